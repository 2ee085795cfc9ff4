"""Trained operators: gradients, held-out accuracy, and the same result on the same data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from doctables.llm import quality, toxicity, webpages
from doctables.llm.common import in_pieces
from doctables.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_gradients():
    net = toxicity.Network.fresh()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    for name in ("words", "chars"):
        net.w[name] = np.random.default_rng(3).standard_normal(len(net.w[name]))
    words = ["abc", "defgh", "x", "word", "zz"]
    at = np.array([[0, 1, 2, 3], [4, 4, -1, -1], [3, -1, -1, -1]])
    y = np.array([1.0, 0, 1])
    _, grad = net.gradients(words, at, y)
    rng = np.random.default_rng(0)
    for name, g in grad.items():
        places = np.argwhere(np.abs(g) > 1e-4)
        for place in places[rng.permutation(len(places))[:3]]:
            place, step = tuple(place), 1e-3
            old = net.w[name][place]
            net.w[name][place] = old + step
            up = net.gradients(words, at, y)[0]
            net.w[name][place] = old - step
            down = net.gradients(words, at, y)[0]
            net.w[name][place] = old
            assert (up - down) / (2 * step) == pytest.approx(g[place], abs=2e-5)


def test_windows_cover_all_words():
    for n in (0, 1, 64, 65, 100, 112, 113, 500):
        starts = toxicity.windows_of(n)
        covered = {i for s in starts for i in range(s, min(n, s + toxicity.WINDOW))}
        assert covered == set(range(n)) and len(starts) == len(set(starts))
        assert all(b - a < toxicity.WINDOW for a, b in zip(starts, starts[1:]))


def test_toxic_words_are_learned_and_their_forms_recognised():
    rng = np.random.default_rng(1)
    stems = ["grumble", "snarkle"]

    def text(bad):
        words = ["".join(rng.choice(list("aeioulnrst"), rng.integers(2, 8))) for _ in range(int(rng.integers(5, 200)))]
        for _ in range(3 * bad):
            words[rng.integers(len(words))] = stems[rng.integers(2)] + "".join(rng.choice(list("aeinst"), 3))
        return " ".join(words)

    labels = np.arange(900) % 2  # with a few hundred documents the forms are not learned
    net = toxicity.train([text(int(b)) for b in labels], labels)
    scores = toxicity.Scorer(net).of([text(int(b)) for b in labels])
    assert ((scores >= toxicity.THRESHOLD) == labels).mean() > 0.9
    # Texts without words are not toxic.
    assert (toxicity.Scorer(net).of(["", " \n", "..."]) < toxicity.THRESHOLD).all()


def test_all_of_a_long_word_counts():
    net = toxicity.Network.fresh()
    net.w["chars"] = np.random.default_rng(3).standard_normal(toxicity.CHAR_ROWS).astype(np.float32)  # the n-grams alone
    text = "\u4e2d\u6587\u5b57" * 100
    one, two = toxicity.Scorer(net).of([text + "\u9fa0\u9fa1", text + "\u9fa2\u9fa3"])
    assert abs(one - two) > 1e-6
    for word in ("".join(map(str, range(n))) if n < 99 else "".join(map(chr, range(n, n + 500))) for n in (30, 90, 0x4E00, 0x1F600)):
        pieces = in_pieces([word])
        starts = [word.index(piece) for piece in pieces]
        assert starts[0] == 0 and word.endswith(pieces[-1]) and all(len(piece.encode()) <= 64 for piece in pieces)
        ends = [s + len(piece) for s, piece in zip(starts, pieces)]
        assert all(len(word[s:e].encode()) >= 8 for s, e in zip(starts[1:], ends))
    features = quality.Features()
    assert (features.of("ab/" * 40) != features.of("ab/" * 40 + "12?" * 40)).any() and quality.shape("a1" * 20) == "a0" * 20 + "~"


def test_quality_held_out(spark):
    rows = QUERIES["op7_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    held = rows.filter("held_out").select("quality", "predicted").collect()
    assert sum(r.quality == r.predicted for r in held) / len(held) > 0.9
    good = [r.predicted for r in held if r.quality == 1]
    assert sum(good) / len(good) > 0.97


def test_toxicity_held_out(spark):
    """Learned from 36 toxic documents. Of the 14 held-out ones, five have no telling word in common with those."""
    rows = QUERIES["op9_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    held = rows.filter("held_out").select("toxic", "predicted").collect()
    assert sum(r.toxic for r in held) == 14
    assert sum(r.predicted for r in held if r.toxic == 1) >= 8
    assert sum(r.predicted for r in held if r.toxic == 0) <= 2


def test_rows_of_few_documents_say_nothing():
    docs = [["bad", "good", f"own{i}"] if i % 2 else ["good", f"own{i}"] for i in range(40)]
    words, _ = toxicity._informed(docs, np.arange(40) % 2)
    rows = toxicity.word_rows([f"own{i}" for i in range(40)]).tolist()
    bad, good = toxicity.word_rows(["bad", "good"]).tolist()
    assert words[bad] > 0.5 and abs(words[good]) < 0.1
    assert not words[[r for r in rows if rows.count(r) < toxicity.LEAST_DOCS and r not in (bad, good)]].any()


def test_texts_without_words_have_their_own_answer(spark):
    rows = np.abs(np.random.default_rng(4).standard_normal((9, quality.DIMENSIONS))).astype(np.float32)
    nothing = np.zeros((1, quality.DIMENSIONS), np.float32)
    for labels, share in (([1] * 9, 0.0), ([1] * 6 + [0] * 3, 0.0)):
        assert quality.voters(rows, np.array(labels)).score(nothing)[0] == share
    few = rows.copy()
    few[6:] = 0  # three labelled texts without words
    for labels, share in (([1] * 9, 0.75), ([1] * 6 + [0] * 3, 0.0), ([1] * 7 + [0] * 2, 0.25)):
        model = quality.voters(few, np.array(labels))
        assert model.score(nothing)[0] == share and len(model.labels) == 6
    sf = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n\t ")], "doc_id long, text string")
    labelled = spark.read.parquet(f"{SF}/labels.parquet")
    scored = quality.score(odd, quality.fit(sf, labelled)).collect()
    assert [r.score for r in scored] == [0.0] * 3 and quality.THRESHOLD > 0


def test_votes_do_not_depend_on_blocks():
    rng = np.random.default_rng(2)
    rows = np.abs(rng.standard_normal((80, quality.DIMENSIONS))).astype(np.float32)
    model = quality.voters(rows, np.arange(80) % 2)
    whole = model.score(rows)
    parts = np.concatenate([model.score(rows[i : i + 7]) for i in range(0, 80, 7)])
    assert np.allclose(whole, parts, atol=1e-5) and ((0 <= whole) & (whole <= 1)).all()
    none = quality.voters(rows[:0], np.zeros(0))
    assert (none.score(rows) == 0.5).all()


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head>
<body class="article-page"><header class="site"><a href="/">Home</a> Name</header>
<div id="cookie-notice"><p>We use cookies to improve your experience, please accept them all.</p><button>OK</button></div>
<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><main><article><header><h1>Title &amp; more</h1></header>
<p>First paragraph with <a href="x>y">a link</a> in it.<p>Sec<b>ond</b>.<br>Line <div class="ad-slot">Buy now</div>
<form><input><label>Mail</label></form><ul><li>point one<li>point two</ul><aside class=sidebar>Side text</aside><p>Last&nbsp;one</p></article>
<section id="comments"><h2>Comments</h2><div class="comment"><p>A long comment that goes on and on for quite some time.</p></div></section>
</main><footer>&copy; 2020</footer></body></html>"""


def test_article_without_the_rest():
    tree = webpages.grown()
    assert webpages.main_text(PAGE, tree) == (
        "Title & more First paragraph with a link in it. Second. Line point one point two Last one"
    )
    for odd in ("", " ", "<", "<p", "<!--", "<script>x", "<![CDATA[", "</"):
        assert webpages.main_text(odd, tree) in ("", "<")


STORY = (
    "<h1>A day at the lake</h1><p>We left the town early and took the small road along the river to the lake, where the water was still and "
    "cold, and nobody else had come yet.</p><p>Short, but fine.</p><p>In the afternoon the wind rose, and we had to turn back before the rain "
    "came over the hills and the road became too muddy to drive on safely.</p>"
)
SAID = " ".join(part for part in __import__("re").split(r"<[^>]+>", STORY) if part)
MENU = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News and weather</a></li><li><a href=/c>About</a></li></ul>"
LONG_COMMENT = "<p>" + "I was there too and it was not at all like that, since the road had been closed for a week. " * 12 + "</p>"
LAYOUTS = {
    "wrapper with a sidebar": f"<div class='content has-sidebar'><article>{STORY}</article><div class='sidebar'>{MENU}</div></div>",
    "sharing is on": f"<nav>{MENU}</nav><article class='post share-enabled'>{STORY}</article><footer>2020 Lake News</footer>",
    "page with a banner": f"<div id='page' class='with-banner'><div class=banner>Buy a boat now</div><main>{STORY}</main></div>",
    "no adverts": f"<div class='no-ads'><div id=menu>{MENU}</div><div class=story>{STORY}</div></div>",
    "form around the page": f"<form id=f action=/x><div id=nav>{MENU}</div><div class='text'>{STORY}</div><div class=footer>2020 Lake News</div></form>",
    "category names": f"<article class='post type-post tag-legal category-comment'>{STORY}</article><div class='related-posts'>{MENU}</div>",
    "wrapper named like a box": f"<div class='widget'><div class='widget-body'><div class='post-content'>{STORY}</div></div></div><footer>2020</footer>",
    "comments longer than the article": f"<article>{STORY}</article><section id='comments'><article class='comment-body'>{LONG_COMMENT}</article></section>",
    "comments in the article": f"<main><article>{STORY}<div class='comment-list'>{LONG_COMMENT}</div></article></main>",
    "teasers": f"<main>{STORY}</main><aside><article class=teaser><h2>More of it</h2><p>A teaser text about some other lake in another country.</p></article></aside>",
    "notice around the article": f"<div class='notice'><article>{STORY}</article></div><div id=comments>{LONG_COMMENT}</div>",
    "role of the main part": f"<div role=navigation>{MENU}</div><div role=main>{STORY}</div><div role=contentinfo>Lake News, all rights</div>",
    "hidden part": f"<article>{STORY}<div style='display: none'>You have read all free stories.</div></article><div aria-hidden=true>Wait</div>",
    "only plain elements": f"<div><div><a href=/a>Home</a></div><div><a href=/b>News</a></div></div>{STORY}<div>2020 <a href=/p>Privacy</a></div>",
    "no marks at all": f"<ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul><div>{STORY}</div><div><a href=/t>Terms</a></div>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_the_article_survives_its_wrappers(name):
    page = f"<!DOCTYPE html><html><head><title>No</title></head><body class='sidebar post-template'>{LAYOUTS[name]}</body></html>"
    assert webpages.main_text(page, webpages.grown()) == SAID


@pytest.mark.parametrize(
    ("names", "says"),
    [("comment-list commentBody reply_form", 2), ("sidebar site-footer ad_slot-2 share", 1), ("entry-content postBody", 3),
     ("has-sidebar no-ads with-banner tag-legal category-comment share-enabled x", 0)],
)
def test_names_of_elements(names, says):
    assert {webpages._named(n) for n in names.split()} == {says}


def test_plain_pages_of_the_table():
    """The table's pages with all block elements made plain: neighbours alone decide."""
    import html
    import re
    from collections import Counter

    import pyarrow.parquet as pq

    tree, counts = webpages.grown(), Counter()
    for page in pq.read_table(f"{SF}/pages.parquet").column("html").to_pylist():
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        want = Counter(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))).split())
        plain = re.sub(r"<(/?)(?:nav|ul|li|article|h1|p|footer|div)\b[^>]*>", r"<\1div>", page)
        got = Counter(webpages.main_text(plain, tree).split())
        counts.update(both=(want & got).total(), got=got.total(), want=want.total(), empty=not got)
    assert counts["both"] >= 0.99 * counts["got"] and counts["both"] >= 0.99 * counts["want"] and not counts["empty"]


def test_tree_fits_its_table():
    tree = webpages.grown()
    marked = webpages.labelled()
    assert all((tree.of(tuple(row[:-1])) > 0.5) == bool(row[-1]) for row in marked)


def test_pages_of_the_table(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in QUERIES["op4_webpages"](spark, SF).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        plain = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)>", " ", inner))
        assert got[r.page_id] == " ".join(html.unescape(plain).split())


@pytest.mark.parametrize("name", ["op7_quality", "op9_toxicity"])
def test_scores_are_the_same_again(spark, name):
    sf = "/root/testdata/sf0.001"
    key = F.round("score", 4)
    one, two = ({(r[0], r[1]) for r in QUERIES[name](spark, sf).select("doc_id", key).collect()} for _ in "ab")
    assert one == two
