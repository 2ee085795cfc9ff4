"""Nulls, empty and long texts, ties, repeated rows, empty tables, and extra columns everywhere."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import queries
from doctables.llm import bpe, decontaminate, fertility, licenses, pii, quality, repeats, simhash, toxicity, webpages
from doctables.llm.queries import QUERIES, vocabulary_file

LONG = "word " * 60_000
ROWS = [
    (1, "plain words here " * 10, "en", "s", 170, 1), (1, "plain words here " * 10, "en", "s", 170, 1), (2, None, None, None, None, None),
    (3, "", "en", "s", 0, 2), (None, "no id at all " * 40, "en", None, 9, 3), (None, None, None, None, None, None), (4, " \n\t ", "de", "s", 4, 4),
    (5, LONG, "en", "s", len(LONG), 5), (6, "mail a@b.co 4111 1111 1111 1111", "fr", "s", 30, 6),
]
# Extra columns with the names that operators give.
DDL = "doc_id long, text string, lang string, source string, n_chars long, score long"
EXTRA = ("spans", "f", "at", "row", "same", "block", "ids", "words", "component_id", "kept", "label", "group", "key", "n_bytes")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DDL).withColumns({c: F.lit("x") for c in EXTRA}).coalesce(2)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


LABELS = [(1, 1, 0), (1, 1, 0), (3, None, None), (5, 0, 1), (6, 1, 0), (None, 1, 1), (99, 0, 0)]


def operators(spark, labelled):
    """Each operator as a function of documents, and the rows it gives for ``ROWS`` (None: any)."""
    path = vocabulary_file()
    benchmark = spark.createDataFrame(
        [(1, "plain words here plain words here plain words here plain words here"), (2, None), (None, ""), (3, "a b")], "item_id long, text string"
    )
    n = len(ROWS)
    return {
        "licenses": (lambda d: licenses.scan(d), 0),
        "pii": (lambda d: pii.find(d), n),
        "redact": (lambda d: pii.redact(d), n),
        "fertility": (lambda d: fertility.judged(d, vocabulary_file("piece_bpe_32k.model"), vocabulary_file("byte_bpe_multi_50k.tiktoken")), n),
        "bpe": (lambda d: bpe.encode(d, path), n),
        "leaks": (lambda d: decontaminate.leaks(d, benchmark), None),
        "without_leaks": (lambda d: decontaminate.without_leaks(d, benchmark), n - 2),
        "quality": (lambda d: quality.score(d, quality.fit(d, labelled), "own"), n),
        "simhash": (lambda d: simhash.near_duplicates(d), n),
        "simhash_kept": (lambda d: simhash.without_near_duplicates(d), 5),
        "toxicity": (lambda d: toxicity.score(d, toxicity.fit(d, labelled), "own"), n),
        "repeats": (lambda d: repeats.per_document(d, repeats.cleaned_texts(d)), n),
    }


NAMES = [
    "licenses", "pii", "redact", "fertility", "bpe", "leaks", "without_leaks", "quality", "simhash", "simhash_kept", "toxicity", "repeats"
]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, docs, name):
    run, n = operators(spark, labels(spark, LABELS))[name]
    rows = run(docs).collect()
    assert n is None and rows or len(rows) == n


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, docs, name):
    run, _ = operators(spark, labels(spark, []))[name]
    assert run(docs.limit(0)).collect() == []


def test_defined_results(spark, docs):
    found = simhash.near_duplicates(docs).collect()
    zero = [r for r in found if r.fingerprint == "0" * 16]
    assert {r.component_id for r in zero} == {2} and len(zero) == 4
    assert [r.component_id for r in found if r.doc_id is None and r.fingerprint != "0" * 16] == [None]
    kept = simhash.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 5), (False, 6), (True, 0)]
    redacted = {r.doc_id: r for r in pii.redact(docs).collect() if r.doc_id is not None}
    assert redacted[6].text == "mail [EMAIL] [CARD]" and redacted[6].n_chars == 19 and redacted[2].text is None
    judged = {r.doc_id: r for r in fertility.judged(docs, vocabulary_file("piece_bpe_32k.model")).collect()}
    assert not judged[2].kept and judged[2].n_words == 0 and judged[5].n_repeat_words == 60_000 and judged[5].base_failed
    same = {r.doc_id: r.n_removed for r in repeats.per_document(docs, repeats.cleaned_texts(docs)).collect()}
    assert same[5] == len(LONG) and same[1] == 0 and same[3] == 0


def test_word_rules_equal_plain_counts():
    import random

    rng = random.Random(8)
    for _ in range(300):
        lines = [" ".join(rng.choice(["aa", "b#", "c", "d\x0bd", "é"]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 9))]
        text = "\n".join(lines)
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
        assert fertility.repeated_words(words) == len(covered)
        seen, n = set(), 0
        for line in text.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                n += line in seen
                seen.add(line)
        assert fertility.duplicate_lines(text) == n


def test_bands_reject_low_entropy_only(spark):
    import random

    rng = random.Random(6)

    def text(words):
        return " ".join("".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 7))) for _ in range(words))

    def junk(words):
        few = [text(1) for _ in range(12)]
        return " ".join(rng.choice(few) for _ in range(words))

    rows = [(i, junk(100) if i % 40 == 0 else text(100), None) for i in range(400)]
    got = fertility.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string"), vocabulary_file("piece_bpe_32k.model")).collect()
    assert {r.doc_id for r in got if not r.kept} == {i for i in range(400) if i % 40 == 0}


def test_every_length_is_judged(spark):
    """Few long documents of one length are judged by shorter ones, along the trend of their entropy."""
    import random

    rng = random.Random(7)
    stems = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(2, 7))) for _ in range(3_000)]
    weights = [1 / (i + 1) for i in range(len(stems))]

    def text(words):
        return " ".join(rng.choices(stems, weights, k=words))

    def junk(words):
        return " ".join(rng.choices(stems[:14], k=words))

    sizes = [n for n in (60, 90, 130, 190, 270, 380) for _ in range(70)]
    rows = [(i, text(n), None) for i, n in enumerate(sizes)]
    rows += [(1_000 + i, text(1_000 * 2**i), None) for i in range(5)] + [(2_000 + i, junk(1_000 * 2**i), None) for i in range(5)]
    run = lambda r: fertility.judged(spark.createDataFrame(r, "doc_id long, text string, lang string"), vocabulary_file("piece_bpe_32k.model"))
    assert {r.doc_id for r in run(rows).collect() if not r.kept and not r.base_failed} == {2_000 + i for i in range(5)}
    few = [(i, text(100), None) for i in range(20)] + [(99, junk(100), None)]
    assert [r.doc_id for r in run(few).collect() if not r.kept and not r.base_failed] == [99]
    assert fertility.neighbours({4: 30, 5: 30, 9: 1}, 50) == [(4, 4), (4, 5), (5, 4), (5, 5), (9, 4), (9, 5), (9, 9)]


def test_measures_of_two_vocabularies(spark):
    """Against the tokens of each whole word by the libraries themselves."""
    import base64
    from collections import Counter

    import numpy as np
    import sentencepiece
    import tiktoken

    paths = [vocabulary_file(name) for name in ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")]
    texts = ["plain words, and more words", "\u6f22\u5b57 \u00e9t\u00e9 \U0001f600 x", "aaaa aaaa", "", "one\u00a0word 12ab"]
    rows = fertility.measured(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), *paths).orderBy("doc_id").collect()
    model = sentencepiece.SentencePieceProcessor(model_file=paths[0])
    with open(paths[1], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pairs = tiktoken.Encoding("t", pat_str=r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+", mergeable_ranks=ranks, special_tokens={})

    def broken(token):
        try:
            return not pairs.decode_single_token_bytes(token).decode() and False
        except UnicodeDecodeError:
            return True

    for text, row in zip(texts, rows):
        words = [w.decode() for w in text.encode().split()]
        for suffix, encode, single, size in (("", model.encode, model.is_byte, 32_000), ("2", pairs.encode_ordinary, broken, len(ranks))):
            tokens = [t for w in words for t in encode(w)]
            share = np.array(list(Counter(tokens).values())) / max(len(tokens), 1)
            want = (0.0, 0.0, 0.0)
            if tokens:
                most = np.log2(min(len(tokens), size)) if len(tokens) > 1 else 1.0
                want = (sum(map(len, words)) / len(tokens), sum(map(single, tokens)) / len(tokens), -(share * np.log2(share)).sum() / most)
            assert np.allclose([row["chars_per_token" + suffix], row["byte_share" + suffix], row["entropy" + suffix]], want, atol=1e-9), text
    assert rows[1].byte_share2 > 0 and rows[0].byte_share2 == 0


def test_a_hot_language_is_split(spark):
    """Most rows have one language and length; the join with the bands has them under several keys."""
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("word"), (F.col("id") + i) % 97)), " ")
    lang = F.when(F.col("id") % 9 == 0, F.concat(F.lit("l"), F.col("id") % 40)).otherwise("en")
    df = spark.range(6_000).select(F.col("id").alias("doc_id"), words.alias("text"), lang.alias("lang"))
    out = fertility.judged(df, vocabulary_file("piece_bpe_32k.model"))
    assert "_salt" in out._jdf.queryExecution().optimizedPlan().toString()
    rows = out.collect()
    assert len(rows) == 6_000 and len({r.doc_id for r in rows}) == 6_000 and all(r.kept for r in rows)


def test_pages_with_nulls(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", ""), (None, None, "<p>x"), (2, "u", "<article><p>A text.</p></article>")], "page_id long, url string, html string")
    got = [r.text for r in webpages.with_main_text(pages).collect()]
    assert got[0] == got[1] == "" and got[3] == "A text."
    assert webpages.with_main_text(pages.limit(0)).collect() == []


def test_odd_pages(spark):
    """Clashing columns, repeated rows with other values, a very long page and deep nesting."""
    text = "The whole text of a very long page goes on and on. " * 20_000
    rows = [(1, "u", "<article><p>A text.</p></article>"), (1, "v", "<article><p>A text.</p></article>"), (3, "w", f"<nav>x</nav><p>{text}</p>"),
            (4, "z", "<div>" * 20_000 + text[:500] + "</div>" * 20_000)]
    extra = {c: F.lit(7) for c in ("text", "n_chars", "words", "aside", "main", "title")}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(extra)
    out = webpages.with_main_text(pages)
    assert sorted(out.columns) == sorted(pages.columns)
    got = {(r.page_id, r.url): r.text for r in out.collect()}
    assert got[1, "u"] == got[1, "v"] == "A text." and got[3, "w"] == text.strip() and got[4, "z"] == text[:500].strip()


def test_queries_are_registered_under_their_numbers():
    names = [n for n in queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and set(names) == set(QUERIES)
    assert "pipeline" in queries() and len(corpus_pipeline.STAGES) == 5


def test_pipeline_equals_its_stages_by_hand(spark):
    """Every stage against what its operator says about its own input."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        before = {r.doc_id: r for r in docs.collect()}
        after = {r.doc_id: r for r in out.collect()}
        assert set(after) <= set(before)
        if name == "bpe":
            assert set(after) == set(before)
            break
        assert out.columns == columns
        if name == "simhash near-dedup":
            groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
            assert set(after) == set(groups.values())
        if name == "benchmark decontamination":
            leaked = {r.doc_id for r in decontaminate.leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert set(after) == set(before) - leaked
        if name == "personal data":
            assert set(after) == set(before)
            assert all(r.text == pii.redacted_text(before[i].text) and r.n_chars == len(r.text) for i, r in after.items())
        docs = spark.createDataFrame(list(after.values()), docs.schema)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == set(before)
