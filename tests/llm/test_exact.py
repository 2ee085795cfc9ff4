"""Operators without SQL against brute force, on small inputs."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from doctables.llm import bpe, components, decontaminate, licenses, pii, repeats, simhash
from doctables.llm.queries import QUERIES, vocabulary_file
from doctables.llm.suffixes import deep_shallow

SF = "/root/testdata/sf0.001"


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# ---- simhash ---------------------------------------------------------------------------------


def groups(fingerprints):
    """Component of each fingerprint, by comparing all pairs."""
    label = list(range(len(fingerprints)))
    changed = True
    while changed:
        changed = False
        for i, x in enumerate(fingerprints):
            for j, y in enumerate(fingerprints[:i]):
                if (x ^ y).bit_count() <= 2 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


@pytest.mark.parametrize("long_run", [256, 2])
def test_links_within_two_bits(spark, long_run):
    rng = random.Random(4)
    prints = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(12):
            prints.add(x)
            for bit in rng.sample(range(64), rng.randint(0, 3)):
                x ^= 1 << bit
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = dict(simhash.components(spark.createDataFrame([(s,) for s in signed], "f long"), long_run).collect())
    want = groups(prints)
    by_got, by_want = {}, {}
    for p, s, w in zip(prints, signed, want):
        by_got.setdefault(got[s], set()).add(p)
        by_want.setdefault(w, set()).add(p)
    assert sorted(map(sorted, by_got.values())) == sorted(map(sorted, by_want.values()))


def test_fingerprint_is_the_majority_of_spark_hashes(spark):
    text = "A b c d b C\nd e"
    words = text.lower().split()
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    rows = spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()
    hashes = [r[0] & (1 << 64) - 1 for r in rows]
    want = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint_of(text) & (1 << 64) - 1 == want


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    random.Random(1).shuffle(edges)
    got = dict(components.connected(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, 101: 100}


# ---- bpe -------------------------------------------------------------------------------------

ODD = [
    "", None, " ", "  a", "a  b\n\n c", "<|endoftext|>", "x <|endoftext|> y<|endoftext|><|endoftext|>z<|endoftext", "日本語 テキスト。 ",
    "emoji 😀😀 مرحبا", "\x1c\x1d a\x85\xa0b ²³½ '", " 's 'll'S don't", "𝟘𝟙 x y　z", "\r\n\t x", "''s", "a" * 3000, "é́x", "\x00a",
    "​ ᠎ x", "ⅷ٣ ୨x",
]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = vocabulary_file()
    tok = Tokenizer.from_file(path)
    documents = spark.read.parquet(f"{SF}/documents.parquet").select("text").toPandas()["text"].tolist()
    texts = ODD + documents
    encoded = bpe.encode(frame(spark, texts), path)
    rows = bpe.decode(encoded, path, into="text").collect()
    assert len(rows) == len(texts)
    joined = bpe.encode(frame(spark, texts), path, decoded=True)
    assert {r.doc_id: (r.ids, r.decoded) for r in joined.collect()} == {r.doc_id: (r.ids, r.text) for r in rows}
    for row in rows:
        want = tok.encode(texts[row.doc_id] or "", add_special_tokens=False).ids
        assert row.ids == want
        assert row.text == tok.decode(want, skip_special_tokens=False) == (texts[row.doc_id] or "")


def test_decoding_broken_bytes(spark):
    from tokenizers import Tokenizer

    path = vocabulary_file()
    tok = Tokenizer.from_file(path)
    ids = tok.encode("日本", add_special_tokens=False).ids
    df = spark.createDataFrame([(ids[:1],), (ids[1:],), (None,), ([],)], "ids array<int>")
    df = df.select(F.monotonically_increasing_id().alias("n"), "ids").coalesce(1)
    assert [r.decoded for r in bpe.decode(df, path).orderBy("n").collect()] == [tok.decode(ids[:1]), tok.decode(ids[1:]), "", ""]
    odd = spark.createDataFrame([([-1, 10**6, *ids],), ([7],)], "ids array<int>")
    assert sorted(r.decoded for r in bpe.decode(odd, path).collect()) == sorted([tok.decode(ids), tok.decode([7])])


def test_decoding_joins_distinct_ids(spark):
    df = spark.createDataFrame([([5, 5, 5, 7],), (None,)], "ids array<int>")
    plan = bpe.decode(df, vocabulary_file())._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [id" in plan and "array_distinct" in plan


def test_packed_numbers():
    arrays = [np.array([], dtype=np.int64), np.array([0, 255, 256, 70000, 2**31]), np.array([3])]
    parts, text = bpe._unpacked(bpe._packed(*arrays, text=b"xyz"))
    assert text == b"xyz" and all((p == a).all() for p, a in zip(parts, arrays))
    assert bpe._unpacked_words(bpe._packed_words(["", "é", "a\nb"])) == ["", "é", "a\nb"]


# ---- repeats ---------------------------------------------------------------------------------


def without_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        covered = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(covered)))
        kept = bytes(x for x, c in zip(b, covered) if not c)
        out.append((len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return out


def cleaned(spark, texts, length, gram, crowd=repeats.CROWD):
    docs = frame(spark, texts)
    found = repeats.cleaned_texts(docs, length, gram, crowd).select(
        "same", "n_bytes", "n_removed", F.size("stretches").alias("n"), F.sha2("kept", 256).alias("sha")
    )
    rows = repeats.per_document(docs, found).orderBy("doc_id").collect()
    return [(r.n_bytes, r.n_removed, r.n, r.sha) for r in rows]


@pytest.mark.parametrize("crowd", [repeats.CROWD, 2])
def test_repeats_small(spark, crowd):
    rng = random.Random(9)

    def noise(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    shared = [noise(rng.randint(10, 90)) for _ in range(6)] + ["a" * 70, "with " * 20, "é" * 30]
    texts = ["".join(rng.choice(shared)[rng.randint(0, 5) :] if rng.random() < 0.6 else noise(40) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    texts += texts[:5] + [None, "", noise(19), noise(20), "b" * 5000]
    assert cleaned(spark, texts, 20, 6, crowd) == without_repeats(texts, 20)


def test_repeats_in_documents(spark):
    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    assert cleaned(spark, texts, repeats.LENGTH, repeats.GRAM) == without_repeats(texts, repeats.LENGTH)


def test_repeats_planted_passages(spark, folder):
    """Passages of over 50 words in three documents each: those of 400 bytes and more go, all of them
    and nothing else; one of 399 bytes and documents without a passage stay whole."""
    rng = random.Random(4)

    def words(n):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))

    sizes = [repeats.LENGTH - 1, repeats.LENGTH, repeats.LENGTH + 1, 700]
    passages = [words(110)[:size] for size in sizes]
    assert all(len(p.split()) > 50 for p in passages)
    texts = [words(200) for _ in range(8)] + [f"{words(80)} {x}{p}{x} {words(80)}" for p in passages for x in "XYZ"]
    removed = [0] * 8 + [size if size >= repeats.LENGTH else 0 for size in sizes for _ in "XYZ"]
    frame(spark, texts).write.parquet(f"{folder}/documents.parquet")
    rows = QUERIES["op10_repeats"](spark, folder).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans) for r in rows] == [(len(t), n, int(n > 0)) for t, n in zip(texts, removed)]
    assert [tuple(r)[1:] for r in rows] == without_repeats(texts, repeats.LENGTH)


def test_deep_shallow_order():
    rng = np.random.default_rng(3)
    rows = rng.integers(0, 2, (300, 40)).astype(np.uint8)
    rows[::3, :30] = 1  # long common prefixes
    rows[5] = rows[6]
    order = deep_shallow(rows)
    got = [rows[i].tobytes() for i in order]
    assert got == sorted(got) and sorted(order) == list(range(300))


# ---- decontamination -------------------------------------------------------------------------


def test_seeds_meet_every_two_substitutions():
    from itertools import combinations

    for wrong in combinations(range(decontaminate.MIN_WORDS), 2):
        assert any(
            not any(start + i in wrong for i, bit in enumerate(mask) if bit == "1")
            for mask in decontaminate.MASKS
            for start in range(decontaminate.MIN_WORDS - len(mask) + 1)
        )


def test_leaks_equal_all_alignments(spark):
    rng = random.Random(3)
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: decontaminate.words_of(r.text) for r in benchmark.collect()}
    texts = []
    for i, row in enumerate(spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()):
        words = row.text.split()[:400]
        if i % 3 == 0:
            item = rng.choice(list(items.values()))
            n = rng.randint(12, len(item))
            start = rng.randint(0, len(item) - n)
            part = item[start : start + n]
            for j in rng.sample(range(1, n - 1), int(n * rng.choice([0, 0.1, 0.16]))):
                part[j] = "zzq"
            words[5:5] = part
        texts.append(" ".join(words))
    want = set()
    for i, text in enumerate(texts):
        words = decontaminate.words_of(text)
        for item_id, item in items.items():
            for shift in range(-len(item), len(words)):
                a, b, _ = decontaminate.longest_overlap(words, item, shift)
                if b - a >= min(decontaminate.MIN_WORDS, len(item)):
                    want.add((i, item_id))
                    break
    got = {(r.doc_id, item) for r in decontaminate.leaks(frame(spark, texts), benchmark).collect() for item in r.item_ids}
    assert got == want and len(want) > 20


def slow_overlaps(words, item, shift):
    """All stretches tried one by one: the longest with equal ends and 80 % equal words, then beside it."""
    least = min(decontaminate.MIN_WORDS, len(item))
    same = {i: item[i] == words[i + shift] for i in range(max(0, -shift), min(len(item), len(words) - shift))}

    def inside(lo, hi):
        best = None
        for end in range(hi, lo, -1):
            for a in range(lo, end - least + 1):
                if same[a] and same[end - 1] and 5 * sum(same[i] for i in range(a, end)) >= 4 * (end - a):
                    if best is None or end - a > best[1] - best[0]:
                        best = (a, end)
                    break
        if best is None:
            return []
        a, b = best
        return [*inside(lo, a), (a, b, sum(same[i] for i in range(a, b))), *inside(b, hi)]

    return inside(min(same), max(same) + 1) if sum(same.values()) >= 0.8 * least else []


def all_overlaps(texts, items):
    rows = set()
    for i, text in enumerate(texts):
        words = decontaminate.words_of(text)
        for ids, item in items:
            for shift in range(1 - len(item), len(words)):
                for a, b, n in slow_overlaps(words, item, shift):
                    rows.add((i, ids, a + shift, b + shift, b - a, n))
    return rows


def found_overlaps(spark, texts, benchmark):
    out = decontaminate.leaks(frame(spark, texts), benchmark).collect()
    rows = [(r.doc_id, tuple(r.item_ids), r.doc_start, r.doc_end, r.n_overlap, r.n_equal) for r in out]
    assert len(rows) == len(set(rows))
    return set(rows)


def items_of(spark, texts):
    rows = list(enumerate(texts, 1))
    return spark.createDataFrame(rows, "item_id long, text string"), [((i,), decontaminate.words_of(t)) for i, t in rows]


@pytest.mark.parametrize("common", [0, 1_000_000])
def test_overlap_rows_equal_all_diagonals(spark, monkeypatch, common):
    """Every row, with seeds that many items share (all of them, or none)."""
    monkeypatch.setattr(decontaminate, "COMMON", common)
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [" ".join(rng.choices(vocabulary, k=rng.choice([6, 7, 9, 10, 11, 12, 15, 15, 16, 20, 25, 31, 45]))) for _ in range(30)]
    texts = []
    for _ in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(items).split()
            for j in rng.sample(range(len(part)), int(len(part) * rng.choice([0, 0.1, 0.2]))):
                part[j] = rng.choice(["zzq", rng.choice(vocabulary)])
            at = rng.randint(0, len(words))
            words[at:at] = part
        texts.append(" ".join(words))
    benchmark, listed = items_of(spark, items)
    want = all_overlaps(texts, listed)
    assert found_overlaps(spark, texts, benchmark) == want and len(want) > 40


def test_no_placement_of_substitutions_is_lost():
    for masks in (decontaminate.MASKS, decontaminate.wide_masks()):
        for words, wrong in decontaminate.TRIED:
            assert not len(decontaminate.uncovered(masks, words, wrong))
    assert {m.count("1") for m in decontaminate.wide_masks()} == {decontaminate.WIDE}
    # A short item with equal ends: one of the pieces of three words is untouched.
    for n in range(decontaminate.SHORTEST, decontaminate.MIN_WORDS):
        left = decontaminate.uncovered([decontaminate.SHORT_MASK], n, n // 5)
        assert all(x & 1 or x >> (n - 1) & 1 for x in left.tolist())


def test_two_copies_give_two_rows_and_a_long_item_changes_none(spark):
    item = " ".join(f"q{i}" for i in range(20))
    texts = [f"{' '.join(f'a{i}' for i in range(9))} {item} {' '.join(f'b{i}' for i in range(20))} {item} end", "nothing of it here"]
    benchmark, _ = items_of(spark, [item])
    rows = {(0, (1,), 9, 29, 20, 20), (0, (1,), 49, 69, 20, 20)}
    assert found_overlaps(spark, texts, benchmark) == rows
    long = " ".join(f"long{i}" for i in range(5_000))
    longer, _ = items_of(spark, [item, long])
    assert found_overlaps(spark, texts, longer) == rows


def test_items_of_one_opening(spark):
    """2,000 items that start alike: documents with the opening alone give no candidates."""
    opening = "which of the following is the best known"
    items = [f"{opening} {' '.join(f'x{i}y{j}' for j in range(12))}" for i in range(2_000)]
    benchmark, _ = items_of(spark, items)
    texts = [f"so {opening} answer number {i} to that" for i in range(300)] + [f"and {items[7]} or so", " ".join(items[9].split()[:11]) + " cut off"]
    found_items, _ = decontaminate._items(benchmark)
    seeds = decontaminate.benchmark_seeds(found_items).persist()
    docs = frame(spark, texts).select("doc_id", F.md5("text").alias("same"), "text")
    found = decontaminate.scan(docs, decontaminate._filter_bits(seeds), 40).persist()
    assert found.count() == len(texts)
    assert decontaminate._candidates(found_items, seeds, found).count() <= 2
    assert found_overlaps(spark, texts, benchmark) == {(300, (8,), 1, 21, 20, 20)}


# ---- personal data ---------------------------------------------------------------------------

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_base_spans_equal_plain_search():
    rng = random.Random(5)
    parts = ["a@.-", "0123456789", "0 -.", "+() 12", "a.b@", "1.2.3.4", "é\n", "4111 1111 1111 1111 ", "+1 (555) 123-4567"]
    n = 0
    for _ in range(20000):
        text = "".join(rng.choice(rng.choice(parts)) for _ in range(rng.randint(0, 60))) + rng.choice(["", *parts])
        want = []
        for kind, pattern in BASE.items():
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m.group())
                good = {
                    "email": lambda: True,
                    "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),
                    "card": lambda: 12 <= len(digits) <= 19 and pii.luhn(digits),
                    "phone": lambda: 9 <= len(digits) <= 15,
                }[kind]()
                if good:
                    want.append((kind, m.start(), m.end()))
        got = [s[:3] for s in pii.scored_spans(text) if s[0] in pii.BASE_KINDS]
        assert got == sorted(want, key=lambda s: (s[1], pii.KINDS.index(s[0])))
        n += len(want)
    assert n > 3000


def test_checks_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765431")
    text = "Pay to IBAN GB82 WEST 1234 5698 7654 32. SSN 123-45-6789"
    assert [s[0] for s in pii.scored_spans(text)] == ["iban", "ssn"]
    assert pii.scored_spans("model 123-45-6789") == []
    assert pii.redacted_text("mail a@b.co, call +1 (555) 123-4567!") == "mail [EMAIL], call [PHONE]!"


@pytest.mark.parametrize("after", ["", " THIS is", " this is", ".", " 12 more", " AB12 CD34", "\nNEXT"])
def test_accounts_end_with_their_country_s_length(after):
    for account in ("BE68 5390 0754 7034", "BE68539007547034", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"):
        text = f"account {account}{after}"
        assert [(s[0], text[s[1] : s[2]]) for s in pii.scored_spans(text) if s[0] == "iban"] == [("iban", account)]
    for wrong in ("BE68 5390 0754 7035", "XX68 5390 0754 7034", "BE68 5390 0754 703", "BE68 5390 0754 70341", "ABE68 5390 0754 7034"):
        assert not [s for s in pii.scored_spans(f"account {wrong}{after}") if s[0] == "iban"]


def test_context_decides():
    account, number, run = "BE68 5390 0754 7034", "123-45-6789", "9f3A77c0b1e84d52aa61" * 2
    kinds = lambda text: [s[0] for s in pii.scored_spans(text) if s[0] not in pii.BASE_KINDS]
    assert kinds(f"see {account} there") == ["iban"] and kinds(f"part model {account} in stock") == []
    assert kinds(f"bank account, part 2: {account}") == ["iban"]
    assert kinds(f"ssn {number}") == ["ssn"] and kinds(f"see {number}") == [] and kinds(f"ssn, order {number}") == []
    assert kinds(f'token = "{run}"') == ["secret"] and kinds(f"see {run}") == [] and kinds(f"token commit {run}") == []
    assert kinds("token = aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1") == [] and kinds(f"password {'x' * 40}") == []
    # The first four kinds stay whatever their score.
    (span,) = pii.scored_spans("version section 1.2.3.4 of it")
    assert span[0] == "ip" and span[3] < pii.LEAST_SCORE
    for kind, words in pii.AGAINST.items():
        assert pii.SCORES[kind] - 0.25 < pii.LEAST_SCORE or kind in pii.BASE_KINDS, (kind, words)


def test_scores_stand_beside_the_spans(spark):
    from doctables.llm.queries import QUERIES

    rows = QUERIES["op2_pii"](spark, "/root/testdata/sf0.001").filter("spans <> ''").collect()
    assert rows and all(len(r.spans.split(",")) == len(r.scores.split(",")) for r in rows)
    assert all(0 <= float(s) <= 1 for r in rows for s in r.scores.split(","))


# ---- licenses --------------------------------------------------------------------------------


def test_patience_alignment():
    a, b = "x a b c y d z".split(), "a b q c d".split()
    assert licenses.patience(a, b) == [(1, 0), (2, 1), (3, 3), (5, 4)]
    assert licenses.patience([], b) == [] and licenses.patience(["", "a"], ["", "a"]) == [(1, 1)]
    rng = random.Random(2)
    for _ in range(300):
        a, b = ([rng.choice("abcdefg") for _ in range(rng.randint(0, 12))] for _ in "ab")
        pairs = licenses.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p < q and r < s for (p, r), (q, s) in zip(pairs, pairs[1:]))


def test_license_notices(spark):
    known = [licenses.Template.of(*t) for t in licenses.TEMPLATES]
    mit = licenses.TEMPLATES[2][2]
    twice = licenses.scan_text(f"{'foo ' * 50}{mit} bar {mit} {mit}", known)
    assert [(f.name, f.start, f.coverage) for f in twice] == [("MIT", 50, 1.0), ("MIT", 137, 1.0), ("MIT", 223, 1.0)]
    edited = mit.replace("hereby granted", "hereby given").replace("restriction", "limits")
    assert [f.name for f in licenses.scan_text(edited, known)] == ["MIT"]
    assert licenses.scan_text("released under the BSD License, mit freundlichem license", known) == []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lines = {"Apache-2.0": "under the Apache License, Version 2.0", "MIT": "Released under the MIT License", "GPL-3.0": "GNU General Public License, version 3", "CC-BY-NC-4.0": "under CC BY-NC 4.0"}
    want = sorted((r.doc_id, name) for r in docs.collect() for name, line in lines.items() for _ in range(r.text.count(line)))
    assert sorted((r.doc_id, r.license) for r in licenses.scan(docs).collect()) == want


def test_license_texts_without_any_one_word():
    """Each word of a long text replaced in turn, a sign on every line, and signs over the bound of size."""
    known = [licenses.Template.of(*t) for t in licenses.TEMPLATES]
    for t, (name, _, text) in zip(known, licenses.TEMPLATES):
        words = text.split()
        if len(words) < 30:
            continue
        for i, w in enumerate(t.words):
            if w in t.needed:
                continue
            edited = [*words[:i], "other", *words[i + 1 :]]
            assert [f.name for f in licenses.scan_text("foo " * 70 + " ".join(edited) + " bar" * 70, known)] == [name], (name, w)
        for lead in range(0, 2 * len(words), 7):
            signs = " ".join(w + " #" * (i % 5 == 4) for i, w in enumerate(words))
            found = licenses.scan_text("foo " * lead + signs + " bar" * 70, known)
            assert [(f.name, f.start, f.coverage) for f in found] == [(name, lead, 1.0)], (name, lead)
    assert [f.name for f in licenses.scan_text(licenses.TEMPLATES[2][2].replace("sublicense", "sub-\nlicense"), known)] == ["MIT"]
