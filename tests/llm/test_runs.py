"""Runs of words against a brute-force search over all periods."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from doctables.llm import runs
from doctables.llm.queries import QUERIES, planted_period


def brute(words):
    """All (start, length, period): each maximal stretch of each period whose smallest period it is."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if size >= max(6, 4 * q) and not any(words[i : j + q - p] == words[i + p : j + q] for p in range(1, q)):
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(rng):
    k, words = rng.choice([1, 2, 3, 5, 50]), []
    while len(words) < rng.randint(0, 150):
        if rng.random() < 0.4:
            unit = [rng.randrange(k) for _ in range(rng.randint(1, 9))] * rng.randint(1, 7)
            words += unit[: len(unit) - rng.randint(0, min(len(unit), 4))]
        else:
            words += [rng.randrange(k) for _ in range(rng.randint(1, 20))]
    return words


def flat(docs):
    return np.array([w for d in docs for w in d], np.int64), np.repeat(np.arange(len(docs)), [len(d) for d in docs])


def shifted(docs):
    out, at = [], 0
    for d in docs:
        out += [(a + at, a + at + n, q) for a, n, q in brute(d)]
        at += len(d)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(4))
def test_random_documents(seed, monkeypatch):
    monkeypatch.setattr(runs, "_PAIRS", 7 if seed % 2 else 2_000_000)
    rng = random.Random(seed)
    for _ in range(80):
        docs = [random_words(rng) for _ in range(rng.randint(1, 8))]
        assert runs.runs_of(*flat(docs)) == shifted(docs), docs


def test_extreme_documents():
    rng = random.Random(5)
    fibonacci = [[0], [0, 1]]
    while len(fibonacci[-1]) < 600:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    block = [rng.randrange(9) for _ in range(61)]
    nested = ([1, 1, 1, 1, 1, 1, 2] * 5 + [3]) * 6
    docs = [[7] * 1000, fibonacci[-1], block * 9, nested, list(range(700)), [4, 5] * 300 + [4], [], [1] * 5, [1] * 6, [1, 2] * 4, [1, 2, 3] * 4]
    assert runs.runs_of(*flat(docs)) == shifted(docs)


def test_grammar_gives_the_words_back():
    rng = random.Random(9)
    docs = [d for d in (random_words(rng) for _ in range(12)) if d]
    words, doc = flat(docs)
    g = runs.Grammar(words, doc)

    def spelled(symbol):
        if symbol < g.terminals:
            return [symbol]
        i = symbol - g.terminals
        assert words[g.start[i] : g.start[i] + g.size[symbol]].tolist() == (own := spelled(g.left[i]) + spelled(g.right[i]))
        return own

    assert [spelled(r) for r in g.roots.tolist()] == docs
    # Pairs that repeat share a nonterminal.
    assert len(g.left) < len(words) - len(docs)


def expected(doc_id, text, change):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if change:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    text = " ".join(w.decode() for i, w in enumerate(words) if i not in gone)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    return len(words), found, best, text


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(runs, "BLOCK", 50)
    rows = [
        (1, "a b " * 40), (1, "a b " * 40), (2, None), (3, ""), (None, "x " * 9), (None, None), (4, " \n\t "), (5, "word " * 30_000),
        (6, "é é é é é é é é é é é é"), (7, "a a a a a a b b b b b b"),
    ]
    extra = ("runs", "collapsed", "n_words", "strongest", "start")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in extra})
    got = runs.find(df.coalesce(2)).collect()
    short = [(i, t) for i, t in rows if i != 5]
    want = sorted(repr((i, *expected(i, t, False))) for i, t in short)
    plain = lambda r: (r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.collapsed)
    assert sorted(repr(plain(r)) for r in got if r.doc_id != 5) == want
    long = next(r for r in got if r.doc_id == 5)
    assert [tuple(x) for x in long.runs] == [(0, 30_000, 1)] and long.collapsed == "word"
    # Equal repeats: the run that starts first.
    assert next(tuple(r.strongest) for r in got if r.doc_id == 7) == (0, 6, 1)
    assert runs.find(df.limit(0)).collect() == []


def test_planted_period_of_no_id():
    assert planted_period(None, []) == [] and planted_period(None, [b"a", b"b"]) == [b"a", b"a"]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    short = {i: t for i, t in docs.items() if len(t or "") < 20_000}
    got = {r.doc_id: r for r in QUERIES["op12_runs"](spark, sf).collect()}
    assert set(got) == set(docs) and len(short) > 100
    for i, text in short.items():
        _, found, best, rest = expected(i, text, True)
        r = got[i]
        assert (r.n_runs, r.runs_sha256, r.collapsed_sha256) == (len(found), sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(rest))
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
