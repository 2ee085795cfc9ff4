"""Periodic runs of words, found in a grammar of the texts.

A run is a stretch of words with smallest period q and at least ``max(LEAST_WORDS, LEAST_REPEATS * q)``
words that no neighbouring word extends. Blocks of whole documents are worked on at once:

1. Re-Pair: words are numbers; pairs of neighbours that occur twice or more become nonterminals. In a
   round, a pair is replaced wherever it is more frequent than both pairs that it overlaps (of equal
   ones side by side, every second), until no pair repeats. What is left is paired off level by level,
   so every document has one root.
2. A run lies in the smallest derivation node that holds it, across that node's boundary. So for each
   nonterminal, once, at its first occurrence: a run across the boundary has two periods on one of its
   sides; periods that pass a comparison of the first words are measured both ways with the names of
   all 2^k words (longest common extensions, exact).
3. Nodes above a run are walked from the roots, which gives the run at all derivation positions.
4. Of one period, stretches that overlap by a period are one; a stretch inside one of smaller period
   has that period and goes.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.llm.common import whole_text

LEAST_WORDS = 6
LEAST_REPEATS = 4
# Words of the documents that are worked on at once; a longer document is a block of its own.
BLOCK = 200_000
# (Boundary, period) pairs that are compared at once, and the words of each compared before names are.
_PAIRS = 2_000_000
_FIRST = 8


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Grammar:
    """Nonterminals of a block: children, length, and start of the first occurrence.

    Numbers below ``terminals`` are words. ``rounds`` are the ranges of nonterminals made together;
    children of one are of earlier rounds. ``roots`` and ``root_at`` are the documents with words.
    """

    def __init__(self, words: np.ndarray, doc: np.ndarray) -> None:
        self.terminals = int(words.max()) + 1 if len(words) else 0
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        self.start: list[np.ndarray] = []
        self.rounds: list[tuple[int, int]] = []
        self._next = self.terminals
        self._names: dict[int, int] = {}
        self._pair_up(words.astype(np.int64), np.arange(len(words)), doc)
        join = lambda parts: np.concatenate([np.empty(0, np.int64), *parts])
        self.left, self.right, self.start = join(self.left), join(self.right), join(self.start)
        size = np.ones(self._next, np.int64)
        for a, b in self.rounds:
            at = slice(a - self.terminals, b - self.terminals)
            size[a:b] = size[self.left[at]] + size[self.right[at]]
        self.size = size

    def _made(self, left: np.ndarray, right: np.ndarray, start: np.ndarray) -> None:
        self.rounds.append((self._next, self._next + len(left)))
        self.left.append(left)
        self.right.append(right)
        self.start.append(start)
        self._next += len(left)

    def _named(self, keys: np.ndarray, at: np.ndarray, sym: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Nonterminals of distinct pairs ``keys``, first seen at ``at``; a pair keeps its name."""
        names = np.empty(len(keys), np.int64)
        new = []
        for i, key in enumerate(keys.tolist()):
            name = self._names.get(key)
            if name is None:
                name = self._names[key] = self._next + len(new)
                new.append(i)
            names[i] = name
        first = at[new]
        self._made(sym[first], sym[first + 1], pos[first])
        return names

    def _pair_up(self, sym: np.ndarray, pos: np.ndarray, doc: np.ndarray) -> None:
        inside = doc[:-1] == doc[1:]
        # Pairs that may repeat. One that occurs once never repeats later: its symbols are as old.
        alive = inside.copy()
        while len(slots := np.flatnonzero(alive)):
            keys = sym[slots] << 32 | sym[slots + 1]
            distinct, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
            alive[slots] = counts[which] > 1
            rank = np.zeros(len(sym) + 1, np.int64)  # of slot i at i + 1; 0: none
            rank[slots + 1] = np.where(counts[which] > 1, counts[which] * len(distinct) + which, 0)
            mine = rank[1:-1]
            best = (mine > 0) & (mine >= rank[:-2]) & (mine >= rank[2:])
            # Neighbours that are both best are the same pair of one symbol.
            step = np.arange(len(best))
            since = np.maximum.accumulate(np.where(best, -1, step))
            chosen = np.flatnonzero(best & ((step - since) % 2 == 1))
            if not len(chosen):
                break
            pairs, first, of = np.unique(sym[chosen] << 32 | sym[chosen + 1], return_index=True, return_inverse=True)
            sym = sym.copy()
            sym[chosen] = self._named(pairs, chosen[first], sym, pos)[of]
            new = np.zeros(len(sym), bool)
            new[chosen] = True
            stays = np.ones(len(sym), bool)
            stays[chosen + 1] = False
            alive = np.append(alive, False)[stays][:-1]
            sym, pos, doc, new = sym[stays], pos[stays], doc[stays], new[stays]
            inside = doc[:-1] == doc[1:]
            alive = (alive | new[:-1] | new[1:]) & inside
        while len(sym) and inside.any():
            heads = np.append(True, ~inside)
            place = np.arange(len(sym))
            place -= np.maximum.accumulate(np.where(heads, place, 0))
            chosen = np.flatnonzero((place[:-1] % 2 == 0) & inside)
            a = self._next
            self._made(sym[chosen], sym[chosen + 1], pos[chosen])
            sym = sym.copy()
            sym[chosen] = np.arange(a, self._next)
            stays = np.ones(len(sym), bool)
            stays[chosen + 1] = False
            sym, pos, doc = sym[stays], pos[stays], doc[stays]
            inside = doc[:-1] == doc[1:]
        self.roots, self.root_at = sym, pos


def _names_of_powers(words: np.ndarray, longest: int) -> list[np.ndarray]:
    """For each k, a name of the 2^k words from every position on (shorter at the end)."""
    names = [words]
    k = 0
    while 2 << k <= longest:
        here = names[-1]
        there = np.full(len(here), -1, np.int64)
        there[: max(len(here) - (1 << k), 0)] = here[1 << k :]
        _, named = np.unique(here * (int(here.max()) + 2) + there + 1, return_inverse=True)
        names.append(named.astype(np.int64))
        k += 1
    return names


def _common(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """Equal words from ``a`` and ``b`` on, or before them, at most ``most``."""
    n = np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        step = 1 << k
        fits = np.flatnonzero(n + step <= most)
        at, other = (a[fits] - n[fits] - step, b[fits] - n[fits] - step) if back else (a[fits] + n[fits], b[fits] + n[fits])
        n[fits[names[k][at] == names[k][other]]] += step
    return n


def _stepwise(words: np.ndarray, x: np.ndarray, q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Whether short periods go on far enough, by at most four periods' words each way."""
    need = np.maximum(LEAST_WORDS, LEAST_REPEATS * q)
    length = q.copy()
    for sign in (1, -1):
        on = np.ones(len(x), bool)
        for i in range(LEAST_REPEATS * _FIRST):
            a = x + i if sign > 0 else x - 1 - i
            on &= (length < need) & ((a + q < hi) if sign > 0 else (a >= lo))
            if not on.any():
                break
            at = np.flatnonzero(on)
            same = words[a[at]] == words[a[at] + q[at]]
            length[at] += same
            on[at] = same
    return length >= need


def _candidates(words: np.ndarray, lo: np.ndarray, mid: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(node, x, q) where a boundary may have two periods q from x on, on its right or left side."""
    nodes = np.arange(len(lo))
    for right in (True, False):
        most = np.minimum((hi - lo) // LEAST_REPEATS, (hi - mid if right else mid - lo) // 2)
        some = nodes[most > 0]
        ends = np.cumsum(most[some])
        at = 0
        while at < len(some):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _PAIRS)))
            here = some[at:to]
            node = np.repeat(here, most[here])
            q = np.arange(1, len(node) + 1) - np.repeat(np.cumsum(most[here]) - most[here], most[here])
            x = mid[node] if right else mid[node] - 2 * q
            for i in range(_FIRST):
                keep = words[x + np.minimum(i, q - 1)] == words[x + q + np.minimum(i, q - 1)]
                node, x, q = node[keep], x[keep], q[keep]
            short = q <= _FIRST
            keep = ~short
            keep[short] = _stepwise(words, x[short], q[short], lo[node[short]], hi[node[short]])
            yield node[keep], x[keep], q[keep]
            at = to


def crossing_runs(words: np.ndarray, doc: np.ndarray, grammar: Grammar) -> tuple[np.ndarray, ...]:
    """(nonterminal's place, start, end, period) of stretches across the boundary of each nonterminal's
    first occurrence, inside it, as offsets from its start; ordered by nonterminal."""
    lo = grammar.start
    mid = lo + grammar.size[grammar.left]
    hi = lo + grammar.size[grammar.terminals :]
    found = list(_candidates(words, lo, mid, hi))
    node, x, q = (np.concatenate([f[i] for f in found]) for i in range(3))
    if not len(node):
        return node, x, x, q
    # Names are only made for documents with candidates.
    named = np.zeros(int(doc[-1]) + 1, bool)
    named[doc[x]] = True
    part = named[doc]
    place = np.cumsum(part) - 1
    names = _names_of_powers(words[part], int((hi[node] - lo[node]).max()))
    a = place[x]
    after = _common(names, a, a + q, hi[node] - x - q, back=False)
    before = _common(names, a, a + q, x - lo[node], back=True)
    start, end = x - before, x + q + after
    keep = (after >= q) & (end - start >= np.maximum(LEAST_WORDS, LEAST_REPEATS * q)) & (start < mid[node]) & (end > mid[node])
    node, start, end, q = node[keep], start[keep], end[keep], q[keep]
    order = np.lexsort((q, node))
    node, start, end, q = node[order], start[order], end[order], q[order]
    # Multiples of a nonterminal's smallest period, inside its stretch.
    head = np.append(True, node[1:] != node[:-1])[: len(node)]
    first = np.maximum.accumulate(np.where(head, np.arange(len(node)), 0))
    keep = head | (start < start[first]) | (end > end[first])
    node, start, end, q = node[keep], start[keep], end[keep], q[keep]
    return node, start - lo[node], end - lo[node], q


def _everywhere(grammar: Grammar, node: np.ndarray, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, period) at all derivation positions."""
    t = grammar.terminals
    own = np.bincount(node, minlength=len(grammar.left))
    first = np.cumsum(own) - own
    leads = np.zeros(t + len(own), bool)
    leads[t:] = own > 0
    for a, b in grammar.rounds:
        leads[a:b] |= leads[grammar.left[a - t : b - t]] | leads[grammar.right[a - t : b - t]]
    wanted = leads[grammar.roots]
    at, pos = grammar.roots[wanted] - t, grammar.root_at[wanted]
    out = []
    while len(at):
        n = own[at]
        which = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        base = np.repeat(pos, n)
        out.append((base + start[which], base + end[which], q[which]))
        left, right = grammar.left[at], grammar.right[at]
        children = np.concatenate([left, right])
        pos = np.concatenate([pos, pos + grammar.size[left]])
        wanted = leads[children]
        at, pos = children[wanted] - t, pos[wanted]
    return tuple(np.concatenate([np.empty(0, np.int64), *(o[i] for o in out)]) for i in range(3))


def _maximal(start: np.ndarray, end: np.ndarray, q: np.ndarray) -> list[tuple[int, int, int]]:
    """Merged stretches with their smallest periods, by start and period."""
    if not len(start):
        return []
    order = np.lexsort((start, q))
    start, end, q = start[order], end[order], q[order]
    # Stretches of one period as one number line per period.
    line = np.cumsum(np.append(False, q[1:] != q[:-1])) * (int(end.max()) + 1)
    reach = np.maximum.accumulate(end + line)
    head = np.append(True, (start + line)[1:] > reach[:-1] - q[1:])
    at = np.flatnonzero(head)
    merged = zip(start[at].tolist(), np.maximum.reduceat(end, at).tolist(), q[at].tolist())
    kept: list[tuple[int, int, int]] = []
    # Of the kept ones, those in no other one: starts and ends both ascend.
    widest: list[tuple[int, int]] = []
    for a, b, period in sorted(merged, key=lambda r: r[2]):
        i = bisect_right(widest, (a, float("inf")))
        if i and widest[i - 1][1] >= b:
            continue
        kept.append((a, b, period))
        while i < len(widest) and widest[i][1] <= b:
            del widest[i]
        insort(widest, (a, b))
    return sorted(kept, key=lambda r: (r[0], r[2]))


def runs_of(words: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs in documents one after the other; ``words`` are numbers,
    ``doc`` the document of each word, ascending. Sorted by start and period."""
    if not len(words):
        return []
    grammar = Grammar(words, doc)
    return _maximal(*_everywhere(grammar, *crossing_runs(words, doc, grammar)))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("strongest", _RUN), ("collapsed", pa.string())])
_DDL = "doc_id long, n_words long, runs array<{0}>, strongest {0}, collapsed string".format("struct<start:long,length:long,period:long>")
Change = Callable[[int | None, list[bytes]], list[bytes]]


def strongest(runs: list[dict]) -> dict | None:
    """The run with most repeats; of equal ones that of least start, then period."""
    return min(runs, key=lambda r: (-Fraction(r["length"], r["period"]), r["start"], r["period"]), default=None)


def _block(ids: list[int | None], docs: list[list[bytes]]) -> pa.RecordBatch:
    numbers = _Numbers()
    sizes = np.array([len(d) for d in docs])
    words = np.fromiter((numbers[w] for d in docs for w in d), np.int64, int(sizes.sum()))
    firsts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(docs)), sizes)
    found: list[list[dict]] = [[] for _ in docs]
    steps = np.zeros(len(words) + 1, np.int64)
    for a, b, q in runs_of(words, doc):
        at = int(doc[a])
        found[at].append({"start": a - int(firsts[at]), "length": b - a, "period": q})
        steps[a + q] += 1
        steps[b] -= 1
    dropped = np.cumsum(steps)[:-1] > 0
    texts = []
    for own, has, first in zip(docs, found, firsts.tolist()):
        if has:
            own = [own[i] for i in np.flatnonzero(~dropped[first : first + len(own)]).tolist()]
        texts.append(b" ".join(own).decode())
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((ids, sizes, found, list(map(strongest, found)), texts), _SCHEMA)], schema=_SCHEMA)


def find(docs: DataFrame, change: Change | None = None) -> DataFrame:
    """Runs of words of every whole text (``doc_id``, ``text``): ``doc_id``, ``n_words``, ``runs`` as
    (``start``, ``length``, ``period``) by start and period, ``strongest``, the one with most repeats (null
    without runs), and ``collapsed``, the words joined by one space without those that a run holds after
    its first period.

    Words are stretches without space, tab to carriage return. ``change`` may replace a document's words
    before. A null or empty text has no words, no runs and an empty text. One row per row: repeated rows
    and rows without an id stay. Other columns are ignored; an empty table stays empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        block: list[list[bytes]] = []
        n = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = text.as_py().encode().split()
                if change is not None:
                    words = change(doc_id, words)
                if n and n + len(words) > BLOCK:
                    yield _block(ids, block)
                    ids, block, n = [], [], 0
                ids.append(doc_id)
                block.append(words)
                n += len(words)
        if ids:
            yield _block(ids, block)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(
        run, _DDL
    )
