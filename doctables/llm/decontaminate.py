"""Benchmark passages in documents, by spaced seeds.

A seed is the hash of the words under a fixed mask; words under its zeros are ignored. Any twelve or
more words in a row of which 80 % are equal have a common seed of one of the masks below (tried for
all placements of substitutions; a longer row has a part of at most 29 words that is tried). Items of
6 to 11 words have seeds of three words in a row, of which one is always untouched.

1. The benchmark's seeds set bits of a filter of fixed size, which every task gets.
2. Documents are scanned once. A seed that passes the filter keeps the words around it, as hashes;
   stretches that touch are one.
3. Kept seeds are joined with the benchmark's on the hash: (stretch, item, shift). A seed that many
   items share, as a common opening, joins as one row; its stretches and items then meet on seeds of
   nine words instead, whose masks have the same property.
4. Along each shift both texts are compared word by word, in tasks that read a stretch once: every
   longest stretch of which ``SIMILARITY`` is equal, and those left beside it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctables.llm.common import stored, whole_text

# The masks, each of six words, and the one of items that are shorter than ``MIN_WORDS``.
MASKS = ("1111011", "110101011", "11100001101")
SHORT_MASK = "111"
SIMILARITY = 0.8
MIN_WORDS = 12
SHORTEST = 6
# (Item, position) pairs of a seed beyond which it joins as one row.
COMMON = 64
# Words of the masks that are used instead.
WIDE = 9
FILTER_BITS = 1 << 26
_BITMAP_BITS = 8 * 4096  # of one bitmap of the built-in aggregate
_CACHE = 1_000_000
CHUNK_CHARS = 1_000_000
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def words_of(text: str) -> list[str]:
    """Lower-case words without the signs around them; signs alone are no words."""
    return [w for w in (_EDGES.sub("", w.lower()) for w in text.split()) if w]


class _WordHashes(dict):
    """Position of a raw word's hash in ``hashes``; hash 0 marks signs alone."""

    def __init__(self) -> None:
        super().__init__()
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.hashes: list[int] = []
        self.table = np.empty(0, np.uint64)

    def array(self) -> np.ndarray:
        """All hashes; the new ones are converted once."""
        if len(self.table) < len(self.hashes):
            self.table = np.concatenate([self.table, np.array(self.hashes[len(self.table) :], np.uint64)])
        return self.table

    def __missing__(self, raw: str) -> int:
        word = _EDGES.sub("", raw.lower())
        self[raw] = at = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word.encode(), 1) | 1 if word else 0)
        return at


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _seeds(hashes: np.ndarray, pattern: str) -> np.ndarray:
    """Seed of every start position that the mask fits at."""
    n = len(hashes) - len(pattern) + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.full(n, int(pattern, 2), dtype=np.uint64)
    for i, bit in enumerate(pattern):
        if bit == "1":
            total = _mixed(total + hashes[i : i + n] * np.uint64(2 * i + 3))
    return total


# Words in a row, and substitutions among them, that masks are tried on.
TRIED = ((12, 2), (15, 3), (20, 4), (25, 5))


def uncovered(masks: Sequence[str], words: int, wrong: int) -> np.ndarray:
    """Placements of ``wrong`` substitutions in ``words`` words that meet every mask everywhere, as bits."""
    left = np.array([sum(1 << i for i in c) for c in combinations(range(words), wrong)], dtype=np.int64)
    for pattern in masks:
        bits = int(pattern[::-1], 2)
        for start in range(words - len(pattern) + 1):
            left = left[(left & (bits << start)) != 0]
    return left


@lru_cache
def wide_masks(weight: int = WIDE, longest: int = 14) -> tuple[str, ...]:
    """Masks of ``weight`` words that leave no placement uncovered, each the one that covers most."""
    every = ["1" + "".join("1" if i in c else "0" for i in range(n - 2)) + "1" for n in range(weight, longest + 1) for c in combinations(range(n - 2), weight - 2)]
    chosen: list[str] = []
    for words, wrong in TRIED:
        fits = [m for m in every if len(m) <= words and (words > 12 or len(m) <= 12)]
        left = uncovered(chosen, words, wrong)
        hit = np.array([np.any([(left & (int(m[::-1], 2) << s)) == 0 for s in range(words - len(m) + 1)], axis=0) for m in fits]) if len(left) else None
        while len(left):
            best = int(hit.sum(1).argmax())
            chosen.append(fits[best])
            left, hit = left[~hit[best]], hit[:, ~hit[best]]
    return tuple(chosen)


def _bits(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two bits of the filter per seed."""
    top = np.uint64(FILTER_BITS - 1)
    return seeds & top, (seeds >> np.uint64(32)) & top


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    """Hashes of every row of a list column."""
    at = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    return [values[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def benchmark_seeds(items: DataFrame, masks: Sequence[str] = MASKS) -> DataFrame:
    """(``item``, ``seed``, ``item_pos``) of items (``item``, ``hashes``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, hashes in zip(batch.column(0).to_pylist(), _lists(batch.column(1))):
                for pattern in masks if len(hashes) >= MIN_WORDS else [SHORT_MASK] if len(hashes) >= SHORTEST else []:
                    seeds = _seeds(hashes, pattern)
                    n = len(seeds)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * n, pa.int64()), pa.array(seeds.view(np.int64)), pa.array(np.arange(n, dtype=np.int32))],
                        ["item", "seed", "item_pos"],
                    )

    return items.select("item", "hashes").mapInArrow(run, "item long, seed long, item_pos int")


def _filter_bits(seeds: DataFrame) -> list[tuple[int, bytes]]:
    """Non-empty bitmaps of the filter: at most ``FILTER_BITS`` bits whatever the benchmark's size."""
    top = F.lit(FILTER_BITS - 1).cast("long")
    bit = F.explode(F.array(F.col("seed").bitwiseAND(top), F.shiftrightunsigned("seed", 32).bitwiseAND(top)))
    bits = seeds.select(bit.alias("bit"))
    parts = bits.groupBy(F.floor(F.col("bit") / _BITMAP_BITS).alias("part")).agg(
        F.bitmap_construct_agg(F.col("bit") % _BITMAP_BITS).alias("bitmap")
    )
    return [(r["part"], bytes(r["bitmap"])) for r in parts.collect()]


def _stretches(hits: np.ndarray, around: int, size: int) -> list[tuple[int, int, int, int]]:
    """Merged stretches around sorted hit positions: first and end word, first and end hit."""
    cut = np.flatnonzero(np.diff(hits) > 2 * around) + 1
    first = np.concatenate([[0], cut])
    end = np.concatenate([cut, [len(hits)]])
    lo = np.maximum(hits[first] - around, 0)
    hi = np.minimum(hits[end - 1] + around, size)
    return list(zip(lo.tolist(), hi.tolist(), first.tolist(), end.tolist()))


class _Filter:
    """The filter's bits as one task holds them."""

    def __init__(self, bitmaps: list[tuple[int, bytes]]) -> None:
        self.flags = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
        for part, bitmap in bitmaps:
            self.flags[part * _BITMAP_BITS // 8 :][: len(bitmap)] = np.frombuffer(bitmap, dtype=np.uint8)

    def _set(self, bits: np.ndarray) -> np.ndarray:
        return (self.flags[bits >> np.uint64(3)] >> (bits & np.uint64(7)).astype(np.uint8)) & 1 == 1

    def passing(self, hashes: np.ndarray, masks: Sequence[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions and seeds that pass, by position, of texts one after the other that end at ``ends``."""
        places, found = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for pattern in masks:
            seeds = _seeds(hashes, pattern)
            one, two = _bits(seeds)
            hit = np.flatnonzero(self._set(one))
            hit = hit[self._set(two[hit])]
            hit = hit[hit + len(pattern) <= ends[np.searchsorted(ends, hit, side="right")]]
            places.append(hit)
            found.append(seeds[hit])
        pos = np.concatenate(places)
        order = np.argsort(pos, kind="stable")
        return pos[order], np.concatenate(found)[order]


def scan(docs: DataFrame, bitmaps: list[tuple[int, bytes]], around: int, masks: Sequence[str] = MASKS) -> DataFrame:
    """Stretches of documents with seeds that pass the filter.

    ``docs`` has ``doc_id``, ``same`` (digest of the text) and ``text``. A stretch has its first word's
    position, the hashes of its words, and its seeds with their positions in it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bitmaps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        passes = _Filter(sent.value)
        known, number = _WordHashes(), TaskContext.get().partitionId() << 40

        def stretches(rows: list[tuple]) -> Iterator[tuple]:
            if not rows:
                return
            # The rows' words one after the other; signs alone are no words.
            raw = known.array()[np.concatenate([at for *_, at in rows])]
            hashes = raw[raw != 0]
            ends = np.concatenate([[0], np.cumsum(raw != 0)])[np.cumsum([len(at) for *_, at in rows])]
            pos, seeds = passes.passing(hashes, masks, ends)
            edges = np.searchsorted(pos, ends).tolist()
            for (doc_id, same, _), a, b, start, end in zip(rows, [0, *edges], edges, [0, *ends.tolist()], ends.tolist()):
                if a == b:
                    continue
                own, found = pos[a:b] - start, seeds[a:b]
                for lo, hi, c, d in _stretches(own, around, end - start):
                    yield doc_id, same, lo, hashes[start + lo : start + hi].view(np.int64), found[c:d].view(np.int64), (own[c:d] - lo).astype(np.int32)

        def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
            rows, chars = [], 0
            for batch in batches:
                for doc_id, same, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                    text = text.as_py()
                    rows.append((doc_id, same, np.array(list(map(known.__getitem__, text.split())), dtype=np.int64)))
                    chars += len(text)
                    if chars > CHUNK_CHARS:
                        yield rows
                        rows, chars = [], 0
                        if len(known) > _CACHE:
                            known.forget()
            yield rows

        for rows in chunks(batches):
            out = list(stretches(rows))
            columns = [range(number, number + len(out)), *(zip(*out) if out else [[]] * 6)]
            number += len(out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, _STRETCH_TYPES)],
                ["stretch", "doc_id", "same", "start", "hashes", "seeds", "places"],
            )

    return docs.mapInArrow(
        run,
        "stretch long, doc_id long, same string, start int, hashes array<long>, seeds array<long>, places array<int>",
    )


_STRETCH_TYPES = (
    pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()),
)


def _wide_hits(stretches: DataFrame, bitmaps: list[tuple[int, bytes]], masks: Sequence[str]) -> DataFrame:
    """(``stretch``, ``seed``, ``place``) of stretches (``stretch``, ``hashes``) whose seeds pass the filter."""
    sent = stretches.sparkSession.sparkContext.broadcast(bitmaps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = _Filter(sent.value)
        for batch in batches:
            for stretch, hashes in zip(batch.column(0).to_pylist(), _lists(batch.column(1))):
                pos, seeds = passes.passing(hashes, masks, np.array([len(hashes)]))
                if len(pos):
                    columns = [np.full(len(pos), stretch), seeds.view(np.int64), pos.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["stretch", "seed", "place"])

    return stretches.select("stretch", "hashes").mapInArrow(run, "stretch long, seed long, place int")


def _longest(same: np.ndarray) -> tuple[int, int] | None:
    """First and end position of the longest stretch that starts and ends with an equal word and has
    ``SIMILARITY`` of them; of equally long ones the last."""
    equal = np.flatnonzero(same)
    if not len(equal):
        return None
    # An equal word counts 1, another one -4: a sum not below zero means 80 % equal words.
    other = -round(SIMILARITY / (1 - SIMILARITY))
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, other))])
    ends = equal + 1
    first = np.searchsorted(-np.minimum.accumulate(sums), -sums[ends], side="left")
    first = equal[np.searchsorted(equal, first)]
    sizes = ends - first
    best = len(sizes) - 1 - int(sizes[::-1].argmax())
    return int(first[best]), int(ends[best])


def _disjoint(same: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, end, equal words) of the longest stretch of at least ``least`` words, and of those on
    either side of it, and so on; by position."""
    out, todo = [], [(0, len(same))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo >= least and (found := _longest(same[lo:hi])) and found[1] - found[0] >= least:
            a, b = lo + found[0], lo + found[1]
            out.append((a, b, int(same[a:b].sum())))
            todo += [(lo, a), (b, hi)]
    return sorted(out)


def longest_overlap(words: list[str], item: list[str], shift: int) -> tuple[int, int, int]:
    """Longest stretch of ``item`` that equals ``words`` from ``shift`` on in at least
    ``SIMILARITY`` of its words: first and end position in the item, equal words."""
    lo, hi = max(0, -shift), min(len(item), len(words) - shift)
    same = np.array([item[i] == words[i + shift] for i in range(lo, hi)], bool)
    a, b = _longest(same) or (0, 0)
    return lo + a, lo + b, int(same[a:b].sum())


_OVERLAP_NAMES = ["doc_id", "same", "item", "doc_start", "doc_end", "n_equal"]
_OVERLAP_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlaps of candidates. A stretch's row comes before those of its candidates."""
    doc_id, same_text, start, words = None, None, 0, np.empty(0, np.uint64)
    for batch in batches:
        out = []
        columns = [batch.column(i).to_pylist() for i in range(1, 7)]
        for item, shift, its_doc, its_text, its_start, candidate, hashes in zip(*columns, _lists(batch.column(7))):
            if not candidate:
                # A copy: the batch's memory goes with the batch.
                doc_id, same_text, start, words = its_doc, its_text, its_start, hashes.copy()
                continue
            lo, hi = max(0, -shift), min(len(hashes), len(words) - shift)
            for a, b, equal in _disjoint(words[lo + shift : hi + shift] == hashes[lo:hi], min(MIN_WORDS, len(hashes))):
                at = start + shift + lo
                out.append((doc_id, same_text, item, at + a, at + b, equal))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, _OVERLAP_TYPES)], _OVERLAP_NAMES)


def _word_lists(text: Column) -> Column:
    """The words of a text joined by spaces, and the hash of each."""

    @F.arrow_udf("struct<key:string,hashes:array<long>>")
    def of(texts: pa.Array) -> pa.Array:
        lists = [words_of(t.as_py()) for t in texts]
        hashes = [np.array([xxhash.xxh64_intdigest(w.encode(), 1) | 1 for w in words], np.uint64).view(np.int64) for words in lists]
        return pa.array([{"key": " ".join(w), "hashes": h} for w, h in zip(lists, hashes)], pa.struct([("key", pa.string()), ("hashes", pa.list_(pa.int64()))]))

    return of.asNondeterministic()(text)


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct normalised texts (``item``, ``hashes``), numbered and stored, and their ids (``item``, ``item_ids``)."""
    rows = benchmark.select("item_id", _word_lists(whole_text()).alias("w")).select("item_id", "w.key", "w.hashes")
    texts = rows.groupBy("key").agg(F.first("hashes").alias("hashes"), F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    items = stored(texts.filter(F.size("hashes") > 0).select(F.monotonically_increasing_id().alias("item"), "hashes", "item_ids"), "items")
    return items.select("item", "hashes"), items.select("item", "item_ids")


def _candidates(items: DataFrame, seeds: DataFrame, found: DataFrame) -> DataFrame:
    """Distinct (``stretch``, ``item``, ``shift``) with a common seed, where a seed of more than
    ``COMMON`` items and positions does not count but for its wide seeds."""

    def joined(hits: DataFrame, of_items: DataFrame) -> DataFrame:
        return hits.join(of_items, "seed").select("stretch", "item", (F.col("place") - F.col("item_pos")).alias("shift"))

    hits = found.select("stretch", F.explode(F.arrays_zip("seeds", "places")).alias("h")).select(
        "stretch", F.col("h.seeds").alias("seed"), F.col("h.places").alias("place")
    )
    common = stored(seeds.groupBy("seed").count().filter(F.col("count") > COMMON).select("seed"), "common")
    if common.isEmpty():
        return joined(hits, seeds).distinct()
    masks = wide_masks()
    shared = seeds.join(common, "seed", "left_semi").select("item").distinct()
    wide = stored(benchmark_seeds(items.join(shared, "item", "left_semi"), masks), "wide")
    # One row per stretch, however many items share its seeds.
    hot = hits.join(common, "seed", "left_semi").select("stretch").distinct()
    again = _wide_hits(found.join(hot, "stretch", "left_semi"), _filter_bits(wide), (*masks, SHORT_MASK))
    rare = joined(hits, seeds.join(common, "seed", "left_anti"))
    return rare.unionByName(joined(again, wide)).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Overlaps of documents (``doc_id``, ``text``) with benchmark items (``item_id``, ``text``).

    One row per document row, distinct item text, shift between both, and overlap: ``doc_id``, ``same``
    (digest of the whole text), ``item_ids`` (all items with that text, sorted), ``doc_start`` and
    ``doc_end`` (word positions in the document, signs not counted), ``n_overlap``, ``n_equal``. Along a
    shift the longest overlap comes first, then those beside it; an overlap starts and ends with an equal
    word. It has at least twelve words, or all of a shorter item; items under six words have no seed and
    are never found. What is found of an item does not depend on the other items. Null texts are empty
    and match nothing. Rows without an id and repeated rows take part like others. Other columns are
    ignored. Words are compared by 64-bit hashes.
    """
    items, ids = _items(benchmark)
    sizes = items.agg(F.max(F.size("hashes")).alias("longest"), F.min(F.size("hashes")).alias("shortest")).first()
    longest = sizes["longest"] or 0
    masks = (*MASKS, SHORT_MASK) if longest and sizes["shortest"] < MIN_WORDS else MASKS
    seeds = stored(benchmark_seeds(items), "seeds")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _digest(whole_text()).alias("same"), whole_text().alias("text"))
    found = stored(scan(rows, _filter_bits(seeds), longest + max(map(len, MASKS)), masks), "stretches")
    candidates = _candidates(items, seeds, found)
    none = lambda t: F.lit(None).cast(t)
    read = found.select("stretch", none("long").alias("item"), none("int").alias("shift"), "doc_id", "same", "start", F.lit(False).alias("candidate"), "hashes")
    tried = candidates.join(items, "item").select(
        "stretch", "item", "shift", none("long").alias("doc_id"), none("string").alias("same"), none("int").alias("start"), F.lit(True).alias("candidate"), "hashes"
    )
    together = read.unionByName(tried).repartition("stretch").sortWithinPartitions("stretch", "candidate")
    overlaps = together.mapInArrow(_verified, "doc_id long, same string, item long, doc_start int, doc_end int, n_equal int")
    return overlaps.join(ids, "item", "left").select(
        "doc_id", "same", "item_ids", "doc_start", "doc_end", (F.col("doc_end") - F.col("doc_start")).alias("n_overlap"), "n_equal"
    )


def _digest(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents without any benchmark overlap; all their columns stay."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("_bad_id"), F.col("same").alias("_bad_text")).distinct()
    same = F.col("_bad_id").eqNullSafe(docs["doc_id"]) & (F.col("_bad_text") == _digest(F.coalesce(docs["text"].cast("string"), F.lit(""))))
    return docs.join(bad, same, "left_anti")
