"""Removal of byte strings that occur more than once in a corpus, by sorted suffixes at anchors.

Sorting every suffix would shuffle the corpus many times over. Instead each window of ``LENGTH``
bytes names an anchor in it: the place of the least hash of ``GRAM`` bytes, the first one of equal
hashes. Equal windows have their anchors at the same distance from their starts, so a repeated
string is found around two anchors with the same bytes.

1. Anchors of all documents: about one in 170 bytes. Their hashes are counted, and those that occur
   at one place only drop out.
2. The others get the bytes around them, meet by hash, and are sorted from the anchor to the right
   and to the left by deep-shallow sorting. Common prefixes on both sides give what is repeated.
3. Anchors of one hash beyond ``CROWD`` do not meet; the hashes of their windows are counted instead,
   which combines before the shuffle.
4. The stretches return to their text.

Equal documents are one text with a count. A text that occurs twice is removed as a whole, if it is
long enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.llm.common import stored, whole_text
from doctables.llm.suffixes import repeated_around

LENGTH = 400
GRAM = 64
# Anchors of one hash that are sorted in one task, and anchors that are sorted at a time.
CROWD = 50_000
SORTED_AT_ONCE = 40_000
# Positions hashed at a time.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
# A text with more anchors than one in so many bytes repeats itself closely.
_DENSE = 24


class Anchors:
    """Finds the anchors of byte strings."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM) -> None:
        self.length, self.gram = length, gram
        n = CHUNK + 2 * length
        inverse = pow(_BASE, -1, 1 << 64)
        self._up, self._down = self._powers(_BASE, n), self._powers(inverse, n)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def _hashes(self, data: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` bytes from every position on."""
        n = len(data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self._up[:n], out=sums[1:])
        h = (sums[size:] - sums[:-size]) * self._down[: n - size + 1]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def _least(self, hashes: np.ndarray) -> np.ndarray:
        """For every window the position of its least hash, the first of equals."""
        wide = self.length - self.gram + 1
        n = len(hashes)
        # The upper bits of the hash above the position: one minimum finds both.
        keyed = (hashes & ~np.uint64((1 << 24) - 1)) | np.arange(n, dtype=np.uint64)
        blocks = np.full(-(-n // wide) * wide, np.uint64(2**64 - 1))
        blocks[:n] = keyed
        blocks = blocks.reshape(-1, wide)
        forward = np.minimum.accumulate(blocks, axis=1).ravel()
        backward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        windows = n - wide + 1
        return (np.minimum(backward[:windows], forward[wide - 1 : wide - 1 + windows]) & np.uint64((1 << 24) - 1)).astype(np.int64)

    def _again(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows that equal one shortly before, and that one."""
        whole = self._hashes(data, self.length)
        order = np.argsort(whole, kind="stable")
        near = (whole[order[1:]] == whole[order[:-1]]) & (np.diff(order) <= self.length - self.gram)
        return order[1:][near], order[:-1][near]

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """Anchor positions, their hashes, and stretches that are repeated within reach.

        A window that equals one shortly before it, as in long runs of one sign, is repeated without
        further search, and the earlier one stands for it.
        """
        places, hashes, close = [], [], []
        for first in range(0, max(0, len(text) - self.length + 1), CHUNK):
            data = np.frombuffer(text[first : first + CHUNK + self.length - 1], dtype=np.uint8)
            grams = self._hashes(data, self.gram)
            least = self._least(grams)
            at = np.unique(least)
            if len(at) * _DENSE > len(data):
                later, earlier = self._again(data)
                keep = np.ones(len(least), dtype=bool)
                keep[later] = False
                at = np.unique(least[keep])
                for start in np.unique(np.concatenate([later, earlier])).tolist():
                    if close and first + start <= close[-1][1]:
                        close[-1] = (close[-1][0], first + start + self.length)
                    else:
                        close.append((first + start, first + start + self.length))
            places.append(at + first)
            hashes.append(grams[at])
        if not places:
            return np.empty(0, np.int64), np.empty(0, np.uint64), []
        place, unique = np.unique(np.concatenate(places), return_index=True)
        return place, np.concatenate(hashes)[unique], close


def _texts(docs: DataFrame) -> DataFrame:
    text = whole_text()
    return docs.select(
        F.col("doc_id"), F.xxhash64(text).alias("same"), F.octet_length(text).cast("int").alias("n_bytes"), text.alias("text")
    )


_STRETCH = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def _anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors(length, gram)
        for batch in batches:
            found = [anchors.of(t.as_py().encode()) for t in batch.column(2)]
            close = [[{"first": a, "end": b} for a, b in c] for _, _, c in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([p.astype(np.int32) for p, _, _ in found], pa.list_(pa.int32())),
                    pa.array([g.view(np.int64) for _, g, _ in found], pa.list_(pa.int64())),
                    pa.array(close, _STRETCH),
                ],
                ["same", "n_bytes", "places", "grams", "close"],
            )

    long = texts.filter(F.col("n_bytes") >= length).select("same", "n_bytes", "text")
    return long.mapInArrow(
        run, "same long, n_bytes int, places array<int>, grams array<long>, close array<struct<first:int,end:int>>"
    )


def _contexts(texts: DataFrame, length: int) -> DataFrame:
    """Anchors with the bytes around them; ``left`` runs backwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                text = batch.column("text")[row].as_py().encode()
                places = batch.column("places")[row].values.to_numpy()
                for lo in range(0, len(places), 4096):
                    some = places[lo : lo + 4096]
                    n = len(some)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("grams")[row].values.slice(lo, n),
                            batch.column("crowded")[row].values.slice(lo, n),
                            pa.array([batch.column("same")[row].as_py()] * n, pa.int64()),
                            pa.array([batch.column("n_bytes")[row].as_py()] * n, pa.int32()),
                            pa.array(some, pa.int32()),
                            pa.array([text[max(0, p - length) : p][::-1] for p in some.tolist()], pa.binary()),
                            pa.array([text[p : p + length] for p in some.tolist()], pa.binary()),
                        ],
                        ["gram", "crowded", "same", "n_bytes", "place", "left", "right"],
                    )

    return texts.select("same", "n_bytes", "text", "places", "grams", "crowded").mapInArrow(
        run, "gram long, crowded boolean, same long, n_bytes int, place int, left binary, right binary"
    )


def _matrix(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    rows = column.to_pylist()
    whole = np.frombuffer(b"".join(r.ljust(length, b"\0") for r in rows), dtype=np.uint8).reshape(-1, length)
    return whole, np.array([len(r) for r in rows], dtype=np.int64)


def _stretches_of_sorted(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """Repeated stretches (``same``, ``n_bytes``, ``first``, ``end``) around anchors that meet by hash."""

    def found(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        left, left_size = _matrix(rows.column("left"), length)
        right, right_size = _matrix(rows.column("right"), length)
        low, high = repeated_around(left, left_size, right, right_size, gram)
        hit = np.flatnonzero(low >= 0)
        place = rows.column("place").to_numpy()[hit]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(rows.column("same").to_numpy()[hit]),
                pa.array(rows.column("n_bytes").to_numpy()[hit]),
                pa.array((place - high[hit]).astype(np.int32)),
                pa.array((place - low[hit] + length).astype(np.int32)),
            ],
            ["same", "n_bytes", "first", "end"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= SORTED_AT_ONCE:
                rows = pa.Table.from_batches(held)
                grams = rows.column("gram").to_numpy()
                cut = int(np.searchsorted(grams, grams[-1]))  # the last hash may go on
                if cut:
                    yield found(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
                size = rows.num_rows - cut
        if held:
            yield found(pa.Table.from_batches(held))

    dealt = contexts.repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "same long, n_bytes int, first int, end int")


def _stretches_of_counted(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for crowded anchors, by counting the hashes of their windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                left, right = row["left"], row["right"]
                text, at = left[::-1] + right, len(left)
                for a in range(min(len(left), length - gram) + 1):
                    window = text[at - a : at - a + length]
                    if len(window) == length:
                        out.append((xxhash.xxh64_intdigest(window, 1) - (1 << 63), xxhash.xxh64_intdigest(window, 2) - (1 << 63), row["same"], row["n_bytes"], row["place"] - a))
            columns = list(zip(*out)) if out else [[]] * 5
            types = [pa.int64()] * 3 + [pa.int32()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["w1", "w2", "same", "n_bytes", "first"])

    windows = contexts.mapInArrow(run, "w1 long, w2 long, same long, n_bytes int, first int")
    where = F.xxhash64("same", "n_bytes", "first")
    twice = windows.groupBy("w1", "w2").agg(F.min(where).alias("a"), F.max(where).alias("b")).filter("a <> b")
    hit = windows.join(twice.select("w1", "w2"), ["w1", "w2"])
    return hit.select("same", "n_bytes", "first", (F.col("first") + length).alias("end")).distinct()


_CLEANED = "same long, n_bytes int, n_removed long, stretches array<struct<first:int,end:int>>, kept binary"


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, merged, kept = [], [], []
        for text, marks in zip(batch.column("text"), batch.column("marks").to_pylist()):
            data, out, done = text.as_py().encode(), [], 0
            spans: list[list[int]] = []
            for mark in sorted(marks or [], key=lambda m: (m["first"], m["end"])):
                if spans and mark["first"] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], mark["end"])
                else:
                    spans.append([mark["first"], mark["end"]])
            for first, end in spans:
                out.append(data[done:first])
                done = end
            out.append(data[done:])
            kept.append(b"".join(out))
            removed.append(len(data) - len(kept[-1]))
            merged.append([{"first": a, "end": b} for a, b in spans])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("same"),
                batch.column("n_bytes"),
                pa.array(removed, pa.int64()),
                pa.array(merged, _STRETCH),
                pa.array(kept, pa.binary()),
            ],
            ["same", "n_bytes", "n_removed", "stretches", "kept"],
        )


def cleaned_texts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """One row per distinct text: ``same`` and ``n_bytes`` (hash and size, its key), ``n_removed``,
    ``stretches`` (removed byte ranges, maximal) and ``kept`` (the other bytes).

    A null text is empty. Texts shorter than ``length`` keep everything. Repeated rows count as
    occurrences of their text; ids and other columns do not matter. An empty table gives no rows.
    """
    rows = _texts(docs)
    anchors = stored(_anchor_rows(rows, length, gram), "anchors")
    each = anchors.select("same", "n_bytes", F.explode(F.arrays_zip("places", "grams")).alias("p")).select(
        "same", "n_bytes", F.col("p.places").alias("place"), F.col("p.grams").alias("gram")
    )
    where = F.xxhash64("same", "n_bytes", "place")
    counted = each.groupBy("gram").agg(F.min(where).alias("a"), F.max(where).alias("b"), F.count(F.lit(1)).alias("n"))
    shared = counted.filter("a <> b").select("gram", (F.col("n") > crowd).alias("crowded"))
    found = each.join(shared, "gram").groupBy("same", "n_bytes").agg(F.collect_set(F.struct("place", "gram", "crowded")).alias("at"))
    wanted = found.select(
        "same", "n_bytes", F.col("at.place").alias("places"), F.col("at.gram").alias("grams"), F.col("at.crowded").alias("crowded")
    )
    texts = rows.groupBy("same", "n_bytes").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    around = stored(_contexts(texts.join(wanted, ["same", "n_bytes"]), length), "contexts")
    sorted_ones = _stretches_of_sorted(around.filter("NOT crowded"), length, gram)
    counted_ones = _stretches_of_counted(around.filter("crowded"), length, gram)
    close = anchors.select("same", "n_bytes", F.explode("close").alias("c")).select("same", "n_bytes", "c.first", "c.end")
    marks = (
        sorted_ones.unionByName(counted_ones)
        .unionByName(close)
        .groupBy("same", "n_bytes")
        .agg(F.collect_set(F.struct("first", "end")).alias("marks"))
    )
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("n_bytes").alias("end")))
    both = texts.join(marks, ["same", "n_bytes"], "left").withColumn(
        "marks", F.when((F.col("copies") > 1) & (F.col("n_bytes") >= length), whole).otherwise(F.col("marks"))
    )
    return both.select("same", "n_bytes", "text", "marks").mapInArrow(_apply, _CLEANED)


def per_document(docs: DataFrame, results: DataFrame) -> DataFrame:
    """Results of texts (``same``, ``n_bytes`` and more) for every row of ``docs``, with ``doc_id``."""
    return _texts(docs).select("doc_id", "same", "n_bytes").join(results, ["same", "n_bytes"])
