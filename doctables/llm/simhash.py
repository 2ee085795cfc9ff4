"""Near-duplicates by SimHash fingerprints and deletion-variant signatures.

A fingerprint has 64 bits, one per bit of its shingles' hashes. Two fingerprints that differ in at
most two bits agree in one of their two halves up to one bit. So each half is indexed 32 times, each
time with another bit left out; equal keys give the candidates, and a bit count verifies them. A
candidate group is scanned as a sorted run. It gives a spanning forest of its links, never all
pairs. The members of a run longer than ``LONG_RUN`` are indexed by the values within one bit of
them instead: two fingerprints within two bits share such a value, and no value has more than 65
fingerprints around it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctables.llm.common import stored, whole_text
from doctables.llm.components import connected

SHINGLE_WORDS = 3
HASH_SEED = 42
# Longest candidate group that is compared within itself; longer ones are split by another key.
LONG_RUN = 256
_BLOCK = 255


def _bits_set(hashes: list[int]) -> int:
    """64 bits, each set if it is set in more than half of the hashes."""
    octets = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, len(octets), 64 * _BLOCK):
        bits = np.unpackbits(octets[start : start + 64 * _BLOCK], axis=1)
        whole = len(bits) // _BLOCK * _BLOCK
        # Sums of at most 255 ones fit a byte, which keeps the additions narrow.
        counts += bits[:whole].reshape(-1, _BLOCK, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprint_of(text: str) -> int:
    """Signed 64-bit fingerprint of a text; zero without words."""
    words = text.encode().lower().split()  # bytes: only A-Z and ASCII white space are touched
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        return _bits_set([xxhash.xxh64_intdigest(joined, HASH_SEED)])
    starts = np.cumsum([0] + [len(w) + 1 for w in words])
    ends = (starts[SHINGLE_WORDS:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return _bits_set([digest(joined[a:b], HASH_SEED) for a, b in zip(starts[:-SHINGLE_WORDS].tolist(), ends)])


def fingerprint(text: Column) -> Column:
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t) for t in texts], dtype="int64")

    return of.asNondeterministic()(text)


def _near(k: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs within the runs of equal keys of two parallel arrays."""
    left, right = [], []
    at = np.flatnonzero(k[:-1] == k[1:])
    shift = 1
    while len(at):
        one, other = f[at], f[at + shift]
        close = np.bitwise_count(one ^ other) <= 2
        left.append(one[close])
        right.append(other[close])
        shift += 1
        at = at[at + shift < len(k)]
        at = at[k[at] == k[at + shift]]
    empty = np.empty(0, dtype=np.uint64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)


def _forest(left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of the given links."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    pairs = np.unique(np.stack([left, right], axis=1), axis=0) if len(left) else np.empty((0, 2), np.uint64)
    a, b = [], []
    for x, y in pairs.tolist():
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            a.append(x)
            b.append(y)
    return a, b


def _batch(left: list[int], right: list[int], crowded: list[int]) -> pa.RecordBatch:
    """Links, and fingerprints of long runs as rows without a partner."""
    a = np.array(left + crowded, dtype=np.uint64).view(np.int64)
    b = np.array(right + [0] * len(crowded), dtype=np.uint64).view(np.int64)
    alone = np.arange(len(a)) >= len(left)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, mask=alone)], ["a", "b"])


def _links_of_runs(batches: Iterator[pa.RecordBatch], long_run: int) -> Iterator[pa.RecordBatch]:
    """Links from rows sorted by key; holds one input batch and at most ``long_run`` rows more."""
    k0 = f0 = np.empty(0, dtype=np.uint64)
    crowded_key = None
    for batch in batches:
        k = np.concatenate([k0, batch.column(0).to_numpy().view(np.uint64)])
        f = np.concatenate([f0, batch.column(1).to_numpy().view(np.uint64)])
        if not len(k):
            continue
        crowded: list[np.ndarray] = []
        if crowded_key is not None:
            same = k == crowded_key
            crowded.append(f[same])
            k, f = k[~same], f[~same]
        if len(k):
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            sizes = np.diff(np.concatenate([starts, [len(k)]]))
            long = np.repeat(sizes > long_run, sizes)
            crowded.append(f[long])
            crowded_key = k[-1] if sizes[-1] > long_run else None
            # The last run may go on in the next batch.
            open_run = np.arange(len(k)) >= starts[-1]
            k0, f0 = k[open_run & ~long], f[open_run & ~long]
            rest = ~open_run & ~long
            a, b = _forest(*_near(k[rest], f[rest]))
        else:
            k0 = f0 = np.empty(0, dtype=np.uint64)
            a, b = [], []
        yield _batch(a, b, np.concatenate(crowded).tolist() if crowded else [])
    a, b = _forest(*_near(k0, f0))
    yield _batch(a, b, [])


def _stars_of_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Link all members of a run to its first: they lie within one bit of the same value."""
    key = first = None
    for batch in batches:
        k = batch.column(0).to_numpy()
        f = batch.column(1).to_numpy()
        if not len(k):
            continue
        new = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
        heads = np.where(new, np.arange(len(k)), -1)
        heads = np.maximum.accumulate(heads)
        head = np.where(heads >= 0, f[heads], first if first is not None else 0)
        key, first = k[-1], head[-1]
        keep = head != f
        yield pa.RecordBatch.from_arrays([pa.array(head[keep]), pa.array(f[keep])], ["a", "b"])


def _runs(keyed: DataFrame) -> DataFrame:
    return keyed.repartition("key").sortWithinPartitions("key", "f")


def links(prints: DataFrame, long_run: int = LONG_RUN) -> DataFrame:
    """Links (``a``, ``b``) that connect all fingerprints ``f`` within two bits; ``f`` is distinct.

    Not all pairs: enough of them that each pair is connected by a chain of links.
    """
    half = F.shiftrightunsigned(F.col("f"), 32)
    low = F.col("f").bitwiseAND(F.lit(0xFFFFFFFF))
    kept = F.when(F.col("v") < 32, low).otherwise(half).bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, v % 32)")))
    variants = prints.select("f", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v"))
    keyed = variants.select(F.expr("shiftleft(CAST(v AS BIGINT), 32)").bitwiseOR(kept).alias("key"), "f")
    found = stored(
        _runs(keyed).mapInArrow(lambda it: _links_of_runs(it, long_run), "a long, b long").distinct(), "links"
    )
    crowded = found.filter("b IS NULL").select(F.col("a").alias("f"))
    flips = F.concat(F.array(F.lit(0).cast("long")), F.expr("transform(sequence(0, 63), i -> shiftleft(1L, i))"))
    balls = crowded.select("f", F.explode(flips).alias("flip"))
    around = balls.select(F.col("f").bitwiseXOR(F.col("flip")).alias("key"), "f")
    more = _runs(around).mapInArrow(_stars_of_runs, "a long, b long").distinct()
    return found.filter("b IS NOT NULL").unionByName(more)


def components(prints: DataFrame, long_run: int = LONG_RUN) -> DataFrame:
    """(``f``, ``group``) for every fingerprint of ``prints``; ``group`` names its component."""
    classes = prints.select("f").distinct()
    labels = connected(links(classes, long_run))
    named = classes.join(labels.withColumnRenamed("node", "f"), "f", "left")
    return named.select("f", F.coalesce("label", "f").alias("group"))


def near_duplicates(docs: DataFrame, long_run: int = LONG_RUN) -> DataFrame:
    """One row per document: ``doc_id``, ``fingerprint`` (hex), ``component_id``.

    ``component_id`` is the smallest ``doc_id`` that links reach. A null text is empty; texts without
    words share fingerprint zero and are linked. Repeated rows give repeated results; rows without
    ``doc_id`` take part, and a component of such rows only has a null ``component_id``. Other columns
    are ignored. An empty table gives no rows.
    """
    prints = stored(docs.select("doc_id", fingerprint(whole_text()).alias("f")), "prints")
    least = prints.groupBy("f").agg(F.min("doc_id").alias("least"))
    grouped = components(prints, long_run).join(least, "f")
    smallest = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    names = grouped.select("f", "group").join(smallest, "group").select("f", "component_id")
    return prints.join(names, "f").select(
        "doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id"
    )


def without_near_duplicates(docs: DataFrame, long_run: int = LONG_RUN) -> DataFrame:
    """One document of each component: the smallest ``doc_id``; of repeated ids any one row.

    All columns stay. A component whose rows have no id keeps one of them.
    """
    cols = docs.columns
    rows = stored(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"),
            F.col("doc_id").alias("doc"),
            fingerprint(whole_text()).alias("f"),
        ).withColumn("at", F.monotonically_increasing_id()),
        "fingerprinted",
    )
    prints = rows.select("doc", "at", "f")
    order = F.struct(F.col("doc").isNull().alias("last"), "doc", "at")
    first = prints.groupBy("f").agg(F.min(order).alias("first"))
    winners = (
        components(prints, long_run).join(first, "f").groupBy("group").agg(F.min("first").alias("first")).select("first.at")
    )
    return rows.join(winners, "at", "left_semi").select("row.*")
