"""Quality by nearest-neighbour voting among labelled documents in a latent-semantic space.

A document is a vector of weighted term shares: word shapes, words, and how often a word follows
itself. The labelled sample gives the term weights and, by truncated singular value decomposition,
the latent space. Sample vectors, of bounded number and size, are broadcast; each document takes
the cosine with every one of them, block by block, and the nearest ones vote by similarity.

Fitting learns from at most ``SAMPLE`` labelled documents, half of each label where there are
enough; it is the only part that does not see all rows. Which ones is decided by a hash of the id.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctables.llm.common import in_pieces, whole_text

SAMPLE = 4_000
DIMENSIONS = 2_048
_SHAPES = 512
RANK = 48
NEIGHBOURS = 15
BLOCK = 256
THRESHOLD = 0.3
# Words make most of the terms; shapes and repeats say more about quality.
_WORD_WEIGHT = 0.5
_REPEAT = 0
_VARIETY = 1
_RESERVED = 2
_CACHE = 200_000


def _bucket(term: str, first: int, last: int) -> int:
    return first + zlib.crc32(term.encode()) % (last - first)


_CASES = re.compile(r"[^\W\d_]+|\d+")


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits as one sign each; other characters stay, repeats
    of one count once."""

    def run(m: re.Match) -> str:
        s = m.group()
        if s[0].isdigit():
            return "0"
        return "a" if s.islower() else "A" if s.isupper() else "Aa" if s.istitle() else "aA"

    return re.sub(r"(.)\1+", r"\1", _CASES.sub(run, word) + ("~" if len(word) > 20 else ""))


class Features:
    """Term vectors of texts; remembers the buckets of the words it met, up to a bound."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[int, int]] = {}

    def _terms(self, word: str) -> tuple[int, int]:
        found = self._known.get(word)
        if found is None:
            if len(self._known) >= _CACHE:
                self._known.clear()
            found = self._known[word] = (
                _bucket(shape(word), _RESERVED, _SHAPES),
                _bucket(word.lower(), _SHAPES, DIMENSIONS),
            )
        return found

    def of(self, text: str) -> np.ndarray:
        """Square roots of the term shares; zero without words. Long words count by their pieces."""
        words = in_pieces(text.split())
        if not words:
            return np.zeros(DIMENSIONS, dtype=np.float32)
        counts = Counter(words)
        terms = np.array(list(map(self._terms, counts)), dtype=np.int64)
        n = np.fromiter(counts.values(), dtype=np.float64, count=len(counts)) / len(words)
        share = np.bincount(terms.ravel(), weights=np.repeat(n, 2), minlength=DIMENSIONS)
        share[_REPEAT] = sum(map(eq, words, words[1:])) / len(words)
        share[_VARIETY] = 1 - len(counts) / len(words)
        return np.sqrt(share).astype(np.float32)


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm > 0, norm, 1)


@dataclass
class Voters:
    """Projection to the latent space, and the labelled vectors in it."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    # Score of texts without terms, which no vector is like.
    empty: float = 0.0

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors."""
        if not len(self.labels):
            return np.where(rows.any(axis=1), 0.5, self.empty)
        cosine = _unit(rows @ self.projection) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** 4
        total = weight.sum(axis=1)
        vote = (weight * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.where(total > 0, vote, np.where(rows.any(axis=1), self.labels.mean(), self.empty))


def voters(rows: np.ndarray, labels: np.ndarray, rank: int = RANK) -> Voters:
    """Fit on term vectors. The decomposition is a subspace iteration from a fixed start.

    Vectors without terms have an answer of their own: their share of label 1, where one more of label 0
    stands for there being nothing to keep.
    """
    worded = rows.any(axis=1)
    empty = float(labels[~worded].sum()) / (int((~worded).sum()) + 1)
    rows, labels = rows[worded], labels[worded]
    if not len(rows):
        return Voters(np.zeros((DIMENSIONS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), empty)
    inverse = np.log((1 + len(rows)) / (1 + (rows > 0).sum(axis=0))) + 1
    inverse[_SHAPES:] *= _WORD_WEIGHT
    weighted = rows * inverse.astype(np.float32)
    basis = np.random.default_rng(7).standard_normal((DIMENSIONS, min(rank + 8, len(rows)))).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
    _, _, right = np.linalg.svd(weighted @ basis, full_matrices=False)
    axes = (basis @ right.T)[:, :rank]
    projection = (inverse[:, None] * axes).astype(np.float32)
    return Voters(projection, _unit(rows @ projection), labels.astype(np.float64), empty)


def term_vectors(text: Column) -> Column:
    """Term vectors for the bounded sample, as bytes: the terms that occur, and their shares."""

    @F.pandas_udf("binary")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features = Features()
        for batch in batches:
            rows = [features.of(t) for t in batch]
            yield pd.Series([np.flatnonzero(r).astype(np.uint16).tobytes() + r[r != 0].tobytes() for r in rows])

    return of.asNondeterministic()(text)


def _dense(row: bytes) -> np.ndarray:
    n = len(row) // 6  # two bytes for a term, four for its share
    out = np.zeros(DIMENSIONS, dtype=np.float32)
    out[np.frombuffer(row, np.uint16, n)] = np.frombuffer(row, np.float32, n, offset=2 * n)
    return out


def sampled(labelled: DataFrame, label: str, size: int) -> DataFrame:
    """(``doc_id``, ``label``): at most ``size`` rows, half of each label, least hash first."""
    rows = labelled.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(
        F.max(F.col(label).cast("int")).alias("label")
    )
    order = F.xxhash64(F.lit("sample"), "doc_id"), F.col("doc_id")
    parts = [rows.filter(F.col("label") == side).orderBy(*order).limit(size // 2) for side in (0, 1)]
    return parts[0].unionByName(parts[1])


def fit(docs: DataFrame, labelled: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Voters:
    """Learn from ``labelled`` (``doc_id`` and the label); ids without a document count for nothing.

    Of repeated ids one text is taken. Without labelled documents every text with words has the score 0.5.
    """
    chosen = F.broadcast(sampled(labelled, label, sample))  # ``sample`` rows of two numbers
    texts = docs.select("doc_id", whole_text().alias("text")).join(chosen, "doc_id")
    one = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    got = sorted(one.select("doc_id", "label", term_vectors(F.col("text"))).collect())
    rows = np.zeros((len(got), DIMENSIONS), dtype=np.float32)
    for row, (_, _, packed) in zip(rows, got):
        row[:] = _dense(packed)
    return voters(rows, np.array([side for _, side, _ in got]))


def score(docs: DataFrame, model: Voters, column: str = "score") -> DataFrame:
    """Add the score of every whole text, 0 to 1; a column of that name is replaced.

    A null text is an empty one. Texts without words have a score of their own, learned from the sample's
    texts without words; where there are none it is 0. A text with words that is like no labelled one
    gets the sample's share of label 1. Equal texts get equal scores. An empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.projection, model.vectors, model.labels, model.empty))

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features, voted = Features(), Voters(*sent.value)
        for batch in batches:
            scores = [
                voted.score(np.stack([features.of(t) for t in batch.iloc[i : i + BLOCK]]))
                for i in range(0, len(batch), BLOCK)
            ]
            yield pd.Series(np.concatenate(scores) if scores else [], dtype="float64")

    return docs.withColumn(column, of.asNondeterministic()(whole_text()))
