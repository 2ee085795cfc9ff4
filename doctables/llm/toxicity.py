"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word comes in as a word and as its character n-grams: the log-odds of its hash among the labelled
documents, and the mean and the largest of those of its n-grams, so inflected and new forms of a stem
are recognised. In training, a document sees the log-odds of other parts of the sample only, as unseen
documents will; rows of very few documents say nothing. Long words, as in scripts without spaces, are
overlapping pieces that are words of their own. The network reads windows of ``WINDOW`` words that
overlap; a document's score is that of its worst window.

Training sees at most ``SAMPLE`` labelled documents of at most ``SAMPLE_CHARS`` characters, half of
each label where there are enough. A label does not say which window is meant, so training starts
with the window whose words are most telling by their counts, and goes on with the window that the
network itself finds worst.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doctables.llm.common import in_pieces, whole_text
from doctables.llm.quality import sampled

SAMPLE = 3_000
SAMPLE_CHARS = 20_000
WINDOW = 64
STRIDE = 48
THRESHOLD = 0.3
WORD_ROWS, CHAR_ROWS = 65_536, 131_072
# Inputs of a word: its own log-odds, the mean and the largest of its n-grams'.
INPUTS = 3
GRAMS = (3, 4, 5)
HIDDEN = 12
# Rounds over the chosen windows, before and after the network chooses them, and the least number
# of batches of each: a small sample is gone through more often.
EPOCHS = (20, 10)
LEAST_BATCHES = (200, 100)
BATCH = 96
SEED = 11
RATE = 0.01
# Rows that fewer documents have say nothing; documents at which a row's log-odds count half; their scale.
LEAST_DOCS = 3
TRUST = 8
SCALE = 0.3
# A sample document's inputs are the log-odds of the other parts of the sample, so that its own words do
# not tell its label.
FOLDS = 5
# Share of the harmless windows beside which stand such that say nothing.
HARMLESS = 0.15
# Windows and words that a scoring task works on at a time, and words that it remembers.
WINDOWS_AT_ONCE = 2_048
_CACHE = 150_000
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def words_of(text: str) -> list[str]:
    """Lower-case words; signs at their edges are dropped, signs alone stay. Long ones come in pieces."""
    return in_pieces([_EDGES.sub("", w) or w for w in text.lower().split()])


def windows_of(n: int) -> list[int]:
    """Starts of overlapping windows that cover ``n`` words."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def gram_rows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the character n-grams of all words, and where each word's rows begin.

    A word stands between two signs of its own, so its first and last letters count as such.
    """
    data = [b"\x02" + w.encode() + b"\x03" for w in words]
    sizes = np.array([len(d) for d in data], dtype=np.int64)
    flat = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.uint64)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(flat))  # bytes up to the word's end
    owner = np.repeat(np.arange(len(words)), sizes)
    rows, owners = [], []
    for n in GRAMS:
        h = np.full(max(0, len(flat) - n + 1), n, dtype=np.uint64)
        for i in range(n):
            h = (h ^ flat[i : i + len(h)]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        fits = room[: len(h)] >= n
        rows.append((h[fits] % np.uint64(CHAR_ROWS)).astype(np.int64))
        owners.append(owner[: len(h)][fits])
    row, own = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return row[order], np.searchsorted(own[order], np.arange(len(words) + 1))


def word_rows(words: list[str]) -> np.ndarray:
    return np.array([zlib.crc32(w.encode()) % WORD_ROWS for w in words], dtype=np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Weights by name; directions ``f`` and ``b`` have their own recurrent weights."""

    w: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls) -> Network:
        rng = np.random.default_rng(SEED)

        def draw(*shape: int, scale: float) -> np.ndarray:
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        w = {"words": np.zeros(WORD_ROWS, np.float32), "chars": np.zeros(CHAR_ROWS, np.float32)}
        for d in "fb":
            w["x" + d] = draw(INPUTS, 3 * HIDDEN, scale=INPUTS**-0.5)
            w["h" + d] = draw(HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5)
            w["c" + d] = np.zeros(3 * HIDDEN, np.float32)
        w["attend"] = draw(2 * HIDDEN, HIDDEN, scale=(2 * HIDDEN) ** -0.5)
        w["query"] = draw(HIDDEN, scale=HIDDEN**-0.5)
        w["out"] = draw(2 * HIDDEN, scale=(2 * HIDDEN) ** -0.5)
        w["bias"] = np.zeros(1, np.float32)
        return cls(w)

    def inputs(self, words: list[str]) -> np.ndarray:
        """Input vectors of words."""
        rows, begins = gram_rows(words)
        if not words:
            return np.zeros((0, INPUTS), np.float32)
        odds = self.w["chars"][rows]
        mean = np.add.reduceat(odds, begins[:-1]) / np.maximum(np.diff(begins), 1)
        return np.stack([self.w["words"][word_rows(words)], mean, np.maximum.reduceat(odds, begins[:-1])], axis=1).astype(np.float32)

    def _run(self, d: str, projected: np.ndarray, there: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states of one direction; ``projected`` is steps x windows x gates."""
        steps, n, _ = projected.shape
        h = np.zeros((n, HIDDEN), np.float32)
        out = np.empty((steps, n, HIDDEN), np.float32)
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        u = self.w["h" + d]
        for t in order:
            x, g = projected[t], h @ u
            gates = _sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * g[:, 2 * HIDDEN :])
            m = there[t][:, None]
            after = np.where(m, z * h + (1 - z) * new, h)
            if keep is not None:
                keep.append((t, h, z, r, new, g[:, 2 * HIDDEN :], m))
            h = after
            out[t] = h
        return out

    def _pool(self, states: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, ...]:
        t = np.tanh(states @ self.w["attend"])
        e = np.where(there, t @ self.w["query"], -1e9)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        c = (a[:, :, None] * states).sum(axis=0)
        return t, a, c, c @ self.w["out"] + self.w["bias"][0]

    def project(self, x: np.ndarray) -> np.ndarray:
        """Inputs times the input weights of both directions, side by side."""
        return np.concatenate([x @ self.w["x" + d] + self.w["c" + d] for d in "fb"], axis=-1)

    def scores(self, projected: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probabilities of windows; ``at`` (windows x steps) has rows of ``projected``, -1 for none."""
        there = (at >= 0).T
        x = projected[np.maximum(at, 0).T]
        g = 3 * HIDDEN
        states = np.concatenate([self._run("f", x[:, :, :g], there), self._run("b", x[:, :, g:], there)], axis=2)
        return _sigmoid(self._pool(states, there)[3])

    def gradients(self, words: list[str], at: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy of windows over ``words``, and its gradients. The inputs are not learned here."""
        w, there = self.w, (at >= 0).T
        x_words = self.inputs(words)
        x = x_words[np.maximum(at, 0).T]
        kept: dict[str, list] = {"f": [], "b": []}
        states = np.concatenate(
            [self._run(d, x @ w["x" + d] + w["c" + d], there, kept[d]) for d in "fb"], axis=2
        )
        t, a, c, logit = self._pool(states, there)
        p = _sigmoid(logit)
        loss = float(-np.mean(y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7)))
        d_logit = ((p - y) / len(y)).astype(np.float32)
        grad = {"out": c.T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
        d_c = d_logit[:, None] * w["out"]
        d_states = a[:, :, None] * d_c
        d_a = (states * d_c).sum(axis=2)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        grad["query"] = np.einsum("tn,tnk->k", d_e, t)
        d_t = d_e[:, :, None] * w["query"] * (1 - t * t)
        grad["attend"] = np.einsum("tnh,tnk->hk", states, d_t)
        d_states = d_states + d_t @ w["attend"].T
        for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            u, dh = w["h" + d], np.zeros((len(y), HIDDEN), np.float32)
            d_gates = np.zeros((len(at.T), len(y), 3 * HIDDEN), np.float32)
            d_u = np.zeros_like(u)
            for step, h, z, r, new, inner, m in reversed(kept[d]):
                dh = dh + d_states[step][:, part]
                live = dh * m
                d_new = live * (1 - z) * (1 - new * new)
                d_z = live * (h - new) * z * (1 - z)
                d_r = d_new * inner * r * (1 - r)
                d_gates[step] = np.concatenate([d_z, d_r, d_new], axis=1)
                through = np.concatenate([d_z, d_r, d_new * r], axis=1)
                d_u += h.T @ through
                dh = np.where(m, live * z, dh) + through @ u.T
            grad["h" + d] = d_u
            grad["c" + d] = d_gates.sum(axis=(0, 1))
            grad["x" + d] = np.einsum("tne,tng->eg", x, d_gates)
        return loss, grad


def _padded(index: list[list[int]]) -> np.ndarray:
    out = np.full((len(index), WINDOW), -1, dtype=np.int64)
    for row, i in zip(out, index):
        row[: len(i)] = i
    return out


class _Adam:
    def __init__(self, w: dict[str, np.ndarray], rate: float) -> None:
        self.w, self.rate, self.n = w, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in w.items() if k not in ("words", "chars")}
        self.v = {k: np.zeros_like(v) for k, v in self.m.items()}

    def step(self, grad: dict[str, np.ndarray]) -> None:
        self.n += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grad.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.n), self.v[k] / (1 - 0.99**self.n)
            self.w[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


def _telling(docs: list[list[str]], labels: np.ndarray) -> dict[str, float]:
    """Log-odds of words by the most telling of the word and its beginnings, from document counts."""

    def marks(word: str) -> set[str]:
        return {word + "$", *(word[:n] for n in (4, 5, 6) if len(word) > n)}

    counts = Counter(), Counter()
    for words, label in zip(docs, labels):
        counts[int(label)].update(set().union(*map(marks, set(words))) if words else ())
    total = np.bincount(labels.astype(int), minlength=2)
    odds = {
        m: np.log((n + 0.5) / (total[1] + 1)) - np.log((counts[0][m] + 0.5) / (total[0] + 1))
        for m, n in counts[1].items()
        if n >= 3
    }
    return {w: max((odds.get(m, -9.0) for m in marks(w)), default=-9.0) for words in docs for w in set(words)}


def _odds(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Log-odds of rows by the documents of either label that have them; few documents say little."""
    odds = np.log((counts[1] + 0.5) / (total[1] + 1)) - np.log((counts[0] + 0.5) / (total[0] + 1))
    return odds * counts.sum(axis=0) / (counts.sum(axis=0) + TRUST)


def _informed(docs: list[list[str]], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of the rows of words and of n-grams."""
    total = np.bincount(labels.astype(int), minlength=2)
    of_words, of_chars = np.zeros((2, WORD_ROWS)), np.zeros((2, CHAR_ROWS))
    for words, label in zip(docs, labels.astype(int).tolist()):
        if words:
            distinct = list(set(words))
            of_words[label, np.unique(word_rows(distinct))] += 1
            of_chars[label, np.unique(gram_rows(distinct)[0])] += 1
    tables = (np.where(counts.sum(axis=0) >= LEAST_DOCS, SCALE * _odds(counts, total), 0) for counts in (of_words, of_chars))
    words, chars = (t.astype(np.float32) for t in tables)
    return words, chars


def _harmless(chosen: list[tuple[list[str], int]], rng: np.random.Generator) -> list[tuple[list[str], int]]:
    """Windows that say nothing, as label 0: short cuts of harmless ones, and none at all. Without them a
    text of which no word is known would get the share of toxic samples."""
    out: list[tuple[list[str], int]] = []
    for words, label in chosen:
        if label or not words or rng.random() >= HARMLESS:
            continue
        start, size = int(rng.integers(len(words))), int(rng.integers(1, 9))
        out += [(words[start : start + size], 0), ([], 0)]
    return out


def train(texts: list[str], labels: np.ndarray) -> Network:
    """Fit on documents with a label 0 or 1 each. The same documents give the same network."""
    net = Network.fresh()
    if len(set(labels.tolist())) < 2:
        net.w["out"][:] = 0
        net.w["bias"][:] = 6 if len(labels) and labels[0] else -6
        return net
    docs = [words_of(t) for t in texts]
    telling = _telling(docs, labels)
    fold = np.array([zlib.crc32(t.encode()) % FOLDS for t in texts])
    tables = []
    for f in range(FOLDS):
        tables.append(_informed([d for d, g in zip(docs, fold) if g != f], labels[fold != f]))
    net.w["words"], net.w["chars"] = whole = _informed(docs, labels)
    rng = np.random.default_rng(SEED)
    optimizer = _Adam(net.w, RATE)

    def window(words: list[str], start: int) -> list[str]:
        return words[start : start + WINDOW]

    def most_telling(words: list[str]) -> int:
        best = int(np.argmax([telling[w] for w in words])) if words else 0
        return min(max(0, best - int(rng.integers(0, WINDOW))), max(0, len(words) - WINDOW))

    for rounds, epochs in enumerate(EPOCHS):
        chosen: list[tuple[list[str], int]] = []
        folds: list[int] = []
        worst = Scorer(net).worst(docs) if rounds else None
        for i, (words, label) in enumerate(zip(docs, labels.tolist())):
            starts = {most_telling(words)} if worst is None else {worst[i]}
            if not label:
                starts.add(int(rng.integers(0, max(1, len(words) - WINDOW + 1))))
            chosen += [(window(words, s), label) for s in sorted(starts)]
            folds += [int(fold[i])] * len(starts)
        extra = _harmless(chosen, rng)
        chosen += extra
        folds += rng.integers(0, FOLDS, len(extra)).tolist()
        batches = -(-len(chosen) // BATCH)
        for _ in range(max(epochs, -(-LEAST_BATCHES[rounds] // batches))):
            order = rng.permutation(len(chosen))
            groups = [[i for i in order.tolist() if folds[i] == f] for f in range(FOLDS)]
            slots = [(f, lo) for f in range(FOLDS) for lo in range(0, len(groups[f]), BATCH)]
            for k in rng.permutation(len(slots)).tolist():
                f, lo = slots[k]
                net.w["words"], net.w["chars"] = tables[f]
                some = [chosen[i] for i in groups[f][lo : lo + BATCH]]
                index: dict[str, int] = {}
                at = _padded([[index.setdefault(w, len(index)) for w in words] for words, _ in some])
                if not index:
                    continue
                _, grad = net.gradients(list(index), at, np.array([y for _, y in some], dtype=np.float32))
                optimizer.step(grad)
        net.w["words"], net.w["chars"] = whole
        optimizer.rate /= 3
    return net


class Scorer:
    """Scores of texts; remembers the projected inputs of words, up to a bound."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.table = np.empty((0, 6 * HIDDEN), np.float32)

    def _indices(self, docs: list[list[str]]) -> list[np.ndarray]:
        if len(self.index) > _CACHE:
            self._forget()
        index = self.index
        new = list(dict.fromkeys(w for words in docs for w in words if w not in index))
        if new:
            index.update(zip(new, range(len(index), len(index) + len(new))))
            parts = [self.net.project(self.net.inputs(new[i : i + 20_000])) for i in range(0, len(new), 20_000)]
            self.table = np.concatenate([self.table, *parts])
        return [np.fromiter(map(index.__getitem__, words), dtype=np.int64, count=len(words)) for words in docs]

    def _windows(self, docs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, document and start of every window."""
        where = [(i, s) for i, words in enumerate(docs) for s in windows_of(len(words))]
        indices = self._indices(docs)
        owner = np.array([i for i, _ in where], dtype=np.int64)
        starts = np.array([s for _, s in where], dtype=np.int64)
        scores = np.empty(len(where))
        # Windows of one length class together: short documents need few steps.
        sizes = np.array([min(WINDOW, len(indices[i]) - s) for i, s in where], dtype=np.int64)
        order = np.argsort(sizes, kind="stable")
        for lo in range(0, len(where), WINDOWS_AT_ONCE):
            some = order[lo : lo + WINDOWS_AT_ONCE]
            steps = max(1, int(sizes[some].max()))
            at = np.full((len(some), steps), -1, dtype=np.int64)
            for row, k in zip(at, some.tolist()):
                i, s = where[k]
                row[: sizes[k]] = indices[i][s : s + WINDOW]
            scores[some] = self.net.scores(self.table if len(self.table) else np.zeros((1, 6 * HIDDEN), np.float32), at)
        return scores, owner, starts

    def worst(self, docs: list[list[str]]) -> list[int]:
        """Start of each document's window of the highest score."""
        out = []
        for lo in range(0, len(docs), 256):
            scores, owner, starts = self._windows(docs[lo : lo + 256])
            order = np.lexsort((-scores, owner))
            out += starts[order[np.flatnonzero(np.diff(owner[order], prepend=-1))]].tolist()
        return out

    def of(self, texts: list[str]) -> np.ndarray:
        """Highest score of the windows of each text."""
        out = np.zeros(len(texts))
        group: list[list[str]] = []
        first = size = 0
        for i, text in enumerate([*texts, None]):
            if text is not None:
                group.append(words_of(text))
                size += len(group[-1])
            if group and (text is None or size > 200_000):
                scores, owner, _ = self._windows(group)
                np.maximum.at(out, owner + first, scores)
                first, group, size = i + 1, [], 0
        return out


def fit(docs: DataFrame, labelled: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Network:
    """Learn from ``labelled`` (``doc_id`` and the label); ids without a document count for nothing.

    Of repeated ids one text is taken. With one label only, or none, all scores are alike.
    """
    chosen = F.broadcast(sampled(labelled, label, sample))  # ``sample`` rows of two numbers
    texts = docs.select("doc_id", whole_text().alias("text")).filter(F.length("text") <= SAMPLE_CHARS).join(chosen, "doc_id")
    got = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")
    return train(got["text"].to_list(), got["label"].to_numpy())


def score(docs: DataFrame, net: Network, column: str = "score") -> DataFrame:
    """Add the score of every whole text, 0 to 1; a column of that name is replaced.

    A null text is an empty one; a text without words gets the score of a window without words.
    Equal texts get equal scores up to rounding. An empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net.w)

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(Network(sent.value))
        for batch in batches:
            yield pd.Series(scorer.of(batch.to_list()), dtype="float64")

    return docs.withColumn(column, of.asNondeterministic()(whole_text()))
