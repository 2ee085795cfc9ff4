"""Quality rules on words, and tokenizer fertility with rejection bands per language.

Public vocabularies encode each word once per task, in batches. For each of them, characters per token,
the share of tokens that are single bytes or broken characters, and the entropy of the tokens (against
that of as many different tokens) describe a text. A band is set by the quartiles of all documents of
one language and about one length that pass the word rules, so it follows the data and needs no list of
languages. Where these are few, documents of the nearest lengths in all languages set it, so every text is judged.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Callable, Hashable, Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctables.llm.common import stored, whole_text
from doctables.operators.lookup import lookup_join

# Fixed values of the word rules.
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
# A band reaches so many interquartile ranges beyond the quartiles, and at least so much of the
# median. Only what speaks against a text is bounded: few characters per token, many bytes, and
# little variety.
REACH = {"chars_per_token": 6.0, "entropy": 3.5, "byte_share": 6.0}
LEAST_REACH = {"chars_per_token": 0.25, "entropy": 0.06, "byte_share": 0.0}
# No text is rejected for a byte share up to this one, whatever the language's quartiles.
FREE_BYTE_SHARE = 0.02
# A group with fewer documents than this is judged by the bands of its length in all languages, for
# which a length with fewer takes in the nearest ones until there are as many, or all.
MIN_DOCUMENTS = 50
# Rows from which on a language and length can be hot.
MIN_HOT = 1_000
# Words that a task remembers, and characters of the texts that it encodes at once.
_CACHE = 300_000
CHUNK_CHARS = 1_000_000

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_PER_VOCABULARY = ("chars_per_token", "byte_share", "entropy")


def measure_names(vocabularies: int) -> list[str]:
    """The token measures; those of the second vocabulary end in 2, and so on."""
    return [name + (str(i + 1) if i else "") for i in range(vocabularies) for name in _PER_VOCABULARY]


def repeated_words(words: Sequence[Hashable]) -> int:
    """Words in windows of eight that are found twice or more, the first one included."""
    index: dict[Hashable, int] = {}
    return repeated_numbers(np.array([index.setdefault(w, len(index)) for w in words], dtype=np.int64))


def repeated_numbers(words: np.ndarray) -> int:
    """The same of words given by numbers."""
    n = len(words) - WINDOW + 1
    if n < 2 or len(np.unique(words)) == len(words):
        return 0
    ids = words.astype(np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(WINDOW):
        h = (h + ids[i : i + n] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    counts = Counter(text.split("\n"))
    return sum(n - 1 for line, n in counts.items() if n > 1 and _WORD.search(line))


def sentence_pieces(path: str) -> tuple[Callable[[list[str]], list[list[int]]], np.ndarray]:
    """Encoder of words by a sentencepiece model, and which of its tokens are single bytes."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    single = np.array([model.is_byte(i) for i in range(model.get_piece_size())])
    return lambda words: model.encode(words, num_threads=1), single


def byte_pairs(path: str) -> tuple[Callable[[list[str]], list[list[int]]], np.ndarray]:
    """Encoder of words by ranks of byte pairs, and which of its tokens are no whole characters."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    broken = np.zeros(max(ranks.values()) + 1, bool)
    for piece, rank in ranks.items():
        try:
            piece.decode()
        except UnicodeDecodeError:
            broken[rank] = True
    # Runs of letters, of digits, and of other signs.
    model = tiktoken.Encoding("words", pat_str=r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+", mergeable_ranks=ranks, special_tokens={})
    return lambda words: list(map(model.encode_ordinary, words)), broken


class Vocabulary:
    """Tokens of numbered words: those of word i are ``tokens[first[i] : first[i + 1]]``."""

    def __init__(self, path: str) -> None:
        self.encode, self.single = (byte_pairs if path.endswith(".tiktoken") else sentence_pieces)(path)
        self.forget()

    def forget(self) -> None:
        self.tokens, self.first = np.empty(0, np.int64), np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> None:
        lists = self.encode(words)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        self.tokens = np.concatenate([self.tokens, np.fromiter((t for one in lists for t in one), np.int64, int(sizes.sum()))])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])

    def of(self, words: np.ndarray, times: np.ndarray, chars: int) -> tuple[int, tuple[float, float, float]]:
        """Tokens; characters per token, byte share, relative entropy (zeros without tokens) of distinct
        words that occur some times each."""
        sizes = self.first[words + 1] - self.first[words]
        n = int(sizes.sum())
        if not n:
            return 0, (0.0, 0.0, 0.0)
        at = np.repeat(self.first[words] - (np.cumsum(sizes) - sizes), sizes) + np.arange(n)
        tokens, weight = self.tokens[at], np.repeat(times, sizes)
        order = np.argsort(tokens)
        heads = np.flatnonzero(np.diff(tokens[order], prepend=-1))
        total = int(weight.sum())
        share = np.add.reduceat(weight[order], heads) / total
        entropy = float(-(share * np.log2(share)).sum())
        most = np.log2(min(total, len(self.single))) if total > 1 else 1.0
        return total, (chars / total, float(share[self.single[tokens[order][heads]]].sum()), entropy / most)


class Fertility:
    """Token measures of texts by some vocabularies; remembers words, up to a bound."""

    def __init__(self, *paths: str) -> None:
        self.vocabularies = [Vocabulary(path) for path in paths]
        self.index: dict[bytes, int] = {}

    def numbers(self, docs: list[list[bytes]]) -> list[np.ndarray]:
        """Words as numbers; new ones are encoded together."""
        if len(self.index) > _CACHE:
            self.index.clear()
            for v in self.vocabularies:
                v.forget()
        index = self.index
        new = list(dict.fromkeys(w for words in docs for w in words if w not in index))
        if new:
            index.update(zip(new, range(len(index), len(index) + len(new))))
            texts = [w.decode() for w in new]
            for v in self.vocabularies:
                v.learn(texts)
        return [np.fromiter(map(index.__getitem__, words), np.int64, len(words)) for words in docs]

    def measured(self, numbers: np.ndarray, chars: int) -> tuple:
        """Tokens of the first vocabulary, and the measures of all, of words with ``chars`` characters."""
        words, times = np.unique(numbers, return_counts=True)
        found = [v.of(words, times, chars) for v in self.vocabularies]
        return found[0][0], *(value for _, values in found for value in values)


def measures(text: Column, *paths: str) -> Column:
    """The rules' numbers and the token measures of a text column, as one struct."""
    whole, real = [*_COUNTS, "n_tokens"], measure_names(len(paths))
    schema = pa.struct([(n, pa.int64()) for n in whole] + [(n, pa.float64()) for n in real])
    ddl = ",".join([f"{n}:long" for n in whole] + [f"{n}:double" for n in real])

    @F.arrow_udf(f"struct<{ddl}>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fertility = Fertility(*paths)

        def rows(texts: list[str]) -> Iterator[dict]:
            # The white space of bytes is that of the rules.
            docs = [t.encode().split() for t in texts]
            for t, numbers in zip(texts, fertility.numbers(docs)):
                chars = len(t) - sum(map(t.count, _SPACES))
                rules = (len(numbers), chars, sum(map(t.count, _SYMBOLS)), duplicate_lines(t), repeated_numbers(numbers))
                yield dict(zip(schema.names, rules + fertility.measured(numbers, chars)))

        def chunks(texts: pa.Array) -> Iterator[list[str]]:
            held, chars = [], 0
            for value in texts:
                held.append(value.as_py())
                chars += len(held[-1])
                if chars > CHUNK_CHARS:
                    yield held
                    held, chars = [], 0
            yield held

        for texts in batches:
            yield pa.array([row for chunk in chunks(texts) for row in rows(chunk)], schema)

    return of.asNondeterministic()(text)


def measured(docs: DataFrame, *paths: str) -> DataFrame:
    """``doc_id``, ``lang``, the measures, and ``base_failed``; ``docs`` may lack ``lang``."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select("doc_id", F.coalesce(lang, F.lit("")).alias("lang"), measures(whole_text(), *paths).alias("m"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    # Entropy depends on length: two classes per doubling.
    length = F.floor(2 * F.log2(F.greatest("n_tokens", F.lit(1))))
    return rows.select("doc_id", "lang", "m.*").withColumns({"length": length, "base_failed": failed})


def _limits(names: list[str]) -> list[Column]:
    def reach(name: str, sign: int) -> Column:
        kind = name.rstrip("0123456789")
        low, mid, high = (F.col(f"{name}_q")[i] for i in range(3))
        edge = low if sign < 0 else high
        return edge + sign * F.greatest(REACH[kind] * (high - low), LEAST_REACH[kind] * mid)

    def limit(name: str) -> Column:
        return F.greatest(reach(name, 1), F.lit(FREE_BYTE_SHARE)) if name.startswith("byte_share") else reach(name, -1)

    return [limit(name).alias(f"{name}_limit") for name in names]


def _measures_of(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if c.rstrip("0123456789") in _PER_VOCABULARY]


def bands(rows: DataFrame, *keys: str, least: int = MIN_DOCUMENTS) -> DataFrame:
    """Limits per group of measured documents that pass the word rules."""
    names = _measures_of(rows)
    quartiles = [F.percentile_approx(name, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(1000)).alias(f"{name}_q") for name in names]
    good = rows.filter("NOT base_failed").groupBy(*keys).agg(*quartiles, F.count(F.lit(1)).alias("n"))
    return good.filter(F.col("n") >= least).select(*keys, *_limits(names))


def neighbours(counts: dict[int, int], least: int = MIN_DOCUMENTS) -> list[tuple[int, int]]:
    """(length, length to take in) for every length: itself, and those at the next distance until
    there are ``least`` documents or all are in."""
    out = []
    for length in counts:
        for distance in sorted({abs(other - length) for other in counts}):
            near = [other for other in counts if abs(other - length) <= distance]
            if sum(counts[other] for other in near) >= least:
                break
        out += [(length, other) for other in near]
    return out


def slope(medians: list[tuple[int, float, int]]) -> float:
    """Change of the median per length class, by least squares over (length, median, documents)."""
    x, y, n = np.array(medians, dtype=float).reshape(-1, 3).T
    if len(x) < 2:
        return 0.0
    dx = x - np.average(x, weights=n)
    return float((n * dx * y).sum() / (n * dx * dx).sum())


def bands_by_length(rows: DataFrame) -> DataFrame:
    """Limits for every length that has a document, in all languages together.

    The entropy of documents taken in from another length is moved along its trend over all lengths;
    towards longer texts it does not fall by more than if they had no more bits a token. What comes to
    the driver is one row per length: at most two per doubling of a 64-bit number.
    """
    entropies = [n for n in _measures_of(rows) if n.startswith("entropy")]
    medians = [F.percentile_approx(n, F.lit(0.5), F.lit(1000)).alias(n) for n in entropies]
    of_length = rows.filter("NOT base_failed").groupBy("length").agg(*medians, F.count(F.lit(1)).alias("n")).collect()
    trends = [slope([(r["length"], r[name], r["n"]) for r in of_length]) for name in entropies]
    pairs = [
        (other, to, other / to if to > other else 0.0, *(trend * (to - other) for trend in trends))
        for to, other in neighbours({r["length"]: r["n"] for r in of_length})
    ]
    shifts = ", ".join(f"shift{i} double" for i in range(len(entropies)))
    near = rows.sparkSession.createDataFrame(pairs, f"length long, to long, least double, {shifts}")
    moved = {name: F.greatest(F.col(name) + F.col(f"shift{i}"), F.col(name) * F.col("least")) for i, name in enumerate(entropies)}
    return bands(rows.join(F.broadcast(near), "length").withColumns({"length": F.col("to"), **moved}), "length", least=1)


def judged(docs: DataFrame, *paths: str) -> DataFrame:
    """One row per document: ``doc_id``, the measures, ``base_failed``, and ``kept``.

    ``paths`` are vocabularies; the first one's number of tokens is the length. ``kept`` is false where the
    word rules fail or a measure of any vocabulary is outside its band; every text that passes the rules
    has a band. A null text is empty and fails; a null ``lang`` is a language of its own. Repeated rows
    give repeated results. Other columns are ignored. An empty table gives no rows.
    """
    rows = stored(measured(docs, *paths), "measures")
    names = _measures_of(rows)
    # Languages are not bounded in number, and one of them may have most rows: those are salted.
    keyed = rows.withColumn("band", F.concat(F.col("length").cast("string"), F.lit(":"), F.col("lang")))
    own = bands(keyed, "band")
    any_language = bands_by_length(rows).select("length", *[F.col(f"{n}_limit").alias(f"{n}_any") for n in names])
    # There are at most two lengths per doubling of a 64-bit number.
    both = lookup_join(keyed, own, "band", "left", min_rows=MIN_HOT, skew=True).join(F.broadcast(any_language), "length", "left")

    def inside(name: str) -> Column:
        limit = F.coalesce(F.col(f"{name}_limit"), F.col(f"{name}_any"))
        return F.col(name) <= limit if name.startswith("byte_share") else F.col(name) >= limit

    kept = ~F.col("base_failed") & F.coalesce(reduce(and_, map(inside, names)), F.lit(False))
    return both.withColumn("kept", kept).select(*rows.columns, "kept").drop("lang", "length")
