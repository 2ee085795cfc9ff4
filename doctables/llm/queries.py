"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctables.llm import bpe, chat, decontaminate, fertility, licenses, pii, quality, repeats, runs, simhash, toxicity, webpages, whitening
from doctables.llm.common import crc_remainder, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _sha(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


@query
def op1_licenses(spark, sf):
    return licenses.scan(table(spark, sf, "documents"))


def _span_list(kinds: tuple[str, ...]) -> Column:
    of_kinds = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    one = F.transform(of_kinds, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


@query
def op2_pii(spark, sf):
    found = pii.find(table(spark, sf, "documents").select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.BASE_KINDS]
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",")
    lists = _sha(_span_list(pii.BASE_KINDS)).alias("base_sha256"), _span_list(pii.KINDS).alias("spans"), scores.alias("scores")
    return found.select("doc_id", *counts, *lists)


@query
def op3_fertility(spark, sf):
    paths = [vocabulary_file(name) for name in ("piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken")]
    found = fertility.judged(table(spark, sf, "documents"), *paths)
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select(
        *first, "chars_per_token", "byte_share", F.col("entropy").alias("token_entropy"),
        F.col("chars_per_token2").alias("byte_pair_chars"), F.col("byte_share2").alias("byte_pair_share"), F.col("entropy2").alias("byte_pair_entropy"),
    )


@query
def op4_webpages(spark, sf):
    found = webpages.with_main_text(table(spark, sf, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def encoded_digests(docs: DataFrame) -> DataFrame:
    """Encode, decode, and reduce both to digests."""
    encoded = bpe.encode(docs, vocabulary_file(), decoded=True)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        _sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        _sha(F.col("decoded")).alias("decoded_sha256"),
    )


@query
def op5_bpe(spark, sf):
    return encoded_digests(table(spark, sf, "documents"))


@query
def op6_decontaminate(spark, sf):
    found = decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", F.explode("item_ids").alias("item_id"), "doc_start", "doc_end", "n_overlap", "n_equal"
    )


@query
def op7_quality(spark, sf):
    docs = table(spark, sf, "documents")
    held_out = crc_remainder(5) == 0
    model = quality.fit(docs, table(spark, sf, "labels").filter(~held_out))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


@query
def op8_simhash(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query
def op9_toxicity(spark, sf):
    docs = table(spark, sf, "documents")
    held_out = crc_remainder(4) == 2
    net = toxicity.fit(docs, table(spark, sf, "labels").filter(~held_out))
    scored = toxicity.score(docs.select("doc_id", "text"), net)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


@query
def op10_repeats(spark, sf):
    docs = table(spark, sf, "documents")
    texts = repeats.cleaned_texts(docs).select(
        "same",
        "n_bytes",
        "n_removed",
        F.size("stretches").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
    return repeats.per_document(docs, texts).select(
        "doc_id", F.col("n_bytes").cast("long").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256"
    )


# A conversation whose texts hold control strings.
_ODD_TURNS = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


@query
def op11_chat(spark, sf):
    names = ["conv_id", "turn", "role", "text"]
    odd = spark.createDataFrame(_ODD_TURNS, "conv_id long, turn long, role string, text string")
    rows = table(spark, sf, "conversations").select(*names).unionByName(odd)
    return chat.read_back(chat.formatted(rows))


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents, periodic from one on; which and how, the id's crc32 says."""
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query
def op12_runs(spark, sf):
    found = runs.find(table(spark, sf, "documents"), planted_period)
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[f].cast("string") for f in ("start", "length", "period")]), F.lit("\n")))
    best = F.col("strongest")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.floor(F.lit(1000) * best["length"] / best["period"]).alias("exponent_milli"),
        _sha(F.array_join(line, "")).alias("runs_sha256"),
        _sha(F.col("collapsed")).alias("collapsed_sha256"),
    )


@query
def op13_whitening(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return whitening.whitened(vectors, whitening.fit(vectors))
