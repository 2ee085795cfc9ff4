"""A corpus pipeline of five stages: what is kept by one is what the next one works on.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the
encoded documents. ``run`` stores every stage's result in the shared folder before the next begins.

Rows without an id take part in every stage; repeated rows are copies of each other, of which one
stays. Other columns pass until the last stage. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctables.llm import decontaminate, pii, quality, simhash
from doctables.llm.common import crc_remainder, stored, table
from doctables.llm.queries import encoded_digests

# The votes of neighbours cannot be written in SQL.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from labelled rows that are not held out.

    Texts without words (null, empty, blank) are not kept unless labelled ones speak for them.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(crc_remainder(5) != 0))
    scored = quality.score(docs, model, "_quality_score")
    return scored.filter(F.col("_quality_score") >= quality.THRESHOLD).drop("_quality_score")


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays; texts without words are one group."""
    return simhash.without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go. An empty text has none; an empty benchmark takes none."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kind; all documents stay, null texts as null."""
    return pii.redact(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document; null texts are empty."""
    return encoded_digests(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
