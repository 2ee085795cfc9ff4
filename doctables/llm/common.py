"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctables.session import scratch

# The white space of the word rules: space and tab to carriage return. It is also what
# ``bytes.split()`` splits on.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """The whole text; a null one counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


PIECE, SHARED = 64, 8  # bytes


def in_pieces(words: list[str]) -> list[str]:
    """Words of over ``PIECE`` bytes, as in texts without spaces, as pieces of at most that size that
    share ``SHARED`` bytes or a few more; cut between characters. Others stay as they are."""
    if max(map(len, words), default=0) <= PIECE // 4:
        return words
    out: list[str] = []
    for w in words:
        if len(w) <= PIECE // 4 or len(data := w.encode()) <= PIECE:
            out.append(w)
            continue
        start = 0
        while True:
            end = _character(data, start + PIECE)
            out.append(data[start:end].decode())
            if end == len(data):
                break
            start = _character(data, end - SHARED)
    return out


def _character(data: bytes, at: int) -> int:
    """Start of the character that a position of UTF-8 is in; the end beyond it."""
    if at >= len(data):
        return len(data)
    while data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    What follows then depends on files that every executor sees, not on the lineage above.
    """
    path = f"{scratch(df.sparkSession, 'llm')}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_remainder(modulus: int, key: str = "doc_id") -> Column:
    """crc32 of an id's text (a null id: the empty text), modulo ``modulus``."""
    return F.pmod(F.crc32(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")), F.lit(modulus))
