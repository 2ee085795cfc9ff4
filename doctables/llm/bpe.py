"""Byte-level BPE encoding and decoding through a table of distinct words.

1. Documents are split into words, block by block. A block keeps each of its words once, in lists by
   a hash of the word, and its documents as positions in these lists.
2. The lists of one hash, of all blocks, meet in one task: a part of the distinct-word table, where
   every word is encoded once.
3. The ids return to their block, in list order, and are copied to the documents' positions.

What is shuffled is each block's word lists and its compressed positions, not a row per word.
``decode`` joins the distinct ids of each list with the table of pieces. Where texts are encoded and decoded
in one pass, ids are looked up in that table instead, which is as large as the vocabulary and no larger: the
join on distinct ids per block was built twice and is over the check tool's limits (figures in README).
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctables.llm.common import stored, whole_text

# A block ends with the document that takes it over one of these sizes.
BLOCK_CHARS = 8_000_000
BLOCK_DOCS = 50_000
# Parts of the distinct-word table, and the words of a part that are held at once.
BUCKETS = 128
TABLE_WORDS = 1_000_000
# Characters below this are split by one regular expression; its classes are those of all Unicode
# versions there. Texts with other characters are split by the tokenizer's own splitter.
_PLAIN_BELOW = 0x250


def _plain_pattern() -> re.Pattern:
    chars = [chr(c) for c in range(_PLAIN_BELOW)]

    def members(kind: str) -> str:
        return "".join(re.escape(c) for c in chars if unicodedata.category(c).startswith(kind))

    # White space of the Unicode standard in this range.
    space = "\t\n\x0b\x0c\r \x85\xa0"
    letters, numbers = members("L"), members("N")
    return re.compile(
        f"'(?:s|t|re|ve|m|ll|d)| ?[{letters}]+| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    )


def word_splitter(path: str) -> Callable[[str], list[str]]:
    """Split a text into the words that the tokenizer encodes separately, special tokens included."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path).pre_tokenizer
    with open(path, encoding="utf-8") as f:
        special = sorted((t["content"] for t in json.load(f)["added_tokens"]), key=len, reverse=True)
    cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None
    plain = _plain_pattern()
    beyond = re.compile(f"[^\\x00-{chr(_PLAIN_BELOW - 1)}]")

    def section(text: str) -> list[str]:
        if not beyond.search(text):
            return plain.findall(text)
        return [text[a:b] for _, (a, b) in own.pre_tokenize_str(text)]

    def split(text: str) -> list[str]:
        if cut is None or not cut.search(text):
            return section(text)
        words = []
        for i, part in enumerate(cut.split(text)):
            words += [part] if i % 2 else section(part) if part else []
        return words

    return split


class _Positions(dict):
    """Words in order of appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        return at


def _packed(*numbers: np.ndarray, text: bytes = b"") -> bytes:
    """Arrays of non-negative numbers and a text, compressed.

    All first bytes of an array's numbers come first, then all second ones, and so on: the higher
    bytes are mostly zero and vanish.
    """
    head, parts = [], []
    for n in numbers:
        wide = max(1, (int(n.max()).bit_length() + 7) // 8) if len(n) else 1
        head += [len(n), wide]
        parts += [(n >> (8 * i)).astype(np.uint8).tobytes() for i in range(wide)]
    data = b"".join([*parts, text])
    return bytes([len(numbers)]) + np.array([len(data), *head], dtype="<u4").tobytes() + pa.compress(data, "zstd", asbytes=True)


def _unpacked(row: bytes) -> tuple[list[np.ndarray], bytes]:
    fields = 1 + 2 * row[0]
    size, *head = np.frombuffer(row, dtype="<u4", count=fields, offset=1).tolist()
    data = pa.decompress(row[1 + 4 * fields :], size, "zstd", asbytes=True)
    out, at = [], 0
    for length, wide in zip(head[::2], head[1::2]):
        n = np.zeros(length, dtype=np.int64)
        for i in range(wide):
            n |= np.frombuffer(data, np.uint8, length, at).astype(np.int64) << (8 * i)
            at += length
        out.append(n)
    return out, data[at:]


def _packed_words(words: list[str]) -> bytes:
    encoded = [w.encode() for w in words]
    return _packed(np.array([len(w) for w in encoded], dtype=np.int64), text=b"".join(encoded))


def _unpacked_words(row: bytes) -> list[str]:
    (sizes,), text = _unpacked(row)
    ends = np.cumsum(sizes, dtype=np.int64).tolist()
    return [text[a:b].decode() for a, b in zip([0, *ends], ends)]


def word_blocks(docs: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Rows (``block``, ``doc_ids``, ``n_words``, ``stream``, ``lists``): ``lists`` has the block's
    words by hash, ``stream`` the words' frequency ranks in the documents, one after the other, and
    the place of each rank in the concatenated lists."""

    def block(number: int, ids: list, streams: list[np.ndarray], words: _Positions) -> pa.RecordBatch:
        order = list(words)
        dealt = [(zlib.crc32(w.encode()) % buckets, w, i) for i, w in enumerate(order)]
        dealt.sort()
        place = np.empty(len(order), dtype=np.int64)
        place[[i for _, _, i in dealt]] = np.arange(len(order))
        ends = np.cumsum(np.bincount([b for b, _, _ in dealt], minlength=buckets)).tolist()
        lists = [_packed_words([w for _, w, _ in dealt[a:b]]) if a < b else None for a, b in zip([0, *ends], ends)]
        stream = np.concatenate(streams)
        by_count = np.argsort(-np.bincount(stream, minlength=len(order)), kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[by_count] = np.arange(len(order))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([ids], pa.list_(pa.int64())),
                pa.array([[len(s) for s in streams]], pa.list_(pa.int32())),
                pa.array([_packed(rank[stream], place[by_count])], pa.binary()),
                pa.array([lists], pa.list_(pa.binary())),
            ],
            ["block", "doc_ids", "n_words", "stream", "lists"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split = word_splitter(path)
        number = TaskContext.get().partitionId() << 32
        ids, streams, words, chars = [], [], _Positions(), 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                ids.append(doc_id)
                streams.append(np.array(list(map(words.__getitem__, split(text))), dtype=np.int32))
                chars += len(text)
                if chars >= BLOCK_CHARS or len(ids) >= BLOCK_DOCS:
                    yield block(number, ids, streams, words)
                    number += 1
                    ids, streams, words, chars = [], [], _Positions(), 0
        if ids:
            yield block(number, ids, streams, words)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return rows.mapInArrow(
        run, "block long, doc_ids array<long>, n_words array<int>, stream binary, lists array<binary>"
    )


def encode_lists(lists: DataFrame, path: str) -> DataFrame:
    """Packed word lists (``block``, ``bucket``, ``words``) to packed ``ids``, with their number per word.

    The rows of a bucket come one after the other, and a word has one bucket, so it is encoded once;
    the table of a bucket starts again beyond ``TABLE_WORDS`` words, which bounds its memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        known: dict[str, list[int]] = {}
        last = None
        for batch in batches:
            buckets = batch.column(1).to_pylist()
            rows = [_unpacked_words(row) for row in batch.column(2).to_pylist()]
            if last != buckets[0] or len(known) > TABLE_WORDS:
                known = {}
            last = buckets[-1]
            new = list(dict.fromkeys(w for row in rows for w in row if w not in known))
            known.update(zip(new, (e.ids for e in tok.encode_batch_fast(new, add_special_tokens=False))))
            out = []
            for row in rows:
                ids = [known[w] for w in row]
                sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
                flat = np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=int(sizes.sum()))
                out.append(_packed(sizes, flat))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["block", "bucket", "ids"]
            )

    dealt = lists.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "block long, bucket int, ids binary")


def _copy_to_positions(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    """Blocks with the ids of their words to one row per document; with ``path`` also its decoded ids."""
    table = None if path is None else pieces(path)
    for batch in batches:
        for row in range(batch.num_rows):
            doc_ids = batch.column("doc_ids")[row].values
            n_words = batch.column("n_words")[row].values.to_numpy()
            # A block of empty texts has no words and no ids.
            parts = [_unpacked(p)[0] for p in batch.column("ids")[row].as_py() or []]
            sizes = np.concatenate([np.empty(0, np.int64), *(p[0] for p in parts)])
            flat = np.concatenate([np.empty(0, np.int64), *(p[1] for p in parts)]).astype(np.int32)
            (ranks, places), _ = _unpacked(batch.column("stream")[row].as_py())
            sizes, begins = sizes[places], (np.cumsum(sizes) - sizes)[places]
            edges = np.concatenate([[0], np.cumsum(n_words, dtype=np.int64)])
            for first in range(0, len(n_words), 64):
                some = edges[first : first + 65]
                at = ranks[some[0] : some[-1]]
                n = sizes[at]
                ends = np.concatenate([[0], np.cumsum(n)])
                source = np.repeat(begins[at] - ends[:-1], n) + np.arange(ends[-1])
                ids = pa.ListArray.from_arrays(pa.array(ends[some - some[0]].astype(np.int32)), pa.array(flat[source]))
                columns = [doc_ids.slice(first, len(some) - 1), ids]
                if table is not None:
                    columns.append(pa.array([_joined(row.values.to_numpy(), table) for row in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """(``doc_id``, ``ids``) of every row of ``docs``, as the tokenizers library encodes the whole
    text without added special tokens. With ``decoded`` also the text that the ids decode to, looked
    up in the same pass in a table of pieces that each task holds.

    A null or empty text has an empty list. Repeated rows and rows without ``doc_id`` keep a row
    each. Other columns are ignored. An empty table gives no rows.
    """
    # Both uses below read this one exchange: they ask for the same columns, and the second finds its
    # rows where the join wants them.
    blocks = word_blocks(docs, path).repartition("block")
    whole = F.col("doc_ids").isNotNull() & F.col("n_words").isNotNull() & F.col("stream").isNotNull()
    lists = blocks.select("block", F.posexplode(F.when(whole, F.col("lists"))).alias("bucket", "words")).filter(
        "words IS NOT NULL"
    )
    coded = encode_lists(lists, path).groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("bucket", "ids"))).alias("got")
    )
    back = coded.select("block", F.col("got.ids").alias("ids"))
    both = blocks.join(back, "block", "left")
    return both.select("doc_ids", "n_words", "stream", "lists", "ids").mapInArrow(
        lambda it: _copy_to_positions(it, path if decoded else None),
        "doc_id long, ids array<int>" + (", decoded string" if decoded else ""),
    )


def piece_table(spark: SparkSession, path: str) -> DataFrame:
    """(``id``, ``piece``) of a vocabulary."""
    return spark.createDataFrame(list(enumerate(map(bytearray, pieces(path)))), "id int, piece binary")


def pieces(path: str) -> list[bytes]:
    """Bytes of every id: the vocabulary's characters mapped back to bytes."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    # The byte alphabet: printable bytes stand for themselves, the others follow from 256 on.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    table = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        known = all(c in byte_of for c in piece)
        table[i] = bytes(byte_of[c] for c in piece) if known else piece.encode()
    return table


def _joined(ids: np.ndarray, table: list[bytes]) -> str:
    return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", errors="replace")


def decode(rows: DataFrame, path: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the text of a column of id lists, for callers with ids of their own.

    Each list's distinct ids are joined with the table of pieces; a list's own are gathered again, so no
    more than a vocabulary. Bytes that are not UTF-8 become replacement characters; ids without a piece
    are left out; a null list is empty. Repeated rows stay.
    """
    numbered = stored(rows.withColumn("_row", F.monotonically_increasing_id()), "ids")
    ids = numbered.select("_row", F.explode(F.array_distinct(F.col(column).cast("array<int>"))).alias("id"))
    found = ids.join(F.broadcast(piece_table(rows.sparkSession, path)), "id")
    pieces_of = found.groupBy("_row").agg(F.collect_list(F.struct("id", "piece")).alias("_pieces"))

    @F.arrow_udf("string")
    def text(lists: pa.Array, tables: pa.Array) -> pa.Array:
        out = []
        for own, table in zip(lists.to_pylist(), tables.to_pylist()):
            of_id = {p["id"]: p["piece"] for p in table or []}
            out.append(b"".join(of_id.get(i, b"") for i in own or []).decode("utf-8", errors="replace"))
        return pa.array(out, pa.string())

    both = numbered.join(pieces_of, "_row", "left")
    return both.withColumn(into, text.asNondeterministic()(F.col(column), F.col("_pieces"))).drop("_row", "_pieces")
