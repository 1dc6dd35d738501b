"""Token-id files of directly addressable codes: any token is read without decoding a block.

A segment holds whole documents in id order. Ids are cut into chunks of BITS bits, lowest first. Level l keeps the
l-th chunk of every id that has one, and a bitmap of which of those ids go on to the next level. A rank directory
counts the bitmap's ones before every 512 bits, so the place of an id in the next level is a directory entry and a
population count. Layout, little-endian: magic "DAC1", u32 bits, u32 documents, u64 tokens, u32 levels; u64 document
offsets (documents + 1); then per level u64 entries, chunk bytes, and but for the last level bitmap words (u64) and
rank entries (u64).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import id_and_text, partitions_for, trimmed, tune
from .tokens import END, default_tokenizer, tokenizer_for

MAGIC, BITS, RANK_BITS = b"DAC1", 8, 512
#: Tokens after which a segment is closed; it never splits a document.
SEGMENT_TOKENS = 1 << 18
SEGMENTS = "shard long, segment long, doc_ids array<long>, n_tokens long, first_token long, payload binary"


def encode(docs: list[np.ndarray]) -> bytes:
    """One segment of the ids (unsigned, up to 32 bits) of some documents."""
    ids = np.concatenate([np.asarray(d, np.uint32) for d in docs]) if docs else np.empty(0, np.uint32)
    offsets = np.cumsum([0, *map(len, docs)], dtype="<u8")
    levels, rest = [], ids
    while True:
        more = rest >> np.uint32(BITS)
        goes_on = more != 0
        last = not goes_on.any()
        part = struct.pack("<Q", len(rest)) + (rest & np.uint32((1 << BITS) - 1)).astype(np.uint8).tobytes()
        part += struct.pack("<B", last)
        if not last:
            room = -(-len(rest) // RANK_BITS) * RANK_BITS
            bits = np.packbits(np.concatenate([goes_on, np.zeros(room - len(rest), bool)]), bitorder="little")
            ones = np.bitwise_count(bits.view("<u8")).reshape(-1, RANK_BITS // 64).sum(1)
            part += bits.tobytes() + np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u8").tobytes()
        levels.append(part)
        if last:
            break
        rest = more[goes_on]
    return MAGIC + struct.pack("<IIQI", BITS, len(docs), len(ids), len(levels)) + offsets.tobytes() + b"".join(levels)


class Segment:
    """Read access to a segment's bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a segment of token ids")
        self.bits, n_docs, self.n_tokens, n_levels = struct.unpack_from("<IIQI", data, 4)
        at = 24
        self.offsets = np.frombuffer(data, "<u8", n_docs + 1, at)
        at += 8 * (n_docs + 1)
        self.levels = []
        for _ in range(n_levels):
            (n,) = struct.unpack_from("<Q", data, at)
            chunks = np.frombuffer(data, np.uint8, n, at + 8)
            at += 8 + n
            last = data[at]
            at += 1
            bitmap = ranks = None
            if not last:
                blocks = -(-n // RANK_BITS)
                bitmap = np.frombuffer(data, "<u8", blocks * RANK_BITS // 64, at)
                at += blocks * RANK_BITS // 8
                ranks = np.frombuffer(data, "<u8", blocks, at)
                at += 8 * blocks
            self.levels.append((chunks, bitmap, ranks))

    def __getitem__(self, i: int) -> int:
        """Token i of the segment: a directory lookup and some population counts a level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out = 0
        for depth, (chunks, bitmap, ranks) in enumerate(self.levels):
            out |= int(chunks[i]) << (depth * self.bits)
            if bitmap is None or not int(bitmap[i // 64]) >> (i % 64) & 1:
                return out
            block = i // RANK_BITS
            before = bitmap[block * RANK_BITS // 64 : i // 64]
            inside = int(bitmap[i // 64]) & ((1 << (i % 64)) - 1)
            i = int(ranks[block]) + int(np.bitwise_count(before).sum()) + inside.bit_count()
        return out

    def ids(self) -> np.ndarray:
        """All tokens."""
        out = np.zeros(self.n_tokens, "<u4")
        where = slice(None)
        for depth, (chunks, bitmap, _) in enumerate(self.levels):
            out[where] |= chunks.astype(np.uint32) << np.uint32(depth * self.bits)
            if bitmap is not None:
                on = np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little")[: len(chunks)])
                where = on if isinstance(where, slice) else where[on]
        return out


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end: int = END, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> None:
    """Encode all texts, in ascending id order, into segments under path (Parquet files with a binary column, so any
    store that Spark writes will do). Texts are range-partitioned once, into more shards the larger the input; shards are
    sorted and encoded one by one.

    Null texts are empty: the end id alone. Null ids come first. Rows of equal ids are in the order of their texts' hash,
    then of their texts, and may lie in several shards.
    An empty table writes files without rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    file = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, waiting, tokens, number, shard = tokenizer_for(file), [], 0, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal waiting, tokens, number
            data = encode([np.frombuffer(x, "<u4") for _, x in waiting])
            out = pa.RecordBatch.from_pydict({"shard": [shard], "segment": [number], "doc_ids": [[d for d, _ in waiting]], "n_tokens": [tokens], "first_token": [first], "payload": [data]}, schema=pa.schema([("shard", pa.int64()), ("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.int64()), ("first_token", pa.int64()), ("payload", pa.binary())]))
            waiting, tokens, number = [], 0, number + 1
            return out

        first = 0
        for b in batches:
            if not b.num_rows:
                continue
            shard = b.column(2)[0].as_py()
            for doc, ids in zip(b.column(0).to_pylist(), coder.encode(b.column(1).to_pylist(), end), strict=True):
                waiting.append((doc, ids))
                tokens += len(ids) // 4
                if tokens >= SEGMENT_TOKENS:
                    n = tokens
                    yield close()
                    first += n
        if waiting:
            yield close()

    order = ["doc_id", F.xxhash64("text")]
    ordered = id_and_text(docs, id_col, text_col).repartitionByRange(shards or partitions_for(docs), *order).sortWithinPartitions(*order, "text")
    ordered.select("doc_id", "text", F.spark_partition_id().cast("long").alias("shard")).mapInArrow(trimmed(run), SEGMENTS).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files under path: doc_id, start (tokens before the document in the whole corpus), n_tokens, ids array.

    A shard's first token follows from the totals of the shards before it: one row per shard, so that window is small.
    """
    return _decoded(spark, path, "ids array<int>", lambda x: pa.array(list(x), pa.list_(pa.int32())), lambda ids: ids.astype(np.int32))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """As read(), with the crc32 of a document's ids in place of the ids."""
    return _decoded(spark, path, "ids_crc32 long", lambda x: pa.array(x, pa.int64()), lambda ids: zlib.crc32(ids.tobytes()))


def _decoded(spark: SparkSession, path: str, column: str, to_array, of_ids) -> DataFrame:
    tune(spark)
    segments = spark.read.schema(SEGMENTS).parquet(path)
    totals = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    from pyspark.sql import Window

    # one row per shard, as many as write() had partitions
    before = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    placed = segments.join(F.broadcast(before), "shard").select("doc_ids", (F.col("first_token") + F.col("before")).alias("first"), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                docs, first, seg = b.column(0)[k].as_py(), b.column(1)[k].as_py(), Segment(b.column(2)[k].as_py())
                ids, at = seg.ids(), seg.offsets.astype(np.int64)
                values = [of_ids(ids[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(first + at[:-1]), pa.array(np.diff(at)), to_array(values)], names=["doc_id", "start", "n_tokens", column.split()[0]])

    return placed.mapInArrow(trimmed(run), f"doc_id long, start long, n_tokens long, {column}")
