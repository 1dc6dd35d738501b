"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch, so that a batch of long texts stays small in a Python worker.
ARROW_ROWS = 512
#: Odd 64-bit multipliers of the window hashes.
_MULTIPLIERS = np.random.default_rng(20240607).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one, but only in
    local mode: elsewhere the machines would not see each other's files."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")


_folders: list[tuple[SparkSession, str]] = []


def forget(spark: SparkSession, path: str) -> None:
    """Delete a folder, if its session still runs."""
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may have ended already
        pass


def release() -> None:
    """Delete all that was staged so far. To be called when the results that were made from it have been written; what
    is left goes when Python ends."""
    while _folders:
        forget(*_folders.pop())


atexit.register(release)


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which release() deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _folders.append((spark, path))
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df once in the shared folder and read it back: lineage is cut and a lost executor costs no recomputation."""
    path = folder(df.sparkSession, f"stage-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tune(spark: SparkSession) -> None:
    """Small Arrow batches bound the memory of Python workers whatever the length of the texts."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) != ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def trim() -> None:
    """Give this process's free memory back."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if free:
        free(0)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, after which the worker gives its free memory back: workers outlive their tasks, and what one
    step leaves unused would count on top of the next one's."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def held_out(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod, is 0. A null id counts as its empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod == 0


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """doc_id long, text binary (null: empty): other columns, whatever their names, never reach an operator."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *more)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (the murmur3 finaliser)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every window of width consecutive words, from the words' hashes; none if there are fewer words."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(width):
        out += h[j : j + n] * _MULTIPLIERS[j]
    return mixed(out)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: A-Z lower-cased, words between ASCII white space; fewer words than width make one shingle, no word none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    return np.unique(window_hashes(h, min(width, len(words))) + np.uint64(0 if len(words) >= width else len(words)))


def partitions_by_size(df: DataFrame, mb: int = 32) -> int:
    """Partitions for what is gathered from df's rows, by the size of its input."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(400_000, size // (mb << 20)) if size < 1 << 60 else 0


def partitions_for(df: DataFrame) -> int:
    """The session's shuffle partitions, or more if df's input is large."""
    return max(shuffle_partitions(df.sparkSession), partitions_by_size(df))


def most_frequent(counts: DataFrame, k: int, column: str = "c") -> DataFrame:
    """Rows of the largest counts, at most k: all from a bound on, which comes from some 500 log-scaled buckets. So no
    task and no driver holds more than k rows, and equal counts are all in or all out."""
    size = F.floor(8 * F.log2(F.col(column))).cast("int")
    cut, n = -1, 0
    for r in counts.groupBy(size.alias("b")).agg(F.count("*").alias("n")).orderBy(F.desc("b")).collect():
        n += r["n"]
        if n > k:
            cut = r["b"]
            break
    return counts.where(size > cut)
