"""Quality rules with thresholds that adapt to each language and source, from mergeable quantile sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import id_and_text, staged, tune, window_hashes, word_hashes

#: Characters that count as symbols, white space, and the width of a repeated window, in words: fixed values.
SYMBOLS, SPACE, WINDOW = b"#*$%&|<>", b" \t\n\r\x0b\x0c", 8
METRICS = ("word_length", "symbol_share", "dup_line_share", "repeat_share")
#: Of each metric: per cent of the documents at its lower, middle and upper quantile, and how many spreads (upper less
#: middle quantile) beyond them its fences lie. Word length has an ordinary spread; the others are zero for most
#: documents, so that only quantiles of the tail say what is usual.
LEVELS = {"word_length": (25, 25, 75, 3), "symbol_share": (0, 50, 90, 3), "dup_line_share": (0, 50, 98, 1), "repeat_share": (0, 50, 98, 1)}
#: Metrics whose spread is at least that of the language: copies of one document may make up half of a source.
POOLED = ("word_length",)
#: Of the documents in which a metric is not zero, per cent that lie below every fence: the smallest amounts are left alone.
SMALL = 5
#: Groups of fewer documents take the quantiles of their language, and those the overall ones.
LEAST_DOCS = 100
#: Groups of language and source up to which the thresholds are broadcast; beyond, they are joined by a shuffle.
BROADCAST_GROUPS = 20_000


def text_counts(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines with a word, n_dup_lines, n_repeat_words of a text."""
    words = text.split()
    chars = len(text.decode("utf-8", "replace")) - (len(text) - len(text.translate(None, SPACE)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) > WINDOW:
        w = window_hashes(word_hashes(words), WINDOW)
        order = np.sort(w)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            edge = np.zeros(len(words) + 1, np.int64)
            starts = np.flatnonzero(np.isin(w, twice))
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + WINDOW, -1)
            repeated = int((np.cumsum(edge[:-1]) > 0).sum())
    return len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeated


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts of every text, and metrics in whole hundredths of a character (word length) or of a per cent (the others)."""
    names = ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([text_counts(t) for t in b.column(1).to_pylist()], np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *(pa.array(found[:, i]) for i in range(6))], names=names)

    group = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c2) for c, c2 in ((lang_col, "lang"), (source_col, "source"))]
    counts = id_and_text(docs, id_col, text_col, *group).mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{n} long" for n in names[3:]))
    return counts.select(
        "*",
        F.expr("100 * word_chars div greatest(n_words, 1)").alias("word_length"),
        F.expr("10000 * n_symbols div greatest(word_chars, 1)").alias("symbol_share"),
        F.expr("10000 * n_dup_lines div greatest(n_lines, 1)").alias("dup_line_share"),
        F.expr("10000 * n_repeat_words div greatest(n_words, 1)").alias("repeat_share"),
    )


def bucket(value: Column) -> Column:
    """Lower end of a value's bucket: its upper six bits, so within 1/32 of the value; below 64 the value itself."""
    shift = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(metrics: DataFrame) -> DataFrame:
    """A quantile sketch per language, source and metric: counts of log-scaled buckets. Sketches merge by adding counts,
    partial counts are formed before the shuffle, and a sketch has at most some 2,000 buckets whatever the input."""
    long = metrics.select("lang", "source", F.explode(F.create_map(*(x for m in METRICS for x in (F.lit(m), F.col(m))))).alias("metric", "value"))
    return long.groupBy("lang", "source", "metric", bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def bucket_end(low: Column) -> Column:
    """Upper end of the bucket that begins at low."""
    return low + F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.length(F.bin(low)) - 6, F.lit(0))) - 1


def _of_metric(values: dict[str, int]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[F.col("metric")]


def quantiles(sketch: DataFrame, *keys: str, levels: dict[str, tuple[int, ...]] = LEVELS) -> DataFrame:
    """n_docs, low, middle and high quantile of each sketch: the bucket at which the running count reaches the share, the
    lower end of the first two and the upper end of the last."""
    w = Window.partitionBy(*keys, "metric")
    run = sketch.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))

    def at(k: int) -> Column:
        return F.min(F.when(100 * F.col("upto") >= _of_metric({m: x[k] for m, x in levels.items()}) * F.col("total"), F.col("bucket")))

    return run.groupBy(*keys, "metric").agg(F.max("total").alias("n_docs"), at(0).alias("low"), at(1).alias("middle"), bucket_end(at(2)).alias("high"))


def fences(sketch: DataFrame) -> DataFrame:
    """One row per language and source: low_ and high_ of each metric. Quantiles are those of its own sketch, or its
    language's or all if it has few documents; no fence lies below the smallest amounts that occur at all."""

    def wide(q: DataFrame, keys: list[str], tag: str) -> DataFrame:
        ranged = q.select(*keys, "metric", "n_docs", "low", "high", ((F.col("high") - F.col("middle")) * _of_metric({m: x[3] for m, x in LEVELS.items()})).alias("spread"))
        return ranged.groupBy(*keys).agg(F.max("n_docs").alias(f"{tag}_docs"), *(F.max(F.when(F.col("metric") == m, F.col(e))).alias(f"{tag}_{e}_{m}") for m in METRICS for e in ("low", "high", "spread")))

    own = wide(quantiles(sketch, "lang", "source"), ["lang", "source"], "own")
    by_lang = wide(quantiles(merged(sketch, "lang"), "lang"), ["lang"], "lang")
    total = wide(quantiles(merged(sketch)), [], "all")
    least = quantiles(merged(sketch.where("bucket > 0")), levels={m: (SMALL, SMALL, SMALL) for m in METRICS}).agg(*(F.max(F.when(F.col("metric") == m, F.col("low"))).alias(f"least_{m}") for m in METRICS))
    joined = own.join(by_lang, "lang").crossJoin(F.broadcast(total)).crossJoin(F.broadcast(least))  # one row each: of all documents

    def pick(x: str) -> Column:
        return F.when(F.col("own_docs") >= LEAST_DOCS, F.col(f"own_{x}")).otherwise(wider(x))

    def wider(x: str) -> Column:
        return F.when(F.col("lang_docs") >= LEAST_DOCS, F.col(f"lang_{x}")).otherwise(F.col(f"all_{x}"))

    def fence(m: str) -> tuple[Column, Column]:
        spread = F.greatest(pick(f"spread_{m}"), wider(f"spread_{m}")) if m in POOLED else pick(f"spread_{m}")
        return (pick(f"low_{m}") - spread).alias(f"low_{m}"), F.greatest(pick(f"high_{m}") + spread, F.coalesce(F.col(f"least_{m}"), F.lit(0))).alias(f"high_{m}")

    return joined.select("lang", "source", *(x for m in METRICS for x in fence(m)))


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts, fences and verdict of every document.

    Texts are read once; their counts, some dozen numbers a document, are staged, sketched and joined with the fences.
    base_failed: fewer than 20 words, or over 30 % of them in repeated windows. kept: base rules passed and no metric
    beyond its fence (word length on both sides, the others above). Null texts are empty and fail. Null languages and
    sources form groups of their own (with the empty name). Fences are of the documents that pass the base rules, all
    of them: those that fail are judged already, and would set what is usual; a group without any other has null fences.
    Repeated rows are judged each; a null id stays null; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    tune(spark)
    metrics = staged(measured(docs, id_col, text_col, lang_col, source_col), "rules")
    base = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    limits = staged(fences(sketches(metrics.where(~base))), "fences")
    n_groups = limits.count()
    limits = F.broadcast(limits) if n_groups <= BROADCAST_GROUPS else limits
    judged = metrics.join(limits, ["lang", "source"], "left")
    beyond = F.col("word_length") < F.col("low_word_length")
    for m in METRICS:
        beyond = beyond | (F.col(m) > F.col(f"high_{m}"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~F.coalesce(beyond, F.lit(False))).alias("kept"), *METRICS, *(f"high_{m}" for m in METRICS))
