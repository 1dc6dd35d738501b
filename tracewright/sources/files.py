"""Readers and writers of the formats in which traces come and go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.operators.graph import _kept as kept


def detect_format(path: str) -> str:
    for suffix in ("jsonl", "json", "parquet"):
        if path.rstrip("/").lower().endswith(f".{suffix}"):
            return suffix
    raise ValueError(f"unknown format: {path}")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows, and the raw text of lines that don't parse."""
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = spark.read.schema(wide).option("mode", "PERMISSIVE").json(path).select("*")
    raw = spark.read.text(path).where(F.trim("value") != "")
    tried = raw.withColumn("v", F.from_json("value", schema, {"mode": "PERMISSIVE"})).withColumn("ok", F.try_parse_json("value").isNotNull())
    return parsed.where("_corrupt_record IS NULL").drop("_corrupt_record"), tried.where("NOT ok").select("value")


def read_any(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    kind = detect_format(path)
    if kind == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.option("multiLine", kind == "json")
    return (reader.schema(schema) if schema else reader).json(path)


def write_any(df: DataFrame, path: str) -> None:
    """By the suffix: Parquet with Snappy, JSON lines, or for .json one array."""
    kind = detect_format(path)
    if kind == "parquet":
        df.write.parquet(path, compression="snappy")
    elif kind == "json":
        write_json(df, path)
    else:
        df.write.json(path)


def write_json(df: DataFrame, path: str) -> None:
    """One JSON array in one file: for small results, as it is made in one task. Larger ones: stream_array()."""
    df.select(F.to_json(F.struct(*df.columns)).alias("v")).agg(F.concat(F.lit("["), F.array_join(F.collect_list("v"), ",\n"), F.lit("]")).alias("value")).write.text(path)


def stream_array(df: DataFrame, path: str) -> None:
    """A JSON array in as many text files as df has partitions: the files in order, between an opening and a closing
    bracket of their own, are the array. No task holds more than a row."""
    spark = df.sparkSession
    df.select(F.concat(F.to_json(F.struct(*df.columns)), F.lit(",")).alias("value")).write.text(f"{path}/1-rows")
    for name, bracket in (("0-open", "["), ("2-close", "null]")):
        spark.createDataFrame([(bracket,)], "value string").coalesce(1).write.text(f"{path}/{name}")


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of what stream_array() wrote."""
    lines = spark.read.text(f"{path}/1-rows").select(F.from_json(F.regexp_replace("value", ",$", ""), schema).alias("v"))
    return lines.select("v.*")


def preview(df: DataFrame) -> DataFrame:
    """n, bytes: rows of a table and the length of their JSON."""
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(F.to_json(F.struct(*df.columns)))), F.lit(0)).alias("bytes"))


def records(docs: DataFrame, column: str, schema: str, inner: str | None = None) -> DataFrame:
    """Rows of JSON documents: the elements of a list, those under inner of an object that has it, or the object itself."""
    body = F.ltrim(F.col(column))
    items = F.from_json(body, items_type(schema))  # of an object it is a list of one
    if inner:
        held = F.from_json(F.get_json_object(body, f"$.{inner}"), items_type(schema))
        items = F.when(F.startswith(body, F.lit("[")), items).otherwise(F.coalesce(held, items))
    return docs.select(F.explode(items).alias("item")).select("item.*")


def items_type(schema: str) -> str:
    return f"array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in schema.split(','))}>>"


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path, modificationTime, length of all files below a folder, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")


# Suffixes of files that are text.
TEXT_SUFFIXES = (
    ".js", ".ts", ".jsx", ".tsx", ".py", ".java", ".cpp", ".c", ".h", ".css", ".scss", ".sass", ".html", ".htm", ".xml", ".json",
    ".md", ".txt", ".yml", ".yaml", ".toml", ".ini", ".cfg", ".conf", ".vue", ".svelte", ".php", ".rb", ".go", ".rs", ".swift", ".kt",
)


def format_of(path: Column) -> Column:
    """Format by the suffix; null for others."""
    found = F.regexp_extract(F.lower(path), r"\.(jsonl|json|parquet)$", 1)
    return F.nullif(found, F.lit(""))


def browser_rows(rows: DataFrame, key: str) -> DataFrame:
    """key, url: of key-value rows whose key speaks of a tab, browser, editor or view, the path or url in the value's JSON,
    which may stand among other text."""
    named = rows.where("key LIKE '%tab%' OR key LIKE '%browser%' OR key LIKE '%editor%' OR key LIKE '%view%' OR key LIKE '%webview%'")
    body = F.regexp_extract("value", r"(?s)(\{.*\})", 1)
    url = F.when(F.contains("key", F.lit("tab")), F.get_json_object(body, "$.path")).otherwise(F.get_json_object(body, "$.url"))
    return named.select(key, url.alias("url")).where("url IS NOT NULL")


def listed(value: str | list[str] | None) -> list[str]:
    """A parameter given as a list or as text with commas; blanks are left out."""
    parts = value if isinstance(value, list) else (value or "").split(",")
    return [p.strip() for p in parts if p and p.strip()]


def moment(value: str | None) -> str | None:
    """A parameter given as milliseconds since 1970 or as a date, as text that casts to a time; null if it is neither."""
    from datetime import UTC, datetime

    try:
        return datetime.fromtimestamp(int(value) / 1000, UTC).strftime("%Y-%m-%d %H:%M:%S.%f")
    except (TypeError, ValueError):
        pass
    try:
        return datetime.fromisoformat(value).strftime("%Y-%m-%d %H:%M:%S.%f")
    except (TypeError, ValueError):
        return None


def checked_range(since: str, until: str) -> tuple[str, str]:
    """A range of times from 2020 on, a year long at most."""
    from datetime import datetime, timedelta

    a, b = moment(since), moment(until)
    if a is None or b is None or a < "2020" or b < a or datetime.fromisoformat(b) - datetime.fromisoformat(a) > timedelta(days=366):
        raise ValueError(f"not a range of times: {since} to {until}")
    return a, b


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with n, from 1 in the order of distinct keys. Each of some ranges of keys is ranked on its own; a range starts
    after as many rows as the ranges before it hold, which is one row each."""
    from pyspark.sql import Window

    ranged = df.withColumn("_r", F.substring(F.col(order[0]).cast("string"), 1, 8))
    w = Window.partitionBy("_r").orderBy(*order)
    sizes = df.groupBy(F.substring(F.col(order[0]).cast("string"), 1, 8).alias("_r")).agg(F.count("*").alias("_n"))
    along = Window.orderBy("_r")
    base = sizes.select("_r", (F.sum("_n").over(along) - F.col("_n")).alias("_base"))
    return ranged.withColumn("n", F.row_number().over(w)).join(base, "_r").withColumn("n", F.col("n") + F.col("_base")).drop("_r", "_base")


def split_positions(df: DataFrame, order: list[str], share: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """The first share of the rows in an order, and the rest. Positions come from one count per range partition. Rows are
    dealt once and kept: each use would choose and coalesce its own ranges, whose numbers don't agree."""
    ranged = kept(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    local = ranged.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = local.groupBy("_p").agg(F.count("*").alias("_n"))
    along = Window.orderBy("_p")  # one row per partition
    bases = sizes.select("_p", (F.sum("_n").over(along) - F.col("_n")).alias("_base"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    placed = local.join(F.broadcast(bases), "_p").withColumn("_first", F.col("_base") + F.col("_i") <= F.floor(F.col("_all") * share))
    return placed.where("_first").select(*df.columns), placed.where("NOT _first").select(*df.columns)


def key_values(rows: DataFrame, like: str, schema: str) -> DataFrame:
    """Rows of a key-value dump (key, value JSON) whose key is like a pattern, one row per element of the value's array."""
    return rows.where(F.col("key").like(like)).select("key", F.explode(F.from_json("value", f"array<{schema}>")).alias("item")).select("key", "item.*")


def traces(prompts: DataFrame, messages: DataFrame) -> DataFrame:
    """session_id, n_events, events in time order: prompts and conversation messages as one document per session."""
    both = prompts.select("session_id", "ts", F.lit("prompt").alias("type"), "text").unionByName(messages.select("session_id", "ts", F.lit("conversation_message").alias("type"), "text"))
    return both.groupBy("session_id").agg(F.count("*").alias("n_events"), F.array_sort(F.collect_list(F.struct("ts", "type", "text"))).alias("events"))
