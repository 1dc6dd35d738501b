"""Corpus pipeline: quality, near duplicates, repeated passages, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of documents. A stage's decisions are those of its operator: rejected documents, all but one of a class of near
duplicates, words that an earlier document has and documents with a benchmark item go.

In every stage a null text counts as empty, other columns than those of documents are ignored, whatever their names, and
an empty table gives no rows. Repeated rows and rows of one id are judged each by all stages but the second, which keeps
one row of each class, and the third, in which rows of one id are one document. A null id is kept as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import attention_quality, decontaminate, ngram_join, packing, substrings
from tracewright.llm._common import folder, forget

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = attention_quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = attention_quality.score(docs.select(*COLUMNS), model, carry=COLUMNS[1:])
    return scored.where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of texts that link: five words and a similarity of 0.8."""
    return ngram_join.first_of_classes(docs.select(*COLUMNS), width=5, threshold=(4, 5))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that an earlier document has; a text that loses all its words goes, others stay as they are."""
    found = substrings.remove_repeats(docs, carry=COLUMNS[1:])
    text = F.when(F.col("n_removed") == 0, F.col("text")).otherwise(F.col("kept_text"))
    return found.where("n_removed < n_words or n_words = 0").select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Rows of one id go together."""
    found = decontaminate.find_contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    bad = found.select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.select(*COLUMNS).join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("benchmark decontamination", decontamination), ("packing", packed)]

#: SQL can express neither the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written in the shared folder and read again, and goes when the next
    stage has written its own."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = folder(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            forget(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
