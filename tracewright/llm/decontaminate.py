"""Benchmark decontamination with DataFrame functions only: size-partitioned MinHash containment search, then exact
containment of shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import staged

WIDTH, CONTAINMENT = 5, (4, 5)
#: Rows up to which sketches, items or found pairs are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def words(text: Column) -> Column:
    """Lower-cased words between ASCII white space; an empty text has none."""
    trimmed = F.btrim(F.lower(text), F.lit(" \t\n\r\x0b\x0c"))
    return F.when(trimmed != "", F.split(trimmed, "[\\x20\\x09-\\x0D]+")).otherwise(F.array().cast("array<string>"))


def shingles(tokenized: DataFrame, width: int, *keep: str) -> DataFrame:
    """A row per shingle of column w: h, its hash, and w0, w1 ..., its words, with the columns named in keep. Shifted
    copies of the array are zipped and inlined, which stays in generated code."""
    whole = tokenized.where(F.size("w") >= width)
    shifted = [F.slice("w", j + 1, F.size("w") - width + 1).alias(f"w{j}") for j in range(width)]
    rows = whole.select(*keep, F.inline(F.arrays_zip(*shifted)).alias(*(f"w{j}" for j in range(width))))
    return rows.select(*keep, F.xxhash64(*(f"w{j}" for j in range(width))).alias("h"), *(f"w{j}" for j in range(width)))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find_contained(docs: DataFrame, items: DataFrame, containment: tuple[int, int] = CONTAINMENT, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, n_item, n_shared: items of whose n_item distinct shingles the document has containment or more.

    Items are partitioned by their number of shingles n; in each partition the MinHash sketch of an item is its
    n - ceil(n * containment) + 1 smallest shingle hashes. A document that contains enough of an item has at least one
    of those, so the search over sketches loses nothing; it is one probe per shingle of a document. Documents with too
    few words for any item of a sketch's hash are pruned. Pairs are then verified on the shingles' words.

    Items of fewer words than width are one shingle of all their words. Null or empty items and documents match
    nothing. Rows that share an id, also the null id, are one document or item with the shingles of all; each pair
    comes once. Empty tables give no rows; other columns are ignored.
    """
    num, den = containment
    tokenized = items.select(F.col(item_id_col).cast("long").alias("item_id"), words(F.col(item_text_col)).alias("w"))
    tokenized = tokenized.where(F.size("w") > 0).withColumn("width", F.least(F.size("w"), F.lit(width)))
    of_items = None
    for k in range(1, width + 1):
        part = shingles(tokenized.where(F.col("width") == k), k, "item_id", "width")
        part = part.select("item_id", "width", "h", F.concat_ws(" ", *(f"w{j}" for j in range(k))).alias("shingle")).distinct()
        of_items = part if of_items is None else of_items.unionByName(part)
    of_items = staged(of_items, "item-shingles")
    sized = of_items.groupBy("item_id", "width").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("h")).alias("hashes"))
    sized = sized.withColumn("need", F.expr(f"({num} * n + {den} - 1) div {den}"))
    sketch = staged(sized.select("item_id", "width", "n", "need", F.explode(F.slice("hashes", 1, F.greatest(F.expr("int(size(hashes) - need + 1)"), F.lit(1)))).alias("h")), "sketches")
    keys = staged(sketch.groupBy("width", "h").agg(F.min("need").alias("least")), "sketch-keys")
    n_keys, n_shingles = keys.count(), of_items.count()
    used = [r[0] for r in keys.select("width").distinct().collect()]  # at most width values
    if not used:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_item long, n_shared long")

    cut = docs.select(F.col(id_col).cast("long").alias("doc_id"), words(F.col(text_col)).alias("w")).withColumn("n_words", F.size("w"))
    probes = None
    for k in sorted(used):
        hits = shingles(cut, k, "doc_id", "n_words").select("doc_id", "n_words", "h")
        hits = hits.join(_small(keys.where(F.col("width") == k).drop("width"), n_keys), "h").where(F.col("n_words") - k + 1 >= F.col("least"))
        hits = hits.select("doc_id", "h", F.lit(k).alias("width")).distinct()
        probes = hits if probes is None else probes.unionByName(hits)
    # few of a document's shingles are in a sketch, so what is joined from here on is small
    pairs = staged(probes.join(_small(sketch, n_keys), ["width", "h"]).select("doc_id", "item_id", "width", "n", "need").distinct(), "pairs")
    n_pairs = pairs.count()
    wanted = _small(pairs.select(F.col("doc_id").alias("wanted_id")).distinct(), n_pairs)
    near = cut.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted_id")), "left_semi")
    exact = None
    for k in sorted(used):
        own = shingles(near, k, "doc_id").select("doc_id", "h", F.concat_ws(" ", *(f"w{j}" for j in range(k))).alias("shingle"))
        both = own.join(_small(of_items.where(F.col("width") == k).drop("width"), n_shingles), ["h", "shingle"]).select("doc_id", "item_id", "shingle").distinct()
        both = both.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
        exact = both if exact is None else exact.unionByName(both)
    named = pairs.select(F.col("doc_id").alias("d"), F.col("item_id").alias("i"), "n", "need")
    verified = exact.join(_small(named, n_pairs), F.col("doc_id").eqNullSafe(F.col("d")) & F.col("item_id").eqNullSafe(F.col("i")))
    return verified.where("n_shared >= need").select("doc_id", "item_id", F.col("n").cast("long").alias("n_item"), F.col("n_shared").cast("long").alias("n_shared"))
