"""Joins that link prompts, edits, events and their contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.time import micros


def band_join(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, width: int, by: tuple[str, str] | None = None) -> DataFrame:
    """Inner join of rows at most width seconds apart. Rows meet by buckets of that width: each right row goes to three,
    so the join is an equi-join with a residual filter and never a nested loop. by: columns that must be equal, too."""
    bucket = lambda c: F.floor(micros(c) / (width * 1_000_000)).cast("long")
    near = right.withColumn("_slot", F.explode(F.array(*(bucket(F.col(right_ts)) + d for d in (-1, 0, 1)))))
    on = [bucket(F.col(left_ts)) == F.col("_slot"), F.abs(micros(left_ts) - micros(right_ts)) <= width * 1_000_000]
    if by:
        on.append(F.col(by[0]) == F.col(by[1]))
    return left.join(near, on).drop("_slot")


def entries_near_prompts(prompts: DataFrame, entries: DataFrame, width: int = 300) -> DataFrame:
    """prompt_id, file_path: files of changed entries that name the prompt or lie within width seconds of it."""
    p = prompts.select(F.col("prompt_id").alias("p_id"), F.col("ts").alias("p_ts"))
    e = entries.where("file_path IS NOT NULL AND (before_code IS NULL OR before_code <> after_code)").select("prompt_id", "file_path", F.col("ts").alias("e_ts"))
    keyed = p.join(e, F.col("p_id") == F.col("prompt_id")).select("p_id", "file_path")
    return keyed.unionByName(band_join(p, e, "p_ts", "e_ts", width).select("p_id", "file_path")).distinct().select(F.col("p_id").alias("prompt_id"), "file_path")


def linked_pairs(prompts: DataFrame, entries: DataFrame) -> DataFrame:
    """prompt_id, entry_id, link_type: pairs named by either side; what the entry names wins."""
    p = prompts.select(F.col("prompt_id").alias("pid"), "linked_entry_id")
    e = entries.select("entry_id", "prompt_id")
    forward = e.join(p, F.col("prompt_id") == F.col("pid")).select(F.col("pid").alias("prompt_id"), "entry_id", F.lit("entry_to_prompt").alias("link_type"))
    back = p.join(e.select("entry_id"), F.col("linked_entry_id") == F.col("entry_id")).select(F.col("pid").alias("prompt_id"), "entry_id", F.lit("prompt_to_entry").alias("link_type"))
    return forward.unionByName(back).groupBy("prompt_id", "entry_id").agg(F.min("link_type").alias("link_type"))


def latest_before(entries: DataFrame, prompts: DataFrame, width: int = 300) -> DataFrame:
    """entry_id, prompt_id: the latest prompt in the width seconds up to each entry (as-of join, prompts may serve twice)."""
    e, p = entries.select("entry_id", F.col("ts").alias("e_ts")), prompts.select("prompt_id", F.col("ts").alias("p_ts"))
    near = band_join(e, p, "e_ts", "p_ts", width).where("p_ts <= e_ts")
    return near.groupBy("entry_id").agg(F.max_by("prompt_id", F.struct("p_ts", "prompt_id")).alias("prompt_id"))


def nearest(prompts: DataFrame, entries: DataFrame, width: int = 300) -> DataFrame:
    """prompt_id, entry_id: the entry nearest in time in the same workspace, among those that name no prompt."""
    p = prompts.select("prompt_id", F.col("ts").alias("p_ts"), F.col("workspace_path").alias("p_ws"))
    e = entries.where("prompt_id IS NULL").select("entry_id", F.col("ts").alias("e_ts"), F.col("workspace_path").alias("e_ws"))
    near = band_join(p, e, "p_ts", "e_ts", width, ("p_ws", "e_ws"))
    return near.groupBy("prompt_id").agg(F.min_by("entry_id", F.struct(F.abs(micros("p_ts") - micros("e_ts")), "entry_id")).alias("entry_id"))


def claim_once(entries: DataFrame, prompts: DataFrame, width: int = 300, by: str | None = None) -> DataFrame:
    """As latest_before, but each prompt serves one entry: a fold in time order, over all rows or within each value of by.

    A prompt waits for width seconds, so rows before and after a longer pause have nothing to do with each other: each
    stretch between such pauses is a fold of its own."""
    from tracewright.operators.sessions import temporal_chunks

    own = F.col(by) if by else F.lit("")
    both = entries.select(own.alias("scope"), "ts", F.col("entry_id").alias("id"), F.lit(1).alias("kind")).unionByName(prompts.select(own.alias("scope"), "ts", F.col("prompt_id").alias("id"), F.lit(0).alias("kind")))

    def fold(rows):
        import pandas as pd

        pending, out = [], []
        for r in rows.sort_values(["ts", "kind", "id"]).itertuples():
            if r.kind == 0:
                pending.append((r.ts, r.id))
            else:
                pending = [x for x in pending if (r.ts - x[0]).total_seconds() <= width]
                if pending:
                    out.append((r.id, pending.pop()[1]))
        return pd.DataFrame(out, columns=["entry_id", "prompt_id"]).astype("int64")

    return temporal_chunks(both, width).groupBy("scope", "chunk_id").applyInPandas(fold, "entry_id long, prompt_id long")


def upsert(old: DataFrame, new: DataFrame, key: str, how: str = "overwrite") -> DataFrame:
    """Import of new rows: skip keeps old ones, overwrite replaces them, merge fills new nulls from old, append keeps both."""
    if how == "append":
        return old.unionByName(new, allowMissingColumns=True)
    if how == "skip":
        return old.unionByName(new.join(old.select(key), key, "left_anti"), allowMissingColumns=True)
    if how == "overwrite":
        return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)
    if how != "merge":
        raise ValueError(how)
    names = list(dict.fromkeys([*new.columns, *old.columns]))
    n, o = new.select(*(F.col(c).alias(f"n_{c}") for c in new.columns)), old.select(*(F.col(c).alias(f"o_{c}") for c in old.columns))
    both = n.join(o, F.col(f"n_{key}") == F.col(f"o_{key}"), "full_outer")
    side = {"n": set(new.columns), "o": set(old.columns)}
    return both.select(*(F.coalesce(*(F.col(f"{s}_{c}") for s in "no" if c in side[s])).alias(c) for c in names))


def last_write(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Insert or replace by key: the last row of each, by an order column."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def change_sets(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, change (added, removed, modified, unchanged): full outer comparison, null-safe."""
    b, a = before.select(F.col(key).alias("b_key"), F.col(value).alias("b")), after.select(F.col(key).alias("a_key"), F.col(value).alias("a"))
    both = b.join(a, F.col("b_key") == F.col("a_key"), "full_outer")
    change = F.when(F.col("b_key").isNull(), F.lit("added")).when(F.col("a_key").isNull(), F.lit("removed")).when(F.col("a").eqNullSafe(F.col("b")), F.lit("unchanged")).otherwise(F.lit("modified"))
    return both.select(F.coalesce("b_key", "a_key").alias(key), change.alias("change"))


def filtered(rows: DataFrame, equal: dict[str, str | None] | None = None, since: str | None = None, until: str | None = None, ts: str = "ts") -> DataFrame:
    """Rows whose columns equal what is asked (None: anything) and whose time lies in the closed range asked."""
    for column, value in (equal or {}).items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    kind = dict(rows.dtypes).get(ts, "timestamp")
    for bound, below in ((since, False), (until, True)):
        if bound is not None:
            at = F.lit(bound).cast(kind)
            rows = rows.where(F.col(ts) <= at if below else F.col(ts) >= at)
    return rows
