"""Streaming twins of the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def session_chunks(stream: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """workspace_path, started, last_event, n: sessions of each workspace, closed once the watermark has passed."""
    x = stream.withWatermark("ts", late).groupBy("workspace_path", F.session_window("ts", gap).alias("w"))
    return x.agg(F.min("ts").alias("started"), F.max("ts").alias("last_event"), F.count("*").alias("n")).drop("w")


def unseen(stream: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Rows whose keys did not come before, within the watermark: what a bounded set of seen commands does."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def file_changes(stream: DataFrame, threshold: int = 10) -> DataFrame:
    """file_path, ts, chars_added, chars_deleted of each significant change against the file's previous content, which is
    kept in state per file."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        import pandas as pd

        (length,) = state.get if state.exists else (None,)
        out = []
        for rows in batches:
            for r in rows.sort_values("ts").itertuples():
                n = len(r.content or "")
                if length is not None and abs(n - length) >= threshold:
                    out.append((key[0], r.ts, max(0, n - length), max(0, length - n)))
                length = n
        state.update((length or 0,))
        yield pd.DataFrame(out, columns=["file_path", "ts", "chars_added", "chars_deleted"])

    return stream.groupBy("file_path").applyInPandasWithState(step, "file_path string, ts timestamp, chars_added long, chars_deleted long", "length long", "append", GroupStateTimeout.NoTimeout)


def prompt_edit_pairs(prompts: DataFrame, edits: DataFrame, within: str = "5 minutes") -> DataFrame:
    """prompt_id, entry_id: edits in a workspace within the interval after a prompt (interval join with watermarks). Both
    meet in buckets of the interval's width, an edit in its own and the one before: a row is compared with those near it,
    not with all of its workspace. Spark takes rows from before 1970 as late."""
    width = f"greatest(unix_micros(timestamp_micros(0) + INTERVAL {within}), 1L)"
    p = prompts.select("prompt_id", F.col("ts").alias("p_ts"), F.col("workspace_path").alias("p_ws")).withWatermark("p_ts", "10 minutes")
    e = edits.select("entry_id", F.col("ts").alias("e_ts"), F.col("workspace_path").alias("e_ws")).withWatermark("e_ts", "10 minutes")
    p = p.withColumn("p_bucket", F.expr(f"unix_micros(p_ts) div {width}"))
    own = f"unix_micros(e_ts) div {width}"
    e = e.withColumn("e_bucket", F.explode(F.expr(f"array({own}, {own} - 1)")))
    return p.join(e, F.expr(f"p_ws = e_ws AND p_bucket = e_bucket AND e_ts >= p_ts AND e_ts <= p_ts + INTERVAL {within}")).select("prompt_id", "entry_id")


def pending_prompts(stream: DataFrame, most: int = 10) -> DataFrame:
    """workspace_path, entry_id, prompt_id: each edit takes the newest prompt that waits in its workspace; of those that
    wait the last most are kept in state. stream: event_id, ts, workspace_path, event_type (purchase: a prompt, click: an
    edit); others pass by. Rows of one batch are taken in the order of time."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        import pandas as pd

        waiting = list(state.get[0]) if state.exists else []
        rows, out = pd.concat(list(batches)), []
        for r in rows.sort_values(["ts", "event_id"]).itertuples():
            if r.event_type == "purchase":
                waiting = [*waiting, r.event_id][-most:]
            elif waiting:
                out.append((key[0], r.event_id, waiting.pop()))
        state.update((waiting,))
        yield pd.DataFrame(out, columns=["workspace_path", "entry_id", "prompt_id"])

    both = stream.where("event_type IN ('purchase', 'click')").select("event_id", "ts", "workspace_path", "event_type")
    return both.groupBy("workspace_path").applyInPandasWithState(step, "workspace_path string, entry_id long, prompt_id long", "waiting array<long>", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """What a stream yields over all that is there now, as a table in memory (for tests and small results)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def run_to(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """What a stream yields over all that is there now, as files under path, which executors write: for results of any size."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
