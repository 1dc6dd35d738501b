"""Sessions, sequences and motifs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.text import canonical_symbol
from tracewright.functions.time import micros


def temporal_chunks(items: DataFrame, gap_seconds: int = 300, ts: str = "ts", id_col: str = "id") -> DataFrame:
    """items with chunk_id: a new chunk begins after a gap of more than gap_seconds in the time order of all items.

    There is no key to partition by, so each day is chunked on its own and days are stitched: what a day needs from
    those before it (the last time, the number of chunks) comes from one row per day.
    """
    by_day = items.withColumn("_day", F.to_date(ts))
    order = Window.partitionBy("_day").orderBy(ts, id_col)
    gap = micros(ts) - micros(F.lag(ts).over(order))
    marked = by_day.withColumn("_new", F.coalesce((gap > gap_seconds * 1_000_000).cast("long"), F.lit(0).cast("long")))
    days = marked.groupBy("_day").agg(F.min(ts).alias("_from"), F.max(ts).alias("_to"), F.sum("_new").alias("_n"))
    along = Window.orderBy("_day")  # one row per day
    start = F.coalesce(((micros("_from") - micros(F.lag("_to").over(along))) > gap_seconds * 1_000_000).cast("long"), F.lit(1).cast("long"))
    days = days.withColumn("_start", start)
    days = days.select("_day", (F.sum(F.col("_start") + F.col("_n")).over(along) - F.col("_n")).alias("_base"))
    return marked.join(days, "_day").withColumn("chunk_id", F.col("_base") + F.sum("_new").over(order)).drop("_day", "_new", "_base")


def chunk_summary(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("chunk_id").agg(
        F.count("*").alias("n_items"),
        F.count_if(F.col("type") == "prompt").alias("n_prompts"),
        F.count_if(F.col("type") == "code_change").alias("n_edits"),
        F.sum("lines_added").alias("lines_added"),
        F.countDistinct("workspace_path").alias("n_workspaces"),
        F.countDistinct("file_path").alias("n_files"),
        F.round((micros(F.max("ts")) - micros(F.min("ts"))) / 1e6).cast("long").alias("duration_s"),
    )


def symbols(events: DataFrame) -> DataFrame:
    """session_id, seq, symbol in time order; a null session is 'default'."""
    order = Window.partitionBy("session_id").orderBy("ts", "event_id")
    named = events.withColumn("session_id", F.coalesce("session_id", F.lit("default")))
    return named.select("session_id", "event_id", F.row_number().over(order).alias("seq"), canonical_symbol(F.col("type")).alias("symbol"))


def _ahead(column: str, n: int) -> Column:
    return F.lead(column, n).over(Window.partitionBy("session_id").orderBy("seq"))


def transitions(seq: DataFrame, most: int = 100) -> DataFrame:
    """The first transitions T_a_b of each session."""
    moved = seq.withColumn("b", _ahead("symbol", 1)).where(f"b IS NOT NULL AND seq <= {most}")
    return moved.select("session_id", "seq", F.concat_ws("_", F.lit("T"), "symbol", "b").alias("motif"))


def cycles(seq: DataFrame) -> DataFrame:
    """CYCLE a b a, at each place."""
    x = seq.withColumn("b", _ahead("symbol", 1)).withColumn("c", _ahead("symbol", 2))
    return x.where("symbol = c AND symbol <> b").select("session_id", "seq", F.concat_ws("_", F.lit("CYCLE"), "symbol", "b").alias("motif"))


def hot(seq: DataFrame, least: int = 5) -> DataFrame:
    return seq.groupBy("session_id", "symbol").agg(F.count("*").alias("n")).where(f"n >= {least}").select("session_id", F.concat_ws("_", F.lit("HOT"), "symbol", "n").alias("motif"))


def switching(seq: DataFrame, above: float = 0.7) -> DataFrame:
    """HIGH_SWITCHING: sessions of two symbols or more whose distinct share is above the bar."""
    x = seq.groupBy("session_id").agg(F.count("*").alias("n"), F.countDistinct("symbol").alias("d")).where(f"n >= 2 AND d > {above} * n")
    return x.select("session_id", F.lit("HIGH_SWITCHING").alias("motif"))


def repeated_grams(seq: DataFrame) -> DataFrame:
    """Pairs and triples that occur twice or more in a session, with how often and where first."""
    x = seq.withColumn("b", _ahead("symbol", 1)).withColumn("c", _ahead("symbol", 2))
    two = x.where("b IS NOT NULL").select("session_id", "seq", F.concat_ws("_", F.lit("SQ"), "symbol", "b").alias("motif"))
    three = x.where("c IS NOT NULL").select("session_id", "seq", F.concat_ws("_", F.lit("SQ"), "symbol", "b", "c").alias("motif"))
    return two.unionByName(three).groupBy("session_id", "motif").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).where("n >= 2")


def motif_hash(pattern: Column) -> Column:
    return F.concat(F.lit("M_"), F.substring(F.sha1(pattern), 1, 10))


def motif_ids(motifs: DataFrame, cap: int = 300) -> DataFrame:
    """session_id, rank, motif id, pattern: each pattern once in order of place, at most cap a session."""
    first = motifs.groupBy("session_id", "pattern").agg(F.min("place").alias("place"))
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy("place", "pattern"))
    return first.withColumn("rank", rank).where(f"rank <= {cap}").select("session_id", "rank", motif_hash(F.col("pattern")).alias("motif"), "pattern")


def adjacent_edges(events: DataFrame, limit_seconds: int = 300, inclusive: bool = True) -> DataFrame:
    """source, target, weight: files of edits next to each other in a workspace's time order, at most the limit apart."""
    order = Window.partitionBy("workspace_path").orderBy("ts", "event_id")
    x = events.select("file_path", F.lead("file_path").over(order).alias("target"), (micros(F.lead("ts").over(order)) - micros("ts")).alias("gap"))
    near = F.col("gap") <= limit_seconds * 1_000_000 if inclusive else F.col("gap") < limit_seconds * 1_000_000
    return x.where((F.col("target") != F.col("file_path")) & near).groupBy(F.col("file_path").alias("source"), "target").agg(F.count("*").alias("weight"))


def sequences(seq: DataFrame, least: int = 3, most: int = 50) -> DataFrame:
    """session_id, length, symbols joined by a space, of sessions within the bounds."""
    x = seq.groupBy("session_id").agg(F.count("*").alias("length"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "symbol"))), lambda s: s["symbol"]), " ").alias("symbols"))
    return x.where(F.col("length").between(least, most))


# How specific an intent is; of two the more specific one names the group.
SPECIFICITY = {"general": 0, "testing": 1, "optimization": 2, "refactor": 3, "bug-fix": 4, "feature": 4, "experiment": 5}


def state_groups(events: DataFrame, gap_seconds: int = 1800, least: int = 3, overlap: float = 0.3) -> DataFrame:
    """session_id, state, n_events, intent, started, ended, files: a fold in time order. A group of least events or more
    ends before an event after a longer gap, of another intent than the group's, of another workspace, or whose file makes
    up less than overlap of the group's files or is not among them; a last group of fewer events is no state.
    events: session_id, event_id, ts, workspace_path, file_path, intent."""

    def fold(rows):
        import pandas as pd

        states, group, files, intent, last = [], [], set(), None, None
        for r in rows.sort_values(["ts", "event_id"]).itertuples():
            own = {r.file_path} if isinstance(r.file_path, str) else set()
            ends = last is not None and (r.ts - last.ts).total_seconds() > gap_seconds
            ends = ends or bool(intent and r.intent and intent != r.intent)
            ends = ends or bool(files and own and len(files & own) < overlap * max(len(files), len(own)))
            ends = ends or (last is not None and r.workspace_path != last.workspace_path)
            if ends and len(group) >= least:
                states.append((group, intent, files))
                group, files, intent = [r], set(own), r.intent
            else:
                group.append(r)
                files |= own
                if r.intent and (not intent or SPECIFICITY.get(r.intent, 0) > SPECIFICITY.get(intent, 0)):
                    intent = r.intent
            last = r
        if len(group) >= least:
            states.append((group, intent, files))
        out = [(g[0].session_id, k, len(g), i, g[0].ts, g[-1].ts, sorted(f)) for k, (g, i, f) in enumerate(states)]
        return pd.DataFrame(out, columns=["session_id", "state", "n_events", "intent", "started", "ended", "files"])

    kind = dict(events.dtypes)["ts"]
    columns = events.select("session_id", "event_id", "ts", "workspace_path", "file_path", "intent")
    return columns.groupBy("session_id").applyInPandas(fold, f"session_id string, state int, n_events int, intent string, started {kind}, ended {kind}, files array<string>")


def state_boundaries(events: DataFrame, gap_seconds: int = 1800, least: int = 3, overlap: float = 0.3) -> DataFrame:
    """session_id, state, n_events of state_groups()."""
    return state_groups(events, gap_seconds, least, overlap).select("session_id", "state", "n_events")


def motif_representation(events: DataFrame) -> DataFrame:
    """session_id, motif: the hashes of repeated pairs and triples of symbols, and HOTSPOT_n of a file with more than five
    events, each once."""
    grams = repeated_grams(symbols(events))
    mined = motif_ids(grams.select("session_id", F.col("motif").alias("pattern"), F.col("first_seq").alias("place"))).select("session_id", "motif")
    most = events.groupBy("session_id", "file_path").agg(F.count("*").alias("n")).groupBy("session_id").agg(F.max("n").alias("n")).where("n > 5")
    return mined.unionByName(most.select("session_id", F.concat(F.lit("HOTSPOT_"), F.col("n").cast("string")).alias("motif"))).distinct()
