"""Representations of a session at falling levels of detail."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import code as C
from tracewright.functions import text as X


def semantic_edits(events: DataFrame, names: str | None = None) -> DataFrame:
    """session_id, event_id, edit: operation->target[->size] of every event with a file. names: column of function names."""
    a, r = F.col("lines_added"), F.col("lines_removed")
    op = F.when(F.col("type").isin("file_change", "code_change", "entry_modified"), F.when((a > 0) & (r == 0), "ADD").when((r > 0) & (a == 0), "REMOVE").otherwise("MODIFY")).when(F.col("type").isin("entry_created", "file_created"), "CREATE").when(F.col("type").isin("entry_deleted", "file_deleted"), "DELETE").otherwise(F.col("type"))
    size = F.when((a > 50) | (r > 50), "LARGE").when((a > 10) | (r > 10), "MEDIUM")
    target = X.stem(F.col("file_path"))
    if names:
        target = F.when(F.size(names) > 0, F.concat_ws("::", target, F.col(names)[0])).otherwise(target)
    return events.select("session_id", "event_id", F.concat_ws("->", op, target, size).alias("edit"))


def edit_script(diffs: DataFrame) -> DataFrame:
    """diff_id, adds, removes, style: nodes (kind and line) of the code after a change that were not there before, and
    the reverse. diffs: diff_id, before_code, after_code."""
    def nodes(column: str) -> DataFrame:
        x = diffs.select("diff_id", F.posexplode(F.split(F.coalesce(column, F.lit("")), "\n")).alias("line", "code"))
        return x.select("diff_id", "line", X.line_kind(F.trim("code")).alias("kind")).where("kind IS NOT NULL").withColumn(column, F.lit(1))

    both = nodes("before_code").join(nodes("after_code"), ["diff_id", "line", "kind"], "full_outer")
    found = both.groupBy("diff_id").agg(F.count_if(F.col("before_code").isNull()).alias("adds"), F.count_if(F.col("after_code").isNull()).alias("removes"))
    full = diffs.select("diff_id").join(found, "diff_id", "left").na.fill(0, ["adds", "removes"])
    return full.withColumn("style", C.change_style(F.col("adds"), F.col("removes"), ((F.col("adds") == 0) & (F.col("removes") == 0)).cast("int")))


def call_graph(codes: DataFrame) -> DataFrame:
    """source, target, weight: calls of one function by another. A call's caller is the first function that begins at
    most ten lines above it. codes: code_id, code."""
    x = codes.select("code_id", F.posexplode(F.split("code", "\n")).alias("line", "text"))
    defined = x.select("code_id", "line", F.explode(C.function_names(F.col("text"))).alias("name"))
    called = x.where(~F.col("text").rlike(r"\b(def|function)\b")).select("code_id", F.col("line").alias("at"), F.explode(C.calls(F.col("text"))).alias("callee"))
    inside = called.join(defined, "code_id").where("at BETWEEN line AND line + 10")
    caller = inside.groupBy("code_id", "at", "callee").agg(F.min_by("name", "line").alias("source"))
    return caller.groupBy("source", F.col("callee").alias("target")).agg(F.count("*").alias("weight"))


def path_candidates(imports: DataFrame) -> DataFrame:
    """file_path, path, target, place: paths that an import may lead to, in the order in which they are tried. A path with
    a dot first is taken from the importing file's folder, others from the root. imports: file_path, path."""
    folder = X.dirname(F.col("file_path"))
    base = F.when(F.startswith(F.col("path"), F.lit(".")), C.normal_path(F.concat_ws("/", folder, "path"))).otherwise(F.col("path"))
    tries = F.array(*(F.concat(base, F.lit(e)) for e in ("", *C.RESOLVED_SUFFIXES)))
    return imports.select("file_path", "path").distinct().select("file_path", "path", F.posexplode(tries).alias("place", "target"))


def resolved_imports(imports: DataFrame, known: DataFrame) -> DataFrame:
    """file_path, path, target: the first candidate that is a known file; imports that lead to none are left out."""
    hits = path_candidates(imports).join(known.select(F.col("file_path").alias("target")).distinct(), "target", "left_semi")
    return hits.groupBy("file_path", "path").agg(F.min_by("target", "place").alias("target"))


def fallback_imports(imports: DataFrame, known: DataFrame) -> DataFrame:
    """As resolved_imports(), without the extension that a path has, packages beside the importing file's folder, and the
    path as it is where no file is found."""
    bare = imports.select("file_path", F.regexp_replace("path", r"\.(js|ts|jsx|tsx|py)$", "").alias("path")).distinct()
    up = F.when(F.startswith(F.col("path"), F.lit(".")), F.col("path")).otherwise(F.concat(F.lit("../"), "path"))
    placed = bare.withColumn("base", C.normal_path(F.concat_ws("/", X.dirname(F.col("file_path")), up)))
    tries = placed.select("file_path", "path", "base", F.posexplode(F.array(*(F.concat("base", F.lit(e)) for e in (".js", ".ts", ".jsx", ".tsx", ".py", ".json")))).alias("place", "target"))
    hits = tries.join(known.select(F.col("file_path").alias("target")).distinct(), "target", "left_semi").groupBy("file_path", "path").agg(F.min_by("target", "place").alias("target"))
    return placed.join(hits, ["file_path", "path"], "left").select("file_path", "path", F.coalesce("target", "base").alias("target"))


def import_edges(imports: DataFrame, known: DataFrame) -> DataFrame:
    """source, target: files and the known files that they import."""
    found = resolved_imports(imports, known).where("target <> file_path")
    return found.select(F.col("file_path").alias("source"), "target").distinct()


def syntax_diff(pairs: DataFrame, key: str, before: str, after: str) -> DataFrame:
    """key, operation, line, change (add, remove): nodes, by kind and line, that only one side has; a pair without any is
    one MODIFY_STATEMENT."""

    def nodes(column: str, side: str) -> DataFrame:
        x = pairs.select(key, F.posexplode(F.split(F.coalesce(column, F.lit("")), "\n")).alias("at", "code"))
        kind = X.line_kind(F.trim("code"))
        return x.select(key, (F.col("at") + 1).cast("long").alias("line"), kind.alias("kind"), F.lit(True).alias(side)).where("kind IS NOT NULL")

    both = nodes(before, "old").join(nodes(after, "new"), [key, "line", "kind"], "full_outer").where("old IS NULL OR new IS NULL")
    op, added = C.operation(F.col("kind")), F.col("old").isNull()
    ops = both.select(key, F.when(added, op).otherwise(F.replace(op, F.lit("ADD_"), F.lit("REMOVE_"))).alias("operation"), "line", F.when(added, "add").otherwise("remove").alias("change"))
    same = pairs.select(key).join(ops.select(key).distinct(), key, "left_anti")
    return ops.unionByName(same.select(key, F.lit("MODIFY_STATEMENT").alias("operation"), F.lit(1).cast("long").alias("line"), F.lit("modify").alias("change")))


def file_edits(events: DataFrame) -> DataFrame:
    """session_id, event_id, at (microseconds, 0 without a time), path of every event that names a file."""
    from tracewright.functions.time import micros

    return events.where("file_path IS NOT NULL").select("session_id", "event_id", F.coalesce(micros("ts"), F.lit(0)).alias("at"), F.col("file_path").alias("path"))


def abstracted(entries: DataFrame, level: int) -> DataFrame:
    """Entries for export at a level: 0 all; 1 code masked; 2 sizes instead of code; 3 file kinds instead of paths."""
    out = entries
    if level >= 1:
        out = out.withColumn("before_code", X.redact_code(F.col("before_code"))).withColumn("after_code", X.redact_code(F.col("after_code")))
    if level >= 2:
        out = out.withColumn("chars_before", F.length("before_code")).withColumn("chars_after", F.length("after_code")).drop("before_code", "after_code")
    if level >= 3:
        out = out.withColumn("file_type", X.file_type(F.col("file_path"))).drop("file_path", "session_id")
    return out


def first_stems(events: DataFrame) -> DataFrame:
    """session_id, rank, stem: modules in the order in which a session first touches them."""
    first = events.select("session_id", X.stem(F.col("file_path")).alias("stem"), "ts", "event_id").groupBy("session_id", "stem").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    return first.select("session_id", F.row_number().over(Window.partitionBy("session_id").orderBy("at")).alias("rank"), "stem")


def edit_pairs(edits: DataFrame, width: int = 300) -> DataFrame:
    """edits with target: for each the first later edit of another file in its session, if it comes within width seconds."""
    from tracewright.functions.time import micros

    w = Window.partitionBy("session_id").orderBy("ts", "event_id")
    # runs of one file: the first edit after a run is the next file's, whatever edit of the run asks
    run = edits.withColumn("new", (~F.col("file_path").eqNullSafe(F.lag("file_path").over(w))).cast("int")).withColumn("run", F.sum("new").over(w))
    heads = run.where("new = 1").select("session_id", (F.col("run") - 1).alias("run"), F.col("file_path").alias("target"), F.col("ts").alias("t_ts"))
    return run.join(heads, ["session_id", "run"]).where(micros("t_ts") - micros("ts") <= width * 1_000_000)


def file_edit_graph(edits: DataFrame, width: int = 300) -> DataFrame:
    """session_id, source, target, weight: how often edit_pairs() links two files."""
    return edit_pairs(edits, width).groupBy("session_id", F.col("file_path").alias("source"), "target").agg(F.count("*").alias("weight"))
