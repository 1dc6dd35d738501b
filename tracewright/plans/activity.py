"""Capture, listings, exports, taxonomies and bookkeeping as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import code as C
from tracewright.functions import events as E
from tracewright.functions import text as X
from tracewright.functions.time import micros
from tracewright.operators import encoders, graph, links, sessions, vectors
from tracewright.plans.registry import query
from tracewright.plans.representations import CODES, _codes, _scratch, _stream
from tracewright.plans.sequences import EDGES, GRAMS, SYMBOLS, _edges, _nodes
from tracewright.sources import files
from tracewright.sources.telemetry import Tables
from tracewright.streaming import stateful


@query("s01_parameterised_sql", "SELECT type, count(*) AS n FROM ev WHERE workspace_path = '/w/p2' GROUP BY type")
def parameterised_sql(t: Tables) -> DataFrame:
    return t.spark.sql("SELECT type, count(*) AS n FROM {ev} WHERE workspace_path = :w GROUP BY type", args={"w": "/w/p2"}, ev=t.ev)


@query("s05_json_document", "SELECT cast(doc_id AS bigint) AS doc_id, lang FROM documents")
def json_document(t: Tables) -> DataFrame:
    path = f"{_scratch(t)}.json"
    t.raw("documents").select("doc_id", "lang").write.json(path)
    return t.spark.read.schema("doc_id long, lang string").option("multiLine", False).json(path)


@query("s06_jsonl_rejects", "SELECT count(*) AS good, 2 AS bad FROM terminal")
def jsonl_rejects(t: Tables) -> DataFrame:
    from pyspark.sql import types as T

    path = f"{_scratch(t)}.jsonl"
    good = t.terminal.select(F.to_json(F.struct("command_id", "command")).alias("value"))
    good.unionByName(t.spark.createDataFrame([("not json",), ("{broken",)], "value string")).write.text(path)
    ok, bad = files.read_jsonl(t.spark, path, T.StructType([T.StructField("command_id", T.LongType()), T.StructField("command", T.StringType())]))
    return ok.agg(F.count("command_id").alias("good")).crossJoin(bad.agg(F.count("*").cast("int").alias("bad")))  # one row each


@query("s17_model_context", "SELECT DISTINCT context_a AS target, context_b AS context FROM prompts WHERE context_a <> context_b")
def model_context(t: Tables) -> DataFrame:
    kv = t.prompts.select(F.concat(F.lit("messageContext:"), F.col("prompt_id").cast("string")).alias("key"), F.to_json(F.array(F.struct(F.col("context_a").alias("target"), F.col("context_b").alias("context")))).alias("value"))
    return files.key_values(kv, "messageContext:%", "struct<target:string,context:string>").where("target <> context").dropDuplicates(["target", "context"]).select("target", "context")


@query("s18_tool_history", "SELECT session_id, count(*) AS n FROM terminal GROUP BY session_id")
def tool_history(t: Tables) -> DataFrame:
    kv = t.terminal.groupBy(F.col("session_id").alias("key")).agg(F.to_json(F.collect_list(F.struct("command"))).alias("value"))
    return files.key_values(kv, "s%", "struct<command:string>").groupBy(F.col("key").alias("session_id")).agg(F.count("*").alias("n"))


CHANGES = "SELECT file_path, ts, n, coalesce(lag(n) OVER (PARTITION BY file_path ORDER BY ts, entry_id), 0) AS before FROM (SELECT file_path, ts, entry_id, length(coalesce(after_code, '')) AS n FROM entries) x"


@query("s24_file_changes", f"SELECT file_path, count(*) AS changes, cast(sum(greatest(0, n - before)) AS bigint) AS added FROM ({CHANGES}) y WHERE abs(n - before) >= 10 GROUP BY file_path")
def file_changes(t: Tables) -> DataFrame:
    n = F.length(F.coalesce("after_code", F.lit("")))
    x = t.entries.select("file_path", "ts", "entry_id", n.alias("n")).withColumn("before", F.coalesce(F.lag("n").over(Window.partitionBy("file_path").orderBy("ts", "entry_id")), F.lit(0)))
    return x.where("abs(n - before) >= 10").groupBy("file_path").agg(F.count("*").alias("changes"), F.sum(F.greatest(F.lit(0), F.col("n") - F.col("before"))).alias("added"))


@query("s27_prompt_lines", "SELECT word, count(*) AS n FROM (SELECT split_part(command, ' ', 1) AS word FROM terminal) x GROUP BY word")
def prompt_lines(t: Tables) -> DataFrame:
    screen = t.terminal.select(F.concat(F.lit("user@host $ "), "command", F.lit("\noutput\n")).alias("screen"))
    found = screen.select(F.explode(F.regexp_extract_all("screen", F.lit(r"(?m)[$%]\s+(.+?)$"))).alias("command"))
    return found.groupBy(F.split("command", " ")[0].alias("word")).agg(F.count("*").alias("n"))


@query("s32_logged_changes", "SELECT entry_id, greatest(0, a - b) AS lines_added, greatest(0, b - a) AS lines_removed FROM (SELECT entry_id, len(string_split(coalesce(after_code, ''), chr(10))) AS a, len(string_split(coalesce(before_code, ''), chr(10))) AS b FROM entries) x")
def logged_changes(t: Tables) -> DataFrame:
    d = X.net_diff(F.col("before_code"), F.col("after_code"))
    return t.entries.select("entry_id", d["lines_added"].cast("long").alias("lines_added"), d["lines_removed"].cast("long").alias("lines_removed"))


@query("s37_samples_since", "SELECT event_id, ts FROM ev WHERE ts >= (SELECT max(ts) FROM ev) - INTERVAL 1 DAY ORDER BY ts DESC, event_id LIMIT 100")
def samples_since(t: Tables) -> DataFrame:
    last = t.ev.agg(F.max("ts").alias("m"))  # one row
    return t.ev.crossJoin(F.broadcast(last)).where("ts >= m - INTERVAL 1 DAY").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "ts")


@query("s38_historical_filters", "SELECT command_id FROM terminal WHERE command LIKE '%test%' AND workspace_path = '/w/p1' AND coalesce(exit_code, 0) = 0")
def historical_filters(t: Tables) -> DataFrame:
    return t.terminal.where("command LIKE '%test%' AND workspace_path = '/w/p1' AND coalesce(exit_code, 0) = 0").select("command_id")


@query("s39_bulk_import", "SELECT how, count(*) AS n FROM (SELECT CASE WHEN prompt_id % 2 = 0 THEN 'imported' ELSE 'kept' END AS how FROM prompts) x GROUP BY how")
def bulk_import(t: Tables) -> DataFrame:
    old = t.prompts.select("prompt_id", F.lit("kept").alias("how"))
    return links.upsert(old, old.where("prompt_id % 2 = 0").withColumn("how", F.lit("imported")), "prompt_id").groupBy("how").agg(F.count("*").alias("n"))


@query("s41_captured_prompts")
def captured_prompts(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.prompts.select("prompt_id", X.prompt_intent(text).alias("intent"), E.complexity(text).alias("complexity"), text.rlike("```").alias("has_code"), text.contains("?").alias("asks"))


@query("k05_sectioned_export", "SELECT 'entries' AS section, count(*) AS n FROM entries UNION ALL SELECT 'prompts', count(*) FROM prompts UNION ALL SELECT 'terminal', count(*) FROM terminal")
def sectioned_export(t: Tables) -> DataFrame:
    path = _scratch(t)
    out = None
    for name, df in (("entries", encoders.abstracted(t.entries, 2)), ("prompts", t.prompts.select("prompt_id", X.sanitize_prompt(F.col("text")).alias("text"))), ("terminal", t.terminal)):
        df.write.parquet(f"{path}/section={name}")
        part = t.spark.read.parquet(f"{path}/section={name}").agg(F.count("*").alias("n")).select(F.lit(name).alias("section"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("k06_limited_export", "SELECT entry_id, file_path FROM entries ORDER BY ts DESC, entry_id LIMIT 500")
def limited_export(t: Tables) -> DataFrame:
    return t.entries.orderBy(F.desc("ts"), "entry_id").limit(500).select("entry_id", "file_path")


@query("p03_prompts_in_range", "SELECT prompt_id FROM prompts WHERE ts BETWEEN (SELECT min(ts) FROM ev) AND (SELECT min(ts) FROM ev) + INTERVAL 5 DAY")
def prompts_in_range(t: Tables) -> DataFrame:
    first = t.ev.agg(F.min("ts").alias("m"))  # one row
    return t.prompts.crossJoin(F.broadcast(first)).where("ts BETWEEN m AND m + INTERVAL 5 DAY").select("prompt_id")


@query("p07_prompt_rows", "SELECT prompt_id AS promptId, mode_id = 1 AS isAuto, linked_entry_id AS linkedEntryId FROM prompts")
def prompt_rows(t: Tables) -> DataFrame:
    return t.prompts.select(F.col("prompt_id").alias("promptId"), (F.col("mode_id") == 1).alias("isAuto"), F.col("linked_entry_id").alias("linkedEntryId"))


@query("p11_audit_pages", "SELECT type AS operation, session_id AS user_id, event_id FROM ev WHERE type = 'entry_created' ORDER BY ts DESC, event_id LIMIT 40 OFFSET 40")
def audit_pages(t: Tables) -> DataFrame:
    return t.ev.where("type = 'entry_created'").orderBy(F.desc("ts"), "event_id").offset(40).limit(40).select(F.col("type").alias("operation"), F.col("session_id").alias("user_id"), "event_id")


@query("p13_date_range", "SELECT event_id FROM ev WHERE (ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-09') OR ts IS NULL")
def date_range(t: Tables) -> DataFrame:
    return t.ev.where("(ts >= TIMESTAMP_NTZ '2024-01-05' AND ts <= TIMESTAMP_NTZ '2024-01-09') OR ts IS NULL").select("event_id")


@query("p19_cursor_page", "SELECT event_id FROM ev WHERE event_id > 500")
def cursor_page(t: Tables) -> DataFrame:
    return t.ev.where("event_id > 500").select("event_id")


@query("p29_active_todos", "SELECT session_id, min(entry_id) AS todo_id FROM entries WHERE lines_added > 40 GROUP BY session_id")
def active_todos(t: Tables) -> DataFrame:
    todos = t.entries.select("session_id", F.col("entry_id").alias("todo_id"), F.when(F.col("lines_added") > 40, "in_progress").otherwise("pending").alias("status"))
    return todos.where("status = 'in_progress'").groupBy("session_id").agg(F.min("todo_id").alias("todo_id"))


@query("p30_schema")
def schema(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([("entries", f.name, f.dataType.simpleString(), f.nullable) for f in t.entries.schema.fields], "table_name string, column_name string, type string, nullable boolean")


@query("a11_token_stats", f"WITH {CODES} SELECT ext, count(*) AS n, cast(sum(w) AS bigint) AS words FROM (SELECT regexp_extract(file_path, '(\\.[a-z]+)$', 1) AS ext, len(regexp_extract_all(code, '\\b[a-zA-Z_][a-zA-Z0-9_]*\\b')) AS w FROM codes) x GROUP BY ext")
def token_stats(t: Tables) -> DataFrame:
    x = _codes(t).select(X.extension(F.col("file_path")).alias("ext"), F.size(F.regexp_extract_all("code", F.lit(r"(\b[a-zA-Z_][a-zA-Z0-9_]*\b)"))).alias("w"))
    return x.groupBy("ext").agg(F.count("*").alias("n"), F.sum("w").alias("words"))


@query("a17_edge_types", f"WITH {EDGES} SELECT type, count(*) AS n, cast(sum(weight) AS bigint) AS weight FROM edges GROUP BY type")
def edge_types(t: Tables) -> DataFrame:
    return _edges(t).groupBy("type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


@query("a21_linking_rate", "SELECT round(100.0 * count(prompt_id) / count(*), 2) AS linked_pct, count(DISTINCT session_id) AS sessions FROM entries")
def linking_rate(t: Tables) -> DataFrame:
    return t.entries.agg(F.round(100.0 * F.count("prompt_id") / F.count("*"), 2).alias("linked_pct"), F.countDistinct("session_id").alias("sessions"))


@query("a26_intent_agreement")
def intent_agreement(t: Tables) -> DataFrame:
    """Share of prompts whose best intent is among their labels, in kind."""
    x = t.prompts.select(X.intents(F.col("text")).alias("many"), X.prompt_intent(F.col("text")).alias("one"))
    pairs = F.create_map(*(F.lit(v) for kv in {"debugging": "INTENT_DEBUG", "testing": "INTENT_TEST", "refactoring": "INTENT_REFACTOR", "documentation": "INTENT_DOCUMENT", "code_implementation": "INTENT_FEATURE"}.items() for v in kv))
    return x.groupBy("one").agg(F.count("*").alias("n"), F.count_if(F.array_contains("many", F.coalesce(F.try_element_at(pairs, F.col("one")), F.lit("INTENT_OTHER")))).alias("agree"))


@query("a27_conversation_stats", "SELECT conv_id, count(*) AS message_count, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def conversation_stats(t: Tables) -> DataFrame:
    return t.raw("conversations").groupBy("conv_id").agg(F.count("*").alias("message_count"), F.max("turn").alias("last_turn"))


@query("a30_hierarchy_summary", "SELECT level, count(*) AS clusters, round(avg(n), 4) AS mean_size FROM (SELECT 0 AS level, label, count(*) AS n FROM embeddings GROUP BY label UNION ALL SELECT 1, label % 2, count(*) FROM embeddings GROUP BY label % 2) x GROUP BY level")
def hierarchy_summary(t: Tables) -> DataFrame:
    e = t.raw("embeddings")
    levels = [e.groupBy("label").agg(F.count("*").alias("n")).select(F.lit(0).alias("level"), "n"), e.groupBy((F.col("label") % 2).alias("label")).agg(F.count("*").alias("n")).select(F.lit(1).alias("level"), "n")]
    return levels[0].unionByName(levels[1]).groupBy("level").agg(F.count("*").alias("clusters"), F.round(F.avg("n"), 4).alias("mean_size"))


@query("u02_temporal_items", "SELECT kind, count(*) AS n FROM (SELECT 'entry' AS kind FROM entries UNION ALL SELECT 'prompt' FROM prompts UNION ALL SELECT 'terminal' FROM terminal) x GROUP BY kind")
def temporal_items(t: Tables) -> DataFrame:
    parts = [df.where("ts IS NOT NULL").select(F.lit(kind).alias("kind"), "ts") for kind, df in (("entry", t.entries), ("prompt", t.prompts), ("terminal", t.terminal))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count("*").alias("n"))


@query("w14_symbol_streams", f"WITH {SYMBOLS} SELECT session_id, count(*) AS n FROM (SELECT session_id FROM syms UNION ALL SELECT session_id FROM syms WHERE type = 'file_open') x GROUP BY session_id")
def symbol_streams(t: Tables) -> DataFrame:
    """Each event's intents right before its symbol, in one stream per session."""
    seq = sessions.symbols(t.ev)
    intent = t.ev.where("type = 'file_open'").select("event_id", F.lit("INTENT_NAVIGATE").alias("intent"))
    x = seq.join(intent, "event_id", "left").select("session_id", F.struct("seq", F.array_compact(F.array("intent", "symbol")).alias("tokens")).alias("s"))
    stream = F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["tokens"]))
    return x.groupBy("session_id").agg(F.size(stream).cast("long").alias("n"))


@query("o06_top_intents", "SELECT vec_id, dim FROM (SELECT vec_id, dim, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, dim) AS rn FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) x) y WHERE rn <= 3")
def top_intents(t: Tables) -> DataFrame:
    top = F.slice(F.array_sort(F.transform("embedding", lambda v, i: F.struct((-v).alias("v"), i.alias("dim")))), 1, 3)
    return t.raw("embeddings").select("vec_id", F.explode(top).alias("s")).select("vec_id", F.col("s.dim").cast("long").alias("dim"))


@query("o08_truncated_lists", "SELECT session_id, concat(array_to_string(list_slice(l, 1, 5), ' | '), CASE WHEN len(l) > 5 THEN concat(' ... (', len(l) - 5, ' more)') ELSE '' END) AS listing FROM (SELECT session_id, list(DISTINCT file_path ORDER BY file_path) AS l FROM ev GROUP BY session_id) x")
def truncated_lists(t: Tables) -> DataFrame:
    x = t.ev.groupBy("session_id").agg(F.array_sort(F.collect_set("file_path")).alias("l"))
    more = F.when(F.size("l") > 5, F.concat(F.lit(" ... ("), (F.size("l") - 5).cast("string"), F.lit(" more)"))).otherwise("")
    return x.select("session_id", F.concat(F.array_join(F.slice("l", 1, 5), " | "), more).alias("listing"))


@query("f13_content_keys", "SELECT count(DISTINCT md5(concat(file_path, lines_added))) AS n FROM entries")
def content_keys(t: Tables) -> DataFrame:
    return t.entries.agg(F.countDistinct(F.md5(F.concat("file_path", F.col("lines_added").cast("string")))).alias("n"))


@query("f44_model_families", "SELECT family, count(*) AS n FROM (SELECT CASE mode_id WHEN 0 THEN 'openai' WHEN 1 THEN 'google' WHEN 2 THEN 'open' ELSE 'unknown' END AS family FROM prompts) x GROUP BY family")
def model_families(t: Tables) -> DataFrame:
    names = F.array(F.lit("GPT-4o"), F.lit("gemini-pro"), F.lit("Mixtral"), F.lit("house"))
    return t.prompts.groupBy(C.model_family(names[F.col("mode_id").cast("int")]).alias("family")).agg(F.count("*").alias("n"))


@query("f49_conversation_titles", "SELECT conv_id, CASE WHEN length(text) > 50 THEN concat(substr(text, 1, 47), '...') ELSE text END AS title FROM conversations WHERE turn = 0")
def conversation_titles(t: Tables) -> DataFrame:
    text = F.col("text")
    return t.raw("conversations").where("turn = 0").select("conv_id", F.when(F.length(text) > 50, F.concat(F.substring(text, 1, 47), F.lit("..."))).otherwise(text).alias("title"))


@query("f55_change_styles", "SELECT style, count(*) AS n FROM (SELECT CASE WHEN lines_added > 0 AND lines_removed > 0 THEN 'mixed' WHEN lines_added > 0 THEN 'add' WHEN lines_removed > 0 THEN 'delete' ELSE 'modify' END AS style FROM entries) x GROUP BY style")
def change_styles(t: Tables) -> DataFrame:
    return t.entries.groupBy(C.change_style(F.col("lines_added"), F.col("lines_removed"), F.lit(0)).alias("style")).agg(F.count("*").alias("n"))


@query("f69_motif_categories", f"WITH {GRAMS} SELECT kind, count(*) AS n FROM (SELECT DISTINCT motif, CASE WHEN len(string_split(motif, '_EV')) > 3 THEN 'triple' ELSE 'pair' END AS kind FROM grams) x GROUP BY kind")
def motif_categories(t: Tables) -> DataFrame:
    seq = sessions.symbols(t.ev)
    w = Window.partitionBy("session_id").orderBy("seq")
    x = seq.select("symbol", F.lead("symbol").over(w).alias("b"), F.lead("symbol", 2).over(w).alias("c"))
    two = x.where("b IS NOT NULL").select(F.lit("pair").alias("kind"), F.concat_ws("_", "symbol", "b").alias("motif"))
    three = x.where("c IS NOT NULL").select(F.lit("triple").alias("kind"), F.concat_ws("_", "symbol", "b", "c").alias("motif"))
    return two.unionByName(three).distinct().groupBy("kind").agg(F.count("*").alias("n"))


@query("f76_edit_operations")
def edit_operations(t: Tables) -> DataFrame:
    nodes = _codes(t).select(F.explode(F.split("code", "\n")).alias("line")).select(X.line_kind(F.trim("line")).alias("kind")).where("kind IS NOT NULL")
    return nodes.groupBy(F.concat(F.lit("MODIFY_"), F.upper("kind")).alias("operation")).agg(F.count("*").alias("n"))


@query("f78_workspace_names", "SELECT DISTINCT workspace_path, split_part(workspace_path, '/', -1) AS name FROM ev")
def workspace_names(t: Tables) -> DataFrame:
    return t.ev.select("workspace_path", X.basename(F.col("workspace_path")).alias("name")).distinct()


@query("r01_raw_representation", "SELECT session_id, count(*) FILTER (WHERE type IN ('code_change', 'entry_created')) AS changes, count(*) FILTER (WHERE type = 'prompt') AS prompts FROM ev GROUP BY session_id")
def raw_representation(t: Tables) -> DataFrame:
    return t.ev.groupBy("session_id").agg(F.count_if(F.col("type").isin("code_change", "entry_created")).alias("changes"), F.count_if(F.col("type") == "prompt").alias("prompts"))


@query("r09_token_rows")
def token_rows(t: Tables) -> DataFrame:
    tokens = C.line_tokens(F.col("code"))
    x = _codes(t).select(F.col("code_id").alias("diff_id"), E.language(F.col("file_path")).alias("language"), tokens.alias("tokens"))
    count = lambda kind: F.size(F.filter("tokens", lambda v: v == kind))
    return x.select("diff_id", "language", F.size("tokens").alias("n_tokens"), count("IDENTIFIER").alias("identifiers"), count("STRING_LITERAL").alias("strings"), count("NUMBER").alias("numbers"), F.size(C.numbered(F.col("tokens"))).alias("canonical"))


@query("r11_function_changes", f"WITH {CODES} SELECT change, count(*) AS n FROM (SELECT CASE WHEN b = '' THEN 'added' WHEN b = a THEN 'unchanged' ELSE 'modified' END AS change FROM (SELECT regexp_extract(before_code, 'def\\s+(\\w+)', 1) AS b, regexp_extract(code, 'def\\s+(\\w+)', 1) AS a FROM codes) x) y GROUP BY change")
def function_changes(t: Tables) -> DataFrame:
    x = _codes(t).select("code_id", C.function_names(F.col("before_code")).alias("b"), C.function_names(F.col("code")).alias("a"))
    change = F.when(F.size("b") == 0, "added").when(F.array_contains("b", F.col("a")[0]), "unchanged").otherwise("modified")
    return x.groupBy(change.alias("change")).agg(F.count("*").alias("n"))


@query("m03_motif_registry", f"WITH {GRAMS} SELECT DISTINCT concat('M_', substr(sha1(motif), 1, 10)) AS motif, motif AS pattern FROM grams")
def motif_registry(t: Tables) -> DataFrame:
    seq = sessions.symbols(t.ev)
    w = Window.partitionBy("session_id").orderBy("seq")
    x = seq.select("symbol", F.lead("symbol").over(w).alias("b"), F.lead("symbol", 2).over(w).alias("c"))
    p = x.where("b IS NOT NULL").select(F.concat_ws("_", F.lit("SQ"), "symbol", "b").alias("pattern")).unionByName(x.where("c IS NOT NULL").select(F.concat_ws("_", F.lit("SQ"), "symbol", "b", "c").alias("pattern")))
    return p.select(F.concat(F.lit("M_"), F.substring(F.sha1("pattern"), 1, 10)).alias("motif"), "pattern").dropDuplicates(["motif"])


@query("g03_module_nodes", "SELECT id, kind, edits FROM (SELECT file_path AS id, 'file' AS kind, count(*) FILTER (WHERE type = 'code_change') AS edits FROM ev GROUP BY file_path UNION ALL SELECT regexp_replace(file_path, '/?[^/]*$', ''), 'directory', count(*) FILTER (WHERE type = 'code_change') FROM ev GROUP BY 1) x")
def module_nodes(t: Tables) -> DataFrame:
    edits = F.count_if(F.col("type") == "code_change").alias("edits")
    f = t.ev.groupBy(F.col("file_path").alias("id")).agg(edits).select("id", F.lit("file").alias("kind"), "edits")
    d = t.ev.groupBy(X.dirname(F.col("file_path")).alias("id")).agg(edits).select("id", F.lit("directory").alias("kind"), "edits")
    return f.unionByName(d)


@query("g18_query_language", f"WITH {EDGES} SELECT source, target, weight FROM edges WHERE weight >= 3")
def query_language(t: Tables) -> DataFrame:
    ask = {"find": "edges", "where": {"min_weight": 3}}
    found = {"edges": _edges, "nodes": _nodes}[ask["find"]](t)
    return found.where(F.col("weight") >= ask["where"]["min_weight"]).select("source", "target", "weight")


@query("g20_stored_call_graph")
def stored_call_graph(t: Tables) -> DataFrame:
    return encoders.call_graph(_codes(t).select("code_id", "code")).select("source", "target").distinct()


@query("v03_vectors")
def event_vectors(t: Tables) -> DataFrame:
    names = ["code_change", "entry_created", "file_open", "prompt", "terminal_command"]
    v = F.concat(vectors.one_hot(F.col("type"), names), F.array_repeat(F.lit(0.0), 768))
    return t.ev.select("event_id", F.size(v).alias("n"), (F.array_position(v, F.lit(1.0)) - 1).alias("hot"), F.aggregate(v, F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("v04_sequence_metadata", "SELECT session_id, count(*) AS length, min(ts) AS started, max(ts) AS ended, arg_min(workspace_path, (ts, event_id)) AS workspace FROM ev GROUP BY session_id")
def sequence_metadata(t: Tables) -> DataFrame:
    return t.ev.groupBy("session_id").agg(F.count("*").alias("length"), F.min("ts").alias("started"), F.max("ts").alias("ended"), F.min_by("workspace_path", F.struct("ts", "event_id")).alias("workspace"))


@query("v13_taxonomy", "SELECT label AS cluster_id, count(*) AS size FROM embeddings GROUP BY label")
def taxonomy(t: Tables) -> DataFrame:
    e = t.raw("embeddings")
    cents = vectors.centroids(e)
    return e.groupBy("label").agg(F.count("*").alias("size")).join(cents, "label").select(F.col("label").alias("cluster_id"), "size")


@query("v15_stored_taxonomy")
def stored_taxonomy(t: Tables) -> DataFrame:
    path = f"{_scratch(t)}.parquet"
    vectors.centroids(t.raw("embeddings")).write.parquet(path)
    return t.spark.read.parquet(path).select("label", F.posexplode("centroid").alias("dim", "m")).withColumn("m", F.round("m", 9))


@query("t03_stream_file_changes")
def stream_file_changes(t: Tables) -> DataFrame:
    x = _stream(t).select(F.col("workspace_path").alias("file_path"), "ts", F.repeat(F.lit("x"), (F.col("event_id") % 90).cast("int")).alias("content"))
    out = stateful.run_once(stateful.file_changes(x), f"changes_{uuid.uuid4().hex}", _scratch(t))
    return out.groupBy("file_path").agg(F.count("*").alias("changes"))


@query("t06_incremental_read", "SELECT count(*) AS n FROM events")
def incremental_read(t: Tables) -> DataFrame:
    """Two runs from one checkpoint: the second finds nothing new."""
    at = _scratch(t)
    names = [f"read_{uuid.uuid4().hex}" for _ in range(2)]
    for name in names:
        q = _stream(t).select("event_id").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination()
    return t.spark.read.parquet(f"{at}/out").agg(F.count("*").alias("n"))


@query("t10_bounded_buffer", "SELECT workspace_path, event_id FROM (SELECT workspace_path, event_id, row_number() OVER (PARTITION BY workspace_path ORDER BY ts DESC, event_id DESC) AS rn FROM ev) x WHERE rn <= 100")
def bounded_buffer(t: Tables) -> DataFrame:
    w = Window.partitionBy("workspace_path").orderBy(F.desc("ts"), F.desc("event_id"))
    return t.ev.select("workspace_path", "event_id", F.row_number().over(w).alias("rn")).where("rn <= 100").drop("rn")


@query("d03_snapshots_appended", "SELECT session_id, count(*) AS n FROM prompts GROUP BY session_id")
def snapshots_appended(t: Tables) -> DataFrame:
    path = f"{_scratch(t)}.parquet"
    for k in range(2):
        t.prompts.where(f"prompt_id % 2 = {k}").select("prompt_id", "session_id").write.mode("append").parquet(path)
    return t.spark.read.parquet(path).groupBy("session_id").agg(F.count("*").alias("n"))


@query("d04_conversation_upsert", "SELECT conv_id, min(turn) AS created_turn, max(turn) AS updated_turn FROM conversations GROUP BY conv_id")
def conversation_upsert(t: Tables) -> DataFrame:
    c = t.raw("conversations")
    old = c.where("turn < 2").groupBy("conv_id").agg(F.min("turn").alias("created_turn"), F.max("turn").alias("updated_turn"))
    new = c.where("turn >= 2").groupBy("conv_id").agg(F.min("turn").alias("new_turn"), F.max("turn").alias("updated_turn"))
    both = new.withColumnRenamed("updated_turn", "later").join(old, "conv_id", "full_outer")
    return both.select("conv_id", F.coalesce("created_turn", "new_turn").alias("created_turn"), F.coalesce("later", "updated_turn").alias("updated_turn"))


@query("d13_historical_upsert", "SELECT command, max(command_id) AS last_id FROM terminal GROUP BY command")
def historical_upsert(t: Tables) -> DataFrame:
    return links.last_write(t.terminal.select("command", F.col("command_id").alias("last_id")), "command", "last_id")


@query("j08_latest_pending", "SELECT entry_id, prompt_id FROM (SELECT e.entry_id, p.prompt_id, row_number() OVER (PARTITION BY e.entry_id ORDER BY p.ts DESC, p.prompt_id DESC) AS rn FROM entries e JOIN prompts p ON p.workspace_path = e.workspace_path AND p.ts <= e.ts AND epoch_us(e.ts) - epoch_us(p.ts) <= 1800000000) x WHERE rn = 1")
def latest_pending(t: Tables) -> DataFrame:
    e = t.entries.select("entry_id", F.col("ts").alias("e_ts"), F.col("workspace_path").alias("e_ws"))
    p = t.prompts.select("prompt_id", F.col("ts").alias("p_ts"), F.col("workspace_path").alias("p_ws"))
    near = links.band_join(e, p, "e_ts", "p_ts", 1800, ("e_ws", "p_ws")).where(micros("p_ts") <= micros("e_ts"))
    return near.groupBy("entry_id").agg(F.max_by("prompt_id", F.struct("p_ts", "prompt_id")).alias("prompt_id"))


@query("j16_node_diff", "SELECT coalesce(b.id, a.id) AS id, CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' WHEN a.v = b.v THEN 'unchanged' ELSE 'modified' END AS change FROM (SELECT file_path AS id, count(*) AS v FROM ev WHERE event_id % 2 = 0 GROUP BY 1) b FULL JOIN (SELECT file_path AS id, count(*) AS v FROM ev WHERE event_id % 2 = 1 GROUP BY 1) a ON a.id = b.id")
def node_diff(t: Tables) -> DataFrame:
    halves = [t.ev.where(f"event_id % 2 = {k}").groupBy(F.col("file_path").alias("id")).agg(F.count("*").alias("v")) for k in (0, 1)]
    return links.change_sets(halves[0], halves[1], "id", "v")


@query("g21_centrality_table", f"WITH {EDGES}, d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) x GROUP BY id) SELECT count(*) FILTER (WHERE degree IS NULL) AS isolated, max(degree) AS largest FROM (SELECT DISTINCT file_path AS id FROM ev) n LEFT JOIN d ON n.id = d.id")
def centrality_table(t: Tables) -> DataFrame:
    return graph.degrees(_nodes(t), _edges(t)).agg(F.count_if(F.col("degree") == 0).alias("isolated"), F.max("degree").alias("largest"))
