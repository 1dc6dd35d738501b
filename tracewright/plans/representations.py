"""Code tokens, representations, vectors, sources, sinks, maintenance and streaming as queries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions import code as C
from tracewright.functions import text as X
from tracewright.operators import encoders, links, sessions, vectors
from tracewright.plans.registry import query
from tracewright.plans.sequences import SYMBOLS
from tracewright.sources import files
from tracewright.sources.telemetry import Tables
from tracewright.streaming import stateful

CODE = """SELECT event_id AS code_id, session_id, file_path, ts, k,
  concat('import m', cast(k % 10 AS string), '/f', cast(k % 100 AS string), chr(10), 'def f', cast(k % 13 AS string), '(a, b):', chr(10), '  x = g', cast(k % 5 AS string), '(a)', chr(10), '  if (x == ', cast(k AS string), '):', chr(10), '    return f', cast(k % 3 AS string), '(x)') AS code,
  concat('import m', cast(k % 10 AS string), '/f', cast(k % 100 AS string), chr(10), 'def f', cast(k % 13 AS string), '(a):', chr(10), '  y = 1', chr(10), CASE WHEN k % 2 = 0 THEN '  for z in a:' ELSE '' END) AS before_code
FROM {ev} ev WHERE type = 'code_change'"""
CODES = f"codes AS ({CODE.replace('{ev}', 'ev')})"


def _codes(t: Tables) -> DataFrame:
    return t.spark.sql(CODE, ev=t.ev)


@query("f14_function_names", f"WITH {CODES} SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(code, 'def\\s+(\\w+)', 1)) AS name FROM codes) x GROUP BY name")
def function_names(t: Tables) -> DataFrame:
    return _codes(t).select(F.explode(C.function_names(F.col("code"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("f15_python_names", f"WITH {CODES} SELECT code_id, array_to_string(regexp_extract_all(code, 'def\\s+(\\w+)', 1), ',') AS names FROM (SELECT code_id, substr(code, position('def' IN code)) AS code FROM codes) x")
def python_names(t: Tables) -> DataFrame:
    return _codes(t).select("code_id", F.array_join(C.python_names(F.expr("substr(code, locate('def', code))")), ",").alias("names"))


@query("f19_generic_tokens")
def generic_tokens(t: Tables) -> DataFrame:
    return _codes(t).select(F.explode(C.generic_tokens(F.col("code"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("f20_line_tokens")
def line_tokens(t: Tables) -> DataFrame:
    return _codes(t).select(F.explode(C.line_tokens(F.col("code"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("f22_numbered_tokens")
def numbered_tokens(t: Tables) -> DataFrame:
    return _codes(t).select("code_id", F.array_join(C.numbered(C.line_tokens(F.col("code"))), " ").alias("tokens"))


@query("f25_imports", f"WITH {CODES} SELECT path, count(*) AS n FROM (SELECT unnest(regexp_extract_all(code, 'import\\s+([^\\s;]+)', 1)) AS path FROM codes) x GROUP BY path")
def imports(t: Tables) -> DataFrame:
    return _codes(t).select(F.explode(C.imports(F.col("code"))).alias("path")).groupBy("path").agg(F.count("*").alias("n"))


@query("f58_calls", f"WITH {CODES} SELECT name, count(*) AS n FROM (SELECT unnest(regexp_extract_all(code, '(\\w+)\\s*\\(', 1)) AS name FROM codes) x WHERE name <> 'if' GROUP BY name")
def calls(t: Tables) -> DataFrame:
    return _codes(t).select(F.explode(C.calls(F.col("code"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


@query("f61_line_changes")
def line_changes(t: Tables) -> DataFrame:
    return _codes(t).select("code_id", F.explode(C.line_changes("before_code", "code")).alias("c")).groupBy("code_id", "c.kind").agg(F.count("*").alias("n"))


@query("f65_operation_counts")
def operation_counts(t: Tables) -> DataFrame:
    return _codes(t).select("code_id", C.operation_count(F.expr("substr(code, locate('def', code))")).alias("n_operations"))


@query("f63_token_estimates", "SELECT doc_id, cast(ceil((len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')) * 1.3::double + length(text) / 4) / 2) AS bigint) AS estimate FROM documents")
def token_estimates(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", X.token_estimate(F.col("text")).cast("long").alias("estimate"))


@query("j24_call_graph", f"""WITH {CODES}, ln AS (SELECT code_id, unnest(string_split(code, chr(10))) AS text, generate_subscripts(string_split(code, chr(10)), 1) - 1 AS line FROM codes),
  d AS (SELECT code_id, line, regexp_extract(text, 'def\\s+(\\w+)', 1) AS name FROM ln WHERE regexp_matches(text, 'def\\s+(\\w+)')), c AS (SELECT code_id, line AS place, unnest(regexp_extract_all(text, '(\\w+)\\s*\\(', 1)) AS callee FROM ln WHERE NOT regexp_matches(text, '\\bdef\\b'))
  SELECT name AS source, callee AS target, count(*) AS weight FROM c JOIN d ON c.code_id = d.code_id AND place BETWEEN line AND line + 10 WHERE callee <> 'if' GROUP BY 1, 2""")
def call_graph(t: Tables) -> DataFrame:
    return encoders.call_graph(_codes(t).select("code_id", "code"))


@query("j20_tool_edges", r"SELECT path AS source, concat('TOOL_', word) AS target, count(*) AS weight FROM (SELECT split_part(command, ' ', 1) AS word, unnest(list_distinct(regexp_extract_all(command, '([\w./-]+\.[A-Za-z]{1,5})\b', 1))) AS path FROM terminal) x GROUP BY 1, 2")
def tool_edges(t: Tables) -> DataFrame:
    x = t.terminal.select(F.split("command", " ")[0].alias("word"), F.explode(X.paths_in(F.col("command"))).alias("path"))
    return x.groupBy(F.col("path").alias("source"), F.concat(F.lit("TOOL_"), "word").alias("target")).agg(F.count("*").alias("weight"))


OP = "CASE WHEN type = 'code_change' THEN CASE WHEN lines_added > 0 AND lines_removed = 0 THEN 'ADD' WHEN lines_removed > 0 AND lines_added = 0 THEN 'REMOVE' ELSE 'MODIFY' END WHEN type = 'entry_created' THEN 'CREATE' ELSE type END"


@query("r03_semantic_edits", f"SELECT session_id, event_id, concat_ws('->', {OP}, regexp_extract(file_path, '([^/.]*)\\.[a-z]+$', 1), CASE WHEN lines_added > 50 OR lines_removed > 50 THEN 'LARGE' WHEN lines_added > 10 OR lines_removed > 10 THEN 'MEDIUM' END) AS edit FROM ev")
def semantic_edits(t: Tables) -> DataFrame:
    return encoders.semantic_edits(t.ev)


@query("r02_token_sequences")
def token_sequences(t: Tables) -> DataFrame:
    x = _codes(t).select("session_id", "ts", "code_id", C.generic_tokens(F.col("code")).alias("tokens"))
    return x.groupBy("session_id").agg(F.size(F.flatten(F.collect_list("tokens"))).alias("n_tokens"), F.count("*").alias("n_changes"))


@query("r04_function_sequences", f"WITH {CODES} SELECT session_id, string_agg(regexp_extract(code, 'def\\s+(\\w+)', 1), '>' ORDER BY ts, code_id) AS functions FROM codes GROUP BY session_id")
def function_sequences(t: Tables) -> DataFrame:
    x = _codes(t).select("session_id", F.struct("ts", "code_id", C.function_names(F.col("code")).alias("f")).alias("s"))
    return x.groupBy("session_id").agg(F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["f"])), ">").alias("functions"))


@query("r05_module_order", "SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY t, e) AS rank, stem FROM (SELECT session_id, stem, min(ts) AS t, arg_min(event_id, (ts, event_id)) AS e FROM (SELECT *, regexp_extract(file_path, '([^/.]*)\\.[a-z]+$', 1) AS stem FROM ev) x GROUP BY session_id, stem) y")
def module_order(t: Tables) -> DataFrame:
    return encoders.first_stems(t.ev).withColumn("rank", F.col("rank").cast("long"))


@query("r06_file_edit_graph", """WITH e AS (SELECT session_id, file_path, ts, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS pos FROM ev WHERE type = 'code_change'),
  n AS (SELECT a.session_id, a.pos, a.file_path, a.ts, min(b.pos) AS next FROM e a JOIN e b ON a.session_id = b.session_id AND b.pos > a.pos AND b.file_path <> a.file_path GROUP BY 1, 2, 3, 4)
  SELECT n.session_id, n.file_path AS source, e.file_path AS target, count(*) AS weight FROM n JOIN e ON n.session_id = e.session_id AND n.next = e.pos WHERE epoch_us(e.ts) - epoch_us(n.ts) <= 86400000000 GROUP BY 1, 2, 3""")
def file_edit_graph(t: Tables) -> DataFrame:
    return encoders.file_edit_graph(t.ev.where("type = 'code_change'"), 86400)


@query("r10_edit_scripts")
def edit_scripts(t: Tables) -> DataFrame:
    return encoders.edit_script(_codes(t).select(F.col("code_id").alias("diff_id"), "before_code", F.col("code").alias("after_code")))


@query("r08_dependencies", f"WITH {CODES} SELECT session_id, string_agg(DISTINCT concat(file_path, '→', p), ', ' ORDER BY concat(file_path, '→', p)) AS dependencies FROM (SELECT session_id, file_path, unnest(regexp_extract_all(code, 'import\\s+([^\\s;]+)', 1)) AS p FROM codes) x GROUP BY session_id")
def dependencies(t: Tables) -> DataFrame:
    x = _codes(t).select("session_id", "file_path", F.explode(C.imports(F.col("code"))).alias("p"))
    return x.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat("file_path", F.lit("→"), "p"))), ", ").alias("dependencies"))


@query("f50_abstracted_export", "SELECT entry_id, length(coalesce(file_path, '')) > 0 AS named, CASE regexp_extract(file_path, '(\\.[a-z]+)$', 1) WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.py' THEN 'python' ELSE 'other' END AS file_type FROM entries")
def abstracted_export(t: Tables) -> DataFrame:
    return encoders.abstracted(t.entries.withColumn("named", F.length("file_path") > 0), 3).select("entry_id", "named", "file_type")


@query("f08_anonymous_paths", "SELECT DISTINCT full_path, concat('<workspace>/', split_part(full_path, '/', -3), '/', split_part(full_path, '/', -2), '/', split_part(full_path, '/', -1)) AS short FROM (SELECT concat(workspace_path, '/', file_path) AS full_path FROM ev) x")
def anonymous_paths(t: Tables) -> DataFrame:
    p = F.concat_ws("/", "workspace_path", "file_path")
    return t.ev.select(p.alias("full_path"), X.anonymous_path(p).alias("short")).distinct()


@query("f66_history_lines", "SELECT command_id, command AS line FROM terminal")
def history_lines(t: Tables) -> DataFrame:
    raw = F.concat(F.lit(": 1700000000:0;"), "command")
    return t.terminal.select("command_id", X.strip_history(raw).alias("line"))


@query("w07_trace_motifs", """SELECT session_id, CASE WHEN max(n) > 5 THEN concat('HOTSPOT_', max(n)) END AS hotspot, sum(switches) > 3 AS chase FROM (SELECT session_id, file_path, count(*) AS n, count(*) FILTER (WHERE prev <> file_path) AS switches
  FROM (SELECT session_id, file_path, lag(file_path) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS prev FROM ev) x GROUP BY 1, 2) y GROUP BY session_id""")
def trace_motifs(t: Tables) -> DataFrame:
    prev = F.lag("file_path").over(Window.partitionBy("session_id").orderBy("ts", "event_id"))
    per = t.ev.select("session_id", "file_path", prev.alias("prev")).groupBy("session_id", "file_path").agg(F.count("*").alias("n"), F.count_if(F.col("prev") != F.col("file_path")).alias("switches"))
    return per.groupBy("session_id").agg(F.when(F.max("n") > 5, F.concat(F.lit("HOTSPOT_"), F.max("n").cast("string"))).alias("hotspot"), (F.sum("switches") > 3).alias("chase"))


@query("w16_threads", "SELECT prompt_id, session_id, count(*) OVER (PARTITION BY session_id ORDER BY ts, prompt_id ROWS UNBOUNDED PRECEDING) AS n_so_far FROM prompts")
def threads(t: Tables) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("ts", "prompt_id").rowsBetween(Window.unboundedPreceding, 0)
    return t.prompts.select("prompt_id", "session_id", F.count("*").over(w).alias("n_so_far"))


@query("a24_common_types", f"WITH {SYMBOLS} SELECT label, type, n FROM (SELECT session_id % 5 AS label, type, count(*) AS n, row_number() OVER (PARTITION BY session_id % 5 ORDER BY count(*) DESC, type) AS rn FROM (SELECT cast(substr(session_id, 2) AS bigint) AS session_id, type FROM syms) x GROUP BY 1, 2) y WHERE rn <= 3")
def common_types(t: Tables) -> DataFrame:
    per = t.ev.groupBy((F.substring("session_id", 2, 12).cast("long") % 5).alias("label"), "type").agg(F.count("*").alias("n"))
    return per.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "type"))).where("rn <= 3").drop("rn")


@query("o05_representative", "SELECT workspace_path, session_id, n FROM (SELECT *, row_number() OVER (PARTITION BY workspace_path ORDER BY abs(n - mean), session_id) AS rn FROM (SELECT *, avg(n) OVER (PARTITION BY workspace_path) AS mean FROM (SELECT workspace_path, session_id, count(*) AS n FROM ev GROUP BY 1, 2) x) y) z WHERE rn = 1")
def representative(t: Tables) -> DataFrame:
    per = t.ev.groupBy("workspace_path", "session_id").agg(F.count("*").alias("n"))
    mean = per.groupBy("workspace_path").agg(F.avg("n").alias("mean"))
    return per.join(mean, "workspace_path").groupBy("workspace_path").agg(F.min_by(F.struct("session_id", "n"), F.struct(F.abs(F.col("n") - F.col("mean")), "session_id")).alias("s")).select("workspace_path", "s.session_id", "s.n")


@query("v05_padded")
def padded(t: Tables) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    pad = F.slice(F.concat(e, F.array_repeat(F.lit(0.0), 80)), 1, 80)
    return t.raw("embeddings").select("vec_id", F.size("embedding").cast("long").alias("n"), F.posexplode(pad).alias("dim", "x")).withColumn("x", F.round("x", 9))


@query("v07_dtw")
def dtw(t: Tables) -> DataFrame:
    """DTW of each session's edit sizes to its workspace's longest session."""
    sizes = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "lines_added"))), lambda s: s["lines_added"].cast("double"))
    per = t.ev.where("type = 'code_change'").groupBy("workspace_path", "session_id").agg(sizes.alias("x"))
    lead = per.groupBy("workspace_path").agg(F.max_by("x", F.struct(F.size("x"), "session_id")).alias("y"))
    return per.join(lead, "workspace_path").select("session_id", "workspace_path", F.round(vectors.dtw_distance("x", "y"), 6).alias("distance"))


@query("v08_behaviour_library", "SELECT label, count(*) AS frequency, min(vec_id) AS first_member FROM embeddings GROUP BY label HAVING count(*) >= 3")
def behaviour_library(t: Tables) -> DataFrame:
    return t.raw("embeddings").groupBy("label").agg(F.count("*").alias("frequency"), F.min("vec_id").alias("first_member")).where("frequency >= 3")


@query("v16_taxonomy_levels")
def taxonomy_levels(t: Tables) -> DataFrame:
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.functions import array_to_vector

    x = t.raw("embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    out = None
    for level, k in enumerate((8, 4, 2)):
        part = BisectingKMeans(k=k, seed=42).fit(x).transform(x).groupBy("prediction").agg(F.count("*").alias("size")).select(F.lit(level).alias("level"), F.col("prediction").alias("cluster_id"), "size")
        out = part if out is None else out.unionByName(part)
    return out


@query("m01_prefixspan")
def prefixspan(t: Tables) -> DataFrame:
    from pyspark.ml.fpm import PrefixSpan

    seq = sessions.symbols(t.ev).groupBy("session_id").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("seq", "symbol"))), 1, 50), lambda s: F.array(s["symbol"])).alias("sequence"))
    found = PrefixSpan(minSupport=0.5, maxPatternLength=3).findFrequentSequentialPatterns(seq.select("sequence"))
    return found.select(F.array_join(F.flatten("sequence"), ">").alias("pattern"), "freq")


@query("s09_json_values", "SELECT event_id, cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS k FROM events")
def json_values(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("s12_traces", "SELECT session_id, count(*) AS n_events, min(ts) AS first_ts FROM (SELECT session_id, ts FROM prompts UNION ALL SELECT session_id, ts FROM terminal) x GROUP BY session_id")
def traces(t: Tables) -> DataFrame:
    messages = t.terminal.select("session_id", "ts", F.col("command").alias("text"))
    return files.traces(t.prompts, messages).select("session_id", "n_events", F.col("events")[0]["ts"].alias("first_ts"))


@query("s13_key_values", "SELECT concat('inlineDiffs-', session_id) AS key, file_path AS path, lines_added AS edits FROM ev WHERE type = 'code_change'")
def key_values(t: Tables) -> DataFrame:
    per = t.ev.where("type IN ('code_change', 'prompt')").groupBy(F.concat(F.when(F.col("type") == "code_change", "inlineDiffs-").otherwise("aiService-"), "session_id").alias("key")).agg(F.to_json(F.collect_list(F.struct(F.col("file_path").alias("path"), F.col("lines_added").alias("edits")))).alias("value"))
    return files.key_values(per, "inlineDiffs-%", "struct<path:string,edits:long>")


@query("s15_file_metadata", "SELECT file_path, count(*) AS edit_count, max(length(coalesce(before_code, ''))) AS longest FROM entries GROUP BY file_path")
def file_metadata(t: Tables) -> DataFrame:
    return t.entries.groupBy("file_path").agg(F.count("*").alias("edit_count"), F.max(F.length(F.coalesce("before_code", F.lit("")))).cast("long").alias("longest"))


def _scratch(t: Tables) -> str:
    sc = t.spark.sparkContext
    if not (sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()):
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="trace-"))
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    return f"{folder.rstrip('/')}/{uuid.uuid4().hex}"


@query("k02_jsonl_round_trip", "SELECT entry_id, file_path, lines_added FROM entries")
def jsonl_round_trip(t: Tables) -> DataFrame:
    path, df = f"{_scratch(t)}.jsonl", t.entries.select("entry_id", "file_path", "lines_added")
    files.write_any(df, path)
    return files.read_any(t.spark, path, T.StructType(df.schema.fields))


@query("k03_parquet_round_trip", "SELECT prompt_id, ts, text FROM prompts")
def parquet_round_trip(t: Tables) -> DataFrame:
    path = f"{_scratch(t)}.parquet"
    files.write_any(t.prompts.select("prompt_id", "ts", "text"), path)
    return files.read_any(t.spark, path)


@query("k08_csv_round_trip", "SELECT command_id, command FROM terminal")
def csv_round_trip(t: Tables) -> DataFrame:
    path, df = _scratch(t), t.terminal.select("command_id", "command")
    files.write_csv(df, path)
    return t.spark.read.schema(df.schema).option("header", True).option("escape", '"').csv(path)


@query("d02_update_by_key", "SELECT prompt_id, CASE WHEN prompt_id % 4 = 0 THEN 99 ELSE mode_id END AS mode_id FROM prompts")
def update_by_key(t: Tables) -> DataFrame:
    old = t.prompts.select("prompt_id", "mode_id")
    return links.upsert(old, old.where("prompt_id % 4 = 0").select("prompt_id", F.lit(99).cast("long").alias("mode_id")), "prompt_id")


@query("d05_append_if_absent", "SELECT session_id, count(DISTINCT file_path) AS n_files FROM entries GROUP BY session_id")
def append_if_absent(t: Tables) -> DataFrame:
    halves = [t.entries.where(f"entry_id % 2 = {i}").groupBy("session_id").agg(F.collect_set("file_path").alias(f"f{i}")) for i in (0, 1)]
    none = F.array().cast("array<string>")
    return halves[0].join(halves[1], "session_id", "full_outer").select("session_id", F.size(F.array_union(F.coalesce("f0", none), F.coalesce("f1", none))).cast("long").alias("n_files"))


@query("d11_materialised_summary", "SELECT session_id, count(*) AS n_events, max(ts) AS last_ts FROM ev GROUP BY session_id")
def materialised_summary(t: Tables) -> DataFrame:
    path = f"{_scratch(t)}.parquet"
    t.ev.groupBy("session_id").agg(F.count("*").alias("n_events"), F.max("ts").alias("last_ts")).write.parquet(path)
    return t.spark.read.parquet(path)


def _stream(t: Tables) -> DataFrame:
    df = t.raw("events")
    raw = t.spark.readStream.schema(df.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
    return raw.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("/w/p"), (F.col("user_id") % 7).cast("string")).alias("workspace_path"), "event_type")


@query("t05_stream_dedupe", "SELECT workspace_path, event_type, count(*) > 0 AS seen FROM (SELECT concat('/w/p', user_id % 7) AS workspace_path, event_type FROM events) x GROUP BY 1, 2")
def stream_dedupe(t: Tables) -> DataFrame:
    out = stateful.run_once(stateful.unseen(_stream(t), ["workspace_path", "event_type"], "1000 days"), f"dedupe_{uuid.uuid4().hex}", _scratch(t))
    return out.select("workspace_path", "event_type", F.lit(True).alias("seen")).distinct()


@query("t07_stream_sessions")
def stream_sessions(t: Tables) -> DataFrame:
    out = stateful.run_once(stateful.session_chunks(_stream(t), "30 minutes"), f"sessions_{uuid.uuid4().hex}", _scratch(t))
    return out.groupBy("workspace_path").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n_events"))
