"""Event classification, hierarchies, graph queries, todos, migrations and incremental reads as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import events as E
from tracewright.functions import text as X
from tracewright.operators import graph, links, sessions, vectors
from tracewright.plans.registry import query
from tracewright.plans.representations import _scratch, _stream
from tracewright.plans.sequences import EDGES, SYMBOLS, _edges, _nodes
from tracewright.sources.telemetry import Tables
from tracewright.streaming import stateful


@query("f02_event_prompts", "SELECT event_id, CASE WHEN type IN ('prompt', 'ai_prompt') THEN coalesce(nullif(CASE WHEN k % 4 = 0 THEN '' ELSE concat('p', k) END, ''), concat('m', event_id)) END AS prompt FROM ev")
def event_prompts(t: Tables) -> DataFrame:
    text = F.when(F.col("k") % 4 == 0, "").otherwise(F.concat(F.lit("p"), F.col("k").cast("string")))
    return t.ev.select("event_id", F.when(F.col("type").isin("prompt", "ai_prompt"), E.truthy(text, F.concat(F.lit("m"), F.col("event_id").cast("string")))).alias("prompt"))


@query("f06_personal_classes")
def personal_classes(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", E.personal_class(F.col("text")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("f31_languages", "SELECT language, count(*) AS n FROM (SELECT CASE regexp_extract(file_path, '(\\.[a-z]+)$', 1) WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.py' THEN 'python' WHEN '.md' THEN 'markdown' WHEN '.json' THEN 'json' ELSE 'text' END AS language FROM ev) x GROUP BY language")
def languages(t: Tables) -> DataFrame:
    return t.ev.groupBy(E.language(F.col("file_path")).alias("language")).agg(F.count("*").alias("n"))


@query("f36_event_intents", """SELECT event_id, coalesce(nullif(concat_ws(',', CASE WHEN contains(file_path, '.md') THEN 'INTENT_DOCUMENT' END, CASE WHEN lines_added > 30 AND lines_added > lines_removed * 1.5 THEN 'INTENT_FEATURE' END,
  CASE WHEN lines_removed > lines_added * 2 AND lines_removed > 20 THEN 'INTENT_REFACTOR' END, CASE WHEN type = 'file_open' THEN 'INTENT_NAVIGATE' END), ''), 'INTENT_OTHER') AS intents FROM ev""")
def event_intents(t: Tables) -> DataFrame:
    found = E.event_intents(F.col("file_path"), F.lit(None).cast("string"), F.col("lines_added"), F.col("lines_removed"), F.col("type"))
    return t.ev.select("event_id", F.array_join(found, ",").alias("intents"))


@query("a31_session_intent", """WITH i AS (SELECT session_id, ts, event_id, CASE WHEN lines_added > 30 AND lines_added > lines_removed * 1.5 THEN 'feature' WHEN lines_removed > lines_added * 2 AND lines_removed > 20 THEN 'refactor' END AS intent FROM ev),
  n AS (SELECT session_id, intent, count(*) AS n, min((ts, event_id)) AS first FROM i WHERE intent IS NOT NULL GROUP BY session_id, intent) SELECT session_id, intent, n FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, first) AS rn FROM n) x WHERE rn = 1""")
def session_intent(t: Tables) -> DataFrame:
    a, r = F.col("lines_added"), F.col("lines_removed")
    x = t.ev.select("session_id", "ts", "event_id", F.when((a > 30) & (a > r * 1.5), "feature").when((r > a * 2) & (r > 20), "refactor").alias("intent")).where("intent IS NOT NULL")
    per = x.groupBy("session_id", "intent").agg(F.count("*").alias("n"), F.min(F.struct("ts", "event_id")).alias("first"))
    return per.groupBy("session_id").agg(F.min_by(F.struct("intent", "n"), F.struct((-F.col("n")).alias("n"), "first")).alias("s")).select("session_id", "s.intent", "s.n")


@query("f42_complexity", "SELECT doc_id, CASE WHEN w > 100 OR s > 5 THEN 'complex' WHEN w > 30 OR s > 2 THEN 'moderate' ELSE 'simple' END AS complexity FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) AS w, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda x: trim(x) <> '')) AS s FROM documents) y")
def complexity(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", E.complexity(F.col("text")).alias("complexity"))


@query("f45_at_files", "SELECT prompt_id, concat('src/f', k, '.py') AS path FROM prompts")
def at_files(t: Tables) -> DataFrame:
    text = F.concat(F.lit("see @src/f"), F.col("k").cast("string"), F.lit(".py and @src/f"), F.col("k").cast("string"), F.lit(".py again"))
    return t.prompts.select("prompt_id", F.explode(E.at_files(text)).alias("path"))


@query("f48_fenced_blocks", "SELECT prompt_id, concat('run ', k, chr(10)) AS block FROM prompts")
def fenced(t: Tables) -> DataFrame:
    text = F.concat(F.lit("do\n```sh\nrun "), F.col("k").cast("string"), F.lit("\n```\nend"))
    return t.prompts.select("prompt_id", F.explode(E.fenced_blocks(text)).alias("block"))


@query("f67_versions", "SELECT k % 12 AS minor, k % 12 > 9 AS newer FROM ev GROUP BY 1, 2")
def versions(t: Tables) -> DataFrame:
    v = F.concat(F.lit("v1."), (F.col("k") % 12).cast("string"), F.lit(".0"))
    return t.ev.select((F.col("k") % 12).alias("minor"), (E.version_parts(v) > E.version_parts(F.lit("1.9.5"))).alias("newer")).distinct()


@query("f68_times", "SELECT event_id, ts FROM ev")
def times(t: Tables) -> DataFrame:
    from tracewright.functions.time import micros

    text = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise(F.floor(micros("ts") / 1000).cast("string"))
    x = t.ev.select("event_id", "ts", E.when_parsed(text).alias("parsed"))
    ok = F.abs(micros(F.col("parsed").cast("timestamp_ntz")) - micros("ts")) < 1000
    return x.select("event_id", F.when(ok, F.col("ts")).alias("ts"))


@query("s20_context_usage", "SELECT prompt_id, least(100.0::double, 100.0::double * (context_usage * 5000) / coalesce(nullif(CASE WHEN k % 3 = 0 THEN 0 ELSE 128000 END, 0), 200000)) AS usage FROM prompts")
def context_usage(t: Tables) -> DataFrame:
    window = F.when(F.col("k") % 3 == 0, 0).otherwise(128000)
    return t.prompts.select("prompt_id", E.context_usage(F.col("context_usage") * 5000, window).alias("usage"))


@query("s26_history_commands", "SELECT source, count(DISTINCT command) AS n FROM terminal GROUP BY source")
def history_commands(t: Tables) -> DataFrame:
    lines = t.terminal.select("source", F.when(F.col("source") == "zsh", F.concat(F.lit(": 1:0;"), "command")).otherwise(F.col("command")).alias("line"))
    return lines.select("source", X.strip_history(F.col("line")).alias("command")).groupBy("source").agg(F.countDistinct("command").alias("n"))


@query("s33_exploded_messages", "SELECT conv_id, turn, role, length(text) AS chars FROM conversations")
def exploded_messages(t: Tables) -> DataFrame:
    nested = t.raw("conversations").groupBy("conv_id").agg(F.to_json(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    m = F.from_json("messages", "array<struct<turn:long,role:string,text:string>>")
    return nested.select("conv_id", F.explode(m).alias("m")).select("conv_id", "m.turn", "m.role", F.length("m.text").cast("long").alias("chars"))


@query("p12_trace_filter", "SELECT session_id, count(*) AS n FROM ev GROUP BY session_id HAVING count(*) >= 60 AND min(ts) <= (SELECT min(ts) FROM ev) + INTERVAL 2 DAY")
def trace_filter(t: Tables) -> DataFrame:
    first = t.ev.agg(F.min("ts").alias("m"))  # one row
    per = t.ev.groupBy("session_id").agg(F.count("*").alias("n"), F.min("ts").alias("begun")).where("n >= 60")
    return per.crossJoin(F.broadcast(first)).where("begun <= m + INTERVAL 2 DAY").select("session_id", "n")


@query("p14_enabled_fields", "SELECT entry_id, file_path FROM entries")
def enabled_fields(t: Tables) -> DataFrame:
    config = {"before_code": False, "after_code": False, "file_path": True}
    slim = t.entries.drop(*(c for c, on in config.items() if not on))
    return slim.select("entry_id", "file_path")


@query("p20_nodes_with_edges", f"WITH {EDGES} SELECT DISTINCT file_path AS id FROM ev WHERE file_path IN (SELECT source FROM edges WHERE weight >= 2)")
def nodes_with_edges(t: Tables) -> DataFrame:
    return _nodes(t).join(_edges(t).where("weight >= 2").select(F.col("source").alias("id")), "id", "left_semi")


@query("p21_find_nodes", f"WITH {EDGES}, d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) x GROUP BY id) SELECT id, degree FROM d WHERE regexp_matches(id, '^src/m[0-4]/') AND degree BETWEEN 2 AND 500")
def find_nodes(t: Tables) -> DataFrame:
    return graph.degrees(_nodes(t), _edges(t)).where(F.col("id").rlike("^src/m[0-4]/") & F.col("degree").between(2, 500)).select("id", "degree")


@query("p22_find_edges", f"WITH {EDGES} SELECT source, target, weight FROM edges WHERE type = 'EDIT_SEQUENCE' AND weight BETWEEN 2 AND 9")
def find_edges(t: Tables) -> DataFrame:
    return _edges(t).where("type = 'EDIT_SEQUENCE' AND weight BETWEEN 2 AND 9").select("source", "target", "weight")


@query("g04_all_edges", """WITH s AS (SELECT file_path, type, lead(file_path) OVER (PARTITION BY workspace_path, type ORDER BY ts, event_id) AS target, epoch_us(lead(ts) OVER (PARTITION BY workspace_path, type ORDER BY ts, event_id)) - epoch_us(ts) AS gap FROM ev WHERE type IN ('code_change', 'file_open'))
  SELECT file_path AS source, target, CASE WHEN type = 'code_change' THEN 'EDIT_SEQUENCE' ELSE 'NAVIGATE' END AS type, count(*) AS weight FROM s WHERE target <> file_path AND ((type = 'code_change' AND gap <= 3600000000) OR (type = 'file_open' AND gap < 3600000000)) GROUP BY 1, 2, 3
  UNION ALL SELECT context_a, context_b, 'MODEL_CONTEXT', count(*) FROM prompts WHERE context_a <> context_b GROUP BY 1, 2""")
def all_edges(t: Tables) -> DataFrame:
    edit = sessions.adjacent_edges(t.ev.where("type = 'code_change'"), 3600).withColumn("type", F.lit("EDIT_SEQUENCE"))
    go = sessions.adjacent_edges(t.ev.where("type = 'file_open'"), 3600, inclusive=False).withColumn("type", F.lit("NAVIGATE"))
    model = graph.merge_edges(t.prompts.where("context_a <> context_b").select(F.col("context_a").alias("source"), F.col("context_b").alias("target"), F.lit("MODEL_CONTEXT").alias("type")))
    return edit.unionByName(go).unionByName(model).select("source", "target", "type", "weight")


@query("g08_closeness")
def closeness(t: Tables) -> DataFrame:
    """Closeness of every node: nodes reached (itself included) over the sum of distances; null if isolated."""
    d = graph.all_distances(_nodes(t), _edges(t)).groupBy(F.col("source").alias("id"))
    return d.agg(F.count("*").alias("reached"), F.sum("distance").alias("total")).select("id", "reached", F.when(F.col("total") > 0, F.round(F.col("reached") / F.col("total"), 6)).alias("closeness"))


@query("g22_structure", f"""RECURSIVE WITH {EDGES}, nb AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges), reach(a, b) AS (SELECT file_path, file_path FROM ev UNION SELECT r.a, nb.b FROM reach r JOIN nb ON r.b = nb.a), c AS (SELECT a, min(b) AS c FROM reach GROUP BY a) SELECT count(*) AS n_components, max(n) AS largest FROM (SELECT c, count(*) AS n FROM c GROUP BY c) x""")
def structure(t: Tables) -> DataFrame:
    per = graph.components(_nodes(t), _edges(t)).groupBy("component").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_components"), F.max("n").alias("largest"))


@query("v12_experiment", "SELECT CASE WHEN mt > mc THEN 'higher' ELSE 'lower_or_equal' END AS conclusion FROM (SELECT avg(CASE WHEN o_custkey % 2 = 0 THEN o_totalprice END) AS mc, avg(CASE WHEN o_custkey % 2 = 1 THEN o_totalprice END) AS mt FROM orders) x")
def experiment(t: Tables) -> DataFrame:
    rows = t.raw("orders").select(F.when(F.col("o_custkey") % 2 == 0, "c").otherwise("t").alias("g"), F.col("o_totalprice").alias("v"))
    return vectors.t_test(rows, "g", "v", "c", "t").select(F.when(F.col("mean_t") > F.col("mean_c"), "higher").otherwise("lower_or_equal").alias("conclusion"))


@query("v14_soft_intents")
def soft_intents(t: Tables) -> DataFrame:
    """Softmax over the cosines to all centroids; the best three of each vector."""
    e = t.raw("embeddings")
    cents = vectors.centroids(e)
    flat = cents.agg(F.collect_list(F.struct("label", "centroid")).alias("all"))  # one row, as many centroids as labels
    x = e.select("vec_id", "embedding").crossJoin(F.broadcast(flat))
    s = x.select("vec_id", F.transform("all", lambda c: F.struct(F.exp(vectors.cosine(F.col("embedding"), c["centroid"])).alias("e"), c["label"].alias("label"))).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, y: a + y["e"])
    return s.select("vec_id", total.alias("total"), F.explode(F.slice(F.sort_array("s", asc=False), 1, 3)).alias("x")).select("vec_id", "x.label", F.round(F.col("x.e") / F.col("total"), 6).alias("weight"))


@query("v17_cluster_words", "SELECT label, word, n FROM (SELECT doc_id % 5 AS label, word, count(*) AS n, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY count(*) DESC, word) AS rn FROM (SELECT doc_id, unnest(list_slice(string_split(lower(text), ' '), 1, 2)) AS word FROM documents) x GROUP BY 1, 2) y WHERE rn <= 2")
def cluster_words(t: Tables) -> DataFrame:
    words = t.raw("documents").select((F.col("doc_id") % 5).alias("label"), F.explode(F.slice(F.split(F.lower("text"), " "), 1, 2)).alias("word")).groupBy("label", "word").agg(F.count("*").alias("n"))
    return words.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "word"))).where("rn <= 2").drop("rn")


@query("w08_universal_motifs", f"WITH {SYMBOLS} SELECT motif, count(*) AS n FROM (SELECT concat('NG3_', symbol, '_', lead(symbol) OVER w, '_', lead(symbol, 2) OVER w) AS motif, lead(symbol, 2) OVER w AS c FROM syms WINDOW w AS (PARTITION BY session_id ORDER BY seq)) x WHERE c IS NOT NULL GROUP BY motif")
def universal_motifs(t: Tables) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy("seq")
    x = sessions.symbols(t.ev).select("symbol", F.lead("symbol").over(w).alias("b"), F.lead("symbol", 2).over(w).alias("c")).where("c IS NOT NULL")
    return x.groupBy(F.concat_ws("_", F.lit("NG3"), "symbol", "b", "c").alias("motif")).agg(F.count("*").alias("n"))


@query("w09_intent_transitions", """WITH i AS (SELECT session_id, event_id, ts, CASE WHEN type = 'file_open' THEN 'NAVIGATE' WHEN lines_added > 30 THEN 'FEATURE' END AS intent FROM ev)
  SELECT motif, count(*) AS n FROM (SELECT concat('INTENT_', intent, '->', lead(intent) OVER (PARTITION BY session_id ORDER BY ts, event_id)) AS motif, lead(intent) OVER (PARTITION BY session_id ORDER BY ts, event_id) AS b FROM i WHERE intent IS NOT NULL) x WHERE b IS NOT NULL GROUP BY motif""")
def intent_transitions(t: Tables) -> DataFrame:
    x = t.ev.select("session_id", "ts", "event_id", F.when(F.col("type") == "file_open", "NAVIGATE").when(F.col("lines_added") > 30, "FEATURE").alias("intent")).where("intent IS NOT NULL")
    nxt = F.lead("intent").over(Window.partitionBy("session_id").orderBy("ts", "event_id"))
    return x.select(F.concat(F.lit("INTENT_"), "intent", F.lit("->"), nxt).alias("motif")).where("motif IS NOT NULL").groupBy("motif").agg(F.count("*").alias("n"))


@query("w17_request_timing", "SELECT session_id, round(avg(epoch_us(nxt) - epoch_us(ts)) / 1e6, 3) AS mean_gap_s FROM (SELECT session_id, ts, lead(ts) OVER (PARTITION BY session_id ORDER BY ts, prompt_id) AS nxt FROM prompts) x WHERE nxt IS NOT NULL GROUP BY session_id")
def request_timing(t: Tables) -> DataFrame:
    from tracewright.functions.time import micros

    nxt = F.lead("ts").over(Window.partitionBy("session_id").orderBy("ts", "prompt_id"))
    x = t.prompts.select("session_id", "ts", nxt.alias("nxt")).where("nxt IS NOT NULL")
    return x.groupBy("session_id").agg(F.round(F.avg(micros("nxt") - micros("ts")) / 1e6, 3).alias("mean_gap_s"))


@query("d06_null_aware_config", "SELECT table_name, field_name, workspace FROM (SELECT 'entries' AS table_name, concat('f', i) AS field_name, CASE WHEN i % 2 = 0 THEN '/w/p1' END AS workspace FROM range(6) r(i)) x WHERE NOT (field_name = 'f3' AND workspace IS NOT DISTINCT FROM NULL)")
def null_aware_config(t: Tables) -> DataFrame:
    config = t.spark.range(6).select(F.lit("entries").alias("table_name"), F.concat(F.lit("f"), F.col("id").cast("string")).alias("field_name"), F.when(F.col("id") % 2 == 0, "/w/p1").alias("workspace"))
    gone = t.spark.createDataFrame([("f3", None)], "f string, w string")
    return config.join(gone, (F.col("field_name") == F.col("f")) & F.col("workspace").eqNullSafe(F.col("w")), "left_anti")


@query("d09_added_columns", "SELECT entry_id, NULL::varchar AS synced_at FROM entries WHERE entry_id % 2 = 0 UNION ALL SELECT entry_id, 'now' FROM entries WHERE entry_id % 2 = 1")
def added_columns(t: Tables) -> DataFrame:
    old = t.entries.where("entry_id % 2 = 0").select("entry_id")
    new = t.entries.where("entry_id % 2 = 1").select("entry_id", F.lit("now").alias("synced_at"))
    return old.unionByName(new, allowMissingColumns=True)


@query("d10_migrations", "SELECT entry_id, upper(type) AS kind, coalesce(lines_added, 0) + coalesce(lines_removed, 0) AS churn FROM entries")
def migrations(t: Tables) -> DataFrame:
    steps = {
        "1.1.0": lambda df: df.withColumnRenamed("type", "kind"),
        "1.2.0": lambda df: df.withColumn("kind", F.upper("kind")),
        "2.0.0": lambda df: df.withColumn("churn", F.coalesce("lines_added", F.lit(0)) + F.coalesce("lines_removed", F.lit(0))).drop("lines_added", "lines_removed"),
    }
    df = t.entries.select("entry_id", "type", "lines_added", "lines_removed")
    for version in sorted(steps, key=lambda v: [int(x) for x in v.split(".")]):
        df = steps[version](df)
    return df


@query("d15_turn_totals", "SELECT conv_id, max(turn) + 1 AS next_turn, cast(sum(length(text)) AS bigint) AS chars FROM conversations GROUP BY conv_id")
def turn_totals(t: Tables) -> DataFrame:
    return t.raw("conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("next_turn"), F.sum(F.length("text")).alias("chars"))


@query("j06_prompts_to_generations", "SELECT prompt_id, role FROM prompts CROSS JOIN (SELECT 'user' AS role UNION ALL SELECT 'assistant') r WHERE role = 'user' OR prompt_id % 2 = 0")
def prompts_to_generations(t: Tables) -> DataFrame:
    made = links.last_write(t.prompts.where("prompt_id % 2 = 0").select(F.col("prompt_id").alias("gid"), "ts"), "gid", "ts")
    x = t.prompts.select("prompt_id").join(made, F.col("prompt_id") == F.col("gid"), "left")
    roles = F.when(F.col("gid").isNull(), F.array(F.lit("user"))).otherwise(F.array(F.lit("user"), F.lit("assistant")))
    return x.select("prompt_id", F.explode(roles).alias("role"))


@query("j12_chunk_links")
def chunk_links(t: Tables) -> DataFrame:
    """Prompts and edits of one temporal chunk that name each other."""
    chunks = sessions.temporal_chunks(t.ev.withColumnRenamed("event_id", "id")).select("id", "chunk_id")
    p = chunks.select(F.col("id").alias("pid"), F.col("chunk_id").alias("p_chunk"))
    e = t.entries.where("prompt_id IS NOT NULL").join(chunks, F.col("entry_id") == F.col("id")).select("entry_id", "prompt_id", "chunk_id")
    return e.join(p, (F.col("prompt_id") == F.col("pid")) & (F.col("chunk_id") == F.col("p_chunk"))).select("chunk_id", "prompt_id", "entry_id")


@query("j23_diff_confidence", """WITH near AS (SELECT DISTINCT e.entry_id FROM entries e JOIN prompts p ON p.ts <= e.ts AND epoch_us(e.ts) - epoch_us(p.ts) <= 300000000)
  SELECT entry_id, CASE WHEN prompt_id IS NOT NULL THEN 'high' WHEN entry_id IN (SELECT entry_id FROM near) THEN 'medium' ELSE 'none' END AS confidence FROM entries""")
def diff_confidence(t: Tables) -> DataFrame:
    near = links.latest_before(t.entries, t.prompts).select("entry_id", F.lit(True).alias("near"))
    return t.entries.select("entry_id", "prompt_id").join(near, "entry_id", "left").select("entry_id", F.when(F.col("prompt_id").isNotNull(), "high").when(F.col("near"), "medium").otherwise("none").alias("confidence"))


@query("r14_event_types", """WITH near AS (SELECT DISTINCT e.entry_id FROM entries e JOIN prompts p ON p.ts <= e.ts AND epoch_us(e.ts) - epoch_us(p.ts) <= 300000000)
  SELECT kind, count(*) AS n FROM (SELECT CASE WHEN prompt_id IS NOT NULL OR entry_id IN (SELECT entry_id FROM near) THEN 'AI_EDIT' ELSE 'MANUAL_EDIT' END AS kind FROM entries) x GROUP BY kind""")
def event_types(t: Tables) -> DataFrame:
    return diff_confidence(t).groupBy(E.link_event_type(F.col("confidence")).alias("kind")).agg(F.count("*").alias("n"))


@query("u05_unified_motifs")
def unified_motifs(t: Tables) -> DataFrame:
    """Transitions, hot symbols and repeated grams of a session in that order, hashed and capped."""
    seq = sessions.symbols(t.ev)
    parts = [sessions.transitions(seq).select("session_id", F.col("motif").alias("pattern"), F.struct(F.lit(0).alias("list"), "seq").alias("place")), sessions.hot(seq).select("session_id", F.col("motif").alias("pattern"), F.struct(F.lit(1).alias("list"), F.lit(0).alias("seq")).alias("place")), sessions.repeated_grams(seq).select("session_id", F.col("motif").alias("pattern"), F.struct(F.lit(2).alias("list"), F.col("first_seq").alias("seq")).alias("place"))]
    return sessions.motif_ids(parts[0].unionByName(parts[1]).unionByName(parts[2]))


@query("u06_merged_graphs", f"WITH {EDGES} SELECT DISTINCT source, target FROM edges")
def merged_graphs(t: Tables) -> DataFrame:
    e = _edges(t).select("source", "target")
    return e.where("source < 'src/m5'").unionByName(e.where("source >= 'src/m3'")).dropDuplicates(["source", "target"])


@query("t01_stream_counts", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_counts(t: Tables) -> DataFrame:
    counts = _stream(t).groupBy("event_type").agg(F.count("*").alias("n"))
    return stateful.run_once(counts, f"counts_{uuid.uuid4().hex}", _scratch(t), "complete")


@query("t13_stream_filter", "SELECT event_id FROM events WHERE user_id % 7 = 3")
def stream_filter(t: Tables) -> DataFrame:
    return stateful.run_once(_stream(t).where("workspace_path = '/w/p3'").select("event_id"), f"filtered_{uuid.uuid4().hex}", _scratch(t))


@query("t15_rate_limit", "SELECT workspace_path, cast(epoch_us(ts) // 3600000000 AS bigint) AS slot, count(*) - 3 AS refused FROM ev GROUP BY 1, 2 HAVING count(*) > 3")
def rate_limit(t: Tables) -> DataFrame:
    from tracewright.functions.time import micros

    per = t.ev.groupBy("workspace_path", F.floor(micros("ts") / 3_600_000_000).cast("long").alias("slot")).agg(F.count("*").alias("n"))
    return per.where("n > 3").select("workspace_path", "slot", (F.col("n") - 3).alias("refused"))
