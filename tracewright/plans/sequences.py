"""Sessions, symbols, motifs, scalar functions, graphs and vectors as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import code as C
from tracewright.functions import events as E
from tracewright.functions import text as X
from tracewright.operators import context, graph, sessions, vectors
from tracewright.plans.registry import query
from tracewright.sources import files
from tracewright.sources.telemetry import Tables, spread

CHUNKS = """marked AS (SELECT event_id, ts, type, workspace_path, file_path, lines_added, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 300000000 THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (ORDER BY ts, event_id)),
  chunks AS (SELECT *, sum(new) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS chunk_id FROM marked)"""
SYMBOLS = """syms AS (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS seq,
  concat('EV_', substr(sha1(split_part(regexp_replace(lower(type), '[._/\\-]+', '|', 'g'), '|', 1)), 1, 6)) AS symbol, type, file_path FROM ev)"""
#: sha1 is spelt out of DuckDB's own functions
SYMBOLS = SYMBOLS.replace("\\\\", "\\")


def _chunked(t: Tables) -> DataFrame:
    return sessions.temporal_chunks(t.ev.withColumnRenamed("event_id", "id"))


@query("w04_temporal_chunks", f"WITH {CHUNKS} SELECT cast(chunk_id AS bigint) AS chunk_id, count(*) AS n_items, count(*) FILTER (WHERE type = 'prompt') AS n_prompts, count(*) FILTER (WHERE type = 'code_change') AS n_edits, cast(sum(lines_added) AS bigint) AS lines_added, count(DISTINCT workspace_path) AS n_workspaces, count(DISTINCT file_path) AS n_files, cast(round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS bigint) AS duration_s FROM chunks GROUP BY chunk_id")
def temporal_chunks(t: Tables) -> DataFrame:
    return sessions.chunk_summary(_chunked(t))


@query("f01_symbols", f"WITH {SYMBOLS} SELECT symbol, count(*) AS n FROM syms GROUP BY symbol")
def symbol_counts(t: Tables) -> DataFrame:
    return sessions.symbols(t.ev).groupBy("symbol").agg(F.count("*").alias("n"))


@query("w01_transitions", f"WITH {SYMBOLS} SELECT motif, count(*) AS n FROM (SELECT concat('T_', symbol, '_', lead(symbol) OVER (PARTITION BY session_id ORDER BY seq)) AS motif, lead(symbol) OVER (PARTITION BY session_id ORDER BY seq) AS b, seq FROM syms) x WHERE b IS NOT NULL AND seq <= 100 GROUP BY motif")
def transitions(t: Tables) -> DataFrame:
    return sessions.transitions(sessions.symbols(t.ev)).groupBy("motif").agg(F.count("*").alias("n"))


@query("w02_cycles", f"WITH {SYMBOLS} SELECT session_id, seq, concat('CYCLE_', symbol, '_', b) AS motif FROM (SELECT *, lead(symbol) OVER w AS b, lead(symbol, 2) OVER w AS c FROM syms WINDOW w AS (PARTITION BY session_id ORDER BY seq)) x WHERE symbol = c AND symbol <> b")
def cycles(t: Tables) -> DataFrame:
    return sessions.cycles(sessions.symbols(t.ev))


@query("w02_hot_symbols", f"WITH {SYMBOLS} SELECT session_id, concat('HOT_', symbol, '_', count(*)) AS motif FROM syms GROUP BY session_id, symbol HAVING count(*) >= 5")
def hot_symbols(t: Tables) -> DataFrame:
    return sessions.hot(sessions.symbols(t.ev))


@query("w02_high_switching", f"WITH {SYMBOLS} SELECT session_id, 'HIGH_SWITCHING' AS motif FROM syms GROUP BY session_id HAVING count(*) >= 2 AND count(DISTINCT symbol) > 0.7 * count(*)")
def high_switching(t: Tables) -> DataFrame:
    return sessions.switching(sessions.symbols(t.ev))


GRAMS = f"""{SYMBOLS}, led AS (SELECT *, lead(symbol) OVER w AS b, lead(symbol, 2) OVER w AS c FROM syms WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
  grams AS (SELECT session_id, seq, concat('SQ_', symbol, '_', b) AS motif FROM led WHERE b IS NOT NULL UNION ALL SELECT session_id, seq, concat('SQ_', symbol, '_', b, '_', c) FROM led WHERE c IS NOT NULL)"""


@query("w03_repeated_grams", f"WITH {GRAMS} SELECT session_id, motif, count(*) AS n, min(seq) AS first_seq FROM grams GROUP BY session_id, motif HAVING count(*) >= 2")
def repeated_grams(t: Tables) -> DataFrame:
    return sessions.repeated_grams(sessions.symbols(t.ev))


@query("m02_motif_sets", f"""WITH {GRAMS}, firsts AS (SELECT session_id, motif AS pattern, min(seq) AS place FROM grams GROUP BY session_id, motif HAVING count(*) >= 2)
  SELECT session_id, rank, concat('M_', substr(sha1(pattern), 1, 10)) AS motif, pattern FROM (SELECT *, cast(row_number() OVER (PARTITION BY session_id ORDER BY place, pattern) AS int) AS rank FROM firsts) x WHERE rank <= 300""")
def motif_sets(t: Tables) -> DataFrame:
    grams = sessions.repeated_grams(sessions.symbols(t.ev))
    return sessions.motif_ids(grams.select("session_id", F.col("motif").alias("pattern"), F.col("first_seq").alias("place")))


@query("w05_edit_sequence_edges", "SELECT file_path AS source, target, count(*) AS weight FROM (SELECT file_path, lead(file_path) OVER w AS target, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap FROM ev WHERE type IN ('code_change', 'entry_created') WINDOW w AS (PARTITION BY workspace_path ORDER BY ts, event_id)) x WHERE target <> file_path AND gap <= 3600000000 GROUP BY 1, 2")
def edit_edges(t: Tables) -> DataFrame:
    return sessions.adjacent_edges(t.ev.where("type IN ('code_change', 'entry_created')"), 3600)


@query("w06_navigation_edges", "SELECT file_path AS source, target, count(*) AS weight FROM (SELECT file_path, lead(file_path) OVER w AS target, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap FROM ev WHERE type = 'file_open' WINDOW w AS (PARTITION BY workspace_path ORDER BY ts, event_id)) x WHERE target <> file_path AND gap < 3600000000 GROUP BY 1, 2")
def navigation_edges(t: Tables) -> DataFrame:
    return sessions.adjacent_edges(t.ev.where("type = 'file_open'"), 3600, inclusive=False)


@query("w10_sequences", f"WITH {SYMBOLS} SELECT session_id, count(*) AS length, string_agg(symbol, ' ' ORDER BY seq) AS symbols FROM syms GROUP BY session_id HAVING count(*) BETWEEN 3 AND 50")
def sequences(t: Tables) -> DataFrame:
    return sessions.sequences(sessions.symbols(t.ev))


@query("w11_latest_content", "SELECT file_path, entry_id, left(after_code, 200000) AS content FROM (SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY ts DESC, entry_id DESC) AS rn FROM entries WHERE length(after_code) >= 10) x WHERE rn = 1")
def latest_content(t: Tables) -> DataFrame:
    x = t.entries.where(F.length("after_code") >= 10)
    return x.groupBy("file_path").agg(F.max_by(F.struct("entry_id", "after_code"), F.struct("ts", "entry_id")).alias("s")).select("file_path", "s.entry_id", F.left("s.after_code", F.lit(200000)).alias("content"))


#: Notes that some events carry.
NOTED = "SELECT *, CASE WHEN k % 7 = 0 THEN 'Fix a bug in auth' WHEN k % 11 = 0 THEN 'add feature' WHEN k % 13 = 0 THEN 'clean up src/ui/a.tsx' WHEN k % 17 = 0 THEN 'performance' END AS annotation FROM {ev} ev"


def _noted(t: Tables) -> DataFrame:
    return t.spark.sql(NOTED, ev=t.ev)


@query("w12_state_boundaries")
def state_boundaries(t: Tables) -> DataFrame:
    return sessions.state_boundaries(_noted(t).withColumn("intent", E.event_intent(F.col("annotation"), F.col("file_path"))))


@query("w13_turn_index", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS idx FROM conversations")
def turn_index(t: Tables) -> DataFrame:
    return t.raw("conversations").select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1).cast("long").alias("idx"))


@query("a25_segment_types", f"WITH {SYMBOLS} SELECT session_id, segment, type, n FROM (SELECT session_id, (seq - 1) // 10 AS segment, type, count(*) AS n, row_number() OVER (PARTITION BY session_id, (seq - 1) // 10 ORDER BY count(*) DESC, type) AS rn FROM syms GROUP BY 1, 2, 3) x WHERE rn <= 3")
def segment_types(t: Tables) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "event_id"))
    per = t.ev.select("session_id", "type", F.floor((seq - 1) / 10).alias("segment")).groupBy("session_id", "segment", "type").agg(F.count("*").alias("n"))
    return per.withColumn("rn", F.row_number().over(Window.partitionBy("session_id", "segment").orderBy(F.desc("n"), "type"))).where("rn <= 3").drop("rn")


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(low, '{w}')" for w in words) + ")"


INTENTS = ", ".join(f"CASE WHEN {_any(words)} THEN '{label}' END" for label, words in X.INTENT_WORDS.items())


@query("f34_intents", f"SELECT prompt_id, coalesce(nullif(concat_ws(',', {INTENTS}), ''), 'INTENT_OTHER') AS intents FROM (SELECT prompt_id, lower(text) AS low FROM prompts) x")
def intents(t: Tables) -> DataFrame:
    return t.said.select("prompt_id", F.array_join(X.intents(F.col("text")), ",").alias("intents"))


@query("a19_intent_distribution", f"SELECT intent, count(*) AS n FROM (SELECT unnest(string_split(coalesce(nullif(concat_ws(',', {INTENTS}), ''), 'INTENT_OTHER'), ',')) AS intent FROM (SELECT lower(text) AS low FROM prompts) x) y GROUP BY intent")
def intent_distribution(t: Tables) -> DataFrame:
    return t.said.select(F.explode(X.intents(F.col("text"))).alias("intent")).groupBy("intent").agg(F.count("*").alias("n"))


@query("f41_prompt_intent")
def prompt_intent(t: Tables) -> DataFrame:
    return t.said.select("prompt_id", X.prompt_intent(F.col("text")).alias("intent"))


@query("f04_redaction")
def redaction(t: Tables) -> DataFrame:
    return spread(t.raw("documents").select("doc_id", "text")).select("doc_id", F.md5(X.redact(F.col("text"))).alias("masked"))


@query("f07_sanitised", r"SELECT doc_id, md5(CASE WHEN length(m) > 2000 THEN concat(substr(m, 1, 2000), '...<truncated>') ELSE m END) AS clean FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}', '<EMAIL>', 'g'), 'https?://[^\s]+', '<URL>', 'g') AS m FROM documents) x")
def sanitised(t: Tables) -> DataFrame:
    return t.raw("documents").select("doc_id", F.md5(X.sanitize_prompt(F.col("text"))).alias("clean"))


@query("f09_file_types", "SELECT kind, count(*) AS n FROM (SELECT CASE regexp_extract(file_path, '(\\.[a-z]+)$', 1) WHEN '.js' THEN 'javascript' WHEN '.ts' THEN 'typescript' WHEN '.py' THEN 'python' ELSE 'other' END AS kind FROM ev) x GROUP BY kind")
def file_types(t: Tables) -> DataFrame:
    return t.ev.groupBy(X.file_type(F.col("file_path")).alias("kind")).agg(F.count("*").alias("n"))


@query("f10_file_ids")
def file_ids(t: Tables) -> DataFrame:
    return t.ev.select("file_path").distinct().select("file_path", X.file_id(F.col("file_path")).alias("file_id"))


@query("f12_path_hashes", "SELECT DISTINCT file_path, concat('F_', substr(md5(file_path), 1, 8)) AS h FROM ev")
def path_hashes(t: Tables) -> DataFrame:
    return t.ev.select("file_path", F.concat(F.lit("F_"), F.substring(F.md5("file_path"), 1, 8)).alias("h")).distinct()


@query("f33_path_parts", "SELECT DISTINCT file_path, regexp_extract(file_path, '([^/]*)$', 1) AS base, regexp_replace(file_path, '/?[^/]*$', '') AS dir, len(list_filter(string_split(file_path, '/'), lambda p: p <> '')) AS depth FROM ev")
def path_parts(t: Tables) -> DataFrame:
    p = F.col("file_path")
    return t.ev.select(p, X.basename(p).alias("base"), X.dirname(p).alias("dir"), X.depth(p).cast("long").alias("depth")).distinct()


@query("f59_net_diffs", r"""SELECT entry_id, greatest(0, al - bl) AS lines_added, greatest(0, bl - al) AS lines_removed, greatest(0, ac - bc) AS chars_added, greatest(0, bc - ac) AS chars_deleted, abs(ac - bc) >= 10 AS significant
  FROM (SELECT entry_id, length(a) AS ac, length(b) AS bc, len(string_split(a, chr(10))) AS al, len(string_split(b, chr(10))) AS bl FROM (SELECT entry_id, coalesce(before_code, '') AS b, coalesce(after_code, '') AS a FROM entries) x) y""")
def net_diffs(t: Tables) -> DataFrame:
    d = t.entries.select("entry_id", X.net_diff(F.col("before_code"), F.col("after_code")).alias("d")).select("entry_id", "d.*")
    return d.select("entry_id", *(F.col(c).cast("long").alias(c) for c in ("lines_added", "lines_removed", "chars_added", "chars_deleted")), "significant")


@query("f60_export_diffs", "SELECT entry_id, length(coalesce(after_code, '')) AS chars_added, length(coalesce(before_code, '')) AS chars_deleted FROM entries")
def export_diffs(t: Tables) -> DataFrame:
    return t.entries.select("entry_id", F.length(F.coalesce("after_code", F.lit(""))).cast("long").alias("chars_added"), F.length(F.coalesce("before_code", F.lit(""))).cast("long").alias("chars_deleted"))


@query("f29_command_paths", r"SELECT command_id, unnest(list_distinct(regexp_extract_all(command, '([\w./-]+\.[A-Za-z]{1,5})\b', 1))) AS path FROM terminal")
def command_paths(t: Tables) -> DataFrame:
    return t.terminal.select("command_id", F.explode(X.paths_in(F.col("command"))).alias("path"))


@query("f32_size_buckets", "SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN n < 100 THEN 'small' WHEN n < 500 THEN 'medium' ELSE 'large' END AS bucket FROM (SELECT len(regexp_split_to_array(text, ' ')) AS n FROM documents) x) y GROUP BY bucket")
def size_buckets(t: Tables) -> DataFrame:
    return t.raw("documents").select(X.size_bucket(F.size(F.split("text", " "))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


@query("f53_line_kinds")
def line_kinds(t: Tables) -> DataFrame:
    lines = t.raw("pages").select("page_id", F.posexplode(F.split("html", "\n")).alias("line", "code"))
    return lines.withColumn("kind", X.line_kind(F.trim("code"))).where("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"))


EDGES = """edges AS (SELECT file_path AS source, target, 'EDIT_SEQUENCE' AS type, count(*) AS weight FROM (SELECT file_path, lead(file_path) OVER w AS target, epoch_us(lead(ts) OVER w) - epoch_us(ts) AS gap FROM ev WHERE type = 'code_change' WINDOW w AS (PARTITION BY workspace_path ORDER BY ts, event_id)) x WHERE target <> file_path AND gap <= 900000000 GROUP BY 1, 2)"""


def _edges(t: Tables) -> DataFrame:
    return sessions.adjacent_edges(t.ev.where("type = 'code_change'"), 900).select("source", "target", F.lit("EDIT_SEQUENCE").alias("type"), "weight")


def _nodes(t: Tables) -> DataFrame:
    return t.ev.select(F.col("file_path").alias("id")).distinct()


@query("g01_file_numbers", "SELECT file_path, concat('FILE_', CASE WHEN n < 1000 THEN lpad(cast(n AS varchar), 3, '0') ELSE cast(n AS varchar) END) AS file_id FROM (SELECT file_path, row_number() OVER (ORDER BY file_path) AS n FROM (SELECT DISTINCT file_path FROM ev) x) y")
def file_numbers(t: Tables) -> DataFrame:
    ids = files.numbered(t.ev.select("file_path").distinct(), ["file_path"])
    return ids.select("file_path", F.concat(F.lit("FILE_"), C.padded(F.col("n"))).alias("file_id"))


@query("g02_directories", "SELECT dir, count(*) AS children, 1 + length(dir) - length(replace(dir, '/', '')) AS depth FROM (SELECT DISTINCT file_path, regexp_replace(file_path, '/?[^/]*$', '') AS dir FROM ev) x GROUP BY dir")
def directories(t: Tables) -> DataFrame:
    d = t.ev.select("file_path").distinct().select(X.dirname(F.col("file_path")).alias("dir"))
    return d.groupBy("dir").agg(F.count("*").alias("children")).withColumn("depth", X.depth(F.col("dir")).cast("long"))


@query("g05_edges", f"WITH {EDGES} SELECT source, target, type, weight FROM edges")
def edges(t: Tables) -> DataFrame:
    return _edges(t)


@query("g06_degrees", f"WITH {EDGES}, nodes AS (SELECT DISTINCT file_path AS id FROM ev) SELECT id, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, coalesce(i, 0) + coalesce(o, 0) AS degree, round((coalesce(i, 0) + coalesce(o, 0)) / ((SELECT count(*) FROM nodes) - 1), 6) AS centrality FROM nodes LEFT JOIN (SELECT source, count(*) AS o FROM edges GROUP BY source) s ON id = source LEFT JOIN (SELECT target, count(*) AS i FROM edges GROUP BY target) g ON id = target")
def degrees(t: Tables) -> DataFrame:
    return graph.degrees(_nodes(t), _edges(t)).withColumn("centrality", F.round("centrality", 6))


@query("o03_hubs", f"WITH {EDGES} SELECT source AS id, count(*) AS out_degree FROM edges GROUP BY source HAVING count(*) > 5 ORDER BY out_degree DESC, id LIMIT 10")
def hubs(t: Tables) -> DataFrame:
    return graph.hubs(graph.degrees(_nodes(t), _edges(t))).select("id", "out_degree")


@query("g09_clustering", f"""WITH {EDGES}, nb AS (SELECT DISTINCT a, b FROM (SELECT source AS a, target AS b FROM edges UNION ALL SELECT target, source FROM edges) x WHERE a <> b), k AS (SELECT a, count(*) AS k FROM nb GROUP BY a HAVING count(*) >= 2),
  tri AS (SELECT x.a, count(*) AS t FROM nb x JOIN nb y ON x.b = y.a AND y.b <> x.a JOIN nb z ON z.a = x.a AND z.b = y.b GROUP BY x.a) SELECT k.a AS id, k.k AS n_neighbours, round(coalesce(t, 0) / (k.k * (k.k - 1)), 6) AS coefficient FROM k LEFT JOIN tri ON k.a = tri.a""")
def clustering(t: Tables) -> DataFrame:
    return graph.clustering(_edges(t))


@query("g11_components", f"""RECURSIVE WITH {EDGES}, nb AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges), reach(a, b) AS (SELECT file_path, file_path FROM ev UNION SELECT r.a, nb.b FROM reach r JOIN nb ON r.b = nb.a) SELECT a AS id, min(b) AS component FROM reach GROUP BY a""")
def components(t: Tables) -> DataFrame:
    return graph.components(_nodes(t), _edges(t))


@query("g14_distances", f"""RECURSIVE WITH {EDGES}, first AS (SELECT min(source) AS s FROM edges), walk(id, distance) AS (SELECT s, 0 FROM first UNION SELECT e.target, w.distance + 1 FROM walk w JOIN edges e ON w.id = e.source WHERE w.distance < 12) SELECT id, min(distance) AS distance FROM walk GROUP BY id""")
def distances(t: Tables) -> DataFrame:
    e = _edges(t)
    start = e.agg(F.min("source")).first()[0]
    return graph.distances(e, start)


@query("g10_has_cycle")
def has_cycle(t: Tables) -> DataFrame:
    return t.spark.createDataFrame([(graph.has_cycle(_edges(t)),)], "has_cycle boolean")


@query("g12_communities")
def communities(t: Tables) -> DataFrame:
    return graph.louvain(_nodes(t), _edges(t))


@query("g13_modularity", f"WITH {EDGES}, c AS (SELECT DISTINCT file_path AS id, regexp_replace(file_path, '/?[^/]*$', '') AS com FROM ev), n AS (SELECT e.*, a.com AS cs, b.com AS ct FROM edges e JOIN c a ON e.source = a.id JOIN c b ON e.target = b.id), m AS (SELECT sum(weight) AS m FROM n), d AS (SELECT c, sum(weight) AS d FROM (SELECT cs AS c, weight FROM n UNION ALL SELECT ct, weight FROM n) x GROUP BY c), i AS (SELECT cs AS c, sum(weight) AS i FROM n WHERE cs = ct GROUP BY cs) SELECT round(sum(coalesce(i, 0) / m - d * d / (2 * m * m)), 6) AS modularity_ref FROM d LEFT JOIN i ON d.c = i.c CROSS JOIN m")
def modularity(t: Tables) -> DataFrame:
    return graph.modularity(_edges(t), _nodes(t).select("id", X.dirname(F.col("id")).alias("community")))


@query("g15_paths")
def paths(t: Tables) -> DataFrame:
    e = _edges(t)
    a, b = e.agg(F.min("source"), F.max("target")).first()
    return graph.paths(e, a, b, depth=4)


@query("g16_neighbours", f"WITH {EDGES} SELECT target AS id, 'out' AS way FROM edges WHERE source = 'src/m1/f1.js' UNION ALL SELECT source, 'in' FROM edges WHERE target = 'src/m1/f1.js'")
def neighbours(t: Tables) -> DataFrame:
    e, of = _edges(t), "src/m1/f1.js"
    return e.where(F.col("source") == of).select(F.col("target").alias("id"), F.lit("out").alias("way")).unionByName(e.where(F.col("target") == of).select(F.col("source").alias("id"), F.lit("in").alias("way")))


@query("g17_subgraph", f"WITH {EDGES} SELECT source, target, weight FROM edges WHERE source LIKE 'src/m1/%' AND target LIKE 'src/m1/%'")
def subgraph(t: Tables) -> DataFrame:
    return graph.subgraph(_edges(t), _nodes(t).where("id LIKE 'src/m1/%'")).select("source", "target", "weight")


@query("g19_graph_diff", f"WITH {EDGES} SELECT source, target, type, CASE WHEN weight = 1 THEN 'removed' WHEN weight > 2 THEN 'modified' END AS change FROM edges WHERE weight = 1 OR weight > 2")
def graph_diff(t: Tables) -> DataFrame:
    e = _edges(t)
    return graph.graph_diff(e, e.where("weight > 1").withColumn("weight", F.least("weight", F.lit(2))))


@query("a16_graph_metrics", f"WITH {EDGES}, n AS (SELECT count(DISTINCT file_path) AS n FROM ev) SELECT n, count(*) AS e, round(2.0 * count(*) / n, 6) AS avg_degree, round(count(*) / (n * (n - 1) / 2), 6) AS density FROM edges CROSS JOIN n GROUP BY n")
def graph_metrics(t: Tables) -> DataFrame:
    both = _nodes(t).agg(F.count("*").alias("n")).crossJoin(_edges(t).agg(F.count("*").alias("e")))  # one row each
    return both.select("n", "e", F.round(2.0 * F.col("e") / F.col("n"), 6).alias("avg_degree"), F.round(F.col("e") / (F.col("n") * (F.col("n") - 1) / 2), 6).alias("density"))


FILES_SEEN = "seen AS (SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY ts, prompt_id) AS seq, [context_a, context_b] AS files FROM prompts), led AS (SELECT *, coalesce(lag(files) OVER (PARTITION BY session_id ORDER BY seq), []) AS before FROM seen)"


@query("p09_context_changes", f"WITH {FILES_SEEN} SELECT session_id, seq, len(list_filter(list_distinct(files), lambda x: NOT list_contains(before, x))) AS n_added, len(list_filter(list_distinct(before), lambda x: NOT list_contains(files, x))) AS n_removed, len(list_filter(list_distinct(files), lambda x: list_contains(before, x))) AS n_kept, len(list_distinct(files)) - len(list_distinct(before)) AS net_change FROM led")
def context_changes(t: Tables) -> DataFrame:
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy("ts", "prompt_id"))
    return context.context_changes(t.prompts.select("session_id", seq.alias("seq"), F.array("context_a", "context_b").alias("files")))


@query("v01_one_hot", "SELECT event_id, CASE WHEN type = 'code_change' THEN 1.0::double ELSE 0.0::double END AS d0, CASE WHEN type = 'prompt' THEN 1.0::double ELSE 0.0::double END AS d3 FROM ev")
def one_hot(t: Tables) -> DataFrame:
    names = ["code_change", "entry_created", "file_open", "prompt", "terminal_command"]
    x = t.ev.select("event_id", vectors.one_hot(F.col("type"), names).alias("v"))
    return x.select("event_id", F.col("v")[0].alias("d0"), F.col("v")[3].alias("d3"))


@query("v06_kmeans_sizes")
def kmeans_sizes(t: Tables) -> DataFrame:
    return vectors.kmeans(t.raw("embeddings"), 8).groupBy("cluster").agg(F.count("*").alias("n"))


@query("v11_t_test", "SELECT n_c, n_t, round(mc, 4) AS mean_c, round(mt, 4) AS mean_t, round(100 * (mt - mc) / mc, 4) AS change_pct, round((mt - mc) / sqrt(((n_c - 1) * vc + (n_t - 1) * vt) / (n_c + n_t - 2) * (1.0 / n_c + 1.0 / n_t)), 4) AS t, n_c + n_t - 2 AS df, round((mt - mc) / sqrt(((n_c - 1) * pc + (n_t - 1) * pt) / (n_c + n_t - 2)), 4) AS cohens_d FROM (SELECT count(c) AS n_c, count(t) AS n_t, avg(c) AS mc, avg(t) AS mt, var_samp(c) AS vc, var_samp(t) AS vt, var_pop(c) AS pc, var_pop(t) AS pt FROM (SELECT CASE WHEN o_custkey % 2 = 0 THEN o_totalprice END AS c, CASE WHEN o_custkey % 2 = 1 THEN o_totalprice END AS t FROM orders) x) y")
def t_test(t: Tables) -> DataFrame:
    rows = t.raw("orders").select(F.when(F.col("o_custkey") % 2 == 0, "control").otherwise("treatment").alias("g"), F.col("o_totalprice").alias("v"))
    return vectors.t_test(rows, "g", "v", "control", "treatment")


@query("v14_assign_cluster")
def assign_cluster(t: Tables) -> DataFrame:
    e = t.raw("embeddings")
    return vectors.assign(e, vectors.centroids(e))
