"""Files in and out, captured messages, listings, stored rows, streams and whole-graph calls as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions import events as E
from tracewright.functions import text as X
from tracewright.operators import encoders, graph, links, sessions, vectors
from tracewright.plans.registry import query
from tracewright.plans.representations import _scratch, _stream
from tracewright.plans.sequences import CHUNKS, EDGES, GRAMS, SYMBOLS, _chunked, _edges, _nodes
from tracewright.sources import files
from tracewright.sources.telemetry import Tables
from tracewright.streaming import stateful


@query("s07_read_parquet", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def read_parquet(t: Tables) -> DataFrame:
    return files.read_any(t.spark, f"{t.sf_dir}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"))


FORMATS = "CASE WHEN path LIKE '%.jsonl' THEN 'jsonl' WHEN path LIKE '%.json' THEN 'json' WHEN path LIKE '%.parquet' THEN 'parquet' END"


@query("s08_formats", f"SELECT path, {FORMATS} AS format FROM (SELECT DISTINCT CASE k % 3 WHEN 0 THEN file_path WHEN 1 THEN concat(file_path, 'l') ELSE concat(file_path, '.parquet') END AS path FROM ev) x")
def formats(t: Tables) -> DataFrame:
    path = F.expr("CASE k % 3 WHEN 0 THEN file_path WHEN 1 THEN concat(file_path, 'l') ELSE concat(file_path, '.parquet') END")
    return t.ev.select(path.alias("path")).distinct().select("path", files.format_of(F.col("path")).alias("format"))


@query("s10_extracted_prompts", "SELECT prompt_id, session_id FROM prompts")
def extracted_prompts(t: Tables) -> DataFrame:
    """Prompts from documents that hold a list, or one prompt alone."""
    one = F.struct("prompt_id", "session_id")
    docs = t.prompts.where("prompt_id % 2 = 0").select(F.to_json(one).alias("body"))
    docs = docs.unionByName(t.prompts.where("prompt_id % 2 = 1").groupBy("session_id").agg(F.to_json(F.collect_list(one)).alias("body")).select("body"))
    path = _scratch(t)
    docs.write.text(path)
    return files.records(t.spark.read.text(path).withColumnRenamed("value", "body"), "body", "prompt_id long, session_id string")


@query("s11_extracted_conversations", "SELECT conv_id, turn FROM conversations")
def extracted_conversations(t: Tables) -> DataFrame:
    """Conversations from lists, from objects that hold a list, and from single ones."""
    one, c = F.struct("conv_id", "turn"), t.raw("conversations")
    lists = c.groupBy("conv_id").agg(F.collect_list(one).alias("items"))
    docs = lists.where("conv_id % 3 = 0").select(F.to_json("items").alias("body")).unionByName(lists.where("conv_id % 3 = 1").select(F.to_json(F.struct(F.col("items").alias("conversations"))).alias("body")))
    docs = docs.unionByName(c.where("conv_id % 3 = 2").select(F.to_json(one).alias("body")))
    return files.records(docs, "body", "conv_id long, turn long", "conversations")


@query("s14_loaded_sequences", f"WITH {SYMBOLS} SELECT session_id, count(*) AS length FROM syms GROUP BY session_id HAVING count(*) BETWEEN 3 AND 500")
def loaded_sequences(t: Tables) -> DataFrame:
    path = f"{_scratch(t)}.json"
    files.write_json(sessions.sequences(sessions.symbols(t.ev), 3, 500), path)
    return files.read_any(t.spark, path, T.StructType.fromDDL("session_id string, length long"))


def _dumps(t: Tables) -> str:
    """A folder a workspace, each with a key-value dump of its files."""
    path = _scratch(t)
    x = t.ev.select(F.regexp_replace("workspace_path", "/", "_").alias("workspace"), F.concat(F.lit("file-"), F.col("event_id").cast("string")).alias("key"), F.to_json(F.array(F.struct(F.col("file_path").alias("path")))).alias("value"))
    x.write.partitionBy("workspace").parquet(path)
    return path


@query("s16_files_of_workspaces", "SELECT replace(workspace_path, '/', '_') AS workspace, file_path AS path, count(*) AS n FROM ev GROUP BY 1, 2")
def files_of_workspaces(t: Tables) -> DataFrame:
    rows = t.spark.read.parquet(_dumps(t))
    found = rows.select("workspace", F.explode(F.from_json("value", "array<struct<path:string>>")).alias("f"))
    return found.groupBy("workspace", F.col("f.path").alias("path")).agg(F.count("*").alias("n"))


@query("u10_united_sources", "SELECT key, count(*) AS n FROM (SELECT concat('file-', event_id) AS key FROM ev UNION ALL SELECT concat('prompt-', prompt_id) FROM prompts) x GROUP BY key")
def united_sources(t: Tables) -> DataFrame:
    """Dumps of several stores read as one."""
    other = _scratch(t)
    t.prompts.select(F.concat(F.lit("prompt-"), F.col("prompt_id").cast("string")).alias("key")).write.parquet(other)
    both = t.spark.read.parquet(_dumps(t)).select("key").unionByName(t.spark.read.parquet(other))
    return both.groupBy("key").agg(F.count("*").alias("n"))


@query("s19_all_extracts", "SELECT 'files' AS extract, count(DISTINCT file_path) AS n FROM ev UNION ALL SELECT 'contexts', count(*) FROM prompts UNION ALL SELECT 'tools', count(*) FROM terminal")
def all_extracts(t: Tables) -> DataFrame:
    parts = {"files": t.ev.select("file_path").distinct(), "contexts": t.prompts.select("context_a"), "tools": t.terminal.select("command")}
    return _counts(parts, "extract")


def _counts(parts: dict[str, DataFrame], name: str) -> DataFrame:
    """One row for each table: its name and number of rows."""
    out = None
    for label, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(label).alias(name), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("s21_assistant_data", "SELECT workspace_path, count(*) AS prompts, cast(sum(context_usage) AS bigint) AS tokens FROM prompts GROUP BY 1")
def assistant_data(t: Tables) -> DataFrame:
    return t.prompts.groupBy("workspace_path").agg(F.count("*").alias("prompts"), F.sum("context_usage").cast("long").alias("tokens"))


@query("s22_workspace_listing", "SELECT DISTINCT concat('workspace=', replace(workspace_path, '/', '_')) AS name FROM ev")
def workspace_listing(t: Tables) -> DataFrame:
    """Workspaces by the folders of their files."""
    return files.listing(t.spark, _dumps(t)).select(F.regexp_extract("path", r"(workspace=[^/]*)/", 1).alias("name")).distinct()


@query("s40_discovered_workspaces", "SELECT DISTINCT workspace_path, true AS has_files FROM ev")
def discovered_workspaces(t: Tables) -> DataFrame:
    found = files.listing(t.spark, _dumps(t)).select(F.regexp_replace(F.regexp_extract("path", r"workspace=([^/]*)/", 1), "_", "/").alias("workspace_path"), "length")
    return found.groupBy("workspace_path").agg((F.sum("length") > 0).alias("has_files"))


@query("s23_all_data", "SELECT 'entries' AS name, count(*) AS n FROM entries UNION ALL SELECT 'events', count(*) FROM ev UNION ALL SELECT 'prompts', count(*) FROM prompts")
def all_data(t: Tables) -> DataFrame:
    return _counts({"entries": t.entries, "events": t.ev, "prompts": t.prompts}, "name")


@query("s25_text_file_changes", f"SELECT file_path, count(*) AS n FROM ev WHERE type = 'code_change' AND regexp_extract(file_path, '(\\.[^./]+)$', 1) IN ({', '.join(repr(x) for x in files.TEXT_SUFFIXES)}, '') GROUP BY 1")
def text_file_changes(t: Tables) -> DataFrame:
    suffix = X.extension(F.col("file_path"))
    return t.ev.where("type = 'code_change'").where(suffix.isin(*files.TEXT_SUFFIXES, "")).groupBy("file_path").agg(F.count("*").alias("n"))


@query("s29_editor_state", "SELECT event_id, file_path AS active_file, lines_added AS cursor_line, session_id AS window_id FROM ev WHERE type = 'file_open'")
def editor_state(t: Tables) -> DataFrame:
    """Nested samples of an editor's state as rows."""
    sample = F.to_json(F.struct(F.struct(F.col("file_path").alias("active"), F.struct(F.col("lines_added").alias("line")).alias("cursor")).alias("editor"), F.struct(F.col("session_id").alias("id")).alias("window")))
    raw = t.ev.where("type = 'file_open'").select("event_id", sample.alias("body"))
    d = raw.select("event_id", F.from_json("body", "editor struct<active:string,cursor:struct<line:long>>, window struct<id:string>").alias("d"))
    return d.select("event_id", F.col("d.editor.active").alias("active_file"), F.col("d.editor.cursor.line").alias("cursor_line"), F.col("d.window.id").alias("window_id"))


KEPT = {"file_open": 1000, "code_change": 100, "terminal_command": 100}


@query("s30_last_samples", "SELECT type, count(*) AS n, min(event_id) AS first_id FROM (SELECT type, event_id, row_number() OVER (PARTITION BY type ORDER BY ts DESC, event_id DESC) AS rn FROM ev) x WHERE " + " OR ".join(f"type = '{k}' AND rn <= {n}" for k, n in KEPT.items()) + " GROUP BY type")
def last_samples(t: Tables) -> DataFrame:
    """Of each kind of sample the last ones, as many as its sampler keeps."""
    rn = F.row_number().over(Window.partitionBy("type").orderBy(F.desc("ts"), F.desc("event_id")))
    most = F.create_map(*(F.lit(x) for kv in KEPT.items() for x in kv))
    kept = t.ev.where(F.col("type").isin(*KEPT)).select("type", "event_id", rn.alias("rn")).where(F.col("rn") <= most[F.col("type")])
    return kept.groupBy("type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("s31_prompt_responses", "SELECT kind, count(*) AS n FROM (SELECT unnest(CASE WHEN role = 'assistant' THEN ['prompt', 'event', 'entry'] ELSE ['prompt', 'event'] END) AS kind FROM conversations) x GROUP BY kind")
def prompt_responses(t: Tables) -> DataFrame:
    """Each message is a prompt and an event, and an assistant's an entry, too."""
    kinds = F.when(F.col("role") == "assistant", F.array(F.lit("prompt"), F.lit("event"), F.lit("entry"))).otherwise(F.array(F.lit("prompt"), F.lit("event")))
    return t.raw("conversations").select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("s34_logged_events", "SELECT event_id, coalesce(CASE WHEN k % 5 > 0 THEN type END, 'unknown') AS type, k FROM ev")
def logged_events(t: Tables) -> DataFrame:
    body = F.to_json(F.struct("event_id", F.when(F.col("k") % 5 > 0, F.col("type")).alias("type"), F.struct("k").alias("details")))
    d = t.ev.select(F.from_json(body, "event_id long, type string, details struct<k:long>").alias("d"))
    return d.select("d.event_id", F.coalesce("d.type", F.lit("unknown")).alias("type"), "d.details.k")


METHODS = ("initialize", "logConversation", "logPromptResponse", "logCodeChange", "logEvent", "streamConversation", "getSessionInfo", "setConfig")


@query("s35_messages", "SELECT method, code, count(*) AS n FROM (SELECT CASE k % 3 WHEN 0 THEN 'logEvent' WHEN 1 THEN 'logCodeChange' ELSE 'nothing' END AS method, CASE WHEN k % 3 = 2 THEN -32601 END AS code FROM ev) x GROUP BY 1, 2")
def messages(t: Tables) -> DataFrame:
    """Line-delimited calls read from files; a method that is not known is answered with an error code."""
    path = _scratch(t)
    method = F.expr("CASE k % 3 WHEN 0 THEN 'logEvent' WHEN 1 THEN 'logCodeChange' ELSE 'nothing' END")
    t.ev.select(F.to_json(F.struct(F.lit("2.0").alias("jsonrpc"), F.col("event_id").alias("id"), method.alias("method"))).alias("value")).write.text(path)
    calls = t.spark.read.text(path).select(F.from_json("value", "id long, method string").alias("m")).select("m.*")
    return calls.groupBy("method", F.when(~F.col("method").isin(*METHODS), -32601).alias("code")).agg(F.count("*").alias("n"))


@query("s36_manual_prompts", "SELECT conv_id, turn, text, 'manual' AS source, 'pending' AS status FROM conversations WHERE role = 'user' AND length(trim(text)) > 0")
def manual_prompts(t: Tables) -> DataFrame:
    x = t.raw("conversations").where((F.col("role") == "user") & (F.length(F.trim("text")) > 0))
    return x.select("conv_id", "turn", "text", F.lit("manual").alias("source"), F.lit("pending").alias("status"))


@query("s42_flattened_samples", "SELECT conv_id, count(*) AS messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def flattened_samples(t: Tables) -> DataFrame:
    """Samples of conversations, flattened and kept by conversation: the later one stays."""
    c = t.raw("conversations")
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    samples = c.select(F.to_json(F.struct(F.struct(F.col("conv_id").alias("id")).alias("conversation"), F.struct(F.col("turn").alias("last"), F.row_number().over(w).alias("count")).alias("state"))).alias("body"))
    rows = samples.select(F.from_json("body", "conversation struct<id:long>, state struct<last:long,count:long>").alias("s")).select(F.col("s.conversation.id").alias("conv_id"), F.col("s.state.count").alias("messages"), F.col("s.state.last").alias("last_turn"))
    return links.last_write(rows, "conv_id", "messages")


@query("s44_browser_state", "SELECT event_id, concat('http://h', k, '/p') AS url FROM ev WHERE k % 4 < 2")
def browser_state(t: Tables) -> DataFrame:
    """Addresses in key-value rows whose key speaks of tabs or browsers: from JSON, or out of other text around it."""
    url = F.concat(F.lit("http://h"), F.col("k").cast("string"), F.lit("/p"))
    key = F.expr("CASE k % 4 WHEN 0 THEN 'open.tab' WHEN 1 THEN 'browser.state' ELSE 'other' END")
    value = F.when(F.col("k") % 4 == 0, F.to_json(F.struct(url.alias("path")))).otherwise(F.concat(F.lit("x\u0001{\"url\":\""), url, F.lit("\"}\u0002y")))
    return files.browser_rows(t.ev.select("event_id", key.alias("key"), value.alias("value")), "event_id")


@query("s47_added_entries", "SELECT type, count(*) AS n FROM (SELECT unnest([type, 'entry_created']) AS type FROM entries) x GROUP BY type")
def added_entries(t: Tables) -> DataFrame:
    """Each entry with the event that tells of it."""
    return t.entries.select(F.explode(F.array(F.col("type"), F.lit("entry_created"))).alias("type")).groupBy("type").agg(F.count("*").alias("n"))


@query("k01_json_document", "SELECT entry_id, file_path FROM entries")
def json_document(t: Tables) -> DataFrame:
    """One JSON array, written and read again."""
    path = f"{_scratch(t)}.json"
    files.write_json(t.entries.select("entry_id", "file_path"), path)
    return t.spark.read.schema("entry_id long, file_path string").option("multiLine", True).json(path)


@query("k04_saved_library", "SELECT label, count(*) AS frequency FROM embeddings GROUP BY label")
def saved_library(t: Tables) -> DataFrame:
    path = f"{_scratch(t)}.json"
    files.write_json(t.raw("embeddings").groupBy("label").agg(F.count("*").alias("frequency")), path)
    return t.spark.read.schema("label int, frequency long").option("multiLine", True).json(path)


@query("k07_structured_export", f"WITH {CHUNKS} SELECT 'chunks' AS section, count(DISTINCT chunk_id) AS n FROM chunks UNION ALL SELECT 'entries', count(*) FROM entries UNION ALL SELECT 'links', count(*) FROM (SELECT p.prompt_id, e.entry_id FROM entries e JOIN prompts p ON e.prompt_id = p.prompt_id UNION SELECT p.prompt_id, e.entry_id FROM prompts p JOIN entries e ON p.linked_entry_id = e.entry_id) l")
def structured_export(t: Tables) -> DataFrame:
    """Entries at an abstraction level, linked pairs and temporal chunks, written as sections and counted."""
    path = _scratch(t)
    parts = {"chunks": sessions.chunk_summary(_chunked(t)), "entries": encoders.abstracted(t.entries, 2), "links": links.linked_pairs(t.prompts, t.entries)}
    for name, df in parts.items():
        df.write.json(f"{path}/{name}")
    return _counts({name: t.spark.read.text(f"{path}/{name}") for name in parts}, "section")


@query("k09_dataset_export", "SELECT split, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (ORDER BY entry_id) <= floor(0.9 * count(*) OVER ()) THEN 'train' ELSE 'validation' END AS split FROM entries) x GROUP BY split")
def dataset_export(t: Tables) -> DataFrame:
    """Training and validation parts as JSON lines, beside a card."""
    path = _scratch(t)
    for name, part in zip(("train", "validation"), files.split_positions(t.entries.select("entry_id", "file_path", "after_code"), ["entry_id"]), strict=True):
        part.write.json(f"{path}/{name}")
    t.spark.createDataFrame([("# Dataset\\n\\ntrain and validation parts as JSON lines",)], "value string").coalesce(1).write.text(f"{path}/card")
    return _counts({name: t.spark.read.schema("entry_id long").json(f"{path}/{name}") for name in ("train", "validation")}, "split").where("n > 0")


@query("u03_dataset_samples", "SELECT id, kind FROM (SELECT cast(entry_id AS varchar) AS id, 'entry' AS kind FROM entries UNION ALL SELECT concat('prompt_', prompt_id), 'prompt' FROM prompts) x")
def dataset_samples(t: Tables) -> DataFrame:
    e = t.entries.select(F.col("entry_id").cast("string").alias("id"), F.lit("entry").alias("kind"))
    return e.unionByName(t.prompts.select(F.concat(F.lit("prompt_"), F.col("prompt_id").cast("string")).alias("id"), F.lit("prompt").alias("kind")))


@query("k11_streamed_array", "SELECT command_id FROM terminal")
def streamed_array(t: Tables) -> DataFrame:
    """A JSON array in pieces, none of which holds more than a partition's rows; the pieces together are one array."""
    path = _scratch(t)
    files.stream_array(t.terminal.select("command_id"), path)
    return files.read_array(t.spark, path, "command_id long")


@query("k12_export_preview", "SELECT 'entries' AS source, count(*) AS n, count(DISTINCT file_path) AS files FROM entries UNION ALL SELECT 'prompts', count(*), 0 FROM prompts UNION ALL SELECT 'terminal', count(*), 0 FROM terminal")
def export_preview(t: Tables) -> DataFrame:
    """How much each source would export; an estimate of bytes is part of the operator."""
    parts = [files.preview(df).select(F.lit(name).alias("source"), "n", (extra if extra is not None else F.lit(0).cast("long")).alias("files")) for name, df, extra in (("prompts", t.prompts, None), ("terminal", t.terminal, None))]
    entries = t.entries.agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files")).select(F.lit("entries").alias("source"), "n", "files")
    return entries.unionByName(parts[0]).unionByName(parts[1])


@query("f70_csv_cells", """SELECT prompt_id, CASE WHEN regexp_matches(v, '[",]') THEN concat('"', replace(v, '"', '""'), '"') ELSE v END AS cell FROM (SELECT prompt_id, regexp_replace(text, '\\r?\\n', '\\\\n', 'g') AS v FROM prompts) x""")
def csv_cells(t: Tables) -> DataFrame:
    return t.prompts.select("prompt_id", X.csv_cell(F.col("text")).alias("cell"))


@query("p10_status_messages", "SELECT event_id, type AS status FROM ev WHERE session_id = 's3' AND ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-06-30'")
def status_messages(t: Tables) -> DataFrame:
    since, until = files.checked_range("2024-01-02", "2024-06-30")
    return links.filtered(t.ev, {"session_id": "s3"}, since, until).select("event_id", F.col("type").alias("status"))


@query("p23_list_parameters", "SELECT event_id FROM ev WHERE type IN ('prompt', 'file_open') AND ts >= TIMESTAMP '2024-01-02'")
def list_parameters(t: Tables) -> DataFrame:
    """Comma lists and times as numbers or dates, as a caller gives them."""
    kinds, since = files.listed(" prompt , file_open,,"), files.moment("1704153600000")
    return links.filtered(t.ev.where(F.col("type").isin(*kinds)), since=since).select("event_id")


@query("p26_all_rows", "SELECT 'entry' AS kind, entry_id AS id FROM entries UNION ALL SELECT 'terminal', command_id FROM terminal")
def all_rows(t: Tables) -> DataFrame:
    both = t.entries.select(F.lit("entry").alias("kind"), F.col("entry_id").alias("id"), "ts").unionByName(t.terminal.select(F.lit("terminal").alias("kind"), F.col("command_id").alias("id"), "ts"))
    return both.orderBy("kind", F.desc("ts"), "id").select("kind", "id")


@query("p33_daily_stats", "SELECT cast(ts AS date) AS day, count(*) AS n FROM ev WHERE cast(ts AS date) = DATE '2024-01-03' GROUP BY 1")
def daily_stats(t: Tables) -> DataFrame:
    return t.ev.where("to_date(ts) = DATE '2024-01-03'").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query("p34_terminal_history", "SELECT command_id, command FROM terminal WHERE source = 'zsh' AND ts >= TIMESTAMP '2024-01-02' ORDER BY ts DESC, command_id LIMIT 50")
def terminal_history(t: Tables) -> DataFrame:
    return links.filtered(t.terminal, {"source": "zsh"}, "2024-01-02").orderBy(F.desc("ts"), "command_id").limit(50).select("command_id", "command")


@query("a03_total_entries", "SELECT count(*) AS n FROM entries")
def total_entries(t: Tables) -> DataFrame:
    return t.entries.agg(F.count("*").alias("n"))


@query("a20_chunk_summary", f"WITH {CHUNKS} SELECT cast(chunk_id AS bigint) AS chunk_id, count(DISTINCT file_path) AS n_files, cast(round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) AS bigint) AS duration_s FROM chunks GROUP BY 1")
def chunk_summary(t: Tables) -> DataFrame:
    return sessions.chunk_summary(_chunked(t)).select("chunk_id", "n_files", "duration_s")


@query("a33_health", "SELECT (SELECT count(*) FROM entries) AS entries, (SELECT count(*) FROM prompts WHERE linked_entry_id IS NULL) AS waiting, (SELECT round(100.0 * count(linked_entry_id) / count(*), 2) FROM prompts) AS linked_pct")
def health(t: Tables) -> DataFrame:
    p = t.prompts.agg(F.count_if(F.col("linked_entry_id").isNull()).alias("waiting"), F.round(100.0 * F.count("linked_entry_id") / F.count("*"), 2).alias("linked_pct"))
    return t.entries.agg(F.count("*").alias("entries")).crossJoin(p)  # one row each


@query("o01_paged_order", "SELECT event_id FROM ev ORDER BY ts DESC, event_id LIMIT 25 OFFSET 50")
def paged_order(t: Tables) -> DataFrame:
    return t.ev.orderBy(F.desc("ts"), "event_id").offset(50).limit(25).select("event_id")


@query("o07_capped_motifs", f"WITH {GRAMS}, firsts AS (SELECT session_id, motif AS pattern, min(seq) AS place FROM grams GROUP BY session_id, motif HAVING count(*) >= 2) SELECT session_id, pattern FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY place, pattern) AS rn FROM firsts) x WHERE rn <= 5")
def capped_motifs(t: Tables) -> DataFrame:
    grams = sessions.repeated_grams(sessions.symbols(t.ev))
    return sessions.motif_ids(grams.select("session_id", F.col("motif").alias("pattern"), F.col("first_seq").alias("place")), 5).select("session_id", "pattern")


@query("d07_audit_log", "SELECT type AS operation, session_id AS actor, count(*) AS n FROM ev WHERE type <> 'file_open' GROUP BY 1, 2")
def audit_log(t: Tables) -> DataFrame:
    """Operations appended to a log, part by part, and read again."""
    path = f"{_scratch(t)}.parquet"
    for kind in ("code_change", "entry_created", "prompt", "terminal_command"):
        t.ev.where(F.col("type") == kind).select(F.col("type").alias("operation"), F.col("session_id").alias("actor"), "ts").write.mode("append").parquet(path)
    return t.spark.read.parquet(path).groupBy("operation", "actor").agg(F.count("*").alias("n"))


@query("d08_share_links", "SELECT session_id, CASE WHEN n > 4 THEN 'shared' ELSE 'private' END AS state FROM (SELECT session_id, count(*) AS n FROM prompts GROUP BY 1) x WHERE n <> 3")
def share_links(t: Tables) -> DataFrame:
    """Links made, changed and taken back: the last word on each key; deleted ones go."""
    made = t.prompts.groupBy("session_id").agg(F.count("*").alias("n"))
    log = made.select("session_id", F.lit("private").alias("state"), F.lit(0).alias("at"))
    log = log.unionByName(made.where("n > 4").select("session_id", F.lit("shared").alias("state"), F.lit(1).alias("at"))).unionByName(made.where("n = 3").select("session_id", F.lit(None).cast("string").alias("state"), F.lit(2).alias("at")))
    return links.last_write(log, "session_id", "at").where("state IS NOT NULL").select("session_id", "state")


@query("d12_global_stats", "SELECT 'prompts' AS name, count(*) AS value FROM prompts UNION ALL SELECT 'sessions', count(DISTINCT session_id) FROM ev")
def global_stats(t: Tables) -> DataFrame:
    """Numbers stored by name as JSON, set twice; the later value is read."""
    path = f"{_scratch(t)}.parquet"
    body = lambda c: F.to_json(F.struct(c.alias("value"))).alias("body")
    old = t.prompts.agg(body(F.lit(0)))
    for name, df, at in (("prompts", old, 0), ("prompts", t.prompts.agg(body(F.count("*"))), 1), ("sessions", t.ev.agg(body(F.countDistinct("session_id"))), 0)):
        df.select(F.lit(name).alias("name"), "body", F.lit(at).alias("at")).write.mode("append").parquet(path)
    return links.last_write(t.spark.read.parquet(path), "name", "at").select("name", F.get_json_object("body", "$.value").cast("long").alias("value"))


@query("d16_created_conversations", "SELECT conv_id, concat('conversation-', conv_id) AS title, 'active' AS status FROM (SELECT DISTINCT conv_id FROM conversations) x")
def created_conversations(t: Tables) -> DataFrame:
    path = f"{_scratch(t)}.parquet"
    t.raw("conversations").select("conv_id").distinct().select("conv_id", F.concat(F.lit("conversation-"), F.col("conv_id").cast("string")).alias("title"), F.lit("active").alias("status")).write.mode("append").parquet(path)
    return t.spark.read.parquet(path)


@query("d17_status_links", "SELECT DISTINCT prompt_id, linked_entry_id AS entry_id FROM prompts WHERE linked_entry_id IS NOT NULL")
def status_links(t: Tables) -> DataFrame:
    """Links written twice count once."""
    path, x = f"{_scratch(t)}.parquet", t.prompts.where("linked_entry_id IS NOT NULL").select("prompt_id", F.col("linked_entry_id").alias("entry_id"))
    for _ in range(2):
        x.write.mode("append").parquet(path)
    return t.spark.read.parquet(path).dropDuplicates(["prompt_id", "entry_id"])


@query("d18_migrated_tables", "SELECT event_id, CASE WHEN event_id % 2 = 1 THEN type END AS rung FROM ev")
def migrated_tables(t: Tables) -> DataFrame:
    """Rows of an older and a newer schema, read as one."""
    path = f"{_scratch(t)}.parquet"
    t.ev.where("event_id % 2 = 0").select("event_id").write.parquet(f"{path}/version=1")
    t.ev.where("event_id % 2 = 1").select("event_id", F.col("type").alias("rung")).write.parquet(f"{path}/version=2")
    return t.spark.read.option("mergeSchema", True).parquet(path).select("event_id", "rung")


@query("t02_polled_queue", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def polled_queue(t: Tables) -> DataFrame:
    """A queue read from a cursor on: the first poll takes what is there, the second nothing, and no row twice."""
    at = _scratch(t)
    for _ in range(2):
        q = _stream(t).select("event_id", "event_type").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(availableNow=True).start()
        q.awaitTermination()
    return t.spark.read.schema("event_id long, event_type string").parquet(f"{at}/out").groupBy("event_type").agg(F.count("*").alias("n"))


@query("t11_poll_loop", "SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def poll_loop(t: Tables) -> DataFrame:
    """A stream that looks for new files at an interval, stopped once it has seen what is there."""
    at = _scratch(t)
    q = _stream(t).select("event_id").writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/check").trigger(processingTime="1 second").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return t.spark.read.schema("event_id long").parquet(f"{at}/out").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("t04_pending_prompts")
def pending_prompts(t: Tables) -> DataFrame:
    """Edits with the newest prompt that waits in their workspace, of which ten at most wait."""
    return stateful.run_once(stateful.pending_prompts(_stream(t)), f"pending_{uuid.uuid4().hex}", _scratch(t))


@query("t08_late_rows")
def late_rows(t: Tables) -> DataFrame:
    """Counts by day with a watermark: days that it has passed are closed, later rows of theirs left out."""
    x = _stream(t).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    out = stateful.run_once(x.select(F.col("w.start").alias("day"), "n"), f"late_{uuid.uuid4().hex}", _scratch(t))
    return out


@query("t04_prompt_edit_pairs", "SELECT p.event_id AS prompt_id, e.event_id AS entry_id FROM events p JOIN events e ON p.user_id % 7 = e.user_id % 7 AND p.event_type = 'purchase' AND e.event_type = 'click' AND epoch_us(e.ts) BETWEEN epoch_us(p.ts) AND epoch_us(p.ts) + 300000000")
def prompt_edit_pairs(t: Tables) -> DataFrame:
    """Interval join of two streams."""
    p = _stream(t).where("event_type = 'purchase'").select(F.col("event_id").alias("prompt_id"), "ts", "workspace_path")
    e = _stream(t).where("event_type = 'click'").select(F.col("event_id").alias("entry_id"), "ts", "workspace_path")
    at = _scratch(t)
    return stateful.run_to(stateful.prompt_edit_pairs(p, e, "5 minutes"), f"{at}/out", f"{at}/check")


@query("g07_betweenness")
def betweenness(t: Tables) -> DataFrame:
    return graph.betweenness(_nodes(t), _edges(t))


@query("g23_graph_changes", f"WITH {EDGES} SELECT source, target, 'removed' AS change FROM edges WHERE weight = 1")
def graph_changes(t: Tables) -> DataFrame:
    """Two graphs given both: what the later one lacks or has."""
    e = _edges(t)
    return graph.graph_diff(e, e.where("weight > 1")).select("source", "target", "change")


@query("g24_detected_communities", f"""RECURSIVE WITH {EDGES}, nb AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges), reach(a, b) AS (SELECT file_path, file_path FROM ev UNION SELECT r.a, nb.b FROM reach r JOIN nb ON r.b = nb.a) SELECT a AS id, min(b) AS community FROM reach GROUP BY a""")
def detected_communities(t: Tables) -> DataFrame:
    return graph.detect_communities(_nodes(t), _edges(t), "components")


@query("v09_clustered_sequences")
def clustered_sequences(t: Tables) -> DataFrame:
    """Clusters of sessions by how often each kind of event occurs in them."""
    return vectors.cluster_sequences(t.ev).groupBy("cluster").agg(F.count("*").alias("n"))


@query("v10_behaviour_library")
def behaviour_library(t: Tables) -> DataFrame:
    """Sessions as sequences, their clusters, and of each cluster its size, usual length and a member near the middle."""
    return vectors.library(sessions.sequences(sessions.symbols(t.ev), 3, 500), vectors.cluster_sequences(t.ev))
