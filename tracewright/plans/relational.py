"""Projections, filters, joins, aggregates, sorts and set operations over the telemetry tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import text as X
from tracewright.operators import context, links
from tracewright.plans.registry import query
from tracewright.sources.telemetry import Tables


@query("s02_events_scan", "SELECT event_id, ts, session_id, type FROM ev WHERE workspace_path = '/w/p3' ORDER BY ts DESC, event_id LIMIT 200")
def events_scan(t: Tables) -> DataFrame:
    return t.ev.where("workspace_path = '/w/p3'").orderBy(F.desc("ts"), "event_id").limit(200).select("event_id", "ts", "session_id", "type")


@query("s03_prompts_scan", "SELECT prompt_id, ts, workspace_path, substr(text, 1, 80) AS preview FROM prompts WHERE workspace_path = '/w/p1' ORDER BY ts DESC, prompt_id LIMIT 100")
def prompts_scan(t: Tables) -> DataFrame:
    return t.prompts.where("workspace_path = '/w/p1'").orderBy(F.desc("ts"), "prompt_id").limit(100).select("prompt_id", "ts", "workspace_path", F.substring("text", 1, 80).alias("preview"))


@query("s04_entries_scan", "SELECT entry_id, ts, file_path FROM entries ORDER BY ts DESC, entry_id LIMIT 100")
def entries_scan(t: Tables) -> DataFrame:
    return t.entries.orderBy(F.desc("ts"), "entry_id").limit(100).select("entry_id", "ts", "file_path")


@query("p01_recent_entries_page", "SELECT entry_id, session_id, file_path, ts FROM entries WHERE workspace_path = '/w/p2' ORDER BY ts DESC, entry_id LIMIT 50 OFFSET 25")
def recent_entries(t: Tables) -> DataFrame:
    return t.entries.where("workspace_path = '/w/p2'").select("entry_id", "session_id", "file_path", "ts").orderBy(F.desc("ts"), "entry_id").offset(25).limit(50)


@query("p02_entries_in_range", "SELECT entry_id, ts FROM entries WHERE ts BETWEEN (SELECT min(ts) FROM ev) + INTERVAL 1 DAY AND (SELECT min(ts) FROM ev) + INTERVAL 3 DAY")
def entries_in_range(t: Tables) -> DataFrame:
    first = t.ev.agg(F.min("ts").alias("m"))  # one row
    return t.entries.crossJoin(F.broadcast(first)).where("ts BETWEEN m + INTERVAL 1 DAY AND m + INTERVAL 3 DAY").select("entry_id", "ts")


@query("p04_entries_with_code", "SELECT entry_id, before_code AS before_content, after_code AS after_content FROM entries WHERE after_code <> ''")
def entries_with_code(t: Tables) -> DataFrame:
    return t.entries.where("after_code <> ''").select("entry_id", F.col("before_code").alias("before_content"), F.col("after_code").alias("after_content"))


@query("p05_file_contents", "SELECT entry_id, file_path FROM entries WHERE after_code IS NOT NULL AND after_code <> '' AND file_path NOT LIKE '%.md'")
def file_contents(t: Tables) -> DataFrame:
    return t.entries.where(F.col("after_code").isNotNull() & (F.col("after_code") != "") & ~F.col("file_path").like("%.md")).select("entry_id", "file_path")


@query("p06_prompt_previews", "SELECT prompt_id, substr(text, 1, 500) AS preview FROM prompts")
def prompt_previews(t: Tables) -> DataFrame:
    return t.prompts.select("prompt_id", F.substring("text", 1, 500).alias("preview"))


@query("p08_terminal_filters", "SELECT command_id, command, exit_code FROM terminal WHERE source = 'zsh' AND exit_code = 1 AND workspace_path = '/w/p4'")
def terminal_filters(t: Tables) -> DataFrame:
    wanted = {"source": "zsh", "exit_code": 1, "workspace_path": "/w/p4"}
    df = t.terminal
    for column, value in wanted.items():
        df = df.where(F.col(column) == value)
    return df.select("command_id", "command", "exit_code")


@query("p15_workspace_access", "SELECT event_id FROM ev WHERE contains(workspace_path, '/w/p5') OR contains('/w/p5', workspace_path) OR workspace_path = ''")
def workspace_access(t: Tables) -> DataFrame:
    asked = F.lit("/w/p5")
    return t.ev.where(F.contains("workspace_path", asked) | F.contains(asked, "workspace_path") | (F.col("workspace_path") == "")).select("event_id")


@query("p16_data_sources", """SELECT source_class, count(*) AS n FROM (SELECT CASE WHEN type = 'prompt' THEN 'prompts' WHEN type = 'terminal_command' THEN 'terminal'
  WHEN type IN ('code_change', 'entry_created') THEN 'files' ELSE 'activity' END AS source_class FROM ev) x WHERE source_class IN ('prompts', 'files') GROUP BY source_class""")
def data_sources(t: Tables) -> DataFrame:
    kind = F.when(F.col("type") == "prompt", "prompts").when(F.col("type") == "terminal_command", "terminal").when(F.col("type").isin("code_change", "entry_created"), "files").otherwise("activity")
    return t.ev.select(kind.alias("source_class")).where(F.col("source_class").isin("prompts", "files")).groupBy("source_class").agg(F.count("*").alias("n"))


@query("p24_entry_by_id", "SELECT entry_id, file_path FROM entries WHERE entry_id = 103 OR cast(entry_id AS varchar) = '103'")
def entry_by_id(t: Tables) -> DataFrame:
    return t.entries.where("entry_id = 103 OR cast(entry_id AS string) = '103'").select("entry_id", "file_path")


@query("p25_events_of_session", "SELECT event_id, ts, type FROM ev WHERE session_id = 's7'")
def events_of_session(t: Tables) -> DataFrame:
    return t.ev.where("session_id = 's7'").select("event_id", "ts", "type")


@query("p27_conversations_with_turns", "SELECT conv_id, count(*) AS n_turns, string_agg(role, '>' ORDER BY turn) AS roles, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def conversations_with_turns(t: Tables) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "role")))
    return t.raw("conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(F.transform(turns, lambda x: x["role"]), ">").alias("roles"), F.max("turn").alias("last_turn"))


@query("p31_linked_prompts", "SELECT prompt_id, linked_entry_id FROM prompts WHERE linked_entry_id IS NOT NULL")
def linked_prompts(t: Tables) -> DataFrame:
    return t.prompts.where("linked_entry_id IS NOT NULL").select("prompt_id", "linked_entry_id")


@query("j01_events_with_prompts", "SELECT e.event_id, e.type, p.prompt_id, length(p.text) AS prompt_chars FROM ev e LEFT JOIN prompts p ON e.event_id - 1 = p.prompt_id")
def events_with_prompts(t: Tables) -> DataFrame:
    p = t.prompts.select("prompt_id", F.length("text").alias("prompt_chars"))
    return t.ev.join(p, F.col("event_id") - 1 == F.col("prompt_id"), "left").select("event_id", "type", "prompt_id", "prompt_chars")


@query("j02_entries_with_prompts", "SELECT e.entry_id, p.prompt_id, p.mode_id FROM entries e LEFT JOIN prompts p ON e.prompt_id = p.prompt_id")
def entries_with_prompts(t: Tables) -> DataFrame:
    p = t.prompts.select(F.col("prompt_id").alias("pid"), "mode_id")
    return t.entries.select("entry_id", "prompt_id").join(p, F.col("prompt_id") == F.col("pid"), "left").select("entry_id", F.col("pid").alias("prompt_id"), "mode_id")


@query("j03_prompts_with_entries", "SELECT p.prompt_id, e.entry_id, e.file_path FROM prompts p LEFT JOIN entries e ON p.linked_entry_id = e.entry_id")
def prompts_with_entries(t: Tables) -> DataFrame:
    e = t.entries.select("entry_id", "file_path")
    return t.prompts.select("prompt_id", "linked_entry_id").join(e, F.col("linked_entry_id") == F.col("entry_id"), "left").select("prompt_id", "entry_id", "file_path")


NEAR = """SELECT DISTINCT p.prompt_id, e.file_path FROM prompts p JOIN entries e ON (e.prompt_id = p.prompt_id
  OR abs(epoch_us(e.ts) - epoch_us(p.ts)) <= 300000000) WHERE e.file_path IS NOT NULL AND (e.before_code IS NULL OR e.before_code <> e.after_code)"""


@query("j04_entries_for_prompt", NEAR)
def entries_for_prompt(t: Tables) -> DataFrame:
    return links.entries_near_prompts(t.prompts, t.entries)


@query("j05_linked_pairs", """SELECT prompt_id, entry_id, min(link_type) AS link_type FROM (
  SELECT p.prompt_id, e.entry_id, 'entry_to_prompt' AS link_type FROM entries e JOIN prompts p ON e.prompt_id = p.prompt_id
  UNION ALL SELECT p.prompt_id, e.entry_id, 'prompt_to_entry' FROM prompts p JOIN entries e ON p.linked_entry_id = e.entry_id) x GROUP BY prompt_id, entry_id""")
def linked_pairs(t: Tables) -> DataFrame:
    return links.linked_pairs(t.prompts, t.entries)


@query("j07_latest_prompt_before_edit", """SELECT entry_id, prompt_id FROM (SELECT e.entry_id, p.prompt_id, row_number() OVER (PARTITION BY e.entry_id ORDER BY p.ts DESC, p.prompt_id DESC) AS rn
  FROM entries e JOIN prompts p ON p.ts <= e.ts AND epoch_us(e.ts) - epoch_us(p.ts) <= 300000000) x WHERE rn = 1""")
def latest_prompt(t: Tables) -> DataFrame:
    return links.latest_before(t.entries, t.prompts)


@query("j07_claimed_prompts")
def claimed_prompts(t: Tables) -> DataFrame:
    return links.claim_once(t.entries, t.prompts, 3600)


@query("j09_nearest_entry", """SELECT prompt_id, entry_id FROM (SELECT p.prompt_id, e.entry_id, row_number() OVER (PARTITION BY p.prompt_id ORDER BY abs(epoch_us(p.ts) - epoch_us(e.ts)), e.entry_id) AS rn
  FROM prompts p JOIN entries e ON e.prompt_id IS NULL AND e.workspace_path = p.workspace_path AND abs(epoch_us(p.ts) - epoch_us(e.ts)) <= 300000000) x WHERE rn = 1""")
def nearest_entry(t: Tables) -> DataFrame:
    return links.nearest(t.prompts, t.entries)


@query("j10_integrity", """SELECT 'orphan_entry' AS problem, count(*) AS n FROM entries e WHERE prompt_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM prompts p WHERE p.prompt_id = e.prompt_id)
  UNION ALL SELECT 'orphan_prompt', count(*) FROM prompts p WHERE linked_entry_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM entries e WHERE e.entry_id = p.linked_entry_id)
  UNION ALL SELECT 'no_time', count(*) FROM entries WHERE ts IS NULL""")
def integrity(t: Tables) -> DataFrame:
    e, p = t.entries, t.prompts
    one = e.where("prompt_id IS NOT NULL").join(p.select("prompt_id"), "prompt_id", "left_anti")
    two = p.where("linked_entry_id IS NOT NULL").join(e.select("entry_id"), F.col("linked_entry_id") == F.col("entry_id"), "left_anti")
    counts = [(one, "orphan_entry"), (two, "orphan_prompt"), (e.where("ts IS NULL"), "no_time")]
    out = None
    for df, name in counts:
        part = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("j11_session_summary", """SELECT s.session_id, n_events, coalesce(n_prompts, 0) AS n_prompts, types FROM (SELECT session_id, count(DISTINCT event_id) AS n_events, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM ev GROUP BY session_id) s
  LEFT JOIN (SELECT session_id, count(*) AS n_prompts FROM prompts GROUP BY session_id) p ON s.session_id = p.session_id""")
def session_summary(t: Tables) -> DataFrame:
    s = t.ev.groupBy("session_id").agg(F.countDistinct("event_id").alias("n_events"), F.array_join(F.array_sort(F.collect_set("type")), ",").alias("types"))
    p = t.prompts.groupBy("session_id").agg(F.count("*").alias("n_prompts"))
    return s.join(p, "session_id", "left").select("session_id", "n_events", F.coalesce("n_prompts", F.lit(0)).alias("n_prompts"), "types")


@query("j14_workspaces", """SELECT workspace_path, count(*) AS n_events, count(DISTINCT session_id) AS n_sessions, max(ts) AS last_activity FROM ev GROUP BY workspace_path
  UNION ALL SELECT '/w/none', 0, 0, NULL""")
def workspaces(t: Tables) -> DataFrame:
    known = t.spark.createDataFrame([(f"/w/p{i}",) for i in range(7)] + [("/w/none",)], "workspace_path string")
    seen = t.ev.groupBy("workspace_path").agg(F.count("*").alias("n_events"), F.countDistinct("session_id").alias("n_sessions"), F.max("ts").alias("last_activity"))
    listed = known.join(seen, "workspace_path", "left").na.fill(0, ["n_events", "n_sessions"])
    return listed.unionByName(seen.join(known, "workspace_path", "left_anti"))


@query("j15_function_changes", """SELECT coalesce(b.file_path, a.file_path) AS file_path, CASE WHEN b.file_path IS NULL THEN 'added' WHEN a.file_path IS NULL THEN 'removed' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'unchanged' ELSE 'modified' END AS change
  FROM (SELECT file_path, max(lines_added) AS v FROM ev WHERE event_id % 3 = 0 GROUP BY file_path) b FULL JOIN (SELECT file_path, max(lines_added) AS v FROM ev WHERE event_id % 7 = 0 GROUP BY file_path) a ON a.file_path = b.file_path""")
def function_changes(t: Tables) -> DataFrame:
    before = t.ev.where("event_id % 3 = 0").groupBy("file_path").agg(F.max("lines_added").alias("v"))
    after = t.ev.where("event_id % 7 = 0").groupBy("file_path").agg(F.max("lines_added").alias("v"))
    return links.change_sets(before, after, "file_path", "v")


CONTEXT = """ctx AS (SELECT prompt_id, context_a AS path FROM prompts UNION ALL SELECT prompt_id, context_b FROM prompts UNION ALL SELECT prompt_id, context_a FROM prompts WHERE mode_id = 1),
  changed AS (SELECT DISTINCT p.prompt_id, e.file_path AS path FROM prompts p JOIN entries e ON abs(epoch_us(e.ts) - epoch_us(p.ts)) <= 300000000),
  cp AS (SELECT prompt_id, count(*) AS n_context, cast(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS bigint) AS n_used FROM (SELECT c.prompt_id, h.path IS NOT NULL AS hit FROM ctx c LEFT JOIN changed h ON c.prompt_id = h.prompt_id AND c.path = h.path) y GROUP BY prompt_id)"""


def _precision(t: Tables) -> DataFrame:
    p = t.prompts
    ctx = p.select("prompt_id", F.explode(F.when(F.col("mode_id") == 1, F.array("context_a", "context_b", "context_a")).otherwise(F.array("context_a", "context_b"))).alias("path"))
    near = links.band_join(p.select("prompt_id", F.col("ts").alias("p_ts")), t.entries.select(F.col("file_path").alias("path"), F.col("ts").alias("e_ts")), "p_ts", "e_ts", 300)
    return context.context_precision(ctx, near.select("prompt_id", "path"))


@query("j17_context_precision", f"WITH {CONTEXT} SELECT prompt_id, n_context, n_used, n_used / n_context AS cp FROM cp")
def context_precision(t: Tables) -> DataFrame:
    return _precision(t)


@query("a08_precision_summary", f"""WITH {CONTEXT} SELECT count(*) AS n, round(avg(v), 6) AS mean_cp, round(median(v), 6) AS median_cp, min(v) AS min_cp, max(v) AS max_cp,
  count(*) FILTER (WHERE b = 0) AS bucket_0, count(*) FILTER (WHERE b = 1) AS bucket_1, count(*) FILTER (WHERE b = 2) AS bucket_2, count(*) FILTER (WHERE b = 3) AS bucket_3, count(*) FILTER (WHERE b = 4) AS bucket_4
  FROM (SELECT n_used / n_context AS v, least(floor(n_used / n_context * 5 + 1e-9), 4) AS b FROM cp) z""")
def precision_summary(t: Tables) -> DataFrame:
    return context.precision_summary(_precision(t))


@query("j21_import_merge", """SELECT coalesce(n.prompt_id, o.prompt_id) AS prompt_id, coalesce(n.mode_id, o.mode_id) AS mode_id FROM (SELECT prompt_id, CASE WHEN mode_id < 2 THEN mode_id + 10 END AS mode_id FROM prompts WHERE prompt_id % 2 = 0) n
  FULL JOIN (SELECT prompt_id, mode_id FROM prompts WHERE prompt_id % 3 = 0) o ON n.prompt_id = o.prompt_id""")
def import_merge(t: Tables) -> DataFrame:
    new = t.prompts.where("prompt_id % 2 = 0").select("prompt_id", F.when(F.col("mode_id") < 2, F.col("mode_id") + 10).alias("mode_id"))
    return links.upsert(t.prompts.where("prompt_id % 3 = 0").select("prompt_id", "mode_id"), new, "prompt_id", "merge")


@query("j22_unsynced_prompts", "SELECT prompt_id FROM prompts p WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.prompt_id = p.prompt_id)")
def unsynced(t: Tables) -> DataFrame:
    return t.prompts.select("prompt_id").join(t.entries.select("prompt_id").where("prompt_id IS NOT NULL"), "prompt_id", "left_anti")


@query("a01_stats", """SELECT (SELECT count(*) FROM ev) AS n_events, (SELECT count(DISTINCT session_id) FROM ev) AS n_sessions, (SELECT count(*) FROM prompts) AS n_prompts, (SELECT count(*) FROM entries) AS n_entries,
  round(100.0 * (SELECT count(*) FROM entries WHERE prompt_id IS NOT NULL) / (SELECT count(*) FROM entries), 2) AS linked_pct""")
def stats(t: Tables) -> DataFrame:
    e = t.ev.agg(F.count("*").alias("n_events"), F.countDistinct("session_id").alias("n_sessions"))
    p = t.prompts.agg(F.count("*").alias("n_prompts"))
    n = t.entries.agg(F.count("*").alias("n_entries"), F.round(100.0 * F.count("prompt_id") / F.count("*"), 2).alias("linked_pct"))
    return e.crossJoin(p).crossJoin(n)  # one row each


@query("a02_max_ids", "SELECT coalesce(max(entry_id), 0) AS max_entry, (SELECT coalesce(max(prompt_id), 0) FROM prompts) AS max_prompt FROM entries")
def max_ids(t: Tables) -> DataFrame:
    return t.entries.agg(F.coalesce(F.max("entry_id"), F.lit(0)).alias("max_entry")).crossJoin(t.prompts.agg(F.coalesce(F.max("prompt_id"), F.lit(0)).alias("max_prompt")))


@query("a04_daily_stats", """SELECT cast(d.day AS varchar) AS day, d.n_events, d.n_prompts, w.workspace_path AS top_workspace FROM (SELECT cast(ts AS date) AS day, count(*) AS n_events, count(*) FILTER (WHERE type = 'prompt') AS n_prompts FROM ev GROUP BY 1) d
  JOIN (SELECT day, workspace_path FROM (SELECT cast(ts AS date) AS day, workspace_path, row_number() OVER (PARTITION BY cast(ts AS date) ORDER BY count(*) DESC, workspace_path) AS rn FROM ev GROUP BY 1, 2) x WHERE rn = 1) w ON d.day = w.day""")
def daily_stats(t: Tables) -> DataFrame:
    per = t.ev.groupBy(F.to_date("ts").cast("string").alias("day"), "workspace_path").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "prompt").alias("p"))
    best = F.min_by("workspace_path", F.struct((-F.col("n")).alias("n"), "workspace_path"))
    return per.groupBy("day").agg(F.sum("n").alias("n_events"), F.sum("p").alias("n_prompts"), best.alias("top_workspace"))


@query("a05_conditional_distinct", "SELECT workspace_path, count(DISTINCT CASE WHEN type = 'prompt' THEN session_id END) AS prompting, count(DISTINCT CASE WHEN type = 'code_change' THEN file_path END) AS edited_files, max(ts) AS last_ts FROM ev GROUP BY workspace_path")
def conditional_distinct(t: Tables) -> DataFrame:
    return t.ev.groupBy("workspace_path").agg(F.countDistinct(F.when(F.col("type") == "prompt", F.col("session_id"))).alias("prompting"), F.countDistinct(F.when(F.col("type") == "code_change", F.col("file_path"))).alias("edited_files"), F.max("ts").alias("last_ts"))


@query("a06_workspace_activity", "SELECT workspace_path, cast(cast(ts AS date) AS varchar) AS day, count(DISTINCT session_id) AS n_sessions, count(*) AS n_events FROM ev GROUP BY 1, 2")
def workspace_activity(t: Tables) -> DataFrame:
    return t.ev.groupBy("workspace_path", F.to_date("ts").cast("string").alias("day")).agg(F.countDistinct("session_id").alias("n_sessions"), F.count("*").alias("n_events"))


@query("a07_context_analytics", "SELECT mode_id, cast(sum(CASE WHEN mode_id = 1 THEN 3 ELSE 2 END) AS bigint) AS n_context, count(DISTINCT context_a) AS distinct_a FROM prompts GROUP BY mode_id")
def context_analytics(t: Tables) -> DataFrame:
    files = F.when(F.col("mode_id") == 1, F.array("context_a", "context_b", "context_a")).otherwise(F.array("context_a", "context_b"))
    return t.prompts.groupBy("mode_id").agg(F.sum(F.size(files)).alias("n_context"), F.countDistinct("context_a").alias("distinct_a"))


@query("a09_metrics", "SELECT round(avg(lines_added), 6) AS mean, median(lines_added) AS median, round(stddev_pop(lines_added), 6) AS std, min(lines_added) AS low, max(lines_added) AS high, count(*) AS n FROM ev")
def metrics(t: Tables) -> DataFrame:
    v = "lines_added"
    return t.ev.agg(F.round(F.avg(v), 6).alias("mean"), F.median(v).alias("median"), F.round(F.stddev_pop(v), 6).alias("std"), F.min(v).alias("low"), F.max(v).alias("high"), F.count("*").alias("n"))


@query("a10_terminal_stats", """SELECT word, n, errors FROM (SELECT split_part(command, ' ', 1) AS word, count(*) AS n, count(*) FILTER (WHERE exit_code <> 0) AS errors FROM terminal GROUP BY 1) x ORDER BY n DESC, word LIMIT 10""")
def terminal_stats(t: Tables) -> DataFrame:
    return t.terminal.groupBy(F.split("command", " ")[0].alias("word")).agg(F.count("*").alias("n"), F.count_if(F.col("exit_code") != 0).alias("errors")).orderBy(F.desc("n"), "word").limit(10)


@query("a12_operation_types", "SELECT op, cast(sum(n) AS bigint) AS n FROM (SELECT 'add' AS op, lines_added AS n FROM entries UNION ALL SELECT 'delete', lines_removed FROM entries) x GROUP BY op")
def operation_types(t: Tables) -> DataFrame:
    ops = F.explode(F.create_map(F.lit("add"), "lines_added", F.lit("delete"), "lines_removed")).alias("op", "n")
    return t.entries.select(ops).groupBy("op").agg(F.sum("n").alias("n"))


@query("a13_function_stats", "SELECT type, ext, count(*) AS n FROM (SELECT type, regexp_extract(file_path, '(\\.[a-z]+)$', 1) AS ext FROM entries) x GROUP BY GROUPING SETS ((type), (ext))")
def function_stats(t: Tables) -> DataFrame:
    x = t.entries.select("type", X.extension(F.col("file_path")).alias("ext"))
    return x.groupingSets([["type"], ["ext"]], "type", "ext").agg(F.count("*").alias("n"))


@query("a15_file_action_stats", """SELECT file_path, count(*) FILTER (WHERE type = 'code_change') AS edits, count(*) FILTER (WHERE type = 'file_open') AS opens, count(DISTINCT session_id) AS sessions,
  cast(sum(lines_added) AS bigint) AS lines_added FROM ev GROUP BY file_path""")
def file_action_stats(t: Tables) -> DataFrame:
    return t.ev.groupBy("file_path").agg(F.count_if(F.col("type") == "code_change").alias("edits"), F.count_if(F.col("type") == "file_open").alias("opens"), F.countDistinct("session_id").alias("sessions"), F.sum("lines_added").alias("lines_added"))


@query("a14_files_representation", """SELECT session_id, string_agg(part, ' | ' ORDER BY part) AS files FROM (SELECT session_id, concat(file_path, ':e', count(*) FILTER (WHERE type = 'code_change'), ':n', count(*) FILTER (WHERE type = 'file_open')) AS part
  FROM ev GROUP BY session_id, file_path) x GROUP BY session_id""")
def files_representation(t: Tables) -> DataFrame:
    per = t.ev.groupBy("session_id", "file_path").agg(F.count_if(F.col("type") == "code_change").alias("e"), F.count_if(F.col("type") == "file_open").alias("n"))
    part = F.concat("file_path", F.lit(":e"), F.col("e").cast("string"), F.lit(":n"), F.col("n").cast("string"))
    return per.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list(part)), " | ").alias("files"))


@query("a18_context_stats", "SELECT regexp_extract(path, '(\\.[a-z]+)$', 1) AS ext, count(*) AS n, count(DISTINCT path) AS files FROM (SELECT context_a AS path FROM prompts UNION ALL SELECT context_b FROM prompts) x GROUP BY 1")
def context_stats(t: Tables) -> DataFrame:
    paths = t.prompts.select(F.explode(F.array("context_a", "context_b")).alias("path"))
    return paths.groupBy(X.extension(F.col("path")).alias("ext")).agg(F.count("*").alias("n"), F.countDistinct("path").alias("files"))


@query("a22_conversation_hierarchy", """SELECT conv_id % 7 AS workspace, count(DISTINCT conv_id) AS conversations, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS user_turns, max(n) AS longest
  FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) x GROUP BY 1""")
def conversation_hierarchy(t: Tables) -> DataFrame:
    per = t.raw("conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("u"))
    return per.groupBy((F.col("conv_id") % 7).alias("workspace")).agg(F.count("*").alias("conversations"), F.sum("n").alias("turns"), F.sum("u").alias("user_turns"), F.max("n").alias("longest"))


@query("a23_trace_stats", "SELECT count(*) AS sessions, cast(sum(n) AS bigint) AS events, round(avg(n), 6) AS mean_events, count(DISTINCT w) AS workspaces FROM (SELECT session_id, count(*) AS n, min(workspace_path) AS w FROM ev GROUP BY session_id) x")
def trace_stats(t: Tables) -> DataFrame:
    per = t.ev.groupBy("session_id").agg(F.count("*").alias("n"), F.min("workspace_path").alias("w"))
    return per.agg(F.count("*").alias("sessions"), F.sum("n").alias("events"), F.round(F.avg("n"), 6).alias("mean_events"), F.countDistinct("w").alias("workspaces"))


@query("a28_table_counts", "SELECT 'entries' AS name, count(*) AS n FROM entries UNION ALL SELECT 'prompts', count(*) FROM prompts UNION ALL SELECT 'terminal', count(*) FROM terminal")
def table_counts(t: Tables) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in (("entries", t.entries), ("prompts", t.prompts), ("terminal", t.terminal))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("a29_performance_metrics", """SELECT type, count(*) AS n, cast(sum(lines_added) AS bigint) AS total, min(lines_added) AS low, max(lines_added) AS high, count(*) FILTER (WHERE lines_added > 60) AS slow FROM ev GROUP BY type""")
def performance_metrics(t: Tables) -> DataFrame:
    v = "lines_added"
    return t.ev.groupBy("type").agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"), F.count_if(F.col(v) > 60).alias("slow"))


@query("a34_queue_stats", "SELECT type, count(*) AS n, min(ts) AS oldest, max(ts) AS newest FROM ev GROUP BY type")
def queue_stats(t: Tables) -> DataFrame:
    return t.ev.groupBy("type").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


@query("a32_first_last_change", "SELECT file_path, min(nullif(lines_added, 0)) AS first_seen, max(nullif(lines_added, 0)) AS last_seen FROM entries GROUP BY file_path")
def first_last(t: Tables) -> DataFrame:
    v = F.nullif(F.col("lines_added"), F.lit(0))
    return t.entries.groupBy("file_path").agg(F.min(v).alias("first_seen"), F.max(v).alias("last_seen"))


@query("u01_activity_feed", "SELECT concat('entry_', entry_id) AS id, ts, type, file_path FROM entries UNION ALL SELECT concat('prompt_', prompt_id), ts, 'prompt', NULL FROM prompts")
def activity_feed(t: Tables) -> DataFrame:
    e = t.entries.select(F.concat(F.lit("entry_"), F.col("entry_id").cast("string")).alias("id"), "ts", "type", "file_path")
    p = t.prompts.select(F.concat(F.lit("prompt_"), F.col("prompt_id").cast("string")).alias("id"), "ts", F.lit("prompt").alias("type"))
    return e.unionByName(p, allowMissingColumns=True)


@query("u04_ordered_distinct", "SELECT session_id, file_path, min(ts) AS first_ts FROM ev GROUP BY session_id, file_path")
def ordered_distinct(t: Tables) -> DataFrame:
    return t.ev.groupBy("session_id", "file_path").agg(F.min("ts").alias("first_ts"))


@query("u07_context_kept_and_dropped", f"WITH {CONTEXT} SELECT prompt_id, n_used AS kept, n_context - n_used AS dropped FROM cp")
def kept_and_dropped(t: Tables) -> DataFrame:
    return _precision(t).select("prompt_id", F.col("n_used").alias("kept"), (F.col("n_context") - F.col("n_used")).alias("dropped"))


@query("u08_edge_except", "SELECT DISTINCT file_path FROM ev WHERE type = 'code_change' EXCEPT SELECT file_path FROM ev WHERE type = 'entry_created' AND event_id % 4 = 0")
def edge_except(t: Tables) -> DataFrame:
    return t.ev.where("type = 'code_change'").select("file_path").subtract(t.ev.where("type = 'entry_created' AND event_id % 4 = 0").select("file_path"))


@query("u09_train_split", "SELECT entry_id FROM (SELECT entry_id, row_number() OVER (ORDER BY ts, entry_id) AS rn, count(*) OVER () AS n FROM entries) x WHERE rn <= floor(0.9 * n)")
def train_split(t: Tables) -> DataFrame:
    from tracewright.sources.files import split_positions

    return split_positions(t.entries.select("entry_id", "ts"), ["ts", "entry_id"])[0].select("entry_id")


@query("o02_null_aware_order", "SELECT entry_id, prompt_id FROM entries ORDER BY prompt_id IS NULL, prompt_id, entry_id")
def null_aware_order(t: Tables) -> DataFrame:
    return t.entries.select("entry_id", "prompt_id").orderBy(F.col("prompt_id").isNull(), "prompt_id", "entry_id")


@query("o04_keywords", """SELECT prompt_id, word, n FROM (SELECT prompt_id, word, count(*) AS n, row_number() OVER (PARTITION BY prompt_id ORDER BY count(*) DESC, word) AS rn FROM
  (SELECT prompt_id, unnest(regexp_split_to_array(lower(text), '[ \\n\\t]+')) AS word FROM prompts) x WHERE length(word) > 3 GROUP BY prompt_id, word) y WHERE rn <= 10""")
def keywords(t: Tables) -> DataFrame:
    words = t.said.select("prompt_id", F.explode(F.split(F.lower("text"), "[ \\n\\t]+")).alias("word")).where(F.length("word") > 3).groupBy("prompt_id", "word").agg(F.count("*").alias("n"))
    return words.withColumn("rn", F.row_number().over(Window.partitionBy("prompt_id").orderBy(F.desc("n"), "word"))).where("rn <= 10").drop("rn")


@query("o09_workspace_order", "SELECT workspace_path, max(ts) AS last_activity FROM ev GROUP BY workspace_path ORDER BY last_activity DESC, workspace_path LIMIT 5")
def workspace_order(t: Tables) -> DataFrame:
    return t.ev.groupBy("workspace_path").agg(F.max("ts").alias("last_activity")).orderBy(F.desc("last_activity"), "workspace_path").limit(5)


@query("d01_last_write_wins", "SELECT file_path, entry_id, ts FROM (SELECT file_path, entry_id, ts, row_number() OVER (PARTITION BY file_path ORDER BY entry_id DESC) AS rn FROM entries) x WHERE rn = 1")
def last_write_wins(t: Tables) -> DataFrame:
    return links.last_write(t.entries.select("file_path", "entry_id", "ts"), "file_path", "entry_id")


@query("t09_retention", "SELECT count(*) AS kept FROM ev WHERE ts >= (SELECT max(ts) FROM ev) - INTERVAL 7 DAY")
def retention(t: Tables) -> DataFrame:
    last = t.ev.agg(F.max("ts").alias("m"))  # one row
    return t.ev.select("ts").crossJoin(F.broadcast(last)).where("ts >= m - INTERVAL 7 DAY").agg(F.count("*").alias("kept"))
