"""Intents, descriptions, abstractions, contexts and states as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import events as E
from tracewright.functions import text as X
from tracewright.functions.time import micros
from tracewright.operators import context, graph, sessions, vectors
from tracewright.plans.registry import query
from tracewright.plans.sequences import GRAMS, INTENTS, NOTED, _noted
from tracewright.sources.telemetry import Tables

NOTES = f"noted AS ({NOTED.replace('{ev}', 'ev')})"


def _case(text: str, rules: tuple, other: str) -> str:
    whens = " ".join("WHEN " + " OR ".join(f"contains({text}, '{w}')" for w in words) + f" THEN '{label}'" for label, words in rules)
    return f"CASE {whens} ELSE {other} END"


LEGACY = _case("lower(type)", tuple((label, (part,)) for part, label in E.LEGACY_TYPES), _case("lower(coalesce(annotation, ''))", E.LEGACY_NOTES, "upper(left(type, 10))"))


@query("f03_legacy_symbols", f"WITH {NOTES} SELECT event_id, {LEGACY} AS symbol FROM noted")
def legacy_symbols(t: Tables) -> DataFrame:
    return _noted(t).select("event_id", E.legacy_symbol(F.col("type"), F.col("annotation")).alias("symbol"))


@query("f35_first_intent", f"SELECT prompt_id, coalesce(split_part(nullif(concat_ws(',', {INTENTS}), ''), ',', 1), 'INTENT_OTHER') AS intent FROM (SELECT prompt_id, lower(text) AS low FROM prompts) x")
def first_intent(t: Tables) -> DataFrame:
    return t.said.select("prompt_id", X.intents(F.col("text"))[0].alias("intent"))


EVENT_INTENT = _case("lower(coalesce(annotation, ''))", E.NOTE_INTENTS, "CASE WHEN contains(lower(file_path), 'test') OR contains(lower(file_path), 'spec') THEN 'testing' ELSE 'general' END")
EVENT_TOPIC = _case("lower(coalesce(annotation, ''))", tuple((x, (x,)) for x in E.NOTE_TOPICS), _case("lower(file_path)", E.PATH_TOPICS, "NULL"))
EVENT_FILES = r"list_filter([file_path, nullif(regexp_extract(coalesce(annotation, ''), '[\w/\-.]+\.(js|tsx|ts|jsx|py|java|go|rs|cpp|c|h|json|yaml|yml)', 0), '')], lambda x: x IS NOT NULL)"


@query("f43_event_facts", f"WITH {NOTES} SELECT event_id, {EVENT_INTENT} AS intent, {EVENT_TOPIC} AS topic, array_to_string({EVENT_FILES}, ',') AS files FROM noted")
def event_facts(t: Tables) -> DataFrame:
    a, p = F.col("annotation"), F.col("file_path")
    return _noted(t).select("event_id", E.event_intent(a, p).alias("intent"), E.event_topic(a, p).alias("topic"), F.array_join(E.event_files(a, p), ",").alias("files"))


PATH_PART = _case("lower(file_path)", (("test-related", ("test",)), ("configuration", ("config", ".env")), ("documentation", ("readme", ".md"))), "NULL")
DESCRIBED = f"""coalesce(nullif(concat_ws(' | ', CASE WHEN length(summary) > 10 THEN left(summary, 100) END, CASE WHEN length(prompt) > 5 THEN concat('prompted: ', left(lower(prompt), 200)) END,
  CASE WHEN lines_added > 50 THEN 'large addition' WHEN lines_removed > lines_added * 2 THEN 'major deletion or refactor' WHEN lines_added > 0 AND lines_removed > 0 THEN 'modification' END,
  {PATH_PART}, CASE WHEN contains(type, 'create') THEN 'creating new file' WHEN contains(type, 'delete') THEN 'removing file' END), ''), 'general code change')"""
SUMMED = "facts AS (SELECT *, CASE WHEN k % 3 = 0 THEN concat('changed part ', cast(k AS string), ' of it') ELSE 'short' END AS summary, CASE WHEN type = 'prompt' THEN concat('Please do ', cast(k AS string)) END AS prompt FROM noted)"


def _facts(t: Tables) -> DataFrame:
    noted = _noted(t)
    return t.spark.sql(SUMMED.removeprefix("facts AS (").removesuffix(")").replace("FROM noted", "FROM {noted}"), noted=noted)


@query("f39_described_events", f"WITH {NOTES}, {SUMMED} SELECT event_id, {DESCRIBED} AS description FROM facts")
def described_events(t: Tables) -> DataFrame:
    cols = [F.col(c) for c in ("type", "file_path", "summary", "lines_added", "lines_removed", "prompt")]
    return _facts(t).select("event_id", E.described(*cols).alias("description"))


@query("f40_intent_descriptions", f"WITH {NOTES}, {SUMMED} SELECT event_id, CASE WHEN length(annotation) > 5 THEN annotation ELSE {DESCRIBED} END AS description FROM facts")
def intent_descriptions(t: Tables) -> DataFrame:
    cols = [F.col(c) for c in ("annotation", "type", "file_path", "summary", "lines_added", "lines_removed", "prompt")]
    return _facts(t).select("event_id", E.intent_description(*cols).alias("description"))


SIGNS = [f"CASE WHEN {' OR '.join(f'contains(lower(file_path), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{label}' END" for label, words in E.PATH_SIGNS.items()]
SIGNS += [f"CASE WHEN {' OR '.join(f'contains(lower(summary), {chr(39)}{w}{chr(39)})' for w in words)} THEN '{label}' END" for label, words in E.SUMMARY_SIGNS.items()]
SIGNS += ["CASE WHEN lines_added > 30 AND lines_added > lines_removed * 1.5 THEN 'INTENT_FEATURE' END", "CASE WHEN lines_removed > lines_added * 2 AND lines_removed > 20 THEN 'INTENT_REFACTOR' END"]
SIGNS += ["CASE WHEN type IN ('navigate', 'search', 'goto', 'file_open') THEN 'INTENT_NAVIGATE' END"]
LABELS = f"list_filter([{', '.join(SIGNS)}], lambda x: x IS NOT NULL)"


def _event_labels(x: DataFrame) -> DataFrame:
    cols = [F.col(c) for c in ("file_path", "summary", "lines_added", "lines_removed", "type")]
    return x.withColumn("labels", E.event_intents(*cols))


@query("f37_intent_tokens", f"""WITH {NOTES}, {SUMMED}, own AS (SELECT event_id, unnest(CASE WHEN len({LABELS}) = 0 THEN ['INTENT_OTHER'] ELSE {LABELS} END) AS token FROM facts WHERE type <> 'prompt'),
  said AS (SELECT prompt_id AS event_id, unnest(string_split(coalesce(nullif(concat_ws(',', {INTENTS}), ''), 'INTENT_OTHER'), ',')) AS token FROM (SELECT prompt_id, lower(text) AS low FROM prompts) x)
  SELECT token, count(*) AS n FROM (SELECT DISTINCT event_id, token FROM own UNION ALL SELECT event_id, token FROM said) y GROUP BY token""")
def intent_tokens(t: Tables) -> DataFrame:
    """Labels of events by their facts and of prompts by their words, one token each."""
    own = _event_labels(_facts(t).where("type <> 'prompt'")).select("event_id", F.explode("labels").alias("token"))
    said = t.prompts.select(F.col("prompt_id").alias("event_id"), F.explode(X.intents(F.col("text"))).alias("token"))
    return own.unionByName(said).groupBy("token").agg(F.count("*").alias("n"))


@query("f38_intent_facade", f"WITH {NOTES}, {SUMMED} SELECT event_id, CASE WHEN len({LABELS}) = 0 THEN 'INTENT_OTHER' ELSE {LABELS}[1] END AS keyword, CASE WHEN length(annotation) > 5 THEN annotation ELSE {DESCRIBED} END AS description FROM facts")
def intent_facade(t: Tables) -> DataFrame:
    """One event's intent by either method that needs no model."""
    cols = [F.col(c) for c in ("annotation", "type", "file_path", "summary", "lines_added", "lines_removed", "prompt")]
    return _event_labels(_facts(t)).select("event_id", F.col("labels")[0].alias("keyword"), E.intent_description(*cols).alias("description"))


NAME = "regexp_extract(file_path, '([^/]*)$', 1)"
DOMAIN = _case(f"lower({NAME})", E.DOMAINS, "'code'")
STATS = "stats AS (SELECT entry_id, file_path, greatest(0, lines_added) AS a, lines_removed AS r, cast(length(coalesce(after_code, '')) AS bigint) AS ca, cast(length(coalesce(before_code, '')) AS bigint) AS cr FROM entries)"
ACTION = "CASE WHEN a > r * 2 AND a + r > 50 THEN 'added functionality to' WHEN r > a * 2 AND a + r > 50 THEN 'removed code from' WHEN abs(a - r) < 10 THEN 'refactored' WHEN a > r * 2 THEN 'added code to' WHEN r > a * 2 THEN 'removed code from' ELSE 'modified' END"


@query("f51_code_abstracts", f"""WITH {STATS} SELECT entry_id, concat('Modified ', {NAME}, CASE WHEN a > 0 OR r > 0 THEN concat(' (+', a, '/-', r, ' lines)') ELSE '' END) AS head, ca > 0 OR cr > 0 AS sized,
  concat({ACTION}, ' ', {DOMAIN}, ' in ', {NAME}) AS statement, CASE WHEN a > r * 2 AND a + r > 50 THEN concat('adding_', {DOMAIN}, '_feature') WHEN r > a THEN concat('removing_', {DOMAIN}, '_code') ELSE concat('modifying_', {DOMAIN}) END AS workflow FROM stats""")
def code_abstracts(t: Tables) -> DataFrame:
    name = X.basename(F.col("file_path"))
    a, r = F.greatest(F.lit(0), F.col("lines_added")), F.col("lines_removed")
    ca, cr = (F.length(F.coalesce(c, F.lit(""))).cast("long") for c in ("after_code", "before_code"))
    whole = E.code_abstract(name, a, r, ca, cr)
    head = F.regexp_replace(whole, r" \([0-9.]+KB added, [0-9.]+KB removed\)$", "")
    return t.entries.select("entry_id", head.alias("head"), (whole != head).alias("sized"), E.code_statement(name, a, r).alias("statement"), E.code_workflow(name, a, r).alias("workflow"))


@query("f52_prompt_abstracts", f"""SELECT prompt_id, CASE WHEN length(text) < 20 THEN concat('Short prompt (', length(text), ' chars)') WHEN length(regexp_extract(text, '^[^.!?]*', 0)) < 100 THEN regexp_extract(text, '^[^.!?]*', 0) ELSE concat(substr(text, 1, 100), '...') END AS abstract,
  {_case("lower(text)", E.STATEMENTS, "'AI interaction'")} AS statement, {_case("lower(text)", E.WORKFLOWS, "'general_interaction'")} AS workflow FROM prompts""")
def prompt_abstracts(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.said.select("prompt_id", E.prompt_abstract(x).alias("abstract"), E.prompt_statement(x).alias("statement"), E.prompt_workflow(x).alias("workflow"))


#: Contexts of prompts in each of the forms in which they come.
GIVEN = """SELECT prompt_id, ts, session_id, workspace_path, context_a, context_b, mode_id, CASE prompt_id % 6 WHEN 0 THEN concat('["', context_a, '", "', context_b, '", ""]')
  WHEN 1 THEN concat('[{"path": "', context_a, '"}, {"fileName": "', context_b, '"}]') WHEN 2 THEN concat('{"attachedFiles": [{"path": "', context_a, '"}], "files": ["no.py"]}')
  WHEN 3 THEN concat('{"codebaseFiles": [{"fileName": "', context_b, '"}]}') WHEN 4 THEN concat('{"files": ["', context_a, '", {"path": "', context_b, '"}]}') ELSE 'not json' END AS context FROM {prompts} p"""
FORMS = f"given AS ({GIVEN.replace('{prompts}', 'prompts')}), named AS (SELECT prompt_id, ts, CASE prompt_id % 6 WHEN 2 THEN [context_a] WHEN 3 THEN [context_b] WHEN 5 THEN [] ELSE [context_a, context_b] END AS files FROM given)"


def _given(t: Tables) -> DataFrame:
    braces = GIVEN.replace("{", "{{").replace("}", "}}").replace("{{prompts}}", "{prompts}")
    return t.spark.sql(braces, prompts=t.prompts)


@query("f30_context_files", f"WITH {FORMS} SELECT prompt_id, array_to_string(files, ',') AS files FROM named")
def context_files(t: Tables) -> DataFrame:
    return _given(t).select("prompt_id", F.array_join(E.context_files(F.col("context")), ",").alias("files"))


CHANGED = "changed AS (SELECT DISTINCT p.prompt_id, e.file_path AS path FROM prompts p JOIN entries e ON e.workspace_path = p.workspace_path AND epoch_us(e.ts) BETWEEN epoch_us(p.ts) AND epoch_us(p.ts) + 1800000000)"


@query("v19_context_precision", f"""WITH {FORMS}, {CHANGED}, per AS (SELECT prompt_id, unnest(files) AS path FROM named) SELECT n.prompt_id, len(n.files) AS n_context,
  (SELECT count(*) FROM per JOIN changed USING (prompt_id, path) WHERE per.prompt_id = n.prompt_id) AS n_used, round(CASE WHEN len(n.files) = 0 THEN 0.0 ELSE (SELECT count(*) FROM per JOIN changed USING (prompt_id, path) WHERE per.prompt_id = n.prompt_id)::double / len(n.files) END, 9) AS cp FROM named n""")
def context_precision(t: Tables) -> DataFrame:
    """Of every prompt the share of its context that a change of its workspace in the next half hour touches."""
    from tracewright.operators import links

    given = _given(t).select("prompt_id", "ts", "workspace_path", E.context_files(F.col("context")).alias("files"))
    p, e = given.select("prompt_id", F.col("ts").alias("p_ts"), F.col("workspace_path").alias("p_ws")), t.entries.select("file_path", F.col("ts").alias("e_ts"), F.col("workspace_path").alias("e_ws"))
    changed = links.band_join(p, e, "p_ts", "e_ts", 1800, ("p_ws", "e_ws")).where(micros("e_ts") >= micros("p_ts")).select("prompt_id", F.col("file_path").alias("path"))
    per = context.context_precision(given.select("prompt_id", F.explode("files").alias("path")), changed)
    zero = {"n_context": 0, "n_used": 0, "cp": 0.0}
    return given.select("prompt_id").join(per, "prompt_id", "left").na.fill(zero).select("prompt_id", "n_context", "n_used", F.round("cp", 9).alias("cp"))


@query("p28_context_snapshots", f"WITH {FORMS} SELECT prompt_id, len(files) AS n_files FROM named WHERE ts >= TIMESTAMP '2024-01-04'")
def context_snapshots(t: Tables) -> DataFrame:
    x = _given(t).where("ts >= TIMESTAMP_NTZ '2024-01-04'")
    return x.select("prompt_id", F.size(E.context_files(F.col("context"))).cast("long").alias("n_files"))


@query("f47_composer_files", "SELECT prompt_id, context_a AS path, regexp_extract(context_a, '([^/]*)$', 1) AS name, 'attached' AS type FROM prompts UNION ALL SELECT prompt_id, context_b, regexp_extract(context_b, '([^/]*)$', 1), 'codebase' FROM prompts WHERE mode_id > 1")
def composer_files(t: Tables) -> DataFrame:
    """Attached, codebase and mentioned files of a composer's JSON."""
    file = lambda c: F.array(F.struct(F.col(c).alias("path")))
    data = F.to_json(F.struct(file("context_a").alias("files"), F.when(F.col("mode_id") > 1, file("context_b")).alias("context")))
    return context.composer_files(t.prompts.select("prompt_id", data.alias("data")), "prompt_id", "data")


@query("s45_prompt_contexts", f"WITH {FORMS} SELECT g.prompt_id, len(files) AS n_context, len(list_distinct(files)) AS n_distinct, g.mode_id > 1 AS has_codebase FROM given g JOIN named n ON g.prompt_id = n.prompt_id")
def prompt_contexts(t: Tables) -> DataFrame:
    files = E.context_files(F.col("context"))
    return _given(t).select("prompt_id", F.size(files).cast("long").alias("n_context"), F.size(F.array_distinct(files)).cast("long").alias("n_distinct"), (F.col("mode_id") > 1).alias("has_codebase"))


@query("j19_model_context_edges", "SELECT p.context_a AS source, e.file_path AS target, count(*) AS weight FROM prompts p JOIN entries e ON e.prompt_id = p.prompt_id WHERE p.context_a IN (SELECT file_path FROM ev) GROUP BY 1, 2")
def model_context_edges(t: Tables) -> DataFrame:
    """Files in the context of a changed file, for known files only."""
    p = t.prompts.select("prompt_id", F.col("context_a").alias("source"))
    pairs = t.entries.select("prompt_id", F.col("file_path").alias("target")).join(p, "prompt_id").drop("prompt_id")
    return graph.context_edges(pairs, t.ev.select("file_path"))


@query("v18_ranked_clusters", """WITH long AS (SELECT vec_id, label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), c AS (SELECT label % 2 AS cluster, dim, avg(x) AS m FROM long GROUP BY 1, 2),
  s AS (SELECT vec_id, cluster, sum(x * m) / sqrt(sum(x * x) * sum(m * m)) AS similarity FROM long JOIN c USING (dim) GROUP BY 1, 2)
  SELECT vec_id, cluster, rank, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(similarity, 9) DESC, cluster) AS rank FROM s) x""")
def ranked_clusters(t: Tables) -> DataFrame:
    """Clusters of the upper level by the similarity to each vector, the nearest first."""
    e = t.raw("embeddings")
    upper = vectors.centroids(e.select("vec_id", "embedding", (F.col("label") % 2).alias("label")))
    return vectors.ranked(e, upper).select("vec_id", "cluster", F.col("rank").cast("long").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query("v20_cluster_labels", """WITH w AS (SELECT doc_id % 5 AS cluster, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents WHERE text IS NOT NULL), n AS (SELECT cluster, word, count(*) AS n FROM w GROUP BY 1, 2)
  SELECT cluster, string_agg(word, ' ' ORDER BY rn) AS label FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, word) AS rn FROM n) x WHERE rn <= 4 GROUP BY cluster""")
def cluster_labels(t: Tables) -> DataFrame:
    """A label of four words for each cluster of texts: its most frequent ones."""
    words = t.raw("documents").select((F.col("doc_id") % 5).alias("cluster"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{4,})"))).alias("word"))
    per = words.groupBy("cluster", "word").agg(F.count("*").alias("n"))
    top = per.withColumn("rn", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "word"))).where("rn <= 4")
    return top.groupBy("cluster").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "word"))), lambda s: s["word"]), " ").alias("label"))


@query("w18_states")
def states(t: Tables) -> DataFrame:
    """Named states of sessions, of the same name in a workspace one."""
    noted = _noted(t).withColumn("intent", E.event_intent(F.col("annotation"), F.col("file_path")))
    found = sessions.state_groups(noted)
    name = F.concat_ws(" ", F.initcap("intent"), F.when(F.size("files") == 1, F.concat(F.lit("in "), X.basename(F.col("files")[0]))).otherwise(F.concat(F.lit("across "), F.size("files").cast("string"), F.lit(" files"))))
    return found.select("session_id", name.alias("name"), "intent", "n_events", "started").dropDuplicates(["session_id", "name"]).select("session_id", "name", "intent")


MOTIFS = f"""{GRAMS}, mined AS (SELECT session_id, concat('M_', substr(sha1(motif), 1, 10)) AS motif FROM grams GROUP BY session_id, motif HAVING count(*) >= 2),
  shaped AS (SELECT session_id, concat('HOTSPOT_', max(n)) AS motif FROM (SELECT session_id, file_path, count(*) AS n FROM ev GROUP BY 1, 2) x GROUP BY session_id HAVING max(n) > 5)"""


@query("r07_motif_sets", f"WITH {MOTIFS} SELECT DISTINCT session_id, motif FROM (SELECT * FROM mined UNION ALL SELECT * FROM shaped) y")
def motif_sets(t: Tables) -> DataFrame:
    """Mined motifs of a session's symbols and those of its files, each once."""
    return sessions.motif_representation(t.ev)
