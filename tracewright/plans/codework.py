"""Functions, imports, edits and tokens of code in several languages, as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import code as C
from tracewright.functions import events as E
from tracewright.functions import text as X
from tracewright.operators import encoders, graph, links, sessions
from tracewright.plans.registry import query
from tracewright.plans.sequences import EDGES, _edges, _nodes
from tracewright.sources import files
from tracewright.sources.telemetry import Tables

#: Code of five kinds of files, with comments, strings, calls, broken lines and imports that lead to known files.
SNIPPET = """SELECT event_id AS snip_id, session_id, workspace_path, file_path, ts, k,
  CASE k % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'typescript' WHEN 3 THEN 'markdown' ELSE 'json' END AS language,
  CASE k % 5
    WHEN 0 THEN concat('import os', chr(10), 'from pkg.m', cast(k % 10 AS string), ' import helper', chr(10), '# a note', chr(10), 'class C', cast(k % 4 AS string),
      '(Base):', chr(10), '  def run', cast(k % 13 AS string), '(self, a, b):', chr(10), '    s = "who@example.com"', chr(10),
      CASE WHEN k % 15 = 0 THEN '    if broken(' ELSE '    return helper(a, 3)' END, chr(10))
    WHEN 1 THEN concat('import x from "./f', cast((k + 5) % 100 AS string), '"', chr(10), 'const y = require("../m', cast((k + 2) % 10 AS string), '/f',
      cast((k + 2) % 100 AS string), '.md")', chr(10), '// a note', chr(10), 'export function go', cast(k % 11 AS string), '(a, b) {', chr(10), '  if (a == 1) { return call',
      cast(k % 6 AS string), '(b) }', chr(10), '}', chr(10), 'const arrow', cast(k % 3 AS string), ' = async (q) => {', chr(10), '}', chr(10))
    WHEN 2 THEN concat('import {A} from "./f', cast(k % 100 AS string), '";', chr(10), 'export function typed', cast(k % 7 AS string), '(a: number, b: string): boolean {', chr(10),
      '  return check(a);', chr(10), '}', chr(10), 'public async load', cast(k % 3 AS string), '() {', chr(10), '}', chr(10))
    WHEN 3 THEN concat('# Title', chr(10), 'see `src/m1/f', cast(k AS string), '.js` and docs/', cast(k % 9 AS string), '/a.md', chr(10))
    ELSE concat('{"name": "m', cast(k AS string), '", "port": 80', cast(k % 10 AS string), '}', chr(10)) END AS code
FROM {ev} ev WHERE type = 'code_change'"""
SNIPPETS = f"snippets AS ({SNIPPET.replace('{ev}', 'ev')})"
LINES = f"""{SNIPPETS}, ln AS (SELECT snip_id, language, file_path, unnest(string_split(code, chr(10))) AS text,
  generate_subscripts(string_split(code, chr(10)), 1) AS line FROM snippets)"""


def _snippets(t: Tables) -> DataFrame:
    braces = SNIPPET.replace("{", "{{").replace("}", "}}").replace("{{ev}}", "{ev}")
    return t.spark.sql(braces, ev=t.ev)


def _lines(t: Tables) -> DataFrame:
    return _snippets(t).select("snip_id", "language", "file_path", F.posexplode(F.split("code", "\n")).alias("at", "text")).withColumn("line", (F.col("at") + 1).cast("long")).drop("at")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _first(patterns: tuple[str, ...], text: str = "trim(text)") -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text}, {_quoted(p)}, 1), '')" for p in patterns) + ")"


DEFINED = "CASE language " + " ".join(f"WHEN '{k}' THEN {_first(v)}" for k, v in C.DEFINITIONS.items()) + f" ELSE {_first(C.DEFINITIONS['javascript'])} END"


def _defined(t: Tables) -> DataFrame:
    return _lines(t).withColumn("name", C.definition(F.col("text"), F.col("language"))).where("name IS NOT NULL")


@query("f56_functions", f"WITH {LINES} SELECT snip_id, line, name FROM (SELECT *, {DEFINED} AS name FROM ln) x WHERE name IS NOT NULL")
def functions(t: Tables) -> DataFrame:
    return _defined(t).select("snip_id", "line", "name")


@query("f57_signatures", f"""WITH {LINES}, d AS (SELECT *, {DEFINED} AS name FROM ln), own AS (SELECT snip_id, line, name, language, regexp_extract(text, '\\(([^)]*)\\)', 1) AS inner_text,
  (SELECT regexp_extract(string_agg(o.text, chr(10) ORDER BY o.line), ':\\s*(\\w+)', 1) FROM ln o WHERE o.snip_id = d.snip_id AND o.line BETWEEN d.line AND d.line + 9) AS typed FROM d WHERE name IS NOT NULL),
  s AS (SELECT *, len(list_filter(string_split(inner_text, ','), lambda x: trim(x) <> '')) AS params, CASE WHEN language IN ('typescript', 'java') AND typed <> '' THEN typed ELSE 'unknown' END AS returns FROM own)
  SELECT snip_id, line, name, params, returns, concat('FUNC_', params, '_', returns) AS signature FROM s""")
def signatures(t: Tables) -> DataFrame:
    read = _snippets(t).select("snip_id", F.explode(C.signatures("code", "language")).alias("s")).select("snip_id", F.col("s.line").cast("long").alias("line"), F.col("s.params").cast("long").alias("params"), "s.returns")
    named = _defined(t).select("snip_id", "line", "name").join(read, ["snip_id", "line"])
    return named.withColumn("signature", F.concat(F.lit("FUNC_"), F.col("params").cast("string"), F.lit("_"), "returns"))


@query("f64_simple_functions", f"""WITH {LINES} SELECT snip_id, line, name FROM (SELECT snip_id, line, CASE WHEN language IN ('javascript', 'typescript')
  THEN {_first((C.SIMPLE_DEFINITIONS["javascript"],), "text")} WHEN language = 'python' THEN {_first((C.SIMPLE_DEFINITIONS["python"],), "text")} END AS name FROM ln) x WHERE name IS NOT NULL""")
def simple_functions(t: Tables) -> DataFrame:
    return _lines(t).select("snip_id", "line", C.simple_definition(F.col("text"), F.col("language")).alias("name")).where("name IS NOT NULL")


def _kind_sql(text: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({text}, {_quoted(p)}) THEN '{k}'" for p, k in X.LINE_KINDS)
    return f"CASE WHEN {text} = '' OR starts_with({text}, '//') OR starts_with({text}, '#') THEN NULL {cases} END"


@query("f71_line_predicates", f"WITH {LINES} SELECT snip_id, line, kind FROM (SELECT snip_id, line, {_kind_sql('trim(text)')} AS kind FROM ln) x WHERE kind IS NOT NULL")
def line_predicates(t: Tables) -> DataFrame:
    return _lines(t).select("snip_id", "line", X.line_kind(F.trim("text")).alias("kind")).where("kind IS NOT NULL")


NODES = f"{LINES}, nodes AS (SELECT snip_id, line, kind FROM (SELECT snip_id, line, {_kind_sql('trim(text)')} AS kind FROM ln) x WHERE kind IS NOT NULL)"
OPERATION = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in C.OPERATIONS.items()) + " ELSE concat('MODIFY_', upper(kind)) END"


@query("f54_syntax_diff", f"""WITH {NODES}, pairs AS (SELECT snip_id, lag(snip_id) OVER (PARTITION BY file_path ORDER BY ts, snip_id) AS old_id FROM snippets),
  b AS (SELECT p.snip_id, line, kind FROM pairs p JOIN nodes n ON n.snip_id = p.old_id), a AS (SELECT * FROM nodes),
  ops AS (SELECT snip_id, {OPERATION} AS operation, line, 'add' AS change FROM a ANTI JOIN b USING (snip_id, line, kind)
    UNION ALL SELECT snip_id, replace({OPERATION}, 'ADD_', 'REMOVE_'), line, 'remove' FROM b ANTI JOIN a USING (snip_id, line, kind))
  SELECT * FROM ops UNION ALL SELECT snip_id, 'MODIFY_STATEMENT', 1, 'modify' FROM snippets WHERE snip_id NOT IN (SELECT snip_id FROM ops)""")
def syntax_diff(t: Tables) -> DataFrame:
    """Operations between a file's snippet and the one before it: nodes (kind and line) that came and went."""
    before = F.lag("code").over(Window.partitionBy("file_path").orderBy("ts", "snip_id"))
    pairs = _snippets(t).select("snip_id", "code", before.alias("before"))
    return encoders.syntax_diff(pairs, "snip_id", "before", "code")


IMPORTED = "CASE language " + " ".join("WHEN '" + k + "' THEN " + " || ".join(f"regexp_extract_all(text, {_quoted(p)}, 1)" for p in v) for k, v in C.LINE_IMPORTS.items()) + " ELSE [] END"


@query("f26_line_imports", f"WITH {LINES} SELECT snip_id, line, unnest({IMPORTED}) AS path FROM ln")
def line_imports(t: Tables) -> DataFrame:
    return _lines(t).select("snip_id", "line", F.explode(C.line_imports(F.col("text"), F.col("language"))).alias("path"))


@query("f72_imports_of_tagged_lines", f"WITH {LINES} SELECT snip_id, line, unnest({IMPORTED}) AS path FROM ln WHERE {_kind_sql('trim(text)')} = 'ImportDeclaration'")
def tagged_imports(t: Tables) -> DataFrame:
    x = _lines(t).where(X.line_kind(F.trim("text")) == "ImportDeclaration")
    return x.select("snip_id", "line", F.explode(C.line_imports(F.col("text"), F.col("language"))).alias("path"))


def _imports(t: Tables) -> DataFrame:
    return _lines(t).select("snip_id", "file_path", F.explode(C.line_imports(F.col("text"), F.col("language"))).alias("path"))


TRIED = ", ".join(f"'{e}'" for e in ("", *C.RESOLVED_SUFFIXES))
RESOLVED = f"""{LINES}, imp AS (SELECT DISTINCT file_path, unnest({IMPORTED}) AS path FROM ln),
  base AS (SELECT file_path, path, CASE WHEN starts_with(path, './') THEN concat(regexp_replace(file_path, '/?[^/]*$', ''), substr(path, 2)) WHEN starts_with(path, '../') THEN concat('src', substr(path, 3)) ELSE path END AS base FROM imp),
  tries AS (SELECT file_path, path, concat(base, unnest([{TRIED}])) AS target, unnest(range(7)) AS place FROM base),
  hits AS (SELECT file_path, path, arg_min(target, place) AS target FROM tries WHERE target IN (SELECT file_path FROM ev) GROUP BY 1, 2)"""


@query("f27_resolved_imports", f"WITH {RESOLVED} SELECT file_path, path, target FROM hits")
def resolved_imports(t: Tables) -> DataFrame:
    return encoders.resolved_imports(_imports(t), t.ev.select("file_path"))


@query("f28_fallback_imports", f"""WITH {LINES}, imp AS (SELECT DISTINCT file_path, regexp_replace(unnest({IMPORTED}), '\\.(js|ts|jsx|tsx|py)$', '') AS path FROM ln),
  base AS (SELECT file_path, path, CASE WHEN starts_with(path, './') THEN concat(regexp_replace(file_path, '/?[^/]*$', ''), substr(path, 2)) WHEN starts_with(path, '../') THEN concat('src', substr(path, 3)) ELSE concat('src/', path) END AS base FROM imp),
  tries AS (SELECT file_path, path, base, concat(base, unnest(['.js', '.ts', '.jsx', '.tsx', '.py', '.json'])) AS target, unnest(range(6)) AS place FROM base),
  hits AS (SELECT file_path, path, arg_min(target, place) AS target FROM tries WHERE target IN (SELECT file_path FROM ev) GROUP BY 1, 2)
  SELECT base.file_path, base.path, coalesce(target, base) AS target FROM base LEFT JOIN hits ON base.file_path = hits.file_path AND base.path = hits.path""")
def fallback_imports(t: Tables) -> DataFrame:
    return encoders.fallback_imports(_imports(t), t.ev.select("file_path"))


@query("f73_path_candidates", f"WITH {RESOLVED} SELECT path, target, place FROM (SELECT DISTINCT path, target, place FROM tries) x")
def path_candidates(t: Tables) -> DataFrame:
    return encoders.path_candidates(_imports(t)).select("path", "target", F.col("place").cast("long").alias("place")).distinct()


@query("j18_import_edges", f"WITH {RESOLVED} SELECT DISTINCT file_path AS source, target FROM hits WHERE target <> file_path")
def import_edges(t: Tables) -> DataFrame:
    return encoders.import_edges(_imports(t), t.ev.select("file_path"))


@query("f16_code_tokens")
def code_tokens(t: Tables) -> DataFrame:
    tokens = C.code_tokens(F.col("code"), F.col("language"))
    return _snippets(t).select("snip_id", "language", F.array_join(tokens, " ").alias("tokens"))


@query("f17_syntax_tokens", f"""WITH {SNIPPETS} SELECT snip_id, CASE WHEN k % 15 = 0 THEN NULL ELSE 'IMPORT IMPORT FROM CLASS IDENTIFIER IDENTIFIER FUNCTION IDENTIFIER ASSIGN RETURN IDENTIFIER STRING_LITERAL CALL IDENTIFIER IDENTIFIER NUMBER' END AS tokens
  FROM snippets WHERE language = 'python'""")
def syntax_tokens(t: Tables) -> DataFrame:
    return _snippets(t).where("language = 'python'").select("snip_id", F.array_join(C.syntax_tokens("code"), " ").alias("tokens"))


_STARTS = "|".join([*map(C._quoted, C.PREFIXES), "\"[^\"]*\"", "'[^']*'", "`[^`]*`", r"\d+(?:\.\d+)?", r"[A-Za-z_$][\w$]*"])
_NAMED = "CASE m " + " ".join(f"WHEN {_quoted(k)} THEN '{v}'" for k, v in C.PREFIXES.items())
_NAMED += " ELSE CASE WHEN regexp_matches(m, '^[\"''`]') THEN 'STRING_LITERAL' WHEN regexp_matches(m, '^[0-9]') THEN 'NUMBER' ELSE 'IDENTIFIER' END END"
TOKENS = f"""{LINES}, found AS (SELECT snip_id, language, line, unnest(regexp_extract_all(trim(text), {_quoted("(" + _STARTS + ")")}, 1)) AS m,
  generate_subscripts(regexp_extract_all(trim(text), {_quoted("(" + _STARTS + ")")}, 1), 1) AS place FROM ln),
  toks AS (SELECT snip_id, language, line, place, {_NAMED} AS token FROM found)"""


@query("f21_tokens", f"WITH {TOKENS} SELECT snip_id, string_agg(token, ' ' ORDER BY line, place) AS tokens FROM toks GROUP BY snip_id")
def tokens(t: Tables) -> DataFrame:
    return _snippets(t).select("snip_id", F.array_join(C.line_tokens(F.col("code")), " ").alias("tokens"))


HIDDEN = "CASE token WHEN 'STRING_LITERAL' THEN '<STR>' WHEN 'NUMBER' THEN '<NUM>' ELSE token END"


@query("f23_hidden_literals", f"WITH {TOKENS} SELECT snip_id, string_agg({HIDDEN}, ' ' ORDER BY line, place) AS tokens FROM toks GROUP BY snip_id")
def hidden_literals(t: Tables) -> DataFrame:
    return _snippets(t).select("snip_id", F.array_join(C.hidden_literals(C.line_tokens(F.col("code"))), " ").alias("tokens"))


@query("f24_counted_names", f"""WITH {TOKENS}, n AS (SELECT *, row_number() OVER (PARTITION BY snip_id ORDER BY line, place) AS spot, sum(CASE WHEN token = 'IDENTIFIER' THEN 1 ELSE 0 END) OVER (PARTITION BY snip_id ORDER BY line, place ROWS UNBOUNDED PRECEDING) AS i FROM toks)
  SELECT snip_id, string_agg(CASE WHEN token = 'IDENTIFIER' THEN concat('ID_', lpad(cast(i AS varchar), 3, '0')) ELSE token END, ' ' ORDER BY line, place) AS tokens FROM n WHERE spot <= 200 GROUP BY snip_id""")
def counted_names(t: Tables) -> DataFrame:
    return _snippets(t).select("snip_id", F.array_join(C.counted_names(C.line_tokens(F.col("code"))), " ").alias("tokens"))


REDACTED = "code"
for _pattern, _mask in (*X.PII, *X.STRING_LITERALS):
    REDACTED = f"regexp_replace({REDACTED}, {_quoted(_pattern)}, {_quoted(_mask)}, 'g')"


@query("f05_code_redaction", f"WITH {SNIPPETS} SELECT snip_id, {REDACTED} AS masked FROM snippets")
def code_redaction(t: Tables) -> DataFrame:
    return _snippets(t).select("snip_id", X.redact_code(F.col("code")).alias("masked"))


@query("f62_similarity")
def similarity(t: Tables) -> DataFrame:
    return t.entries.select("entry_id", F.round(C.similarity(F.coalesce("before_code", F.lit("")), F.coalesce("after_code", F.lit(""))), 9).alias("similarity"))


@query("f77_batch_diffs", """SELECT entry_id, chars, significant FROM (SELECT entry_id, length(coalesce(after_code, '')) - length(coalesce(before_code, '')) AS chars,
  abs(length(coalesce(after_code, '')) - length(coalesce(before_code, ''))) >= 25 AS significant FROM entries) x WHERE significant""")
def batch_diffs(t: Tables) -> DataFrame:
    d = t.entries.select("entry_id", X.net_diff(F.col("before_code"), F.col("after_code"), 25).alias("d"))
    return d.where("d.significant").select("entry_id", (F.col("d.chars_added") - F.col("d.chars_deleted")).cast("long").alias("chars"), "d.significant")


SIGNED = f"""{LINES}, d AS (SELECT *, {DEFINED} AS name FROM ln), sigs AS (SELECT d.snip_id, s.file_path, s.ts, name, line FROM d JOIN snippets s ON d.snip_id = s.snip_id WHERE name IS NOT NULL),
  old AS (SELECT snip_id, lag(snip_id) OVER (PARTITION BY file_path ORDER BY ts, snip_id) AS old_id FROM snippets)"""


@query("f74_moved_functions", f"WITH {SIGNED} SELECT a.snip_id, a.name, a.line, b.line AS old_line, a.line <> b.line AS moved FROM sigs a JOIN old o ON a.snip_id = o.snip_id JOIN sigs b ON b.snip_id = o.old_id AND b.name = a.name")
def moved_functions(t: Tables) -> DataFrame:
    """Functions of a snippet that the file's one before it has, too, and whether their line changed."""
    now = _defined(t).select("snip_id", "name", "line")
    pairs = _snippets(t).select("snip_id", F.lag("snip_id").over(Window.partitionBy("file_path").orderBy("ts", "snip_id")).alias("old_id")).where("old_id IS NOT NULL")
    old = now.select(F.col("snip_id").alias("old_id"), "name", F.col("line").alias("old_line"))
    return now.join(pairs, "snip_id").join(old, ["old_id", "name"]).select("snip_id", "name", "line", "old_line", (F.col("line") != F.col("old_line")).alias("moved"))


@query("f75_compared_edges", f"WITH {EDGES} SELECT source, target, CASE WHEN weight > 2 THEN 'weight' ELSE '' END AS changed FROM edges WHERE weight > 1")
def compared_edges(t: Tables) -> DataFrame:
    """Properties in which two graphs' edges of the same ends differ."""
    e = _edges(t)
    return graph.compared(e, e.where("weight > 1").withColumn("weight", F.least("weight", F.lit(2))))


@query("f11_motif_hashes", "SELECT DISTINCT type, concat('M_', substr(sha1(type), 1, 10)) AS motif FROM ev")
def motif_hashes(t: Tables) -> DataFrame:
    return t.ev.select("type", sessions.motif_hash(F.col("type")).alias("motif")).distinct()


@query("j13_edit_pairs", """WITH e AS (SELECT session_id, event_id, file_path, ts, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS pos FROM ev WHERE type = 'code_change'),
  n AS (SELECT a.session_id, a.event_id, a.file_path, a.ts, min(b.pos) AS next FROM e a JOIN e b ON a.session_id = b.session_id AND b.pos > a.pos AND b.file_path <> a.file_path GROUP BY 1, 2, 3, 4)
  SELECT n.event_id, n.file_path AS source, e.file_path AS target FROM n JOIN e ON n.session_id = e.session_id AND n.next = e.pos WHERE epoch_us(e.ts) - epoch_us(n.ts) <= 86400000000""")
def edit_pairs(t: Tables) -> DataFrame:
    return encoders.edit_pairs(t.ev.where("type = 'code_change'"), 86400).select("event_id", F.col("file_path").alias("source"), "target")


@query("w19_file_edits", "SELECT session_id, event_id, epoch_us(ts) AS at, file_path AS path FROM ev WHERE file_path IS NOT NULL")
def file_edits(t: Tables) -> DataFrame:
    return encoders.file_edits(t.ev)


@query("w15_structural_events", """SELECT f.file_id, entry_id AS diff_id, e.file_path, 'FILE_EDIT' AS event_type, row_number() OVER (PARTITION BY e.file_path ORDER BY ts, entry_id) AS seq FROM entries e
  JOIN (SELECT file_path, concat('FILE_', lpad(cast(row_number() OVER (ORDER BY file_path) AS varchar), 3, '0')) AS file_id FROM (SELECT DISTINCT file_path FROM ev) x) f ON e.file_path = f.file_path""")
def structural_events(t: Tables) -> DataFrame:
    ids = files.numbered(t.ev.select("file_path").distinct(), ["file_path"]).select("file_path", F.concat(F.lit("FILE_"), C.padded(F.col("n"))).alias("file_id"))
    seq = F.row_number().over(Window.partitionBy("file_path").orderBy("ts", "entry_id")).cast("long")
    return t.entries.select("file_path", F.col("entry_id").alias("diff_id"), F.lit("FILE_EDIT").alias("event_type"), seq.alias("seq")).join(ids, "file_path")


@query("r12_module_graph", f"WITH {EDGES} SELECT id, edits, coalesce(o, 0) AS out_degree FROM (SELECT file_path AS id, count(*) FILTER (WHERE type = 'code_change') AS edits FROM ev GROUP BY 1) n LEFT JOIN (SELECT source, count(*) AS o FROM edges GROUP BY 1) s ON n.id = s.source")
def module_graph(t: Tables) -> DataFrame:
    """Nodes with their edits and edges, as one table."""
    edits = t.ev.groupBy(F.col("file_path").alias("id")).agg(F.count_if(F.col("type") == "code_change").alias("edits"))
    return edits.join(graph.degrees(_nodes(t), _edges(t)).select("id", F.col("out_degree").cast("long").alias("out_degree")), "id")


@query("r13_incremental_tokens", f"WITH {SNIPPETS} SELECT snip_id, language FROM snippets")
def incremental_tokens(t: Tables) -> DataFrame:
    """What is stored first and what came later, extracted from where the first part ends."""
    from tracewright.plans.representations import _scratch

    path, rows = f"{_scratch(t)}.parquet", _snippets(t).select("snip_id", "language", "ts", F.array_join(C.line_tokens(F.col("code")), " ").alias("tokens"))
    middle = rows.agg(F.expr("timestampadd(SECOND, timestampdiff(SECOND, min(ts), max(ts)) div 2, min(ts))").alias("m"))
    rows.join(F.broadcast(middle), F.col("ts") <= F.col("m")).drop("m").write.parquet(path)
    last = t.spark.read.parquet(path).agg(F.max("ts").alias("m"))
    rows.join(F.broadcast(last), F.col("ts") > F.col("m")).drop("m").write.mode("append").parquet(path)
    return t.spark.read.parquet(path).select("snip_id", "language")


def _extracted(t: Tables) -> DataFrame:
    return _snippets(t).select("snip_id", "workspace_path", "language", "file_path", "ts", F.size(C.line_tokens(F.col("code"))).cast("long").alias("n_tokens"))


@query("p17_token_filters", f"WITH {TOKENS} SELECT s.snip_id, s.file_path, count(*) AS n_tokens FROM snippets s JOIN toks ON s.snip_id = toks.snip_id WHERE s.language = 'python' AND s.workspace_path = '/w/p3' GROUP BY 1, 2")
def token_filters(t: Tables) -> DataFrame:
    return links.filtered(_extracted(t), {"language": "python", "workspace_path": "/w/p3"}).select("snip_id", "file_path", "n_tokens")


@query("p18_edit_script_filters", f"WITH {NODES} SELECT s.snip_id, count(n.line) AS nodes FROM snippets s JOIN nodes n ON s.snip_id = n.snip_id WHERE s.language = 'javascript' AND s.ts >= TIMESTAMP '2024-01-03' GROUP BY 1")
def edit_script_filters(t: Tables) -> DataFrame:
    kept = links.filtered(_snippets(t), {"language": "javascript"}, since="2024-01-03").select("snip_id")
    nodes = _lines(t).where(X.line_kind(F.trim("text")).isNotNull())
    return nodes.join(kept, "snip_id", "left_semi").groupBy("snip_id").agg(F.count("*").alias("nodes"))


@query("p32_stored_functions", f"WITH {LINES} SELECT snip_id, name, line FROM (SELECT snip_id, line, {DEFINED} AS name FROM ln) x WHERE name IS NOT NULL")
def stored_functions(t: Tables) -> DataFrame:
    """Functions stored as JSON, read and parsed again."""
    from tracewright.plans.representations import _scratch

    path = f"{_scratch(t)}.parquet"
    _defined(t).select("snip_id", F.to_json(F.struct("name", "line")).alias("body")).write.parquet(path)
    return t.spark.read.parquet(path).select("snip_id", F.from_json("body", "name string, line long").alias("b")).select("snip_id", "b.*")


@query("p35_previews", f"WITH {SNIPPETS} SELECT snip_id AS id, language, file_path AS file FROM snippets ORDER BY ts DESC, snip_id LIMIT 20")
def previews(t: Tables) -> DataFrame:
    return _snippets(t).orderBy(F.desc("ts"), "snip_id").limit(20).select(F.col("snip_id").alias("id"), "language", F.col("file_path").alias("file"))


@query("d14_persisted_functions", f"WITH {LINES} SELECT file_path, name, max(snip_id) AS snip_id FROM (SELECT snip_id, file_path, {DEFINED} AS name FROM ln) x WHERE name IS NOT NULL GROUP BY 1, 2")
def persisted_functions(t: Tables) -> DataFrame:
    """Functions written in bulk, of one file and name the last."""
    from tracewright.plans.representations import _scratch

    path, key = f"{_scratch(t)}.parquet", ["file_path", "name"]
    _defined(t).groupBy(*key).agg(F.max("snip_id").alias("snip_id")).write.parquet(path)
    return t.spark.read.parquet(path)


@query("f31_languages_of_snippets", f"WITH {SNIPPETS} SELECT language, count(*) AS n FROM snippets GROUP BY 1")
def languages(t: Tables) -> DataFrame:
    return _snippets(t).groupBy(E.language(F.col("file_path")).alias("language")).agg(F.count("*").alias("n"))


def _mentioned(text: Column) -> Column:
    return E.response_files(text)


@query("f46_response_files", f"""WITH {SNIPPETS}, m AS (SELECT snip_id, unnest(regexp_extract_all(code, '`([^`]+\\.[a-zA-Z]+)`', 1) || regexp_extract_all(code, '\\b([a-zA-Z0-9_-]+/[a-zA-Z0-9_/-]+\\.[a-zA-Z]+)\\b', 1)
  || regexp_extract_all(code, '[''"]([^''"]+\\.[a-zA-Z]+)[''"]', 1)) AS path FROM snippets) SELECT DISTINCT snip_id, path, regexp_extract(path, '([^/]*)$', 1) AS name FROM m WHERE length(path) > 2 AND length(path) < 200""")
def response_files(t: Tables) -> DataFrame:
    x = _snippets(t).select("snip_id", F.explode(_mentioned(F.col("code"))).alias("path"))
    return x.select("snip_id", "path", X.basename(F.col("path")).alias("name"))
