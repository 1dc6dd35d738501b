"""SQL for queries that other modules register, where it takes what they can't import."""

from __future__ import annotations

from tracewright.functions import text as X
from tracewright.plans.codework import _NAMED, _STARTS, _kind_sql, _quoted
from tracewright.plans.registry import check
from tracewright.plans.representations import CODES

KINDS = f"SELECT {_kind_sql('trim(line)')} AS kind FROM"
check("f53_line_kinds", f"SELECT kind, count(*) AS n FROM ({KINDS} (SELECT unnest(string_split(html, chr(10))) AS line FROM pages) x) y WHERE kind IS NOT NULL GROUP BY kind")
check("f76_edit_operations", f"WITH {CODES} SELECT concat('MODIFY_', upper(kind)) AS operation, count(*) AS n FROM ({KINDS} (SELECT unnest(string_split(code, chr(10))) AS line FROM codes) x) y WHERE kind IS NOT NULL GROUP BY 1")

_SCORES = [" + ".join(f"cast(contains(low, '{w}') AS int)" for w in words) for words in X.PROMPT_INTENTS.values()]
_BEST = f"CASE WHEN {' AND '.join(f's{i} = 0' for i in range(len(_SCORES)))} THEN 'general' " + " ".join(f"WHEN s{i} = greatest({', '.join(f's{j}' for j in range(len(_SCORES)))}) THEN '{x}'" for i, x in enumerate(X.PROMPT_INTENTS)) + " END"
ONE_INTENT = f"SELECT prompt_id, text, {_BEST} AS intent FROM (SELECT prompt_id, text, {', '.join(f'{s} AS s{i}' for i, s in enumerate(_SCORES))} FROM (SELECT prompt_id, text, lower(text) AS low FROM prompts) x) y"
check("f41_prompt_intent", f"SELECT prompt_id, intent FROM ({ONE_INTENT}) z")

_FOUND = f"regexp_extract_all(trim(line), {_quoted('(' + _STARTS + ')')}, 1)"
check("f20_line_tokens", f"WITH {CODES} SELECT token, count(*) AS n FROM (SELECT {_NAMED} AS token FROM (SELECT unnest({_FOUND}) AS m FROM (SELECT unnest(string_split(code, chr(10))) AS line FROM codes) x) y) z GROUP BY token")

SIDES = f"""nodes AS (SELECT code_id, line, {_kind_sql("trim(text)")} AS kind, side FROM (SELECT code_id, unnest(string_split(code, chr(10))) AS text, generate_subscripts(string_split(code, chr(10)), 1) AS line, 'a' AS side FROM codes
  UNION ALL SELECT code_id, unnest(string_split(before_code, chr(10))), generate_subscripts(string_split(before_code, chr(10)), 1), 'b' FROM codes) x),
  own AS (SELECT code_id, line, kind, min(side) AS lo, max(side) AS hi FROM nodes WHERE kind IS NOT NULL GROUP BY 1, 2, 3),
  n AS (SELECT c.code_id, count(line) FILTER (WHERE lo = 'a' AND hi = 'a') AS adds, count(line) FILTER (WHERE lo = 'b') AS removes FROM codes c LEFT JOIN own ON c.code_id = own.code_id GROUP BY 1)"""
check("r10_edit_scripts", f"WITH {CODES}, {SIDES} SELECT code_id AS diff_id, adds, removes, CASE WHEN adds > 0 AND removes > 0 THEN 'mixed' WHEN adds > 0 THEN 'add' WHEN removes > 0 THEN 'delete' ELSE 'modify' END AS style FROM n")

check("v14_assign_cluster", """WITH long AS (SELECT vec_id, label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings), c AS (SELECT label AS cluster, dim, avg(x) AS m FROM long GROUP BY 1, 2),
  s AS (SELECT vec_id, cluster, round(sum(x * m) / sqrt(sum(x * x) * sum(m * m)), 9) AS similarity FROM long JOIN c USING (dim) GROUP BY 1, 2)
  SELECT vec_id, cluster, similarity FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, cluster) AS rn FROM s) x WHERE rn = 1""")

check("v03_vectors", "SELECT event_id, 773 AS n, CASE type WHEN 'code_change' THEN 0 WHEN 'entry_created' THEN 1 WHEN 'file_open' THEN 2 WHEN 'prompt' THEN 3 WHEN 'terminal_command' THEN 4 END AS hot, 1.0::double AS total FROM ev")
check("v15_stored_taxonomy", "SELECT label, dim, round(avg(x), 9) AS m FROM (SELECT label, unnest(embedding)::double AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) y GROUP BY 1, 2")
check("v05_padded", "SELECT vec_id, len(embedding) AS n, dim, CASE WHEN dim < len(embedding) THEN round(embedding[dim + 1]::double, 9) ELSE 0.0 END AS x FROM embeddings, (SELECT unnest(range(80)) AS dim) d")
