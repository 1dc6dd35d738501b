"""SQL for DuckDB that gives the rows of the queries that SQL can express."""

from __future__ import annotations

from . import rules

WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

DECONTAMINATION = f"""
WITH items AS (SELECT item_id, {WORDS.format("lower(coalesce(text, ''))")} AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 5) AS k FROM items WHERE len(w) > 0),
own AS (SELECT DISTINCT item_id, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS p FROM sized) x),
need AS (SELECT item_id, count(*) AS n FROM own GROUP BY item_id),
docs AS (SELECT doc_id, {WORDS.format("lower(coalesce(text, ''))")} AS w FROM documents),
have AS (SELECT DISTINCT doc_id, k, array_to_string(list_slice(w, p, p + k - 1), ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM docs CROSS JOIN (SELECT DISTINCT k FROM own) ks WHERE len(w) >= k) x),
met AS (SELECT doc_id, item_id, count(*) AS n_shared FROM have JOIN own USING (k, s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS n_item, n_shared FROM met JOIN need USING (item_id) WHERE 5 * n_shared >= 4 * n
"""

JACCARD = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 3), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM docs WHERE len(w) > 0) x),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS h FROM sh GROUP BY doc_id),
nodes AS (SELECT h, min(doc_id) AS rep, any_value(n) AS n, count(*) AS copies FROM sets GROUP BY h),
rs AS (SELECT rep, s FROM nodes JOIN sh ON rep = doc_id),
pairs AS (SELECT x.rep AS a, y.rep AS b, count(*) AS c FROM rs x JOIN rs y ON x.s = y.s AND x.rep < y.rep GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN nodes p ON a = p.rep JOIN nodes q ON b = q.rep WHERE 100 * c >= 85 * (p.n + q.n - c)),
two_way AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT rep, rep FROM nodes UNION SELECT r.a, t.b FROM reach r JOIN two_way t ON r.b = t.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(n.copies, 1) AS n_copies
FROM docs d LEFT JOIN sets s ON d.doc_id = s.doc_id LEFT JOIN nodes n ON s.h = n.h LEFT JOIN comp c ON n.rep = c.a
"""

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(list_slice(ws, p, p + 12), ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM w WHERE len(ws) >= 13) x),
bad AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY k) AS f FROM win) y WHERE f < doc_id),
cov AS (SELECT DISTINCT doc_id, p + j AS i FROM bad CROSS JOIN range(13) r(j)),
pos AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT pos.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos.i) AS t FROM pos LEFT JOIN cov ON pos.doc_id = cov.doc_id AND pos.i = cov.i WHERE cov.i IS NULL GROUP BY pos.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


BASE = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"
END = "({0} + (1 << greatest(length(bin({0})) - 6, 0)) - 1)"


def _level(name: str, keys: str) -> str:
    """Quantiles of each metric for the sketches of one level."""
    by = f"{keys}, " if keys else ""

    def at(m: str, share: int) -> str:
        return f"min(CASE WHEN metric = '{m}' AND 100 * upto >= {share} * total THEN bucket END)"

    run = f"{name}_run AS (SELECT *, sum(n) OVER (PARTITION BY {by}metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY {by}metric) AS total FROM (SELECT {by}metric, bucket, sum(n) AS n FROM sketch GROUP BY {by}metric, bucket) x)"
    ends = ", ".join(f"{at(m, lo)} AS {name}_low_{m}, {END.format(at(m, hi))} AS {name}_high_{m}, {far} * ({END.format(at(m, hi))} - {at(m, mid)}) AS {name}_spread_{m}" for m, (lo, mid, hi, far) in rules.LEVELS.items())
    return f"{run},\n{name} AS (SELECT {by}max(total) AS {name}_docs, {ends} FROM {name}_run {f'GROUP BY {keys}' if keys else ''})"


def _wider(x: str) -> str:
    return f"CASE WHEN lang_docs >= {rules.LEAST_DOCS} THEN lang_{x} ELSE all_{x} END"


def _pick(x: str) -> str:
    return f"CASE WHEN own_docs >= {rules.LEAST_DOCS} THEN own_{x} ELSE {_wider(x)} END"


def _fences(m: str) -> str:
    spread = f"greatest({_pick(f'spread_{m}')}, {_wider(f'spread_{m}')})" if m in rules.POOLED else f"({_pick(f'spread_{m}')})"
    return f"{_pick(f'low_{m}')} - {spread} AS low_{m}, greatest({_pick(f'high_{m}')} + {spread}, coalesce(least_{m}, 0)) AS high_{m}"


LEAST = ", ".join(f"min(CASE WHEN metric = '{m}' AND 100 * upto >= {rules.SMALL} * total THEN bucket END) AS least_{m}" for m in rules.METRICS)
QUALITY_RULES = f"""
WITH base AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, p, array_to_string(list_slice(w, p, p + 7), ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM base WHERE len(w) >= 8) x),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) x WHERE c >= 2),
rep AS (SELECT doc_id, count(DISTINCT p + j) AS n FROM twice CROSS JOIN range(8) r(j) GROUP BY doc_id),
ln AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM base) x WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
counted AS (SELECT base.doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(dup, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
  FROM base LEFT JOIN ln ON base.doc_id = ln.doc_id LEFT JOIN rep ON base.doc_id = rep.doc_id),
m AS (SELECT *, 100 * word_chars // greatest(n_words, 1) AS word_length, 10000 * n_symbols // greatest(word_chars, 1) AS symbol_share, 10000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_share, 10000 * n_repeat_words // greatest(n_words, 1) AS repeat_share FROM counted),
long AS ({" UNION ALL ".join(f"SELECT lang, source, '{x}' AS metric, {x} AS v FROM m WHERE NOT {BASE}" for x in rules.METRICS)}),
sketch AS (SELECT lang, source, metric, (v >> greatest(length(bin(v)) - 6, 0)) * (1 << greatest(length(bin(v)) - 6, 0)) AS bucket, count(*) AS n FROM long GROUP BY 1, 2, 3, 4),
{_level("own", "lang, source")},
{_level("lang", "lang").replace("lang AS (SELECT lang,", "lang AS (SELECT lang AS of_lang,")},
{_level("all", "")},
few AS (SELECT {LEAST} FROM (SELECT metric, bucket, sum(n) OVER (PARTITION BY metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY metric) AS total FROM (SELECT metric, bucket, sum(n) AS n FROM sketch WHERE bucket > 0 GROUP BY 1, 2) x) y),
f AS (SELECT own.lang, own.source, {", ".join(map(_fences, rules.METRICS))} FROM own JOIN lang ON own.lang = lang.of_lang CROSS JOIN "all" CROSS JOIN few)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE} AS base_failed,
  NOT {BASE} AND NOT coalesce(word_length < low_word_length OR {" OR ".join(f"{x} > high_{x}" for x in rules.METRICS)}, false) AS kept,
  {", ".join(rules.METRICS)}, {", ".join(f"cast(high_{x} AS bigint) AS high_{x}" for x in rules.METRICS)}
FROM m LEFT JOIN f ON m.lang = f.lang AND m.source = f.source
""".replace('all AS (SELECT max', '"all" AS (SELECT max')
