"""Operators that SQL can't express, against plain Python or cases worked out by hand."""

import math
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewright.functions import code as C
from tracewright.functions import events as E
from tracewright.functions import text as X
from tracewright.operators import encoders, graph, links, sessions, vectors
from tracewright.sources import files
from tracewright.streaming import stateful

START = datetime(2024, 1, 1)


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = list(row)
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return row[-1]


def test_similarity_is_that_of_the_longest_common_subsequence(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("abc é") for _ in range(rng.randrange(60))), "".join(rng.choice("abc é") for _ in range(rng.randrange(60)))) for _ in range(60)]
    pairs += [("", ""), ("", "abc"), ("same", "same"), (None, "x"), (None, None)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = {r["i"]: r["s"] for r in rows.select("i", C.similarity("a", "b").alias("s")).collect()}
    for i, (a, b) in enumerate(pairs):
        a, b = a or "", b or ""
        assert math.isclose(got[i], common(a, b) / max(len(a), len(b)) if a or b else 1.0)


def test_time_warping(spark):
    def plain(a, b):
        t = [[math.inf] * (len(b) + 1) for _ in range(len(a) + 1)]
        t[0][0] = 0.0
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                t[i][j] = (x - y) ** 2 + min(t[i - 1][j], t[i][j - 1], t[i - 1][j - 1])
        return math.sqrt(t[-1][-1])

    rng = random.Random(2)
    for _ in range(40):
        a, b = ([float(rng.randrange(9)) for _ in range(rng.randrange(1, 12))] for _ in range(2))
        assert math.isclose(vectors.dtw(a, b), plain(a, b))
    assert vectors.dtw([], []) == 0 and vectors.dtw([], [1.0]) == math.inf


def states(spark, rows):
    """rows: (minutes, file, intent, workspace) of one session."""
    events = [("s", i, START + timedelta(minutes=m), w, f, k) for i, (m, f, k, w) in enumerate(rows)]
    df = spark.createDataFrame(events, "session_id string, event_id long, ts timestamp_ntz, workspace_path string, file_path string, intent string")
    return [(r["n_events"], r["intent"], r["files"]) for r in sessions.state_groups(df).orderBy("state").collect()]


def test_states_end_by_pause_intent_files_and_workspace(spark):
    g = "general"
    assert states(spark, [(0, "a", g, "w"), (1, "a", g, "w"), (2, "a", g, "w"), (33, "a", g, "w"), (34, "a", g, "w"), (35, "a", g, "w")]) == [(3, g, ["a"]), (3, g, ["a"])]
    # an intent is compared with that of the group, which is the most specific so far
    assert states(spark, [(0, "a", g, "w"), (1, "a", "bug-fix", "w"), (2, "a", "bug-fix", "w"), (3, "a", g, "w")]) == [(3, "bug-fix", ["a"])]
    # files of their own end a group of three, though fewer events don't
    assert states(spark, [(0, "a", g, "w"), (1, "b", g, "w"), (2, "a", g, "w"), (3, "c", g, "w"), (4, "c", g, "w"), (5, "c", g, "w")]) == [(3, g, ["a", "b"]), (3, g, ["c"])]
    # a known file among four is a quarter of them, which is too little
    assert states(spark, [(0, "a", g, "w"), (1, "b", g, "w"), (2, "c", g, "w"), (3, "a", g, "w"), (4, "d", g, "w")]) == [(4, g, ["a", "b", "c"])]
    assert states(spark, [(0, "a", g, "w"), (1, "a", g, "w"), (2, "a", g, "w"), (3, "a", g, "x")]) == [(3, g, ["a"])]
    assert states(spark, [(0, "a", g, "w"), (1, "a", g, "w")]) == []
    assert states(spark, [(0, None, g, "w"), (1, None, g, "w"), (2, "a", g, "w")]) == [(3, g, ["a"])]


def test_each_prompt_is_claimed_once(spark):
    rng = random.Random(3)
    moments = sorted(rng.sample(range(40_000), 300))
    kinds = [rng.random() < 0.5 for _ in moments]
    prompts = [(i, START + timedelta(seconds=s), f"w{i % 3}") for i, (s, k) in enumerate(zip(moments, kinds, strict=True)) if k]
    entries = [(i, START + timedelta(seconds=s), f"w{i % 3}") for i, (s, k) in enumerate(zip(moments, kinds, strict=True)) if not k]

    def want(ps, es):
        waiting, out = [], set()
        for at, kind, i in sorted([(t, 0, i) for i, t, _ in ps] + [(t, 1, i) for i, t, _ in es]):
            if not kind:
                waiting.append((at, i))
            else:
                waiting = [x for x in waiting if (at - x[0]).total_seconds() <= 300]
                if waiting:
                    out.add((i, waiting.pop()[1]))
        return out

    p = spark.createDataFrame(prompts, "prompt_id long, ts timestamp_ntz, workspace_path string")
    e = spark.createDataFrame(entries, "entry_id long, ts timestamp_ntz, workspace_path string")
    assert {tuple(r) for r in links.claim_once(e, p).collect()} == want(prompts, entries)
    own = set().union(*(want([x for x in prompts if x[2] == w], [x for x in entries if x[2] == w]) for w in ("w0", "w1", "w2")))
    assert {tuple(r) for r in links.claim_once(e, p, by="workspace_path").collect()} == own


def test_numbers_go_on_beyond_three_digits(spark):
    df = spark.range(1, 1003).select(F.format_string("src/%s/f%04d.py", (F.col("id") % 9).cast("string"), "id").alias("p"))
    rows = files.numbered(df, ["p"]).select("p", "n", C.padded(F.col("n")).alias("s")).orderBy("p").collect()
    assert [r["n"] for r in rows] == list(range(1, 1003))
    assert len({r["s"] for r in rows}) == 1002 and rows[6]["s"] == "007" and rows[-1]["s"] == "1002"
    many = spark.range(1).select(C.counted_names(F.array_repeat(F.lit("IDENTIFIER"), 1200), 1100).alias("t")).first()["t"]
    assert len(set(many)) == 1100 and many[0] == "ID_001" and many[-1] == "ID_1100"


def test_betweenness_on_a_small_graph(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "e")], "source string, target string")
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(nodes, edges).collect()}
    # a-d and a-e lead over b, which is reached before c; a-e, b-e and c-e over d
    assert got == {"a": 0, "b": 2, "c": 0, "d": 3, "e": 0}


def test_paths_without_dots(spark):
    cases = {"a/b/../c": "a/c", "./a//b": "a/b", "../x": "x", "a/./b": "a/b", "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    assert {r["p"]: r["q"] for r in df.select("p", C.normal_path(F.col("p")).alias("q")).collect()} == cases


def test_context_files_of_any_form(spark):
    cases = [
        ('["a.py", "b.py", "a.py", ""]', ["a.py", "b.py", "a.py"]), ('[{"path": "a"}, {"fileName": "b"}, {}]', ["a", "b"]), ('{"attachedFiles": [{"path": "a"}], "files": ["z"]}', ["a"]),
        ('{"codebaseFiles": [{"fileName": "c"}]}', ["c"]), ('{"files": ["a", {"path": "b"}]}', ["a", "b"]), ("{}", []), ("[]", []), ("no json", []), ("", []), (None, []),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, c string")
    got = {r["i"]: r["f"] for r in df.select("i", E.context_files(F.col("c")).alias("f")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_redaction_keeps_the_quotes(spark):
    df = spark.createDataFrame([("x = \"a b\"; y = 'c'; z = `d\ne`; mail me@example.com",)], "c string")
    assert df.select(X.redact_code(F.col("c"))).first()[0] == "x = \"[STR]\"; y = '[STR]'; z = `[STR]`; mail [EMAIL]"


def test_signatures_over_lines(spark):
    code = "export function f(\n  a: number,\n  b,\n): string {\n  return 1\n}\nfunction g() {\n}"
    df = spark.createDataFrame([(code, "typescript"), (None, "python")], "c string, l string")
    rows = df.select(C.signatures("c", "l").alias("s")).collect()
    assert [(x["params"], x["returns"]) for x in rows[0]["s"]][0] == (2, "number")
    assert rows[0]["s"][6]["params"] == 0 and len(rows[1]["s"]) == 1


def test_code_that_does_not_parse_is_tokenized_by_lines(spark):
    df = spark.createDataFrame([("x = 1", "python"), ("if broken(", "python"), ("let a = 1", "javascript"), (None, "python")], "c string, l string")
    got = [r[0] for r in df.select(C.code_tokens(F.col("c"), F.col("l"))).collect()]
    assert got[0] == ["ASSIGN", "IDENTIFIER", "NUMBER"] and got[1] == ["IF", "IDENTIFIER", "PAREN"] and got[2] == ["LET", "IDENTIFIER", "ASSIGN", "NUMBER"]


def test_syntax_diff_without_change_is_one_statement(spark):
    df = spark.createDataFrame([(1, "return x", "return x"), (2, "", "if (a) {\nreturn x"), (3, None, None)], "id int, b string, a string")
    got = sorted(tuple(r) for r in encoders.syntax_diff(df, "id", "b", "a").collect())
    assert got == [(1, "MODIFY_STATEMENT", 1, "modify"), (2, "ADD_IF_CONDITION", 1, "add"), (2, "ADD_RETURN", 2, "add"), (3, "MODIFY_STATEMENT", 1, "modify")]


def test_pending_prompts_wait_ten_at_most(spark, tmp_path):
    rows = [(i, START + timedelta(seconds=i), "w", "purchase") for i in range(14)] + [(100 + i, START + timedelta(seconds=50 + i), "w", "click") for i in range(12)] + [(200, START + timedelta(seconds=99), "v", "click")]
    spark.createDataFrame(rows, "event_id long, ts timestamp, workspace_path string, event_type string").coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, ts timestamp, workspace_path string, event_type string").parquet(f"file://{tmp_path}/in")
    got = stateful.run_once(stateful.pending_prompts(stream), "pending_test", f"file://{tmp_path}/check").collect()
    assert {(r["entry_id"], r["prompt_id"]) for r in got} == {(100 + i, 13 - i) for i in range(10)}


def test_parameters():
    assert files.listed("a, b,,") == ["a", "b"] and files.listed(None) == [] and files.listed(["x", " "]) == ["x"]
    assert files.moment("0") == "1970-01-01 00:00:00.000000" and files.moment("2024-02-03") == "2024-02-03 00:00:00.000000" and files.moment("soon") is None
    with pytest.raises(ValueError):
        files.checked_range("2019-01-01", "2019-02-01")
    with pytest.raises(ValueError):
        files.checked_range("2024-01-01", "2026-01-01")


def test_streamed_array_is_one_array(spark, tmp_path):
    import glob
    import json

    df = spark.range(20).repartition(3)
    files.stream_array(df, f"file://{tmp_path}/a")
    text = "".join(open(p).read() for d in ("0-open", "1-rows", "2-close") for p in sorted(glob.glob(f"{tmp_path}/a/{d}/part-*")))
    assert sorted(x["id"] for x in json.loads(text) if x) == list(range(20))
