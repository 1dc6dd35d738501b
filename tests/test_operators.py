"""Operators on small inputs, batch and stream."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tracewright.operators import context, graph, links, sessions, vectors
from tracewright.sources import files
from tracewright.streaming import stateful

T0 = dt.datetime(2024, 1, 1, 23, 50)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_chunks_stitch_days(spark):
    """A gap of 300 s stays in a chunk and one of 301 s ends it, also across midnight and over empty days."""
    times = [0, 300, 601, 602, 900, 1000, 86400 * 3, 86400 * 3 + 300, 86400 * 3 + 601]
    df = spark.createDataFrame([(i, at(s)) for i, s in enumerate(times)], "id int, ts timestamp")
    got = [r["chunk_id"] for r in sessions.temporal_chunks(df).orderBy("id").collect()]
    assert got == [1, 1, 2, 2, 2, 2, 3, 3, 4]
    assert sessions.temporal_chunks(df.limit(0)).count() == 0


def test_band_join_equals_nested_loop(spark):
    import random

    rng = random.Random(4)
    a = [(i, at(rng.randrange(0, 20000) / 2)) for i in range(200)]
    b = [(i, at(rng.randrange(0, 20000) / 2)) for i in range(200)]
    x, y = spark.createDataFrame(a, "a int, ta timestamp"), spark.createDataFrame(b, "b int, tb timestamp")
    got = sorted((r["a"], r["b"]) for r in links.band_join(x, y, "ta", "tb", 60).collect())
    assert got == sorted((i, j) for i, p in a for j, q in b if abs((p - q).total_seconds()) <= 60)


def test_claims_use_a_prompt_once(spark):
    p = spark.createDataFrame([("w", at(0), 1), ("w", at(10), 2)], "workspace_path string, ts timestamp, prompt_id long")
    e = spark.createDataFrame([("w", at(20), 11), ("w", at(21), 12), ("w", at(22), 13)], "workspace_path string, ts timestamp, entry_id long")
    assert {tuple(r) for r in links.claim_once(e, p).collect()} == {(11, 2), (12, 1)}


@pytest.mark.parametrize(("how", "want"), [("skip", {(1, "a"), (2, "b"), (3, "z")}), ("overwrite", {(1, "a"), (2, None), (3, "z")}), ("merge", {(1, "a"), (2, "b"), (3, "z")}), ("append", {(1, "a"), (2, "b"), (2, None), (3, "z")})])
def test_upsert(spark, how, want):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, None), (3, "z")], "k int, v string")
    assert {tuple(r) for r in links.upsert(old, new, "k", how).select("k", "v").collect()} == want


def test_context_precision_edges(spark):
    ctx = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c"), (3, None)], "prompt_id int, path string")
    changed = spark.createDataFrame([(1, "a"), (2, "x")], "prompt_id int, path string")
    got = {r["prompt_id"]: round(r["cp"], 3) for r in context.context_precision(ctx, changed).collect()}
    assert got == {1: 0.667, 2: 0.0, 3: 0.0}
    s = context.precision_summary(spark.createDataFrame([(0.0,), (0.2,), (1.0,), (0.6,)], "cp double")).first()
    assert [s[f"bucket_{i}"] for i in range(5)] == [1, 1, 0, 1, 1]


def test_motifs(spark):
    seq = spark.createDataFrame([("s", i + 1, c) for i, c in enumerate("ABABAAAAA")], "session_id string, seq int, symbol string")
    assert sessions.cycles(seq).count() == 3
    assert [r["motif"] for r in sessions.hot(seq).collect()] == ["HOT_A_7"]
    assert sessions.switching(seq).count() == 0
    assert sessions.transitions(seq).count() == 8


@pytest.fixture(scope="module")
def net(spark):
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("z", "z")]
    nodes = spark.createDataFrame([(v,) for v in "abcdxyzq"], "id string")
    return nodes, spark.createDataFrame([(*x, "T", 1) for x in e], "source string, target string, type string, weight long")


def test_graph(spark, net):
    nodes, edges = net
    assert {tuple(r) for r in graph.components(nodes, edges).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x"), ("z", "z"), ("q", "q")}
    assert graph.has_cycle(edges) and not graph.has_cycle(edges.where("source <> target AND source <> 'c'"))
    assert {tuple(r) for r in graph.distances(edges, "a").collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    assert [r["path"] for r in graph.paths(edges, "a", "d").collect()] == ["a>b>c>d"]
    tri = {r["id"]: r["coefficient"] for r in graph.clustering(edges).collect()}
    assert tri["a"] == 1.0 and round(tri["c"], 3) == 0.333
    deg = {r["id"]: r["degree"] for r in graph.degrees(nodes, edges).collect()}
    assert deg["c"] == 3 and deg["q"] == 0 and deg["z"] == 2
    found = {r["id"]: r["community"] for r in graph.louvain(nodes, edges).collect()}
    assert found["x"] == found["y"] != found["a"] and found["q"] == "q"
    assert graph.graph_diff(edges, edges.where("source <> 'x'")).first()["change"] == "removed"


def test_vectors(spark):
    assert vectors.dtw([1, 2, 3], [1, 2, 2, 3]) == 0 and vectors.dtw([0], [3, 4]) == 5
    assert abs(vectors.p_value(2.0, 10) - 0.07338803) < 1e-6 and abs(vectors.p_value(0.0, 5) - 1) < 1e-12
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.9, 0.1], 0), (3, [0.0, 1.0], 1)], "vec_id int, embedding array<double>, label int")
    got = {r["vec_id"]: r["cluster"] for r in vectors.assign(df, vectors.centroids(df)).collect()}
    assert got == {1: 0, 2: 0, 3: 1}
    x = spark.createDataFrame([("c", 1.0), ("c", 2.0), ("c", 3.0), ("t", 2.0), ("t", 4.0), ("t", 6.0)], "g string, v double")
    r = vectors.t_test(x, "g", "v", "c", "t").first()
    assert r["df"] == 4 and math.isclose(r["t"], 1.5492, abs_tol=1e-4) and r["change_pct"] == 100


def test_files(spark, tmp_path):
    from pyspark.sql import types as T

    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n')
    good, bad = files.read_jsonl(spark, f"file://{tmp_path}/x.jsonl", T.StructType([T.StructField("a", T.LongType())]))
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and [r["value"] for r in bad.collect()] == ["not json"]
    with pytest.raises(ValueError):
        files.detect_format("x.txt")
    train, rest = files.split_positions(spark.range(100).toDF("id"), ["id"])
    assert {r["id"] for r in train.collect()} == set(range(90)) and rest.count() == 10


def test_split_positions_agree_over_coalesced_ranges(spark):
    """Rows and their counts come from the same ranges, though one of both plans has wide rows and the other none."""
    wide = spark.range(30000, numPartitions=3).select((F.col("id") * 7919 % 30000).alias("id"), F.expr("repeat(sha2(cast(id as string), 512), 8)").alias("text"))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        train, rest = files.split_positions(wide, ["id"])
        assert sorted(r["id"] for r in train.select("id", "text").collect()) == list(range(27000))
        assert sorted(r["id"] for r in rest.collect()) == list(range(27000, 30000))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, at(60 * (i % 7) + 4000 * (i // 7)), "w", f"f{i % 2}", "x" * (i * 7 % 50)) for i in range(28)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, workspace_path string, file_path string, content string")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = stateful.run_once(stateful.unseen(stream, ["file_path"], "100 days"), "seen", f"{tmp_path}/c1")
    assert got.count() == 2
    chunks = stateful.run_once(stateful.session_chunks(stream, "5 minutes", "1 minute"), "chunked", f"{tmp_path}/c2")
    assert {r["n"] for r in chunks.collect()} == {7}
    changes = stateful.run_once(stateful.file_changes(stream), "changes", f"{tmp_path}/c3")
    assert changes.where(F.col("chars_added") + F.col("chars_deleted") < 10).count() == 0 and changes.count() > 3


def test_prompt_edit_pairs_meet_near_their_time(spark, tmp_path):
    """Streams meet in buckets of the interval, each pair once, bounds included; executors write them."""
    schema = "id long, ts timestamp, workspace_path string"
    begin = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    rows = [(i, begin + dt.timedelta(seconds=s), w) for i, (s, w) in enumerate([(s, w) for s in (-900, -600, -300, -1, 0, 1, 299, 300, 301, 600, 5000) for w in ("v", "w", None)] + [(0, "w")])]
    spark.createDataFrame([*rows, (99, None, "w")], schema).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    pairs = stateful.prompt_edit_pairs(stream.withColumnRenamed("id", "prompt_id"), stream.withColumnRenamed("id", "entry_id"), "5 minutes")
    assert "p_bucket" in pairs._jdf.queryExecution().analyzed().toString()
    got = sorted(tuple(r) for r in stateful.run_to(pairs, f"{tmp_path}/out", f"{tmp_path}/check").collect())
    assert got == sorted((a, b) for a, s, v in rows for b, t, w in rows if v is not None and v == w and 0 <= (t - s).total_seconds() <= 300)
