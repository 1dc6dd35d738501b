"""Queries do the whole job, beyond what their SQL asks for."""

from tracewright import catalog


def test_json_document_holds_every_row(spark, sf_dir):
    want = {(r["doc_id"], r["lang"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = [tuple(r) for r in catalog.queries()["s05_json_document"](spark, sf_dir).select("doc_id", "lang").collect()]
    assert set(got) == want and len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_closeness_of_every_node(spark, sf_dir):
    from tracewright.operators import graph

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c")], "source string, target string")
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    far = {(r["source"], r["id"]): r["distance"] for r in graph.all_distances(nodes, edges).collect()}
    assert far == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("b", "a"): 1, ("b", "b"): 0, ("b", "c"): 1, ("c", "a"): 2, ("c", "b"): 1, ("c", "c"): 0, ("d", "d"): 0}
    rows = catalog.queries()["g08_closeness"](spark, sf_dir).collect()
    assert len(rows) > 1 and len({r["id"] for r in rows}) == len(rows)


def test_null_aware_order_returns_all_entries(spark, sf_dir):
    from tracewright.sources.telemetry import Tables

    rows = catalog.queries()["o02_null_aware_order"](spark, sf_dir).collect()
    assert len(rows) == Tables(spark, sf_dir).entries.count()
    nulls = [r["prompt_id"] is None for r in rows]
    assert nulls == sorted(nulls) and any(nulls)


def test_distances_have_no_bound(spark):
    from tracewright.operators import graph

    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(67)], "source string, target string")
    assert graph.distances(edges, "n0").agg({"distance": "max"}).first()[0] == 67
    assert graph.distances(edges, "n0", most=3).agg({"distance": "max"}).first()[0] == 3
