"""Module graphs as two DataFrames: nodes (id) and edges (source, target, type, weight)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _kept(df: DataFrame) -> DataFrame:
    """df written once where all executors can read it, so that loops don't grow the plan."""
    sc = df.sparkSession.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="graph-"))
        folder = sc.getCheckpointDir()
    path, schema = f"{folder}/graph-{uuid.uuid4().hex}", df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def merge_edges(raw: DataFrame) -> DataFrame:
    """One edge per source, target and type; weight: how many there were."""
    return raw.groupBy("source", "target", "type").agg(F.count("*").alias("weight"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, in_degree, out_degree, degree, centrality (degree over n - 1) of every node."""
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    sums = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    n = nodes.agg(F.count("*").alias("n"))  # one row
    full = nodes.select("id").join(sums, "id", "left").na.fill(0, ["in_degree", "out_degree"]).crossJoin(F.broadcast(n))
    total = F.col("in_degree") + F.col("out_degree")
    return full.select("id", "in_degree", "out_degree", total.alias("degree"), F.when(F.col("n") > 1, total / (F.col("n") - 1)).otherwise(0.0).alias("centrality"))


def neighbours(edges: DataFrame) -> DataFrame:
    """a, b: undirected neighbour pairs, once each way, without loops."""
    pairs = edges.where("source <> target").select(F.col("source").alias("a"), F.col("target").alias("b"))
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def clustering(edges: DataFrame) -> DataFrame:
    """id, n_neighbours, coefficient: linked share of a node's neighbour pairs, for nodes of two neighbours or more."""
    nb = neighbours(edges)
    size = nb.groupBy("a").agg(F.count("*").alias("k")).where("k >= 2")
    x, y, z = nb.alias("x"), nb.alias("y"), nb.alias("z")
    tri = x.join(y, F.col("x.b") == F.col("y.a")).where("y.b <> x.a").join(z, (F.col("y.b") == F.col("z.b")) & (F.col("x.a") == F.col("z.a"))).groupBy(F.col("x.a").alias("a")).agg(F.count("*").alias("t"))
    return size.join(tri, "a", "left").select(F.col("a").alias("id"), F.col("k").alias("n_neighbours"), F.round(F.coalesce("t", F.lit(0)) / (F.col("k") * (F.col("k") - 1)), 6).alias("coefficient"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component: smallest id reachable in the undirected graph; labels are halved along chains by jumping."""
    nb = _kept(neighbours(edges))
    now = nodes.select("id", F.col("id").alias("component"))
    while True:
        least = nb.join(now, nb["b"] == now["id"]).groupBy("a").agg(F.min("component").alias("m"))
        nearer = now.join(least, now["id"] == least["a"], "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"), F.col("component").alias("old"))
        jump = nearer.select(F.col("id").alias("j"), F.col("component").alias("jc"))
        done = _kept(nearer.join(jump, nearer["component"] == jump["j"], "left").select("id", F.least("component", F.coalesce("jc", "component")).alias("component"), "old"))
        now = done.select("id", "component")
        if done.where("component <> old").isEmpty():
            return now


def has_cycle(edges: DataFrame) -> bool:
    """Any directed cycle: edges into or out of nodes that no other edge enters are peeled off until none is left to peel."""
    left = _kept(edges.select("source", "target").distinct())
    n = left.count()
    while n:
        entered = left.select(F.col("target").alias("t")).distinct()
        left = _kept(left.join(entered, left["source"] == entered["t"], "left_semi"))
        m = left.count()
        if m == n:
            return True
        n = m
    return False


def distances(edges: DataFrame, start: str, directed: bool = True, most: int | None = None) -> DataFrame:
    """id, distance: steps of the shortest path from start (at most so many, if most is given); each level is one join with the edges not yet reached."""
    spark: SparkSession = edges.sparkSession
    step = _kept(edges.select("source", "target").distinct() if directed else neighbours(edges).toDF("source", "target"))
    seen = spark.createDataFrame([(start, 0)], "id string, distance int")
    front, d = seen, 0
    while most is None or d < most:
        d += 1
        nxt = front.join(step, front["id"] == step["source"]).select(F.col("target").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        front = _kept(nxt.withColumn("distance", F.lit(d)))
        if front.isEmpty():
            break
        seen = _kept(seen.unionByName(front))
    return seen


def all_distances(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """source, id, distance from every node (id) to each that it reaches, itself included; edges go both ways."""
    step = _kept(neighbours(edges).toDF("a", "b"))
    seen = _kept(nodes.select(F.col("id").alias("source"), "id", F.lit(0).alias("distance")).distinct())
    front, d = seen, 0
    while not front.isEmpty():
        d += 1
        nxt = front.join(step, front["id"] == step["a"]).select("source", F.col("b").alias("id")).distinct().join(seen.select("source", "id"), ["source", "id"], "left_anti")
        front = _kept(nxt.withColumn("distance", F.lit(d)))
        seen = _kept(seen.unionByName(front))
    return seen


def paths(edges: DataFrame, start: str, goal: str, depth: int = 10, most: int = 10) -> DataFrame:
    """path, length: simple paths from start to goal, shortest first, at most so many."""
    step = edges.select("source", "target").distinct()
    now = edges.sparkSession.createDataFrame([([start],)], "nodes array<string>")
    found = None
    for d in range(1, depth + 1):
        now = now.join(step, F.element_at("nodes", -1) == F.col("source")).where(~F.array_contains("nodes", F.col("target"))).select(F.concat("nodes", F.array("target")).alias("nodes"))
        now = _kept(now)
        hit = now.where(F.element_at("nodes", -1) == goal).select(F.array_join("nodes", ">").alias("path"), F.lit(d).alias("length"))
        found = hit if found is None else found.unionByName(hit)
        now = now.where(F.element_at("nodes", -1) != goal)
        if found.count() >= most or now.isEmpty():
            break
    return found.orderBy("length", "path").limit(most)


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges both of whose ends are in ids (id)."""
    keep = ids.select("id").distinct()
    return edges.join(keep, edges["source"] == keep["id"], "left_semi").join(keep, edges["target"] == keep["id"], "left_semi")


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """modularity_ref of a partition (id, community), with the squared degrees over 2 m^2."""
    named = edges.join(communities.select(F.col("id").alias("source"), F.col("community").alias("cs")), "source").join(communities.select(F.col("id").alias("target"), F.col("community").alias("ct")), "target")
    m = named.agg(F.sum("weight").alias("m"))
    inside = named.where("cs = ct").groupBy(F.col("cs").alias("c")).agg(F.sum("weight").alias("inside"))
    ends = named.select(F.col("cs").alias("c"), "weight").unionByName(named.select(F.col("ct").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("d"))
    both = ends.join(inside, "c", "left").crossJoin(F.broadcast(m))  # one row
    term = F.coalesce("inside", F.lit(0)) / F.col("m") - F.col("d") * F.col("d") / (2 * F.col("m") * F.col("m"))
    return both.agg(F.round(F.sum(term), 6).alias("modularity_ref"))


def louvain(nodes: DataFrame, edges: DataFrame, sweeps: int = 100) -> DataFrame:
    """id, community by one level of greedy local moves, for graphs of modules that fit one task (a repository's files)."""
    both = edges.select("source", "target", "weight")

    def move(rows):
        import pandas as pd

        adj: dict[str, dict[str, float]] = {}
        for r in rows.sort_values(["source", "target"]).itertuples():
            if r.source != r.target:
                for a, b in ((r.source, r.target), (r.target, r.source)):
                    adj.setdefault(a, {})[b] = adj.setdefault(a, {}).get(b, 0) + r.weight
        total = sum(sum(x.values()) for x in adj.values()) or 1.0
        comm = {v: v for v in adj}
        deg = {v: sum(x.values()) for v, x in adj.items()}
        size = dict(deg)
        for _ in range(sweeps):
            moved = False
            for v in sorted(adj):
                links: dict[str, float] = {}
                for u, w in adj[v].items():
                    links[comm[u]] = links.get(comm[u], 0) + w
                own = comm[v]
                size[own] -= deg[v]
                best = max(sorted({*links, own}), key=lambda c: links.get(c, 0) - size[c] * deg[v] / total)
                if links.get(best, 0) - size[best] * deg[v] / total <= links.get(own, 0) - size[own] * deg[v] / total + 1e-12:
                    best = own
                size[best] += deg[v]
                moved |= best != own
                comm[v] = best
            if not moved:
                break
        return pd.DataFrame(sorted(comm.items()), columns=["id", "community"])

    found = both.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda rows: move(rows), "id string, community string")
    return nodes.select("id").join(found, "id", "left").withColumn("community", F.coalesce("community", "id"))


def graph_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """source, target, type, change of edges that were added, removed or changed in weight."""
    on = ["source", "target", "type"]
    b, a = before.select(*on, F.col("weight").alias("wb")), after.select(*on, F.col("weight").alias("wa"))
    both = b.join(a, on, "full_outer")
    change = F.when(F.col("wb").isNull(), F.lit("added")).when(F.col("wa").isNull(), F.lit("removed")).when(F.col("wa") != F.col("wb"), F.lit("modified"))
    return both.select(*on, change.alias("change")).where("change IS NOT NULL")


def hubs(deg: DataFrame, above: int = 5, most: int = 10) -> DataFrame:
    return deg.where(F.col("out_degree") > above).orderBy(F.desc("out_degree"), "id").limit(most)


def first_in_order(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_rn = 1").drop("_rn")


def compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """source, target, changed: names of the properties, joined by commas, in which edges of the same ends differ."""
    values = [c for c in old.columns if c not in ("source", "target")]
    both = old.select("source", "target", *(F.col(c).alias(f"o_{c}") for c in values)).join(new, ["source", "target"])
    return both.select("source", "target", F.concat_ws(",", *(F.when(~F.col(c).eqNullSafe(F.col(f"o_{c}")), F.lit(c)) for c in values)).alias("changed"))


def context_edges(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """source, target, weight: pairs both of whose files are known (file_path), counted."""
    ids = known.select(F.col("file_path").alias("known")).distinct()
    inside = pairs.join(ids, F.col("source") == F.col("known"), "left_semi").join(ids, F.col("target") == F.col("known"), "left_semi")
    return inside.groupBy("source", "target").agg(F.count("*").alias("weight"))


def betweenness(nodes: DataFrame, edges: DataFrame, sample: int = 100) -> DataFrame:
    """id, betweenness: of the directed shortest paths from each of the first nodes (by id) to each later one of them, on
    how many a node lies in between. Between two nodes one path counts: nodes are reached in the order of their id, and a
    node's way leads over the one that was reached first."""
    first = nodes.select("id").distinct().orderBy("id").limit(sample)
    step = _kept(edges.where("source <> target").select("source", "target").distinct())
    none = F.array().cast("array<string>")
    front = first.select(F.col("id").alias("start"), "id", F.array(F.lit("")).alias("order"), none.alias("between"))
    seen, paths = _kept(front.select("start", "id")), None
    front = _kept(front)
    while not front.isEmpty():
        way = F.when(F.col("id") == F.col("start"), F.col("between")).otherwise(F.concat("between", F.array("id")))
        reached = front.join(step, front["id"] == step["source"]).select("start", F.col("target"), F.struct(F.concat("order", F.array("id")).alias("order"), way.alias("between")).alias("by"))
        best = reached.groupBy("start", "target").agg(F.min("by").alias("by")).select("start", F.col("target").alias("id"), "by.order", "by.between")
        front = _kept(best.join(seen, ["start", "id"], "left_anti"))
        seen = _kept(seen.unionByName(front.select("start", "id")))
        paths = front if paths is None else paths.unionByName(front)
    inner = paths.where("id > start").join(first, "id", "left_semi").select(F.explode("between").alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    return nodes.select("id").distinct().join(inner, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("betweenness"))


def detect_communities(nodes: DataFrame, edges: DataFrame, method: str = "louvain") -> DataFrame:
    """id, community by the method asked for: louvain or components."""
    if method == "components":
        return components(nodes, edges).select("id", F.col("component").alias("community"))
    if method == "louvain":
        return louvain(nodes, edges)
    raise ValueError(f"unknown method: {method}")
