"""The pipeline and the registered queries on the smallest tables."""

import corpus_pipeline
from tracewright.llm import queries


def test_pipeline_stage_by_stage(spark, sf_dir, tmp_path):
    """Each stage keeps a part of its input, whole rows but for removed words, and its operator's decision holds."""
    from tracewright.llm import decontaminate, ngram_join

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, sf_dir).write.parquet(path := f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(path)
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before) and len(after) > 0.5 * len(before), name
        if name != "substring dedup":
            assert all(before[d] == t for d, t in after.items())
        if name == "n-gram Jaccard join":
            left = ngram_join.similarity_classes(docs, 5, (4, 5))
            assert left.where("doc_id <> component_id").isEmpty()
        if name == "benchmark decontamination":
            assert decontaminate.find_contained(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).isEmpty()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(after)


def test_quality_stage_keeps_by_the_classifier(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, sf_dir).collect()}
    said = {r["doc_id"] for r in queries.op1_quality_classifier(spark, sf_dir).where("predicted = 1").collect()}
    assert kept == said


def test_one_query_per_operator():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]


def test_sql_gives_the_same_rows(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        found = con.execute(sql)
        columns = [d[0] for d in found.description]
        df = queries.queries()[name](spark, sf_dir)
        assert sorted(columns) == sorted(df.columns), name
        want = sorted(str([row[columns.index(c)] for c in sorted(columns)]) for row in found.fetchall())
        assert sorted(str([r[c] for c in sorted(columns)]) for r in df.collect()) == want, name


def test_stages_on_awkward_rows(spark, sf_dir, docs, corpus):
    """Nulls, empty texts, repeated rows and ids, and other columns of clashing names; and no rows at all."""
    from collections import Counter

    from pyspark.sql import functions as F

    odd = docs.withColumn("source", F.coalesce("source", F.lit("s0"))).withColumn("kept_id", F.lit("x")).withColumn("bad_id", F.lit(1))
    columns = list(corpus_pipeline.COLUMNS)
    inputs = Counter((r[0], r[1]) for r in corpus)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, sf_dir)
        rows = got.collect()
        assert stage(spark, odd.limit(0), sf_dir).count() == 0, name
        if name == "packing":
            assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)
            continue
        assert got.columns == columns, name
        if name == "substring dedup":
            assert all(len((r["text"] or "").split()) <= max(len((t or "").split()) for (d, t) in inputs if d == r["doc_id"]) for r in rows)
            continue
        kept = Counter((r["doc_id"], r["text"]) for r in rows)
        assert all(n <= inputs[x] for x, n in kept.items()), name
        if name == "n-gram Jaccard join":
            assert max(kept.values()) == 1 and kept[3, corpus[3][1]] == 1
            assert {d for d, t in kept if t and not t.split()} == {204}
        if name == "benchmark decontamination":
            assert kept == inputs


def test_pipeline_against_brute_force(spark, tmp_path):
    """All stages but the tokenizer's and the trained model's, whose verdicts are taken, row by row."""
    import random

    rng = random.Random(6)
    pool = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    rows = [(i, text(rng.randrange(30, 90))) for i in range(80)]
    passage, item = text(30), text(12)
    for i in range(0, 30, 5):
        rows[i] = (i, f"{rows[i][1]} {passage} {text(40)}")
    for i in (40, 47):
        rows[i] = (i, f"{rows[i][1]} {item}")
    rows += [(100 + k, rows[k + 50][1] + " extra") for k in range(6)] + [(60, rows[60][1]), (61, text(50)), (200, rows[61][1]), (300, ""), (301, None)]
    labels = [(i, i % 2, 0) for i in range(80)]
    spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    sf = f"file://{tmp_path}"
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()]

    def shingles(t, k):
        w = (t or "").lower().split()
        return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()

    order = sorted(kept, key=lambda r: (r[0], r[1] or ""))
    sets, parent = [shingles(t, 5) for _, t in order], list(range(len(order)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    order = list(dict.fromkeys(order[i] for i in range(len(order)) if find(i) == i))
    first, left = {}, []
    for d, t in sorted(order, key=lambda r: r[0]):
        w = (t or "").split()
        for i in range(len(w) - 12):
            first.setdefault(tuple(w[i : i + 13]), d)
    for d, t in order:
        w, gone = (t or "").split(), set()
        for i in range(len(w) - 12):
            if first[tuple(w[i : i + 13])] < d:
                gone |= set(range(i, i + 13))
        if len(gone) < len(w) or not w:
            left.append((d, " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t))
    need = shingles(item, 5)
    bad = {d for d, t in left if 5 * len(need & shingles(t, 5)) >= 4 * len(need)}
    from tracewright.llm.tokens import END, default_tokenizer, tokenizer_for

    coder = tokenizer_for(default_tokenizer())
    want = sorted((d, len(coder.encode([(t or "").encode()], END)[0]) // 4) for d, t in left if d not in bad)
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == want
    assert bad and len(left) < len(kept) and len(order) < len(kept)
