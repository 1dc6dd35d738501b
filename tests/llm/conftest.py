"""Small documents that hold every awkward case."""

import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): near and exact copies, shared passages, nulls, empties, repeated rows, a long text."""
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ("lo", "ra", "mi", "tu", "ve", "sha") for b in ("n", "ter", "dis", "qua", "", "pol", "xy")]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(("", "", ".", ",")) for _ in range(n))
    passage = text(40)
    rows = []
    for i in range(60):
        body = text(rng.randrange(30, 160))
        if i % 6 == 0:
            body = f"{body}\n{passage} {text(20)}"
        rows.append((i, body, ("en", "de")[i % 2], f"s{i % 3}"))
    base = rows[3][1].split()
    for k in range(8):  # near copies, ever further from the first
        w = list(base)
        for _ in range(k):
            w[rng.randrange(len(w))] = "zz"
        rows.append((100 + k, " ".join(w), "en", "s0"))
    rows += [(200, rows[5][1], "en", "s1"), (201, rows[5][1].upper(), None, None), (202, "", "en", "s1"), (203, None, "en", "s1"), (204, "  \n\t ", "de", "s2")]
    rows += [(205, "one", "en", "s1"), (206, "one two three", "en", "s1"), (207, "one two three", "en", "s1"), (None, passage, "en", None), (None, None, None, None)]
    rows += [(3, rows[3][1], "en", "s0"), (208, "weiß über é ’ naïve 中文 " * 30, "fr", "s2"), (209, text(6000), "en", "s0"), (210, ("spam spam " * 200).strip(), "en", "s0")]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With more columns, of clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(corpus, "doc_id long, text string, lang string, source string")
    clash = ("id", "node", "n", "hashes", "part", "h", "w", "score", "component", "item_id", "key", "token", "digest", "label")
    return df.select("*", F.length("text").cast("long").alias("n_chars"), *(F.lit("x").alias(c) for c in clash)).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
