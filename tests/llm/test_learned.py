"""Trained operators, by their accuracy on what they did not see."""

import random
import tracemalloc
import zlib

import numpy as np
import pytest

from tracewright.llm import attention_quality, noisy_or_toxicity


def bags(n, seed):
    rng = random.Random(seed)
    common = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(common) for _ in range(rng.randrange(20, 200))]
        bad, rude = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            w = [x + rng.choice(("###", "%%%", "$$$")) for x in w]
        if rude:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(("grumblex", "snarkly", "vilest"))
        rows.append((i, ". ".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9)), "en"))
        labels.append((i, int(not bad), int(rude)))
    rows += [(10_000, None, "en"), (10_001, "", "en"), (None, "w1 w2", None), (0, rows[0][1], "en")]
    labels += [(None, 1, 1), (10_002, 1, 0), (5, None, None)]
    return rows, labels


@pytest.fixture(scope="module")
def data(spark):
    rows, labels = bags(700, 1)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {x[0]: x for x in labels}


@pytest.mark.parametrize(("module", "column", "place", "bar"), [(attention_quality, "quality", 1, 0.3), (noisy_or_toxicity, "toxic", 2, 0.5)])
def test_held_out_accuracy(spark, data, module, column, place, bar):
    docs, labels, truth = data
    model = module.train(docs, labels, column)
    rows = module.score(docs, model).collect()
    assert len(rows) == 704
    held = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 10_000 and r["held_out"] and r["doc_id"] != 5]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held_out"] for r in rows if r["doc_id"] is not None)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= bar) for r in rows)
    assert np.mean([r["predicted"] == truth[r["doc_id"]][place] for r in held]) > 0.95
    assert module.score(docs.limit(0), model).count() == 0
    assert module.score(docs, module.train(docs, labels.limit(0), column)).count() == 704


def test_scores_do_not_use_labels_or_ids(spark, data):
    docs, labels, _ = data
    from pyspark.sql import functions as F

    model = attention_quality.train(docs, labels)
    moved = docs.withColumn("doc_id", F.col("doc_id") + 77).withColumn("lang", F.lit("zz"))
    a = sorted(r["score"] for r in attention_quality.score(docs, model).collect())
    assert np.allclose(a, sorted(r["score"] for r in attention_quality.score(moved, model).collect()))


def test_offending_sentences_are_located(data):
    docs, labels, _ = data
    model = noisy_or_toxicity.train(docs, labels)
    text = b"w1 w2 w3 w4. w5 snarkly w6 w7. w8 w9."
    spans, p = model.sentence_scores(text)
    assert text[slice(*spans[int(p.argmax())])] == b"w5 snarkly w6 w7." and (p > 0.5).sum() == 1


def test_toxicity_fit_holds_four_bytes_a_bucket_of_a_sentence():
    """And a stretch of what a step derives from them: it took some 55 bytes each, and 1,569 MB of the driver in all."""
    rng = random.Random(4)
    vocabulary = [f"{rng.randrange(10**9):x}" for _ in range(3000)]
    texts = [". ".join(" ".join(rng.choices(vocabulary, k=20)) for _ in range(100)).encode() for _ in range(250)]
    tracemalloc.start()
    noisy_or_toxicity.NoisyOr().fit(texts, np.arange(250) % 2, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 48 << 20


def test_toxicity_fit_does_not_depend_on_stretches(monkeypatch):
    rows, labels = bags(300, 3)
    texts, y = [t.encode() for _, t, _ in rows[:300]] + [b"", b" \n", b"one. two"], np.array([x[2] for x in labels[:300]] + [0, 1, 0])
    whole = noisy_or_toxicity.NoisyOr().fit(texts, y)
    for name in ("STRETCH", "LISTED"):
        monkeypatch.setattr(noisy_or_toxicity, name, 40)
    cut = noisy_or_toxicity.NoisyOr().fit(texts, y)
    assert np.abs(whole.weights).max() > 1 and np.allclose(whole.weights, cut.weights, atol=1e-5) and abs(whole.bias - cut.bias) < 1e-6
