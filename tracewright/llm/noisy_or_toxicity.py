"""Toxicity: sentence scores, combined by noisy-or, learned from labels of whole documents."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import held_out, id_and_text, trim, tune
from .labelled import training_sample

BUCKETS, THRESHOLD = 1 << 18, 0.5
#: Labelled documents to train on, at most, for each label.
TRAIN = {0: 5000, 1: 3000}
#: Words whose weight a worker remembers.
CACHED_WORDS = 500_000
#: Buckets of sentences (one sentence's stay together) that a step of the fit has open at once; bytes of a sentence that is
#: split into a list of words.
STRETCH, LISTED = 1 << 18, 1 << 20
_EDGE = b".,;:!?*$%&#|()[]{}<>\"'`-_+=~^/\\@"
_SENTENCE = re.compile(rb"(?<=[.!?])[\x20\x09-\x0D]+|\n+")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def features(word: bytes) -> list[int]:
    """Buckets of a word: itself, its first four and five letters, its last five; case and outer signs don't matter."""
    w = word.strip(_EDGE).decode("utf-8", "replace").lower()
    found = ["w" + w, "p" + w[:4], "q" + w[:5], "s" + w[-5:]] if len(w) > 3 else ["w" + w]
    return [xxhash.xxh3_64_intdigest(f) % BUCKETS for f in found]


def spans_of(text: bytes) -> Iterator[tuple[int, int]]:
    """Byte spans of the sentences that have a word."""
    at = 0
    for m in _SENTENCE.finditer(text):
        if text[at : m.start()].strip():
            yield at, m.start()
        at = m.end()
    if text[at:].strip():
        yield at, len(text)


def sentences(text: bytes) -> list[tuple[int, int]]:
    return list(spans_of(text))


def words_of(text: bytes, i: int, j: int) -> Iterator[bytes]:
    """The words of a sentence; those of a very long one are not all held."""
    return iter(text[i:j].split()) if j - i <= LISTED else (m.group() for m in _WORD.finditer(text, i, j))


class NoisyOr:
    """P(sentence) = sigmoid(bias + sum of its words' weights); P(document) = 1 - product of 1 - P(sentence)."""

    def __init__(self):
        self.weights, self.bias, self.seen = np.zeros(BUCKETS, np.float32), -6.0, {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "seen": {}}

    def fit(self, texts: list[bytes], y: np.ndarray, steps: int = 80, rate: float = 0.15, decay: float = 2e-4) -> NoisyOr:
        """Adam on the log likelihood of the document labels, less decay times the sum of the weights. Weights stay at 0
        or above: harmless words don't excuse a sentence. Buckets of fewer than three documents keep weight 0.

        A sentence's buckets are held as 4 bytes each; what a step derives from them is held for one stretch at a time."""
        parts, df = self._parts(texts)
        used = np.flatnonzero(df >= 3)
        place = np.full(BUCKETS, -1, np.int32)
        place[used] = np.arange(len(used), dtype=np.int32)
        for k, (columns, sizes, docs) in enumerate(parts):
            at = place[columns]
            keep = at >= 0
            parts[k] = at[keep], np.bincount(np.repeat(np.arange(len(sizes)), sizes)[keep], minlength=len(sizes)).astype(np.int32), docs
        w, b = np.zeros(len(used)), self.bias
        m, v, mb, vb = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
        for step in range(1, steps + 1):
            none, found = np.zeros(len(texts)), []
            for columns, sizes, docs in parts:
                z = np.bincount(np.repeat(np.arange(len(sizes)), sizes), w.take(columns), len(sizes)) + b
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                none += np.bincount(docs, np.log1p(-np.minimum(p, 1 - 1e-9)), len(texts))
                found.append(p)
            q = np.exp(none)
            ratio = np.where(y == 1, -np.minimum(q / np.maximum(1 - q, 1e-9), 1e6), 1) / len(texts)
            g, gb = np.full(len(used), decay), 0.0
            for (columns, sizes, docs), p in zip(parts, found, strict=True):
                dz = p * ratio.take(docs)
                g += np.bincount(columns, np.repeat(dz, sizes), len(used))
                gb += dz.sum()
            m, v, mb, vb = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            w = np.maximum(w - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6), 0)
            b = b - rate * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.999**step)) + 1e-6)
        self.weights[used], self.bias = w, float(b)
        return self

    @staticmethod
    def _parts(texts: list[bytes]) -> tuple[list[tuple[np.ndarray, ...]], np.ndarray]:
        """Stretches of sentences (buckets, how many of each sentence, its text) and the number of texts of each bucket."""
        buckets: dict[bytes, array] = {}
        parts, df, last = [], np.zeros(BUCKETS, np.int32), np.full(BUCKETS, -1, np.int32)
        columns, sizes, docs = array("i"), array("i"), array("i")

        def met(d: int, since: int) -> None:
            new = np.array(columns[since:], np.int32)
            new = new[last[new] != d]
            df[new] += 1  # once for a bucket, however often it is among them
            last[new] = d

        for d, text in enumerate(texts):
            since = len(columns)
            for i, j in spans_of(text):
                s: set[int] = set()
                for w in words_of(text, i, j):
                    f = buckets.get(w)
                    if f is None:
                        f = array("i", features(w))
                        if len(buckets) < CACHED_WORDS // 4:
                            buckets[w] = f
                    s.update(f)
                columns.extend(s)
                sizes.append(len(s))
                docs.append(d)
                if len(columns) >= STRETCH:
                    met(d, since)
                    parts.append(tuple(np.array(x, np.int32) for x in (columns, sizes, docs)))
                    columns, sizes, docs, since = array("i"), array("i"), array("i"), 0
            met(d, since)
        parts.append(tuple(np.array(x, np.int32) for x in (columns, sizes, docs)))
        return parts, df

    def _weight(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        if len(seen) > CACHED_WORDS:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = float(self.weights[features(w)].sum())
        return np.fromiter(map(seen.__getitem__, words), np.float64, len(words))

    def sentence_scores(self, text: bytes) -> tuple[list[tuple[int, int]], np.ndarray]:
        """Spans of the sentences and their scores; a word counts once a sentence."""
        spans = sentences(text)
        if not spans:
            return [], np.empty(0)
        split = [list(set(text[i:j].split())) for i, j in spans]
        starts = np.concatenate([[0], np.cumsum([len(x) for x in split])[:-1]]).astype(np.int64)
        z = np.add.reduceat(self._weight([w for x in split for w in x]), starts) + self.bias
        return spans, 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def document_score(p: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())) if len(p) else 0.0


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", limits: dict[int, int] | None = None) -> NoisyOr:
    texts, y = training_sample(docs, labels, label_col, limits or TRAIN, id_col, text_col)
    model = NoisyOr().fit(texts, np.array(y)) if len(set(y)) == 2 else NoisyOr()
    del texts
    trim()  # the driver keeps what it is not asked to give back
    return model


def score(docs: DataFrame, model: NoisyOr, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, and offending: spans (bytes of the UTF-8 text) and scores of the
    sentences at 0.5 or more.

    Null and empty texts have no sentence and score 0. Repeated rows are scored each; a null id stays null; an empty
    table gives no rows; other columns are ignored.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a megabyte of weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())]))
        for b in batches:
            scores, counts, bad = [], [], []
            for text in b.column(1).to_pylist():
                spans, p = own.sentence_scores(text)
                scores.append(document_score(p))
                counts.append(len(spans))
                bad.append([{"start": spans[i][0], "stop": spans[i][1], "score": float(p[i])} for i in np.flatnonzero(p >= THRESHOLD)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(scores, pa.float64()), pa.array(counts, pa.int64()), pa.array(bad, kind)], names=["doc_id", "held_out", "score", "n_sentences", "offending"])

    out = id_and_text(docs, id_col, text_col, held_out(id_col, 5).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, n_sentences long, offending array<struct<start:long,stop:long,score:double>>")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences", "offending")
