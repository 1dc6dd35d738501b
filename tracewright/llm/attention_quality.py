"""Quality classifier: attention-based multiple-instance learning over the passages of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import held_out, id_and_text, mixed, trimmed, tune, word_hashes
from .labelled import training_sample

PASSAGE_WORDS, HASHED, HIDDEN, THRESHOLD = 64, 8, 16, 0.3
#: Labelled documents to train on, at most, for each label.
TRAIN = {0: 2000, 1: 4000}
_CLASSES = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&<>", b"|", b"!?", b".,;:", b"@/\\_=+~^{}[]()\"'`-", bytes(range(128, 192)), bytes(range(192, 256)))
_OF = np.full(256, len(_CLASSES), np.uint8)
for _k, _c in enumerate(_CLASSES):
    _OF[list(_c)] = _k
N_FEATURES = len(_CLASSES) + 6 + HASHED


def passages(text: bytes) -> np.ndarray:
    """One vector per passage of 64 words: shares of character classes, lengths, repetition, and a signed hash sum of its words."""
    words = text.split()
    if not words:
        return np.zeros((1, N_FEATURES), np.float32)
    n = len(words)
    starts = np.arange(0, n, PASSAGE_WORDS)
    sizes = np.diff(np.append(starts, n)).astype(np.float32)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths)
    flat = _OF[np.frombuffer(b"".join(words), np.uint8)]
    bounds = np.concatenate([[0], ends])[starts]
    chars = np.diff(np.append(bounds, ends[-1])).astype(np.float32)
    out = np.zeros((len(starts), N_FEATURES), np.float32)
    part = np.repeat(np.arange(len(starts)), np.diff(np.append(bounds, ends[-1])))
    k = len(_CLASSES)
    out[:, :k] = np.bincount(part * (k + 1) + flat, minlength=len(starts) * (k + 1)).reshape(-1, k + 1)[:, :k] / chars[:, None]
    h = word_hashes(words)
    group = np.arange(n) // PASSAGE_WORDS
    same = np.concatenate([[False], h[1:] == h[:-1]])
    order = np.lexsort((h, group))
    again = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (group[order][1:] == group[order][:-1])])
    out[:, k] = chars / sizes / 10
    out[:, k + 1] = np.add.reduceat(lengths.astype(np.float32) ** 2, starts) / sizes / 100
    out[:, k + 2] = np.add.reduceat(same, starts, dtype=np.float32) / sizes
    out[:, k + 3] = np.bincount(group[order], again, len(starts)) / sizes
    out[:, k + 4] = np.log1p(sizes) / 4
    out[:, k + 5] = np.log1p(n) / 10
    signs = np.unpackbits((mixed(h) & np.uint64(0xFF)).astype(np.uint8)[:, None], axis=1)[:, :HASHED].astype(np.float32) * 2 - 1
    out[:, k + 6 :] = np.add.reduceat(signs, starts, axis=0) / np.sqrt(sizes)[:, None] / 4
    return out


class AttentionMIL:
    """h = tanh(Wx); weight of a passage: softmax of w.(tanh(Vh) * sigmoid(Uh)); score: sigmoid of c.(weighted h) + d."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        k = HIDDEN
        self.p = {"W": rng.normal(0, 0.5, (N_FEATURES, k)), "b": np.zeros(k), "V": rng.normal(0, 0.3, (k, k)), "U": rng.normal(0, 0.3, (k, k)), "w": rng.normal(0, 0.3, k), "c": rng.normal(0, 0.3, k), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(N_FEATURES), np.ones(N_FEATURES)

    def _forward(self, x: np.ndarray, starts: np.ndarray):
        p = self.p
        h = np.tanh((x - self.mean) / self.scale @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * g) @ p["w"]
        runs = np.diff(np.append(starts, len(x)))
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), runs))
        a = e / np.repeat(np.add.reduceat(e, starts), runs)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return h, t, g, a, z, runs, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))

    def fit(self, bags: list[np.ndarray], y: np.ndarray, weight: np.ndarray, steps: int = 250, rate: float = 0.03, decay: float = 1e-4) -> AttentionMIL:
        x = np.concatenate(bags).astype(np.float64)
        starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)
        self.mean, self.scale = x.mean(0), x.std(0) + 0.05
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        xs = (x - self.mean) / self.scale
        for step in range(1, steps + 1):
            p = self.p
            h, t, g, a, z, runs, out = self._forward(x, starts)
            dl = weight * (out - y) / weight.sum()
            dz = np.repeat(dl[:, None] * p["c"], runs, axis=0)
            da = (dz * h).sum(1)
            ds = a * (da - np.repeat(np.add.reduceat(a * da, starts), runs))
            dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
            dh = (a[:, None] * dz + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
            grad = {"W": xs.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": ds @ (t * g), "c": z.T @ dl, "d": np.array([dl.sum()])}
            for k in p:
                gk = grad[k] + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * gk
                v2[k] = 0.999 * v2[k] + 0.001 * gk * gk
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Score of each bag, and the weight of its most attended passage."""
        starts = np.concatenate([[0], np.cumsum([len(b) for b in bags])[:-1]]).astype(np.int64)
        *_, a, _, _, out = self._forward(np.concatenate(bags).astype(np.float64), starts)
        return out, np.maximum.reduceat(a, starts)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", limits: dict[int, int] | None = None) -> AttentionMIL:
    """A model of the labels, of a bounded sample; without labelled rows it scores by its initial weights."""
    texts, y = training_sample(docs, labels, label_col, limits or TRAIN, id_col, text_col)
    model = AttentionMIL()
    if len(set(y)) < 2:
        return model
    return model.fit([passages(t) for t in texts], np.array(y, float), np.ones(len(y)))


def score(docs: DataFrame, model: AttentionMIL, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, and the columns of carry: every passage of every text is scored.

    Null and empty texts are one passage without words. Repeated rows are scored each; a null id stays null; an empty
    table gives no rows; columns not in carry, whatever their names, are ignored.
    """
    tune(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few kilobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                bags = [passages(t) for t in b.column(1).to_pylist()]
                out, _ = shared.value.score(bags)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out), pa.array([len(x) for x in bags], pa.int64()), *b.columns[3:]], names=["doc_id", "held_out", "score", "n_passages", *b.schema.names[3:]])

    extra = [F.struct(*(F.col(c) for c in carry)).alias("carry")] if carry else []
    source = id_and_text(docs, id_col, text_col, held_out(id_col, 5).alias("held_out"), *extra)
    schema = "doc_id long, held_out boolean, score double, n_passages long" + (f", carry {source.schema['carry'].dataType.simpleString()}" if carry else "")
    out = source.mapInArrow(trimmed(run), schema)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages", *(F.col("carry")[c].alias(c) for c in carry))
