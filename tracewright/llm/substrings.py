"""Removal of word sequences that an earlier document has, found by difference-cover anchors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import id_and_text, mixed, partitions_for, trimmed, tune, window_hashes, word_hashes

MIN_WORDS = 13
#: Perfect difference covers: fixed values. Any two residues, shifted alike by less than the period, both fall in the set.
COVERS = {3: (0, 1), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
#: Hashes after which a map task sorts and sends what it holds: a memory bound.
FLUSH = 2_000_000
#: Bytes of an anchor's hash that travel: anchors only propose windows, so a clash costs work and no more.
ANCHOR_BYTES = 6
BLOBS = "part int, known boolean, docs binary, counts binary, hashes binary"


def cover_for(width: int) -> tuple[int, tuple[int, ...]]:
    """The longest period that leaves anchors of half the width at least; period 1 for very short windows."""
    return max(((v, d) for v, d in COVERS.items() if 2 * v <= width + 1), default=(1, (0,)))


def anchors(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the cover and the hashes of the anchors there. A match of width words holds an anchor that is aligned
    alike in both texts, since anchors are width - period + 1 words long and one starts within the first period words."""
    period, cover = cover_for(width)
    found = window_hashes(h, width - period + 1)
    at = np.flatnonzero(np.isin(np.arange(len(found)) % period, cover))
    return at, found[at]


def candidates(h: np.ndarray, width: int, shared: np.ndarray) -> np.ndarray:
    """Starts of the windows that hold an anchor among shared."""
    period, _ = cover_for(width)
    n = len(h) - width + 1
    if n <= 0 or not len(shared):
        return np.empty(0, np.int64)
    at, found = anchors(h, width)
    hit = at[np.isin(found & np.uint64(256**ANCHOR_BYTES - 1), shared)]
    edge = np.zeros(len(h) + period + 1, np.int64)
    np.add.at(edge, np.maximum(hit - period + 1, 0), 1)
    np.add.at(edge, hit + 1, -1)
    return np.flatnonzero(np.cumsum(edge)[:n] > 0)


def _groups(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows sorted by hash, and for each row the smallest and largest id of its hash."""
    order = np.argsort(h, kind="stable")
    h, ids = h[order], ids[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    if not len(h):
        return h, ids, ids, ids
    runs = np.diff(np.append(starts, len(h)))
    return h, ids, np.repeat(np.minimum.reduceat(ids, starts), runs), np.repeat(np.maximum.reduceat(ids, starts), runs)


def _part(ids: np.ndarray, n_parts: int) -> np.ndarray:
    """The part to which a document's answers go, by a hash: ids may come in strides."""
    return (mixed(ids.view(np.uint64)) % np.uint64(n_parts)).astype(np.int64)


def _pack(h: np.ndarray, size: int) -> bytes:
    """The low size bytes of each hash."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def _unpack(data: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.reshape(-1).view("<u8")


def _blobs(parts: np.ndarray, ids: np.ndarray, h: np.ndarray, known: bool, size: int) -> Iterator[tuple]:
    """One row per part: its documents, how many hashes each has, and the hashes."""
    if not len(parts):
        return
    order = np.lexsort((ids, parts))
    parts, ids, h = parts[order], ids[order], h[order]
    cuts = np.flatnonzero(np.concatenate([[True], parts[1:] != parts[:-1]]))
    for i, j in zip(cuts, np.append(cuts[1:], len(parts)), strict=True):
        docs, counts = np.unique(ids[i:j], return_counts=True)
        yield int(parts[i]), known, docs.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), _pack(h[i:j], size)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "known", "docs", "counts", "hashes"])


def _answers(rows: DataFrame, hashes: Callable, n_parts: int, later_only: bool, size: int) -> DataFrame:
    """id, hashes binary: per document the hashes, size bytes each, that others have too (later_only: that a smaller id has).

    rows: doc_id, text and what else hashes(text, extra) takes. Map tasks group their own hashes first: of a hash they
    ask for one document only, however many have it, and answer for the others themselves. So no reducer gets more
    rows of a hash than there are map tasks. Questions and answers travel packed, a row for each pair of partitions.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, n, mask = [], [], 0, np.uint64(256**size - 1)

        def flush() -> pa.RecordBatch:
            h, who, low, high = _groups(np.concatenate(held), np.concatenate(ids))
            ask = who == low
            known = who > low if later_only else low != high
            return _batch([*_blobs(((h[ask] >> np.uint64(24)) % np.uint64(n_parts)).astype(np.int64), who[ask], h[ask], False, size), *_blobs(_part(who[known], n_parts), who[known], h[known], True, size)])

        for b in batches:
            more = b.column(2).to_pylist() if b.num_columns > 2 else [None] * b.num_rows
            for doc, text, extra in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), more, strict=True):
                found = np.unique(hashes(text, extra) & mask) if doc is not None else ()
                if len(found):
                    held.append(found)
                    ids.append(np.full(len(found), doc, np.int64))
                    n += len(found)
            if n >= FLUSH:
                yield flush()
                held, ids, n = [], [], 0
        if n:
            yield flush()

    def opened(docs: bytes, counts: bytes, h: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.frombuffer(docs, "<i8"), np.frombuffer(counts, "<u4")), _unpack(h, size)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            known = np.array(b.column(1).to_pylist(), bool)
            if known.any():
                yield b.filter(pa.array(known))
            asked += [opened(*x) for x in zip(*(b.filter(pa.array(~known)).column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
        if asked:
            h, ids, low, high = _groups(np.concatenate([x[1] for x in asked]), np.concatenate([x[0] for x in asked]))
            on = ids > low if later_only else low != high
            yield _batch(list(_blobs(_part(ids[on], n_parts), ids[on], h[on], True, size)))

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [opened(*x) for b in batches for x in zip(*(b.column(c).to_pylist() for c in (2, 3, 4)), strict=True)]
        if got:
            ids, h = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
            order = np.argsort(ids, kind="stable")
            ids, h = ids[order], h[order]
            docs, starts = np.unique(ids, return_index=True)
            ends = np.append(starts[1:], len(ids))
            for k in range(0, len(docs), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(docs[k : k + 4096]), pa.array([_pack(h[i:j], size) for i, j in zip(starts[k : k + 4096], ends[k : k + 4096], strict=True)], pa.binary())], names=["id", "hashes"])

    asked = rows.mapInArrow(trimmed(send), BLOBS).repartition(n_parts, "part")
    return asked.mapInArrow(trimmed(answer), BLOBS).repartition(n_parts, "part").mapInArrow(trimmed(assemble), "id long, hashes binary")


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove each word within a run of min_words words that also occurs in a document of smaller id.

    Returns per row: doc_id, n_words, n_removed, kept_text (kept words joined by a space), and the columns of carry.
    Two rounds over the text: anchors that several documents share, then the windows around those anchors, of which the
    smallest id is found. Windows are judged on the input. Texts are shuffled once and that exchange serves both rounds.

    Null texts have no words. Rows of a null id neither lose words nor make others lose them. Rows that share an id are
    one document: they don't remove from each other, and lose what a smaller id has. An empty table gives no rows.
    Other columns, whatever their names, are ignored unless in carry.
    """
    tune(docs.sparkSession)
    n_parts = partitions_for(docs)
    extra = [F.struct(*(F.col(c) for c in carry)).alias("carry")] if carry else []
    light = id_and_text(docs, id_col, text_col)
    dealt = id_and_text(docs, id_col, text_col, *extra).repartition(n_parts, "doc_id")

    def joined(answers: DataFrame) -> DataFrame:
        return dealt.join(answers.hint("shuffle_hash"), dealt["doc_id"] == answers["id"], "left")

    shared = _answers(light, lambda text, _: anchors(word_hashes(text.split()), min_words)[1], n_parts, False, ANCHOR_BYTES)

    def near(text: bytes, found: bytes | None) -> np.ndarray:
        if not found:
            return np.empty(0, np.uint64)
        h = word_hashes(text.split())
        return window_hashes(h, min_words)[candidates(h, min_words, _unpack(found, ANCHOR_BYTES))]

    earlier = _answers(joined(shared).select("doc_id", "text", "hashes"), near, n_parts, True, 8)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = text.split()
                n_words.append(len(words))
                if found and len(words) >= min_words:
                    on = np.flatnonzero(np.isin(window_hashes(word_hashes(words), min_words), np.frombuffer(found, "<u8")))
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, on, 1)
                    np.add.at(edge, on + min_words, -1)
                    left = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    words = [words[i] for i in left]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
            columns = [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns + ([b.column(3)] if carry else []), names=["doc_id", "n_words", "n_removed", "kept_text", *["carry"] * bool(carry)])

    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    if carry:
        schema += f", carry {dealt.schema['carry'].dataType.simpleString()}"
    out = joined(earlier).select("doc_id", "text", "hashes", *["carry"] * bool(carry)).mapInArrow(trimmed(cut), schema)
    own: list[Column] = [F.col(c) for c in ("doc_id", "n_words", "n_removed", "kept_text")]
    return out.select(*own, *(F.col("carry")[c].alias(c) for c in carry))
