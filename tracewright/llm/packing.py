"""Packing of token ids into training windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_and_text, trimmed, tune
from .tokens import END, default_tokenizer, tokenizer_for

WINDOW = 4096
#: Tokens of a block: its pieces are packed together in memory. A memory bound, not a limit of the input.
BLOCK_TOKENS = 1 << 20
#: Part of the capacity that windows are left with on average, so that near-equal ones need no more windows.
SPARE = 128
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, padded_tokens long"


def difference(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Split items 0..n-1 of these sizes into k sets of near-equal sums: Karmarkar-Karp largest differencing for k ways.

    Each partial partition is k sums with their members; the two of the largest spread are merged, the largest sum of
    one with the smallest of the other, and sums are lowered by their least, until one partition is left.
    """
    n = len(sizes)
    left, right = [-1] * n, [-1] * n  # a node above n joins two others; below, it is an item
    heap = []
    for i, s in enumerate(sizes):
        sums = np.zeros(k, np.int64)
        sums[0] = s
        who = np.full(k, -1, np.int64)
        who[0] = i
        heap.append((-int(s) if k > 1 else 0, i, sums, who))
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, a, wa = heapq.heappop(heap)
        _, _, b, wb = heapq.heappop(heap)
        sums, who, other = a + b[::-1], wa.copy(), wb[::-1]
        for j in np.flatnonzero(other >= 0):
            if who[j] < 0:
                who[j] = other[j]
            else:
                left.append(int(who[j]))
                right.append(int(other[j]))
                who[j] = len(left) - 1
        by = np.argsort(-sums, kind="stable")
        sums, who = sums[by] - sums.min(), who[by]
        order += 1
        heapq.heappush(heap, (-int(sums[0]), order, sums, who))
    out: list[list[int]] = []
    for root in heap[0][3] if heap else []:
        items, todo = [], [int(root)] if root >= 0 else []
        while todo:
            x = todo.pop()
            if x < n:
                items.append(x)
            else:
                todo += [right[x], left[x]]
        out.append(items)
    return out


def windows(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Sets of items, none above capacity: the number of sets rises whenever the fullest exceeds it. Sizes are at most capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        found = difference(sizes, k)
        if max((int(sizes[x].sum()) for x in found if x), default=0) <= capacity:
            return [x for x in found if x]
        k += 1


def powers(n: int) -> list[int]:
    """n as a sum of falling powers of two: sequences of those lengths need no padding."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def padded(n: int, capacity: int) -> int:
    return n if n & (n - 1) == 0 else capacity


class Packer:
    """Packs the documents of one partition. Memory: a block and the document at hand."""

    def __init__(self, part: int, capacity: int = WINDOW, block: int = BLOCK_TOKENS):
        self.next_id, self.capacity, self.block = part << 33, capacity, max(block, 2 * capacity)
        self.waiting: list[tuple[int | None, int, bytes, int]] = []  # doc, start, ids, tokens of the document
        self.tokens = 0

    def add(self, doc: int | None, ids: bytes) -> Iterator[tuple]:
        """Full windows are cut off a long document; its rest waits for the block."""
        total = len(ids) // 4
        full = total - total % self.capacity if total >= self.capacity else 0
        for at in range(0, full, self.capacity):
            yield from self._sequence([(doc, at, ids[4 * at : 4 * (at + self.capacity)], total)])
        if full < total:
            self.waiting.append((doc, full, ids[4 * full :], total))
            self.tokens += total - full
        if self.tokens >= self.block:
            yield from self.flush(last=False)

    def flush(self, last: bool = True) -> Iterator[tuple]:
        """Pack whole pieces that wait into windows by differencing, as many as fill them but for a spare part; others wait
        on. In the end what is left, about a window, is cut into sequences of powers of two, which have no padding."""
        room = self.tokens // self.capacity * (self.capacity - self.capacity // SPARE)
        head, rest, used = [], [], 0
        for piece in self.waiting:
            n = len(piece[2]) // 4
            fits = used + n <= room
            (head if fits else rest).append(piece)
            used += n * fits
        self.waiting, self.tokens = rest, self.tokens - used
        if head:
            for members in windows(np.array([len(x[2]) // 4 for x in head], np.int64), self.capacity):
                yield from self._sequence([head[i] for i in members])
        if last:
            yield from self._exact()

    def _exact(self) -> Iterator[tuple]:
        left = self.waiting
        self.waiting, n, self.tokens = [], self.tokens, 0
        lengths = [self.capacity] * (n // self.capacity) + powers(n % self.capacity)
        at, skip = 0, 0
        for length in lengths:
            own = []
            while length:
                doc, start, ids, total = left[at]
                here = min(length, len(ids) // 4 - skip)
                own.append((doc, start + skip, ids[4 * skip : 4 * (skip + here)], total))
                length -= here
                skip += here
                if 4 * skip == len(ids):
                    at, skip = at + 1, 0
            yield from self._sequence(own)

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        number, self.next_id, at = self.next_id, self.next_id + 1, 0
        whole = sum(len(p[2]) // 4 for p in pieces)
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            yield doc, start, n, zlib.crc32(ids), total, number, at, whole, padded(whole, self.capacity)
            at += n


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = WINDOW, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all texts into sequences of at most capacity tokens; one row per piece of a document.

    Documents longer than capacity give full windows and a rest; rests and shorter documents stay whole, and the number
    of windows rises whenever the fullest exceeds the capacity. Only what a partition has left in the end is cut.
    Blocks are packed where their documents are read: nothing is shuffled, and a lost task is simply run again.
    Null or empty texts are a document of the end id alone. Repeated rows are packed each; a null id stays null.
    An empty table gives no rows. Other columns are ignored. sequence_id is unique over the table.
    """
    tune(docs.sparkSession)
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = tokenizer_for(path), None
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(names))], names=names)

        for b in batches:
            if not b.num_rows:
                continue
            packer = packer or Packer(b.column(2)[0].as_py(), capacity)
            rows = [r for doc, ids in zip(b.column(0).to_pylist(), coder.encode(b.column(1).to_pylist(), end), strict=True) for r in packer.add(doc, ids)]
            yield batch(rows)
        if packer:
            yield batch(list(packer.flush()))

    return id_and_text(docs, id_col, text_col, F.spark_partition_id().alias("part")).mapInArrow(trimmed(run), SCHEMA)
