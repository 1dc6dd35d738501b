"""Signature trees: nodes hold OR-combined token bitmaps and size ranges; a dual traversal drops node pairs whose
greatest possible overlap is too small."""

from __future__ import annotations

import numpy as np

WORDS = 32  # of 64 bits
FANOUT = 8
#: Node pairs that are tested at once: a memory bound.
CHUNK = 1 << 13


def bitmap(shingles: np.ndarray) -> bytes:
    """At least four bits a shingle, 2048 or a power of two above: wide enough to tell sets of any size apart. Blocks of
    2048 bits, OR-combined, are the bitmap of that width."""
    width = max(WORDS * 64, 1 << int(4 * len(shingles) - 1).bit_length()) if len(shingles) else WORDS * 64
    bits = np.zeros(width, np.uint8)
    bits[(shingles % np.uint64(width)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(wide: np.ndarray, words: int = WORDS) -> np.ndarray:
    return np.bitwise_or.reduce(wide.reshape(-1, words), axis=0)


def may_link(x: np.ndarray, nx: int, y: np.ndarray, ny: int, num: int, den: int) -> bool:
    """Whether sets of nx and ny shingles may have num/den of their union in common, by bitmaps of the narrower width."""
    words = min(len(x), len(y))
    x, y = (v if len(v) == words else folded(v, words) for v in (x, y))
    excess = min(nx - int(np.bitwise_count(x).sum(dtype=np.int64)), ny - int(np.bitwise_count(y).sum(dtype=np.int64)))
    return (num + den) * (int(np.bitwise_count(x & y).sum(dtype=np.int64)) + excess) >= num * (nx + ny)


class Level:
    """Nodes of one height: OR of bitmaps, smallest and largest set size, most tokens above the bits, common component or -1."""

    def __init__(self, bits: np.ndarray, low: np.ndarray, high: np.ndarray, excess: np.ndarray, comp: np.ndarray):
        self.bits, self.low, self.high, self.excess, self.comp = bits, low, high, excess, comp

    def __len__(self) -> int:
        return len(self.low)

    def parents(self) -> Level:
        at = np.arange(0, len(self), FANOUT)
        low, high = np.minimum.reduceat(self.comp, at), np.maximum.reduceat(self.comp, at)
        return Level(np.bitwise_or.reduceat(self.bits, at, axis=0), np.minimum.reduceat(self.low, at), np.maximum.reduceat(self.high, at), np.maximum.reduceat(self.excess, at), np.where((low == high) & (low >= 0), low, -1))


class Tree:
    """Tree over sets. bits: (n, WORDS) bitmaps, sizes: numbers of shingles, comps: numbers of known components, from 0."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray, comps: np.ndarray):
        first = np.where(bits != 0, bits, np.uint64(0)).argmax(1)
        self.order = np.lexsort((bits[:, 1], bits[:, 0], first, comps, sizes))
        bits, sizes, comps = bits[self.order], sizes[self.order].astype(np.int64), comps[self.order].astype(np.int64)
        ones = np.bitwise_count(bits).sum(1).astype(np.int64)
        self.levels = [Level(bits, sizes, sizes, sizes - ones, comps)]
        while len(self.levels[-1]) > 1:
            self.levels.append(self.levels[-1].parents())

    def pairs(self, num: int, den: int):
        """Chunks (i, j) of members, as positions in the input, that may have num/den of their union in common and whose
        components differ. Every pair that has comes exactly once."""
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            depth, i, j = stack.pop()
            if len(i) > CHUNK:
                stack.append((depth, i[CHUNK:], j[CHUNK:]))
                i, j = i[:CHUNK], j[:CHUNK]
            x = self.levels[depth]
            keep = (x.comp[i] < 0) | (x.comp[i] != x.comp[j])
            keep &= (den * x.high[i] >= num * x.low[j]) & (den * x.high[j] >= num * x.low[i])
            i, j = i[keep], j[keep]
            overlap = np.bitwise_count(x.bits[i] & x.bits[j]).sum(1).astype(np.int64) + np.minimum(x.excess[i], x.excess[j])
            keep = (num + den) * overlap >= num * (x.low[i] + x.low[j])
            i, j = i[keep], j[keep]
            if not len(i):
                continue
            if depth == 0:
                on = i != j
                yield self.order[i[on]], self.order[j[on]]
                continue
            below = len(self.levels[depth - 1])
            a = (i[:, None] * FANOUT + np.arange(FANOUT)).repeat(FANOUT, 1).ravel()
            b = np.tile(j[:, None] * FANOUT + np.arange(FANOUT), (1, FANOUT)).ravel()
            on = (a < below) & (b < below) & (a <= b)
            stack.append((depth - 1, a[on], b[on]))


def leaders(bits: np.ndarray, sizes: np.ndarray, num: int, den: int, most: int = 64) -> list[tuple[int, int]]:
    """A few pairs that link most of a group: the member nearest to the bitwise majority is paired with all that it may
    link with; the same goes on among the others, for most leaders. As many pairs as members at most."""
    rest, out = np.arange(len(sizes)), []
    ones = np.bitwise_count(bits).sum(1).astype(np.int64)
    for _ in range(most):
        if len(rest) < 2:
            break
        own = bits[rest]
        major = np.packbits(2 * np.unpackbits(own.view(np.uint8), axis=1).sum(0, dtype=np.int64) > len(rest)).view(np.uint64)
        lead = rest[np.bitwise_count(own ^ major).sum(1, dtype=np.int64).argmin()]
        overlap = np.bitwise_count(own & bits[lead]).sum(1).astype(np.int64) + np.minimum(sizes[rest] - ones[rest], sizes[lead] - ones[lead])
        near = ((num + den) * overlap >= num * (sizes[rest] + sizes[lead])) & (rest != lead)
        out += [(int(lead), int(x)) for x in rest[near]]
        rest = rest[~near & (rest != lead)]
    return out
