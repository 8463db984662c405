"""Windows of fixed length over many documents, told apart by anchors.

A window's anchor is the gram inside it with the smallest hash, the first one on ties: a function of the window's content, so
equal windows have equal anchors at equal offsets. Neighbouring windows mostly share their anchor; such a run is one segment
and stands for all its windows. Counts of anchors never fall below counts of windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Items of a piece; a longer document is cut into pieces that overlap by a window less one item.
PIECE = 1 << 18
#: Low bits of a key that hold a position; they are more than a batch of pieces needs.
PLACE = np.uint64(24)
MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers of a multiplier and of its inverse modulo 2^64."""
    known = _powers.get(which)
    if known is None or len(known[0]) < n:
        n = 1 << max(12, int(n - 1).bit_length())
        m = int(MULTIPLIERS[which])
        up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
        up[1:], down[1:] = np.uint64(m), np.uint64(pow(m, -1, 1 << 64))
        known = _powers[which] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return known


class Rolling:
    """Hashes of any ranges of an array of 64-bit items."""

    def __init__(self, items: np.ndarray, which: int):
        up, self.down = powers(which, len(items) + 1)
        self.sums = np.zeros(len(items) + 1, np.uint64)
        np.cumsum(items * up[: len(items)], out=self.sums[1:])

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.empty(0, np.uint64)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i, from running minima of blocks of that width in both directions."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def batches(documents: Iterator[tuple[int, np.ndarray]], window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(items, piece's document, piece's first item, piece's length), with documents cut into pieces and pieces put together."""
    held: list[tuple[int, int, np.ndarray]] = []
    size = 0
    for doc, items in documents:
        at = 0
        while len(items) - at >= window:
            part = items[at : at + PIECE]
            held.append((doc, at, part))
            size += len(part)
            if size >= PIECE:
                yield _together(held)
                held, size = [], 0
            if at + PIECE >= len(items):
                break
            at += PIECE - window + 1
    if held:
        yield _together(held)


def _together(held: list[tuple[int, int, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return np.concatenate([h[2] for h in held]), np.array([h[0] for h in held]), np.array([h[1] for h in held]), np.array([len(h[2]) for h in held])


def segments(documents: Iterator[tuple[int, np.ndarray]], window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, first window, windows, anchor's hash, segment's two hashes, anchor's place in the document) of all segments, as arrays."""
    for items, doc, first, length in batches(documents, window):
        one, two = Rolling(items, 0), Rolling(items, 1)
        grams = one.every(gram)
        key = (grams >> PLACE << PLACE) | np.arange(len(grams), dtype=np.uint64)
        place = (sliding_min(key, window - gram + 1) & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
        ends = np.cumsum(length)
        starts = ends - length
        n = length - window + 1
        whole = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())  # windows that lie in one piece
        piece = np.repeat(np.arange(len(n)), n)
        anchor = place[whole]
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])])
        count = np.diff(np.r_[new, len(whole)])
        begin, which = whole[new], piece[new]
        end = begin + count + window - 1
        yield doc[which], begin - starts[which] + first[which], count, grams[anchor[new]], one.at(begin, end), two.at(begin, end), anchor[new] - starts[which] + first[which]


def union_length(start: np.ndarray, end: np.ndarray) -> tuple[int, int, list[tuple[int, int]]]:
    """Items covered by ranges, the number of maximal runs, and the runs."""
    if not len(start):
        return 0, 0, []
    order = np.argsort(start, kind="stable")
    start, far = start[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.r_[True, start[1:] > far[:-1]])
    last = np.r_[new[1:] - 1, len(start) - 1]
    runs = list(zip(start[new].tolist(), far[last].tolist(), strict=True))
    return int(sum(b - a for a, b in runs)), len(runs), runs
