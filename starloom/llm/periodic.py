"""Runs of repeated words by the linear tandem-repeat method of Gusfield and Stoye.

A run is a stretch of consecutive words with smallest period q, at least max(LEAST, RATIO * q) words long, that no neighbouring word
extends. Texts of a task are put together, words as numbers, and an exact filter leaves the stretches that may hold a run:
in a run of period q every gram of GRAM words occurs again q words away, so a word goes whose gram has no equal in the same document within
a RATIO-th of the stretch it lies in. What is left becomes one string with a separator of its own behind each stretch, and there

1. a suffix array with common prefixes stands for the suffix tree: a node is an interval of ranks with a length;
2. the Lempel-Ziv blocks are cut (longest earlier occurrence of each place), and squares about the border of two blocks are found by the
   longest common extensions of places k apart, both ways, for each k up to the blocks' lengths: a leftmost covering set;
3. each covering square is marked at its node, and walks along suffix links (from the leaf of place i to that of i + 1) mark
   its rotations as long as the period holds: the complete vocabulary of squares with primitive root;
4. all leaves below a marked node are occurrences of its square; occurrences of one period at consecutive places merge into a run.

Steps are taken for all stretches of a task at once, in arrays. Extensions come from ranks of substrings of 2^j words. Memory is a few
words for each word of a task's stretches and level; one document is never cut.

Defined results: a null or empty text has no words, no runs and collapses to nothing. Rows are judged one by one, so repeated rows
and repeated or null doc_ids get results of their own; ties between runs follow start, then period. An empty table gives
an empty result. Columns of any other name are not looked at.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from starloom.llm.common import free_name, small_batches
from starloom.llm.words import rows_of

LEAST, RATIO = 6, 4
#: Words worked on together, at least.
TOGETHER = 1 << 17


class Extensions:
    """Longest common extensions of places of a string, from the ranks of its substrings of 1, 2, 4, ... symbols."""

    def __init__(self, symbols: np.ndarray):
        self.n = n = len(symbols)
        rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        self.levels = [np.append(rank, -1)]
        step = 1
        while n and rank.max() < n - 1:
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - step)] = rank[step:] + 1
            rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64)
            self.levels.append(np.append(rank, -1))
            step *= 2
        self.rank = rank

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j on agree; i < j, either may be the end of the string."""
        at, to = i.copy(), j.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            same = level[np.minimum(at, self.n)] == level[np.minimum(to, self.n)]
            same &= to < self.n
            at += same << k
            to += same << k
        return at - i

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols up to i and up to j, included, agree; i < j, i may be -1."""
        at, to = i + 1, j + 1
        for k in range(len(self.levels) - 1, -1, -1):
            level, size = self.levels[k], 1 << k
            fits = at >= size
            same = fits & (level[np.where(fits, at - size, 0)] == level[np.where(fits, to - size, 1 if self.n > 1 else 0)])
            at -= same << k
            to -= same << k
        return i + 1 - at


def blocks(sa: np.ndarray, ext: Extensions) -> np.ndarray:
    """Where the Lempel-Ziv blocks begin: each is the longest string that begins earlier too, or one new symbol."""
    n = len(sa)
    before, after = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    stack: list[int] = []
    for at in sa.tolist():
        while stack and stack[-1] > at:
            after[stack.pop()] = at
        before[at] = stack[-1] if stack else -1
        stack.append(at)
    longest = np.ones(n, np.int64)
    for other in (before, after):
        known = np.flatnonzero(other >= 0)
        longest[known] = np.maximum(longest[known], ext.ahead(other[known], known))
    jump, starts, at = longest.tolist(), [], 0
    while at < n:
        starts.append(at)
        at += jump[at]
    return np.array(starts, np.int64)


def covering(starts: np.ndarray, ext: Extensions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, k) of the stretches of period k, at least 2 k long, about the borders of blocks."""
    n = ext.n
    ends = np.append(starts[1:], n)
    size = ends - starts
    following = np.append(size[1:], 0)
    # Squares reaching over the end of a block, by the distance k of the border from the place it is compared with.
    border = np.repeat(ends, size)
    k = np.arange(1, size.sum() + 1) - np.repeat(np.cumsum(size) - size, size)
    one = border - k, border, k
    # Squares about its beginning.
    both = size + following
    border = np.repeat(starts, both)
    k = np.arange(1, both.sum() + 1) - np.repeat(np.cumsum(both) - both, both)
    two = border, border + k, k
    i, j, k = (np.concatenate(c) for c in zip(one, two, strict=True))
    right, left = ext.ahead(i, j), ext.behind(i - 1, j - 1)
    found = right + left >= k
    i, j, k, right, left = (c[found] for c in (i, j, k, right, left))
    return i - left, j + right, k


def least_factor(most: int) -> np.ndarray:
    """The smallest prime factor of each number up to `most`."""
    out = np.arange(most + 1)
    for p in range(2, int(most**0.5) + 1):
        if out[p] == p:
            multiples = out[p * p :: p]
            multiples[multiples == np.arange(p * p, most + 1, p)] = p
    return out


def primitive(begin: np.ndarray, end: np.ndarray, k: np.ndarray, ext: Extensions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches, each once, with their smallest period."""
    if not len(k):
        return begin, end, k
    # Stretches that begin alike and end alike are one; any period of it will do to start from.
    order = np.lexsort((k, end, begin))
    begin, end, k = begin[order], end[order], k[order]
    new = np.r_[True, (begin[1:] != begin[:-1]) | (end[1:] != end[:-1])]
    begin, end, k = begin[new], end[new], k[new].copy()
    factor, left = least_factor(int(k.max())), k.copy()
    while (left > 1).any():
        open_ = np.flatnonzero(left > 1)
        p = factor[left[open_]]
        shorter = k[open_] // p
        has = ext.ahead(begin[open_], begin[open_] + shorter) >= end[open_] - begin[open_] - shorter
        k[open_] = np.where(has, shorter, k[open_])
        left[open_] //= p
    return begin, end, k


def vocabulary(begin: np.ndarray, end: np.ndarray, k: np.ndarray, sa: np.ndarray, ext: Extensions) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first rank, end rank, k) of the node of each different square: covering squares and their rotations along suffix links."""
    n = len(sa)
    turns = np.minimum(k, end - begin - 2 * k + 1)
    which = np.repeat(np.arange(len(k)), turns)
    step = np.arange(turns.sum()) - np.repeat(np.cumsum(turns) - turns, turns)
    leaf, size = ext.rank[begin[which] + step], 2 * k[which]
    # least[j][r]: smallest of the common prefixes of ranks r - 1 and r, ..., r + 2^j - 2 and r + 2^j - 1.
    common = np.zeros(n, np.int64)
    common[1:] = _common(sa, ext)
    least = [common]
    while 2 << (len(least) - 1) <= n:
        last, j = least[-1], len(least) - 1
        least.append(np.minimum(last[: len(last) - (1 << j)], last[1 << j :]))
    low, high = leaf.copy(), leaf + 1
    for j in range(len(least) - 1, -1, -1):
        reach = 1 << j
        back = np.flatnonzero(low - reach >= 0)
        back = back[least[j][low[back] - reach + 1] >= size[back]]
        low[back] -= reach
        on = np.flatnonzero(high + reach <= n)
        on = on[least[j][high[on]] >= size[on]]
        high[on] += reach
    # A node and a length are one square; walks that meet go on as one.
    _, first = np.unique(low * (n + 1) + size, return_index=True)
    return low[first], high[first], size[first] // 2


def _common(sa: np.ndarray, ext: Extensions) -> np.ndarray:
    a, b = np.minimum(sa[:-1], sa[1:]), np.maximum(sa[:-1], sa[1:])
    return ext.ahead(a, b)


def runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all maximal repetitions of a string that hold a square, by start, then period."""
    none = np.empty(0, np.int64)
    if len(symbols) < 2:
        return none, none, none
    ext = Extensions(symbols)
    sa = np.empty(ext.n, np.int64)
    sa[ext.rank] = np.arange(ext.n)
    begin, end, k = primitive(*covering(blocks(sa, ext), ext), ext)
    if not len(k):
        return none, none, none
    low, high, k = vocabulary(begin, end, k, sa, ext)
    many = high - low
    which = np.repeat(np.arange(len(k)), many)
    at = sa[low[which] + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    period = k[which]
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    new = np.r_[True, (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)]
    last = np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]
    start, period, end = at[new], period[new], at[last] + 2 * period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def stretches(ids: np.ndarray, doc: np.ndarray, least: int, ratio: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the stretches of words that may hold a run: no run reaches out of one, and no document border lies in one."""
    # The longest gram that each place of any run has again q words before or behind it in the run.
    gram = min(max(least, ratio * q) - 2 * q + 1 for q in range(1, least + 1))
    n = len(ids) - gram + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(gram):
        h = h * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n].astype(np.uint64) + np.uint64(1)
    h += doc[:n].astype(np.uint64) * np.uint64(0xD1342543DE82EF95)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    bits = np.uint64(max(1, int(n).bit_length()))
    key = np.sort((h >> bits << bits) | np.arange(n, dtype=np.uint64))
    place = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    same = (key[1:] >> bits) == (key[:-1] >> bits)
    apart = np.where(same, place[1:] - place[:-1], n)
    gap = np.full(n, n, np.int64)
    gap[place[1:]] = apart
    gap[place[:-1]] = np.minimum(gap[place[:-1]], apart)
    open_ = (gap < n) & (doc[:n] == doc[gram - 1 :])
    border = doc[1:n] != doc[: n - 1]
    while True:
        first = np.flatnonzero(open_ & np.r_[True, ~open_[:-1] | border])
        end = np.flatnonzero(open_ & np.r_[~open_[1:] | border, True]) + gram
        near = np.repeat((end - first) // ratio, end - first - gram + 1)
        inside = np.flatnonzero(open_)
        far = gap[inside] > near
        if not far.any():
            long = end - first >= least
            return first[long], end[long]
        open_[inside[far]] = False


def found(texts: list[list[bytes]], least: int = LEAST, ratio: int = RATIO) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    words = [w for t in texts for w in t]
    number = dict(zip(words, range(len(words)), strict=True))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    size = np.array([len(t) for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    first, end = stretches(ids, doc, least, ratio)
    if not len(first):
        return out
    n = end - first
    place = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
    # Each stretch is followed by a symbol that occurs nowhere else.
    behind = np.cumsum(n) + np.arange(len(n))
    whole = np.ones(n.sum() + len(n), bool)
    whole[behind] = False
    symbols, source = np.empty(len(whole), np.int64), np.empty(len(whole), np.int64)
    symbols[whole], symbols[behind], source[whole] = ids[place], len(words) + np.arange(len(n)), place
    start, stop, period = runs(symbols)
    kept = stop - start >= np.maximum(least, ratio * period)
    begin = np.cumsum(size) - size
    for s, e, q in zip(start[kept].tolist(), stop[kept].tolist(), period[kept].tolist(), strict=True):
        d = int(doc[source[s]])
        out[d].append((int(source[s] - begin[d]), e - s, q))
    return out


def collapsed(words: list[bytes], found_: list[tuple[int, int, int]]) -> list[bytes]:
    """words without those that a run holds after its first period."""
    if not found_:
        return words
    gone = np.zeros(len(words) + 1, np.int32)
    for s, n, q in found_:
        gone[s + q] += 1
        gone[s + n] -= 1
    return [w for w, g in zip(words, np.cumsum(gone[:-1]).tolist(), strict=True) if not g]


def together(texts: Iterator[tuple[int, list[bytes]]], least: int, ratio: int, size: int = TOGETHER) -> Iterator[tuple[int, list[bytes], list[tuple[int, int, int]]]]:
    """(row, words, runs) of each (row, words)."""
    held: list[tuple[int, list[bytes]]] = []
    n = 0
    for item in texts:
        held.append(item)
        n += len(item[1])
        if n >= size:
            yield from ((r, w, f) for (r, w), f in zip(held, found([w for _, w in held], least, ratio), strict=True))
            held, n = [], 0
    if held:
        yield from ((r, w, f) for (r, w), f in zip(held, found([w for _, w in held], least, ratio), strict=True))


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's texts: one document in ten has a tail that repeats; which, and how, follows from its number. Without one it stays."""
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digest(docs: DataFrame, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """The contract's columns, of its texts with planted tails."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            ids = b.column("doc_id").to_pylist()
            texts = ((row, planted(text.split(), ids[row])) for row, text in enumerate(rows_of(b)))
            out = []
            for row, words, f in together(texts, least, ratio):
                best = max(f, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if f else None
                head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in f)
                out.append((ids[row], len(f), *head, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, f))).hexdigest()))
            kinds = [pa.int64()] * 6 + [pa.string()] * 2
            columns = zip(*out, strict=True) if out else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in DIGEST.split(", ")])

    thin = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return thin.mapInArrow(run, DIGEST)


def periodic_runs(docs: DataFrame, least: int = LEAST, ratio: int = RATIO) -> DataFrame:
    """docs with runs (start, length, period of each) and collapsed, the text's words without what runs repeat, joined by blanks.

    A text without runs stays as it is; a null one stays null and has no runs. Columns named alike in docs get underscores before the new ones.
    """
    runs_, text_ = free_name(docs, "runs"), free_name(docs, "collapsed")
    kept = small_batches(docs).select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = list(rows_of(b))
            listed, out = [[] for _ in texts], [t.decode() for t in texts]
            for row, words, f in together(enumerate(t.split() for t in texts), least, ratio):
                if f:
                    listed[row] = [{"start": s, "length": n, "period": q} for s, n, q in f]
                    out[row] = b" ".join(collapsed(words, f)).decode()
            there = b.column("text").is_valid().to_pylist()
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(listed, kind), pa.array([t if ok else None for t, ok in zip(out, there, strict=True)], pa.string())], names=["row", "runs", "collapsed"])

    listed_ = ArrayType(StructType([StructField(c, LongType()) for c in ("start", "length", "period")]))
    schema = kept.select("row").schema.add("runs", listed_).add("collapsed", "string")
    return kept.mapInArrow(run, schema).select("row.*", F.col("runs").alias(runs_), F.col("collapsed").alias(text_))
