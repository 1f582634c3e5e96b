"""Periodic run detection: maximal repetitions of words, by descending-LCP Kruskal.

A *run* is a stretch of words with smallest period q, at least two periods long, that no neighbouring
word extends.  Suffixes that share a prefix of l words form a class; uniting the classes by decreasing
l (the longest common prefix, LCP, of neighbours in the suffix order are the edges, as in Kruskal's spanning
tree) makes any two positions of two classes united at l have an LCP of exactly l.  Each class keeps
its positions in order.  When two classes are united, positions i < j of different classes that become
neighbours and stand d = j - i <= l apart repeat with period d from i up to j + l; they are the seed
of a run if the words before them differ.  The first two periods of every run are such a seed: between
them the same words cannot occur again, as the period is the smallest one.

A run of at least ``least`` words and two periods has an LCP of at least ``least`` / 2 between its first two
periods, so only positions whose next ``least`` / 2 words occur twice in the document are sorted and
united; a document without repeated passages costs one sorted hash per word.

Documents are independent rows: nothing is shuffled, and a group of copies of any size is dealt out
like other rows.  Memory grows with the longest text.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behaviorkit.llm.common import give_back, slices

_SLICE = 1_000_000      # characters of texts that are worked on together
_BLOCK = 1024           # positions in a block of an ordered set, about


class Positions:
    """An ordered set of positions in blocks: neighbours and insertion without moving the whole set."""

    __slots__ = ("blocks", "tops", "size")

    def __init__(self, values: list[int]):
        self.blocks = [values[i:i + _BLOCK] for i in range(0, len(values), _BLOCK)]
        self.tops = [b[-1] for b in self.blocks]
        self.size = len(values)

    def __iter__(self):
        return chain.from_iterable(self.blocks)

    def around(self, x: int) -> tuple[int, int]:
        """The next smaller and the next larger position, -1 where there is none."""
        at = bisect_left(self.tops, x)
        if at == len(self.blocks):
            return self.tops[-1], -1
        b = self.blocks[at]
        i = bisect_left(b, x)
        return (b[i - 1] if i else self.tops[at - 1] if at else -1), b[i]

    def add(self, x: int) -> None:
        at = min(bisect_left(self.tops, x), len(self.blocks) - 1)
        b = self.blocks[at]
        insort(b, x)
        if len(b) > 2 * _BLOCK:
            self.blocks[at:at + 1] = [b[:_BLOCK], b[_BLOCK:]]
            self.tops[at:at + 1] = [b[_BLOCK - 1], b[-1]]
        else:
            self.tops[at] = b[-1]
        self.size += 1


def suffix_order(words: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose next ``least`` words occur again in their document, in suffix order, and whether each
    shares these words with the one before it.

    ``words`` are numbers above 0 that no two documents share, with a 0 after each document; ``ends``
    holds for every position the place of that 0.
    """
    n = len(words)
    padded = np.concatenate([words, np.zeros(2 * least, np.int64)])
    h = np.zeros(n, np.uint64)
    for k in range(least):              # only a filter: equal words have equal hashes
        h = (h + padded[k:k + n].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    inside = np.flatnonzero(np.arange(n) + least <= ends)
    h = h[inside]
    by = np.argsort(h, kind="stable")
    again = h[by][1:] == h[by][:-1]
    twice = np.zeros(len(by), bool)
    twice[1:] |= again
    twice[:-1] |= again
    some = np.sort(inside[by[twice]])
    if not len(some):
        return some, np.zeros(0, bool)
    # ranks of these positions and of those that follow them, by their next ``least`` words
    mine = np.unique(np.concatenate([some, some + least]))
    grams = [padded[mine + k] for k in range(least)]
    sort = np.lexsort(grams[::-1])
    mine = mine[sort]
    differ = np.zeros(len(mine), bool)
    for g in grams:
        differ[1:] |= g[sort][1:] != g[sort][:-1]
    differ[:1] = True
    rank = np.zeros(n + 2 * least, np.int64)
    rank[mine] = np.maximum.accumulate(np.where(differ, np.arange(len(mine)), 0))
    order = some[np.argsort(rank[some], kind="stable")]
    first = rank[order]
    same = np.zeros(len(order), bool)
    same[1:] = first[1:] == first[:-1]
    keep = same.copy()
    keep[:-1] |= same[1:]               # a hash may have joined unlike words
    order, same = order[keep], same[keep]
    # doubling: open positions share ``step`` words with another one, so the rank ``step`` words on is known
    step, left = least, order
    while len(left):
        r = rank[left]
        nxt = rank[left + step]
        sort = np.lexsort([nxt, r])
        left, r, nxt = left[sort], r[sort], nxt[sort]
        group = np.ones(len(left), bool)
        group[1:] = r[1:] != r[:-1]
        part = group.copy()
        part[1:] |= nxt[1:] != nxt[:-1]
        place = np.arange(len(left))
        rank[left] = r + np.maximum.accumulate(np.where(part, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        still = ~part
        still[:-1] |= ~part[1:]
        left, step = left[still], step * 2
    return order[np.argsort(rank[order], kind="stable")], same


def edges(words: list[int], order: np.ndarray, same: np.ndarray, least: int) -> tuple[list, list, list]:
    """Neighbours in suffix order with a common prefix of ``least`` words or more: (its length, a, b), longest first."""
    a, b = order[:-1][same[1:]], order[1:][same[1:]]
    by = np.argsort(b, kind="stable")
    lengths, last, length = [], -2, 0
    for i, j in zip(b[by].tolist(), a[by].tolist()):      # the prefix shrinks by one word at most from one position to the next
        length = max(length - 1, least) if i == last + 1 else least
        while words[i + length] == words[j + length] and words[i + length]:
            length += 1
        lengths.append(length)
        last = i
    lengths = np.array(lengths, np.int64)
    down = np.argsort(-lengths, kind="stable")
    return lengths[down].tolist(), a[by][down].tolist(), b[by][down].tolist()


def seeds(lengths: list[int], a: list[int], b: list[int]):
    """(i, j, l) of positions i < j that become neighbours when their classes are united at common prefix l, j - i <= l."""
    up: dict[int, int] = {}
    held: dict[int, list | Positions] = {}

    def root(x):
        top = x
        while (p := up.get(top, top)) != top:
            top = p
        while (p := up.get(x, x)) != top:
            up[x] = top
            x = p
        return top

    for length, x, y in zip(lengths, a, b):
        x, y = root(x), root(y)
        if x == y:
            continue
        big, small = held.pop(x, None) or [x], held.pop(y, None) or [y]
        if (len(big) if isinstance(big, list) else big.size) < (len(small) if isinstance(small, list) else small.size):
            big, small, x, y = small, big, y, x
        up[y] = x
        if isinstance(big, list) and len(big) > _BLOCK:
            big = Positions(big)
        if isinstance(big, list):       # both short
            merged = sorted(big + small)
            mine = set(small)
            for i, j in zip(merged, merged[1:]):
                if j - i <= length and (i in mine) != (j in mine):
                    yield i, j, length
            held[x] = merged
            continue
        added = list(small)
        for k, p in enumerate(added):
            low, high = big.around(p)
            if low >= 0 and p - low <= length and (k == 0 or added[k - 1] < low):
                yield low, p, length
            if high >= 0 and high - p <= length and (k + 1 == len(added) or added[k + 1] > high):
                yield p, high, length
        for p in added:
            big.add(p)
        held[x] = big


def runs(texts: list[list[bytes]], least: int = 12) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of every list of words, by start, then period."""
    words, starts = [], []
    number = 0
    for text in texts:
        known: dict[bytes, int] = {}
        starts.append(len(words))
        words.extend([known.setdefault(w, len(known) + number + 1) for w in text])
        words.append(0)
        number += len(known)
    array = np.array(words, np.int64)
    starts = np.array(starts, np.int64)
    sizes = np.diff(np.append(starts, len(words)))
    order, same = suffix_order(array, np.repeat(starts + sizes - 1, sizes), max(least // 2, 1))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if len(order):
        words = words + [0]
        doc = np.repeat(np.arange(len(texts)), sizes)
        for i, j, length in seeds(*edges(words, order, same, max(least // 2, 1))):
            if j - i + length >= least:
                d = int(doc[i])
                at = int(starts[d])
                if i == at or words[i - 1] != words[j - 1]:
                    found[d].append((i - at, j - i + length, j - i))
    for f in found:
        f.sort(key=lambda r: (r[0], r[2]))
    return found


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    if not found:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)])


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """One row per row of ``docs``: ``key``, ``runs`` (array of start, length, period by start, then period) and
    ``collapsed`` (the words outside repeated periods, joined by one space).

    Words are runs of anything but ASCII white space, numbered from 0.  A run has at least ``least``
    words and two periods.  A null, empty or blank text has no word and no run; null keys and
    repeated rows stay; an empty table gives an empty one; further columns are ignored.  A very long
    text is worked on by itself, whole, in one task, in time about proportional to its length.
    """
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kind = docs.schema[key].dataType.simpleString()

    def find(batches):
        for b in batches:
            keys, at = b.column(0), 0
            for part in slices([t or "" for t in b.column(1).to_pylist()], _SLICE):
                words = [t.encode("utf-8", "surrogatepass").split() for t in part]
                found = runs(words, least)
                rows = [[dict(zip(("start", "length", "period"), r)) for r in f] for f in found]
                text = [collapsed(w, f).decode("utf-8", "surrogatepass") for w, f in zip(words, found)]
                yield pa.RecordBatch.from_arrays([keys.slice(at, len(part)), pa.array(rows, pa.list_(run)), pa.array(text, pa.string())],
                                                 names=["_key", "runs", "collapsed"])
                at += len(part)
        give_back()

    narrow = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    out = narrow.mapInArrow(find, f"_key {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
    return out.select(F.col("_key").alias(key), "runs", "collapsed")


def summary(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digest columns of :func:`find_runs`: count, the longest run (ties: smallest start, then period) and two SHA-256."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    got = found.select(key, F.size("runs").cast("long").alias("n_runs"), best.alias("_best"),
                       F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    length, period = -F.col("_best.l"), F.col("_best.p")
    return got.select(key, "n_runs", F.col("_best.s").alias("start"), length.alias("length"), period.alias("period"),
                      F.floor(1000 * length / period).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_repeats(key: Column, text: Column) -> Column:
    """The planted edit of the registered query: with h the CRC-32 of the decimal key, texts with h % 10 = 0 repeat a
    stretch of their words up to their end; any other text, and a null key's, stays as it is."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def edited(words):
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, at(i).cast("int"))), " ")

    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    rewritten = F.when(F.size(words) > 0, F.element_at(F.transform(F.array(words), edited), 1)).otherwise(text)
    return F.when(h % 10 == 0, rewritten).otherwise(text)
