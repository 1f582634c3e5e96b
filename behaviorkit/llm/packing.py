"""Best-fit packing of tokenised documents into sequences of at most ``capacity`` tokens.

Linear grouping: lengths above ``capacity / small_part`` are sorted and cut into groups of equal
cardinality, each rounded up to its longest member.  The few sizes left are packed by the
configuration linear program (column generation with a knapsack), rounded down; the actual
documents take the places of their group, and what is left over goes, longest first, to the fullest
sequence that still holds it, the short documents last.  The scheme is tried with each border in
``small_parts`` and the plan with the fewest sequences is used.

Lengths are whole numbers up to ``capacity``, so all of this is arithmetic on the histogram of
lengths: the driver sees at most ``capacity`` counts, and returns a plan of runs ("the documents of
length 300 ranked 1200 to 1899 lie at offset 512 of sequences 70 to 769") whose number does not
depend on the number of documents.  Documents get their rank within their length by a distributed
running count and look up their run.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behaviorkit.llm.common import give_back, running_total, written
from behaviorkit.llm.tokens import encoder
from behaviorkit.operators.ranking import ordered_index

PIECE = "piece int, start long, length long, ids_crc32 long"


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be shorter than capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)] if n else []


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text",
           words: str = "leading_space", with_ids: bool = False, place: Column | None = None) -> DataFrame:
    """``(key, piece, start, length, ids_crc32[, ids][, place])`` of every document's ids and its end id."""
    schema = f"`{key}` string, {PIECE}" + ", ids binary" * with_ids + ", place long" * (place is not None)
    columns = [key, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids + ["place"] * (place is not None)
    end = np.asarray([end_id], "<u4").tobytes()

    def encode(batches):
        ids_of = encoder(tokenizer, words).encode
        for b in batches:
            rows = []
            for k, t, *at in zip(*(b[c] for c in b.columns)):
                ids = memoryview(ids_of(t) + end)
                for i, (s, n) in enumerate(cut_points(len(ids) // 4, capacity)):
                    part = ids[4 * s:4 * (s + n)]
                    rows.append((k, i, s, n, zlib.crc32(part)) + ((bytes(part),) if with_ids else ()) + tuple(at))
            out = pd.DataFrame(rows, columns=columns)
            yield out
            b = rows = out = None
        give_back()

    # keys travel as text: a null key would turn 64-bit numbers into floats
    src = docs.select(F.col(key).cast("string").alias("_key"), F.col(text).alias("_text"), *([] if place is None else [place.alias("_place")]))
    return src.mapInPandas(encode, schema).withColumn(key, F.col(key).cast(docs.schema[key].dataType))


# -- the plan, on the histogram of lengths ---------------------------------------------------------

class Run:
    """``count`` sequences filled alike: ``held`` lists (length, documents of it per sequence, first rank)."""

    __slots__ = ("count", "slack", "held")

    def __init__(self, count: int, slack: int, held: list):
        self.count, self.slack, self.held = count, slack, held

    def split(self, n: int) -> "Run":
        """Keep the first ``n`` sequences, return the others."""
        rest = Run(self.count - n, self.slack, [(z, q, r + n * q) for z, q, r in self.held])
        self.count = n
        return rest


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Fractional optimum of the configuration program: [(how many of each size, how often)].

    Simplex over the current configurations; the next one is the knapsack of the dual prices.
    Stopping early leaves a feasible solution.
    """
    m = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        x = np.linalg.solve(basis, demand)
        price = np.linalg.solve(basis.T, np.ones(m))
        best, took = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            fit = sizes <= c
            value = np.where(fit, price + best[np.where(fit, c - sizes, 0)], -1)
            g = int(value.argmax())
            best[c], took[c] = (value[g], g) if value[g] > best[c - 1] else (best[c - 1], -1)
        if best[capacity] <= 1 + 1e-7:
            break
        new, c = np.zeros(m), capacity
        while c > 0:
            if took[c] >= 0:
                new[took[c]] += 1
                c -= int(sizes[took[c]])
            else:
                c -= 1
        way = np.linalg.solve(basis, new)
        ratio = np.where(way > 1e-9, x / np.where(way > 1e-9, way, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = new
    x = np.linalg.solve(basis, demand)
    return [(basis[:, j].astype(int), float(x[j])) for j in range(m)]


def _substitute(hist: dict[int, int], capacity: int, small: int, groups: int) -> tuple[list[Run], list[tuple[int, int, int]]]:
    """Runs of sequences of large documents, and (length, first rank, count) of large ones left over."""
    lengths = [z for z in sorted(hist, reverse=True) if small < z < capacity]
    counts = np.array([hist[z] for z in lengths])
    if not len(lengths):
        return [], []
    edges = np.concatenate(([0], np.cumsum(counts)))          # places of each length, longest first
    total = int(edges[-1])
    cuts = sorted({total * g // groups for g in range(groups + 1)})
    starts, demand = np.array(cuts[:-1]), np.diff(cuts)
    sizes = np.array([lengths[bisect.bisect_right(edges, s) - 1] for s in starts])   # rounded up to the longest
    # equal sizes of neighbouring groups are one size
    same = np.concatenate(([True], sizes[1:] != sizes[:-1]))
    starts, sizes, demand = starts[same], sizes[same], np.add.reduceat(demand, np.flatnonzero(same))
    nexts, ends = starts.copy(), starts + demand

    def take(g: int, n: int) -> list[tuple[int, int, int]]:
        """(length, first rank, count) of the next n places of group g; fewer when it ends."""
        out, at, stop = [], int(nexts[g]), int(min(nexts[g] + n, ends[g]))
        nexts[g] = stop
        while at < stop:
            i = bisect.bisect_right(edges, at) - 1
            upto = min(stop, int(edges[i + 1]))
            out.append((lengths[i], at - int(edges[i]), upto - at))
            at = upto
        return out

    runs: list[Run] = []
    for config, often in configurations(sizes, demand.astype(float), capacity):
        n = int(often + 1e-6)
        if n <= 0:
            continue
        columns = [take(g, n) for g in range(len(sizes)) for _ in range(config[g])]
        done = 0
        while done < n and any(columns):
            step = min(col[0][2] for col in columns if col)
            runs.append(Run(step, capacity - sum(col[0][0] for col in columns if col), [(col[0][0], 1, col[0][1]) for col in columns if col]))
            for col in columns:
                if col:
                    z, r, c = col.pop(0)
                    if c > step:
                        col.insert(0, (z, r + step, c - step))
            done += step
    left = [x for g in range(len(sizes)) for x in take(g, int(ends[g] - nexts[g]))]
    return runs, left


SMALL_PARTS = (2, 3, 4)


def plan(hist: dict[int, int], capacity: int = 1024, small_parts: Sequence[int] = SMALL_PARTS,
         groups: int = 48) -> list[tuple[int, ...]]:
    """(length, first rank, ranks, per sequence, first sequence, offset) for all lengths of a histogram."""
    plans = [_plan(hist, capacity, max(capacity // p, 1), groups) for p in small_parts]
    return min(plans, key=lambda rows: max((s + n // q for _, _, n, q, s, _ in rows), default=0))


def _plan(hist: dict[int, int], capacity: int, small: int, groups: int) -> list[tuple[int, ...]]:
    runs, left = _substitute(hist, capacity, small, groups)
    full = [Run(hist[capacity], 0, [(capacity, 1, 0)])] if hist.get(capacity) else []
    left += [(z, 0, n) for z, n in hist.items() if 0 < z <= small and z < capacity and n]
    by_slack: dict[int, list[Run]] = {}
    for r in runs:
        by_slack.setdefault(r.slack, []).append(r)
    slacks = sorted(by_slack)

    def put(run: Run) -> None:
        if run.slack not in by_slack:
            by_slack[run.slack] = []
            bisect.insort(slacks, run.slack)
        by_slack[run.slack].append(run)

    for z, rank, n in sorted(left, reverse=True):
        while n:
            i = bisect.bisect_left(slacks, z)
            if i < len(slacks):                      # best fit: the fullest sequences that still hold it
                here = by_slack[slacks[i]]
                run = here.pop()
                if not here:
                    del by_slack[slacks.pop(i)]
                q = min(run.slack // z, n) if run.count == 1 else run.slack // z
                bins = min(run.count, max(n // q, 1))
                q = min(q, n)
                if bins < run.count:
                    put(run.split(bins))
            else:                                    # new sequences, filled with this length
                q = min(capacity // z, n)
                bins = n // q
                run = Run(bins, capacity, [])
            run.held.append((z, q, rank))
            run.slack -= z * q
            rank, n = rank + bins * q, n - bins * q
            put(run)
    out, first = [], 0
    for run in full + [r for rs in by_slack.values() for r in rs]:
        offset = 0
        for z, q, rank in run.held:
            out.append((z, rank, run.count * q, q, first, offset))
            offset += z * q
        first += run.count
    return out


PLAN = "length long, rank0 long, ranks long, per long, seq0 long, offset0 long"


def assign(parts: DataFrame, order: Sequence[str], capacity: int = 1024, small_parts: Sequence[int] = SMALL_PARTS, groups: int = 48) -> DataFrame:
    """``parts`` (narrow: keys and ``length``) plus ``sequence_id`` and ``offset``."""
    hist = {int(r["length"]): int(r["count"]) for r in parts.groupBy("length").count().collect()}   # at most capacity rows
    rows = plan(hist, capacity, small_parts, groups)
    runs = parts.sparkSession.createDataFrame(rows, PLAN)
    ranked = running_total(parts.withColumn("_one", F.lit(1)), order, "_one", by=["length"], total="_rank").drop("_one")
    # the plan is as long as the histogram and the configurations, not as the documents: always broadcast
    at = F.col("_rank") - F.col("rank0")
    return (ranked.join(F.broadcast(runs), "length").where((at >= 0) & (at < F.col("ranks")))
            .withColumn("sequence_id", F.col("seq0") + F.floor(at / F.col("per")).cast("long"))
            .withColumn("offset", F.col("offset0") + (at % F.col("per")) * F.col("length"))
            .select(*parts.columns, "sequence_id", "offset"))


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text",
         words: str = "leading_space", small_parts: Sequence[int] = SMALL_PARTS, groups: int = 48, place: Column | None = None) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    With ``place``, a number per document, documents of equal length take their places in its order, and sequences are
    numbered from 0 by the least place of their documents: read by number, they follow that order.

    A null or empty text is its end id alone.  Null keys and repeated rows are packed like any other
    row; an empty table gives an empty result; other columns of ``docs`` are ignored.
    """
    narrow = written(pieces(docs, tokenizer, capacity, end_id, key, text, words, place=place), "pieces")
    if place is None:
        return assign(narrow, [key, "piece", "ids_crc32"], capacity, small_parts, groups)
    packed = written(assign(narrow, ["place", key, "piece", "ids_crc32"], capacity, small_parts, groups), "packed")
    first = packed.groupBy("sequence_id").agg(F.min("place").alias("first"))
    numbers = ordered_index(first, ["first", "sequence_id"], name="number").select("sequence_id", (F.col("number") - 1).alias("number"))
    return packed.join(numbers, "sequence_id").select(*[F.col("number").alias(c) if c == "sequence_id" else c for c in packed.columns if c != "place"])


def sequences(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text",
              words: str = "leading_space") -> DataFrame:
    """The packed sequences themselves: ``sequence_id, ids`` (at most ``capacity`` ids, little-endian 32-bit)."""
    whole = written(pieces(docs, tokenizer, capacity, end_id, key, text, words, with_ids=True), "pieces")
    placed = assign(whole.drop("ids"), [key, "piece", "ids_crc32"], capacity)
    both = placed.join(whole.select(key, "piece", "ids"), [key, "piece"])
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return both.groupBy("sequence_id").agg(F.aggregate(inside, F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
