"""Mixing sources to target weights: Pfair scheduling of blocks, earliest deadline first.

Every source cuts its documents, in key order, into blocks.  With weight w, block j of a source may not
start before slot floor(j / w) and must be done by slot ceil((j + 1) / w); slots are filled earliest
deadline first among the released blocks.  With weights that add up to 1 every window is met, so after any
number of slots each source is less than one block away from its share.

A *phase* lasts until a source has placed its last block; the next one starts anew with the weights of the
sources that are left, so every document is placed.  There are at most as many phases as sources.

Weights are rounded to whole parts of a period (largest remainder), so the schedule of a phase repeats.  The
period is ``period`` slots or, where a weight needs it, as many as give the smallest weight two of them.  Only one
period of each phase is worked out on the driver, whatever the number of documents; a block finds its slot by
arithmetic on its number within its source.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behaviorkit.llm.common import running_total, written

#: Sources that the driver holds, some numbers each per phase; more is refused.
MAX_SOURCES = 10_000
#: Longest period; a weight below half of 1 / MAX_PERIOD counts as one slot of it.
MAX_PERIOD = 1_000_000


def _sorted(sources) -> list:
    return sorted(sources, key=lambda s: (s is None, s))


def quotas(weights: Mapping, period: int) -> dict:
    """Slots of each source in a period, adding up to it; at least one each, by largest remainder (ties: source order)."""
    order = _sorted(weights)
    if not order:
        return {}
    total = sum(weights.values())
    exact = {s: weights[s] / total * period for s in order}
    out = {s: max(int(exact[s]), 1) for s in order}
    rest = sorted(order, key=lambda s: out[s] - exact[s])
    for s in rest[:max(period - sum(out.values()), 0)]:
        out[s] += 1
    over = sum(out.values()) - period
    for s in sorted(order, key=lambda s: -out[s]):          # slots given to weights below one
        if over > 0:
            less = min(out[s] - 1, over)
            out[s], over = out[s] - less, over - less
    return out


def period_of(weights: Mapping, period: int) -> int:
    """``period``, raised until the smallest weight has two slots and there are ten a source, up to ``MAX_PERIOD``."""
    least = min(weights.values()) / sum(weights.values())
    return max(len(weights), min(max(period, 10 * len(weights), int(2 / least) + 1), MAX_PERIOD))


def turns(parts: Mapping, period: int) -> Iterator[tuple]:
    """(source, its block's number) slot by slot over one period: earliest deadline among the released blocks."""
    order = _sorted(parts)
    waiting = [(0, i, 0) for i in range(len(order))]        # (release, source, block)
    ready: list[tuple[int, int, int]] = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, i, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // parts[order[i]]), i, j))
        deadline, i, j = heapq.heappop(ready)               # the parts fill the period, so there is one, and in time
        if deadline <= slot:
            raise ValueError("a block missed its deadline")
        yield order[i], j
        if j + 1 < parts[order[i]]:
            heapq.heappush(waiting, ((j + 1) * period // parts[order[i]], i, j + 1))


def phases(blocks: Mapping, weights: Mapping, period: int) -> list[dict]:
    """The schedule: per phase its first slot, its length, its period, and per source its first block, its slots of a
    period (``parts`` of them) counted from the phase's start.  ``blocks``: number of blocks of each source."""
    left, first, out, start = dict(blocks), dict.fromkeys(blocks, 0), [], 0
    while left:
        goal = {s: weights[s] for s in left}
        n = period_of(goal, period)
        parts = quotas(goal, n)
        at: dict = {s: [] for s in left}
        length = None
        for slot, (s, _) in enumerate(turns(parts, n)):
            at[s].append(slot)
            if len(at[s]) == left[s]:
                length = slot + 1
                break
        if length is None:
            length = 1 + min((r - 1) // parts[s] * n + at[s][(r - 1) % parts[s]] for s, r in left.items())
        at = {s: np.array(t, np.int64) for s, t in at.items()}
        out.append({"start": start, "length": length, "period": n, "first": {s: first[s] for s in left}, "at": at, "parts": parts})
        for s in list(left):
            used = length // n * parts[s] + int(np.searchsorted(at[s], length % n))
            first[s] += used
            left[s] -= used
            if not left[s]:
                del left[s]
        start += length
    return out


def slot_of(source: Column, block: Column, plan: list[dict]) -> Column:
    """Slot of a block by the plan of :func:`phases`; null for a source that is not in it."""
    by: dict = {}
    for phase in plan:
        for s, first in phase["first"].items():
            by.setdefault(s, []).append((first, phase["start"], phase["period"], phase["parts"][s], phase["at"][s]))

    @F.pandas_udf("long")
    def place(source: pd.Series, block: pd.Series) -> pd.Series:
        out = pd.Series(pd.NA, index=source.index, dtype="Int64")
        for s, b in block.groupby(source.where(source.notna(), None), dropna=False):
            mine = by.get(None if pd.isna(s) else s)
            if mine is None:
                continue
            number = b.to_numpy(np.int64)
            which = np.searchsorted([m[0] for m in mine], number, side="right") - 1
            slot = np.empty(len(number), np.int64)
            for k in np.unique(which).tolist():
                first, start, period, parts, at = mine[k]
                turn, j = np.divmod(number[which == k] - first, parts)
                slot[which == k] = start + turn * period + at[j]
            out[b.index] = slot
        return out

    return place(source, block)


def tempered(sizes: Mapping, alpha: float = 0.7) -> dict:
    """Default target weights: size to the power ``alpha``, which lifts small sources."""
    return {s: max(n, 1) ** alpha for s, n in sizes.items()}


def _blocks(docs: DataFrame, weights: Mapping | None, key: str, source: str, text: str, alpha: float) -> tuple[DataFrame, dict, dict]:
    """(key, source, size and characters before it in its source, of every row; characters of each source; target weights)."""
    narrow = written(docs.select(F.col(key).alias("key"), F.col(source).alias("source"),
                                 F.coalesce(F.length(text), F.lit(0)).cast("long").alias("size")), "sizes")
    # one row per source
    sizes = {r["source"]: r["n"] for r in narrow.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(sizes) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goal = {s: w for s, w in (tempered(sizes, alpha) if weights is None else weights).items() if s in sizes and w > 0}
    placed = running_total(narrow, ["key", "size"], "size", by=["source"], total="before")
    return placed, sizes, goal


def order(docs: DataFrame, weights: Mapping | None = None, key: str = "doc_id", source: str = "source", text: str = "text",
          block: int = 20_000, period: int = 1000, alpha: float = 0.7) -> DataFrame:
    """``key, source, size, block, slot, in_mix`` of every row of ``docs``; ``slot`` is the place of its block.

    A block is ``block`` characters of one source; a document lies in the block in which it starts, so a very long one
    takes up the slots of several blocks.  Every row of a source with a weight is in the mixture.  ``weights`` maps source to weight (missing
    sources: not in the mixture, slot null); by default ``tempered`` character counts.  A null source
    is a source of its own; null and empty texts have size 0; null keys come first in their source;
    repeated rows stay; an empty table gives no row.
    """
    placed, sizes, goal = _blocks(docs, weights, key, source, text, alpha)
    plan = phases({s: max(-(-sizes[s] // block), 1) for s in goal}, goal, period)
    # a row of size 0 at the end of its source starts where the last block ends: it lies in that block
    starts = F.greatest(F.when((F.col("size") == 0) & (F.col("before") > 0), F.col("before") - 1).otherwise(F.col("before")), F.lit(0))
    placed = placed.withColumn("block", F.floor(starts / block).cast("long"))
    out = placed.withColumn("slot", slot_of(F.col("source"), F.col("block"), plan))
    return out.select(F.col("key").alias(key), F.col("source").alias(source), "size", "block", "slot", F.col("slot").isNotNull().alias("in_mix"))


def mixture(docs: DataFrame, weights: Mapping | None = None, key: str = "doc_id", source: str = "source", text: str = "text",
            block: int = 20_000, period: int = 1000, alpha: float = 0.7) -> DataFrame:
    """The rows of ``docs`` in the order of the mixture; without ``weights`` all of them.

    Rows of equal key, source and text length stand together, at the first of their places; an empty table gives no row.
    """
    plan = (order(docs, weights, key, source, text, block, period, alpha).where("in_mix")
            .groupBy(F.col(key).alias("_mix_k"), F.col(source).alias("_mix_s"), F.col("size").alias("_mix_n"))
            .agg(F.min("slot").alias("_mix_slot")))
    same = (docs[key].eqNullSafe(plan["_mix_k"]) & docs[source].eqNullSafe(plan["_mix_s"])
            & (F.coalesce(F.length(docs[text]), F.lit(0)).cast("long") == plan["_mix_n"]))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = [plan["_mix_slot"], plan["_mix_k"]]
    return docs.join(plan, same).repartitionByRange(parts, *turn).sortWithinPartitions(*turn).select(*[docs[c] for c in docs.columns])
