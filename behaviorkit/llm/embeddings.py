"""Embedding near-dedup by an epsilon grid order join.

Vectors with equal label are linked when their cosine is at least ``cosine``, that is, when their
unit vectors are at most eps = sqrt(2 - 2 cosine) apart.

1. Equal (label, vector) rows become one vector with a count.
2. The leading principal directions of all unit vectors come from sums that Spark adds up.
3. Every vector gets a grid cell of side eps on those directions; label and cells order all vectors
   (range partitions, sorted), and the ordered sequence is cut into blocks with their bounding boxes.
4. Blocks are compared through their boxes: only pairs whose boxes are within eps are joined, found
   by an equi-join on (label, cell of the first direction).
5. A task joins one pair of blocks recursively: intervals of the sequence are halved, parts whose
   boxes are further apart than eps are skipped, the rest is compared exactly in double precision.
   It returns link counts per vector and a spanning forest, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from behaviorkit.llm.common import connected_components, cut, written

LEADING = 8                     # principal directions of the grid
LEAF = 128                      # vectors of an interval that are compared at once
_SLACK = 1e-6                   # boxes are compared with room for rounding; links are not


def distinct_vectors(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``rep, label, vec, copies``: each usable (label, vector) once, under its smallest key."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (rows.select(F.col(key).alias("key"), F.col(label).cast("string").alias("label"), v.alias("vec")).dropna(subset=["key", "label", "vec"])
            .where(finite & F.exists("vec", lambda x: x != 0))
            .groupBy("label", "vec").agg(F.min("key").alias("rep"), F.count(F.lit(1)).alias("copies")))


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled first, so that very large or small components neither overflow nor vanish."""
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def principal_directions(vectors: DataFrame, leading: int = LEADING) -> dict[int, np.ndarray]:
    """For each vector length: the leading principal directions of all unit vectors, as columns."""

    def add(batches):
        for b in batches:
            for d, some in b.groupby(b["vec"].map(len)):
                u = unit(np.stack(some["vec"].to_numpy()))
                yield pd.DataFrame({"d": [d] * (d + 1), "row": range(d + 1), "sums": [*(u.T @ u), u.sum(axis=0)], "n": len(u)})

    parts = vectors.select("vec").mapInPandas(add, "d int, row int, sums array<double>, n long")
    one = parts.select("d", "row", "n", F.posexplode("sums").alias("col", "x"))
    # as many numbers as the square of the vector length
    found = one.groupBy("d", "row", "col").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toPandas()
    out = {}
    for d, g in found.groupby("d"):
        m = np.zeros((d + 1, d))
        m[g["row"], g["col"]] = g["x"]
        n, mean = g["n"].iloc[0], m[d] / g["n"].iloc[0]
        _, axes = np.linalg.eigh(m[:d] / n - np.outer(mean, mean))
        out[int(d)] = axes[:, ::-1][:, :leading]
    return out


def blocks(vectors: DataFrame, axes: dict[int, np.ndarray], eps: float, size: int = 1024) -> DataFrame:
    """``block, label, dim, rows, ids, copies, data, low, high``: consecutive intervals of the epsilon grid order."""

    def place(batches):
        for b in batches:
            at = [unit(v[None, :])[0] @ axes[len(v)] for v in b["vec"]]
            yield b.assign(cells=[np.floor(p / eps).astype("int32") for p in at])

    ordered = vectors.mapInPandas(place, "label string, vec array<double>, rep long, copies long, cells array<int>")
    keys = ["label", F.size("vec"), "cells", "rep"]
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pack(batches):
        from pyspark import TaskContext

        part, held, number = TaskContext.get().partitionId(), [], 0

        def block(rows: pd.DataFrame):
            u = unit(np.stack(rows["vec"].to_numpy()))
            p = u @ axes[u.shape[1]]
            return (part << 32 | number, rows["label"].iloc[0], u.shape[1], len(rows), rows["rep"].to_numpy("<i8").tobytes(),
                    rows["copies"].to_numpy("<i8").tobytes(), np.ascontiguousarray(u).tobytes(), p.min(axis=0), p.max(axis=0))

        names = ["block", "label", "dim", "rows", "ids", "copies", "data", "low", "high"]
        for b in batches:
            for _, same in b.groupby([b["label"], b["vec"].map(len)], sort=False):
                if held and (held[0]["label"].iloc[0] != same["label"].iloc[0] or len(held[0]["vec"].iloc[0]) != len(same["vec"].iloc[0])):
                    yield pd.DataFrame([block(pd.concat(held))], columns=names)
                    held, number = [], number + 1
                held.append(same)
                rows = pd.concat(held) if len(held) > 1 else same
                while len(rows) >= size:
                    yield pd.DataFrame([block(rows.iloc[:size])], columns=names)
                    rows, number = rows.iloc[size:], number + 1
                held = [rows] if len(rows) else []
        if held:
            yield pd.DataFrame([block(pd.concat(held))], columns=names)

    ranged = ordered.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("cells")
    return written(ranged.mapInPandas(pack, "block long, label string, dim int, rows long, ids binary, copies binary, data binary, "
                                            "low array<double>, high array<double>"), "blocks")


def block_pairs(found: DataFrame, eps: float) -> DataFrame:
    """``a, b`` (a <= b) of blocks with equal label whose boxes are within eps of each other."""
    box = found.select("block", "label", "dim", "low", "high")
    cell = lambda c: F.floor(F.get(c, F.lit(0)) / eps).cast("long")
    # a block lies in the cells of its first side; it looks for the others one cell further on each side
    left = box.select(F.col("block").alias("a"), "label", "dim", F.col("low").alias("la"), F.col("high").alias("ha"),
                      F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))).alias("cell"))
    right = box.select(F.col("block").alias("b"), "label", "dim", F.col("low").alias("lb"), F.col("high").alias("hb"),
                       F.explode(F.sequence(cell(F.col("low")) - 1, cell(F.col("high")) + 1)).alias("cell"))
    gap = F.transform(F.arrays_zip("la", "ha", "lb", "hb"), lambda x: F.greatest(x["la"] - x["hb"], x["lb"] - x["ha"], F.lit(0.0)))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, g: s + g * g)
    return (left.join(right, ["label", "dim", "cell"]).where((F.col("a") <= F.col("b")) & (apart <= eps * eps + _SLACK))
            .select("a", "b").distinct())


class _Forest:
    """Union-find over the places of both blocks of a task."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((x, y))


def join_blocks(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, axes: np.ndarray, cosine: float, same: bool):
    """(links of each x, links of each y, spanning edges) between two blocks of unit vectors.

    ``nx``, ``ny`` are copies; edges are places, those of y behind those of x.  With ``same`` both are
    one block and only counts of x are used.
    """
    eps2 = 2 - 2 * cosine + _SLACK
    px, py = x @ axes, y @ axes
    cx, cy = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    forest = _Forest(len(x) + (0 if same else len(y)))
    shift = 0 if same else len(x)
    todo = [(0, len(x), 0, len(y))]
    while todo:
        a, b, c, d = todo.pop()
        if same and c < a:
            continue
        gap = np.maximum(np.maximum(px[a:b].min(axis=0) - py[c:d].max(axis=0), py[c:d].min(axis=0) - px[a:b].max(axis=0)), 0)
        if gap @ gap > eps2:
            continue
        if b - a > LEAF or d - c > LEAF:
            m, n = (a + b) // 2, (c + d) // 2
            todo += [(s, t, u, v) for s, t in ((a, m), (m, b)) for u, v in ((c, n), (n, d)) if s < t and u < v]
            continue
        near = x[a:b] @ y[c:d].T >= cosine
        if same and a == c:
            np.fill_diagonal(near, False)
        cx[a:b] += near @ ny[c:d]
        if not same:
            cy[c:d] += near.T @ nx[a:b]
        elif a != c:
            cx[c:d] += near.T @ nx[a:b]
        # links of a leaf as a forest: rows whose links are one connected part add one edge each
        for i, row in enumerate(near):
            js = np.flatnonzero(row)
            if len(js):
                roots, seen = forest.find(a + i), None
                for j in js.tolist():
                    r = forest.find(shift + c + j)
                    if r != seen and r != roots:
                        forest.join(a + i, shift + c + j)
                        roots = forest.find(a + i)
                    seen = roots
    return cx, cy, forest.edges


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                    cosine: float = 0.93, block: int = 1024) -> DataFrame:
    """One row ``key, n_links, component_id, kept`` per row of ``rows``.

    ``n_links`` counts other rows linked directly, copies included; ``component_id`` is the smallest
    key reachable by links; ``kept`` marks the rows that are their component's smallest.  Rows with a
    null label, a null, empty or zero vector, null or non-finite components or a null key link with
    nothing, nor do vectors of different length.  Repeated rows are copies of one another; a row with
    a null key has a null component and is not kept; an empty table gives an empty result.
    """
    vectors = cut(distinct_vectors(rows, key, vector, label))
    axes = principal_directions(vectors)
    eps = float(np.sqrt(2 - 2 * cosine))
    found = blocks(vectors, axes, eps, block)
    pairs = block_pairs(found, eps)
    # both blocks of a pair meet under the pair's key, one group of at most two rows at a time
    sides = pairs.select("a", "b", F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("block"))

    def meet(pair: pd.DataFrame) -> pd.DataFrame:
        pair = pair.sort_values("block")
        d = int(pair["dim"].iloc[0])
        data = [np.frombuffer(x).reshape(-1, d) for x in pair["data"]]
        ids = [np.frombuffer(x, "<i8") for x in pair["ids"]]
        n = [np.frombuffer(x, "<i8") for x in pair["copies"]]
        same = len(data) == 1
        cx, cy, edges = join_blocks(data[0], data[-1], n[0], n[-1], axes[d], cosine, same)
        every = ids[0] if same else np.concatenate(ids)
        links = cx if same else np.concatenate((cx, cy))
        some = np.flatnonzero(links)
        e = np.array(edges, np.int64).reshape(-1, 2)
        return pd.concat((pd.DataFrame({"a": every[some], "b": every[some], "links": links[some]}),
                          pd.DataFrame({"a": every[e[:, 0]], "b": every[e[:, 1]], "links": 0})))

    met = sides.join(found, "block").groupBy("a", "b").applyInPandas(meet, "a long, b long, links long")
    met = written(met, "links")
    counts = met.groupBy("a").agg(F.sum("links").alias("links")).withColumnRenamed("a", "of")
    groups = connected_components(met.where("a <> b"))
    known = (vectors.join(counts, F.col("rep") == F.col("of"), "left").join(groups, F.col("rep") == F.col("node"), "left")
             .select("label", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    # rows find their vector by a hash spread over salts, so that copies of one vector do not meet in one task
    salts = 16
    named = known.withColumns({"h": F.xxhash64("label", "vec"), "salt": F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))})
    src = rows.select(F.col(key).alias("key"), F.col(label).cast("string").alias("l"), F.col(vector).cast("array<double>").alias("v"))
    src = src.withColumns({"h": F.xxhash64("l", "v"), "salt": F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int")})
    out = src.join(named, (src["h"] == named["h"]) & (src["salt"] == named["salt"]) & (F.col("l") == F.col("label")) & (F.col("v") == F.col("vec"))
                   & F.col("key").isNotNull(), "left")
    component = F.coalesce("component_id", "key")
    return out.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.cast("long").alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"))
