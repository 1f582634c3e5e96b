"""Ranked lexical search: the best documents of every item, by dual-tree search over coordinate maxima.

Items and documents are vectors over the items' terms; a score is their inner product, in integers.  Items
are arranged in a tree, like ones together, and so is every block of documents.  A node holds,
per term, the largest coordinate below it, so the inner product of two nodes bounds every score of a
document under the one and an item under the other.  The search descends pairs of nodes, highest bound
first, and leaves out a pair whose bound is below the weakest kth score of the node's items: whole
batches at once, and without losing a result, as a bound is never below a score.

One pass over the texts turns each document into its length and its counts of the items' terms, which
is all that is kept (no text is shuffled); document frequencies and totals come from these rows.  The search
runs over blocks of them where they lie.  It starts from kth scores of a small sample of documents: scores that
some 20 documents reach are a sound floor for all, so most blocks return a few rows only.  The sample
steers what can be left out, never the result.

Items are the stated query set.  They are taken in groups of bounded size (``group_chars``), each with its
own pass, so that what every task receives is bounded whatever their number.
"""

from __future__ import annotations

import math
from bisect import insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from behaviorkit.llm.common import give_back, slices, written

#: ASCII bytes that are neither a letter nor a digit become spaces, A-Z become a-z; other bytes stay.
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
_PIECE = 4_000_000      # bytes of a text that are cut into terms at once
_BLOCK = 4096           # documents in a tree
_DOC_LEAF, _ITEM_LEAF, _FAN = 16, 4, 8


def terms(text: str | None):
    """Lists of the terms of a whole text, in order: runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)
    at = 0
    while at < len(raw):
        end = at + _PIECE
        if end < len(raw):
            end = raw.rfind(b" ", at, end) + 1 or raw.find(b" ", end) + 1 or len(raw)
        yield raw[at:end].split()
        at = end


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int], key: str, text: str) -> DataFrame:
    """``key, n, terms, counts`` of every row with a term: its number of terms, and how often it holds those of ``vocabulary`` (from 1)."""
    kind = docs.schema[key].dataType.simpleString()

    def count(batches):
        get = vocabulary.get
        for b in batches:
            keys, at = b.column(0), 0
            for part in slices([t or "" for t in b.column(1).to_pylist()], 1_000_000):
                n, ends, found, often = [], [0], [], []
                for t in part:
                    size, ids = 0, []
                    for words in terms(t):
                        size += len(words)
                        ids.extend(filter(None, map(get, words)))
                    which, count = np.unique(np.array(ids, np.int32), return_counts=True)
                    n.append(size)
                    found.append(which)
                    often.append(count.astype(np.int32))
                    ends.append(ends[-1] + len(which))
                offsets = pa.array(ends, pa.int32())
                out = pa.RecordBatch.from_arrays(
                    [keys.slice(at, len(part)), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(found), pa.int32())),
                     pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(often), pa.int32()))], names=["key", "n", "terms", "counts"])
                yield out.filter(pa.array(np.array(n) > 0))
                at += len(part)
        give_back()

    narrow = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return narrow.mapInArrow(count, f"key {kind}, n bigint, terms array<int>, counts array<int>")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def arrange(n: int, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, size: int, leaf: int, turns: int = 4) -> np.ndarray:
    """An order of ``n`` sparse vectors in which neighbours are alike: sorted by their place along the direction in which
    they vary most (a few power iterations), halves again and again, down to ``leaf`` vectors."""
    order = np.arange(n)
    span = leaf
    while span < n:
        span *= 2
    values = values / max(values.max(initial=0.0), 1.0)
    while span > leaf and -(-n // span) * size <= 1 << 23:
        nodes = -(-n // span)
        node = np.empty(n, np.int64)
        node[order] = np.arange(n) // span
        held = np.bincount(node, minlength=nodes)
        at = node[rows] * size + columns
        along = np.random.default_rng(nodes).random(nodes * size)
        for _ in range(turns):
            place = np.bincount(rows, values * along[at], n)
            place -= (np.bincount(node, place, nodes) / held)[node]
            along = np.bincount(at, values * place[rows], nodes * size)
            along /= max(np.abs(along).max(initial=0.0), 1e-300)
        order = np.lexsort((np.bincount(rows, values * along[at], n), node))
        span //= 2
    return order


def _levels(leaves: np.ndarray) -> list[np.ndarray]:
    """Coordinate maxima from the leaves up: each node above covers ``_FAN`` neighbours, the last level is one root."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append(np.maximum.reduceat(out[-1], np.arange(0, len(out[-1]), _FAN)))
    return out


class Items:
    """The tree over a group of items: their vectors (weight times repeats per term), like ones together."""

    def __init__(self, vectors: list[dict[int, int]], size: int):
        some = [i for i, v in enumerate(vectors) if v]
        entries = np.array([(r, t, c) for r, i in enumerate(some) for t, c in vectors[i].items()], np.int64).reshape(-1, 3)
        self.order = [some[r] for r in arrange(len(some), entries[:, 0], entries[:, 1], entries[:, 2].astype(np.float64), size, _ITEM_LEAF)]
        # inner products are exact in doubles below 2^53; a coordinate of a document is below 10^6
        most = max((sum(v.values()) for v in vectors), default=0)
        self.exact = np.float64 if most * 10**6 < 2**53 else np.int64
        self.size = size
        self.leaves = []        # (items, their terms, matrix terms x items)
        maxima = []
        for s in range(0, len(self.order), _ITEM_LEAF):
            held = self.order[s:s + _ITEM_LEAF]
            columns = np.array(sorted({t for i in held for t in vectors[i]}))
            matrix = np.array([[vectors[i].get(t, 0) for i in held] for t in columns.tolist()], self.exact)
            top = np.zeros(size, self.exact)
            top[columns] = matrix.max(axis=1)
            maxima.append(top)
            self.leaves.append((held, columns, matrix))
        self.levels = _levels(np.array(maxima)) if maxima else []


class Search:
    """Best ``k`` documents of every item over the blocks given to :meth:`add`; ``floor`` holds scores that k documents are known to reach."""

    def __init__(self, items: Items, floor: list[int], k: int):
        self.items, self.k = items, k
        self.best: list[list[tuple]] = [[] for _ in floor]     # (-score, key is not null, key), best first
        self.least = np.maximum(np.array(floor, np.int64), 1)  # weakest score that can still enter
        self.visited = self.scored = 0

    def add(self, keys: list, ends: np.ndarray, which: np.ndarray, impact: np.ndarray, weights: np.ndarray) -> None:
        """A block of documents: document d holds the terms ``which[ends[d]:ends[d + 1]]`` with coordinates ``impact``."""
        order = arrange(len(keys), np.repeat(np.arange(len(keys)), np.diff(ends)), which, impact * weights[which], self.items.size, _DOC_LEAF)
        sizes = np.diff(ends)[order]
        starts = np.concatenate(([0], np.cumsum(sizes)))
        take = np.repeat(ends[:-1][order] - starts[:-1], sizes) + np.arange(starts[-1])
        self.terms, self.impact = which[take], impact[take].astype(self.items.exact)
        self.rows = np.repeat(np.arange(len(order)), sizes)
        self.starts, self.keys, self.order = starts, keys, order.tolist()
        n = -(-len(order) // _DOC_LEAF)
        leaves = np.zeros((n, self.items.size), self.items.exact)
        np.maximum.at(leaves, (self.rows // _DOC_LEAF, self.terms), self.impact)
        self.levels = _levels(leaves)
        if self.items.levels:
            self._visit(len(self.levels) - 1, 0, len(self.items.levels) - 1, 0)

    def _weakest(self, level: int, node: int) -> int:
        """The weakest score that can still enter for any item under the node."""
        span = _FAN ** level * _ITEM_LEAF
        return self.least[self.items.order[node * span:(node + 1) * span]].min()

    def _visit(self, dl: int, d: int, il: int, i: int) -> None:
        if dl == 0 and il == 0:
            return self._score(d, i)
        below_d = (dl - 1, np.arange(d * _FAN, min((d + 1) * _FAN, len(self.levels[dl - 1])))) if dl else (0, np.array([d]))
        below_i = (il - 1, np.arange(i * _FAN, min((i + 1) * _FAN, len(self.items.levels[il - 1])))) if il else (0, np.array([i]))
        bounds = self.levels[below_d[0]][below_d[1]] @ self.items.levels[below_i[0]][below_i[1]].T
        for at in np.argsort(-bounds, axis=None, kind="stable").tolist():
            x, y = divmod(at, bounds.shape[1])
            self.visited += 1
            node = int(below_i[1][y])
            if bounds[x, y] >= self._weakest(below_i[0], node):
                self._visit(below_d[0], int(below_d[1][x]), below_i[0], node)

    def _score(self, d: int, i: int) -> None:
        held, columns, matrix = self.items.leaves[i]
        first, last = d * _DOC_LEAF, min((d + 1) * _DOC_LEAF, len(self.order))
        a, b = self.starts[first], self.starts[last]
        place = np.searchsorted(columns, self.terms[a:b])
        place[place == len(columns)] = 0
        hit = columns[place] == self.terms[a:b]
        dense = np.zeros((last - first, len(columns)), self.items.exact)
        dense[self.rows[a:b][hit] - first, place[hit]] = self.impact[a:b][hit]
        scores = dense @ matrix
        self.scored += scores.size
        for row, column in np.argwhere(scores >= self.least[held]).tolist():
            item, score = held[column], int(scores[row, column])
            key = self.keys[self.order[first + row]]
            best, entry = self.best[item], (-score, key is not None, key)
            if len(best) == self.k:
                if entry >= best[-1]:
                    continue
                best.pop()
            insort(best, entry)
            if len(best) == self.k:
                self.least[item] = max(self.least[item], -best[-1][0])

    def results(self):
        for item, best in enumerate(self.best):
            for score, _, key in best:
                yield item, -score, key


def _search(vectors: DataFrame, items: Items, weights: list[int], n_docs: int, n_terms: int, floor: list[int], k: int) -> DataFrame:
    """``item, score, key``: the best ``k`` rows of every item from each partition of ``vectors``."""
    kind = vectors.schema["key"].dataType
    by_term = np.array(weights, np.float64)

    def run(batches):
        search, held, rows, key_type = Search(items, floor, k), [], 0, None

        def block():
            t = pa.Table.from_batches(held).combine_chunks()
            which, counts = (t.column(c).combine_chunks() for c in ("terms", "counts"))
            ends = which.offsets.to_numpy().astype(np.int64)
            terms_, tf = which.values.to_numpy()[ends[0]:ends[-1]], counts.values.to_numpy()[ends[0]:ends[-1]].astype(np.int64)
            ends = ends - ends[0]
            m = np.array([75 + 25 * n * n_docs // n_terms for n in t.column("n").to_pylist()], np.int64)
            impact = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(m, np.diff(ends)))
            search.add(t.column("key").to_pylist(), ends, terms_, impact, by_term)

        for b in batches:
            key_type = b.schema.field("key").type
            b = b.filter(pa.compute.greater(pa.compute.list_value_length(b.column(b.schema.get_field_index("terms"))), 0))
            for at in range(0, b.num_rows, _BLOCK):
                part = b.slice(at, _BLOCK)
                if rows + part.num_rows > _BLOCK:
                    block()
                    held, rows = [], 0
                held.append(part)
                rows += part.num_rows
        if rows:
            block()
        found = list(search.results())
        if found:
            item, score, key = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(score, pa.int64()), pa.array(key, key_type)],
                                             names=["item", "score", "key"])

    schema = T.StructType([T.StructField("item", T.IntegerType()), T.StructField("score", T.LongType()), T.StructField("key", kind)])
    return vectors.select("key", "n", "terms", "counts").mapInArrow(run, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    turn = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("key"))
    return found.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= k)


def rank(docs: DataFrame, items: DataFrame, k: int = 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
         item_text: str = "text", sample: int = 4096, group_chars: int = 2_000_000) -> DataFrame:
    """``item_key, rank, key, score`` of the ``k`` best rows of ``docs`` for every row of ``items``, scores above 0.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.  With N rows of ``docs``
    that hold a term, L terms in all, n terms in a row, df rows holding a term and tf times in a row, a
    term weighs floor(1000 ln((2N + 2) / (2 df + 1))), and a row scores the sum over the item's terms, repeats
    included, of that weight times (10^9 tf) div (1000 tf + 12 m), m = 75 + (25 n N) div L.  Ranks start at 1 and
    are unique; equal scores go by ascending key, null keys first.

    Null and empty texts have no term: such rows count nowhere, such items have no result.  Repeated
    rows, and rows or items of equal or null key, are ranked each for itself; empty tables give no
    row; further columns are ignored.  A text of any length is read whole, piece by piece.  About ``sample``
    rows give the floor from which the search starts.  Items are searched in groups of about ``group_chars`` characters.
    """
    spark = docs.sparkSession
    stated = items.select(F.col(item_key).alias("item_key"), F.col(item_text).alias("item_text"))
    length = stated.agg(F.sum(F.length("item_text"))).first()[0] or 0
    groups = length // group_chars + 1
    out = None
    for g in range(groups):
        rows = stated.where(F.pmod(F.xxhash64("item_key", "item_text"), F.lit(groups)) == g).collect()     # a group: bounded
        counted = [Counter(w for words in terms(r["item_text"]) for w in words) for r in rows]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counted)), 1)}
        vectors = written(count_terms(docs, vocabulary, key, text), "term-counts")
        total = vectors.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
        n_docs, n_terms = total["n"], total["l"] or 1
        df = dict(vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect())      # one row per term of the group
        weights = [0] + [weight(n_docs, df.get(t, 0)) for t in vocabulary.values()]
        of_items = [{vocabulary[w]: weights[vocabulary[w]] * c for w, c in held.items() if weights[vocabulary[w]]} for held in counted]
        tree = Items(of_items, len(weights))
        floor = [0] * len(rows)
        if n_docs > 2 * sample:
            some = _best(_search(vectors.sample(fraction=sample / n_docs, seed=1).repartition(4), tree, weights, n_docs, n_terms, floor, k), k)
            for r in some.where(F.col("rank") == k).select("item", "score").collect():     # one row per item of the group
                floor[r["item"]] = r["score"]
        found = _best(_search(vectors, tree, weights, n_docs, n_terms, floor, k), k)
        names = spark.createDataFrame([(i, r["item_key"]) for i, r in enumerate(rows)],
                                      T.StructType([T.StructField("at", T.IntegerType()), T.StructField("name", stated.schema["item_key"].dataType)]))
        part = (found.join(F.broadcast(names), F.col("item") == F.col("at"))
                .select(F.col("name").alias(item_key), "rank", F.col("key").alias(key), "score"))
        out = part if out is None else out.unionByName(part)
    return out
