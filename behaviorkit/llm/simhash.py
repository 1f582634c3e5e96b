"""SimHash near-dedup: 64-bit fingerprints linked at a small Hamming distance, groups as components.

Candidate search by *segment popcounts*: the 64 bits are cut into 32 segments of two bits and a
fingerprint is mapped to the vector of bit counts (0, 1 or 2) per segment.  The Manhattan distance
of two such vectors never exceeds the Hamming distance of the fingerprints, so it is a lower bound
that can be searched on a grid.  Both halves of the vector (16 segments each) share the allowed
distance d, hence one half differs by at most d // 2.  Each half is a cell of an integer grid; the
range join looks up the cells within that Manhattan radius, the bound over the whole vector is
applied, and the survivors are verified with the exact Hamming distance.

A vector is kept as its *thermometer code*: count c of a segment becomes c low bits, so the
Manhattan distance of two vectors is ``bit_count(xor)`` and a neighbouring cell sets one more bit.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behaviorkit.llm.common import connected_components, cut, give_back, written

SEED = 42
_LOW = 0x5555555555555555     # the lower bit of each two-bit segment


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a whole text, as a signed long.

    A-Z are lower-cased, words are runs of anything but ASCII white space, shingles are ``shingle``
    consecutive words joined by a space, with repeats; a shorter text is one shingle; a null, empty
    or blank text has fingerprint 0.  A bit is 1 if set in more than half of the shingles' XXH64.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    last = max(len(words) - shingle + 1, 1)
    spans = zip(starts[:last].tolist(), (ends[min(shingle, len(words)) - 1:] - 1).tolist())
    digest = xxhash.xxh64_digest
    count, n = np.zeros(64, np.int64), 0
    chunk: list[bytes] = []
    for s, e in spans:
        chunk.append(digest(joined[s:e], SEED))
        if len(chunk) == 1 << 16:
            count, n = count + _bits(chunk), n + len(chunk)
            chunk = []
    count, n = count + _bits(chunk), n + len(chunk)
    return int(np.packbits(count * 2 > n).view(">i8")[0])


def _bits(digests: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def with_fingerprint(docs: DataFrame, text: str = "text", shingle: int = 3, name: str = "fp") -> DataFrame:
    """``docs`` plus its fingerprint as a long (Arrow batches, one text at a time)."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")
            del texts
        give_back()

    return docs.withColumn(name, fp(F.col(text)))


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def popcount_vector(fp: Column) -> Column:
    """Thermometer code of the two-bit segment counts: count 0, 1, 2 -> bits 00, 01, 11."""
    high = F.shiftright(fp, 1)
    either = fp.bitwiseOR(high).bitwiseAND(F.lit(_LOW))
    both = fp.bitwiseAND(high).bitwiseAND(F.lit(_LOW))
    return either.bitwiseOR(F.shiftleft(both, 1))


def _reach(cell: Column, radius: int) -> Column:
    """Array of (cell, step) for ``cell`` and each cell with up to ``radius`` more thermometer bits."""
    out = F.array(F.struct(cell.alias("cell"), F.lit(0).alias("step")))
    for r in range(1, radius + 1):
        grown = F.flatten(F.transform(F.filter(out, lambda x: x["step"] == r - 1), lambda x: F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: _can_set(x["cell"], i)),
            lambda i: F.struct(x["cell"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)).alias("cell"),
                               F.lit(r).alias("step")))))
        out = F.array_distinct(F.concat(out, grown))
    return out


def _can_set(cell: Column, i: Column) -> Column:
    """The next free bit of a segment: the lower one, or the upper one over a set lower one."""
    bit = lambda k: F.call_function("shiftright", cell, k).bitwiseAND(F.lit(1).cast("long"))
    return (bit(i) == 0) & ((i % 2 == 0) | (bit(i - 1) == 1))


def candidate_pairs(fps: DataFrame, distance: int = 3, fp: str = "fp") -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints whose popcount vectors are within ``distance``.

    ``fps`` holds each fingerprint once, so copies never meet.  Cells with all-equal halves are
    joined with the cells reached by adding bits; going down is found from the other side.
    """
    v = fps.select(F.col(fp).alias("fp"), popcount_vector(F.col(fp)).alias("vec"))
    halves = F.array(F.struct(F.lit(0).alias("half"), F.col("vec").bitwiseAND(F.lit(0xFFFFFFFF)).alias("cell")),
                     F.struct(F.lit(1).alias("half"), F.shiftrightunsigned("vec", 32).alias("cell")))
    cells = v.select("fp", "vec", F.explode(halves).alias("h")).select("fp", "vec", "h.half", "h.cell")
    # the cell that joins the bits of two cells is above both, and their Manhattan distance is the sum of the
    # steps up to it: at radius 1 it is one of the two, further out both sides look upwards
    probes = (cells.select("fp", "vec", "half", F.explode(_reach(F.col("cell"), distance // 2)).alias("r"))
              .select(F.col("fp").alias("a"), F.col("vec").alias("va"), "half", F.col("r.cell").alias("cell"), F.col("r.step").alias("step")))
    other = cells if distance < 4 else probes.select(F.col("a").alias("fp"), F.col("va").alias("vec"), "half", "cell")
    near = F.bit_count(F.col("va").bitwiseXOR(F.col("vec"))) <= distance
    once = (F.col("step") > 0) | (F.col("a") < F.col("fp")) if distance < 4 else F.col("a") < F.col("fp")
    return (probes.join(other, ["half", "cell"]).where(once & near & (F.col("a") != F.col("fp")))
            .select("a", F.col("fp").alias("b")))


def links(fps: DataFrame, distance: int = 3, fp: str = "fp") -> DataFrame:
    """Verified links between distinct fingerprints: Hamming distance at most ``distance``."""
    c = candidate_pairs(fps, distance, fp)
    return c.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).distinct()


def near_duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3,
                          distance: int = 3) -> DataFrame:
    """One row ``(key, fp, component_id)`` per row of ``docs``.

    ``component_id`` is the smallest key reachable over links, itself included.  Equal fingerprints
    are one node of the graph, so a group of copies of any size costs one row after a map-side
    combined aggregate.  Null and empty texts share fingerprint 0 and are linked; a row with a null
    key is returned with its group's smallest key (null if no row of the group has one); repeated
    rows stay; an empty table gives an empty result; other columns of ``docs`` are ignored.
    """
    src = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    marked = written(with_fingerprint(src, "_text", shingle, "fp").select("_key", "fp"), "simhash")
    nodes = cut(marked.groupBy("fp").agg(F.min("_key").alias("first")))
    groups = cut(connected_components(links(nodes.select("fp"), distance)))     # smallest fingerprint of each group
    of_node = (nodes.join(groups, nodes["fp"] == groups["node"], "left")
               .select("fp", F.coalesce("component", "fp").alias("root"), "first"))
    smallest = of_node.groupBy("root").agg(F.min("first").alias("component_id"))
    named = of_node.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("_key").alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest key, as it was.

    Decisions are made per row: rows of one key with unlike texts belong to different groups, and a row with a null key
    stays only where its group has no other key.  Of rows that repeat the smallest key of a group one stays.  Null,
    empty and blank texts are one group.  An empty table gives an empty one; a very long text is worked on
    by itself, shingle by shingle.

    The rows are written once with their fingerprint and a number; copies are reduced to their first row before the
    groups are found, and the texts are shuffled once, by the row number, whatever their size.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs[key].alias("key"), docs[text].alias("text"))
    rows = with_fingerprint(rows, "text", shingle, "fp").select("doc", "key", "fp", F.monotonically_increasing_id().alias("row"))
    rows = written(rows, "fingerprinted")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row"))
    nodes = cut(rows.groupBy("fp").agg(first.alias("first")))
    groups = cut(connected_components(links(nodes.select("fp"), distance)))
    of_group = (nodes.join(groups, nodes["fp"] == groups["node"], "left")
                .groupBy(F.coalesce("component", "fp").alias("root")).agg(F.min("first").alias("first")))
    stay = of_group.select(F.col("first.row").alias("of"))
    return rows.join(stay.hint("shuffle_hash"), F.col("row") == F.col("of"), "left_semi").select("doc.*")
