"""Token-id shards with a minimal perfect hash index over the document keys.

The store is a table of segments in ascending key order.  A segment (a few MB) holds the raw
little-endian ids of consecutive documents (16 bits where the vocabulary allows, else 32), the
offset of each document, and an index: a minimal perfect hash maps each distinct key of the segment
to a slot, and the slot holds a 32-bit fingerprint of the key and the first document with it.  A
keyed read hashes the key, compares the fingerprint and slices the payload: constant time, no key
is compared or searched.  Keys are stored beside the index for full scans and are not read by keyed
access.

The hash is built in levels: keys that are alone in their bit of a level's bit array are settled,
the others go on to the next level; a slot is the number of set bits before a key's bit.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from behaviorkit.llm.tokens import encoder

#: One row of the store.  ``keys`` are 64-bit; the first ``nulls`` documents have a null key.
SEGMENT = ("part int, seg int, first_key long, last_key long, nulls long, docs long, ids long, width int, "
           "payload binary, offsets binary, keys binary, levels binary, level_bits array<long>, slots binary")

_SLOT = np.dtype([("fingerprint", "<u4"), ("doc", "<u4")])


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """Spread 64-bit keys (splitmix finaliser), another spread for each seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_index(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(bits of each level, all levels' bits as booleans) of distinct ``keys``."""
    sizes, bits, rest = [], [], keys.astype(np.uint64)
    while len(rest):
        m = max(8, -(-len(rest) * 3 // 16) * 8)
        at = (mix(rest, len(sizes)) % np.uint64(m)).astype(np.int64)
        alone = np.bincount(at, minlength=m) == 1
        sizes.append(m)
        bits.append(alone)
        rest = rest[~alone[at]]
    return sizes, np.concatenate(bits) if bits else np.zeros(0, bool)


def slots_of(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where no level has its bit."""
    before = np.concatenate(([0], np.cumsum(bits)))
    out, open_, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    keys = keys.astype(np.uint64)
    for level, m in enumerate(sizes):
        at = (mix(keys[open_], level) % np.uint64(m)).astype(np.int64) + base
        hit = bits[at]
        out[open_[hit]] = before[at[hit]]
        open_, base = open_[~hit], base + m
    return out


def _prints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 997) >> np.uint64(32)).astype("<u4")


def _segment(part: int, seg: int, width: int, keys: list, ids: list[bytes]) -> tuple:
    nulls = sum(k is None for k in keys)
    n32 = np.array([len(x) // 4 for x in ids], np.int64)
    raw = np.frombuffer(b"".join(ids), "<u4")
    k = np.array([0 if x is None else x for x in keys], np.int64)
    distinct, first = np.unique(k[nulls:], return_index=True)
    sizes, bits = build_index(distinct)
    slots = np.zeros(len(distinct), _SLOT)
    at = slots_of(distinct, sizes, bits)
    slots["fingerprint"][at], slots["doc"][at] = _prints(distinct), first + nulls
    known = [x for x in keys if x is not None]
    return (part, seg, known[0] if known else None, known[-1] if known else None, nulls, len(keys), int(n32.sum()), width,
            raw.astype("<u2").tobytes() if width == 2 else raw.tobytes(), np.concatenate(([0], np.cumsum(n32))).astype("<u8").tobytes(),
            k.astype("<i8").tobytes(), np.packbits(bits).tobytes(), sizes, slots.tobytes())


def write_store(docs: DataFrame, path: str, tokenizer: str, words: str, end_id: int, key: str = "doc_id", text: str = "text",
                segment_bytes: int = 4 << 20) -> None:
    """Encode whole texts and write them as segments in ascending key order below ``path``.

    One shuffle of the texts into key ranges; each task streams its sorted range and holds one
    segment.  A null or empty text has only its end id; null keys come first; repeated keys are kept
    side by side; other columns are ignored; an empty table writes no segment.
    """
    names = [c.split()[0] for c in SEGMENT.split(", ")]
    end = np.asarray([end_id], "<u4").tobytes()

    def encode(batches):
        from pyspark import TaskContext

        part, seg, keys, ids, held = TaskContext.get().partitionId(), 0, [], [], 0
        tokens = encoder(tokenizer, words)
        ids_of, width = tokens.encode, 2 if max(tokens.size, end_id + 1) <= 1 << 16 else 4
        for b in batches:
            for k, t in zip(b["_key"], b["_text"]):
                keys.append(None if k is None else int(k))
                ids.append(ids_of(t) + end)
                held += len(ids[-1])
                if held >= 2 * segment_bytes:
                    yield pd.DataFrame([_segment(part, seg, width, keys, ids)], columns=names)
                    seg, keys, ids, held = seg + 1, [], [], 0
        if keys:
            yield pd.DataFrame([_segment(part, seg, width, keys, ids)], columns=names)

    src = docs.select(F.col(key).cast("long").alias("_k"), F.col(text).alias("_text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = src.repartitionByRange(n, F.col("_k").asc_nulls_first()).sortWithinPartitions(F.col("_k").asc_nulls_first(), "_text")
    # as text: a null key would turn 64-bit numbers into floats on the way to pandas
    ranged.select(F.col("_k").cast("string").alias("_key"), "_text").mapInPandas(encode, SEGMENT).write.parquet(path)


def open_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT).parquet(path)


class Segment:
    """One segment in memory: ``at(keys)`` finds documents through the index, ``ids(i)`` slices one."""

    def __init__(self, row):
        self.ids_ = np.frombuffer(row["payload"], "<u2" if row["width"] == 2 else "<u4")
        self.offsets = np.frombuffer(row["offsets"], "<u8").astype(np.int64)
        self._sizes = [int(x) for x in row["level_bits"]]
        self._bits = np.unpackbits(np.frombuffer(row["levels"], np.uint8)).astype(bool)[:sum(self._sizes)]
        self._slots = np.frombuffer(row["slots"], _SLOT)

    def at(self, keys: np.ndarray) -> np.ndarray:
        """First document of each key, -1 where the segment does not have it."""
        if not len(self._slots):
            return np.full(len(keys), -1, np.int64)
        slot = slots_of(keys, self._sizes, self._bits)
        found = (slot >= 0) & (self._slots["fingerprint"][slot] == _prints(keys))
        return np.where(found, self._slots["doc"][slot].astype(np.int64), -1)

    def ids(self, i: int) -> bytes:
        return self.ids_[self.offsets[i]:self.offsets[i + 1]].astype("<u4").tobytes()


def _starts(store: DataFrame) -> DataFrame:
    """(part, seg, base): ids before each segment; sums per part first, so no window holds all segments."""
    sums = store.select("part", "seg", "ids")
    per_part = sums.groupBy("part").agg(F.sum("ids").alias("n"))       # one row per task of the writer
    parts = per_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)),
                                               F.lit(0)).alias("p0"))
    inside = Window.partitionBy("part").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    return (sums.withColumn("s0", F.coalesce(F.sum("ids").over(inside), F.lit(0))).join(parts, "part")
            .select("part", "seg", (F.col("p0") + F.col("s0")).alias("base")))


def read_documents(store: DataFrame, key: str = "doc_id") -> DataFrame:
    """Full scan: ``key, start, n_tokens, ids_crc32`` of every document, each found through the index.

    A document with a repeated key is found as the first with its key and counted on from there.
    """
    def scan(batches):
        for b in batches:
            for _, row in b.iterrows():
                s = Segment(row)
                k = np.frombuffer(row["keys"], "<i8")
                nulls = int(row["nulls"])
                first = s.at(k[nulls:])
                if (first < 0).any():
                    raise ValueError("a stored key is missing from the index of its segment")
                again = np.arange(len(first)) - np.searchsorted(k[nulls:], k[nulls:], side="left")
                at = np.concatenate((np.arange(nulls), first + again)).astype(np.int64)
                yield pd.DataFrame({"part": np.int32(row["part"]), "seg": np.int32(row["seg"]), "doc": at,
                                    "k": [None] * nulls + [str(x) for x in k[nulls:]], "local": s.offsets[at],
                                    "n_tokens": s.offsets[at + 1] - s.offsets[at], "ids_crc32": [zlib.crc32(s.ids(i)) for i in at]})

    found = store.mapInPandas(scan, "part int, seg int, doc long, k string, local long, n_tokens long, ids_crc32 long")
    return (found.join(_starts(store), ["part", "seg"])
            .select(F.col("k").cast("long").alias(key), (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32"))


def lookup(store: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keyed access: ``key, ids`` (little-endian 32-bit) of each distinct wanted key that the store holds.

    Keys are routed to the segments whose range holds them and grouped by segment; a task loads one
    segment without its stored keys.  Of documents with a repeated key the first of each segment is
    returned.  Null keys find nothing.
    """
    # one row per writer task: as many as that job's shuffle partitions, whatever the data
    ends = [(r["part"], r["lo"], r["hi"]) for r in store.groupBy("part").agg(F.min("first_key").alias("lo"), F.max("last_key").alias("hi"))
            .dropna().orderBy("lo").collect()]
    los = np.array([e[1] for e in ends], np.int64)

    @F.pandas_udf("int")
    def route(k: pd.Series) -> pd.Series:
        i = np.searchsorted(los, k.to_numpy(np.int64), side="right") - 1
        return pd.Series([ends[x][0] if x >= 0 else -1 for x in i], dtype="int32")

    wanted = keys.select(F.col(key).cast("long").alias("k")).dropna().distinct().withColumn("part", route("k"))
    ranges = store.select(F.col("part"), "seg", "first_key", "last_key")
    asked = wanted.join(ranges, "part").where((F.col("k") >= F.col("first_key")) & (F.col("k") <= F.col("last_key")))
    asked = asked.select(F.col("part").alias("p"), F.col("seg").alias("g"), "k")
    held = store.select("part", "seg", "width", "payload", "offsets", "levels", "level_bits", "slots")

    def read(segment: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        out = {"k": [], "ids": []}
        if len(segment) and len(want):
            s, k = Segment(segment.iloc[0]), want["k"].to_numpy(np.int64)
            for x, i in zip(k, s.at(k)):
                if i >= 0:
                    out["k"].append(x)
                    out["ids"].append(s.ids(i))
        return pd.DataFrame(out)

    found = held.groupBy("part", "seg").cogroup(asked.groupBy("p", "g")).applyInPandas(read, "k long, ids binary")
    return found.withColumnRenamed("k", key)
