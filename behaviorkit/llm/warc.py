"""WARC archives of pages, read back and indexed, and the external merge of the index.

Writing: every partition sorts its records by (URL key, capture time, page) and becomes one archive
file, a *capture run*.  A record is one row of Spark's text writer whose line separator is the end
of a WARC record, so archives can go to any file system Spark writes to.  Of equal payloads the
smallest page id is a ``response``; the others are ``revisit`` records that refer to it.

Reading: each archive is parsed by its Content-Length headers and gives index rows in file order.

Merging: index rows are dealt into key ranges; a task merges its slice of the runs, each already in
order, with a loser tree.  The result is one history of captures in (URL key, time, page) order.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from behaviorkit.llm.common import written
from behaviorkit.session import scratch_path

END = "\r\n\r\n"
NO_ID = 2**63 - 1                # a null page id: after all others
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
INDEX = ("run string, seq long, offset long, length long, url string, captured string, page_id long, record_type string, "
         "payload_bytes long, payload_digest string, refers_to long")


def base32(hex40: Column) -> Column:
    """Base32 of a digest in hex: each five hex digits are four base32 digits."""
    digits = []
    for g in range(8):
        five = F.conv(F.substring(hex40, 5 * g + 1, 5), 16, 10).cast("int")
        digits += [F.substr(F.lit(_BASE32), F.shiftright(five, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*digits)


def url_key(url: Column) -> Column:
    """Sort key of a URL: host labels reversed, then path and query; scheme, user, ``www``, default port and
    fragment are left out.  A null or blank URL has key ``)/``."""
    pattern = r"^\s*(?:[a-z][a-z0-9+.-]*://)?(?:[^/?#@]*@)?(?:www\d*\.)?([^/:?#]*)(?::(\d*))?([^#]*)"
    lower = F.lower(F.coalesce(url, F.lit("")))
    part = lambda k: F.regexp_extract(lower, pattern, k)
    port = F.when(part(2).isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), part(2)))
    rest = F.trim(part(3))
    return F.concat(F.array_join(F.reverse(F.split(part(1), r"\.")), ","), port, F.lit(")"),
                    F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


def revisits(rows: DataFrame, min_bytes: int = 0, salts: int = 16) -> DataFrame:
    """``(id, sha1, refers_to)`` of the records that repeat the payload of a smaller page id.

    ``rows`` is narrow (id, sha1, size).  A payload that a third of all pages share is spread over
    ``salts`` tasks.
    """
    first = (rows.where(F.col("size") >= min_bytes).groupBy("sha1").agg(F.min("id").alias("refers_to"), F.max("id").alias("most"))
             .where(F.col("refers_to") < F.col("most")).select("sha1", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")))
    return (rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int")).join(first, ["sha1", "salt"])
            .where(F.col("id") > F.col("refers_to")).select("id", "sha1", "refers_to").distinct())


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
                   captured: Column | None = None, min_bytes: int = 0, records_per_file: int = 4000, compression: str = "gzip") -> None:
    """One record per row of ``pages`` below ``path``, each file sorted by (URL key, time, page).

    A null payload is empty; a null URL is an empty target; a null page id counts as the largest.
    Repeated rows of the smallest page id are all responses.  ``captured`` is the capture time; by
    default 2020-01-01 plus page id seconds.  ``min_bytes``: smaller payloads are always responses.
    """
    ident = F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))
    body = F.coalesce(F.col(html), F.lit(""))
    when = captured if captured is not None else F.timestamp_seconds(F.lit(1_577_836_800) + F.pmod(ident, F.lit(1_000_000_000)))
    rows = pages.select(ident.alias("id"), F.coalesce(F.col(url), F.lit("")).alias("target"), body.alias("payload"), when.alias("at"),
                        F.sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("size"))
    again = revisits(rows.select("id", "sha1", "size"), min_bytes)
    both = rows.join(again, ["id", "sha1"], "left")
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.when(c == NO_ID, "none").otherwise(c.cast("string")), F.lit(">"))
    repeat = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    block = F.when(repeat, http).otherwise(F.concat(http, F.col("payload")))
    length = F.octet_length(http) + F.when(repeat, F.lit(0)).otherwise(F.col("size"))
    safe = F.replace(F.replace(F.col("target"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(repeat, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name(F.col("id")),
        F.lit("\r\nWARC-Target-URI: "), safe,
        F.lit("\r\nWARC-Date: "), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("sha1")),
        F.when(repeat, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
                                name(F.col("refers_to")))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit(END), block)
    (both.sortWithinPartitions(url_key(F.col("target")), "at", "id").select(record.alias("value"))
     .write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path))


def records(data: bytes):
    """(offset, length, headers, block) of every record of an archive, by its Content-Length."""
    at = 0
    while at < len(data):
        head = data.index(b"\r\n\r\n", at)
        lines = data[at:head].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at {at}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        end = head + 4 + int(headers["Content-Length"])
        if data[end:end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at {at} does not end where it says")
        yield at, end + 4 - at, headers, data[head + 4:end]
        at = end + 4


def _page(urn: str | None) -> int | None:
    number = urn[len("<urn:x-page:"):-1] if urn else ""
    return None if number in ("", "none") else int(number)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of all archives below ``path``, in file order within each run.

    Payload size and digest of a response come from the stored payload, whose digest must be the
    stated one; those of a revisit from its headers.  Offsets count decompressed bytes.
    """
    def parse(batches):
        for b in batches:
            for run, raw in zip(b["path"], b["content"]):
                data = zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else bytes(raw)
                rows = []
                for seq, (offset, length, h, block) in enumerate(records(data)):
                    cut = block.index(b"\r\n\r\n") + 4
                    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response":
                        size = len(block) - cut
                        if base64.b32encode(hashlib.sha1(block[cut:]).digest()).decode() != digest:
                            raise ValueError(f"digest of {h['WARC-Record-ID']} does not match its payload")
                    else:
                        size = int(block[:cut].split(b"Content-Length: ")[1].split(b"\r\n")[0])
                    page, first = _page(h["WARC-Record-ID"]), _page(h.get("WARC-Refers-To"))
                    rows.append((run, seq, offset, length, h["WARC-Target-URI"], h["WARC-Date"], page, h["WARC-Type"], size, digest, first))
                out = pd.DataFrame(rows, columns=[c.split()[0] for c in INDEX.split(", ")])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64"})

    found = spark.read.format("binaryFile").load(path).select("path", "content")
    return found.mapInPandas(parse, INDEX)


class LoserTree:
    """k-way merge: ``runs`` are iterators of (key, item) in key order; yields items in key order.

    An inner node keeps the loser of its match and the winner moves up, so the next item costs one
    comparison per level, along the path of the last winner.  Ties go to the earlier run.
    """

    def __init__(self, runs):
        self._runs = [iter(r) for r in runs]
        k = len(self._runs)
        self._heads = [next(r, None) for r in self._runs]
        self._losers = [-1] * max(k, 1)
        for r in range(k):
            self._play(r, building=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._heads[a], self._heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _play(self, run: int, building: bool = False) -> None:
        node = (run + len(self._runs)) // 2
        while node > 0:
            other = self._losers[node]
            if other < 0 and building:
                self._losers[node] = run
                return
            if self._beats(other, run):
                self._losers[node], run = run, other
            node //= 2
        self._losers[0] = run

    def __iter__(self):
        while self._runs and self._heads[winner := self._losers[0]] is not None:
            yield self._heads[winner][1]
            self._heads[winner] = next(self._runs[winner], None)
            self._play(winner)


def merge_runs(index: DataFrame) -> DataFrame:
    """The index in (URL key, time, page) order: adds ``url_key`` and ``position`` (from 0) in the whole history.

    A null page id comes last among equals; equal rows keep their run order.  Key ranges bound what a
    task holds: the order is total, so one URL with very many captures is split as well.
    """
    spark = index.sparkSession
    keyed = index.withColumn("url_key", url_key(F.col("url"))).withColumn("_id", F.coalesce("page_id", F.lit(NO_ID)))
    order = ["url_key", "captured", "_id", "run", "seq"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions("run", "seq").withColumn("_part", F.spark_partition_id())
    schema = ranged.schema.add("_at", "long")

    def merge(batches):
        some = [b for b in batches if len(b)]
        if not some:
            return
        rows = pd.concat(some, ignore_index=True)
        keys = list(zip(rows["url_key"], rows["captured"], rows["_id"]))
        runs = [[(keys[i], i) for i in at] for at in rows.groupby("run", sort=True).indices.values()]
        merged = rows.iloc[list(LoserTree(runs))]
        yield merged.astype({"page_id": "Int64", "refers_to": "Int64"}).assign(_at=range(len(merged)))

    # as floats, ids of rows beside a null would lose digits: they travel as text
    text = ranged.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    merged = written(text.mapInPandas(merge, schema), "history")
    counts = merged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))          # one row per task
    before = counts.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)),
                                               F.lit(0)).alias("n0"))
    return merged.join(before, "_part").withColumn("position", F.col("n0") + F.col("_at")).drop("_part", "_at", "_id", "n0")


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write the archives below the shared folder, read them back and return their merged index."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, key, url, html, min_bytes=min_bytes)
    return merge_runs(written(read_index(spark, path), "cdx"))
