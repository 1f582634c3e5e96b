"""Document fingerprints from closed syncmers, in DataFrame functions only.

White space is normalised to single spaces.  At every character stands an inner substring of
``INNER`` characters; a k-mer is ``k`` consecutive ones, ``INNER + k - 1`` characters (16).  A k-mer is
a *closed syncmer* when the smallest hash of an inner substring lies at its first or last place.  That
depends on the k-mer alone, so equal passages choose equal anchors wherever they stand.

The fingerprint is the ``size`` smallest distinct anchor hashes of the whole text, as hex text; the
likeness of two fingerprints is the share of common values among the ``size`` smallest of both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behaviorkit.llm.common import written
from behaviorkit.operators.ranking import ordered_index

INNER = 13                       # characters of an inner substring
#: Takes one character and captures the inner substring that starts there.
_WINDOW = rf"(?s)(?=(.{{{INNER}}}))."


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def inner_hashes(plain: Column) -> Column:
    """Hashes of the inner substrings at all characters of a normalised text; a shorter one that is not empty is one of its own.

    Pass a column, not an expression: it is read several times.
    """
    found = F.regexp_extract_all(plain, F.lit(_WINDOW), F.lit(1))
    found = F.when(F.length(plain) >= INNER, found).when(F.length(plain) > 0, F.array(plain)).otherwise(F.array().cast("array<string>"))
    return F.transform(found, lambda w: F.xxhash64(w))


def chunk_hashes(text: Column) -> Column:
    """Hashes of the inner substrings of a text, its white space normalised."""
    return inner_hashes(normal(text))


def _places(hashes: Column, first: Column, last: Column, k: int) -> Column:
    """0-based places ``first`` to ``last`` (none if it is smaller) at which a closed syncmer starts."""
    def closed(i: Column) -> Column:
        inner = [F.get(hashes, i + j) for j in range(k)]
        return F.least(inner[0], inner[-1]) <= F.least(*inner[1:-1])

    return F.filter(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>")), closed)


def _hashed(hashes: Column, places: Column, k: int) -> Column:
    return F.transform(places, lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(k)]))


def _short(hashes: Column, k: int, found: Column) -> Column:
    """``found``, or for a text of fewer than ``k`` inner substrings one anchor of all its hashes."""
    whole = F.aggregate(hashes, F.lit(42).cast("long"), lambda a, h: F.xxhash64(a, h))
    return F.when(F.size(hashes) >= k, found).when(F.size(hashes) > 0, F.array(whole)).otherwise(F.array().cast("array<bigint>"))


def positions(hashes: Column, k: int = 4) -> Column:
    """0-based places of the closed syncmers; a text of fewer than ``k`` inner substrings is one anchor at 0."""
    places = _places(hashes, F.lit(0), F.size(hashes) - k, k)
    return F.when(F.size(hashes) >= k, places).when(F.size(hashes) > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))


def anchors(hashes: Column, k: int = 4) -> Column:
    """Hashes of the closed syncmers in text order."""
    return _short(hashes, k, _hashed(hashes, _places(hashes, F.lit(0), F.size(hashes) - k, k), k))


def sketch(found: Column, size: int = 64) -> Column:
    return F.slice(F.sort_array(F.array_distinct(found)), 1, size)


def as_text(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def likeness(a: Column, b: Column, size: int = 64) -> Column:
    """Estimated share of common anchors, 0 to 1; two texts without anchors are alike."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, size)
    common = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(common / F.size(union))


def _with_hashes(docs: DataFrame, plain: Column) -> DataFrame:
    """``docs`` plus ``_h``, the hashes of a normalised text; the text is a column of its own, so it is normalised once."""
    return docs.withColumn("_p", plain).withColumn("_h", inner_hashes(F.col("_p"))).drop("_p")


def fingerprints(docs: DataFrame, text: str = "text", k: int = 4, size: int = 64, name: str = "sketch") -> DataFrame:
    """``docs`` plus the sketch of every whole text (null: empty)."""
    found = _with_hashes(docs, normal(F.coalesce(F.col(text), F.lit(""))))
    return found.withColumn("_a", anchors(F.col("_h"), k)).withColumn(name, sketch(F.col("_a"), size)).drop("_h", "_a")


def _front(text: Column, n: Column) -> Column:
    """The half of a text of ``n`` characters that its edited copy keeps, normalised; white space at its end is one space."""
    return F.ltrim(F.regexp_replace(F.left(text, n - F.floor(n / 2)), r"\s+", " "))


def _inside(front: Column, k: int) -> Column:
    """Number of k-mers that lie in the kept half (not above 0: none); the text and its edited copy have them in common."""
    return F.length(F.rtrim(front)) - (INNER + k - 2)


def _packed(docs: DataFrame, k: int, size: int) -> DataFrame:
    """``docs`` plus ``prints``: sketch of the text and sketch of its kept half, a common value once.

    The array holds the number of values of the first only, the size of the first, the values of the first only, of both,
    and of the second only.  One column, so that every reader of the shuffled rows needs all of them.
    """
    found = _with_hashes(docs.withColumn("_l", F.greatest(_inside(_front(F.col("text"), F.col("n")), k), F.lit(0))), normal(F.col("text")))
    h, cut = F.col("_h"), F.col("_l")
    found = found.withColumns({"_a": _hashed(h, _places(h, F.lit(0), cut - 1, k), k),
                               "_b": _short(h, k, _hashed(h, _places(h, cut, F.size(h) - k, k), k))})
    found = found.withColumns({"_s": sketch(F.concat("_a", "_b"), size), "_k": sketch(F.col("_a"), size)})
    only, both, rest = F.array_except("_s", "_k"), F.array_intersect("_s", "_k"), F.array_except("_k", "_s")
    sizes = F.array(F.size(only).cast("long"), F.size("_s").cast("long"))
    return found.withColumn("prints", F.concat(sizes, only, both, rest)).drop("_l", "_h", "_a", "_b", "_s", "_k")


def _own(prints: Column) -> Column:
    return F.sort_array(F.slice(prints, 3, F.get(prints, F.lit(1)).cast("int")))


def _kept(prints: Column) -> Column:
    only = F.get(prints, F.lit(0)).cast("int")
    return F.slice(prints, only + 3, F.size(prints) - 2 - only)


def _edited_sketch(both: DataFrame, k: int, size: int) -> DataFrame:
    """``both`` plus the sketch of the edited copy: the anchors of the kept half are known, so only the k-mers that reach into
    ``h.head`` are looked at.  Where no k-mer lies in the kept half, the whole copy is fingerprinted."""
    found = both.withColumn("_f", _front(F.col("text"), F.col("n"))).withColumn("_l", _inside(F.col("_f"), k))
    start = F.when(F.col("_l") > 0, F.substr("_f", F.col("_l") + 1)).otherwise(F.col("_f"))
    # the first character looked at may be a space
    tail = found.withColumn("_t", F.rtrim(F.regexp_replace(F.concat(start, "h.head"), r"\s+", " ")))
    tail = _with_hashes(tail, F.when(F.col("_l") > 0, F.col("_t")).otherwise(F.ltrim("_t")))
    none = (F.col("_l") > 0) & (F.size("_h") < k)
    tail = tail.withColumn("_a", F.when(none, F.array().cast("array<bigint>")).otherwise(anchors(F.col("_h"), k)))
    return tail.withColumn("edited_sketch", sketch(F.concat(_kept(F.col("prints")), "_a"), size))


def anchor_table(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4) -> DataFrame:
    """``key, position, anchor``: every closed syncmer with its place, for positional matching."""
    h = docs.select(F.col(key), chunk_hashes(F.coalesce(F.col(text), F.lit(""))).alias("_h"))
    pairs = F.arrays_zip(positions(F.col("_h"), k).alias("position"), anchors(F.col("_h"), k).alias("anchor"))
    return h.select(key, F.explode(pairs).alias("_p")).select(key, "_p.position", "_p.anchor")


def compare_with_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 4, size: int = 64) -> DataFrame:
    """Fingerprint every text and an edited copy of it, and compare with it and with the next document.

    The edited copy has its last n // 2 characters replaced by the first as many (or all) of the next
    document in ascending key order (after the last: the first).  Returns ``key, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The order is found on (key, length, hash) rows alone.  Texts are shuffled once with their sketch and
    that of their kept half; that shuffle serves both the document itself and, as at most half a text, the
    one before it.  Of the edited copy only the k-mers that reach into the new half are hashed.
    Null keys come first; different rows with one key go by length and hash of the text; a repeated
    row is one document whose result is repeated; a null text is empty; a single document is its own
    next one; an empty table gives an empty result; other columns are ignored.
    """
    rows = (docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
            .withColumns({"absent": F.col("key").isNull(), "id": F.coalesce(F.col("key"), F.lit(0)),
                          "n": F.char_length("text"), "hash": F.xxhash64("text")}))
    ids = ["absent", "id", "n", "hash"]
    order = written(ordered_index(rows.select(*ids).distinct(), [F.desc("absent"), "id", "n", "hash"], name="row"), "order")
    total = order.count()
    # ids of a document -> ids and length of the one before it
    here = order.select(F.when(F.col("row") == 1, F.lit(total)).otherwise(F.col("row") - 1).alias("row"), *ids)
    prior = order.select("row", *[F.col(c).alias(f"to_{c}") for c in ids])
    links = here.join(prior, "row").drop("row")
    sent = _packed(rows.select(*ids, "text"), k, size)
    heads = (sent.join(links, ids)
             .select(*[f"to_{c}" for c in ids], F.left("text", F.floor(F.col("to_n") / 2)).alias("head"), _own(F.col("prints")).alias("next")))
    heads = heads.groupBy(*[f"to_{c}" for c in ids]).agg(F.any_value(F.struct("head", "next")).alias("h"))
    same = [F.col(c) == F.col(f"to_{c}") for c in ids]
    both = sent.join(heads, same).withColumn("edited", F.concat(F.left("text", F.col("n") - F.floor(F.col("n") / 2)), "h.head"))
    out = _edited_sketch(both, k, size).withColumn("sketch", _own(F.col("prints")))
    return out.select(F.when(~F.col("absent"), F.col("id")).alias(key), F.col("n").cast("long").alias("n_chars"),
                      F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"),
                      as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
                      likeness(F.col("sketch"), F.col("edited_sketch"), size).alias("near_edited"),
                      likeness(F.col("sketch"), F.col("h.next"), size).alias("near_next"))
