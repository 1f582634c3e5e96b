"""Character vocabulary, tokenisation, sequence encoding and mini-batches (V1, IO6, T1, T2, B1-B4).

The vocabulary is a map-side combined character histogram ranked with
``ordered_index``; tokenisation is a row-local array lookup (see ``char_tokens``);
batching, padding and collection are window / group-by work on small groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from behaviorkit.operators.ranking import ordered_index

# Special tokens and their ids (padding must be id 0).
SPECIALS = ("[PAD]", "[unused1]", "[UNK]", "[CLS]", "[SEP]")
PAD, SPACE, UNK, CLS, SEP = 0, 1, 2, 3, 4
# Space-like characters: space, newline, carriage return, tab, Unicode category Zs.
SPACE_RE = "^[ \\n\\r\\t\\p{Zs}]$"
MAXLEN = 256      # fixed value: code points fed to the encoder
BATCH_SIZE = 4    # fixed value: rows per mini-batch
_CODE_SPACE = 0x110000


def chars(text: Column) -> Column:
    """Array of the code points of ``text`` (empty array for an empty string)."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, ""))


def char_vocabulary(corpus: DataFrame, text: str = "content") -> DataFrame:
    """V1: ``(token, token_id, n)``: specials first, then every non-space character
    of the whole texts ranked by frequency (desc) and code-point order.

    The character histogram is map-side combined, so the shuffle carries one
    row per distinct character per task; ranking uses :func:`ordered_index`.
    """
    spark = corpus.sparkSession
    counts = (corpus.select(F.explode(chars(F.col(text))).alias("token"))
                    .where(~F.col("token").rlike(SPACE_RE))
                    .groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    specials = [(t, i, None) for i, t in enumerate(SPECIALS)]
    ranked = ordered_index(counts, [F.col("n").desc(), F.col("token")], name="r")
    vocab = ranked.select("token", (F.col("r") - 1 + len(SPECIALS)).cast("int").alias("token_id"), "n")
    return spark.createDataFrame(specials, "token string, token_id int, n long").unionByName(vocab)


def strip(c: Column) -> Column:
    """Leading and trailing white space removed, Unicode spaces and the separators U+001C-U+001F included."""
    return F.regexp_replace(c, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """IO6: one token per line -> ``(token, token_id)`` with dense ids in file order.

    Lines are stripped; a repeated token keeps its first id (the ids stay dense).  The order is
    file path, start of the file block, place of the line in it, so a folder of files is read in
    path order.
    """
    place = ["path", "start", "line"]
    lines = spark.read.text(path).select(
        strip(F.col("value")).alias("token"), F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"))
    first = lines.groupBy("token").agg(F.min(F.struct(*place)).alias("at")).select("token", "at.*")
    ranked = ordered_index(first, place, name="r")
    return ranked.select("token", (F.col("r") - 1).cast("int").alias("token_id"))


def lookup_table(vocab: DataFrame) -> DataFrame:
    """One row ``lut``: token id of every code point from 0 to the largest that is not ``[UNK]``.

    A single-character token has its own id, other space-like characters (Unicode category Zs from
    the engine's own tables) have ``[unused1]``.  Bounded by the Unicode code space.
    """
    spark = vocab.sparkSession
    char = F.decode(F.unhex(F.lpad(F.hex("cp"), 8, "0")), "UTF-32")
    space = (spark.range(0, _CODE_SPACE).withColumnRenamed("id", "cp").where(~F.col("cp").between(0xD800, 0xDFFF))
             .where(char.rlike(SPACE_RE)).select("cp", F.lit(SPACE).alias("token_id")))
    single = vocab.where(F.char_length("token") == 1).select(F.ascii("token").cast("long").alias("cp"), "token_id")
    known = single.unionByName(space).groupBy("cp").agg(F.max("token_id").alias("token_id"))
    last = known.agg(F.max("cp").alias("last"))
    full = (spark.range(0, _CODE_SPACE).withColumnRenamed("id", "cp").where(F.col("cp") <= last.scalar())
            .join(known, "cp", "left").select("cp", F.coalesce("token_id", F.lit(UNK)).alias("token_id")))
    return full.agg(F.transform(F.array_sort(F.collect_list(F.struct("cp", "token_id"))), lambda x: x["token_id"]).alias("lut"))


def char_tokens(corpus: DataFrame, vocab: DataFrame, keys: Sequence[str] = ("task", "id"),
                text: str = "content", out: str = "tokens") -> DataFrame:
    """T1 + J5: per document, the token id of every character of the whole text:
    the character's own id when in the vocabulary, else ``[unused1]`` for
    space-like characters, else ``[UNK]``.

    Row-local built-ins, no shuffle and no Python: each character indexes one array over the code
    points (:func:`lookup_table`), a one-row scalar subquery.  Exploding every character into a row
    would make the re-assembly aggregate hold whole documents as row buffers.
    """
    lut = lookup_table(vocab).scalar()
    ids = F.transform(chars(F.col(text)), lambda ch: F.coalesce(F.get(F.col("_lut"), F.ascii(ch)), F.lit(UNK)))
    return corpus.withColumn("_lut", lut).select(*keys, ids.alias(out))


def encode(tokens: Column, maxlen: int = MAXLEN) -> tuple[Column, Column]:
    """T2 (+ P11), truncating form: ``[CLS] + first maxlen tokens + [SEP]`` and all-zero segment ids."""
    x1 = F.concat(F.array(F.lit(CLS)), F.slice(tokens, 1, maxlen), F.array(F.lit(SEP)))
    x2 = F.array_repeat(F.lit(0), F.size(x1))
    return x1, x2


def encode_windows(df: DataFrame, keys: Sequence[str] = ("task", "id"), tokens: str = "tokens",
                   maxlen: int = MAXLEN) -> DataFrame:
    """T2, whole texts: consecutive windows ``(keys..., window, x1, x2)`` of ``maxlen`` tokens, each
    wrapped in ``[CLS]`` and ``[SEP]``; a text without tokens has one empty window."""
    last = F.greatest(F.ceil(F.size(tokens) / F.lit(maxlen)).cast("int") - 1, F.lit(0))
    w = df.select(*keys, tokens, F.explode(F.sequence(F.lit(0), last)).alias("window"))
    x1 = F.concat(F.array(F.lit(CLS)), F.slice(F.col(tokens), F.col("window") * maxlen + 1, F.lit(maxlen)), F.array(F.lit(SEP)))
    return w.select(*keys, "window", x1.alias("x1")).withColumn("x2", F.array_repeat(F.lit(0), F.size("x1")))


def text_windows(df: DataFrame, keys: Sequence[str] = ("task", "id"), text: str = "content", maxlen: int = MAXLEN) -> DataFrame:
    """Consecutive windows ``(keys..., window, part)`` of ``maxlen`` characters of whole texts; an empty text has one empty window.

    A window travels as its characters, a quarter of the size of their ids; :func:`encode_part` gives the ids where they are needed.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{maxlen}}}"), F.lit(0))
    pieces = F.when(F.length(text) == 0, F.array(F.lit(""))).otherwise(pieces)
    return df.select(*keys, F.posexplode(pieces).alias("window", "part"))


def encode_part(part: Column, lut: Column) -> Column:
    """T1 + T2 of one window: ``[CLS]``, the ids of its characters by :func:`lookup_table`, ``[SEP]``."""
    ids = F.transform(chars(part), lambda ch: F.coalesce(F.get(lut, F.ascii(ch)), F.lit(UNK)))
    return F.concat(F.array(F.lit(CLS)), ids, F.array(F.lit(SEP)))


def assign_batches(df: DataFrame, order: Sequence[Column | str], size: int = BATCH_SIZE,
                   batch: str = "batch", rn: str = "rn") -> DataFrame:
    """B1: consecutive batches of ``size`` rows in ``order``; the last may be partial."""
    ranked = ordered_index(df, order, name=rn)
    return ranked.withColumn(batch, F.floor((F.col(rn) - 1) / size).cast("long"))


def pad_in_batch(df: DataFrame, col: str, batch: str = "batch", pad: int = PAD, out: str | None = None) -> DataFrame:
    """B2: pad ``col`` with ``pad`` to the longest array of its batch."""
    longest = F.max(F.size(col)).over(Window.partitionBy(batch))
    padded = F.concat(F.col(col), F.array_repeat(F.lit(pad), longest - F.size(col)))
    return df.withColumn(out or col, padded)


def collect_batches(df: DataFrame, cols: Sequence[str], batch: str = "batch", rn: str = "rn") -> DataFrame:
    """One row per batch with the rows' arrays in order (a batch holds ``size`` rows)."""
    s = F.array_sort(F.collect_list(F.struct(F.col(rn), *[F.col(c) for c in cols])))
    def field(name):
        return lambda r: r[name]

    return (df.groupBy(batch).agg(s.alias("_rows"))
              .select(batch, *[F.transform("_rows", field(c)).alias(c) for c in cols]))


def int_array_text(c: Column, sep: str = ",") -> Column:
    """Comma-joined text of an int array (report form)."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), sep)


def nested_array_text(c: Column) -> Column:
    """'|'-joined rows of comma-joined int arrays (report form of a batch matrix)."""
    return F.array_join(F.transform(c, lambda a: int_array_text(a)), "|")
