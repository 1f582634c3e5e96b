"""Encoding, splitting and missing-value operators (EN1-EN3, SP1, L2, X1, P9, A19, MV1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from behaviorkit.operators.quantiles import column_quantiles_long
from behaviorkit.operators.ranking import ntile_from_rank, ordered_index

NAN_TEXT = "nan"      # text a missing value becomes when cast to string (pandas astype(str))
SENTINEL = "\\N"      # missing-value sentinel found in raw exports (backslash + N)


def as_label_text(c: Column) -> Column:
    """P10: value as string, NULL -> 'nan' (a category of its own)."""
    return F.coalesce(c.cast("string"), F.lit(NAN_TEXT))


# ------------------------------------------------------------------ EN1 / EN2

def label_dictionary(df: DataFrame, col: str, scope: Sequence[str] = ()) -> DataFrame:
    """EN1 fit: (scope..., value, code) with code = 0..k-1 in code-point order of the
    string form of the value, per ``scope`` group (``scope=()`` = one global dictionary).
    """
    vals = df.select(*scope, as_label_text(F.col(col)).alias("value")).distinct()
    d = ordered_index(vals, ["value"], by=scope, name="code")
    return d.select(*scope, "value", (F.col("code") - 1).cast("int").alias("code"))


def label_encode(df: DataFrame, cols: Sequence[str], scope: Sequence[str] = (), suffix: str = "") -> DataFrame:
    """EN1 transform: replace each column by its dense code (or add ``col+suffix``).

    ``scope=()`` fits one dictionary over the whole table (the same city gets
    the same code everywhere); ``scope=("split",)`` refits per split, the
    reference's behaviour.  Dictionaries are small dimension tables; AQE
    broadcasts them when their run-time size is under the broadcast threshold.
    """
    out = df
    for c in cols:
        d = label_dictionary(df, c, scope).withColumnRenamed("code", f"_code_{c}")
        out = (out.withColumn("_v", as_label_text(F.col(c)))
                  .join(d.withColumnRenamed("value", "_v"), [*scope, "_v"], "left")
                  .drop("_v"))
        out = out.withColumnRenamed(f"_code_{c}", f"{c}{suffix}") if suffix else \
            out.drop(c).withColumnRenamed(f"_code_{c}", c)
    return out


def label_decode(df: DataFrame, code_col: str, dictionary: DataFrame, out_col: str = "label") -> DataFrame:
    """EN2: code -> original label text via the fitted dictionary."""
    d = dictionary.select(F.col("code").alias(code_col), F.col("value").alias(out_col))
    return df.join(d, code_col, "left")


# ------------------------------------------------------------------ EN3

def one_hot(label: Column, n_classes: int) -> Column:
    """EN3: int array of length n with a 1 at ``label``; a NULL label is class 0, the stand-in of unlabelled
    test rows (training rows without a label are left out before, R6)."""
    lab = F.coalesce(label.cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda i: (i == lab).cast("int"))


# ------------------------------------------------------------------ X1 / P9

def sentinel_to_null(df: DataFrame, cols: Sequence[str] | None = None, sentinel: str = SENTINEL) -> DataFrame:
    """Exact-cell match of the sentinel -> NULL on string columns."""
    names = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in names})


def to_float(c: Column, lenient: bool = True) -> Column:
    """32-bit float; ``lenient`` turns malformed text into NULL instead of failing."""
    return c.try_cast("float") if lenient else c.cast("float")


# ------------------------------------------------------------------ SP1 / L2

def stratified_folds(df: DataFrame, id_col: str, label_col: str, k: int = 10, seed: int = 222,
                     fold_col: str = "fold") -> DataFrame:
    """SP1: fold 0..k-1 per row, balanced within each label.

    Rows are shuffled by ``md5(id:seed)`` (deterministic, engine independent),
    numbered within their label, and cut into ``ntile(k)`` groups.  The numbering
    is distributed (``ordered_index``), so a label holding most rows is still
    spread over many tasks.
    """
    h = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))
    keyed = df.withColumn("_h", h)
    out = ordered_index(keyed, ["_h", id_col], by=[label_col], name="_rn", size="_size")
    return out.withColumn(fold_col, ntile_from_rank(F.col("_rn"), F.col("_size"), k) - 1).drop("_h", "_rn", "_size")


def train_validation_split(folded: DataFrame, fold_col: str = "fold", validation_fold: int = 0) -> DataFrame:
    """L2: first fold validates, the rest trains."""
    return folded.withColumn("subset", F.when(F.col(fold_col) == validation_fold, "validation").otherwise("train"))


# ------------------------------------------------------------------ A19 / MV1

def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    num = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, num) and f.name not in exclude]


def column_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles of whole columns, long form
    ``(column, q, value)``; NULL and NaN are ignored.

    Distributed (:mod:`behaviorkit.operators.quantiles`): the columns are
    unpivoted, numbered in value order per column, and only the two
    neighbouring order statistics of each level are kept -- no task holds a
    whole column.
    """
    return column_quantiles_long(df, cols, qs)


def quantile_fills(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> dict[float, dict[str, float]]:
    """MV1 fit: the fill value of each column for every level in ``qs``, in one pass over ``df``.

    One number per column and level -- bounded by the schema width -- reaches the driver.
    """
    out: dict[float, dict[str, float]] = {q: {} for q in qs}
    for r in column_quantiles(df, cols, list(qs)).collect():
        out[min(qs, key=lambda q: abs(q - r["q"]))][r["column"]] = r["value"]
    return out


def apply_fills(df: DataFrame, cols: Sequence[str], values: dict) -> DataFrame:
    """MV1 transform: NULL and NaN of each column become its fill value (a column without one keeps NULL)."""
    fills = {}
    for c in cols:
        v, dt = values.get(c), df.schema[c].dataType
        if isinstance(dt, (T.FloatType, T.DoubleType)):
            col, out_t = F.when(~F.isnan(F.col(c)), F.col(c)), dt
        else:  # an integral column filled with a fractional quantile becomes double
            col, out_t = F.col(c).cast("double"), T.DoubleType()
        fills[c] = F.coalesce(col, F.lit(v).cast(out_t)) if v is not None else col
    return df.withColumns(fills)


def quantile_impute(df: DataFrame, cols: Sequence[str], q: float) -> DataFrame:
    """MV1: fill NULL/NaN in each column with that column's q-quantile."""
    return apply_fills(df, cols, quantile_fills(df, cols, [q])[q])
