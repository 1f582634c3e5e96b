"""Class-probability decoding (DEC1-DEC3, EN2 on arrays).

Probabilities are an ``array<double>`` indexed by class code; each row's task
restricts the classes it may take.  All decoding is row-local array work
(no shuffle): the task domain is a CASE over a fixed, small table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from behaviorkit.operators.prep import as_label_text


def domain_codes(task: Column, domains: Mapping[int, Sequence[int]]) -> Column:
    """Array of the class codes allowed for ``task``."""
    expr = None
    for t, codes in domains.items():
        arr = F.array(*[F.lit(int(c)) for c in codes])
        expr = F.when(task == t, arr) if expr is None else expr.when(task == t, arr)
    return expr


def class_name(code: Column, prefix: str = "L") -> Column:
    return F.concat(F.lit(prefix), code.cast("string"))


def _scored(p: Column, codes: Column) -> Column:
    """(score, code) of the allowed classes that have a score; NULL and NaN are no score."""
    pairs = F.transform(codes, lambda c: F.struct(F.element_at(p, c + 1).alias("p"), c.alias("c")))
    return F.filter(pairs, lambda x: x["p"].isNotNull() & ~F.isnan(x["p"].cast("double")))


def argmax_code(p: Column, codes: Column) -> Column:
    """DEC1 default: the allowed code with the largest probability; ties -> lowest code; nothing scored -> NULL."""
    best = F.array_max(F.transform(_scored(p, codes), lambda x: F.struct(x["p"].alias("p"), (-x["c"]).alias("nc"))))
    return (-best["nc"]).cast("int")


def argmax_concat(score: Column, codes: Column, prefix: str = "L") -> Column:
    """DEC1 parity: names of *all* allowed classes reaching the maximum score,
    concatenated in code order; no scored class -> empty string."""
    scored = _scored(score, codes)
    top = F.array_max(F.transform(scored, lambda x: x["p"]))
    hit = F.filter(scored, lambda x: x["p"] == top)
    return F.coalesce(F.array_join(F.transform(hit, lambda x: class_name(x["c"], prefix)), ""), F.lit(""))


def learned_domains(labelled: DataFrame, dictionary: DataFrame, task: str = "task", label: str = "label") -> DataFrame:
    """DEC1 + D3: per task the codes of its own distinct labels, ascending, as one array column ``codes``.

    One row per task; the codes are those of the fitted ``dictionary`` (EN1).
    """
    seen = labelled.select(task, as_label_text(F.col(label)).alias("value")).distinct().join(dictionary, "value")
    return seen.groupBy(task).agg(F.array_sort(F.collect_set("code")).alias("codes"))


def argmax_all(p: Column) -> Column:
    """Index of the largest element (first on ties), as numpy ``argmax``."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def probability_long(df: DataFrame, keys: Sequence[str], p: str = "p", prefix: str = "L") -> DataFrame:
    """DEC2 long form: one row per (key, class) with the class name."""
    return (df.select(*keys, F.posexplode(p).alias("code", "prob"))
              .select(*keys, F.col("code").cast("int").alias("code"), class_name(F.col("code"), prefix).alias("label"),
                      "prob"))


def probability_wide(df: DataFrame, keys: Sequence[str], n_classes: int, p: str = "p", prefix: str = "L") -> DataFrame:
    """DEC2 wide form: one column per class name (no pivot shuffle needed)."""
    return df.select(*keys, *[F.col(p)[i].alias(f"{prefix}{i}") for i in range(n_classes)])
