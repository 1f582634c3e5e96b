"""Modelling-table assembly (F5): users + usage/voice/SMS features + labels.

The reference builds three user tables (train, April test, final test), each
with three left joins and its own label encoders, then concatenates two of
them.  Here all users carry a ``split`` column and are joined once: three
left joins on the subscriber key, whose per-key feature tables are already
hash-partitioned by that key.  AQE's skew-join split covers a hot subscriber.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from behaviorkit.operators import features as feat
from behaviorkit.operators.prep import label_encode, sentinel_to_null, to_float

KEY = feat.KEY


def union_all(frames: Sequence[DataFrame], allow_missing: bool = False) -> DataFrame:
    """Bag union by column name; ``allow_missing`` fills absent columns with NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)


def drop_checked(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns, failing on a name that is not there (Spark would ignore it)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise KeyError(f"columns not found: {missing}")
    return df.drop(*cols)


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """P3."""
    return df.withColumnsRenamed(mapping)


def null_safe_left_join(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """J2 parity: left join where NULL keys match NULL keys (pandas ``merge``)."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [left[c].eqNullSafe(r[f"_r_{c}"]) for c in on])
    return left.join(r, cond, "left").drop(*[f"_r_{c}" for c in on])


def attach_features(users: DataFrame, tables: Sequence[DataFrame], key: str = KEY) -> DataFrame:
    """Left-join each per-key feature table onto the users."""
    return reduce(lambda acc, t: acc.join(t, key, "left"), tables, users)


def features_by_split(users: DataFrame, app: DataFrame, voc: DataFrame, sms: DataFrame, key: str = KEY,
                      split: str = "split", only: Sequence[str] = ("app", "voc", "sms")) -> dict[str, DataFrame]:
    """the usage, voice and SMS feature tables, each carrying the subscriber's
    ``split`` so one job per source serves every split (write them with
    ``partitionBy(split)`` and a reader of one split prunes the others).  Every
    subscriber has a row; one without records has NULL features."""
    s = users.select(key, split)
    build = {"app": lambda: feat.usage_features(app, key), "voc": lambda: feat.voice_features(voc, key),
             "sms": lambda: feat.sms_features(sms, key)}
    return {name: s.join(build[name](), key, "left") for name in only}


def assemble_users(users: DataFrame, app: DataFrame, voc: DataFrame, sms: DataFrame, labels: DataFrame,
                   key: str = KEY, encode_scope: Sequence[str] = (), arpu: str = "arpu_202005") -> DataFrame:
    """one modelling row per subscriber and split.

    * train rows keep their own label, April rows take it from ``labels``
      (left join, no de-duplication: a key listed twice fans out), final rows
      have none;
    * the usage, voice and SMS features are left-joined once for all splits;
    * ``city_name`` / ``county_name`` become dense codes (``encode_scope=()``:
      one dictionary for all splits; ``("split",)``: refit per split);
    * the ``\\N`` sentinel becomes NULL in every split and ``arpu`` a 32-bit float.
    """
    # one pass over the users: the label files join only April rows (a key listed
    # twice fans out those rows, as a left join does); train keeps its own label
    lab = labels.select(F.col(key).alias("_lk"), F.col("label").alias("_ll"))
    split = F.col("split")
    u = users.join(lab, (F.col(key) == F.col("_lk")) & (split == "april"), "left")
    u = u.withColumn("label", F.when(split == "train", F.col("label")).when(split == "april", F.col("_ll"))
                     .cast("int")).drop("_lk", "_ll")
    u = sentinel_to_null(u, [arpu]).withColumn(arpu, to_float(F.col(arpu)))
    u = label_encode(u, ["city_name", "county_name"], scope=encode_scope)
    fa = feat.usage_features(app, key)
    fv = feat.voice_features(voc, key)
    fs = feat.sms_features(sms, key)
    out = attach_features(u, [fa, fv, fs], key)
    head = [key, "split", "city_name", "county_name", arpu, "label"]
    rest = [c for c in out.columns if c not in head]
    return out.select(*head, *rest)
