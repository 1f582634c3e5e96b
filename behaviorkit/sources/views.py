"""Input views: the reference's input shapes mapped onto the driver tables.

Each view is a lazy projection over one or two Parquet tables, so column
pruning and filters reach the scan.  The mapping is by shape only (see
FIXTURES.md section 2); the DuckDB twin of every view lives in
``behaviorkit.plans.sqlgen.VIEWS``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorkit.sources.tables import table

# Fixed values of the probability view: task -> class codes of that task.
TASK_DOMAINS = {0: (0, 1, 2, 3, 4), 1: (5, 6, 7), 2: (8, 9)}
N_CLASSES = 10


def _props_int() -> Column:
    return F.regexp_extract("props", "([0-9]+)", 1).cast("int")


def voc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voice call records: one row per call."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view", "purchase"))
    k = _props_int()
    return ev.select(
        F.col("user_id").alias("phone_no_m"),
        k.alias("opposite_no_m"),
        F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 2)
         .when(F.col("event_type") == "purchase", 3).alias("calltype_id"),
        F.nullif(F.col("value"), F.lit(0.01)).alias("call_dur"),
        F.col("ts").alias("start_datetime"),
        (k % 3).alias("imei_m"),
        F.nullif(k % 7, F.lit(0)).alias("city_name"),
        F.nullif(k % 11, F.lit(0)).alias("county_name"),
    )


def sms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short-message records."""
    ev = table(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "error"))
    return ev.select(
        F.col("user_id").alias("phone_no_m"),
        F.nullif(_props_int(), F.lit(0)).alias("opposite_no_m"),
        F.when(F.col("event_type") == "signup", 1).otherwise(2).alias("calltype_id"),
        F.col("ts").alias("request_datetime"),
    )


def app(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data-usage records."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("phone_no_m"),
        F.nullif(F.col("l_partkey") % 50, F.lit(0)).alias("busi_name"),
        F.col("l_extendedprice").alias("flow"),
        F.date_format("l_shipdate", "yyyyMM").alias("month_id"),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriber attributes with a ``split`` column (train / april / final)."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    key = F.col("c_custkey")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        key.alias("phone_no_m"),
        F.nullif(F.col("c_mktsegment"), F.lit("FURNITURE")).alias("city_name"),
        F.col("n_name").alias("county_name"),
        F.when(key % 13 == 0, F.lit("\\N")).otherwise(F.col("c_acctbal").cast("string")).alias("arpu_202005"),
        F.when(key % 3 == 0, 1).otherwise(0).alias("label"),
        F.when(key % 10 < 6, "train").when(key % 10 < 8, "april").otherwise("final").alias("split"),
    )


def labels_u(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label files for the April users; ``half`` tells which of the two files."""
    key = F.col("c_custkey")
    return (table(spark, sf_dir, "customer").where((key % 10).isin(6, 7))
            .select(key.alias("phone_no_m"), F.when(key % 3 == 0, 1).otherwise(0).alias("label"),
                    (key % 2).alias("half")))


def tnews(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"),
                    F.col("lang").alias("label"))


def ocemotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"),
        F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("bad").alias("label"))


def ocnli(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "conversations").alias("a")
    b = table(spark, sf_dir, "conversations").alias("b")
    return a.join(b, (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("b.turn") == F.col("a.turn") + 1)).select(
        F.concat(F.col("a.conv_id").cast("string"), F.lit("-"), F.col("a.turn").cast("string")).alias("id"),
        F.col("a.text").alias("content1"), F.col("b.text").alias("content2"), F.col("b.role").alias("label"))


def probw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-number class weights: every component of the vector adds to class (place mod 10)."""
    def folded(c):
        mine = F.filter("embedding", lambda _, i: i % N_CLASSES == c)
        return F.aggregate(mine, F.lit(1).cast("bigint"), lambda a, x: a + F.floor(F.abs(x.cast("double")) * 10000).cast("bigint"))

    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id", "label", (F.col("vec_id") % 3).alias("task"),
        F.transform(F.sequence(F.lit(0), F.lit(N_CLASSES - 1)), folded).alias("w"))


def probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class-probability rows: (vec_id, label, task, p array<double> of 10 classes)."""
    w = probw(spark, sf_dir)
    total = F.aggregate("w", F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return w.select("vec_id", "label", "task",
                    F.transform("w", lambda x: x.cast("double") / total.cast("double")).alias("p"))


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deterministic pseudo-model positive-class probabilities per subscriber."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("phone_no_m"),
        ((key * 37 % 1000).cast("double") / 1000).alias("p_a"),
        ((key * 91 % 1000).cast("double") / 1000).alias("p_b"),
        ((key * 53 % 1000).cast("double") / 1000).alias("p_c"),
    )
