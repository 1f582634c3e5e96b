"""Per-subscriber behavioural feature builders (usage, voice, SMS).

Design
------
The reference computes every statistic in its own ``groupby`` and left-joins
the pieces back onto a de-duplicated key spine (19 joins).  Here each builder
is at most three shuffled aggregations that share the subscriber key:

* one fused ``groupBy(key).agg(...)`` for all single-level statistics
  (counts, conditional counts, moments, quantiles, distinct counts);
* the two-level pair statistics: ``groupBy(key, counterpart)`` first, which
  spreads a hot subscriber over its counterparts, then ``groupBy(key)``;
* one value histogram ``groupBy(key, dim, value).count()`` for the time
  preferences (mode, mode frequency, distinct count), which is map-side
  combined so a hot subscriber contributes at most 24 + 31 rows per task.

The per-key results are joined on the key (already hash-partitioned by it).
Rows with a NULL key form no group, as in pandas ``groupby``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from behaviorkit.functions.stats import count_where, guarded, ratio, stats
from behaviorkit.operators.quantiles import keyed_quantiles

KEY = "phone_no_m"


# ---------------------------------------------------------------- helpers

def as_timestamp(df: DataFrame, name: str) -> Column:
    """A timestamp column, parsing text when the source holds strings."""
    dt = df.schema[name].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.col(name)
    if isinstance(dt, T.DateType):
        return F.col(name).cast("timestamp_ntz")
    return F.to_timestamp_ntz(F.col(name))


def with_time_parts(df: DataFrame, ts: str) -> DataFrame:
    """Hour of day and day of month of ``ts`` (new columns, input untouched)."""
    t = as_timestamp(df, ts)
    return df.withColumns({"hour": F.hour(t), "day": F.dayofmonth(t)})


def _keyed(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull())


# Default quantile strategy of the builders: exact and safe for hot keys.
QUANTILES = "ranked"
# Distinct counts: "exact" (Catalyst's Expand-based distinct aggregation) or "approx"
# (HyperLogLog++ sketches, fixed memory per key, relative error ~5%).
DISTINCT = "exact"


def nunique(c, distinct: str = DISTINCT) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.approx_count_distinct(c) if distinct == "approx" else F.count_distinct(c)


def _with_quantiles(agg: DataFrame, src: DataFrame, key: str, values: Mapping[str, str], q: float,
                    quantiles: str) -> DataFrame:
    """Attach ``{prefix}_median`` / ``{prefix}_quantile`` computed by ``keyed_quantiles``."""
    if quantiles != "ranked":
        return agg
    levels = {"median": 0.5} if q == 0.5 else {"median": 0.5, "quantile": q}
    qt = keyed_quantiles(src, [key], dict(values), levels)
    if q == 0.5:
        qt = qt.withColumns({f"{p}_quantile": F.col(f"{p}_median") for p in values})
    return agg.join(qt, key, "left")


def _with_distinct(agg: DataFrame, src: DataFrame, key: str, counts: Mapping[str, str]) -> DataFrame:
    """Attach exact distinct counts, each from the (key, value) pairs alone: beside other statistics in one aggregate every row
    would be expanded once per count, with the buffers of all statistics."""
    for name, c in counts.items():
        pairs = src.where(F.col(c).isNotNull()).select(key, c).distinct()
        agg = agg.join(pairs.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left")
    return agg.withColumns({n: F.coalesce(n, F.lit(0).cast("long")) for n in counts})


def value_profile(df: DataFrame, key: str, dims: Mapping[str, Column | str]) -> DataFrame:
    """A15, A16 + A2: per key and dim, the mode (smallest value on ties), its
    frequency, and the number of distinct non-null values.

    Output columns: ``key, {p}_mode, {p}_mode_count, {p}_nunique`` per prefix
    ``p`` in ``dims``.  Values are any whole numbers.
    Keys whose values are all NULL do not appear (callers left-join).
    """
    items = [F.struct(F.lit(p).alias("d"), (F.col(c) if isinstance(c, str) else c).cast("long").alias("v"))
             for p, c in dims.items()]
    hist = (df.select(F.col(key), F.explode(F.array(*items)).alias("it"))
              .select(key, "it.d", "it.v")
              .where(F.col("v").isNotNull())
              .groupBy(key, "d", "v").agg(F.count(F.lit(1)).alias("c")))
    # the histogram has one row per key, dim and value: its largest (count, -value) is the mode
    aggs, out = [], [key]
    for p in dims:
        sel = F.col("d") == p
        aggs += [F.max(F.when(sel, F.struct(F.col("c"), (-F.col("v")).alias("nv")))).alias(f"_m_{p}"),
                 F.count_if(sel).alias(f"{p}_nunique")]
        out += [(-F.col(f"_m_{p}.nv")).alias(f"{p}_mode"), F.col(f"_m_{p}.c").alias(f"{p}_mode_count"), F.col(f"{p}_nunique")]
    return hist.groupBy(key).agg(*aggs).select(*out)


def _profile_cols(prefixes) -> list[Column]:
    out = []
    for p in prefixes:
        out += [F.col(f"{p}_mode"), F.col(f"{p}_mode_count"),
                F.coalesce(F.col(f"{p}_nunique"), F.lit(0).cast("long")).alias(f"{p}_nunique")]
    return out


# ---------------------------------------------------------------- F1 usage

USAGE_COLUMNS = ["phone_no_m", "busi_count",
    "flow_mean", "flow_median", "flow_min", "flow_max", "flow_var", "flow_skew", "flow_std",
    "flow_quantile", "flow_sem", "flow_sum", "month_ids", "flow_month"]


def usage_features(app: DataFrame, key: str = KEY, busi: str = "busi_name", flow: str = "flow",
                   month: str = "month_id", q: float = 0.5, quantiles: str = QUANTILES,
                   distinct: str = DISTINCT) -> DataFrame:
    """data-usage features, 14 columns, one row per subscriber."""
    names = ("mean", "median", "min", "max", "var", "skew", "std", "quantile", "sem", "sum")
    base = _keyed(app, key)
    counts = {"busi_count": busi, "month_ids": month}
    extra = [nunique(c, distinct).alias(n) for n, c in counts.items()] if distinct == "approx" else []
    agg = base.groupBy(key).agg(*stats(flow, "flow", names, q, quantiles), *extra)
    if distinct != "approx":
        agg = _with_distinct(agg, base, key, counts)
    agg = _with_quantiles(agg, base, key, {"flow": flow}, q, quantiles)
    return agg.withColumn("flow_month", ratio("flow_sum", "month_ids")).select(*USAGE_COLUMNS)


# ---------------------------------------------------------------- F2 voice

PAIR_STATS = ("mean", "median", "max", "min", "var", "skew", "sem", "std", "quantile")


def voice_contact_counts(voc: DataFrame, key: str = KEY, opposite: str = "opposite_no_m") -> DataFrame:
    """A1, A2: number of calls with a known counterpart and distinct counterparts."""
    return _keyed(voc, key).groupBy(key).agg(
        F.count(opposite).alias("opposite_count"), F.count_distinct(opposite).alias("opposite_unique"))


def _outgoing_aggs(calltype: str, imei: str, city: str, county: str, outgoing: int,
                   distinct: str = DISTINCT) -> list[Column]:
    c1 = F.col(calltype) == outgoing
    return [
        guarded(c1, count_where(c1, imei)).alias("voccalltype1"),
        guarded(c1, nunique(F.when(c1, F.col(imei)), distinct)).alias("imeis"),
        guarded(c1, nunique(F.when(c1, F.col(city)), distinct)).alias("city_name_call"),
        guarded(c1, nunique(F.when(c1, F.col(county)), distinct)).alias("county_name_call"),
    ]


def voice_outgoing_features(voc: DataFrame, key: str = KEY, opposite: str = "opposite_no_m",
                            calltype: str = "calltype_id", imei: str = "imei_m", city: str = "city_name",
                            county: str = "county_name", outgoing: int = 1) -> DataFrame:
    """P4 + A13 + P5: statistics of outgoing calls only, NULL for subscribers without any."""
    agg = _keyed(voc, key).groupBy(key).agg(
        F.count(opposite).alias("opposite_count"), *_outgoing_aggs(calltype, imei, city, county, outgoing))
    return agg.select(key, "voccalltype1", "imeis",
                      ratio("voccalltype1", "opposite_count").alias("voc_calltype1"),
                      "city_name_call", "county_name_call")


def pair_table(voc: DataFrame, key: str = KEY, opposite: str = "opposite_no_m", dur: str = "call_dur") -> DataFrame:
    """First level of A14: per (subscriber, counterpart) non-null call count and duration sum."""
    return (voc.where(F.col(key).isNotNull() & F.col(opposite).isNotNull())
               .groupBy(key, opposite)
               .agg(F.count(dur).alias("count"), F.coalesce(F.sum(dur), F.lit(0.0)).alias("sum")))


def voice_pair_stats(voc: DataFrame, key: str = KEY, opposite: str = "opposite_no_m", dur: str = "call_dur",
                     q: float = 0.5, quantiles: str = QUANTILES, with_unique: bool = False) -> DataFrame:
    """Nine statistics of the per-counterpart call counts and duration sums."""
    extra = [F.count(F.lit(1)).alias("opposite_unique")] if with_unique else []
    pairs = pair_table(voc, key, opposite, dur)
    agg = pairs.groupBy(key).agg(
        *stats("count", "phone2opposite", PAIR_STATS, q, quantiles),
        *stats("sum", "phone2oppo_sum", PAIR_STATS, q, quantiles), *extra)
    agg = _with_quantiles(agg, pairs, key, {"phone2opposite": "count", "phone2oppo_sum": "sum"}, q, quantiles)
    cols = [key] + [f"{p}_{s}" for p in ("phone2opposite", "phone2oppo_sum") for s in PAIR_STATS]
    return agg.select(*cols, *(["opposite_unique"] if with_unique else []))


def voice_duration_stats(voc: DataFrame, key: str = KEY, dur: str = "call_dur",
                         q: float = 0.5, quantiles: str = QUANTILES) -> DataFrame:
    """A3-A11 over call durations."""
    base = _keyed(voc, key)
    agg = base.groupBy(key).agg(*stats(dur, "call_dur", PAIR_STATS, q, quantiles))
    agg = _with_quantiles(agg, base, key, {"call_dur": dur}, q, quantiles)
    return agg.select(key, *[f"call_dur_{s}" for s in PAIR_STATS])


def time_preference(df: DataFrame, ts: str, prefix: str, key: str = KEY) -> DataFrame:
    """P6-P8 + A15/A16: hour-of-day and day-of-month mode, mode count and distinct count.

    Output: ``key, {prefix}hour_mode, {prefix}hour_mode_count, {prefix}hour_nunique,
    {prefix}day_mode, {prefix}day_mode_count, {prefix}day_nunique``.
    """
    t = with_time_parts(_keyed(df, key), ts)
    return value_profile(t, key, {f"{prefix}hour": "hour", f"{prefix}day": "day"})


VOICE_COLUMNS = (
    ["phone_no_m", "opposite_count", "opposite_unique", "voccalltype1", "imeis", "voc_calltype1",
     "city_name_call", "county_name_call"]
    + [f"phone2opposite_{s}" for s in PAIR_STATS] + [f"phone2oppo_sum_{s}" for s in PAIR_STATS]
    + [f"call_dur_{s}" for s in PAIR_STATS]
    + ["city_name_nunique", "county_name_nunique", "calltype_id_unique",
       "voc_hour_mode", "voc_hour_mode_count", "voc_hour_nunique",
       "voc_day_mode", "voc_day_mode_count", "voc_day_nunique"])


def voice_features(voc: DataFrame, key: str = KEY, opposite: str = "opposite_no_m", calltype: str = "calltype_id",
                   dur: str = "call_dur", ts: str = "start_datetime", imei: str = "imei_m",
                   city: str = "city_name", county: str = "county_name", outgoing: int = 1,
                   q: float = 0.5, quantiles: str = QUANTILES, distinct: str = DISTINCT) -> DataFrame:
    """the 44 voice columns in one fused aggregate + pair statistics + time profile."""
    base = _keyed(voc, key)
    main = base.groupBy(key).agg(
        F.count(opposite).alias("opposite_count"),
        *_outgoing_aggs(calltype, imei, city, county, outgoing, distinct),
        *stats(dur, "call_dur", PAIR_STATS, q, quantiles),
        nunique(city, distinct).alias("city_name_nunique"),
        nunique(county, distinct).alias("county_name_nunique"),
        nunique(calltype, distinct).alias("calltype_id_unique"),
    )
    main = _with_quantiles(main, base, key, {"call_dur": dur}, q, quantiles)
    pairs = voice_pair_stats(base, key, opposite, dur, q, quantiles, with_unique=True)
    prof = time_preference(base, ts, "voc_", key)
    out = main.join(pairs, key, "left").join(prof, key, "left")
    return out.select(
        key, "opposite_count", F.coalesce("opposite_unique", F.lit(0).cast("long")).alias("opposite_unique"),
        "voccalltype1", "imeis", ratio("voccalltype1", "opposite_count").alias("voc_calltype1"),
        "city_name_call", "county_name_call",
        *[f"phone2opposite_{s}" for s in PAIR_STATS], *[f"phone2oppo_sum_{s}" for s in PAIR_STATS],
        *[f"call_dur_{s}" for s in PAIR_STATS],
        "city_name_nunique", "county_name_nunique", "calltype_id_unique",
        *_profile_cols(["voc_hour", "voc_day"]))


# ---------------------------------------------------------------- F3 sms

SMS_COLUMNS = ["phone_no_m", "sms_count", "sms_nunique", "sms_rate", "calltype_2", "calltype_rate",
               "hour_mode", "hour_mode_count", "hour_nunique", "day_mode", "day_mode_count", "day_nunique"]


def sms_features(sms: DataFrame, key: str = KEY, opposite: str = "opposite_no_m", calltype: str = "calltype_id",
                 ts: str = "request_datetime", incoming: int = 2, distinct: str = DISTINCT) -> DataFrame:
    """12 SMS columns."""
    base = _keyed(sms, key)
    c2 = F.col(calltype) == incoming
    main = base.groupBy(key).agg(
        F.count(opposite).alias("sms_count"), nunique(opposite, distinct).alias("sms_nunique"),
        guarded(c2, count_where(c2, calltype)).alias("calltype_2"))
    prof = time_preference(base, ts, "", key)
    out = main.join(prof, key, "left")
    return out.select(
        key, "sms_count", "sms_nunique", ratio("sms_count", "sms_nunique").alias("sms_rate"),
        "calltype_2", ratio("calltype_2", "sms_count").alias("calltype_rate"),
        *_profile_cols(["hour", "day"]))
