"""Registered queries: modelling-table assembly, joins, unions, encoding, imputation."""

from __future__ import annotations

from pyspark.sql import functions as F

from behaviorkit.operators import features as feat
from behaviorkit.operators.assemble import (assemble_users, drop_checked, null_safe_left_join, rename,
                                            union_all)
from behaviorkit.operators.models import stored
from behaviorkit.operators.prep import (column_quantiles, label_dictionary, label_decode, label_encode,
                                        quantile_impute, sentinel_to_null, to_float)
from behaviorkit.plans.cdr import feature_sql
from behaviorkit.plans.registry import query, report
from behaviorkit.plans.sqlgen import with_views
from behaviorkit.sources import views

KEY = "phone_no_m"
FEATURES = feat.USAGE_COLUMNS[1:] + feat.VOICE_COLUMNS[1:] + feat.SMS_COLUMNS[1:]
IMPUTE_COLUMNS = ["city_name", "county_name", "arpu_202005"] + FEATURES
QUANTILE_LEVELS = (0.39, 0.34, 0.319)   # fixed values: one fill level per model
SENT = "chr(92) || 'N'"


def _assembled(spark, sf_dir, scope=()):
    return assemble_users(views.users(spark, sf_dir), views.app(spark, sf_dir), views.voc(spark, sf_dir),
                          views.sms(spark, sf_dir), views.labels_u(spark, sf_dir), encode_scope=scope)


def assembled_sql_body(as_float: bool = True, scope: str = "") -> str:
    usage, voice, sms = feature_sql(as_float)
    part = f"partition by {scope} " if scope else ""
    return f"""
with usage_f as ({usage}),
voice_f as ({voice}),
sms_f as ({sms}),
u0 as (
  select phone_no_m, city_name, county_name, arpu_202005, label, split from users where split = 'train'
  union all
  select u.phone_no_m, u.city_name, u.county_name, u.arpu_202005, l.label, u.split
  from users u left join labels_u l on u.phone_no_m = l.phone_no_m where u.split = 'april'
  union all
  select phone_no_m, city_name, county_name, arpu_202005, null as label, split from users where split = 'final'),
u1 as (
  select phone_no_m, split,
    cast(dense_rank() over ({part}order by coalesce(cast(city_name as varchar), 'nan')) - 1 as integer) as city_name,
    cast(dense_rank() over ({part}order by coalesce(cast(county_name as varchar), 'nan')) - 1 as integer) as county_name,
    try_cast(nullif(arpu_202005, {SENT}) as float) as arpu_202005,
    cast(label as integer) as label
  from u0),
assembled as (
  select u1.*, a.* exclude (phone_no_m), v.* exclude (phone_no_m), s.* exclude (phone_no_m)
  from u1 left join usage_f a on u1.phone_no_m = a.phone_no_m
  left join voice_f v on u1.phone_no_m = v.phone_no_m
  left join sms_f s on u1.phone_no_m = s.phone_no_m)"""


_ASM_VIEWS = ("users", "labels_u", "app", "voc", "sms")


@query("assembled_users", with_views(assembled_sql_body() + "\nselect * from assembled", *_ASM_VIEWS))
def q_assembled_users(spark, sf_dir):
    return report(_assembled(spark, sf_dir))


@query("null_safe_join", with_views("""
select u.phone_no_m, u.city_name, c.city_users
from users u left join (select city_name, count(*) as city_users from users group by city_name) c
  on u.city_name is not distinct from c.city_name""", "users"))
def q_null_safe_join(spark, sf_dir):
    u = views.users(spark, sf_dir)
    counts = u.groupBy("city_name").agg(F.count(F.lit(1)).alias("city_users"))
    return null_safe_left_join(u.select(KEY, "city_name"), counts, ["city_name"])


@query("label_union", with_views("""
select phone_no_m, label from labels_u where half = 0
union all
select phone_no_m, label from labels_u where half = 1""", "labels_u"))
def q_label_union(spark, sf_dir):
    lab = views.labels_u(spark, sf_dir)
    return union_all([lab.where(F.col("half") == 0).select(KEY, "label"),
                      lab.where(F.col("half") == 1).select(KEY, "label")])


@query("union_missing_columns", with_views("""
select phone_no_m, city_name, county_name, arpu_202005, label from users where split = 'april'
union all
select phone_no_m, city_name, county_name, arpu_202005, null as label from users where split = 'final'
""", "users"))
def q_union_missing_columns(spark, sf_dir):
    u = views.users(spark, sf_dir)
    # the April source names its revenue column by its own month
    april = u.where(F.col("split") == "april").withColumnRenamed("arpu_202005", "arpu_202004")
    april = rename(drop_checked(april, ["split"]), {"arpu_202004": "arpu_202005"})
    final = drop_checked(u.where(F.col("split") == "final"), ["label", "split"])
    return union_all([april, final], allow_missing=True)


@query("sentinel_to_null_float", with_views(f"""
select phone_no_m, try_cast(nullif(arpu_202005, {SENT}) as float) as arpu_202005 from users""", "users"))
def q_sentinel_to_null_float(spark, sf_dir):
    u = sentinel_to_null(views.users(spark, sf_dir).select(KEY, "arpu_202005"))
    return u.select(KEY, to_float(F.col("arpu_202005")).alias("arpu_202005"))


@query("label_encode", with_views("""
select phone_no_m,
  cast(dense_rank() over (order by coalesce(city_name, 'nan')) - 1 as integer) as city_name,
  cast(dense_rank() over (order by coalesce(county_name, 'nan')) - 1 as integer) as county_name
from users""", "users"))
def q_label_encode(spark, sf_dir):
    return label_encode(views.users(spark, sf_dir).select(KEY, "city_name", "county_name"),
                        ["city_name", "county_name"])


@query("label_decode", with_views("""
select phone_no_m, coalesce(city_name, 'nan') as city_name from users""", "users"))
def q_label_decode(spark, sf_dir):
    u = views.users(spark, sf_dir).select(KEY, "city_name")
    d = label_dictionary(u, "city_name")
    enc = label_encode(u, ["city_name"], suffix="_code").select(KEY, "city_name_code")
    return label_decode(enc, "city_name_code", d, "city_name").select(KEY, "city_name")


@query("label_encode_per_table", with_views("""
select phone_no_m, split,
  cast(dense_rank() over (partition by split order by coalesce(city_name, 'nan')) - 1 as integer) as city_name,
  cast(dense_rank() over (partition by split order by coalesce(county_name, 'nan')) - 1 as integer) as county_name
from users""", "users"))
def q_label_encode_per_table(spark, sf_dir):
    return label_encode(views.users(spark, sf_dir).select(KEY, "split", "city_name", "county_name"),
                        ["city_name", "county_name"], scope=["split"])


def _final_numeric_sql() -> str:
    cols = ", ".join(f"cast({c} as double) as {c}" for c in IMPUTE_COLUMNS)
    return f"final_num as (select phone_no_m, {cols} from assembled where split = 'final')"


def _column_quantiles_sql() -> str:
    body = assembled_sql_body(as_float=False)
    cols = ", ".join(IMPUTE_COLUMNS)
    sel = "\nunion all\n".join(
        f"select name as \"column\", cast({q} as double) as q, cast(quantile_cont(x, {q}) as float) as value from long group by name"
        for q in QUANTILE_LEVELS)
    return with_views(f"""{body},
{_final_numeric_sql()},
long as (select name, x from (unpivot final_num on {cols} into name name value x) where x is not null and not isnan(x))
{sel}""", *_ASM_VIEWS)


@query("column_quantiles", _column_quantiles_sql())
def q_column_quantiles(spark, sf_dir):
    # one narrow row per user, written once: the quantiles read it more than once
    final = stored(_assembled(spark, sf_dir).where(F.col("split") == "final").select(*IMPUTE_COLUMNS), "final-users")
    out = column_quantiles(final, IMPUTE_COLUMNS, QUANTILE_LEVELS)
    return out.select("column", "q", F.col("value").cast("float").alias("value"))


def _quantile_impute_sql(q: float) -> str:
    body = assembled_sql_body(as_float=False)
    qcols = ", ".join(f"quantile_cont({c}, {q}) as {c}" for c in IMPUTE_COLUMNS)
    fills = ", ".join(f"cast(coalesce(f.{c}, qv.{c}) as float) as {c}" for c in IMPUTE_COLUMNS)
    num = ", ".join(f"cast({c} as double) as {c}" for c in IMPUTE_COLUMNS)
    return with_views(f"""{body},
f as (select phone_no_m, {num} from assembled where split = 'final'),
qv as (select {qcols} from f)
select f.phone_no_m, {fills} from f cross join qv""", *_ASM_VIEWS)


@query("quantile_impute", _quantile_impute_sql(QUANTILE_LEVELS[0]))
def q_quantile_impute(spark, sf_dir):
    final = stored(_assembled(spark, sf_dir).where(F.col("split") == "final").select(KEY, *IMPUTE_COLUMNS), "final-users")
    filled = quantile_impute(final, IMPUTE_COLUMNS, QUANTILE_LEVELS[0])
    return report(filled.select(KEY, *[F.col(c).cast("double").alias(c) if c != "arpu_202005" else F.col(c)
                                       for c in IMPUTE_COLUMNS]))
