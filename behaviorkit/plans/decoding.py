"""Registered queries: probability decoding, metrics, blending and the submission balance."""

from __future__ import annotations

from pyspark.sql import functions as F

from behaviorkit.operators import decode as dec
from behaviorkit.operators import metrics as mt
from behaviorkit.operators.blend import WEIGHTS, blend_submission
from behaviorkit.operators.prep import one_hot
from behaviorkit.operators.tokens import assign_batches
from behaviorkit.plans.registry import query, report
from behaviorkit.plans.sqlgen import with_views
from behaviorkit.sources import views

TIE_BUCKETS = 20   # scores quantised to 1/20 for the tie-concatenating decoder


def _codes():
    return dec.domain_codes(F.col("task"), views.TASK_DOMAINS)


def _argmax(spark, sf_dir):
    p = views.probs(spark, sf_dir)
    code = dec.argmax_code(F.col("p"), _codes())
    return p.withColumn("pred_code", code).withColumn("pred_label", dec.class_name(F.col("pred_code")))


ARGMAX_CTE = """
cand as (select p.vec_id, p.task, p.label, d.code, p.p[d.code + 1] as prob
         from probs p join domains d on p.task = d.task),
best as (select * from (
  select *, row_number() over (partition by vec_id order by prob desc, code asc) as rn from cand) where rn = 1)"""


@query("task_argmax", with_views(f"""with {ARGMAX_CTE}
select vec_id, task, cast(code as integer) as pred_code, 'L' || code as pred_label from best""", "probs", "domains"))
def q_task_argmax(spark, sf_dir):
    return _argmax(spark, sf_dir).select("vec_id", "task", "pred_code", "pred_label")


@query("task_argmax_ties_concat", with_views(f"""with {ARGMAX_CTE},
scored as (select *, floor(prob * {TIE_BUCKETS}) as s from cand),
marked as (select *, max(s) over (partition by vec_id) as mx from scored)
select vec_id, task, coalesce(string_agg(case when s = mx then 'L' || code end, '' order by code), '') as pred_label
from marked group by vec_id, task""", "probs", "domains"))
def q_task_argmax_ties_concat(spark, sf_dir):
    p = views.probs(spark, sf_dir)
    score = F.transform("p", lambda x: F.floor(x * TIE_BUCKETS))
    return p.select("vec_id", "task", dec.argmax_concat(score, _codes()).alias("pred_label"))


@query("probability_long", with_views("""
select vec_id, cast(unnest(range(0, 10)) as integer) as code, 'L' || unnest(range(0, 10)) as label, unnest(p) as prob
from probs""", "probs"))
def q_probability_long(spark, sf_dir):
    return dec.probability_long(views.probs(spark, sf_dir), ["vec_id"])


@query("probability_wide", with_views(
    "select vec_id, " + ", ".join(f"p[{i + 1}] as L{i}" for i in range(10)) + " from probs", "probs"))
def q_probability_wide(spark, sf_dir):
    return dec.probability_wide(views.probs(spark, sf_dir), ["vec_id"], views.N_CLASSES)


@query("task_submission", with_views(f"""with {ARGMAX_CTE}
select task, cast(vec_id as varchar) as id, 'L' || code as label from best""", "probs", "domains"))
def q_task_submission(spark, sf_dir):
    a = _argmax(spark, sf_dir)
    return a.select("task", F.col("vec_id").cast("string").alias("id"), F.col("pred_label").alias("label"))


@query("macro_f1", with_views(f"""with {ARGMAX_CTE},
pairs as (select task, label, code as pred, count(*) as n from best group by task, label, code),
per as (
  select task, cls, sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from (
    select task, label as cls, case when label = pred then n else 0 end as tp, 0 as fp,
           case when label <> pred then n else 0 end as fn from pairs
    union all
    select task, pred as cls, 0, n, 0 from pairs where label <> pred) group by task, cls)
select task, cast(avg(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0)) as float) as macro_f1,
       count(*) as n_classes
from per group by task""", "probs", "domains"))
def q_macro_f1(spark, sf_dir):
    a = _argmax(spark, sf_dir)
    return report(mt.macro_f1(a, "label", "pred_code", by=["task"]))


@query("binary_prf", with_views("""
with j as (select u.label, case when m.p_a > 0.5 then 1 else 0 end as pred
           from users u join model_scores m on u.phone_no_m = m.phone_no_m),
c as (select sum(case when label = 1 and pred = 1 then 1 else 0 end) as tp,
             sum(case when pred = 1 then 1 else 0 end) as pp, sum(case when label = 1 then 1 else 0 end) as ap from j)
select cast(coalesce(cast(tp as double) / nullif(pp, 0), 0) as float) as precision,
       cast(coalesce(cast(tp as double) / nullif(ap, 0), 0) as float) as recall,
       cast(coalesce(cast(2 * tp as double) / nullif(pp + ap, 0), 0) as float) as f1 from c""",
    "users", "model_scores"))
def q_binary_prf(spark, sf_dir):
    u = views.users(spark, sf_dir).select("phone_no_m", "label")
    m = views.model_scores(spark, sf_dir)
    j = u.join(m, "phone_no_m").withColumn("pred", mt.binary_prediction(F.col("p_a")))
    return report(mt.binary_prf(j, "label", "pred"))


def _rsum_sql(arr: str) -> str:
    return f"list_sum(list_transform({arr}, lambda x: round_even(least(greatest(x, 0.0), 1.0), 0)))"


@query("batch_f1", with_views(f"""
with b as (select *, (row_number() over (order by vec_id) - 1) // 4 as batch,
                  list_transform(range(10), lambda i: case when i = label then 1.0 else 0.0 end) as y from probs),
s as (select batch,
        sum({_rsum_sql('list_transform(list_zip(y, p), lambda t: t[1] * t[2])')}) as tp,
        sum({_rsum_sql('y')}) as pos, sum({_rsum_sql('p')}) as pp from b group by batch),
r as (select batch, tp / (pp + 1e-7) as prec, tp / (pos + 1e-7) as rec from s)
select batch, cast(prec as float) as precision, cast(rec as float) as recall,
       cast(2 * (prec * rec) / (prec + rec + 1e-7) as float) as f1 from r""", "probs"))
def q_batch_f1(spark, sf_dir):
    p = views.probs(spark, sf_dir)
    b = assign_batches(p.select("vec_id", "p", one_hot(F.col("label"), views.N_CLASSES).alias("y")), ["vec_id"])
    return report(mt.batch_f1(b, "y", "p"))


@query("top2_accuracy", with_views("""
select cast(avg(case when len(list_filter(p, lambda x: x > p[label + 1])) < 2 then 1 else 0 end) as float) as top2_accuracy,
       cast(avg(case when list_position(p, list_max(p)) - 1 = label then 1 else 0 end) as float) as accuracy,
       count(distinct label) as n_classes
from probs""", "probs"))
def q_top2_accuracy(spark, sf_dir):
    p = views.probs(spark, sf_dir)
    out = p.agg(F.avg(mt.top_k_hit(F.col("p"), F.col("label"), 2)).alias("top2_accuracy"),
                F.avg((dec.argmax_all(F.col("p")) == F.col("label")).cast("int")).alias("accuracy"),
                F.count_distinct("label").alias("n_classes"))
    return report(out)


@query("accuracy", with_views(f"""with {ARGMAX_CTE}
select task, cast(avg(case when code = label then 1 else 0 end) as float) as accuracy, count(*) as n
from best group by task""", "probs", "domains"))
def q_accuracy(spark, sf_dir):
    a = _argmax(spark, sf_dir)
    return report(a.groupBy("task").agg(F.avg((F.col("pred_code") == F.col("label")).cast("int")).alias("accuracy"),
                                        F.count(F.lit(1)).alias("n")))


BLEND_SQL = """
blended as (
  select u.phone_no_m, 0.25 * m.p_b + 0.25 * m.p_c + 0.5 * m.p_a as score
  from users u join model_scores m on u.phone_no_m = m.phone_no_m where u.split = 'final'),
sub as (select phone_no_m, score,
          case when score > 0.6 then 1.0 when score < 0.6 then 0.0 else score end as label from blended)"""


def _submission(spark, sf_dir):
    u = views.users(spark, sf_dir).where(F.col("split") == "final").select("phone_no_m")
    m = views.model_scores(spark, sf_dir)
    return blend_submission(u.join(m, "phone_no_m"), "phone_no_m", WEIGHTS)


@query("blend_threshold", with_views(f"with {BLEND_SQL}\nselect phone_no_m, score, label from sub",
                                     "users", "model_scores"))
def q_blend_threshold(spark, sf_dir):
    return _submission(spark, sf_dir)


@query("prediction_balance", with_views(f"""with {BLEND_SQL}
select label, count(*) as n, cast(count(*) as double) / (select count(*) from sub) as share
from sub where label is not null group by label""", "users", "model_scores"))
def q_prediction_balance(spark, sf_dir):
    return mt.value_shares(_submission(spark, sf_dir), "label")
