"""Registered queries: per-subscriber CDR features."""

from __future__ import annotations

from pyspark.sql import functions as F

from behaviorkit.operators import features as feat
from behaviorkit.operators.dedup import key_spine, last_per_key
from behaviorkit.plans.registry import query, report
from behaviorkit.plans.sqlgen import ratio_sql, stat_sql, with_views
from behaviorkit.sources import views
from behaviorkit.sources.tables import table

NINE = feat.PAIR_STATS
USAGE_STATS = ("mean", "median", "min", "max", "var", "skew", "std", "quantile", "sem", "sum")


_AS_FLOAT = [True]   # report form (FLOAT) unless a builder switches it off


def _f(expr: str, name: str) -> str:
    return f"cast({expr} as float) as {name}" if _AS_FLOAT[0] else f"{expr} as {name}"


def _stats_f(x: str, prefix: str, names, integral: bool = False) -> str:
    """Statistics as FLOAT; min / max of an integral input keep the input type."""
    return ",\n  ".join(
        f"{stat_sql(x, n)} as {prefix}_{n}" if integral and n in ("min", "max") else _f(stat_sql(x, n), f"{prefix}_{n}")
        for n in names)


# ------------------------------------------------------------------ F1

def usage_sql_body() -> str:
    return f"""
select phone_no_m,
  count(distinct busi_name) as busi_count,
  {_stats_f('flow', 'flow', USAGE_STATS)},
  count(distinct month_id) as month_ids,
  {_f(ratio_sql('coalesce(sum(flow), 0)', 'count(distinct month_id)'), 'flow_month')}
from app where phone_no_m is not null
group by phone_no_m"""


@query("usage_features", with_views(usage_sql_body(), "app"))
def q_usage_features(spark, sf_dir):
    return report(feat.usage_features(views.app(spark, sf_dir)))


# ------------------------------------------------------------------ F2 parts

@query("voice_contact_counts", with_views("""
select phone_no_m, count(opposite_no_m) as opposite_count, count(distinct opposite_no_m) as opposite_unique
from voc where phone_no_m is not null group by phone_no_m""", "voc"))
def q_voice_contact_counts(spark, sf_dir):
    return feat.voice_contact_counts(views.voc(spark, sf_dir))


def _outgoing_cte() -> str:
    return """
outgoing as (
  select phone_no_m, count(imei_m) as voccalltype1, count(distinct imei_m) as imeis,
         count(distinct city_name) as city_name_call, count(distinct county_name) as county_name_call
  from voc where phone_no_m is not null and calltype_id = 1 group by phone_no_m),
spine as (select phone_no_m, count(opposite_no_m) as opposite_count from voc
          where phone_no_m is not null group by phone_no_m)"""


@query("voice_outgoing_features", with_views(f"""
with {_outgoing_cte()}
select s.phone_no_m, o.voccalltype1, o.imeis,
       {_f(ratio_sql('o.voccalltype1', 's.opposite_count'), 'voc_calltype1')},
       o.city_name_call, o.county_name_call
from spine s left join outgoing o on s.phone_no_m = o.phone_no_m""", "voc"))
def q_voice_outgoing_features(spark, sf_dir):
    return report(feat.voice_outgoing_features(views.voc(spark, sf_dir)))


def _pairs_cte() -> str:
    return f"""
pairs as (
  select phone_no_m, opposite_no_m, count(call_dur) as cnt, coalesce(sum(call_dur), 0) as sm
  from voc where phone_no_m is not null and opposite_no_m is not null
  group by phone_no_m, opposite_no_m),
pstats as (
  select phone_no_m, count(*) as opposite_unique,
  {_stats_f('cnt', 'phone2opposite', NINE, integral=True)},
  {_stats_f('sm', 'phone2oppo_sum', NINE)}
  from pairs group by phone_no_m)"""


@query("voice_pair_stats", with_views(f"""
with {_pairs_cte()}
select * exclude (opposite_unique) from pstats""", "voc"))
def q_voice_pair_stats(spark, sf_dir):
    return report(feat.voice_pair_stats(views.voc(spark, sf_dir)))


@query("voice_duration_stats", with_views(f"""
select phone_no_m, {_stats_f('call_dur', 'call_dur', NINE)}
from voc where phone_no_m is not null group by phone_no_m""", "voc"))
def q_voice_duration_stats(spark, sf_dir):
    return report(feat.voice_duration_stats(views.voc(spark, sf_dir)))


def _profile_cte(src: str, ts: str, prefix: str) -> str:
    return f"""
hist as (
  select phone_no_m, 'hour' as d, hour({ts}) as v, count(*) as c from {src}
  where phone_no_m is not null group by phone_no_m, hour({ts})
  union all
  select phone_no_m, 'day' as d, day({ts}) as v, count(*) as c from {src}
  where phone_no_m is not null group by phone_no_m, day({ts})),
ranked as (
  select *, row_number() over (partition by phone_no_m, d order by c desc, v asc) as rn,
         count(*) over (partition by phone_no_m, d) as nu
  from hist),
prof as (
  select phone_no_m,
    max(case when d = 'hour' and rn = 1 then v end) as {prefix}hour_mode,
    max(case when d = 'hour' and rn = 1 then c end) as {prefix}hour_mode_count,
    coalesce(max(case when d = 'hour' then nu end), 0) as {prefix}hour_nunique,
    max(case when d = 'day' and rn = 1 then v end) as {prefix}day_mode,
    max(case when d = 'day' and rn = 1 then c end) as {prefix}day_mode_count,
    coalesce(max(case when d = 'day' then nu end), 0) as {prefix}day_nunique
  from ranked group by phone_no_m)"""


@query("voice_hour_preference", with_views(f"""
with {_profile_cte('voc', 'start_datetime', 'voc_')}
select phone_no_m, voc_hour_mode, voc_hour_mode_count, voc_hour_nunique from prof""", "voc"))
def q_voice_hour_preference(spark, sf_dir):
    p = feat.time_preference(views.voc(spark, sf_dir), "start_datetime", "voc_")
    return p.select("phone_no_m", "voc_hour_mode", "voc_hour_mode_count", "voc_hour_nunique")


@query("voice_day_preference", with_views(f"""
with {_profile_cte('voc', 'start_datetime', 'voc_')}
select phone_no_m, voc_day_mode, voc_day_mode_count, voc_day_nunique from prof""", "voc"))
def q_voice_day_preference(spark, sf_dir):
    p = feat.time_preference(views.voc(spark, sf_dir), "start_datetime", "voc_")
    return p.select("phone_no_m", "voc_day_mode", "voc_day_mode_count", "voc_day_nunique")


def voice_sql_body() -> str:
    return f"""
with {_outgoing_cte()},
{_pairs_cte()},
{_profile_cte('voc', 'start_datetime', 'voc_')},
main as (
  select phone_no_m,
  {_stats_f('call_dur', 'call_dur', NINE)},
  count(distinct city_name) as city_name_nunique,
  count(distinct county_name) as county_name_nunique,
  count(distinct calltype_id) as calltype_id_unique
  from voc where phone_no_m is not null group by phone_no_m)
select s.phone_no_m, s.opposite_count, coalesce(p.opposite_unique, 0) as opposite_unique,
  o.voccalltype1, o.imeis, {_f(ratio_sql('o.voccalltype1', 's.opposite_count'), 'voc_calltype1')},
  o.city_name_call, o.county_name_call,
  {', '.join(f'p.phone2opposite_{n}' for n in NINE)},
  {', '.join(f'p.phone2oppo_sum_{n}' for n in NINE)},
  {', '.join(f'm.call_dur_{n}' for n in NINE)},
  m.city_name_nunique, m.county_name_nunique, m.calltype_id_unique,
  f.voc_hour_mode, f.voc_hour_mode_count, coalesce(f.voc_hour_nunique, 0) as voc_hour_nunique,
  f.voc_day_mode, f.voc_day_mode_count, coalesce(f.voc_day_nunique, 0) as voc_day_nunique
from spine s
left join outgoing o on s.phone_no_m = o.phone_no_m
left join pstats p on s.phone_no_m = p.phone_no_m
left join main m on s.phone_no_m = m.phone_no_m
left join prof f on s.phone_no_m = f.phone_no_m"""


@query("voice_features", with_views(voice_sql_body(), "voc"))
def q_voice_features(spark, sf_dir):
    return report(feat.voice_features(views.voc(spark, sf_dir)))


# ------------------------------------------------------------------ F3

def sms_sql_body() -> str:
    return f"""
with {_profile_cte('sms', 'request_datetime', '')},
main as (
  select phone_no_m, count(opposite_no_m) as sms_count, count(distinct opposite_no_m) as sms_nunique
  from sms where phone_no_m is not null group by phone_no_m),
c2 as (
  select phone_no_m, count(calltype_id) as calltype_2 from sms
  where phone_no_m is not null and calltype_id = 2 group by phone_no_m)
select m.phone_no_m, m.sms_count, m.sms_nunique,
  {_f(ratio_sql('m.sms_count', 'm.sms_nunique'), 'sms_rate')},
  c2.calltype_2, {_f(ratio_sql('c2.calltype_2', 'm.sms_count'), 'calltype_rate')},
  f.hour_mode, f.hour_mode_count, coalesce(f.hour_nunique, 0) as hour_nunique,
  f.day_mode, f.day_mode_count, coalesce(f.day_nunique, 0) as day_nunique
from main m left join c2 on m.phone_no_m = c2.phone_no_m
left join prof f on m.phone_no_m = f.phone_no_m"""


@query("sms_features", with_views(sms_sql_body(), "sms"))
def q_sms_features(spark, sf_dir):
    return report(feat.sms_features(views.sms(spark, sf_dir)))


# ------------------------------------------------------------------ D1, D2

@query("user_spine", with_views("select distinct phone_no_m from voc where phone_no_m is not null", "voc"))
def q_user_spine(spark, sf_dir):
    return key_spine(views.voc(spark, sf_dir), "phone_no_m")


@query("last_event_per_user", """
select user_id, event_id, ts, event_type, value from (
  select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events)
where rn = 1""")
def q_last_event_per_user(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return last_per_key(ev, "user_id", ["ts", "event_id"], ["event_id", "ts", "event_type", "value"])


def feature_sql(as_float: bool) -> tuple[str, str, str]:
    """(usage, voice, sms) SQL bodies, statistics as FLOAT or left as DOUBLE."""
    _AS_FLOAT[0] = as_float
    try:
        return usage_sql_body(), voice_sql_body(), sms_sql_body()
    finally:
        _AS_FLOAT[0] = True
