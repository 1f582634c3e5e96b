"""DuckDB SQL for the input views and the statistic fragments used by the oracle.

The oracle is an independent formulation: it uses DuckDB's own aggregates
(``quantile_cont``, ``skewness``, window ranking) rather than the Spark code
paths, with explicit CASE guards for the pandas null / small-n rules.
"""

from __future__ import annotations

VIEWS = {
    "voc": """
select user_id as phone_no_m,
       cast(regexp_extract(props,'([0-9]+)',1) as int) as opposite_no_m,
       case event_type when 'click' then 1 when 'view' then 2 when 'purchase' then 3 end as calltype_id,
       nullif(value, 0.01) as call_dur, ts as start_datetime,
       cast(regexp_extract(props,'([0-9]+)',1) as int) % 3 as imei_m,
       nullif(cast(regexp_extract(props,'([0-9]+)',1) as int) % 7, 0) as city_name,
       nullif(cast(regexp_extract(props,'([0-9]+)',1) as int) % 11, 0) as county_name
from events where event_type in ('click','view','purchase')""",
    "sms": """
select user_id as phone_no_m,
       nullif(cast(regexp_extract(props,'([0-9]+)',1) as int), 0) as opposite_no_m,
       case event_type when 'signup' then 1 else 2 end as calltype_id, ts as request_datetime
from events where event_type in ('signup','error')""",
    "app": """
select l_suppkey as phone_no_m, nullif(l_partkey % 50, 0) as busi_name, l_extendedprice as flow,
       strftime(l_shipdate,'%Y%m') as month_id from lineitem""",
    "users": """
select c_custkey as phone_no_m, nullif(c_mktsegment,'FURNITURE') as city_name,
       n_name as county_name,
       case when c_custkey % 13 = 0 then concat(chr(92),'N') else cast(c_acctbal as varchar) end as arpu_202005,
       case when c_custkey % 3 = 0 then 1 else 0 end as label,
       case when c_custkey % 10 < 6 then 'train' when c_custkey % 10 < 8 then 'april' else 'final' end as split
from customer join nation on c_nationkey = n_nationkey""",
    "labels_u": """
select c_custkey as phone_no_m, case when c_custkey % 3 = 0 then 1 else 0 end as label,
       c_custkey % 2 as half from customer where c_custkey % 10 in (6, 7)""",
    "tnews": "select cast(doc_id as varchar) as id, text as content, lang as label from documents",
    "ocemotion": """
select cast(d.doc_id as varchar) as id, d.text as content,
       case when l.toxic = 1 then 'toxic' when l.quality = 1 then 'good' else 'bad' end as label
from documents d join labels l on d.doc_id = l.doc_id""",
    "ocnli": """
select concat(cast(a.conv_id as varchar), '-', cast(a.turn as varchar)) as id,
       a.text as content1, b.text as content2, b.role as label
from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1""",
    "probw": """
select vec_id, label, vec_id % 3 as task,
       list_transform(range(10), lambda c: cast(1 + list_sum(list_transform(
         list_filter(range(len(embedding)), lambda i: i % 10 = c),
         lambda i: cast(floor(abs(cast(embedding[i + 1] as double))*10000) as bigint))) as bigint)) as w
from embeddings""",
    "probs": """
select vec_id, label, task,
       list_transform(w, lambda x: cast(x as double) / cast(list_sum(w) as double)) as p
from probw""",
    "model_scores": """
select c_custkey as phone_no_m,
       cast(c_custkey * 37 % 1000 as double) / 1000 as p_a,
       cast(c_custkey * 91 % 1000 as double) / 1000 as p_b,
       cast(c_custkey * 53 % 1000 as double) / 1000 as p_c
from customer""",
    "domains": """
select * from (values (0,0,'L0'),(0,1,'L1'),(0,2,'L2'),(0,3,'L3'),(0,4,'L4'),
                      (1,5,'L5'),(1,6,'L6'),(1,7,'L7'),(2,8,'L8'),(2,9,'L9')) t(task, code, label_name)""",
}

# views a view depends on
_DEPS = {"probs": ["probw"]}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with CTEs for the named views (dependencies first)."""
    order: list[str] = []

    def add(n):
        for d in _DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ",\n".join(f"{n} as ({VIEWS[n]})" for n in order)
    body = body.strip()
    if body.lower().startswith("with "):
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"


def stat_sql(x: str, name: str, q: float = 0.5) -> str:
    if name == "mean":
        return f"avg({x})"
    if name in ("median",):
        return f"quantile_cont({x}, 0.5)"
    if name == "quantile":
        return f"quantile_cont({x}, {q})"
    if name == "max":
        return f"max({x})"
    if name == "min":
        return f"min({x})"
    if name == "var":
        return f"var_samp({x})"
    if name == "std":
        return f"stddev_samp({x})"
    if name == "skew":
        return (f"case when count({x}) < 3 then null when var_pop({x}) = 0 then 0.0 "
                f"else skewness({x}) end")
    if name == "sem":
        return f"stddev_samp({x}) / sqrt(count({x}))"
    if name == "sum":
        return f"coalesce(sum({x}), 0)"
    raise ValueError(name)


def ratio_sql(a: str, b: str) -> str:
    return f"case when {b} is null or {b} = 0 then null else cast({a} as double) / cast({b} as double) end"
