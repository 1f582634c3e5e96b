"""Registered queries: text corpus, vocabulary, tokens, batches, folds, one-hot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from behaviorkit.operators import epochs as ep
from behaviorkit.operators import tokens as tk
from behaviorkit.operators.corpus import PAIR_PREFIX, build_corpus
from behaviorkit.operators.decode import argmax_code, learned_domains
from behaviorkit.operators.prep import label_decode, label_dictionary, label_encode, one_hot, stratified_folds, \
    train_validation_split
from behaviorkit.operators.slices import head, read_slice, tail, write_ordered
from behaviorkit.plans.registry import query
from behaviorkit.plans.sqlgen import with_views
from behaviorkit.sources import views
from behaviorkit.session import scratch_path
from behaviorkit.sources.tables import table

TASK_ORDER = ("tnews", "ocemotion", "ocnli")   # order the task tables are concatenated in
N_FOLDS, FOLD_SEED = 10, 222                   # fixed values of the stratified split


def corpus(spark, sf_dir, labelled=True):
    return build_corpus({"tnews": views.tnews(spark, sf_dir), "ocemotion": views.ocemotion(spark, sf_dir),
                         "ocnli": views.ocnli(spark, sf_dir)}, labelled=labelled)


def _task_rank():
    return F.when(F.col("task") == "tnews", 0).when(F.col("task") == "ocemotion", 1).otherwise(2)


CORPUS_CTE = r"""
corpus as (
  select 'tnews' as task, coalesce(id, 'nan') as id, coalesce(content, 'nan') as content,
         coalesce(label, 'nan') as label from tnews
  union all
  select 'ocemotion', coalesce(id, 'nan'), coalesce(content, 'nan'), coalesce(label, 'nan') from ocemotion
  union all
  select 'ocnli', coalesce(id, 'nan'),
         concat(coalesce(content1, 'nan'), coalesce(content2, 'nan')), coalesce(label, 'nan')
  from ocnli),
task_rank as (select * from (values ('tnews', 0), ('ocemotion', 1), ('ocnli', 2)) t(task, task_rank))"""

VOCAB_CTE = r"""
chars as (select unnest(regexp_extract_all(content, '(?s).')) as token from corpus),
counts as (select token, count(*) as n from chars
           where not regexp_matches(token, '^[ \n\r\t\p{Zs}]$') group by token),
vocab as (
  select token, cast(row_number() over (order by n desc, token) - 1 + 5 as integer) as token_id, n from counts
  union all
  select * from (values ('[PAD]', 0, null), ('[unused1]', 1, null), ('[UNK]', 2, null),
                        ('[CLS]', 3, null), ('[SEP]', 4, null)) s(token, token_id, n))"""

TOKENS_CTE = r"""
exploded as (
  select task, id, unnest(cs) as ch, unnest(range(1, len(cs) + 1)) as pos
  from (select task, id, regexp_extract_all(content, '(?s).') as cs from corpus)),
tok as (
  select e.task, e.id,
         list(coalesce(v.token_id, case when regexp_matches(e.ch, '^[ \n\r\t\p{Zs}]$') then 1 else 2 end)
              order by e.pos) as toks
  from exploded e left join vocab v on e.ch = v.token
  group by e.task, e.id),
tokens as (
  select c.task, c.id, coalesce(t.toks, []::integer[]) as toks
  from corpus c left join tok t on c.task = t.task and c.id = t.id),
encoded as (
  select task, id, cast(w as integer) as window_no, list_concat([3], toks[256 * w + 1:256 * w + 256], [4]) as x1
  from (select *, unnest(range(greatest(1, cast(ceil(len(toks) / 256.0) as bigint)))) as w from tokens))"""

_TEXT_VIEWS = ("tnews", "ocemotion", "ocnli")


def _tokens(spark, sf_dir):
    c = corpus(spark, sf_dir)
    return c, tk.char_tokens(c, tk.char_vocabulary(c))


def _encoded(spark, sf_dir):
    """Every window of every whole text."""
    _, t = _tokens(spark, sf_dir)
    return tk.encode_windows(t).withColumnRenamed("window", "window_no")


@query("corpus_union", with_views(f"with {CORPUS_CTE}\nselect task, id, content, label from corpus", *_TEXT_VIEWS))
def q_corpus_union(spark, sf_dir):
    return corpus(spark, sf_dir)


@query("char_vocabulary", with_views(f"with {CORPUS_CTE},\n{VOCAB_CTE}\nselect token, token_id, n from vocab",
                                     *_TEXT_VIEWS))
def q_char_vocabulary(spark, sf_dir):
    return tk.char_vocabulary(corpus(spark, sf_dir))


@query("char_tokens", with_views(f"""with {CORPUS_CTE},\n{VOCAB_CTE},\n{TOKENS_CTE}
select task, id, array_to_string(toks, ',') as tokens, len(toks) as n_tokens from tokens""", *_TEXT_VIEWS))
def q_char_tokens(spark, sf_dir):
    _, t = _tokens(spark, sf_dir)
    return t.select("task", "id", tk.int_array_text(F.col("tokens")).alias("tokens"),
                    F.size("tokens").cast("long").alias("n_tokens"))


@query("encoded_sequences", with_views(f"""with {CORPUS_CTE},\n{VOCAB_CTE},\n{TOKENS_CTE}
select task, id, window_no, array_to_string(x1, ',') as x1,
       array_to_string(list_transform(x1, lambda x: 0), ',') as x2, len(x1) as n_ids from encoded""",
                                       *_TEXT_VIEWS))
def q_encoded_sequences(spark, sf_dir):
    e = _encoded(spark, sf_dir)
    return e.select("task", "id", "window_no", tk.int_array_text(F.col("x1")).alias("x1"),
                    tk.int_array_text(F.col("x2")).alias("x2"), F.size("x1").cast("long").alias("n_ids"))


@query("encoded_truncated", with_views(f"""with {CORPUS_CTE},\n{VOCAB_CTE},\n{TOKENS_CTE}
select task, id, array_to_string(x1, ',') as x1, len(x1) as n_ids from encoded where window_no = 0""", *_TEXT_VIEWS))
def q_encoded_truncated(spark, sf_dir):
    """T2 in its truncating form (its feature): the first 256 tokens of each text."""
    _, t = _tokens(spark, sf_dir)
    x1, _ = tk.encode(F.col("tokens"), tk.MAXLEN)
    return t.select("task", "id", tk.int_array_text(x1).alias("x1"), F.size(x1).cast("long").alias("n_ids"))


@query("pair_prefix", with_views("""
select coalesce(id, 'nan') as id, concat(substr(coalesce(content1, 'nan'), 1, 200), coalesce(content2, 'nan')) as content
from ocnli""", "ocnli"))
def q_pair_prefix(spark, sf_dir):
    """P11 + P12 in the truncating form (its feature): 200 code points of the first sentence, then the second."""
    pairs = build_corpus({"ocnli": views.ocnli(spark, sf_dir)}, labelled=False, prefix=PAIR_PREFIX)
    return pairs.select("id", "content")


@query("corpus_unlabelled", with_views(f"with {CORPUS_CTE}\nselect task, id, content from corpus", *_TEXT_VIEWS))
def q_corpus_unlabelled(spark, sf_dir):
    """F6, test side: the same union without labels."""
    return corpus(spark, sf_dir, labelled=False)


@query("task_domains", with_views(f"""with {CORPUS_CTE},
codes as (select distinct label, dense_rank() over (order by label) - 1 as code from corpus),
own as (select distinct c.task, k.code, k.label from corpus c join codes k on c.label = k.label)
select task, string_agg(code::varchar, ',' order by code) as codes, string_agg(label, ',' order by label) as labels
from own group by task""", *_TEXT_VIEWS))
def q_task_domains(spark, sf_dir):
    """D3: each task's own classes from its distinct labels, with the dictionary's codes and names."""
    c = corpus(spark, sf_dir)
    names = (c.select("task", "label").distinct().groupBy("task")
              .agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels")))
    domains = learned_domains(c, label_dictionary(c, "label"))
    return domains.withColumn("codes", tk.int_array_text(F.col("codes"))).join(names, "task")


@query("corpus_task_argmax", with_views(f"""with {CORPUS_CTE},
codes as (select distinct label, dense_rank() over (order by label) - 1 as code from corpus),
dom as (select distinct c.task, k.code, k.label as name from corpus c join codes k on c.label = k.label),
scored as (select c.task, c.id, d.name, d.code, (length(c.content) + 1) * (37 * d.code + 11) % 101 as s
           from corpus c join dom d on c.task = d.task),
best as (select *, row_number() over (partition by task, id order by s desc, code) as rn from scored)
select task, id, cast(code as integer) as pred_code, name as pred_label from best where rn = 1""", *_TEXT_VIEWS))
def q_corpus_task_argmax(spark, sf_dir):
    """DEC1 + EN2: argmax of a whole-text score over the task's learned classes, named by the dictionary."""
    c = corpus(spark, sf_dir)
    d = label_dictionary(c, "label")
    last = F.array_max("codes")
    p = F.transform(F.sequence(F.lit(0), last), lambda k: ((F.char_length("content") + 1) * (37 * k + 11) % 101).cast("double"))
    # one row per task and one per class: broadcast, so that no task reads a whole task's texts
    scored = c.join(F.broadcast(learned_domains(c, d)), "task").select("task", "id", argmax_code(p, F.col("codes")).alias("pred_code"))
    return label_decode(scored, "pred_code", F.broadcast(d), "pred_label").select("task", "id", "pred_code", "pred_label")


BATCH_CTE = """
batched as (
  select e.task, e.id, e.window_no, e.x1, row_number() over (order by r.task_rank, e.id, e.window_no) as rn
  from encoded e join task_rank r on e.task = r.task),
batched2 as (select *, (rn - 1) // 4 as batch from batched),
padded as (
  select task, id, window_no, rn, batch,
         list_concat(x1, list_transform(range(max(len(x1)) over (partition by batch) - len(x1)), lambda i: 0)) as x1
  from batched2)"""


def _batched(spark, sf_dir):
    """``(windows with their batch, lookup array)``: only keys are ranked; windows join afterwards by key, as text.

    Ids are looked up after the last shuffle.
    """
    placed = _placed(spark, sf_dir)
    c = corpus(spark, sf_dir)
    windows = tk.text_windows(c).withColumnRenamed("window", "window_no")
    return windows.join(placed, ["task", "id", "window_no"]), tk.lookup_table(tk.char_vocabulary(c)).scalar()


def _placed(spark, sf_dir):
    # the number of windows follows from the length of the text, without its tokens
    last = F.greatest(F.ceil(F.char_length("content") / tk.MAXLEN).cast("int") - 1, F.lit(0))
    w = corpus(spark, sf_dir).select("task", "id", F.explode(F.sequence(F.lit(0), last)).alias("window_no"))
    return tk.assign_batches(w.withColumn("task_rank", _task_rank()), ["task_rank", "id", "window_no"]).drop("task_rank")


@query("batch_assignment", with_views(f"""with {CORPUS_CTE},\n{VOCAB_CTE},\n{TOKENS_CTE},\n{BATCH_CTE}
select task, id, window_no, rn, batch from batched2""", *_TEXT_VIEWS))
def q_batch_assignment(spark, sf_dir):
    return _placed(spark, sf_dir).select("task", "id", "window_no", "rn", "batch")


SLICE_BLOCK = 500


@query("corpus_slices", with_views(f"""with {CORPUS_CTE},
numbered as (select c.task, c.id, row_number() over (order by r.task_rank, c.id) - 1 as rn from corpus c join task_rank r on c.task = r.task),
n as (select count(*) as total, count(*) filter (task = 'tnews') as a, count(*) filter (task = 'ocemotion') as b, count(*) filter (task = 'ocnli') as c from corpus)
select case when rn < a then 'head' when rn < a + b then 'middle' else 'tail' end as part, task, id, rn
from numbered cross join n where rn < a + b or rn >= total - c""", *_TEXT_VIEWS))
def q_corpus_slices(spark, sf_dir):
    """L1: the tasks' rows as the first, the middle and the last rows of the corpus order, each read from its blocks alone."""
    path = scratch_path(spark, "ordered-corpus")
    c = corpus(spark, sf_dir).select("task", "id", _task_rank().alias("task_rank"))
    n = dict(c.groupBy("task").count().collect())       # one row per task
    write_ordered(c, ["task_rank", "id"], path, SLICE_BLOCK)
    a, b, z = (n.get(t, 0) for t in TASK_ORDER)
    parts = {"head": head(spark, path, a, SLICE_BLOCK), "middle": read_slice(spark, path, a, a + b, SLICE_BLOCK),
             "tail": tail(spark, path, z, a + b + z, SLICE_BLOCK)}
    return reduce(lambda x, y: x.unionByName(y), [df.select(F.lit(p).alias("part"), "task", "id", "rn") for p, df in parts.items()])


EPOCHS, EPOCH_SEED = (0, 1, 2), 222


def _epoch_sql() -> str:
    """The Feistel network written out: a pass is one subquery per round, cycle walking a recursion."""
    keys = ", ".join(f"({e}, {', '.join(map(str, ep.round_keys(EPOCH_SEED, e)))})" for e in EPOCHS)

    def mixed(v, j):
        t = f"((({v} + k{j}) * {ep.FACTOR}) % {ep.PRIME})"
        return f"(({t} * {t}) % {ep.PRIME})"

    def one_pass(source):
        q = f"select *, x % a as l, x // a as r from ({source})"
        for j in range(ep.ROUNDS):
            half, other, size = ("l", "r", "a") if j % 2 == 0 else ("r", "l", "b")
            q = f"select * replace (({half} + {mixed(other, j)}) % {size} as {half}) from ({q})"
        return f"select * exclude (l, r, x), r * a + l as x from ({q})"

    return f"""with {CORPUS_CTE},
windows as (select task, id, unnest(range(greatest(1, cast(ceil(length(content) / 256.0) as bigint)))) as window_no from corpus),
numbered as (select w.*, row_number() over (order by r.task_rank, w.id, w.window_no) - 1 as i from windows w join task_rank r on w.task = r.task),
size as (select count(*)::bigint as n, ceil(sqrt(count(*)))::bigint as a from numbered),
sized as (select n, a, ((n + a - 1) // a)::bigint as b from size),
keys as (select * from (values {keys}) t(epoch, {', '.join(f'k{j}' for j in range(ep.ROUNDS))})),
walk as (with recursive w as (
           select * from ({one_pass("select task, id, window_no, n, a, b, keys.*, i::bigint as x from numbered cross join sized cross join keys")})
           union all select * from ({one_pass("select * from w where x >= n")})) select * from w)
select task, id, cast(window_no as integer) as window_no, epoch, x as place, x // 4 as batch from walk where x < n"""


@query("epoch_batches", with_views(_epoch_sql(), *_TEXT_VIEWS))
def q_epoch_batches(spark, sf_dir):
    """O3 + B1: every epoch's own shuffled batches, from one numbering of the windows."""
    last = F.greatest(F.ceil(F.char_length("content") / tk.MAXLEN).cast("int") - 1, F.lit(0))
    w = corpus(spark, sf_dir).select("task", "id", F.explode(F.sequence(F.lit(0), last)).alias("window_no"), _task_rank().alias("task_rank"))
    return ep.epoch_batches(w, ["task_rank", "id", "window_no"], EPOCHS, tk.BATCH_SIZE, EPOCH_SEED).drop("task_rank")


@query("padded_batches", with_views(f"""with {CORPUS_CTE},\n{VOCAB_CTE},\n{TOKENS_CTE},\n{BATCH_CTE}
select task, id, window_no, batch, array_to_string(x1, ',') as x1, len(x1) as width from padded""", *_TEXT_VIEWS))
def q_padded_batches(spark, sf_dir):
    b, lut = _batched(spark, sf_dir)
    longest = F.max(F.char_length("part")).over(Window.partitionBy("batch"))
    p = b.withColumn("_longest", longest + 2).withColumn("_lut", lut).withColumn("x1", tk.encode_part(F.col("part"), F.col("_lut")))
    p = p.withColumn("x1", F.concat("x1", F.array_repeat(F.lit(tk.PAD), F.col("_longest") - F.size("x1"))))
    return p.select("task", "id", "window_no", "batch", tk.int_array_text(F.col("x1")).alias("x1"),
                    F.size("x1").cast("long").alias("width"))


def _labelled_corpus(spark, sf_dir):
    c = corpus(spark, sf_dir)
    n_cls = label_dictionary(c, "label").count()
    return label_encode(c, ["label"], suffix="_code"), n_cls


@query("batch_arrays", with_views(f"""with {CORPUS_CTE},\n{VOCAB_CTE},\n{TOKENS_CTE},\n{BATCH_CTE},
codes as (select label, cast(dense_rank() over (order by label) - 1 as integer) as code from corpus),
ncls as (select count(distinct label) as n from corpus),
ys as (select c.task, c.id, array_to_string(list_transform(range(n.n), lambda i: case when i = k.code then 1 else 0 end), ',') as y
       from corpus c join (select distinct label, code from codes) k on c.label = k.label cross join ncls n)
select p.batch,
       string_agg(array_to_string(p.x1, ','), '|' order by p.rn) as x1,
       string_agg(array_to_string(list_transform(p.x1, lambda x: 0), ','), '|' order by p.rn) as x2,
       string_agg(y.y, '|' order by p.rn) as y
from padded p join ys y on p.task = y.task and p.id = y.id
group by p.batch""", *_TEXT_VIEWS))
def q_batch_arrays(spark, sf_dir):
    lab, n_cls = _labelled_corpus(spark, sf_dir)
    windows, lut = _batched(spark, sf_dir)
    ys = lab.select("task", "id", "label_code")
    rows = windows.join(ys, ["task", "id"]).groupBy("batch").agg(F.collect_list(F.struct("rn", "part", "label_code")).alias("_rows"))
    # ids, padding, zero segment ids and targets inside the collected batch (at most four rows)
    b = rows.withColumn("_lut", lut).withColumn("_rows", F.array_sort(F.transform("_rows", lambda r: F.struct(
        r["rn"].alias("rn"), tk.encode_part(r["part"], F.col("_lut")).alias("x1"), one_hot(r["label_code"], n_cls).alias("y")))))
    b = b.select("batch", F.col("_rows.x1").alias("x1"), F.col("_rows.y").alias("y"))
    width = F.array_max(F.transform("x1", F.size))
    b = b.withColumn("x1", F.transform("x1", lambda x: F.concat(x, F.array_repeat(F.lit(tk.PAD), width - F.size(x)))))
    b = b.withColumn("x2", F.transform("x1", lambda x: F.array_repeat(F.lit(0), F.size(x))))
    return b.select("batch", *[tk.nested_array_text(F.col(c)).alias(c) for c in ("x1", "x2", "y")])


@query("training_pairs", with_views(f"""with {CORPUS_CTE},
codes as (select label, cast(dense_rank() over (order by label) - 1 as integer) as code from corpus),
ncls as (select count(distinct label) as n from corpus),
coded as (select c.*, k.code from corpus c join (select distinct label, code from codes) k on c.label = k.label),
folded as (
  select *, ntile({N_FOLDS}) over (partition by code order by md5(task || '/' || id || ':{FOLD_SEED}'), task || '/' || id) - 1 as fold
  from coded)
select f.task, f.id, f.content, case when f.fold = 0 then 'validation' else 'train' end as subset, f.code as label_code,
       array_to_string(list_transform(range(n.n), lambda i: case when i = f.code then 1 else 0 end), ',') as y
from folded f cross join ncls n""", *_TEXT_VIEWS))
def q_training_pairs(spark, sf_dir):
    lab, n_cls = _labelled_corpus(spark, sf_dir)
    keys = lab.select("task", "id", "label_code").withColumn("uid", F.concat_ws("/", "task", "id"))
    folded = train_validation_split(stratified_folds(keys, "uid", "label_code", N_FOLDS, FOLD_SEED))
    folded = folded.join(corpus(spark, sf_dir).select("task", "id", "content"), ["task", "id"])   # keys are ranked, texts join after
    return folded.select("task", "id", "content", "subset", "label_code",
                         tk.int_array_text(one_hot(F.col("label_code"), n_cls)).alias("y"))


@query("stratified_folds", f"""
select doc_id, quality,
  cast(ntile({N_FOLDS}) over (partition by quality order by md5(cast(doc_id as varchar) || ':{FOLD_SEED}'), doc_id) - 1 as integer) as fold
from labels""")
def q_stratified_folds(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return stratified_folds(lab, "doc_id", "quality", N_FOLDS, FOLD_SEED)


@query("train_validation_split", f"""
select doc_id, quality, case when fold = 0 then 'validation' else 'train' end as subset from (
  select doc_id, quality,
    ntile({N_FOLDS}) over (partition by quality order by md5(cast(doc_id as varchar) || ':{FOLD_SEED}'), doc_id) - 1 as fold
  from labels)""")
def q_train_validation_split(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return train_validation_split(stratified_folds(lab, "doc_id", "quality", N_FOLDS, FOLD_SEED)) \
        .select("doc_id", "quality", "subset")


@query("one_hot", with_views("""
select vec_id, label,
  array_to_string(list_transform(range(10), lambda i: case when i = label then 1 else 0 end), ',') as y
from probs""", "probs"))
def q_one_hot(spark, sf_dir):
    p = views.probs(spark, sf_dir)
    return p.select("vec_id", "label", tk.int_array_text(one_hot(F.col("label"), views.N_CLASSES)).alias("y"))
