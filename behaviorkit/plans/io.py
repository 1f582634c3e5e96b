"""Registered queries: write-then-read round trips through every sink (IO1-IO5, P1, P6).

Each query writes into a fresh folder under the shared checkpoint folder and
returns the table read back, so the check compares what a reader of the files sees.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from behaviorkit.operators import features as feat
from behaviorkit.operators import tokens as tk
from behaviorkit.operators.assemble import features_by_split
from behaviorkit.plans.cdr import sms_sql_body, usage_sql_body, voice_sql_body
from behaviorkit.plans.decoding import ARGMAX_CTE, q_task_submission
from behaviorkit.plans.registry import query, report
from behaviorkit.plans.text import CORPUS_CTE, VOCAB_CTE, corpus
from behaviorkit.plans.sqlgen import with_views
from behaviorkit.session import scratch_path
from behaviorkit.sources import files, views

VOC_CSV_SCHEMA = "phone_no_m long, opposite_no_m int, calltype_id int, call_dur double, start_datetime string"


@query("csv_roundtrip", with_views(
    "select phone_no_m, opposite_no_m, calltype_id, call_dur, start_datetime from voc", "voc"))
def q_csv_roundtrip(spark, sf_dir):
    v = views.voc(spark, sf_dir).select("phone_no_m", "opposite_no_m", "calltype_id", "call_dur",
                                        F.col("start_datetime").cast("string").alias("start_datetime"))
    path = scratch_path(spark, "voc-csv")
    files.write_csv(v, path)
    back = files.read_csv_table(spark, path, VOC_CSV_SCHEMA)
    return back.withColumn("start_datetime", feat.as_timestamp(back, "start_datetime"))


@query("tsv_roundtrip", with_views("select id, content, label from tnews", "tnews"))
def q_tsv_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "tnews-tsv")
    files.write_tsv(views.tnews(spark, sf_dir), path)
    return files.read_task_tsv(spark, path, ["id", "content", "label"], multi_line=True)   # texts hold line breaks


@query("jsonl_roundtrip", with_views(f"""with {ARGMAX_CTE}
select task, cast(vec_id as varchar) as id, 'L' || code as label from best""", "probs", "domains"))
def q_jsonl_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "submission-jsonl")
    files.write_jsonl(q_task_submission(spark, sf_dir), path, partition_by=["task"])
    return files.read_jsonl(spark, path, "id string, label string, task long").select("task", "id", "label")


@query("feature_store_roundtrip", with_views(usage_sql_body(), "app"))
def q_feature_store_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "usage-features")
    files.write_features(feat.usage_features(views.app(spark, sf_dir)), path)
    return report(files.read_features(spark, path))


def _stored(spark, sf_dir, source):
    """one source's feature table with the split, written partitioned in full precision, every split read back by itself."""
    path = scratch_path(spark, f"{source}-features-by-split")
    tables = features_by_split(views.users(spark, sf_dir), views.app(spark, sf_dir), views.voc(spark, sf_dir),
                               views.sms(spark, sf_dir), only=[source])
    files.write_features(tables[source], path, partition_by=["split"])
    # each reader takes one split: the split filter prunes the other partitions' directories
    parts = [files.read_features(spark, path).where(F.col("split") == s) for s in ("train", "april", "final")]
    return report(reduce(lambda a, b: a.unionByName(b), parts))


@query("feature_store_by_split", with_views(f"""with f as ({usage_sql_body()})
select u.phone_no_m, f.* exclude (phone_no_m), u.split from users u left join f on f.phone_no_m = u.phone_no_m""", "app", "users"))
def q_feature_store_by_split(spark, sf_dir):
    return _stored(spark, sf_dir, "app")


@query("voice_store_by_split", with_views(f"""with f as ({voice_sql_body()})
select u.phone_no_m, f.* exclude (phone_no_m), u.split from users u left join f on f.phone_no_m = u.phone_no_m""", "voc", "users"))
def q_voice_store_by_split(spark, sf_dir):
    return _stored(spark, sf_dir, "voc")


@query("sms_store_by_split", with_views(f"""with f as ({sms_sql_body()})
select u.phone_no_m, f.* exclude (phone_no_m), u.split from users u left join f on f.phone_no_m = u.phone_no_m""", "sms", "users"))
def q_sms_store_by_split(spark, sf_dir):
    return _stored(spark, sf_dir, "sms")


@query("vocabulary_file_roundtrip", with_views(f"with {CORPUS_CTE},\n{VOCAB_CTE}\nselect token, token_id from vocab",
                                               "tnews", "ocemotion", "ocnli"))
def q_vocabulary_file_roundtrip(spark, sf_dir):
    """IO6 + P13: the derived vocabulary written one token per line in id order, read back."""
    path = scratch_path(spark, "vocab-txt")
    vocab = tk.char_vocabulary(corpus(spark, sf_dir))
    # one ordered file; its size is bounded by the vocabulary (one line per distinct character)
    vocab.orderBy("token_id").select("token").coalesce(1).write.mode("overwrite").text(path)
    return tk.read_vocabulary(spark, path)
