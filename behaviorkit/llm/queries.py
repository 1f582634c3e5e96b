"""Registered queries of the training-data operators: each applies its operator to its whole table.

``ORACLE`` holds DuckDB SQL where SQL can express the result; the others are tested against
brute force, exact round trips or held-out accuracy in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from behaviorkit.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document: 3-word shingles, at most 3 differing bits."""
    from behaviorkit.llm import simhash
    g = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return g.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


@query("op8_best_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 1024 tokens."""
    from behaviorkit.llm import packing
    from behaviorkit.llm.tokens import vocabulary_path
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), capacity=1024, end_id=2)


@query("op9_token_id_store")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids as indexed segments and reads them back: doc_id, start, n_tokens, ids_crc32."""
    from behaviorkit.llm import tokenstore
    from behaviorkit.llm.tokens import vocabulary_path
    from behaviorkit.session import scratch_path
    path = scratch_path(spark, "token-store")
    tokenstore.write_store(table(spark, sf_dir, "documents"), path, vocabulary_path("word_bpe_49k.json"), "white_space", end_id=1)
    return tokenstore.read_documents(tokenstore.open_store(spark, path))


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, posterior, quality_score, keep of every document."""
    from behaviorkit.llm import quality
    return quality.classify(table(spark, sf_dir, "documents"), train_rows=4000)


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score; profiles are learned from the documents that are not held out."""
    from behaviorkit.llm import langid
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    found = langid.identify(docs.select("doc_id", "text"), langid.learn(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op3_source_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, size, block, slot and in_mix of every document, for tempered source weights."""
    from behaviorkit.llm import mixing
    return mixing.order(table(spark, sf_dir, "documents"), block=20_000, alpha=0.7)


@query("op10_lm_scoring")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, log_likelihood, mean_log_likelihood of every document."""
    from behaviorkit.llm import lm
    return lm.pseudo_likelihood(table(spark, sf_dir, "documents"), workers=24, rounds=6)


@query("op6_closed_syncmers")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited copy, and their likeness."""
    from behaviorkit.llm import syncmers
    return syncmers.compare_with_edits(table(spark, sf_dir, "documents"))


@query("op4_warc", sql="""
    with p as (select page_id, coalesce(html, '') as html from pages),
         q as (select page_id, html, octet_length(encode(html)) as payload_bytes, sha1(html) as hex,
                      min(page_id) over (partition by html) as first from p),
         d as (select *, (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                                 1 + (('0x' || substr(hex, 5 * (j // 4) + 1, 5))::int >> (15 - 5 * (j % 4))) % 32, 1), '' order by j)
                          from range(32) t(j)) as payload_digest from q)
    select page_id, payload_bytes, payload_digest,
           case when page_id = first then 'response' else 'revisit' end as record_type,
           case when page_id = first then null else first end as refers_to
    from d""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes a record per page, reads the archives back and merges their index: one row per page."""
    from behaviorkit.llm import warc
    found = warc.archive(table(spark, sf_dir, "pages"), min_bytes=0)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op2_embedding_near_dedup", sql="""
    with v as (select vec_id, label, embedding::double[] as e from embeddings
               where label is not null and embedding is not null
                 and len(list_filter(embedding::double[], lambda x: x is null or not isfinite(x))) = 0
                 and len(list_filter(embedding::double[], lambda x: x <> 0)) > 0),
         l as (select a.vec_id as x, b.vec_id as y from v a join v b
               on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.93),
         r as (with recursive w(x, y) as (select x, y from l union select w.x, l.y from w join l on w.y = l.x) select x, min(y) as y from w group by x)
    select e.vec_id, (select count(*) from l where l.x = e.vec_id) as n_links,
           least(e.vec_id, coalesce(r.y, e.vec_id)) as component_id, e.vec_id = least(e.vec_id, coalesce(r.y, e.vec_id)) as kept
    from embeddings e left join r on r.x = e.vec_id""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector at cosine 0.93 within its label."""
    from behaviorkit.llm import embeddings
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.93)


_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@query("op11_lexical_search", sql=f"""
    with t as (select doc_id, unnest({_TERMS}) as term from documents),
         f as (select doc_id, term, count(*) as tf from t group by all),
         d as (select doc_id, sum(tf)::bigint as n from f group by doc_id),
         a as (select count(*)::bigint as docs, sum(n)::bigint as l from d),
         q as (select item_id, term, count(*)::bigint as c from (select item_id, unnest({_TERMS}) as term from benchmark) group by all),
         w as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w
               from f cross join a where term in (select term from q) group by term),
         m as (select doc_id, 100 - 25 + ((25 * n * docs) // l) as m from d cross join a),
         s as (select item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
               from q join w using (term) join f using (term) join m using (doc_id) group by all),
         r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
    select item_id, rank::integer as rank, doc_id, score from r where rank <= 20""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item_id, rank, doc_id, score: the 20 best documents of every benchmark item."""
    from behaviorkit.llm import lexical
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


@query("op12_sentencepiece")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, encoded to pieces and decoded again."""
    from behaviorkit.llm import pieces
    from behaviorkit.llm.tokens import vocabulary_path
    return pieces.round_trip_digests(table(spark, sf_dir, "documents"), vocabulary_path("piece_bpe_32k.model"))


@query("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least 12 words of every document, a tenth of them with planted repeats: digests of all runs and of the collapsed text."""
    from behaviorkit.llm import periodic
    docs = table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", periodic.with_repeats(F.col("doc_id"), F.col("text")).alias("text"))
    return periodic.summary(periodic.find_runs(docs, least=12))
