"""Packing, token store, syncmers, archives and LM scores: exact round trips and plain versions."""

import base64
import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from behaviorkit.llm import lm, packing, queries, syncmers, tokenstore, warc
from behaviorkit.llm.tokens import Encoder, vocabulary_path
from behaviorkit.session import scratch_path

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"


def _plain_ids(name, text):
    from tokenizers import Tokenizer
    t = _plain_ids.kept.setdefault(name, Tokenizer.from_file(vocabulary_path(name)))
    return t.encode(text or "", add_special_tokens=False).ids


_plain_ids.kept = {}


@pytest.mark.parametrize("name,words", [(BYTE, "leading_space"), (WORD, "white_space")])
def test_words_encode_as_whole_texts(documents, odd, name, words):
    e = Encoder(vocabulary_path(name), words, cached=50)
    texts = [r["text"] for r in documents.limit(60).collect()] + [r["text"] for r in odd.collect()]
    texts += ["a\n b  c \n\n d\t e", " x ", "don't  STOP ΑΣ ς it's", "a'b ''s x's! (don't) _x_ 3.5 a1b ©®", "é́ é", "İstanbul ŸÿſK", "<|endoftext|> a", "a\0b c",
              "a <|endoftext|> b", "x<|endoftext|><|startoftext|>y <|startoftext|>", "<|EndOfText|> <|endoftext| >", "(word) (word), [a1] ((x)) .5 -3- ½, x½. ª. º, €5.",
              "word,word word,, , ,a (", "Ünï, (élan) «ça»; ٣, 日本, (日本)"]
    for t in texts:
        assert e.encode(t) == np.asarray(_plain_ids(name, t), "<u4").tobytes(), (t or "")[:50]


def test_plan_places_every_length_once_and_fills_well():
    rng = random.Random(1)
    cases = [{}, {1: 1}, {1: 5000}, {1024: 3, 1023: 4, 1: 2}, {513: 100, 300: 50, 20: 7}, Counter(rng.randint(1, 1024) for _ in range(300)),
             Counter(rng.randint(1, 1024) for _ in range(50_000)), Counter(min(1024, 1 + int(rng.expovariate(1 / 400))) for _ in range(5000))]
    for hist in cases:
        by, held = defaultdict(list), defaultdict(list)
        for z, rank, n, per, first, offset in packing.plan(hist):
            by[z].append((rank, n))
            assert n % per == 0
            for b in range(n // per):
                held[first + b].append((offset, z * per))
        for z, n in hist.items():
            at = 0
            for rank, count in sorted(by[z]):
                assert rank == at
                at += count
            assert at == n
        for places in held.values():
            at = 0
            for offset, size in sorted(places):
                assert offset == at
                at += size
            assert at <= 1024
        if sum(hist.values()) > 1000:
            least = -(-sum(z * n for z, n in hist.items()) // 1024)
            assert len(held) <= 1.01 * least + 1


def test_pack_odd_rows(odd, no_rows):
    rows = packing.pack(odd, vocabulary_path(BYTE)).collect()
    want = Counter()
    for r in odd.select("doc_id", "text").collect():
        ids = np.asarray(_plain_ids(BYTE, r["text"]) + [2], "<u4")
        for i, (s, n) in enumerate(packing.cut_points(len(ids), 1024)):
            want[r["doc_id"], i, s, n, zlib.crc32(ids[s:s + n].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == [0, *np.cumsum([n for _, n in sorted(p)])[:-1]] and sum(n for _, n in p) <= 1024
    assert packing.pack(no_rows, vocabulary_path(BYTE)).count() == 0
    assert packing.cut_points(2500, 1024) == [(0, 452), (452, 1024), (1476, 1024)] and packing.cut_points(1024, 1024) == [(0, 1024)]


def test_sequences_hold_the_ids(documents):
    docs = documents.where("doc_id < 40")
    out = packing.sequences(docs, vocabulary_path(BYTE)).collect()
    total = sum(len(_plain_ids(BYTE, r["text"])) + 1 for r in docs.collect())
    assert sum(len(r["ids"]) // 4 for r in out) == total and max(len(r["ids"]) for r in out) <= 4096


def test_index_is_minimal_and_perfect():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000):
        keys = np.unique(rng.integers(-2**62, 2**62, n))
        sizes, bits = tokenstore.build_index(keys)
        assert sorted(tokenstore.slots_of(keys, sizes, bits).tolist()) == list(range(len(keys)))


def test_store_round_trip_and_keyed_reads(spark, odd, no_rows):
    path = scratch_path(spark, "store")
    tokenstore.write_store(odd, path, vocabulary_path(WORD), "white_space", 1, segment_bytes=256)
    store = tokenstore.open_store(spark, path)
    assert store.count() > 2
    rows = sorted(odd.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))
    at, want = 0, []
    for r in rows:
        ids = np.asarray(_plain_ids(WORD, r["text"]) + [1], "<u4").tobytes()
        want.append((r["doc_id"], at, len(ids) // 4, zlib.crc32(ids)))
        at += len(ids) // 4
    got = sorted(map(tuple, tokenstore.read_documents(store).collect()), key=lambda r: r[1])
    assert got == want
    keys = spark.createDataFrame([(i,) for i in (1, 3, 6, 8, 99, -4, None)], "doc_id long")
    found = {r["doc_id"]: zlib.crc32(r["ids"]) for r in tokenstore.lookup(store, keys).collect()}
    assert found == {k: c for k, _, _, c in want if k in (1, 3, 6, 8)}
    tokenstore.write_store(no_rows, path + "-empty", vocabulary_path(WORD), "white_space", 1)
    assert tokenstore.read_documents(tokenstore.open_store(spark, path + "-empty")).count() == 0


def _edits(rows):
    """Plain edited texts; a repeated row is one document."""
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        yield key, text, text[:len(text) - half] + after[:half], after


def test_syncmers_are_the_plain_ones(spark):
    for n in (0, 1, 3, 4, 5, 40):
        text = " ".join(f"w{i * i % 17}" for i in range(n))
        df = spark.createDataFrame([(text,)], "t string").select(syncmers.chunk_hashes(F.col("t")).alias("h"))
        r = df.select("h", syncmers.positions(F.col("h"), 4).alias("p")).first()
        h = r["h"]
        want = [i for i in range(len(h) - 3) if min(h[i], h[i + 3]) <= min(h[i + 1], h[i + 2])] if len(h) >= 4 else [0] * (len(h) > 0)
        assert r["p"] == want


def _plain_sketch(text, k=4, size=64):
    plain = re.sub(r"[ \t\n\x0b\f\r]+", " ", text).strip(" ")
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    if not plain:
        return []
    pieces = [plain[i:i + 13] for i in range(len(plain) - 12)] or [plain]
    h = [signed(xxhash.xxh64_intdigest(p.encode(), 42)) for p in pieces]

    def fold(values):
        out = 42
        for v in values:
            out = xxhash.xxh64_intdigest(struct.pack("<q", v), out)
        return signed(out)

    if len(h) < k:
        whole = 42
        for v in h:
            whole = fold([whole, v])
        return [whole]
    return sorted({fold(h[i:i + k]) for i in range(len(h) - k + 1) if min(h[i], h[i + k - 1]) <= min(h[i + 1:i + k - 1])})[:size]


def _plain_likeness(a, b, size=64):
    union = sorted({*a, *b})[:size]
    return len([x for x in union if x in a and x in b]) / len(union) if union else 1.0


def test_query_against_plain_fingerprints(spark, documents):
    rng = random.Random(3)
    odd_texts = ["", " ", "a", "  lead and trail  ", "x" * 12, "x" * 13, "exactly16 chars.", "fifteen chars..", "a  b\tc\n\nd " * 9, "日本語" * 30,
                 "half is blank" + " " * 40, " " * 40 + "half is blank", "".join(rng.choice("ab ") for _ in range(1500))]
    rows = [(r["doc_id"], r["text"] or "") for r in documents.where("length(text) < 6000").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(odd_texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in syncmers.compare_with_edits(df).collect()}
    text = lambda v: "".join(format(x & (1 << 64) - 1, "016x") for x in v)
    for key, own, edited, after in _edits(rows):
        a, b, c = _plain_sketch(own), _plain_sketch(edited), _plain_sketch(after)
        r = got[key]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (text(a), text(b)), key
        assert (r["near_edited"], r["near_next"]) == (_plain_likeness(a, b), _plain_likeness(a, c)), key


def test_syncmers_context_free(spark):
    inner = " ".join(f"inner{i}" for i in range(30))
    df = spark.createDataFrame([(1, "some words before " + inner + " and after"), (2, "other " + inner)], "doc_id long, text string")
    found = {k: set(g["anchor"]) for k, g in syncmers.anchor_table(df).toPandas().groupby("doc_id")}
    assert len(found[1] & found[2]) >= 0.8 * min(map(len, found.values()))


def test_edits_and_likeness(spark, documents, odd, no_rows):
    for docs in (documents, odd):
        rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
        got = syncmers.compare_with_edits(docs).collect()
        assert len(got) == len(rows)
        want = {k: (len(t), hashlib.sha256(e.encode()).hexdigest()) for k, t, e, _ in _edits(rows)}
        assert all((r["n_chars"], r["edited_sha256"]) == want[r["doc_id"]] for r in got)
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
        prints = defaultdict(set)
        for r in got:
            prints[dict(rows)[r["doc_id"]]].add(r["fingerprint"])
        assert all(len(p) == 1 for p in prints.values())
    long = [r for r in syncmers.compare_with_edits(documents).collect() if r["n_chars"] > 500]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.97 and 0.25 < np.mean([r["near_edited"] for r in long]) < 0.45
    assert syncmers.compare_with_edits(no_rows).count() == 0
    plan = syncmers.compare_with_edits(documents)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_edited_copy_hashes_only_its_new_half(spark):
    """Borders of the kept half: white space on either side, halves of about one k-mer, blank halves; the whole copy is not hashed again."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("ab  \t\n日") for _ in range(n)) for n in [*range(24, 44), 61, 90, 300, 301, 700] * 3]
    texts += ["k" * 16 + " " * 16, "k" * 15 + " " * 17, " " * 16 + "k" * 16, "word " * 20, "abcdefghijklmnop" * 2, " " * 50 + "q" * 50, "", "z" * 40, " lead" * 30]
    rows = list(enumerate(texts))
    found = syncmers.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in found.collect()}
    text = lambda v: "".join(format(x & (1 << 64) - 1, "016x") for x in v)
    for key, own, edited, after in _edits(rows):
        a, b, c = _plain_sketch(own), _plain_sketch(edited), _plain_sketch(after)
        r = got[key]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (text(a), text(b)), key
        assert (r["near_edited"], r["near_next"]) == (_plain_likeness(a, b), _plain_likeness(a, c)), key
    analyzed = found._jdf.queryExecution().analyzed().toString()
    assert "regexp_replace(" in analyzed and not re.search(r"regexp_replace\((coalesce\()?edited#", analyzed)


def test_loser_tree_merges_runs():
    rng = random.Random(2)
    for _ in range(200):
        runs = [sorted(rng.choices(range(30), k=rng.randint(0, 8))) for _ in range(rng.randint(0, 9))]
        assert list(warc.LoserTree([[(x, x) for x in r] for r in runs])) == sorted(sum(runs, []))


def test_archives_round_trip(spark):
    con = duckdb.connect()
    con.execute("create view pages as select * from read_parquet('/root/testdata/sf0.001/pages.parquet')")
    got = sorted(map(tuple, queries.op4(spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted(con.execute(queries.ORACLE["op4_warc"]).fetchall())


def test_archives_of_odd_pages(spark):
    tricky = "<p>é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"
    rows = [(5, "http://www.a.org/x?y#z", tricky), (2, "https://b.a.org:443", tricky), (None, None, None), (7, "u\nv", ""), (7, "u\nv", ""),
            (9, "http://a.org:8080/", "x" * 300_000), (None, "http://a.org/", tricky)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("run", F.lit("clash"))
    r = warc.archive(pages).orderBy("position").collect()
    assert [x["position"] for x in r] == list(range(len(rows)))
    assert [x["url_key"] for x in r] == sorted(x["url_key"] for x in r)
    data = lambda h: (h or "").encode()
    want = Counter()
    first = {tricky: 2, "": 7}
    for k, _, h in rows:
        f = first.get(h or "", k)
        want[k, len(data(h)), base64.b32encode(hashlib.sha1(data(h)).digest()).decode(), "response" if k == f else "revisit", None if k == f else f] += 1
    assert Counter((x["page_id"], x["payload_bytes"], x["payload_digest"], x["record_type"], x["refers_to"]) for x in r) == want
    assert warc.archive(pages.limit(0)).count() == 0


def test_network_gradient_and_windows():
    table = lm.id_table([ord(c) for c in "abc "])
    codes = lm.windows(["ab", "", "c"], table)
    context, centre = lm.Network.unpack(codes)
    assert centre.tolist() == [2, 3, 4] and context.tolist() == [[0, 0, 3, 0], [0, 2, 0, 0], [0, 0, 0, 0]]
    n = np.array([3, 1, 2])
    net = lm.Network()
    g = net.gradient(codes, n)
    loss = lambda w: -(lm.Network(w).log_probability(codes) * n).sum() / n.sum()
    for i in np.random.default_rng(1).choice(np.flatnonzero(np.abs(g) > 1e-4), 12):
        up, down = net.weights.astype(np.float64), net.weights.astype(np.float64)
        up[i] += 1e-4
        down[i] -= 1e-4
        assert abs((loss(up) - loss(down)) / 2e-4 - g[i]) < 1e-3
    assert abs(np.exp(net.forward(context)[1]).sum(axis=1) - 1).max() < 1e-4


def test_lm_learns_and_scores(spark, documents, odd, no_rows):
    points = lm.alphabet(documents)
    weights = lm.train(lm.window_counts(documents, points), workers=4, rounds=4)
    texts = [r["text"] for r in documents.collect()]
    codes = lm.windows(texts, lm.id_table(points))
    centre = lm.Network.unpack(codes)[1]
    share = np.bincount(centre) / len(centre)
    unigram = -(share[share > 0] * np.log(share[share > 0])).sum()
    assert -lm.Network(weights).log_probability(codes).mean() < 0.85 * unigram
    rng = random.Random(1)
    mixed = ["".join(rng.sample(t, len(t))) for t in texts if len(t) > 200][:40]
    frame = spark.createDataFrame(pd.DataFrame({"t": [t for t in texts if len(t) > 200][:40] + mixed, "real": [True] * 40 + [False] * 40}))
    means = lm.score(frame, weights, points, "t").groupBy("real").agg(F.avg("mean_log_likelihood")).collect()
    means = {r[0]: r[1] for r in means}
    assert means[True] > means[False] + 0.3
    rows = lm.pseudo_likelihood(odd, workers=2, rounds=1).collect()
    assert len(rows) == odd.count()
    size = {r["doc_id"]: len(r["text"] or "") for r in odd.collect()}
    assert all(r["n_tokens"] == size[r["doc_id"]] and (r["mean_log_likelihood"] is None) == (r["n_tokens"] == 0) for r in rows)
    assert lm.pseudo_likelihood(no_rows, workers=2, rounds=1).count() == 0


def test_characters_beyond_the_alphabet_are_told_apart(spark):
    rng = random.Random(5)
    common = [chr(0x4E00 + i) for i in range(300)]
    texts = ["".join(rng.choices(common, weights=range(300, 0, -1), k=400)) for _ in range(60)] + ["".join(chr(0x1F300 + i) for i in range(200))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["doc_id"]: r["mean_log_likelihood"] for r in lm.pseudo_likelihood(docs, workers=2, rounds=2).collect()}
    count = Counter("".join(texts))
    n = sum(count.values())
    entropy = -sum(c / n * np.log(c / n) for c in count.values())
    assert abs(-np.mean([rows[i] for i in range(60)]) / entropy - 1) < 0.15 and rows[60] < -6      # rare symbols are not the best text
    points = [ord(c) for c in common[:126]]
    table = np.exp(lm.rest_table(points, (np.array([ord("a"), ord("b")]), np.array([3, 1]))).astype(float))
    table[points] = 0
    assert abs(table.sum() - 1) < 1e-4 and abs(table[ord("a")] / table[ord("b")] - 3) < 1e-3


def test_syncmers_of_shifted_text_without_spaces(spark):
    rng = random.Random(6)
    passage = "".join(chr(rng.choice((0x4E00, 0x1F300)) + rng.randrange(600)) for _ in range(2000))
    rows = [(0, passage)] + [(i, "一二三"[:i] + passage) for i in (1, 2, 3)] + [(4, passage[:50] + "x" + passage[50:])]
    found = {k: set(g["anchor"]) for k, g in syncmers.anchor_table(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().groupby("doc_id")}
    assert len(found[0]) > 700 and all(len(found[0] & found[i]) >= 0.97 * len(found[0]) for i in range(1, 5))
    spaced = spark.createDataFrame([(0, "one  two\n three four five six"), (1, " one two three\tfour five six ")], "doc_id long, text string")
    prints = [r["sketch"] for r in syncmers.fingerprints(spaced).collect()]
    assert prints[0] == prints[1] and len(prints[0]) > 1
