"""SimHash and embedding near-dedup against brute force."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from behaviorkit.llm import embeddings, simhash
from behaviorkit.llm.common import connected_components


def _groups(keys, links):
    up = {k: k for k in keys}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def _plain_simhash(text):
    words, count = (text or "").encode().lower().split(), [0] * 64
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for bit in range(64):
            count[bit] += h >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * count[bit] > len(shingles))


def test_fingerprint_is_the_plain_one():
    for t in (None, "", " ", "One", "one  TWO\n", "a b c", "a b c a b c d É e", "x y " * 500):
        assert simhash.fingerprint(t) & (1 << 64) - 1 == _plain_simhash(t)


def test_popcount_bound_and_links(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = {0, (1 << 64) - 1, *base}
    for x in base:
        for bits in (1, 2, 3, 4):
            y = x
            for b in rng.sample(range(64), bits):
                y ^= 1 << b
            values.add(y)
    values = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for distance in (3, 5):
        want = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= distance}
        got = {tuple(sorted(x & (1 << 64) - 1 for x in r)) for r in simhash.links(df, distance).collect()}
        assert got == want
    bound = df.select("fp", simhash.popcount_vector(F.col("fp")).alias("v")).collect()
    for p in bound[:80]:
        for q in bound[:80]:
            assert ((p["v"] ^ q["v"]) & (1 << 64) - 1).bit_count() <= ((p["fp"] ^ q["fp"]) & (1 << 64) - 1).bit_count()


def test_components_of_paths_and_hubs(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, 600 + i) for i in range(80)] + [(7, 7)]
    edges += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == _groups({x for e in edges for x in e}, edges)


def test_simhash_groups(spark, documents, odd, no_rows):
    for docs in (documents, odd):
        rows = docs.select("doc_id", "text").collect()
        fps = [_plain_simhash(r["text"]) for r in rows]
        links = [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
        group = _groups(range(len(rows)), links)
        first = {}
        for i, r in enumerate(rows):
            ids = [x for x in (first.get(group[i]), r["doc_id"]) if x is not None]
            first[group[i]] = min(ids) if ids else None
        want = sorted(((r["doc_id"], format(f, "016x"), first[group[i]]) for i, (r, f) in enumerate(zip(rows, fps))), key=repr)
        got = simhash.near_duplicate_groups(docs).select("doc_id", simhash.hex16(F.col("fp")), "component_id").collect()
        assert sorted(map(tuple, got), key=repr) == want
    assert simhash.near_duplicate_groups(no_rows).count() == 0


def test_keep_one_of_each_group(spark, odd, no_rows):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    # 2, 3, 4 have no word and are one group; 5 is repeated; the null key is a copy of 1
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5, 6, 7, 8]
    assert simhash.keep_one(no_rows).count() == 0
    a, b, c, d, e = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "le chat noir dort sur le lit", "der hund bellt laut im hof",
                     "nobody else says any of this")
    rows = [(1, a), (5, a), (5, b), (7, c), (7, d), (None, a), (None, a), (None, e), (None, e), (9, d), (7, d)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, simhash.keep_one(docs).collect()), key=repr)
    assert got == sorted([(1, a), (5, b), (7, c), (7, d), (None, e)], key=repr)


def test_keep_one_against_plain_groups(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    fps = [_plain_simhash(r["text"]) for r in rows]
    group = _groups(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    want = {}
    for i, r in enumerate(rows):
        want[group[i]] = min(want.get(group[i], r["doc_id"]), r["doc_id"])
    kept = simhash.keep_one(documents)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want.values()) and kept.join(documents, documents.columns).count() == kept.count()
    # one plan for all sizes: the texts meet the decisions in a shuffled hash join
    assert "ShuffledHashJoin" in kept._jdf.queryExecution().executedPlan().toString()


def test_embedding_links_and_components(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    rows = []
    for i in range(240):
        v = centres[i % 6] + rng.normal(size=16) * rng.choice([0.02, 0.3, 2.0])
        rows.append((i, v.tolist(), int(i % 4 // 2)))
    rows += [(900 + i, rows[5][1], rows[5][2]) for i in range(40)] + [(950, [2 * x for x in rows[5][1]], rows[5][2])]
    rows += [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [None] * 16, 0), (1004, rows[0][1], None),
             (1005, [1.0, 2.0], 0), (1006, [float("inf")] * 16, 0), (None, rows[0][1], 0), (1007, [], 0), (7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rep", F.lit("clash"))
    ok = [r for r in rows if r[0] is not None and r[1] and r[2] is not None and len(r[1]) == 16
          and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    u = np.array([r[1] for r in ok])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.array([r[2] for r in ok])[:, None] == np.array([r[2] for r in ok])[None, :])
    np.fill_diagonal(near, False)
    links = {}
    for i, r in enumerate(ok):
        links[r[0]] = int(near[i].sum())
    comp = _groups({r[0] for r in rows if r[0] is not None}, [(ok[i][0], ok[j][0]) for i, j in zip(*np.nonzero(near))])
    for block in (1024, 16):
        got = embeddings.near_duplicates(df, block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["vec_id"] is None:
                assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, False)
            else:
                assert r["n_links"] == links.get(r["vec_id"], 0), r
                assert r["component_id"] == comp[r["vec_id"]] and r["kept"] == (r["vec_id"] == comp[r["vec_id"]])
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
