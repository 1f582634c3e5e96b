
from pyspark.sql import Window
from pyspark.sql import functions as F

from behaviorkit.operators import decode as dec
from behaviorkit.operators import metrics as mt
from behaviorkit.operators import tokens as tk
from behaviorkit.operators.blend import threshold_label
from behaviorkit.operators.features import voice_outgoing_features
from behaviorkit.operators.prep import label_dictionary, label_decode, label_encode, stratified_folds
from behaviorkit.operators.ranking import ntile_from_rank, ordered_index


def test_filter_then_count_null_vs_zero(spark):
    rows = [(1, 5, 2, "a", None, None), (2, 6, 1, None, None, None), (3, 7, 1, "i", None, None)]
    voc = spark.createDataFrame(rows, "phone_no_m long, opposite_no_m int, calltype_id int, imei_m string, "
                                      "city_name string, county_name string")
    r = {x["phone_no_m"]: x for x in voice_outgoing_features(voc).collect()}
    assert r[1]["voccalltype1"] is None and r[1]["imeis"] is None        # no outgoing call
    assert r[2]["voccalltype1"] == 0 and r[2]["imeis"] == 0              # outgoing, null imei
    assert r[3]["voccalltype1"] == 1 and r[3]["voc_calltype1"] == 1.0


def test_ordered_index_matches_row_number(spark):
    df = spark.range(0, 2000).select((F.col("id") % 7).alias("g"), F.xxhash64("id").alias("h"), "id")
    got = ordered_index(df, ["h", "id"], by=["g"], name="rn", partitions=5)
    want = df.withColumn("rn2", F.row_number().over(Window.partitionBy("g").orderBy("h", "id")))
    j = got.join(want, ["g", "h", "id"])
    assert j.count() == 2000
    assert j.where(F.col("rn") != F.col("rn2")).count() == 0


def test_ntile_closed_form(spark):
    df = spark.range(1, 38).withColumn("n", F.lit(37))
    want = df.withColumn("t", F.ntile(10).over(Window.orderBy("id")))
    bad = want.where(ntile_from_rank(F.col("id"), F.col("n"), 10) != F.col("t")).count()
    assert bad == 0


def test_folds_disjoint_covering_balanced(spark):
    df = spark.range(0, 500).select(F.col("id").cast("string").alias("id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    f = stratified_folds(df, "id", "y", k=10, seed=222)
    assert f.count() == 500 and f.select("id").distinct().count() == 500
    sizes = [r["c"] for r in f.groupBy("fold").agg(F.count("*").alias("c")).collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) <= 2


def test_encode_decode_identity(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "k int, c string")
    d = label_dictionary(df, "c")
    assert [(r["value"], r["code"]) for r in d.orderBy("code").collect()] == [("a", 0), ("b", 1), ("nan", 2)]
    enc = label_encode(df, ["c"], suffix="_code")
    back = label_decode(enc, "c_code", d, "c2")
    assert back.where(F.coalesce(F.col("c"), F.lit("nan")) != F.col("c2")).count() == 0


def test_tokens_pad_and_batches(spark):
    corpus = spark.createDataFrame([("t", "1", "ab a"), ("t", "2", ""), ("t", "3", "zzz　b"), ("t", "4", "b")],
                                   "task string, id string, content string")
    vocab = tk.char_vocabulary(corpus.where(F.col("id") != "3"))
    toks = {r["id"]: r["tokens"] for r in tk.char_tokens(corpus, vocab).collect()}
    v = {r["token"]: r["token_id"] for r in vocab.collect()}
    assert toks["2"] == []
    assert toks["1"] == [v["a"], v["b"], tk.SPACE, v["a"]]
    assert toks["3"] == [tk.UNK, tk.UNK, tk.UNK, tk.SPACE, v["b"]]       # ideographic space is Zs
    x1, _ = tk.encode(F.col("tokens"), maxlen=2)
    enc = tk.char_tokens(corpus, vocab).select("id", x1.alias("x1"))
    b = tk.pad_in_batch(tk.assign_batches(enc, ["id"], size=3), "x1")
    widths = b.groupBy("batch").agg(F.countDistinct(F.size("x1")).alias("w")).collect()
    assert all(r["w"] == 1 for r in widths)
    assert sorted(r["batch"] for r in b.collect()) == [0, 0, 0, 1]


def test_argmax_ties(spark):
    df = spark.createDataFrame([([0.5, 0.5, 0.0], 0), ([0.1, 0.2, 0.7], 0)], "p array<double>, t int")
    codes = F.array(F.lit(0), F.lit(1), F.lit(2))
    r = df.select(dec.argmax_code(F.col("p"), codes).alias("c"), dec.argmax_concat(F.col("p"), codes).alias("s")).collect()
    assert (r[0]["c"], r[0]["s"]) == (0, "L0L1")
    assert (r[1]["c"], r[1]["s"]) == (2, "L2")


def test_threshold_boundary_and_batch_rounding(spark):
    df = spark.createDataFrame([(0.6,), (0.61,), (0.2,)], "s double")
    assert [r[0] for r in df.select(threshold_label(F.col("s"))).collect()] == [0.6, 1.0, 0.0]
    b = spark.createDataFrame([(0, [1, 0], [0.5, 0.5])], "batch int, y array<int>, p array<double>")
    r = mt.batch_f1(b, "y", "p").first()
    assert r["precision"] == 0.0 and r["recall"] == 0.0                  # round(0.5) = 0 (half to even)


def test_macro_f1(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 1)], "y int, p int")
    r = mt.macro_f1(df, "y", "p").first()
    # class 0: 2/3, class 1: 2/4, class 2: 0
    assert abs(r["macro_f1"] - (2 / 3 + 0.5 + 0) / 3) < 1e-12 and r["n_classes"] == 3


def test_read_vocabulary_file_order_dedup(spark, tmp_path):
    p = tmp_path / "vocab.txt"
    p.write_text("[PAD]\n  a \nb\na\nc\n", encoding="utf-8")
    v = tk.read_vocabulary(spark, str(p))
    assert sorted((r["token_id"], r["token"]) for r in v.collect()) == [(0, "[PAD]"), (1, "a"), (2, "b"), (3, "c")]


def test_column_quantiles_match_pandas(spark):
    import pandas as pd
    from behaviorkit.operators.prep import column_quantiles, quantile_impute
    pdf = pd.DataFrame({"a": [1.0, None, 7.0, 2.0, 2.0], "b": [5.0, 4.0, None, None, 1.0]})
    df = spark.createDataFrame(pdf)
    got = {(r["column"], r["q"]): r["value"] for r in column_quantiles(df, ["a", "b"], [0.39, 0.5]).collect()}
    for c in "ab":
        for q in (0.39, 0.5):
            assert abs(got[(c, q)] - pdf[c].quantile(q)) < 1e-12
    filled = quantile_impute(df, ["a", "b"], 0.39).toPandas()
    assert filled.equals(pdf.fillna(pdf.quantile(0.39)))


def test_hot_value_quantiles(spark):
    """One key and value hold most rows: they are one counted row, and the result is pandas'."""
    import pandas as pd
    from behaviorkit.operators.quantiles import keyed_quantiles
    pdf = pd.DataFrame({"k": ["hot"] * 5000 + ["b"] * 7, "x": [3.0] * 4000 + [float(i) for i in range(1000)] + [1.0, 1.0, 2.0, 8.0, 9.0, 9.5, None]})
    got = {r["k"]: r for r in keyed_quantiles(spark.createDataFrame(pdf), ["k"], {"x": "x"}, {"lo": 0.1, "med": 0.5, "hi": 0.93}).collect()}
    for k, g in pdf.groupby("k")["x"]:
        for name, q in (("lo", 0.1), ("med", 0.5), ("hi", 0.93)):
            assert abs(got[k][f"x_{name}"] - g.quantile(q)) < 1e-9


def test_mode_of_large_values(spark):
    from behaviorkit.operators.features import value_profile
    df = spark.createDataFrame([(1, 10**15), (1, 10**15), (1, 5), (1, 5), (1, -7), (2, -(10**12))], "k int, v long")
    r = {x["k"]: x for x in value_profile(df, "k", {"p": "v"}).collect()}
    assert (r[1]["p_mode"], r[1]["p_mode_count"], r[1]["p_nunique"]) == (5, 2, 3) and r[2]["p_mode"] == -(10**12)


def test_no_score_is_no_class(spark):
    nan = float("nan")
    df = spark.createDataFrame([([nan, 0.2, 0.7],), ([nan, nan, nan],), ([None, None, None],)], "p array<double>")
    codes = F.array(F.lit(0), F.lit(1), F.lit(2))
    r = [tuple(x) for x in df.select(dec.argmax_code(F.col("p"), codes), dec.argmax_concat(F.col("p"), codes)).collect()]
    assert r == [(2, "L2"), (None, ""), (None, "")]


def test_strip_and_folder_of_vocabulary_files(spark, tmp_path):
    (tmp_path / "b.txt").write_text("b\n\u3000c\u00a0\n", encoding="utf-8")
    (tmp_path / "a.txt").write_text("a\x1c\nb \n", encoding="utf-8")
    v = tk.read_vocabulary(spark, str(tmp_path))
    assert sorted((r["token_id"], r["token"]) for r in v.collect()) == [(0, "a"), (1, "b"), (2, "c")]


def test_windows_lose_no_token(spark):
    df = spark.createDataFrame([("t", "1", list(range(10, 21))), ("t", "2", []), ("t", "3", [7, 8, 9, 6])], "task string, id string, tokens array<int>")
    w = tk.encode_windows(df, maxlen=4).orderBy("id", "window").collect()
    assert [(r["id"], r["window"], r["x1"]) for r in w] == [
        ("1", 0, [3, 10, 11, 12, 13, 4]), ("1", 1, [3, 14, 15, 16, 17, 4]), ("1", 2, [3, 18, 19, 20, 4]), ("2", 0, [3, 4]), ("3", 0, [3, 7, 8, 9, 6, 4])]


def test_files_written_by_pandas(spark, tmp_path):
    import pandas as pd
    from behaviorkit.sources import files
    pdf = pd.DataFrame({"id": ["1", "2", "3"], "content": ['say ""hi"", ok', 'a "quoted", comma\tand tab', "two\nlines"], "label": ["x", "y", "z"]})
    pdf.to_csv(tmp_path / "a.csv", index=False)
    pdf.to_csv(tmp_path / "a.tsv", index=False, header=False, sep="\t")
    want = [tuple(r) for r in pdf.itertuples(index=False)]
    csv = files.read_csv_table(spark, str(tmp_path / "a.csv"), "id string, content string, label string", multi_line=True)
    tsv = files.read_task_tsv(spark, str(tmp_path / "a.tsv"), ["id", "content", "label"], multi_line=True)
    assert sorted(map(tuple, csv.collect())) == want and sorted(map(tuple, tsv.collect())) == want
    files.write_csv(tsv, str(tmp_path / "out"), single_file=True)
    back = pd.concat(pd.read_csv(p, dtype=str) for p in (tmp_path / "out").glob("*.csv"))
    assert sorted(tuple(r) for r in back.itertuples(index=False)) == want
    (tmp_path / "bad.tsv").write_text("1\ta\tx\n2\tonly two\n", encoding="utf-8")
    rows = files.read_task_tsv(spark, str(tmp_path / "bad.tsv"), ["id", "content", "label"], corrupt="raw").collect()
    assert [(r["id"], r["raw"]) for r in sorted(rows)] == [("1", None), ("2", "2\tonly two")]


def test_checkpoint_folder_must_be_shared():
    from types import SimpleNamespace
    import pytest
    from behaviorkit.session import checkpoint_dir
    conf = SimpleNamespace(get=lambda *a: None)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: conf, master="spark://host:7077")
    with pytest.raises(ValueError):
        checkpoint_dir(SimpleNamespace(sparkContext=sc, conf=conf))


def test_windows_of_characters_encode_as_the_whole_text(spark):
    texts = ["", "a\n 😀b" * 30, "x" * 512, "y" * 257]
    corpus = spark.createDataFrame([("t", str(i), t) for i, t in enumerate(texts)], "task string, id string, content string")
    assert [r["c"] for r in corpus.select(tk.chars(F.col("content")).alias("c")).collect()] == [list(t) for t in texts]
    vocab = tk.char_vocabulary(corpus.where(F.col("id") != "3"))
    want = {(r["id"], r["window"]): r["x1"] for r in tk.encode_windows(tk.char_tokens(corpus, vocab)).collect()}
    parts = tk.text_windows(corpus).withColumn("_lut", tk.lookup_table(vocab).scalar())
    got = {(r["id"], r["window"]): r["x1"] for r in parts.withColumn("x1", tk.encode_part(F.col("part"), F.col("_lut"))).collect()}
    assert got == want and len(got) == 1 + 1 + 2 + 2


def test_argmax_broadcasts_its_dictionaries_and_batches_shuffle_text(spark):
    from behaviorkit.plans import all_queries
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = all_queries()["corpus_task_argmax"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [x for x in plan.splitlines() if "Join [task#" in x or "Join [pred_code#" in x]
    assert joins and all("BroadcastHashJoin" in x for x in joins)
    for name in ("batch_arrays", "padded_batches"):
        plan = all_queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        above = plan[:plan.index("Join")]
        assert "array_repeat" in above and "part#" in plan[plan.index("Join"):] and "x1#" not in plan[plan.index("Join"):]
