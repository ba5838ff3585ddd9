"""Hand-worked fixtures (FIXTURES.md section C) and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from statfold.functions import arrays, dates
from statfold.operators import evaluate, freq, gram, linear, rebalance, sampling, text
from statfold.operators.rouge import lcs_length
from statfold.session import scratch_path
from statfold.sources import files


def test_two_digit_years(spark):
    df = spark.createDataFrame([("05-Jan-85",), ("05-Jan-20",), ("31-Dec-68",), ("01-Jan-69",)], "s string")
    got = [r[0] for r in df.select(F.year(dates.parse_day_mon_yy("s"))).collect()]
    assert got == [1985, 2020, 2068, 1969]


def test_csv_na_tokens(spark):
    path = scratch_path(spark, "csv-fixture")
    lines = spark.createDataFrame([("id,name,score",), ("1,a,10",), ("2,NA,",), ('3,"",NA',), ("4,b,2.5",)], "v string")
    lines.coalesce(1).write.text(path)
    df = files.read_csv(spark, path)
    rows = {r["id"]: r for r in df.collect()}
    assert rows[2]["name"] is None and rows[2]["score"] is None
    assert rows[3]["name"] is None and rows[3]["score"] is None
    assert dict(df.dtypes)["score"] == "double" and dict(df.dtypes)["id"] == "bigint"


def test_dense_months_gap_single_empty(spark):
    df = spark.createDataFrame([("2020-01-15",), ("2020-01-20",), ("2020-04-02",)], "d string").select(
        F.to_timestamp("d").alias("ts"))
    out = freq.monthly_running(df, "ts").orderBy("period").collect()
    assert [r["n"] for r in out] == [2, 0, 0, 1] and [r["running"] for r in out] == [2, 2, 2, 3]
    single = freq.monthly_running(df.limit(1), "ts").collect()
    assert len(single) == 1
    empty = freq.monthly_running(df.where("false"), "ts").collect()
    assert empty == []


def test_text_fixtures(spark):
    df = spark.createDataFrame([("heyyyy!!!! ok",), ("  a b\tc  ",)], "t string")
    got = [r[0] for r in df.select(text.clean_prompt("t")).collect()]
    assert got[0] == "hey! ok"
    assert got[1] == "a b\tc"
    norm = spark.createDataFrame([("Héllo -----  World\r\n12 x 3b\tZ",)], "t string").select(
        text.normalize_contract("t")).first()[0]
    assert norm == "h llo world  x 3b z"


@pytest.mark.parametrize("n", [0, 509, 510, 511, 600])
def test_token_padding_lengths(spark, n):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(n)))], "id long, t string")
    vocab = text.build_vocabulary(docs, "t")
    enc = text.encode(docs, "id", "t", vocab, 512).first()
    ids, mask = enc["input_ids"], enc["attention_mask"]
    assert len(ids) == 512 and ids[0] == text.START_ID
    kept = min(n, 510)
    assert ids[kept + 1] == text.END_ID and sum(mask) == kept + 2
    assert arrays is not None


def test_last_n_short_arrays(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([],)], "a array<int>")
    assert [r[0] for r in df.select(arrays.last_n("a", 2)).collect()] == [[2, 3], []]


def test_roc_with_ties_and_one_class(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (1, 0.5), (0, 0.5)]
    df = spark.createDataFrame(rows, "y int, s double")
    auc = evaluate.auc(df, "y", "s").first()["auc"]
    # Mann-Whitney by hand: positives ranks with ties averaged
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    expect = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / (len(pos) * len(neg))
    assert auc == pytest.approx(expect)
    area = evaluate.curve_area(evaluate.roc_curve(df, "y", "s"), "fpr", "tpr").first()["area"]
    assert area == pytest.approx(expect)
    one = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, s double")
    assert evaluate.auc(one, "y", "s").first()["auc"] is None


def test_three_class_report_with_unpredicted_class(spark):
    rows = [(0, 0), (0, 1), (1, 1), (1, 1), (2, 1), (2, 0)]
    df = spark.createDataFrame(rows, "y int, p int")
    rep = {r["row"]: r for r in evaluate.classification_report(df, "y", "p").collect()}
    assert rep["2"]["precision"] == 0.0 and rep["2"]["recall"] == 0.0 and rep["2"]["f1"] == 0.0
    assert rep["accuracy"]["f1"] == pytest.approx(3 / 6)
    m = evaluate.averaged_scores(df, "y", "p").first()
    p = [0.5, 2 / 4, 0.0]
    r = [0.5, 1.0, 0.0]
    assert m["macro_precision"] == pytest.approx(sum(p) / 3)
    assert m["macro_f1_of_means"] == pytest.approx(2 * (sum(p) / 3) * (sum(r) / 3) / (sum(p) / 3 + sum(r) / 3))


def _xy(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = 1.0 + x @ np.array([0.5, -2.0, 0.25]) + rng.normal(scale=0.3, size=n)
    rows = [(float(a), float(b), float(c), float(t)) for (a, b, c), t in zip(x, y)]
    return spark.createDataFrame(rows, "a double, b double, c double, y double"), x, y


def test_ridge_and_lasso_against_closed_forms(spark):
    df, x, y = _xy(spark)
    m = gram.moments(df, ["a", "b", "c", "y"])
    xc, yc = x - x.mean(0), y - y.mean()
    for alpha in (0.1, 1.0, 10.0):
        b, _ = linear.ridge_from_moments(m, ["a", "b", "c"], "y", alpha)
        assert np.allclose(b, np.linalg.solve(xc.T @ xc + alpha * np.eye(3), xc.T @ yc))
    b, b0 = linear.lasso_from_moments(m, ["a", "b", "c"], "y", 0.05)
    # KKT conditions of (1/2n)||y - b0 - Xb||^2 + alpha |b|_1
    grad = xc.T @ (yc - xc @ b) / len(y)
    for g, bj in zip(grad, b):
        assert (abs(g - 0.05 * np.sign(bj)) < 1e-6) if bj != 0 else abs(g) <= 0.05 + 1e-9


def test_ols_collinear_and_constant_columns(spark):
    df, x, y = _xy(spark)
    df2 = df.withColumn("a2", F.col("a") * 2).withColumn("k", F.lit(3.0))
    coef, model, d, res = linear.ols(df2, "y", ["a", "b", "c", "a2", "k"])
    rows = {r["term"]: r for r in coef.collect()}
    def missing(v):
        return v is None or math.isnan(v)
    assert missing(rows["a2"]["coef"]) and missing(rows["k"]["coef"])  # aliased terms are NA, as in R
    ref, *_ = np.linalg.lstsq(np.column_stack([np.ones(len(y)), x]), y, rcond=None)
    assert rows["Intercept"]["coef"] == pytest.approx(ref[0]) and rows["b"]["coef"] == pytest.approx(ref[2])
    assert model.first()["df_model"] == 3


def test_fold_moments_merge_exactly(spark):
    df, x, y = _xy(spark, 200)
    folds = gram.moments_by(sampling.kfold(df.withColumn("id", F.monotonically_increasing_id()), "id", 5), ["a", "y"], "fold")
    total = gram.combine(list(folds.values()))
    one = gram.moments(df, ["a", "y"])
    assert np.allclose(total.comoment, one.comoment) and np.allclose(total.mean, one.mean)
    rest = total - folds[0]
    assert rest.n == total.n - folds[0].n


def test_exact_split_sizes_and_oversampling_invariants(spark):
    df = spark.range(0, 1001).withColumn("y", (F.col("id") % 5 == 0).cast("int"))
    s = sampling.exact_split(df, "id", 0.2, 7)
    assert s.where("split = 'test'").count() == math.ceil(0.2 * 1001)
    over = rebalance.oversample_minority(df, "y", "id", 1600, 42)
    assert over.count() == 1600 and over.where("draw IS NULL").count() == 1001
    assert over.where("draw IS NOT NULL AND y = 0").count() == 0


def test_lcs_bit_parallel():
    def dp(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]
    rng = np.random.default_rng(1)
    for _ in range(30):
        a = list(rng.integers(0, 5, rng.integers(0, 40)))
        b = list(rng.integers(0, 5, rng.integers(0, 40)))
        assert lcs_length(a, b) == dp(a, b)


@pytest.mark.parametrize("chunk", [3, 4096])
def test_duplicated_rows_chunked(spark, chunk):
    from statfold.operators.clean import duplicated_rows
    rows = [("a", 1)] * 10 + [("b", 2)] * 2 + [("c", 3)] + [(None, 4)] * 3
    df = spark.createDataFrame(rows, "k string, v int")
    got = sorted((r["k"] or "", r["v"]) for r in duplicated_rows(df, chunk).collect())
    assert got == sorted([("a", 1)] * 9 + [("b", 2)] + [("", 4)] * 2)


def test_curve_area_stitches_partitions(spark):
    rng = np.random.default_rng(7)
    xs = np.sort(rng.random(3000))
    ys = rng.random(3000)
    pts = spark.createDataFrame([(float(i), float(a), float(b)) for i, (a, b) in enumerate(zip(xs, ys))],
                                "threshold double, x double, y double").repartition(6)
    spark.conf.set("spark.statfold.rangePartitions", "11")
    try:
        got = evaluate.curve_area(pts, "x", "y", [F.col("threshold")]).first()["area"]
    finally:
        spark.conf.unset("spark.statfold.rangePartitions")
    assert got == pytest.approx(float(np.sum((xs[1:] - xs[:-1]) * (ys[1:] + ys[:-1]) / 2)))


def test_spread_only_under_split_inputs(spark):
    from statfold.sources.tables import spread, table
    slots = spark.sparkContext.defaultParallelism
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert docs.rdd.getNumPartitions() >= slots
    assert docs.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    wide = spark.range(0, 1000, numPartitions=slots * 2)
    assert spread(wide) is wide
