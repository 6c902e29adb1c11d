import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tiltwise.functions.columns import col, normal_cdf
from tiltwise.operators import distributed, local, sampling
from tiltwise.operators.measures import auroc, max_smd, measures, smd, smd_sets
from tiltwise.operators.optimizers import AdamSoftmax, ConvexOptimizer, DualSGD, ExponentiatedGradient, ReweightSettings, TunedExponentiatedGradient, reweight_by_means, solve_entropy, standardise
from tiltwise.operators.profile import profile
from tiltwise.operators.summary import block_means, log_frame, summarise, top_features, union_sections
from tiltwise.operators.transform import fit_transform, normalise
from tiltwise.sources.simulate import high_dimensional, anchor_data, sample_published, sample_published_outcomes
from tiltwise.sources.tables import means_frame, read_csv, read_means, results_table, write_csv


def problem(seed=1, n=400, m=4, binary=False):
    rng = np.random.default_rng(seed)
    z = (rng.random((n, m)) < 0.4).astype(float) if binary else rng.normal(size=(n, m))
    w = np.exp(z @ rng.normal(size=m) * 0.5)
    return z, w @ z / w.sum()


# Optimizers ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("binary", [False, True])
def test_tuned_gradient_meets_the_means(binary):
    z, mu = problem(binary=binary)
    r = TunedExponentiatedGradient().optimize(z, mu)
    assert r.status == "Success" and r.weights.mean() == pytest.approx(1) and (r.weights > 0).all()
    assert np.abs(r.weights @ z / len(z) - mu).max() < 1e-3
    assert r.iterations >= len(r.log)


def test_direct_and_tilt_form_agree():
    z, mu = problem(2, 500, 6)
    w, v, theta, u = np.full(500, 1 / 500), np.zeros(500), np.zeros(6), np.zeros(6)
    for _ in range(100):
        rest = z.T @ w - mu
        v = 0.9 * v + z @ rest
        w = w * np.exp(-0.1 * v)
        w /= w.sum()
        u = 0.9 * u + rest
        theta = theta + u
    tilt = np.exp(-0.1 * z @ theta)
    assert np.abs(500 * (tilt / tilt.sum() - w)).max() < 1e-10
    r = ExponentiatedGradient(0.1, 101, 0, max_abs_tol=0).optimize(z, mu)
    assert np.abs(r.weights / 500 - w).max() < 1e-12


def test_counts_stand_for_repeated_rows():
    z, mu = problem(3, 60, 3)
    counts = np.arange(60) % 4 + 1
    for optimizer in (TunedExponentiatedGradient(), ConvexOptimizer(0.01)):
        a, b = optimizer.optimize(z, mu, counts), optimizer.optimize(np.repeat(z, counts, axis=0), mu)
        assert np.abs(np.repeat(a.weights, counts) - b.weights).max() < 1e-5


def test_too_large_rates_overflow():
    z, mu = problem(4)
    assert ExponentiatedGradient(1e6, 50).optimize(z * 100, mu + 50).status == "NA-objective"
    r = TunedExponentiatedGradient(alphas=(1e6,)).optimize(z * 100, mu + 50)
    assert r.status in ("Failure", "Not-converged")


def test_outcome_anchor_and_warm_start():
    z, mu = problem(5, binary=True)
    plain = TunedExponentiatedGradient().optimize(z, mu)
    anchored = TunedExponentiatedGradient(outcome_column=0, anchor_outcome=True).optimize(z, mu)
    assert anchored.status == "Success"
    again = TunedExponentiatedGradient().with_initial(plain).optimize(z, mu)
    assert again.iterations <= plain.iterations


def test_entropy_dual_is_the_optimum_of_its_primal():
    z, mu = problem(6, 80, 3)
    lam, ones = 0.05, np.ones(80)
    w, nu, good = solve_entropy(z, mu, ones, lam)
    assert good and np.linalg.norm(nu) <= 1 / lam + 1e-8

    def primal(v):
        return np.linalg.norm(z.T @ v - mu) + lam * (v * np.log(v)).sum()

    rng, best = np.random.default_rng(1), primal(w)
    for _ in range(300):
        v = w * np.exp(rng.normal(size=80) * rng.choice([1e-3, 1e-2, 1e-1]))
        assert primal(v / v.sum()) >= best - 1e-9


@pytest.mark.parametrize("divergence", ["entropy", "chi2"])
@pytest.mark.parametrize("distance", ["l1", "l2"])
def test_primal_is_a_minimum(divergence, distance):
    z, mu = problem(7, 60, 3)
    lam = 0.05 if divergence == "entropy" else 3.0
    r = reweight_by_means(z, mu, ReweightSettings(divergence, lam, distance=distance, method="primal"))
    assert r.status == "Success"
    zs, ms = standardise(z, mu, np.ones(60), 1e-4)

    def primal(v):
        rest = zs.T @ v - ms
        far = np.abs(rest).sum() if distance == "l1" else np.linalg.norm(rest)
        return far + lam * ((v * np.log(np.maximum(v, 1e-300))).sum() if divergence == "entropy" else ((v - 1 / 60) ** 2).sum())

    w = r.weights / 60
    rng, best = np.random.default_rng(1), primal(w)
    for _ in range(300):
        v = np.maximum(w + rng.normal(size=60) * rng.choice([1e-6, 1e-5, 1e-4]), 0)
        assert primal(v / v.sum()) >= best - 2e-6


def test_infeasible_means_fail():
    z, _ = problem(8)
    far = np.full(4, 50.0)
    assert reweight_by_means(z, far, ReweightSettings(lam=0.0)).status == "Failure"
    assert reweight_by_means(z, far, ReweightSettings("chi2", 0.0, method="primal")).status == "Failure"
    assert np.isnan(reweight_by_means(z, far, ReweightSettings(lam=0.0)).weights).all()
    with pytest.raises(ValueError):
        ReweightSettings("gini")


def test_sgd_and_adam_come_near():
    z, mu = problem(9, 2000, 3, binary=True)
    r = DualSGD(batch=500, n_iter=3000, improve_th=1e-3).optimize(z, mu)
    assert r.status == "Success" and np.abs(r.weights @ z / len(z) - mu).max() < 0.1
    assert DualSGD(batch=500, n_iter=3000, improve_th=1e-3, schedule="exponential").optimize(z, mu).status == "Success"
    a = AdamSoftmax(n_iter=1000, max_success_mse=1e-3).optimize(z, mu)
    assert a.status == "Success"


def test_adam_goes_on_at_half_the_rate_where_it_circles_the_optimum():
    z = np.array([(y, d / 100, r) for y in (0, 1) for d in range(11) for r in (0, 1)], float)
    counts = np.random.default_rng(14).integers(500, 3000, len(z)).astype(float)
    mu = counts @ z / counts.sum() + np.array([0.09, 0.0002, 0.002])
    for order in (np.arange(44), np.arange(44)[::-1], np.random.default_rng(1).permutation(44)):
        assert AdamSoftmax().optimize(z[order], mu, counts[order]).status == "Success"


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 5))
def test_weights_are_positive_with_mean_one(seed, m):
    z, mu = problem(seed, 150, m)
    r = TunedExponentiatedGradient(n_iter=500).optimize(z, mu)
    assert (r.weights > 0).all() and r.weights.mean() == pytest.approx(1)
    assert r.max_abs_err < 0.05


def test_newton_over_a_table(spark):
    z, mu = problem(10, 300, 4)
    df = spark.createDataFrame([tuple(map(float, r)) for r in z], "a double, b double, c double, d double").repartition(5)
    theta, r = distributed.newton_tilt(df, dict(zip("abcd", mu, strict=True)), list("abcd"))
    w, nu, _ = solve_entropy(z, mu, np.ones(300), 0.0)
    assert r.status == "Success" and r.iterations < 25 and np.abs(theta - nu).max() < 1e-5
    rows = distributed.tilt_weights(df, list("abcd"), theta).toPandas()
    assert rows.w.mean() == pytest.approx(1) and abs((rows.w * rows.a).mean() - mu[0]) < 1e-6


# Measures -----------------------------------------------------------------------------------------------------------------


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.sampled_from([0.0, 0.1, 0.5, 0.9, 1.0]), st.floats(0.1, 5)), min_size=2, max_size=30))
def test_local_auroc_counts_pairs(rows):
    y, p, w = (np.array(c) for c in zip(*rows, strict=True))
    pairs = [(wi * wj, 1.0 if pi > pj else 0.5 if pi == pj else 0.0) for yi, pi, wi in rows if yi for yj, pj, wj in rows if not yj]
    got = local.weighted_auroc(y, p, w)
    if pairs:
        assert got == pytest.approx(sum(a * b for a, b in pairs) / sum(a for a, _ in pairs))
        assert local.weighted_auroc(y, p**3, w * 7) == pytest.approx(got)
    else:
        assert math.isnan(got)


def test_measures_over_a_table_equal_local_ones(spark):
    rng = np.random.default_rng(1)
    y, p, w = (rng.random(500) < 0.3).astype(int), np.round(rng.random(500), 2), rng.random(500) * 3
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(y, p, w, strict=True)], "y int, p double, w double").repartition(4)
    got, want = measures(df, w="w").first(), local.measures(y, p, w)
    assert [got[c] for c in ("auroc", "brier", "mean_prediction", "observed_risk")] == pytest.approx(list(want.values()))
    one_class = measures(df.where("y = 0")).first()
    assert one_class["auroc"] is None and one_class["brier"] is None and one_class["n_outcome"] == 0
    assert auroc(df.where("false"), col("y"), col("p")).first()["auroc"] is None


def test_mean_differences(spark):
    z = spark.createDataFrame([(0.0, 1.0, 1.0, 2.0), (1.0, 2.0, 4.0, 2.0), (1.0, 3.0, 9.0, 2.0)], "b double, x double, x2 double, c double")
    got = {r.feature: r.smd for r in smd(z, {"b": 0.5, "x": 1.0, "x2": 2.0, "c": 2.0}, [("b",), ("x", "x2"), ("c",), ("b", "x", "x2")]).collect()}
    assert got["b"] == pytest.approx((2 / 3 - 0.5) / math.sqrt(0.25 + 2 / 9))
    assert got["x"] == pytest.approx(1 / math.sqrt(1 + (14 / 3 - 4)))
    assert got["c"] == pytest.approx(0) and "b,x" not in got
    assert max_smd(z, {"b": 2.0}, [("b",)]) == math.inf
    local_value = local.max_smd({"b": np.array([0, 1, 1.0])}, {"b": 0.5}, [("b",)], np.ones(3))
    assert local_value == pytest.approx(got["b"])


# Transforms and profiles --------------------------------------------------------------------------------------------------


def test_transform_names_and_one_fit_for_both_sides(spark):
    df = spark.createDataFrame([(0, 1.0, 0, "u"), (1, 2.0, 1, "v"), (1, 3.0, 1, "w")], "Y int, a double, b int, s string")
    spec = fit_transform(df, "Table 1")
    assert spec.names == ["Y", "a:y1", "b:y1", "s:y1", "(a^2):y1", "(s^2):y1", "a:y0", "b:y0", "s:y0", "(a^2):y0", "(s^2):y0"]
    assert [tuple(r) for r in spec.apply(df.limit(3)).collect()][2] == (1.0, 3.0, 1.0, 2.0, 9.0, 4.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    other = spec.apply(spark.createDataFrame([(0, 5.0, 0, "u")], df.schema))
    assert other.columns == spec.names
    assert ("a:y1", "(a^2):y1") in smd_sets(spec) and ("Y",) in smd_sets(spec)
    two = fit_transform(df.drop("s"), "Interaction", interactions=["a", "b"])
    assert len({frozenset(t.factors) for t in two.terms if t.stratum == 1}) == sum(t.stratum == 1 for t in two.terms)
    assert fit_transform(df.drop("s"), "anything").names[:2] == ["Y", "I(Y):a"]


def test_transform_of_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (1, 3.0)], "Y int, a double")
    spec = fit_transform(df)
    df.write.parquet(str(tmp_path / "in"))
    stream = spec.apply(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("transformed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("transformed").count() == 3 and spark.table("transformed").columns == spec.names


def test_profile_of_odd_columns(spark):
    df = spark.createDataFrame([(None, float("nan"), 1.0, 0), (1.0, 2.0, 1.0, 1), (None, 3.0, 1.0, 0)], "a double, b double, c double, d int")
    p = profile(df)
    assert [p[c].arity for c in "abcd"] == [2, 3, 1, 2] and [p[c].missing for c in "abcd"] == [2, 1, 0, 0]
    assert p["d"].zero_one and not p["b"].zero_one and p["d"].at_high == 1
    empty = profile(df.where("false"))
    assert empty["a"].arity == 0 and empty["a"].low is None


def test_profile_by_counts_is_that_of_all_rows(spark):
    rows = [(1e9 + 0.25, None, 1.0), (1e9 + 0.75, None, 0.0), (1e9 + 0.75, 2.0, 0.0), (1e9, float("nan"), 1.0)]
    times = [3, 1, 4, 2]
    merged = spark.createDataFrame([(*r, n) for r, n in zip(rows, times)], "a double, b double, c double, n long")
    own, all_rows = profile(merged, ["a", "b", "c"], "n"), profile(spark.createDataFrame([r for r, n in zip(rows, times) for _ in range(n)], "a double, b double, c double"))
    for c, p in all_rows.items():
        assert (own[c].count, own[c].missing, own[c].low, own[c].high, own[c].arity, own[c].at_high, own[c].zero_one) == (p.count, p.missing, p.low, p.high, p.arity, p.at_high, p.zero_one)
        assert own[c].mean == pytest.approx(p.mean, rel=1e-15) and own[c].sd == pytest.approx(p.sd, rel=1e-6)
    single, empty = profile(merged.where("n = 1"), ["a", "b"], "n"), profile(merged.where("false"), ["a"], "n")["a"]
    assert single["a"].sd is None and single["b"].mean is None and empty.count == 0 and empty.sd is None and empty.low is None


def test_normalise_drops_constant_columns(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("x"), F.lit(2.0).alias("k"))
    z, mu, moments = normalise(df, {"x": 4.5, "k": 2.0})
    assert z.columns == ["x"] and mu == {"x": 0.0} and moments["x"][0] == 4.5


def test_normal_cdf(spark):
    got = spark.createDataFrame([(0.0,), (1.96,)], "x double").select(normal_cdf("x").alias("p")).collect()
    assert got[0].p == 0.5 and got[1].p == pytest.approx(0.975, abs=1e-4)


# Sampling and summaries ---------------------------------------------------------------------------------------------------


def test_stratified_sizes():
    assert sampling.stratified_sizes(900, 100, 400) == (300, 100)
    assert sampling.stratified_sizes(100, 900, 400) == (100, 300)
    assert sampling.stratified_sizes(900, 900, 401) == (200, 201)
    assert sampling.stratified_sizes(50, 50, 400) == (50, 50)
    assert [sampling.sampling_mode(100, n, s) for n, s in ((74, True), (74, False), (75, True))] == ["stratified", "subset", "bootstrap"]


def test_samples_have_exact_sizes_and_repeat(spark):
    df = sampling.with_row_id(spark.range(1000).withColumn("y", (F.col("id") % 10 == 0).cast("int")).repartition(7)).persist()
    assert sorted(r.row_id for r in df.select("row_id").collect()) == list(range(1000))
    for draw in (lambda: sampling.bootstrap(df, 300, 3), lambda: sampling.subset(df, 300, 3), lambda: sampling.stratified(df, "y", 300, 3)):
        one, two = draw(), draw()
        assert {r.rep: r.n for r in one.groupBy("rep").agg(F.sum("mult").alias("n")).collect()} == {0: 300, 1: 300, 2: 300}
        assert one.exceptAll(two).count() == 0
    assert sampling.bootstrap(df.where("false"), 5, 1).count() == 0
    assert sampling.upsample(df, "y").where("y = 1").count() == 900
    assert sampling.shuffle(df, 1, "row_id").count() == 1000


def test_summary(spark):
    values = [0.1, 0.2, 0.4, None, float("nan")]
    df = spark.createDataFrame([(i, "a", v) for i, v in enumerate(values)] + [(0, "b", -1.5), (0, "c", 0.3)], "rep int, metric string, value double")
    got = {r.metric: r for r in summarise(df).collect()}
    logs = np.log1p([0.1, 0.2, 0.4])
    assert got["a"].lower == pytest.approx(np.exp(logs.mean() - 1.96 * logs.std(ddof=1)) - 1)
    assert got["a"].median == 0.2 and got["a"].n == 3 and "b" not in got and got["c"].sd is None
    assert union_sections({"x": spark.createDataFrame([("f", 1.0)], "field string, value double")}).columns == ["section", "field", "value_num", "value_str"]
    log = spark.createDataFrame([(i, float(i)) for i in range(1, 7)], "iter int, err double")
    assert [r.err for r in block_means(log, 3).orderBy("block").collect()] == [2.0, 5.0]
    z, mu = problem()
    r = TunedExponentiatedGradient().optimize(z, mu)
    assert log_frame(spark, r.log).columns == ["iter", "primal_objective", "kl", "max_abs_err"] and log_frame(spark, r.log).count() == len(r.log)
    coefficients = spark.createDataFrame([("a", 0.1), ("b", -3.0), ("c", 2.0)], "feature string, coefficient double")
    assert [r.feature for r in top_features(coefficients, 2).collect()] == ["b", "c"]


# Sources ------------------------------------------------------------------------------------------------------------------


def test_tables_in_and_out(spark, tmp_path):
    mu = {"a:y1": 0.25, "b": None}
    write_csv(means_frame(spark, mu), str(tmp_path / "mu"))
    assert read_means(read_csv(spark, str(tmp_path / "mu"), "feature string, mu double")) == mu
    one, two = (spark.createDataFrame([(f, v)], "field string, value double") for f, v in (("x", 1.0), ("y", 2.0)))
    assert sorted(tuple(r) for r in results_table({"one": one, "two": two}).collect()) == [("x", 1.0, None), ("y", None, 2.0)]


def test_models(spark, tmp_path):
    from pyspark.ml.classification import DecisionTreeClassificationModel

    from tiltwise.operators import models

    df = spark.range(400).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"), (F.col("id") % 7 > 3).cast("int").alias("Y"), F.lit(1.0).alias("w"))
    fitted = [models.logistic(df, "Y", ["a", "b"], "w"), models.tree(df, "Y", ["a", "b"], "w"), models.boosted(df, "Y", ["a", "b"], "w", trials=1, folds=2), models.network(df, "Y", ["a", "b"], hidden=4)]
    for m in fitted:
        assert models.auc(m, df, "Y") > 0.9 and m.predict(df).columns == ["a", "b", "Y", "w", "p"]
    assert fitted[1].important(spark, 1).first().feature == "a"
    fitted[1].save(str(tmp_path / "tree"))
    again = models.load_model(DecisionTreeClassificationModel, str(tmp_path / "tree"), ["a", "b"])
    assert again.predict(df).exceptAll(fitted[1].predict(df)).count() == 0


def test_simulators(spark):
    data = anchor_data(spark, 300, high_dimensional(20, -1.0, 15), seed=2)
    d = data["internalTest"]
    assert d.columns == [*[f"X{j + 1}" for j in range(20)], "Y"] and d.count() == 300
    assert {r[0] for r in d.select("X20").distinct().collect()} <= {0.0, 1.0}
    table = {"n": 4000, "%": 100, "gender = MALE": 40, "age group 1": 20, "age group 2": 30, "age group 3": 50, "ill": 10}
    got = sample_published(spark, table, 1, 5, {"ill": 3.0})
    m = got.agg(F.avg("gender"), F.avg("age group 1"), F.avg("ill"), F.avg(F.when(F.col("gender") == 1, F.col("ill"))), F.avg(F.when(F.col("gender") == 0, F.col("ill")))).first()
    assert m[0] == pytest.approx(0.4, abs=0.03) and m[1] == pytest.approx(0.2, abs=0.03) and m[2] == pytest.approx(0.1, abs=0.02) and m[3] > 2 * m[4]
    assert got.columns == ["gender", "age group 1", "age group 2", "ill", "Y"]
    assert sample_published_outcomes(spark, table, table, 1).groupBy("Y").count().count() == 2
