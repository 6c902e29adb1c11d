"""Solvers, repetitions and resamples over tables against the same on arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tiltwise.functions.columns import col
from tiltwise.operators import distributed, local, resample, sampling, vectors
from tiltwise.operators.optimizers import AdamSoftmax, ConvexOptimizer, DualSGD, ExponentiatedGradient, Tilt, TunedExponentiatedGradient, answer_all
from tiltwise.operators.sampling import uniform
from tiltwise.operators.summary import log_frame
from tiltwise.operators.transform import fit_transform
from tiltwise.plans.estimate import EstimatorSettings, different_rows, estimate_external, estimate_internal, run_repetitions, solve_whole

MU = {"a": 0.5, "b": 0.45, "x": 0.6}


@pytest.fixture(scope="module")
def rows(spark):
    u = lambda k: uniform(F.lit(k), F.col("id"))
    a, b = F.when(u(1) < 0.4, 1.0).otherwise(0.0), F.when(u(2) < 0.5, 1.0).otherwise(0.0)
    x = F.floor(u(3) * 20) / 20
    y = F.when(u(4) < 0.2 + 0.5 * x, 1.0).otherwise(0.0)
    out = spark.range(3000).select(a.alias("a"), b.alias("b"), x.alias("x"), y.alias("_y"), F.round(0.1 + 0.7 * x + 0.1 * b, 2).alias("_p"), (1 + F.floor(u(5) * 3)).cast("double").alias("w0")).repartition(3).persist()
    out.count()
    return out


def solved(found, name="w"):
    table = found.weights.toPandas()
    keys = sorted(c for c in table.columns if c not in (name, "_count"))
    table = table.sort_values(keys, ignore_index=True)
    return table[name].to_numpy(float), table["_count"].to_numpy(float)


@pytest.mark.parametrize("w0", [None, "w0"])
@pytest.mark.parametrize("columns", [["a", "b", "x"], ["a", "b"]])
def test_mse_on_a_table_equals_arrays(rows, w0, columns):
    z, mu = rows.select(*columns, "w0"), {c: MU[c] for c in columns}
    settings = TunedExponentiatedGradient(n_tune_iter=6, n_iter=12, max_success_mse=1.0)
    one = solve_whole(z, mu, settings, w0=w0)
    two = solve_whole(z, mu, settings, max_local=0, w0=w0)
    assert one.status == two.status == "Success" and one.iterations == two.iterations and len(one.log) == len(two.log)
    assert np.allclose(solved(one)[0], solved(two)[0], rtol=1e-7)
    assert np.allclose(np.array(one.log), np.array(two.log), rtol=1e-6, atol=1e-9)
    if w0:
        without = solve_whole(z, mu, settings)
        assert not np.allclose(solved(without)[0], solved(two)[0], rtol=1e-2)
        exact, limit = solve_whole(z, mu, w0=w0), solve_whole(z, mu, TunedExponentiatedGradient(), w0=w0)
        assert np.allclose(solved(exact)[0], solved(limit)[0], rtol=5e-3)
    assert log_frame(rows.sparkSession, two.log).count() == len(two.log)


def test_a_pass_has_no_more_tasks_than_its_different_rows_need(rows, monkeypatch):
    seen = []
    one_pass = distributed.add_up
    monkeypatch.setattr(distributed, "add_up", lambda table, block, merge, fan_in=None, parts=None: seen.append((table.rdd.getNumPartitions(), parts)) or one_pass(table, block, merge, fan_in, parts))
    z = rows.select("a", "b", "x").repartition(7)
    solve_whole(z, MU, TunedExponentiatedGradient(n_tune_iter=2, n_iter=2, max_success_mse=1.0), max_local=0)
    assert seen and {n for n, _ in seen} == {1} and 1 in {p for _, p in seen}


def counted(df):
    """``df`` and a number that grows by each of its rows that is read."""
    read = df.sparkSession.sparkContext.accumulator(0)

    def batches(frames):
        for f in frames:
            read.add(len(f))
            yield f

    return df.mapInPandas(batches, df.schema), read


@pytest.mark.parametrize("optimizer", [None, TunedExponentiatedGradient(n_tune_iter=2, n_iter=2, max_success_mse=1.0), ConvexOptimizer(lam=0.0, divergence="chi2", method="primal")])
def test_a_table_is_read_once(rows, optimizer):
    z, read = counted(rows.select("a", "b", "x"))
    solve_whole(z, MU, optimizer, max_local=0).weights.count()
    assert read.value == 3000


def test_runs_share_different_rows(rows):
    z, read = counted(rows.select("a", "b", "x", "w0"))
    shared = different_rows(z).withColumnRenamed("_count", "times")
    settings = TunedExponentiatedGradient(n_tune_iter=6, n_iter=12, max_success_mse=1.0)
    for optimizer, most in ((settings, 50_000), (settings, 0), (None, 0)):
        found = solve_whole(shared, MU, optimizer, most, w0="w0", count="times")
        alone = solve_whole(rows.select("a", "b", "x", "w0"), MU, optimizer, most, w0="w0")
        assert np.allclose(solved(found), solved(alone), rtol=1e-9)
    assert read.value == 3000


def test_initial_weights_query_reads_its_rows_twice(spark, monkeypatch):
    from tiltwise.plans import queries

    tables = []
    plain = queries.read_table
    monkeypatch.setattr(queries, "read_table", lambda *a: tables.append(counted(plain(*a))) or tables[-1][0])
    n = plain(spark, "/root/testdata/sf0.001", "lineitem").count()
    assert queries.QUERIES["eg_initial_weights"](spark, "/root/testdata/sf0.001").count() == 24
    assert sum(read.value for _, read in tables) == 2 * n  # once for the external means, once to merge equal rows


def test_top_coefficients_order_equal_sums_by_name(spark, tmp_path):
    from tiltwise.plans.queries import QUERIES

    lines = [(1, 0.1, 0.0), (1, 0.2, 0.0), (2, 0.3, 0.0)] + [(k, 0.5 + k / 100, 0.0) for k in range(3, 12)]  # 0.1 + 0.2 is above 0.3 in doubles
    spark.createDataFrame(lines, "l_partkey long, l_discount double, l_tax double").write.parquet(str(tmp_path / "lineitem.parquet"))
    names = [(1, "z"), (2, "a"), *((k, f"n{k}") for k in range(3, 12)), (11, "n11")]  # a part that comes twice counts twice
    spark.createDataFrame(names, "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    found = [tuple(r) for r in QUERIES["top_coefficients"](spark, str(tmp_path)).collect()]
    assert len(found) == 10 and found[0] == ("n11", 1.22) and found[-1] == ("a", 0.3)


def test_weights_that_do_not_fit_are_refused(rows):
    z = rows.select("a", "b", "w0")
    with pytest.raises(ValueError):
        solve_whole(z, MU, TunedExponentiatedGradient(w0=np.ones(3)))
    for optimizer in (ConvexOptimizer(), AdamSoftmax()):
        with pytest.raises(ValueError):
            solve_whole(z, MU, optimizer, w0="w0")


def test_anchor_on_a_table_equals_arrays(rows):
    z = rows.select("a", "b")
    settings = dict(outcome_column=0, anchor_outcome=True, n_tune_iter=3, n_iter=4, max_success_mse=1.0)
    for w0 in (None, "w0"):
        z = rows.select("a", "b", *([w0] if w0 else []))
        one, two = (solve_whole(z, {"a": 0.7, "b": 0.45}, TunedExponentiatedGradient(**settings), max_local=m, w0=w0) for m in (10**6, 0))
        assert np.allclose(solved(one)[0], solved(two)[0], rtol=1e-9)
        assert np.allclose(np.array(one.log), np.array(two.log), rtol=1e-7, atol=1e-12)
        assert one.log[0][2] < 0.1  # the start has the outcome's share


def sequential(optimizer, tilt):
    """Learning rates one after the other."""
    trials, total = [], 0
    for alpha in optimizer.alphas:
        trial = ExponentiatedGradient(alpha, optimizer.n_tune_iter, optimizer.abs_tol, optimizer.momentum, optimizer.max_abs_tol, optimizer.max_success_mse).solve(tilt)
        total += trial.iterations
        if trial.status == "NA-objective":
            break
        trials.append((trial.err, alpha, trial.theta))
        if trial.err < optimizer.abs_tol or trial.worst < optimizer.max_abs_tol:
            return trial.theta, total
    if not trials:
        return None, total
    _, alpha, theta = min(trials, key=lambda t: t[0])
    found = ExponentiatedGradient(alpha, optimizer.n_iter, optimizer.abs_tol, optimizer.momentum, optimizer.max_abs_tol, optimizer.max_success_mse).solve(tilt, theta)
    return found.theta, total + found.iterations


@pytest.mark.parametrize("alphas,scale", [((0.01, 0.1, 0.5), 1.0), ((0.1, 300.0, 0.2), 5.0), ((1e6, 0.1), 5.0), ((0.3, 0.05), 0.01), ((0.1, 0.5, 1e9), 0.05)])
def test_rates_side_by_side_end_as_one_after_the_other(alphas, scale):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(200, 3)) * scale
    tilt = Tilt(z, z.mean(axis=0) + 0.05 * scale, np.ones(200))
    for settings in (dict(n_tune_iter=20, n_iter=60), dict(n_tune_iter=200, n_iter=10)):
        optimizer = TunedExponentiatedGradient(alphas=alphas, **settings)
        found, want = optimizer.solve(tilt), sequential(optimizer, tilt)
        assert found.iterations == want[1]
        assert found.status == "Failure" if want[0] is None else np.array_equal(found.theta, want[0])


def test_one_pass_answers_all_that_is_asked(rows, monkeypatch):
    passes = []
    plain = distributed.many_sums
    monkeypatch.setattr(distributed, "many_sums", lambda *a, **k: passes.append(len(a[2])) or plain(*a, **k))
    found = solve_whole(rows.select("a", "x"), {"a": 0.45, "x": 0.5}, TunedExponentiatedGradient(n_tune_iter=6, n_iter=5, max_success_mse=1.0), max_local=0)
    assert found.status == "Success" and passes == [1] + [5] * 6 + [1] * 5 + [1]  # base, tuning, steps, weights


@pytest.mark.parametrize("optimizer", [
    ConvexOptimizer(lam=0.0), ConvexOptimizer(lam=0.1), ConvexOptimizer(lam=2.0), ConvexOptimizer(lam=3.0, distance="l1", method="primal"),
    ConvexOptimizer(lam=0.0, divergence="chi2", method="primal"), ConvexOptimizer(lam=3000.0, divergence="chi2", method="primal"), ConvexOptimizer(lam=9000.0, divergence="chi2", method="primal", distance="l1"),
])
@pytest.mark.parametrize("far", [0.0, 0.25])
def test_convex_problems_on_a_table_equal_arrays(rows, optimizer, far):
    z, mu = rows.select("a", "b", "x"), MU | {"x": MU["x"] + far}
    one, two = solve_whole(z, mu, optimizer), solve_whole(z, mu, optimizer, max_local=0)
    assert one.status == two.status == "Success"
    assert np.allclose(solved(one)[0], solved(two)[0], rtol=2e-3, atol=2e-3)
    if far and optimizer.by_squares and optimizer.lam == 0:
        assert (solved(two)[0] == 0).mean() > 0.05
        w, n = solved(two)
        table = two.weights.toPandas()
        assert all(abs(np.average(table[c], weights=table["w"] * table["_count"]) - mu[c]) < 1e-7 for c in mu)


def test_means_out_of_reach(rows):
    for optimizer in (None, ConvexOptimizer(lam=0.0), ConvexOptimizer(lam=0.0, divergence="chi2", method="primal")):
        found = solve_whole(rows.select("a", "x"), {"a": 0.5, "x": 3.0}, optimizer, max_local=0)
        assert found.status == "Failure" and found.table is None


def test_batches_of_a_table_are_partitions_of_it(rows):
    small = distributed.compress(rows.select("a", "x"))
    tilt = distributed.TableTilt(small, {"a": 0.45, "x": 0.5}, ["a", "x"], "_count")
    gap = tilt.batches(500, 1)
    stored = tilt.stored[0].table.toPandas()
    assert stored["_some"].sum() == 3000 and sorted(stored["_bucket"].unique()) == list(range(6))
    sizes = stored.groupby("_bucket")["_some"].sum()
    assert sizes.min() > 350 and sizes.max() < 650
    theta = np.array([0.3, -0.2])
    found = [gap(i, theta) for i in range(12)]
    want = []
    for b in range(6):
        own = stored[stored["_bucket"] == b]
        w = own["_some"] * np.exp(-(own[["a", "x"]].to_numpy() @ theta))
        want.append((own[["a", "x"]].to_numpy() * (w / w.sum()).to_numpy()[:, None]).sum(axis=0) - tilt.mu)
    for epoch in (found[:6], found[6:]):  # each batch once in an epoch
        assert np.allclose(sorted(map(tuple, epoch)), sorted(map(tuple, want)))
    assert any(not np.allclose(a, b) for a, b in zip(found[:6], found[6:], strict=True))
    tilt.drop()


def test_sgd_on_a_table(rows):
    z, mu = rows.select("a", "b"), {"a": 0.45, "b": 0.45}
    found = solve_whole(z, mu, DualSGD(epsilons=(0.3,), n_tune_iter=5, n_iter=40, batch=700, improve_th=1e-4), max_local=0)
    assert found.status == "Success"
    exact, _ = solved(solve_whole(z, mu))
    assert np.allclose(solved(found)[0], exact, atol=0.05)
    whole = [solve_whole(z, mu, DualSGD(epsilons=(0.3,), n_tune_iter=5, n_iter=20, batch=1 << 40, improve_th=1e-12, max_halvings=1), max_local=m) for m in (0, 10**6)]
    assert np.allclose(whole[0].err, whole[1].err, rtol=1e-6) and np.allclose(np.array(whole[0].log[:3])[:, :3], np.array(whole[1].log[:3])[:, :3], rtol=1e-6)


@pytest.mark.parametrize("parameterisation", ["log", "id"])
def test_adam_on_a_table_equals_arrays(rows, parameterisation):
    z, mu = rows.select("a", "b", "x"), MU | {"x": 0.5}
    optimizer = AdamSoftmax(rates=(0.01, 0.1), n_tune_iter=4, n_iter=9, parameterisation=parameterisation, max_success_mse=1.0)
    one, two = solve_whole(z, mu, optimizer), solve_whole(z, mu, optimizer, max_local=0)
    assert one.status == two.status == "Success" and one.iterations == two.iterations
    assert one.err == pytest.approx(two.err, rel=1e-8) and np.allclose(solved(one)[0], solved(two)[0], rtol=1e-7)
    from tiltwise.operators.rowstate import adam_weights

    table = distributed.compress(z).withColumn("_z", F.array("a", "b", "x"))
    by_keep = [adam_weights(optimizer, table, np.array([mu[c] for c in "abx"]), "w", keep=k) for k in (1, 3, 100)]
    assert len({round(r[2], 12) for r in by_keep}) == 1  # generations change nothing


def test_adam_halves_its_rate_on_a_table_as_on_arrays(rows):
    z, mu = rows.select("a", "b", "x"), MU | {"x": 0.5}
    settings = dict(rates=(0.01, 0.1), n_tune_iter=3, n_iter=4, abs_tol=0.0, max_success_mse=0.0)
    short, one, two = solve_whole(z, mu, AdamSoftmax(**settings, max_halvings=0)), solve_whole(z, mu, AdamSoftmax(**settings, max_halvings=2)), solve_whole(z, mu, AdamSoftmax(**settings, max_halvings=2), max_local=0)
    assert short.iterations == 10 and one.iterations == two.iterations == 18
    assert one.status == two.status == "Not-converged" and one.err == pytest.approx(two.err, rel=1e-8)


# Repetitions and resamples ------------------------------------------------------------------------------------------------


class Draws:
    """A user's sampler: thirds of the rows by their ids, the first of them twice."""

    def draw(self, rows, n):
        third = rows.withColumn("rep", (F.col("row_id") % 3).cast("int"))
        return third.withColumn("mult", F.when(F.col("rep") == 0, 2).otherwise(1).cast("long"))


def test_a_task_gets_different_rows_alone(rows, monkeypatch):
    """As many rows as there are stand in no group: equal ones are added up before."""
    from tiltwise.plans import estimate

    samples = Draws().draw(sampling.with_row_id(rows.select("_y", "_p", "a")), 3000)
    counted = estimate.merged(samples, ["a"])
    assert counted.count() == samples.select("rep", "_y", "_p", "a").distinct().count() < 1000 < samples.count()
    assert counted.agg(F.sum("mult")).first()[0] == samples.agg(F.sum("mult")).first()[0]
    monkeypatch.setattr(estimate.vectors, "run_vectors", lambda *_: pytest.fail("different rows fit a task"))
    quick = TunedExponentiatedGradient(n_tune_iter=4, n_iter=6, max_success_mse=1.0)
    z = rows.select(F.col("_y").alias("y"), F.col("_p").alias("p"), "a", "b")
    found = estimate.estimate_external(z, {"a": 0.5, "b": 0.45}, EstimatorSettings(quick, n_repetitions=3, sampler=Draws(), max_task_rows=300, max_wsmd=1.0))
    assert found.status == "Success"


def test_numbering_rows_shuffles_none(rows):
    plan = sampling.with_row_id(rows.select("a", "b"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    drawn = sampling.bootstrap(sampling.with_row_id(rows.select("a", "b")), 3000, 2)
    assert "SortMergeJoin" not in drawn._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("columns,warm", [(["a", "b", "x"], False), (["a", "b"], False), (["a", "x"], True)])
def test_repetitions_on_one_table_equal_those_in_tasks(rows, columns, warm):
    mu = {c: MU[c] for c in columns}
    own = rows.select("_y", "_p", *columns, *([F.exp(F.col("a") * 0.4 - F.col("x")).alias("_w0")] if warm else []))
    numbered = sampling.with_row_id(own).persist()
    samples = Draws().draw(numbered, 3000).unionByName(Draws().draw(numbered, 3000).where("row_id < 30")).drop("row_id")  # some rows come twice
    sets = [(c,) for c in columns]
    optimizer = TunedExponentiatedGradient(alphas=(0.1, 0.3), n_tune_iter=6, n_iter=12, max_success_mse=1.0)
    one = {(r["rep"], r["metric"]): r["value"] for r in run_repetitions(samples, columns, mu, optimizer, sets, warm).collect()}
    two = {(r["rep"], r["metric"]): r["value"] for r in vectors.run_vectors(samples, columns, mu, optimizer, sets, 3, warm, per_task=7).collect()}
    assert set(one) == set(two) and len(one) == 3 * 12
    assert all(one[k] == pytest.approx(two[k], rel=1e-5, abs=1e-7) for k in one if k[1] != "Opt err")


def test_repetitions_without_both_classes_or_success(rows):
    own = rows.select("_y", "_p", "a").where("_y = 1").select(F.lit(0).alias("rep"), F.lit(1).cast("long").alias("mult"), "*")
    more = rows.select(F.lit(1).alias("rep"), F.lit(1).cast("long").alias("mult"), "_y", "_p", "a")
    bad = TunedExponentiatedGradient(n_tune_iter=2, n_iter=2, max_success_mse=1e-12)
    found = vectors.run_vectors(own.unionByName(more), ["a"], {"a": 0.6}, bad, [("a",)], 2).collect()
    assert {(r["rep"], r["metric"]) for r in found} == {(1, "Opt err"), (1, "n iter")}
    with pytest.raises(ValueError):
        vectors.run_vectors(more, ["a"], {"a": 0.6}, DualSGD(), [("a",)], 2)


def test_a_sampler_of_ones_own(rows):
    z = rows.select(F.col("_y").alias("y"), F.col("_p").alias("p"), "a", "b")
    mu = {"a": 0.5, "b": 0.45}
    quick = TunedExponentiatedGradient(alphas=(0.3,), n_tune_iter=6, n_iter=30, max_success_mse=1.0)
    for most in (10**6, 0):
        found = estimate_external(z, mu, EstimatorSettings(quick, n_repetitions=3, sampler=Draws(), max_task_rows=most, max_wsmd=1.0))
        assert found.status == "Success"
        got = {(r["rep"], r["metric"]): r["value"] for r in found.repetitions.collect()}
        assert [got[r, "n"] for r in range(3)] == [2000, 1000, 1000]


def test_large_bootstrap_repetitions(rows):
    z = rows.select(F.col("_y").alias("y"), F.col("_p").alias("p"), "a", "b")
    quick = TunedExponentiatedGradient(alphas=(0.3,), n_tune_iter=6, n_iter=30, max_success_mse=1.0)
    one, two = (estimate_external(z, {"a": 0.5, "b": 0.45}, EstimatorSettings(quick, n_repetitions=3, max_task_rows=m, max_wsmd=1.0)) for m in (100, 200_000))
    key = lambda e: {(r["rep"], r["metric"]): r["value"] for r in e.repetitions.collect()}
    a, b = key(one), key(two)
    assert one.status == two.status == "Success" and set(a) == set(b)
    assert all(a[k] == pytest.approx(b[k], rel=1e-5, abs=1e-7) for k in a if k[1] != "Opt err")


def test_large_repetitions_of_transformed_features(rows):
    raw = rows.select(F.col("_y").alias("y"), "x", "a", F.col("_p").alias("p"))
    spec = fit_transform(raw.select("y", "x", "a"), "Table 1", "y", ["x", "a"])
    z = spec.apply(raw.withColumn("_y0", F.col("y")), keep=["_y0", "p"])
    assert "(x^2):y1" in spec.names
    mu = {k: v * 1.03 for k, v in spec.means(raw).items()}
    quick = TunedExponentiatedGradient(alphas=(0.1,), n_tune_iter=3, n_iter=8, max_success_mse=10.0)
    one, two = (estimate_external(z, mu, EstimatorSettings(quick, n_repetitions=2, max_task_rows=m, max_wsmd=10.0), y="_y0", spec=spec) for m in (100, 200_000))
    a, b = ({(r["rep"], r["metric"]): r["value"] for r in e.repetitions.collect()} for e in (one, two))
    assert one.status == two.status == "Success" and set(a) == set(b) and len(a) == 24
    assert all(a[k] == pytest.approx(b[k], rel=1e-5, abs=1e-7) for k in a if k[1] != "Opt err")


def test_row_ids_are_dense_and_stay(spark):
    rows = spark.range(1000).withColumn("k", F.col("id") % 7).repartition(5, "k")
    numbered = sampling.with_row_id(rows)
    first = {r["id"]: r["row_id"] for r in numbered.collect()}
    assert sorted(first.values()) == list(range(1000)) and first == {r["id"]: r["row_id"] for r in numbered.repartition(3).collect()}
    assert sampling.with_row_id(rows.where("false")).count() == 0


def test_scan_equals_measures_of_each_column(spark, rows):
    cells = resample.in_ranges(rows.groupBy(F.col("_y").alias("y"), F.col("_p").alias("p")).agg(F.count("*").alias("n")), 5)
    assert cells.table.select("_range").distinct().count() > 3
    assert cells.table.groupBy("p").agg(F.countDistinct("_range").alias("n")).where("n > 1").count() == 0
    draw = lambda y, p, k: ((np.floor(p * 1000) * (k + 3) + 7 * y) % 11).astype(float)
    found = {r["rep"]: r for r in resample.scan(cells.table, lambda _, b: np.column_stack([draw(b["y"].to_numpy(), b["p"].to_numpy(), k) for k in range(4)] + [np.zeros(len(b))])).collect()}
    t = cells.table.toPandas()
    for k in range(4):
        want = local.measures(t["y"].to_numpy(), t["p"].to_numpy(), draw(t["y"].to_numpy(), t["p"].to_numpy(), k))
        assert [found[k][c] for c in ("auroc", "brier", "mean_prediction", "observed_risk")] == pytest.approx(list(want.values()))
    assert found[4]["auroc"] is None and found[4]["brier"] is None
    cells.drop()


def test_bootstrap_of_continuous_predictions(spark, rows):
    own = rows.withColumn("p", F.col("_p") + uniform(F.lit(9), F.col("a"), F.col("x"), F.col("_p"), F.col("b"), F.col("_y")) / 1000).select(F.col("_y").alias("y"), "p")
    one = resample.bootstrap_measures(own, reps=200, seed=3, per_task=40).toPandas().sort_values("rep", ignore_index=True)
    two = resample.bootstrap_measures(own, reps=200, seed=3, per_task=40).toPandas().sort_values("rep", ignore_index=True)
    assert one.equals(two) and len(one) == 200
    y, p = (own.toPandas()[c].to_numpy() for c in ("y", "p"))
    se = {"brier": ((y - p) ** 2).std() / math.sqrt(len(y)), "mean_prediction": p.std() / math.sqrt(len(y)), "observed_risk": y.std() / math.sqrt(len(y))}
    want = local.measures(y, p, np.ones(len(y)))
    for c, m in (("brier", "Brier score"), ("mean_prediction", "Global calibration mean prediction"), ("observed_risk", "Global calibration observed risk")):
        assert one[c].mean() == pytest.approx(want[m], abs=4 * se[c] / math.sqrt(200)) and one[c].std() == pytest.approx(se[c], rel=0.2)
    assert one["auroc"].mean() == pytest.approx(want["AUROC"], abs=0.003)
    one_class = resample.bootstrap_measures(own.where("y = 1"), reps=3).collect()
    assert all(r["auroc"] is None for r in one_class)


def test_internal_performance_of_a_hundred_resamples(rows):
    got = {r.field: r.value for r in estimate_internal(rows, "_y", "_p").collect()}
    assert len(got) == 22 and got["95% lower AUROC"] < got["Median    AUROC"] < got["95% upper AUROC"]


# Factors ------------------------------------------------------------------------------------------------------------------


def test_contrasts_and_whole_rows(spark):
    own = spark.createDataFrame([(1, 0.5, "b", "u"), (0, 1.5, "a", "v"), (1, None, "a", "u"), (0, 2.5, None, "u"), (1, 3.5, "c", "v"), (None, 1.0, "a", "u")], "y int, x double, f string, g string")
    spec = fit_transform(own, "Interaction", "y", ["x", "f", "g"], interactions=("g",), contrasts=True)
    label = "I(y)"
    for term in (f"{label}:fa", f"{label}:fb", f"{label}:fc", f"{label}:gu", f"{label}:x:gv", f"{label}:fb:gv", f"{label}:fc:gv", f"{label}:I(x^2)"):
        assert term in spec.names
    assert not {f"{label}:x:gu", f"{label}:fa:gv", f"{label}:fb:gu", f"{label}:I(f^2)"} & set(spec.names)
    got = spec.apply(own, keep=["x"]).orderBy("x").collect()
    assert [r["x"] for r in got] == [0.5, 1.5, 3.5]
    assert [r[f"{label}:fc:gv"] for r in got] == [0, 0, 1] and [r["I(1 - y):fa"] for r in got] == [0, 1, 0] and [r["I(1 - y):x:gv"] for r in got] == [0, 1.5, 0]
    outside = spark.createDataFrame([(1, 1.0, "a", "u"), (1, 1.0, "new", "u"), (0, float("nan"), "a", "u")], "y int, x double, f string, g string")
    assert spec.used(outside).count() == 1 and spec.means(outside)[f"{label}:fa"] == 1.0
    with pytest.raises(ValueError):
        fit_transform(own, "Table 1", "y", contrasts=True)


def test_answers_go_to_those_who_asked():
    tilts = [Tilt(np.random.default_rng(k).normal(size=(50, 2)), np.array([0.1, -0.1 * k]), np.ones(50)) for k in range(3)]
    optimizer = TunedExponentiatedGradient()
    together = answer_all([optimizer.ask(t.mu, t.reach) for t in tilts], lambda thetas, whose: [tilts[w].state(t) for t, w in zip(thetas, whose, strict=True)])
    for t, found in zip(tilts, together, strict=True):
        assert np.array_equal(found.theta, optimizer.solve(t).theta)
    assert col("a") is not None
