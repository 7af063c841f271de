"""Order statistics, tests, flow metrics, bootstrap and models on fixtures computed by hand or with numpy."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchmark.functions.geometry import albers_constants
from catchmark.operators import bootstrap as bs
from catchmark.operators import distributions as ds
from catchmark.operators import hydrology as hy
from catchmark.functions import linear
from catchmark.operators import models
from catchmark.operators import tables as tb
from catchmark.operators.contingency import chi_square, odds_ratio
from catchmark.operators.ordered import exact_quantiles, first_n_by, group_quantiles, running_totals


def test_running_totals_cut_rows_and_offsets_at_the_same_values(spark):
    """The sketch is not the same twice, so it is read from a file by whatever uses it."""
    rows = spark.range(50_000).selectExpr("xxhash64(id) AS x", "id % 7 AS n").repartition(32)
    got = running_totals(rows, [], "x", ["n"])
    assert "percentile_approx" not in got._jdf.queryExecution().toString()
    seen, want = got.orderBy("x").select("n", "cum_n").collect(), 0
    for n, cum in seen:
        want += n
        assert cum == want


@pytest.mark.parametrize("parts", [1, 16])
def test_exact_quantiles_match_numpy(spark, parts):
    rng = np.random.default_rng(1)
    groups = {
        "skewed": np.exp(rng.normal(size=30_000) * 4),
        "third_equal": np.concatenate([np.full(10_000, 3.0), rng.integers(0, 50, 20_000).astype(float)]),
        "tiny": np.array([1.0, 2.0, 4.0, 9.0]),
        "one": np.array([5.0]),
    }
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("tiny", None), ("tiny", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(parts)
    probs = {"lo": 0.0, "p001": 0.001, "t1": 1 / 3, "mid": 0.5, "t2": 2 / 3, "p995": 0.995, "hi": 1.0}
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    same = {r["g"]: r for r in group_quantiles(df, ["g"], "v", probs).collect()}
    for g, vs in groups.items():
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(vs, p), rel=1e-12)
            assert same[g][name] == pytest.approx(np.quantile(vs, p), rel=1e-12)
    total = exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"]
    assert total == pytest.approx(np.median(np.concatenate(list(groups.values()))))


def test_fixture_cut_points(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (9.0,), (None,)], "stress_value double")
    row = tb.cut_points(df).first()
    assert (row["t1"], row["t2"], row["q2"]) == (2.0, 4.0, 3.0)
    assert exact_quantiles(df, [], "stress_value", {"p": 0.1}).first()["p"] == pytest.approx(1.3)


def test_many_groups(spark, monkeypatch):
    """Beyond the rows that are broadcast the join is an ordinary one."""
    from catchmark.operators import ordered

    df = spark.range(500).selectExpr("id % 50 AS g", "cast(id AS double) AS v")
    few = {r["g"]: r["m"] for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    monkeypatch.setattr(ordered, "BROADCAST_ROWS", 10)
    many = {r["g"]: r["m"] for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert few == many == {g: 225.0 + g for g in range(50)}


def test_noise_does_not_repeat(spark):
    from catchmark.functions.random import MODULUS, hash31

    far = spark.range(2000).select(hash31(F.col("id"), 7).alias("a"), hash31(F.col("id") + MODULUS, 7).alias("b"), hash31(F.col("id") + (1 << 40), 7).alias("c"), hash31(F.col("id"), 8).alias("d"))
    rows = far.collect()
    for other in "bcd":
        assert sum(r["a"] == r[other] for r in rows) <= 2
    # two streams are not one sequence shifted: hardly a run of three of one is in the other
    a, d = [r["a"] for r in rows], {tuple(r["d"] for r in rows[i : i + 3]) for i in range(1998)}
    assert not any(tuple(a[i : i + 3]) in d for i in range(1998))
    assert spark.range(1).select(hash31(F.lit((1 << 62) + 5), 1)).first()[0] >= 0


def test_running_totals_over_slices(spark):
    values = sorted(random.Random(2).sample(range(100_000), 3_000))
    df = spark.createDataFrame([("k", float(v), i % 5) for i, v in enumerate(values)], "g string, x double, n long").repartition(7)
    want, acc = {}, 0
    for i, v in enumerate(values):
        acc += i % 5
        want[float(v)] = acc
    got = running_totals(df, ["g"], "x", ["n"], n_slices=32).collect()
    assert {r["x"]: r["cum_n"] for r in got} == want
    assert {r["tot_n"] for r in got} == {acc}


def test_first_n_by_keeps_exactly_the_smallest(spark):
    df = spark.range(5_000).withColumn("r", F.pmod(F.col("id") * 37, F.lit(1000)))
    got = {r["id"] for r in first_n_by(df, F.col("r"), 1000, "id", 1_234, 64).collect()}
    assert got == {i for _, i in sorted(((i * 37) % 1000, i) for i in range(5_000))[:1_234]}


def test_ecdf_rows_with_ties_and_a_hot_value(spark):
    df = spark.createDataFrame([("a", v, i) for i, v in enumerate((1.0, 2.0, 2.0, 4.0))], "g string, v double, id long")
    rows = sorted((r["y"], r["x"], r["y_step"]) for r in ds.ecdf_rows(df, ["g"], "v", "id").collect())
    assert rows == [(0.25, 1.0, 0.25), (0.5, 2.0, 0.75), (0.75, 2.0, 0.75), (1.0, 4.0, 1.0)]
    hot = spark.createDataFrame([("a", 5.0 if i % 3 else float(i), i) for i in range(900)], "g string, v double, id long").repartition(6)
    got = sorted((r["y"], r["x"]) for r in ds.ecdf_rows(hot, ["g"], "v", "id").collect())
    want = sorted(5.0 if i % 3 else float(i) for i in range(900))
    assert [x for _, x in got] == want and [y for y, _ in got] == pytest.approx([(i + 1) / 900 for i in range(900)])


def test_ecdf_on_grid(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 2.0), ("a", 4.0)], "g string, v double")
    grid = spark.createDataFrame([("a", 0, 0.5), ("a", 1, 2.0), ("a", 2, 2.0), ("a", 3, 9.0)], "g string, gi int, x double")
    grid = grid.withColumnsRenamed({"g": "k", "gi": "g"})
    counts = ds.value_counts(df.withColumnRenamed("g", "k"), ["k"], "v")
    got = {r["g"]: r["y"] for r in ds.ecdf_on_grid(counts, grid, ["k"]).collect()}
    assert got == {0: 0.0, 1: 0.75, 2: 0.75, 3: 1.0}


def test_bh_fdr_both_forms(spark):
    p = [0.01, 0.04, 0.03, None]
    df = spark.createDataFrame(list(enumerate(p)), "i long, p double")
    for f in (ds.bh_fdr, ds.bh_fdr_results):
        got = {r["i"]: r["q"] for r in f(df, "p", "q").collect()}
        assert [got[i] for i in range(3)] == pytest.approx([0.03, 0.04, 0.04]) and got[3] is None
    tied = spark.createDataFrame([(0, 0.02), (1, 0.02), (2, 0.5)], "i long, p double")
    for f in (ds.bh_fdr, ds.bh_fdr_results):
        assert sorted(r["q"] for r in f(tied, "p", "q").collect()) == pytest.approx([0.03, 0.03, 0.5])


def test_chi_square_and_odds(spark):
    cells = [(r, c, n) for r, row in enumerate([[10, 20, 30], [20, 20, 20]]) for c, n in enumerate(row)]
    row = chi_square(spark.createDataFrame(cells, "r long, c long, n long"), [], "r", "c").first()
    assert (row["dof"], row["n"]) == (2, 120)
    assert [row["chi2"], row["p"], row["cramers_v"]] == pytest.approx([16 / 3, 0.069483, 0.210819], abs=1e-6)
    two = spark.createDataFrame([(0, 0, 10), (0, 1, 20), (1, 0, 30), (1, 1, 15)], "r long, c long, n long")
    got = chi_square(two, [], "r", "c").first()  # continuity-corrected by hand: sum((|o-e|-.5)^2/e)
    e = [30 * 40 / 75, 30 * 35 / 75, 45 * 40 / 75, 45 * 35 / 75]
    want = sum((abs(o - x) - 0.5) ** 2 / x for o, x in zip((10, 20, 30, 15), e))
    assert got["chi2"] == pytest.approx(want)
    empty = spark.createDataFrame([(0, 0, 0), (0, 1, 3), (1, 0, 0), (1, 1, 4), (2, 0, 0), (2, 1, 1)], "r long, c long, n long")
    with pytest.raises(Exception, match="expected cell is zero"):
        chi_square(empty, [], "r", "c").collect()
    df = spark.createDataFrame([(10, 20, 5, 40), (0, 10, 5, 5)], "a long, b long, c long, d long")
    got = [tuple(r) for r in df.select(*odds_ratio(*[F.col(x) for x in "abcd"])).collect()]
    assert got[0] == pytest.approx((4.0, 1.204476, 13.283788), abs=1e-6)
    assert got[1] == pytest.approx((0.047619, 0.002203, 1.029336), abs=1e-6)


def test_rank_comparison(spark):
    rows = [("k", True, v) for v in (1.0, 2.0, 3.0)] + [("k", False, 2.0), ("k", False, 2.0)]
    r = ds.rank_comparison(spark.createDataFrame(rows, "k string, a boolean, x double"), ["k"], "x", F.col("a")).first()
    assert (r["n_first"], r["n_second"], r["mwu_u"], r["cliffs_delta"]) == (3, 2, 3.0, 0.0)
    assert r["ks_d"] == pytest.approx(1 / 3)
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 40, 700).astype(float), rng.integers(3, 45, 400).astype(float)
    rows = [("k", True, float(v)) for v in x] + [("k", False, float(v)) for v in y]
    r = ds.rank_comparison(spark.createDataFrame(rows, "k string, a boolean, x double").repartition(9), ["k"], "x", F.col("a")).first()
    diff = np.sign(x[:, None] - y[None, :])
    assert r["cliffs_delta"] == pytest.approx(diff.mean())
    assert r["mwu_u"] == pytest.approx(((diff > 0) + 0.5 * (diff == 0)).sum())
    grid = np.unique(np.concatenate([x, y]))
    d = max(abs((x <= g).mean() - (y <= g).mean()) for g in grid)
    assert r["ks_d"] == pytest.approx(d)


def test_histogram_closes_last_bin_and_keeps_empty_bins(spark):
    vals = [0.0, 0.1, 9.9, 10.0, 10.0]
    got = [r["n"] for r in ds.histogram(spark.createDataFrame([(v,) for v in vals], "v double"), "v", 10).orderBy("bin").collect()]
    assert got == list(np.histogram(vals, 10)[0])


def day(n):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=n)


def test_flow_metrics(spark):
    rows = [(1, day(0), 1.0), (1, day(1), 3.0), (1, day(3), 7.0)]  # the gap is not bridged
    r = hy.regime_metrics(hy.daily_mean(spark.createDataFrame(rows, "feature_id long, time timestamp, q double")), months=1).first()
    assert r["RBI"] == pytest.approx(2 / 11) and r["season_conc"] == pytest.approx(1.0)
    rows = [(1, day(i), q) for i, q in enumerate((1.0, 2.0, 4.0))]
    r = hy.regime_metrics(hy.daily_mean(spark.createDataFrame(rows, "feature_id long, time timestamp, q double"))).first()
    assert r["stdQ"] == pytest.approx(1.247219, abs=1e-6)
    assert r["season_conc"] == 0.0  # eleven missing months take all three slots
    rows = [(1, dt.datetime(2020, m, 5), float(m)) for m in range(1, 13)]
    r = hy.regime_metrics(hy.daily_mean(spark.createDataFrame(rows, "feature_id long, time timestamp, q double"))).first()
    assert r["season_conc"] == pytest.approx(33 / 78)
    zero = hy.regime_metrics(hy.daily_mean(spark.createDataFrame([(1, day(0), 0.0)], "feature_id long, time timestamp, q double"))).first()
    assert zero["CVQ"] is None and zero["RBI"] is None


def test_flow_window_is_inclusive_and_top_reach(spark):
    rows = [(1, dt.datetime(2020, 1, 1), 1.0), (1, dt.datetime(2020, 1, 2, 23, 59), 1.0), (1, dt.datetime(2020, 1, 3), 1.0), (2, dt.datetime(2020, 1, 1), 1.0)]
    flow = spark.createDataFrame(rows, "feature_id long, time timestamp, q double")
    keep = spark.createDataFrame([(1,), (99,)], "feature_id long")
    assert hy.flow_window(flow, "2020-01-01", "2020-01-02", keep).count() == 2
    m = spark.createDataFrame([(10, 1, 3), (11, 1, 5), (12, 1, 5), (13, 1, None), (20, 2, None), (21, 2, None)], "feature_id long, basin_id long, ord int")
    for k, want in ((1, {(1, 11), (2, 20)}), (2, {(1, 11), (1, 12), (2, 20), (2, 21)})):
        assert {(r["basin_id"], r["feature_id"]) for r in hy.top_reaches(m, k).collect()} == want


def test_dedupe_and_one_to_one_fail_loudly(spark):
    ok = spark.createDataFrame([(1, 2.0), (1, 2.0), (-9999, 1.0), (None, 1.0), (3, None)], "pfaf_id long, bws_raw double")
    assert sorted(map(tuple, tb.dedupe_stress(ok).collect()), key=str) == [(1, 2.0), (3, None)]
    bad = spark.createDataFrame([(1, 2.0), (1, 3.0)], "pfaf_id long, bws_raw double")
    with pytest.raises(Exception, match="different"):
        tb.dedupe_stress(bad).collect()
    left = spark.createDataFrame([(1, "a"), (1, "b")], "k long, v string")
    with pytest.raises(Exception, match="repeated key"):
        tb.one_to_one(left, left.select("k"), ["k"]).collect()


def boot_values(spark):
    rng = random.Random(9)
    rows = [(g, "m", i + off, round(rng.gauss(mu, 1), 2)) for g, n, mu, off in (("A", 41, 0.5, 0), ("None", 120, 0.0, 1000)) for i in range(n)]
    return spark.createDataFrame(rows, "group string, metric string, basin_id long, x double")


@pytest.mark.parametrize("replace", [True, False])
def test_bootstrap_brackets_the_difference_and_is_reproducible(spark, replace):
    values = boot_values(spark)
    run = lambda v: bs.bootstrap_vs_pool(
        v, ds.ranked_rows(v, ["group", "metric"], "x", "basin_id").cache(), ["A"], ["m"], 200, 5, replace, 30
    ).first()
    a, b = run(values.repartition(1)), run(values.repartition(11))
    assert a == b and (a["n"], a["m"]) == (41, 120)
    assert a["d_lo"] <= a["d_med"] <= a["d_hi"]
    assert abs(a["d_med"] - (a["median_sector"] - a["median_pool"])) < 0.3


def test_draws_without_replacement_are_distinct(spark):
    spec = spark.createDataFrame([("A", "m", "None", 41, 120, 0)], "sector string, metric string, group string, n long, m long, stream long")
    draws = bs.draw_ranks(spec, ["sector", "metric"], 50, 1, False)
    sizes = draws.groupBy("rep").agg(F.count_distinct("i").alias("d"), F.sum("c").alias("c"), F.max("i").alias("hi"), F.min("i").alias("lo")).collect()
    assert {(r["d"], r["c"]) for r in sizes} == {(41, 41)} and max(r["hi"] for r in sizes) <= 120 and min(r["lo"] for r in sizes) >= 1


def newton_logit(x, y, penalty=0.0):
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(design.shape[1])
    ridge = np.diag([0.0] + [penalty] * (design.shape[1] - 1))
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ beta))
        h = design.T @ (design * (p * (1 - p))[:, None]) + ridge
        beta = beta + np.linalg.solve(h, design.T @ (y - p) - ridge @ beta)
    return beta, np.sqrt(np.diag(np.linalg.inv(h))), p


def test_distance_logit(spark):
    rng = np.random.default_rng(2)
    near, far = rng.exponential(8, 300), rng.exponential(14, 260)
    side = lambda v: spark.createDataFrame([(float(a),) for a in v], "dist_km double")
    frame = models.presence_frame(side(near), side(far))
    fit = models.fit_distance_logit(frame).first()
    y = np.r_[np.ones(300), np.zeros(260)]
    beta, se, p = newton_logit(np.log(np.r_[near, far] + 1)[:, None], y)
    ll = (y * np.log(p) + (1 - y) * np.log(1 - p)).sum()
    base = y.mean()
    ll0 = len(y) * (base * math.log(base) + (1 - base) * math.log(1 - base))
    assert (fit["intercept"], fit["coef"]) == pytest.approx(tuple(beta), rel=1e-6)
    assert fit["or_lo"] == pytest.approx(math.exp(beta[1] - 1.959963984540054 * se[1]), rel=1e-5)
    assert fit["pseudo_r2"] == pytest.approx(1 - ll / ll0, rel=1e-6)
    assert fit["p_value"] == pytest.approx(math.erfc(abs(beta[1] / se[1]) / math.sqrt(2)), rel=1e-4)
    assert fit["llr_p"] == pytest.approx(math.erfc(math.sqrt((ll - ll0))), rel=1e-4)


def test_penalised_odds(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 2)) * [3, 0.2] + [10, 1]
    y = (rng.uniform(size=200) < 1 / (1 + np.exp(-(x[:, 0] - 10)))).astype(float)
    df = spark.createDataFrame([(float(c), float(a), float(b)) for c, (a, b) in zip(y, x)], "y double, a double, b double")
    got = {r["predictor"]: r["coef"] for r in models.penalised_odds_ratios(df, "y", ["a", "b"]).collect()}
    beta, _, _ = newton_logit((x - x.mean(0)) / x.std(0), y, 1.0)
    assert (got["a"], got["b"]) == pytest.approx((beta[1], beta[2]), abs=1e-5)
    assert models.penalised_odds_ratios(df.limit(50), "y", ["a", "b"]).count() == 0


def test_solver_equals_numpy(spark):
    rng = np.random.default_rng(8)
    for n in (1, 2, 5):
        m = rng.normal(size=(n + 3, n)) * 10.0 ** rng.uniform(-3, 3, n)
        a, b = m.T @ m, rng.normal(size=n)
        df = spark.createDataFrame([([float(a[i, j]) for i in range(n) for j in range(i + 1)], [float(v) for v in b])], "a array<double>, b array<double>")
        factor = df.select("b", linear.cholesky(F.col("a"), n).alias("l"))
        z = factor.select("l", linear.forward(F.col("l"), F.col("b"), n).alias("z"))
        x = np.array(z.select(linear.backward(F.col("l"), F.col("z"), n).alias("x")).first()["x"])
        assert np.allclose(a @ x, b, rtol=1e-8)
        assert np.allclose(z.select(linear.inverse_diagonal(F.col("l"), n).alias("d")).first()["d"], np.diag(np.linalg.inv(a)), rtol=1e-6)
    flat = spark.createDataFrame([([1.0, 2.0, 4.0],), ([1.0, 0.0, -1.0],)], "a array<double>")
    assert [r["l"] for r in flat.select(linear.cholesky(F.col("a"), 2).alias("l")).collect()] == [None, None]


def test_groups_are_fitted_together(spark):
    rng = np.random.default_rng(12)
    rows, want = [], {}
    for name, n, slope in (("large", 4000, 0.4), ("small", 60, -1.0), ("steep", 300, 6.0)):
        x = rng.normal(size=n) * 2 + 1
        y = (rng.uniform(size=n) < 1 / (1 + np.exp(-(0.3 + slope * x)))).astype(float)
        rows += [(name, float(b), float(a)) for a, b in zip(x, y)]
        beta, se, _ = newton_logit(x[:, None], y)
        eta = beta[0] + beta[1] * x
        want[name] = beta, se, (y * eta - np.logaddexp(0, eta)).sum()
    rows += [("parted", 0.0, 1.0), ("parted", 0.0, 2.0), ("parted", 1.0, 3.0), ("one", 1.0, 1.0), ("one", 1.0, 2.0), ("flat", 0.0, 2.0), ("flat", 1.0, 2.0), ("small", None, 1.0), ("small", 1.0, None)]
    got = {r["g"]: r for r in models.fit_logistic(spark.createDataFrame(rows, "g string, y double, x double").repartition(5), ["g"], "y", ["x"]).collect()}
    for name, (beta, se, loglik) in want.items():
        r = got[name]
        assert r["converged"] and r["coef"] == pytest.approx(beta, rel=1e-7) and np.sqrt(r["variance"]) == pytest.approx(se, rel=1e-5) and r["loglik"] == pytest.approx(loglik, rel=1e-9)
    assert got["small"]["n"] == 60
    for name in ("parted", "one", "flat"):
        assert (got[name]["converged"], got[name]["coef"], got[name]["loglik"]) == (False, None, None)
    assert models.fit_logistic(spark.createDataFrame([], "g string, y double, x double"), ["g"], "y", ["x"]).count() == 0


def test_albers_constants_are_plausible():
    assert albers_constants()["n"] == pytest.approx(0.6029, abs=1e-4)


@pytest.mark.parametrize("parts", [1, 16])
def test_quantile_grid_matches_numpy(spark, parts):
    rng = np.random.default_rng(5)
    groups = {"skewed": np.exp(rng.normal(size=20_000) * 3), "tied": np.concatenate([np.full(5_000, 2.0), rng.integers(0, 9, 5_000)]), "two": np.array([1.0, 4.0]), "one": np.array([3.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("two", None), ("one", float("nan"))]
    counts = ds.value_counts(spark.createDataFrame(rows, "g_name string, v double").repartition(parts), ["g_name"], "v")
    for low, high in ((0.01, 0.99), (0.0, 1.0)):
        got: dict = {}
        for r in ds.quantile_grid(counts, ["g_name"], low, high, 250).collect():
            got.setdefault(r["g_name"], {})[r["g"]] = r["x"]
        for name, vs in groups.items():
            assert [got[name][g] for g in range(250)] == pytest.approx(np.quantile(vs, np.linspace(low, high, 250)), rel=1e-9)


def test_draws_counted_in_arrays_are_the_draws_of_the_noise(spark):
    spec = spark.createDataFrame([("a", "m", "None", 70_000, 900, 5)], "sector string, metric string, group string, n long, m long, stream long")
    keys = ["sector", "metric"]
    want = {(r["rep"], r["i"]): r["c"] for r in bs.draw_ranks(spec, keys, 2, 7, True).collect()}
    listed = bs._replicates(spec, 2).withColumn("_slices", F.sequence(F.lit(0).cast("bigint"), F.lit(30).cast("bigint")))
    assert {(r["rep"], r["i"]): r["c"] for r in bs._counted(listed, keys, 7, "_slices").collect()} == want
    slices = {}
    for (rep, i), c in want.items():
        slices[rep, (i - 1) // 30] = slices.get((rep, (i - 1) // 30), 0) + c
    assert {(r["rep"], r["_slice"]): r["c"] for r in bs._counted(bs._replicates(spec, 2), keys, 7).collect()} == slices


def test_medians_without_replacement_are_those_of_the_drawn_ranks(spark):
    keys, kind = ["sector", "metric"], "sector string, metric string, group string, n long, m long, stream long"
    rows = [("few", "m", "None", 1, 7, 0), ("all", "m", "None", 300, 300, 1), ("odd", "m", "None", 9_001, 20_000, 2), ("even", "m", "None", 19_998, 20_000, 3), ("more", "m", "None", 8, 7, 4)]
    spec = spark.createDataFrame(rows, kind)
    ranked = spark.range(1, 20_001).select(F.lit("None").alias("group"), F.lit("m").alias("metric"), F.col("id").alias("i"), (F.col("id") * 10.0).alias("x"))
    drawn: dict = {}
    for r in bs.draw_ranks(spec.filter("n <= m"), keys, 3, 7, False).collect():
        drawn.setdefault((r["sector"], r["rep"]), []).append(r["i"] * 10.0)
    medians = bs.replicate_medians(spec, ranked, keys, 3, 7, False)
    assert {(r["sector"], r["rep"]): r["median"] for r in medians.collect()} == {k: float(np.median(v)) for k, v in drawn.items()}
    assert len(drawn) == 12


def test_medians_with_replacement_are_those_of_the_drawn_ranks(spark):
    """Odd and even samples, larger and smaller than their pool; what is written for a replicate is its middle, whatever the sizes."""
    keys, kind = ["sector", "metric"], "sector string, metric string, group string, n long, m long, stream long"
    rows = [("one", "m", "None", 1, 7, 0), ("two", "m", "None", 2, 900, 1), ("odd", "m", "None", 40_001, 20_000, 2), ("even", "m", "None", 33_000, 20_000, 3), ("few", "m", "None", 500, 2, 4)]
    spec = spark.createDataFrame(rows, kind)
    ranked = spark.range(1, 20_001).select(F.lit("None").alias("group"), F.lit("m").alias("metric"), F.col("id").alias("i"), (F.col("id") * 10.0).alias("x"))
    drawn: dict = {}
    for r in bs.draw_ranks(spec, keys, 4, 7, True).collect():
        drawn.setdefault((r["sector"], r["rep"]), []).extend([r["i"] * 10.0] * r["c"])
    medians = bs.replicate_medians(spec, ranked, keys, 4, 7)
    assert {(r["sector"], r["rep"]): r["median"] for r in medians.collect()} == {k: float(np.median(v)) for k, v in drawn.items()}
    assert len(drawn) == 20
    plan = bs._middle_draws(bs._replicates(spec, 4), keys, 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("start", [0, bs.MODULUS // 2, bs.MODULUS - 5])
def test_middles_are_found_where_noise_is_uneven(spark, start, monkeypatch):
    monkeypatch.setattr(bs, "_array_noise", lambda: (lambda key: key, lambda low, key, seed: start + key * key % 5))
    spec = spark.createDataFrame([("a", "m", "None", 40_000, 1 << 40, 0)], "sector string, metric string, group string, n long, m long, stream long")
    first = np.sort(start + np.arange(40_000, dtype=np.int64) ** 2 % 5)
    second = lambda h: np.floor((h + h / float(bs.MODULUS)) / float(bs.MODULUS) * (1 << 40))
    got = bs._middle_draws(bs._replicates(spec, 1), ["sector", "metric"], 7).first()
    assert (got["_low"], got["_high"]) == tuple(min(int(second(h)), (1 << 40) - 1) + 1 for h in first[19_999:20_001])


@pytest.mark.parametrize("start", [0, 5, bs.MODULUS - 5])
def test_cutoffs_are_found_where_noise_is_uneven(spark, start, monkeypatch):
    """All noise in a few numbers, with ties, far from where it is looked for first."""
    monkeypatch.setattr(bs, "_array_noise", lambda: (lambda key: key, lambda low, key, seed: start + key * key % 5))
    spec = spark.createDataFrame([("a", "m", "None", 401, 40_000, 0)], "sector string, metric string, group string, n long, m long, stream long")
    order = sorted(range(40_000), key=lambda t: (t * t % 5, t))[:401]
    got = bs._middle_members(bs._replicates(spec, 1), ["sector", "metric"], 7).first()
    assert (got["_low"], got["_high"]) == (sorted(order)[200] + 1,) * 2


def test_draws_without_replacement_leave_no_counts_behind(spark):
    """What is written for a replicate is its middle, whatever the pool's size."""
    spec = spark.createDataFrame([("a", "m", "None", 30, 90, 0)], "sector string, metric string, group string, n long, m long, stream long")
    plan = bs._middle_members(bs._replicates(spec, 4), ["sector", "metric"], 7)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("replace", [True, False])
def test_curves_are_those_of_the_drawn_ranks(spark, replace):
    """No draw is a row; slices that cuts split, equal cuts and cuts at either end."""
    keys, kind = ["sector", "metric"], "sector string, metric string, group string, n long, m long, stream long"
    cuts = {"a": [0, 1, 7, 7, 4096, 9_999, 10_000, 15_001, 20_000], "b": [0, 3, 90], "c": [1, 1]}
    spec = spark.createDataFrame([("a", "m", "None", 18_000, 20_000, 0), ("b", "m", "None", 60, 90, 1), ("c", "m", "None", 1, 1, 2)], kind)
    drawn = {}
    for r in bs.draw_ranks(spec, keys, 2, 7, replace).collect():
        drawn.setdefault((r["sector"], r["rep"]), []).extend([r["i"]] * r["c"])
    want = {(s, rep, g): sum(i <= k for i in ranks) / len(ranks) for (s, rep), ranks in drawn.items() for g, k in enumerate(cuts[s])}
    listed = bs._replicates(spec, 2).join(spark.createDataFrame(list(cuts.items()), "sector string, _cuts array<long>"), "sector")
    got = bs._curves(listed, keys, 7, replace)
    assert {(r["sector"], r["rep"], r["g"]): r["y"] for r in got.collect()} == want
    assert "Generate" not in bs._curves(listed.localCheckpoint(), keys, 7, replace)._jdf.queryExecution().executedPlan().toString()


def test_bh_fdr_works_out_p_twice_a_row_at_most(spark):
    seen = spark.sparkContext.accumulator(0)

    def note(x):
        seen.add(1)
        return x

    df = spark.range(400).select("id", F.udf(note, "double")(F.when(F.col("id") % 9 > 0, F.col("id") / 400.0)).alias("p"))
    got = {r["id"]: r["q"] for r in ds.bh_fdr(df, "p", "q").collect()}
    assert seen.value <= 800
    p = np.array([i / 400.0 for i in range(400) if i % 9])
    q = np.minimum(1, np.minimum.accumulate((p * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1])
    assert [got[i] for i in range(400) if i % 9] == pytest.approx(list(q)) and all(got[i] is None for i in range(0, 400, 9))
