"""ECDFs, contingency and rank tests, false-discovery control, bootstrap and logistic models."""

from __future__ import annotations

from pyspark.sql import functions as F

from catchmark.catalog import Query
from catchmark.catalog.common import (
    noise31, noise_u, num, distance_sql, inside_sql, projected_edges_sql, projected_points_sql,
    FAC_CTES, FAC_INPUT, HIT, MASTER, MASTER_INPUT, PRESENCE, SECTORS, R, binned, erfc_sql, facilities_with_stress, fx, master, out, r6, sql,
)
from catchmark.catalog.locating import REF_CTES, REF_INPUT, area_ctes, matched_ctes, place_sql, reference
from catchmark.functions.clean import keep_values
from catchmark.functions.random import hashed_uniform
from catchmark.operators import bootstrap as bs
from catchmark.operators import distributions as ds
from catchmark.operators import models
from catchmark.operators.contingency import odds_ratio
from catchmark.plans import distance as dist_plan
from catchmark.plans import regimes as regime_plan
from catchmark.plans import stress as stress_plan

QUERIES: dict[str, Query] = {}


# --- ECDFs ----------------------------------------------------------------------------------------------------
def ecdf_rows(spark, d):
    dist = keep_values(fx(spark, d, "distances"), "dist_lake_km")
    return out(ds.ecdf_rows(dist, ["sector", "grp"], "dist_lake_km", "site_id"), "sector", "grp")


QUERIES["ecdf_rows"] = Query(
    ecdf_rows,
    sql(
        ["distances"],
        f"SELECT sector, grp, {R('dist_lake_km')} AS x, {R('row_number() OVER (PARTITION BY sector, grp ORDER BY dist_lake_km) / cast(count(*) OVER (PARTITION BY sector, grp) as double)')} AS y, "
        f"{R('cume_dist() OVER (PARTITION BY sector, grp ORDER BY dist_lake_km)')} AS y_step FROM distances WHERE dist_lake_km >= 0",
    ),
)


def ecdf_grid(spark, d):
    dist = keep_values(fx(spark, d, "distances"), "dist_coast_km")
    limits = ds.axis_limits(dist, ["sector"], "dist_coast_km", 0.01, 0.995)
    grid = ds.linear_grid(limits, ["sector"], "lo", "hi", 250)
    return out(ds.ecdf_on_grid(ds.value_counts(dist, ["sector"], "dist_coast_km"), grid, ["sector"]), "sector", "g")


QUERIES["ecdf_grid"] = Query(
    ecdf_grid,
    sql(
        ["distances"],
        f"SELECT sector, g, {R('x')} AS x, {R('(SELECT count(*) FROM v WHERE v.sector = grid.sector AND v.c <= grid.x) / cast((SELECT count(*) FROM v WHERE v.sector = grid.sector) as double)')} AS y FROM grid",
        ("v", "SELECT sector, dist_coast_km AS c FROM distances WHERE dist_coast_km >= 0"),
        ("lim", "SELECT sector, quantile_cont(c, 0.01) AS lo, quantile_cont(c, 0.995) AS hi FROM v GROUP BY sector"),
        ("grid", "SELECT sector, g, CASE WHEN g = 249 THEN hi ELSE lo + g * ((hi - lo) / 249e0) END AS x FROM lim CROSS JOIN (SELECT unnest(range(0, 250)) AS g) AS s"),
    ),
)


def ecdf_pooled(spark, d):
    """Both groups of a sector on the 250 quantiles of their pooled values."""
    dist = keep_values(fx(spark, d, "distances"), "dist_coast_km")
    counts = ds.value_counts(dist, ["sector", "grp"], "dist_coast_km")
    pooled = ds.quantile_grid(counts.groupBy("sector", "x").agg(F.sum("n").alias("n")), ["sector"])
    grid = pooled.join(counts.select("sector", "grp").distinct(), "sector")
    return out(ds.ecdf_on_grid(counts, grid, ["sector", "grp"]), "sector", "grp", "g")


QUERIES["ecdf_pooled"] = Query(
    ecdf_pooled,
    sql(
        ["distances"],
        f"SELECT grid.sector, s.grp, g, {R('x')} AS x, {R('(SELECT count(*) FROM v WHERE v.sector = grid.sector AND v.grp = s.grp AND v.c <= grid.x) / cast(s.n as double)')} AS y "
        "FROM grid JOIN (SELECT sector, grp, count(*) AS n FROM v GROUP BY sector, grp) AS s ON s.sector = grid.sector",
        ("v", "SELECT sector, grp, dist_coast_km AS c FROM distances WHERE dist_coast_km >= 0"),
        ("q", f"SELECT sector, quantile_cont(c, [{', '.join(f'{0.01 + g * ((0.99 - 0.01) / 249)!r}::DOUBLE' for g in range(250))}]) AS xs FROM v GROUP BY sector"),
        ("grid", "SELECT sector, unnest(range(0, 250)) AS g, unnest(xs) AS x FROM q"),
    ),
)

_P = f"(CASE WHEN o_custkey % 50 = 0 THEN NULL ELSE round(pow({noise_u('o_orderkey', 91)}, 2e0), 4) END)"


def bh_fdr(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    p = F.when(F.col("o_custkey") % 50 != 0, F.round(F.pow(hashed_uniform(F.col("o_orderkey"), 91), 2.0), 4))
    return out(ds.bh_fdr(orders.select("o_orderkey", p.alias("p")), "p", "q"), "o_orderkey", digits=10)


QUERIES["bh_fdr"] = Query(
    bh_fdr,
    f"WITH t AS (SELECT o_orderkey, {_P} AS p FROM orders), "
    "r AS (SELECT o_orderkey, p, p * (SELECT count(p) FROM t) / count(*) OVER (ORDER BY p) AS raw FROM t WHERE p IS NOT NULL), "
    "q AS (SELECT o_orderkey, least(1, min(raw) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r) "
    f"SELECT t.o_orderkey, {R('t.p', 10)} AS p, {R('q.q', 10)} AS q FROM t LEFT JOIN q ON q.o_orderkey = t.o_orderkey",
)

# --- contingency ----------------------------------------------------------------------------------------------
_DIRECT_CTES = (
    *FAC_CTES,
    (
        "lmh",
        "SELECT sector, count(*) FILTER (WHERE stress_tertile = 'low') AS Low, count(*) FILTER (WHERE stress_tertile = 'medium') AS Medium, "
        "count(*) FILTER (WHERE stress_tertile = 'high') AS High, count(*) AS total FROM fac GROUP BY sector",
    ),
    ("full_cells", "SELECT sector AS r, 'l' AS c, Low AS n FROM lmh UNION ALL SELECT sector, 'm', Medium FROM lmh UNION ALL SELECT sector, 'h', High FROM lmh"),
    ("high_cells", "SELECT sector AS r, 'h' AS c, High AS n FROM lmh UNION ALL SELECT sector, 'n', Low + Medium FROM lmh"),
    *[
        (
            f"{w}_test",
            f"SELECT sum(pow(n - e, 2) / e) AS chi2, max(t) AS t FROM (SELECT n, sum(n) OVER (PARTITION BY r) * cast(sum(n) OVER (PARTITION BY c) as double) / sum(n) OVER () AS e, "
            f"sum(n) OVER () AS t FROM {w}_cells) AS q",
        )
        for w in ("full", "high")
    ],
)
_P_FULL, _P_HIGH = "exp(-f.chi2 / 2e0) * (1e0 + f.chi2 / 2e0)", "exp(-h.chi2 / 2e0)"


def chi2_direct(spark, d):
    got = stress_plan.direct_comparison(facilities_with_stress(spark, d))
    got = got.withColumn("High_test_significant", F.col("High_test_significant").cast("int"))
    keep = ("Mode", "Sector", "Low", "Medium", "High", "Not_high", "Total", "df_full_distribution", "df_high_vs_not_high", "High_test_significant")
    return out(got, *keep)


QUERIES["chi2_direct"] = Query(
    chi2_direct,
    sql(
        FAC_INPUT,
        "SELECT 'ALL_BASINS' AS \"Mode\", sector AS \"Sector\", Low, Medium, High, Low + Medium AS Not_high, total AS \"Total\", "
        + ", ".join(f"{R(f'1e2 * {n} / total')} AS {n}_percent" for n in ("Low", "Medium", "High"))
        + f", {R('f.chi2')} AS Chi2_full_distribution, 4 AS df_full_distribution, {R(_P_FULL)} AS p_full_distribution, {R('sqrt(f.chi2 / (f.t * 2))')} AS Cramers_V_full_distribution, "
        f"{R('h.chi2')} AS Chi2_high_vs_not_high, 2 AS df_high_vs_not_high, {R(_P_HIGH)} AS p_high_vs_not_high, {R('sqrt(h.chi2 / h.t)')} AS Cramers_V_high_vs_not_high, "
        f"CASE WHEN {_P_HIGH} < 0.05 THEN 1 ELSE 0 END AS High_test_significant FROM lmh CROSS JOIN full_test AS f CROSS JOIN high_test AS h",
        *_DIRECT_CTES,
    ),
)
QUERIES["chi2_summary"] = Query(
    lambda spark, d: out(
        stress_plan.direct_summary(facilities_with_stress(spark, d)), "Mode", "Sector", "N_with_stress", "df_direct_full", "df_direct_high"
    ),
    sql(
        FAC_INPUT,
        "SELECT 'ALL_BASINS' AS \"Mode\", 'AI_vs_Power_vs_TRI' AS \"Sector\", cast(h.t as bigint) AS N_with_stress, "
        f"{R('f.chi2')} AS Chi2_direct_full, 4 AS df_direct_full, {R(_P_FULL)} AS p_direct_full, {R('sqrt(f.chi2 / (f.t * 2))')} AS Cramers_V_direct_full, "
        f"{R('h.chi2')} AS Chi2_direct_high, 2 AS df_direct_high, {R(_P_HIGH)} AS p_direct_high, {R('sqrt(h.chi2 / h.t)')} AS Cramers_V_direct_high FROM full_test AS f CROSS JOIN high_test AS h",
        *_DIRECT_CTES,
    ),
)


def chi2_ref(spark, d):
    got = stress_plan.sector_vs_reference(facilities_with_stress(spark, d), reference(spark, d), "ALL_BASINS")
    return out(got, "Mode", "Sector", "N_with_stress")


def _or_sql(a: str, b: str, c: str, d: str, name: str) -> str:
    add = f"(CASE WHEN least({a}, {b}, {c}, {d}) = 0 THEN 5e-1 ELSE 0e0 END)"
    a, b, c, d = (f"({x} + {add})" for x in (a, b, c, d))
    ratio, half = f"(({a} / {b}) / ({c} / {d}))", f"(1.96e0 * sqrt(1e0 / {a} + 1e0 / {b} + 1e0 / {c} + 1e0 / {d}))"
    return f"{R(ratio)} AS {name}, {R(f'exp(ln({ratio}) - {half})')} AS {name}_lo, {R(f'exp(ln({ratio}) + {half})')} AS {name}_hi"


def _chi2_ref_sql(mode: str = "ALL_BASINS") -> str:
    counts, matched = [], mode != "ALL_BASINS"
    for side, table, sector in (("o", "fac", "sector"), ("r", "ref", "sector" if matched else None)):
        cols = ", ".join(
            [f"count(*) FILTER (WHERE stress_tertile = '{c}') AS {side}{i}" for i, c in enumerate(("low", "medium", "high"))]
            + [f"count(*) FILTER (WHERE stress_quartile = '{c}') AS {side}{c}" for c in ("Q1", "Q2", "Q3", "Q4")]
        )
        counts.append(f"SELECT {'sector, ' if sector else ''}{cols} FROM {table}{' GROUP BY sector' if sector else ''}")
    meet = "JOIN ({}) AS r USING (sector)" if matched else "CROSS JOIN ({}) AS r"
    both = ("both_sides", f"SELECT * FROM ({counts[0]}) AS o " + meet.format(counts[1]))

    def chi(classes):
        so, sr = "+".join(f"o{c}" for c in classes), "+".join(f"r{c}" for c in classes)
        terms = []
        for c in classes:
            for side, tot in (("o", so), ("r", sr)):
                e = f"((o{c} + r{c}) * cast(({tot}) as double) / ({so} + {sr}))"
                terms.append(f"pow({side}{c} - {e}, 2) / {e}")
        return "(" + " + ".join(terms) + ")"

    tests = ("tested", f"SELECT *, {chi('012')} AS c3, {chi(('Q1', 'Q2', 'Q3', 'Q4'))} AS c4 FROM both_sides")
    p4 = f"{erfc_sql('sqrt(c4 / 2e0)')} + sqrt(2e0 * c4 / pi()) * exp(-c4 / 2e0)"
    body = (
        f"SELECT '{mode}' AS \"Mode\", sector AS \"Sector\", o0 + o1 + o2 AS N_with_stress, "
        f"{R('c3')} AS Chi2_tertiles, {R('exp(-c3 / 2e0)')} AS p_tertiles, {_or_sql('o2', '(o0 + o1)', 'r2', '(r0 + r1)', 'OR_high')}, "
        f"{R('c4')} AS Chi2_quartiles, {R(p4)} AS p_quartiles, {_or_sql('oQ4', '(oQ1 + oQ2 + oQ3)', 'rQ4', '(rQ1 + rQ2 + rQ3)', 'OR_Q4')} FROM tested"
    )
    if matched:
        ctes, rows = matched_ctes()
        return sql(FAC_INPUT, body, *ctes, ("ref", rows), both, tests)
    return sql(REF_INPUT, body, *FAC_CTES, *REF_CTES, both, tests)


QUERIES["chi2_ref"] = Query(chi2_ref, _chi2_ref_sql())


def chi2_matched(spark, d):
    """Each sector against random places in the basins it is in."""
    got = stress_plan.matched_stress(spark, facilities_with_stress(spark, d), fx(spark, d, "basin_edges"), binned(spark, d), "BASIN_MATCHED")
    return out(got, "Mode", "Sector", "N_with_stress")


QUERIES["chi2_matched"] = Query(chi2_matched, _chi2_ref_sql("BASIN_MATCHED"))


def odds(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    big, late = F.col("l_quantity") > 45, F.col("l_returnflag") == "R"
    cells = li.groupBy("l_partkey").agg(
        *[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in (("a", big & late), ("b", big & ~late), ("c", ~big & late), ("d", ~big & ~late))]
    )
    ratio, lo, hi = odds_ratio(*[F.col(c) for c in "abcd"])
    return out(cells.select("l_partkey", ratio.alias("odds"), lo.alias("odds_lo"), hi.alias("odds_hi")), "l_partkey")


QUERIES["odds_ratio"] = Query(
    odds,
    f"SELECT l_partkey, {_or_sql('a', 'b', 'c', 'd', 'odds')} FROM (SELECT l_partkey, count(*) FILTER (WHERE l_quantity > 45 AND l_returnflag = 'R') AS a, "
    "count(*) FILTER (WHERE l_quantity > 45 AND l_returnflag <> 'R') AS b, count(*) FILTER (WHERE l_quantity <= 45 AND l_returnflag = 'R') AS c, "
    "count(*) FILTER (WHERE l_quantity <= 45 AND l_returnflag <> 'R') AS d FROM lineitem GROUP BY l_partkey) AS t",
)

# --- rank tests -----------------------------------------------------------------------------------------------


def _rank_ctes(values: str) -> tuple[tuple[str, str], ...]:
    """``values`` yields (k, first, x); results per k. Cliff's delta is counted over all pairs as a check."""
    return (
        ("v", values),
        (
            "cum",
            "SELECT k, x, sum(CASE WHEN first THEN 1 ELSE 0 END) OVER w AS ca, sum(CASE WHEN first THEN 0 ELSE 1 END) OVER w AS cb, "
            "count(*) FILTER (WHERE first) OVER g AS n1, count(*) FILTER (WHERE NOT first) OVER g AS n2, first, "
            "rank() OVER (PARTITION BY k ORDER BY x) + (count(*) OVER (PARTITION BY k, x) - 1) / 2e0 AS rk, count(*) OVER (PARTITION BY k, x) AS t "
            "FROM v WINDOW w AS (PARTITION BY k ORDER BY x), g AS (PARTITION BY k)",
        ),
        (
            "ks",
            "SELECT k, max(n1) AS n1, max(n2) AS n2, max(abs(ca / cast(n1 as double) - cb / cast(n2 as double))) AS d, "
            "sum(CASE WHEN first THEN rk ELSE 0 END) - max(n1) * (max(n1) + 1) / 2e0 AS u, sum(cast(t as double) * t - 1e0) AS ties FROM cum GROUP BY k",
        ),
        (
            "mw",
            "SELECT *, (greatest(u, cast(n1 as double) * n2 - u) - cast(n1 as double) * n2 / 2e0 - 5e-1) / "
            "sqrt(cast(n1 as double) * n2 / 12e0 * (n1 + n2 + 1e0 - ties / (cast(n1 + n2 as double) * (n1 + n2 - 1)))) AS z, sqrt(cast(n1 as double) * n2 / (n1 + n2)) * d AS lam FROM ks",
        ),
        (
            "pv",
            "SELECT *, greatest(0, least(1, (SELECT sum((CASE WHEN j % 2 = 1 THEN 2 ELSE -2 END) * exp(-2e0 * j * j * lam * lam)) FROM (SELECT unnest(range(1, 101)) AS j) AS s))) AS ks_p, "
            f"{erfc_sql('greatest(z, 0) / sqrt(2e0)')} AS mwu_p FROM mw",
        ),
        ("cliff", "SELECT a.k, sum(sign(a.x - b.x)) / cast(count(*) as double) AS delta FROM v AS a JOIN v AS b ON b.k = a.k WHERE a.first AND NOT b.first GROUP BY a.k"),
        ("med", "SELECT k, median(x) FILTER (WHERE first) - median(x) FILTER (WHERE NOT first) AS diff FROM v GROUP BY k"),
    )


def _bh(p: str) -> str:
    """Quadratic but plain: over a handful of result rows."""
    return (
        f"(SELECT min(b.{p} * (SELECT count(*) FROM pv) / (SELECT count(*) FROM pv AS c WHERE c.{p} <= b.{p})) FROM pv AS b WHERE b.{p} >= pv.{p})"
    )


RIVER = _rank_ctes("SELECT sector AS k, grp = 'sector' AS first, dist_river_km AS x FROM distances WHERE dist_river_km > 0")


def tests_vs_random(spark, d):
    return out(dist_plan.tests_vs_random(fx(spark, d, "distances"), "dist_river_km"), "distance_column", "sector", "n_first", "n_second")


QUERIES["tests_vs_random"] = Query(
    tests_vs_random,
    sql(
        ["distances"],
        f"SELECT 'dist_river_km' AS distance_column, pv.k AS sector, n1 AS n_first, n2 AS n_second, {R('d')} AS ks_d, {R('ks_p')} AS ks_p, {R('u')} AS mwu_u, {R('z')} AS mwu_z, "
        f"{R('mwu_p')} AS mwu_p, {R('cliff.delta')} AS cliffs_delta, {R('med.diff')} AS median_diff, {R('least(1, ' + _bh('ks_p') + ')')} AS ks_q, "
        f"{R('least(1, ' + _bh('mwu_p') + ')')} AS mwu_q FROM pv JOIN cliff ON cliff.k = pv.k JOIN med ON med.k = pv.k",
        *RIVER,
    ),
)


def _ranks(spark, d):
    rows = keep_values(fx(spark, d, "distances"), "dist_coast_km")
    return ds.rank_comparison(rows, ["sector"], "dist_coast_km", F.col("grp") == "sector")


COAST = _rank_ctes("SELECT sector AS k, grp = 'sector' AS first, dist_coast_km AS x FROM distances WHERE dist_coast_km >= 0")
QUERIES["ks_d"] = Query(
    lambda spark, d: _ranks(spark, d).select("sector", "n_first", "n_second", r6("ks_d").alias("ks_d")),
    sql(["distances"], f"SELECT k AS sector, n1 AS n_first, n2 AS n_second, {R('d')} AS ks_d FROM ks", *COAST[:3]),
)
QUERIES["mwu_u"] = Query(
    lambda spark, d: _ranks(spark, d).select("sector", r6("mwu_u").alias("mwu_u"), r6("mwu_z").alias("mwu_z")),
    sql(["distances"], f"SELECT k AS sector, {R('u')} AS mwu_u, {R('z')} AS mwu_z FROM mw", *COAST[:4]),
)
QUERIES["cliffs_delta"] = Query(
    lambda spark, d: _ranks(spark, d).select("sector", r6("cliffs_delta").alias("cliffs_delta")),
    sql(["distances"], f"SELECT k AS sector, {R('delta')} AS cliffs_delta FROM cliff", COAST[0], COAST[5]),
)
QUERIES["median_diff"] = Query(
    lambda spark, d: ds.median_difference(
        keep_values(fx(spark, d, "distances"), "dist_coast_km"), ["sector"], "dist_coast_km", F.col("grp") == "sector"
    ).select("sector", r6("median_diff").alias("median_diff")),
    sql(["distances"], f"SELECT k AS sector, {R('diff')} AS median_diff FROM med", COAST[0], COAST[6]),
)


def journal_table(spark, d):
    return dist_plan.journal_table(fx(spark, d, "distances"), "dist_lake_km")


QUERIES["journal_table"] = Query(journal_table)

# --- bootstrap ------------------------------------------------------------------------------------------------
_METRICS = regime_plan.TESTED
_LONG = " UNION ALL ".join(f"SELECT grp, '{m}' AS metric, basin_id, {m} AS x FROM grouped WHERE {m} IS NOT NULL" for m in _METRICS)
_OVERLAP = (
    "SELECT *, 'AI' AS grp FROM master WHERE AI_present = 1 UNION ALL SELECT *, 'Power' FROM master WHERE Power_present = 1 "
    "UNION ALL SELECT *, 'TRI' FROM master WHERE TRI_present = 1 UNION ALL SELECT *, 'None' FROM master WHERE any_infra = 0"
)
_EXCLUSIVE = "SELECT *, CASE WHEN AI_present = 1 THEN 'AI' WHEN Power_present = 1 THEN 'Power' WHEN TRI_present = 1 THEN 'TRI' ELSE 'None' END AS grp FROM master"
_SECTOR_NO = "CASE s.grp WHEN 'AI' THEN 0 WHEN 'Power' THEN 1 ELSE 2 END"
_METRIC_NO = "CASE s.metric WHEN 'RBI' THEN 0 WHEN 'season_conc' THEN 1 ELSE 2 END"


def _boot_ctes(exclusive: bool, where: str) -> tuple[tuple[str, str], ...]:
    return (
        HIT, PRESENCE, MASTER,
        ("grouped", _EXCLUSIVE if exclusive else _OVERLAP),
        ("vals", _LONG),
        ("pool", "SELECT *, row_number() OVER (PARTITION BY grp, metric ORDER BY x, basin_id) AS i FROM vals"),
        ("sizes", "SELECT grp, metric, count(*) AS n, median(x) AS med FROM vals GROUP BY grp, metric"),
        (
            "spec",
            f"SELECT s.grp AS sector, s.metric, s.n, p.n AS m, s.med AS med_s, p.med AS med_p, {_SECTOR_NO} * 3 + {_METRIC_NO} AS stream "
            f"FROM sizes AS s JOIN sizes AS p ON p.metric = s.metric AND p.grp = 'None' WHERE s.grp <> 'None' AND {where}",
        ),
    )


def _replicates(n: str, m: str, group: str, reps: int, seed: int, stream: str, extra: str = "") -> str:
    h = noise_u(f"(rep * {n} + t)", f"({seed} + ({stream}) * {bs.STREAM_STEP})")
    return (
        f"SELECT sector, metric, rep{extra}, median(x) AS med FROM (SELECT sector, s.metric, rep{extra}, p.x FROM (SELECT *, "
        f"cast(least(floor({h} * {m}), {m} - 1) as bigint) + 1 AS i FROM (SELECT *, unnest(range(0, {n})) AS t FROM (SELECT *, unnest(range(0, {reps})) AS rep FROM spec) AS a) AS b) AS s "
        f"JOIN pool AS p ON p.grp = {group} AND p.metric = s.metric AND p.i = s.i) AS q GROUP BY sector, metric, rep{extra}"
    )


def _values(spark, d, exclusive):
    return regime_plan.group_values(master(spark, d), exclusive=exclusive)


def boot_with_repl(spark, d):
    return out(regime_plan.effect_table(_values(spark, d, False)), "Sector", "Metric", "N_sector", "N_none_pool")


_DIFF = ", ".join(f"{R(f'quantile_cont(med_s - r.med, {p})')} AS {n}" for n, p in (("MedianDiff_sector_minus_matched", 0.5), ("CI95_low", 0.025), ("CI95_high", 0.975)))
QUERIES["boot_with_repl"] = Query(
    boot_with_repl,
    sql(
        MASTER_INPUT,
        f'SELECT s.sector AS "Sector", s.metric AS "Metric", s.n AS "N_sector", s.m AS "N_none_pool", {R("s.med_s")} AS "Median_sector", {R("s.med_p")} AS "Median_matched_baseline", {_DIFF} '
        "FROM spec AS s JOIN reps AS r ON r.sector = s.sector AND r.metric = s.metric GROUP BY s.sector, s.metric, s.n, s.m, s.med_s, s.med_p",
        *_boot_ctes(False, "s.n >= 3 AND p.n >= 3"),
        ("reps", _replicates("n", "m", "'None'", 500, 42, "stream")),
    ),
)


def boot_no_repl(spark, d):
    return out(regime_plan.matched_effect_table(_values(spark, d, True)), "Sector", "Metric", "N_sector")


_HB = noise31("(rep * m + t)", f"(7 + stream * {bs.STREAM_STEP})")
QUERIES["boot_no_repl"] = Query(
    boot_no_repl,
    sql(
        MASTER_INPUT,
        f'SELECT s.sector AS "Sector", s.metric AS "Metric", s.n AS "N_sector", {_DIFF}, '
        f"{R('least(1, 2 * least(avg(CASE WHEN med_s - r.med <= 0 THEN 1e0 ELSE 0e0 END), avg(CASE WHEN med_s - r.med >= 0 THEN 1e0 ELSE 0e0 END)))')} AS p_two_bootstrap "
        "FROM spec AS s JOIN reps AS r ON r.sector = s.sector AND r.metric = s.metric GROUP BY s.sector, s.metric, s.n, s.med_s",
        *_boot_ctes(True, "s.n >= 30 AND p.n >= s.n"),
        (
            "reps",
            "SELECT q.sector, q.metric, q.rep, median(p.x) AS med FROM (SELECT sector, metric, rep, t, n, row_number() OVER (PARTITION BY sector, metric, rep ORDER BY h, t) AS k FROM ("
            f"SELECT *, {_HB} AS h FROM (SELECT *, unnest(range(0, m)) AS t FROM (SELECT *, unnest(range(0, 800)) AS rep FROM spec) AS a) AS b) AS c) AS q "
            "JOIN pool AS p ON p.grp = 'None' AND p.metric = q.metric AND p.i = q.t + 1 WHERE q.k <= q.n GROUP BY q.sector, q.metric, q.rep",
        ),
    ),
)


def boot_two_sample(spark, d):
    values, ranked = regime_plan.written_ranks(_values(spark, d, True))
    return out(bs.bootstrap_two_sample(values, ranked, SECTORS, _METRICS), "sector", "metric", "n", "m")


_TWO_CTES = (
    *_boot_ctes(True, "s.n >= 30 AND p.n >= 30"),
    ("ra", _replicates("n", "n", "s.sector", 2000, 7, "stream * 2")),
    ("rb", _replicates("m", "m", "'None'", 2000, 7, "stream * 2 + 1")),
    (
        "two",
        "SELECT s.sector, s.metric, s.n, s.m, s.med_s - s.med_p AS d, quantile_cont(ra.med - rb.med, 0.025) AS d_lo, quantile_cont(ra.med - rb.med, 0.975) AS d_hi "
        "FROM spec AS s JOIN ra ON ra.sector = s.sector AND ra.metric = s.metric JOIN rb ON rb.sector = s.sector AND rb.metric = s.metric AND rb.rep = ra.rep "
        "GROUP BY s.sector, s.metric, s.n, s.m, s.med_s, s.med_p",
    ),
)
QUERIES["boot_two_sample"] = Query(
    boot_two_sample,
    sql(MASTER_INPUT, f"SELECT sector, metric, n, m, {R('d')} AS d, {R('d_lo')} AS d_lo, {R('d_hi')} AS d_hi FROM two", *_TWO_CTES),
)


def tests_vs_none(spark, d):
    return out(regime_plan.tests_vs_none(_values(spark, d, True)), "Metric", "Sector", "CompareTo", "N_sector", "N_none")


QUERIES["tests_vs_none"] = Query(
    tests_vs_none,
    sql(
        MASTER_INPUT,
        f'SELECT two.metric AS "Metric", two.sector AS "Sector", \'None\' AS "CompareTo", two.n AS "N_sector", two.m AS "N_none", {R("two.d")} AS "MedianDiff_sector_minus_none", '
        f'{R("d_lo")} AS "CI95_low", {R("d_hi")} AS "CI95_high", {R("pv.d")} AS "KS_D", {R("ks_p")} AS "KS_p", {R("mwu_p")} AS "MWU_p", '
        f'{R("least(1, " + _bh("ks_p") + ")")} AS "KS_pFDR", {R("least(1, " + _bh("mwu_p") + ")")} AS "MWU_pFDR" FROM pv JOIN two ON two.metric || two.sector = pv.k',
        *_TWO_CTES,
        *_rank_ctes(
            "SELECT s.metric || s.sector AS k, true AS first, x FROM spec AS s JOIN vals ON vals.grp = s.sector AND vals.metric = s.metric UNION ALL "
            "SELECT s.metric || s.sector, false, x FROM spec AS s JOIN vals ON vals.grp = 'None' AND vals.metric = s.metric"
        )[:5],
    ),
)


def ecdf_band(spark, d):
    return out(regime_plan.effect_bands(master(spark, d)), "sector", "metric", "g")


QUERIES["ecdf_band"] = Query(
    ecdf_band,
    sql(
        MASTER_INPUT,
        f"SELECT c.sector, c.metric, c.g, {R('max(grid.x)')} AS x, {R('quantile_cont(y, 0.5)')} AS b_med, {R('quantile_cont(y, 0.025)')} AS b_lo, {R('quantile_cont(y, 0.975)')} AS b_hi "
        "FROM curves AS c JOIN grid ON grid.metric = c.metric AND grid.g = c.g GROUP BY c.sector, c.metric, c.g",
        *_boot_ctes(False, "s.n >= 3 AND p.n >= 3"),
        ("lim", " UNION ALL ".join(f"SELECT '{m}' AS metric, quantile_cont({m}, 0.01) AS lo, quantile_cont({m}, {0.99 if m == 'CVQ' else 0.995}) AS hi FROM master" for m in _METRICS)),
        ("grid", "SELECT metric, g, CASE WHEN g = 249 THEN hi ELSE lo + g * ((hi - lo) / 249e0) END AS x FROM lim CROSS JOIN (SELECT unnest(range(0, 250)) AS g) AS s"),
        ("firsts", "SELECT p.metric, p.i, min(g.g) AS g FROM pool AS p JOIN grid AS g ON g.metric = p.metric AND p.x <= g.x WHERE p.grp = 'None' GROUP BY p.metric, p.i"),
        (
            "draws",
            f"SELECT sector, metric, n, rep, cast(least(floor({noise_u('(rep * n + t)', f'(42 + stream * {bs.STREAM_STEP})')} * m), m - 1) as bigint) + 1 AS i FROM ("
            "SELECT *, unnest(range(0, n)) AS t FROM (SELECT *, unnest(range(0, 500)) AS rep FROM spec) AS a) AS b",
        ),
        ("bins", "SELECT d.sector, d.metric, d.rep, f.g, count(*) AS c FROM draws AS d JOIN firsts AS f ON f.metric = d.metric AND f.i = d.i GROUP BY ALL"),
        (
            "curves",
            "SELECT s.sector, s.metric, s.rep, s.g, sum(coalesce(b.c, 0)) OVER (PARTITION BY s.sector, s.metric, s.rep ORDER BY s.g) / cast(s.n as double) AS y FROM "
            "(SELECT *, unnest(range(0, 250)) AS g FROM (SELECT *, unnest(range(0, 500)) AS rep FROM spec) AS a) AS s "
            "LEFT JOIN bins AS b ON b.sector = s.sector AND b.metric = s.metric AND b.rep = s.rep AND b.g = s.g",
        ),
    ),
)

# --- models ---------------------------------------------------------------------------------------------------


def _presence(spark, d):
    dist = keep_values(fx(spark, d, "distances"), "dist_river_km").withColumnRenamed("dist_river_km", "dist_km")
    return models.presence_frame(dist.filter("grp = 'sector'"), dist.filter("grp = 'random'"))


NEWTON_STEPS = 10


def newton_ctes(rows: str, k: int, keys: tuple[str, ...] = (), penalty: float = 0.0, steps: int = NEWTON_STEPS) -> tuple[tuple[str, str], ...]:
    """``fit``: coefficients b0.., Hessian h_i_j and log-likelihood ll at them, after so many whole Newton steps on the table ``rows`` (keys, y, x1..xk)."""
    n, names = k + 1, [f"b{i}" for i in range(k + 1)]
    own = "".join(f"{c}, " for c in keys)
    x = ["1e0", *[f"x{i}" for i in range(1, n)]]
    group = f" GROUP BY {', '.join(keys)}" if keys else ""
    meet = f"JOIN {{}} AS b USING ({', '.join(keys)})" if keys else "CROSS JOIN {} AS b"
    ridge = [0.0] + [penalty] * k

    def sums(at: str) -> str:
        eta = " + ".join(f"{b} * {a}" for b, a in zip(names, x))
        p = f"SELECT *, 1e0 / (1e0 + exp(-e)) AS p FROM (SELECT r.*, {', '.join(names)}, {eta} AS e FROM {rows} AS r {meet.format(at)}) AS s"
        told = [f"any_value({b}) AS {b}" for b in names]
        told += [f"sum((y - p) * {x[i]}) - {num(ridge[i])} * any_value(b{i}) AS g_{i}" for i in range(n)]
        told += [f"sum(p * (1e0 - p) * {x[i]} * {x[j]}) + {num(ridge[i] if i == j else 0.0)} AS h_{i}_{j}" for i in range(n) for j in range(n)]
        return f"SELECT {own}count(*) AS n, sum(y * ln(p) + (1e0 - y) * ln(1e0 - p)) AS ll, {', '.join(told)} FROM ({p}) AS s{group}"

    def solved(inner: str) -> str:
        """Gauss-Jordan elimination, a nested query a pivot."""
        for q in range(n):
            change = [f"h_{i}_{j} - h_{i}_{q} * h_{q}_{j} / h_{q}_{q} AS h_{i}_{j}" if i != q else f"h_{q}_{j} / h_{q}_{q} AS h_{q}_{j}" for i in range(n) for j in range(n)]
            change += [f"g_{i} - h_{i}_{q} * g_{q} / h_{q}_{q} AS g_{i}" if i != q else f"g_{q} / h_{q}_{q} AS g_{q}" for i in range(n)]
            inner = f"SELECT {own}{', '.join(names)}, {', '.join(change)} FROM ({inner}) AS s"
        return f"SELECT {own}{', '.join(f'b{i} + g_{i} AS b{i}' for i in range(n))} FROM ({inner}) AS s"

    start = ", ".join(["ln(avg(y) / (1e0 - avg(y))) AS b0", *[f"0e0 AS b{i}" for i in range(1, n)]])
    ctes = [("at0", f"SELECT {own}{start} FROM {rows}{group}")]
    ctes += [(f"at{t}", solved(sums(f"at{t - 1}"))) for t in range(1, steps + 1)]
    return (*ctes, ("fit", sums(f"at{steps}")), ("nothing", f"SELECT {own}count(*) * (avg(y) * ln(avg(y)) + (1 - avg(y)) * ln(1 - avg(y))) AS ll0 FROM {rows}{group}"))


def _fit_sql(keys: tuple[str, ...] = ()) -> str:
    """The columns of a distance fit from ``fit`` and ``nothing``."""
    meet = f"JOIN nothing USING ({', '.join(keys)})" if keys else "CROSS JOIN nothing"
    told = f"SELECT *, sqrt(h_0_0 / (h_0_0 * h_1_1 - h_0_1 * h_0_1)) AS s FROM fit {meet}"
    z = "1.959963984540054e0"
    return (
        f"SELECT {''.join(f'{c}, ' for c in keys)}{R('b1')} AS coef, {R('b0')} AS intercept, {R('s')} AS se, {R('exp(b1)')} AS odds_ratio, {R(f'exp(b1 - s * {z})')} AS or_lo, {R(f'exp(b1 + s * {z})')} AS or_hi, "
        f"{R(erfc_sql('abs(b1 / s) / sqrt(2e0)'))} AS p_value, {R('1e0 - ll / ll0')} AS pseudo_r2, {R(erfc_sql('sqrt(greatest(ll - ll0, 0e0))'))} AS llr_p FROM ({told}) AS f"
    )


PRESENCE_ROWS = (
    "rows_",
    "SELECT CASE WHEN grp = 'sector' THEN 1e0 ELSE 0e0 END AS y, dist_river_km AS d, ln(dist_river_km + 1e0) AS x1 FROM distances WHERE dist_river_km >= 0 AND NOT isnan(dist_river_km) AND NOT isinf(dist_river_km)",
)
QUERIES["logit_distance"] = Query(lambda spark, d: out(models.fit_distance_logit(_presence(spark, d))), sql(["distances"], _fit_sql(), PRESENCE_ROWS, *newton_ctes("rows_", 1)))


def logit_curve(spark, d):
    frame = _presence(spark, d)
    return out(models.probability_curve(frame, models.fit_distance_logit(frame)), "g")


QUERIES["logit_curve"] = Query(
    logit_curve,
    sql(
        ["distances"],
        f"SELECT g, {R('x')} AS dist_km, {R('1e0 / (1e0 + exp(-(b0 + b1 * ln(x + 1e0))))')} AS prob FROM "
        "(SELECT cast(g as integer) AS g, hi * g / 299e0 AS x, b0, b1 FROM (SELECT unnest(range(0, 300)) AS g) AS s CROSS JOIN fit CROSS JOIN (SELECT greatest(quantile_cont(d, 0.995), 50e0) AS hi FROM rows_) AS t) AS c",
        PRESENCE_ROWS, *newton_ctes("rows_", 1),
    ),
)

_ALL_METRICS = " AND ".join(f"{m} IS NOT NULL" for m in regime_plan.TABLE_METRICS)
PENALISED_ROWS = (
    "rows_",
    "SELECT cast(AI_present as double) AS y, " + ", ".join(f"({m} - avg({m}) OVER ()) / stddev_pop({m}) OVER () AS x{i}" for i, m in enumerate(regime_plan.TABLE_METRICS, 1)) + f" FROM master WHERE {_ALL_METRICS}",
)
QUERIES["logit_l2"] = Query(
    lambda spark, d: out(models.penalised_odds_ratios(master(spark, d, "left"), "AI_present", regime_plan.TABLE_METRICS), "predictor"),
    sql(
        MASTER_INPUT,
        " UNION ALL ".join(f"SELECT '{m}' AS predictor, {R(f'b{i}')} AS coef, {R(f'exp(b{i})')} AS odds_ratio FROM fit WHERE n > 50" for i, m in enumerate(regime_plan.TABLE_METRICS, 1)),
        HIT, PRESENCE, MASTER, PENALISED_ROWS, *newton_ctes("rows_", len(regime_plan.TABLE_METRICS), penalty=1.0, steps=6),
    ),
)


def logit_pipeline(spark, d):
    dist = dist_plan.matched_distances(spark, fx(spark, d, "facilities"), fx(spark, d, "basin_edges"), fx(spark, d, "water_segments"))
    return out(dist_plan.logit_table(dist), "sector", "n_sector", "n_random")


def _pipeline_ctes() -> tuple[tuple[str, str], ...]:
    """``rows_``: sites inside basins and as many random points, with the distance to the nearest major river."""
    sites = f"SELECT sector, 'sector' AS grp, site_id AS k, x, y FROM ({inside_sql('spots', 'edges_m', 'p.sector, p.site_id, p.x, p.y, e.basin_id', 'p.sector, p.site_id, p.x, p.y, e.basin_id', 'x', 'y')}) AS i"
    asked = f"SELECT sector, seed, unnest(range(0, n)) AS draw FROM (SELECT sector, count(*) AS n, 7 + CASE sector {' '.join(f'WHEN {chr(39)}{s}{chr(39)} THEN {v}' for s, v in dist_plan.SEED_OFFSETS.items())} ELSE 0 END AS seed FROM inside GROUP BY sector) AS a"
    return (
        ("edges_m", projected_edges_sql("basin_edges", "basin_id, ring")),
        ("spots", projected_points_sql("facilities", "sector, site_id")),
        ("major", projected_edges_sql("water_segments", "kind, feature_id") + " WHERE kind = 'River' AND ord >= 5"),
        ("inside", sites),
        *area_ctes("edges_m"),
        ("asked", asked),
        ("drawn", place_sql("asked", "d.seed", "sector, draw")),
        ("both_", "SELECT sector, grp, k, x, y FROM inside UNION ALL SELECT sector, 'random', draw, x, y FROM drawn"),
        # a site in several basins has as many rows
        ("near_", f"SELECT p.sector, p.grp, p.k, p.x, p.y, min({distance_sql('p.x', 'p.y')}) / 1e3 AS d FROM (SELECT DISTINCT * FROM both_) AS p CROSS JOIN major AS s GROUP BY ALL"),
        ("rows_", "SELECT b.sector, b.grp, CASE WHEN b.grp = 'sector' THEN 1e0 ELSE 0e0 END AS y, ln(d + 1e0) AS x1 FROM both_ AS b JOIN near_ AS n ON n.sector = b.sector AND n.grp = b.grp AND n.k = b.k AND n.x = b.x AND n.y = b.y"),
    )


QUERIES["logit_pipeline"] = Query(
    logit_pipeline,
    sql(
        ["facilities", "basin_edges", "water_segments"],
        f"SELECT f.*, n_sector, n_random FROM ({_fit_sql(('sector',))}) AS f JOIN "
        "(SELECT sector, count(*) FILTER (WHERE grp = 'sector') AS n_sector, count(*) FILTER (WHERE grp = 'random') AS n_random FROM rows_ GROUP BY sector) AS c USING (sector)",
        *_pipeline_ctes(), *newton_ctes("rows_", 1, ("sector",)),
    ),
)
