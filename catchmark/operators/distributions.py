"""Empirical distributions, descriptives and rank comparisons over groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catchmark.functions.tails import kolmogorov_sf, normal_two_sided
from catchmark.operators.lineage import cut
from catchmark.operators.ordered import attach, exact_quantiles, per_group, running_totals


def value_counts(df: DataFrame, keys: Sequence[str], value: str, **measures: Column) -> DataFrame:
    """One row per (keys, value) with summed measures: the form every operator below works on."""
    if not measures:
        measures = {"n": F.lit(1).cast("bigint")}
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    return clean.groupBy(*keys, F.col(value).alias("x")).agg(*[F.sum(c).alias(m) for m, c in measures.items()])


def ranked_rows(df: DataFrame, keys: Sequence[str], value: str, row_id: str, salt: int = 32) -> DataFrame:
    """(keys, x, row_id, i, n, last): i = 1..n in value order, tied rows taking successive numbers.

    A value shared by many rows is split into ``salt`` parts, so a tie never lands in one task; ``last`` is the
    number of values up to and including x.
    """
    keys = list(keys)
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(
        *keys, F.col(value).alias("x"), F.col(row_id), F.pmod(F.xxhash64(row_id), F.lit(salt)).alias("_part")
    )
    parts = rows.groupBy(*keys, "x", "_part").agg(F.count(F.lit(1)).alias("_m"))
    totals = running_totals(parts.groupBy(*keys, "x").agg(F.sum("_m").alias("n")), keys, "x", ["n"])
    earlier = W.partitionBy(*keys, "x").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    base = parts.withColumn("_earlier", F.coalesce(F.sum("_m").over(earlier), F.lit(0))).join(
        totals.drop("_slice"), [*keys, "x"]
    )
    base = base.select(
        *keys, "x", "_part", (F.col("cum_n") - F.col("n") + F.col("_earlier")).alias("_base"), "cum_n", "tot_n"
    )
    order = W.partitionBy(*keys, "x", "_part").orderBy(row_id)
    numbered = rows.withColumn("_rn", F.row_number().over(order)).join(base, [*keys, "x", "_part"])
    return numbered.select(
        *keys, "x", row_id, (F.col("_base") + F.col("_rn")).alias("i"), F.col("tot_n").alias("n"), F.col("cum_n").alias("last")
    )


def ecdf_rows(df: DataFrame, keys: Sequence[str], value: str, row_id: str) -> DataFrame:
    """One row per value: x, y = i/n (tied values take successive y), y_step = the step function's upper value."""
    ranked = ranked_rows(df, keys, value, row_id)
    return ranked.select(*keys, "x", (F.col("i") / F.col("n")).alias("y"), (F.col("last") / F.col("n")).alias("y_step"))


def linear_grid(limits: DataFrame, keys: Sequence[str], low: str, high: str, n: int = 250) -> DataFrame:
    """``n`` evenly spaced points from low to high for every row of ``limits``."""
    step = (F.col(high) - F.col(low)) / float(n - 1)
    return limits.select(*keys, low, high, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("g")).select(
        *keys, "g", F.when(F.col("g") == n - 1, F.col(high)).otherwise(F.col(low) + F.col("g") * step).alias("x")
    )


def quantile_grid(counts: DataFrame, keys: Sequence[str], low: float = 0.01, high: float = 0.99, n: int = 250, measure: str = "n") -> DataFrame:
    """(keys, g, x): the linear-interpolation quantiles at ``n`` even probabilities from low to high, for groups of any size.

    ``counts`` is (keys, x, n). Running totals tell which ranks a distinct value covers, so each says by itself which grid points lie on
    it; a grid point meets only its two neighbours, and values without one give no row.
    """
    keys, step = list(keys), (high - low) / (n - 1)
    run = running_totals(counts.select(*keys, F.col("x").cast("double").alias("x"), F.col(measure).alias("n")), keys, "x", ["n"])
    place = lambda g: (F.lit(low) + g * F.lit(step)) * (F.col("tot_n") - 1)
    span = F.greatest(F.col("tot_n") - 1, F.lit(1))
    near = lambda rank: (rank / span - F.lit(low)) / F.lit(step)
    clip = lambda c: F.greatest(F.lit(0), F.least(F.lit(n - 1), c)).cast("int")
    # the division only narrows the search; one grid point to either side makes up for its rounding
    first, last = clip(F.floor(near(F.col("cum_n") - F.col("n") - 1)) - 1), clip(F.ceil(near(F.col("cum_n"))) + 1)
    covers = lambda rank: (rank >= F.col("cum_n") - F.col("n")) & (rank < F.col("cum_n"))
    points = F.transform(
        F.sequence(first, last),
        lambda g: F.struct(g.alias("g"), covers(F.floor(place(g))).alias("lower"), covers(F.floor(place(g)) + 1).alias("upper")),
    )
    own = F.filter(points, lambda q: q["lower"] | q["upper"])
    each = run.select(*keys, "x", "tot_n", F.explode(own).alias("q")).select(*keys, "x", "tot_n", "q.*")
    part = place(F.col("g")) - F.floor(place(F.col("g")))
    found = each.groupBy(*keys, "g").agg(
        F.max(F.when(F.col("lower"), F.col("x"))).alias("_lower"), F.max(F.when(F.col("upper"), F.col("x"))).alias("_upper"), F.max(part).alias("_part")
    )
    return found.select(*keys, "g", (F.col("_lower") + (F.coalesce("_upper", "_lower") - F.col("_lower")) * F.col("_part")).alias("x"))


def ecdf_on_grid(counts: DataFrame, grid: DataFrame, keys: Sequence[str], n: str = "n") -> DataFrame:
    """#(values <= grid point)/n at each grid point, by one running total over values and grid together.

    ``counts`` is (keys, x, n); ``grid`` is (keys, g, x), at most a few hundred points per group.
    """
    keys = list(keys)
    both = counts.select(*keys, "x", F.col(n).alias("n"), F.lit(None).cast("int").alias("g")).unionByName(
        grid.select(*keys, F.col("x").cast("double").alias("x"), F.lit(0).cast("bigint").alias("n"), F.col("g").cast("int").alias("g"))
    )
    merged = both.groupBy(*keys, "x").agg(F.sum("n").alias("n"), F.collect_list("g").alias("_gs"))
    summed = running_totals(merged, keys, "x", ["n"])
    return summed.select(
        *keys, F.explode("_gs").alias("g"), "x", F.when(F.col("tot_n") > 0, F.col("cum_n") / F.col("tot_n")).alias("y")
    )


def descriptives(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """N, median, quartiles and mean per group."""
    keys = list(keys)
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    sizes = clean.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    cuts = exact_quantiles(clean, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    return attach(sizes, cuts, keys)


def summary_counts(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """N of all rows and the NULL-skipping median of each column, per group."""
    keys = list(keys)
    long = df.unpivot(keys, list(values), "column", "value")
    medians = exact_quantiles(long, [*keys, "column"], "value", {"m": 0.5})
    wide = medians.groupBy(*keys).agg(*[F.max(F.when(F.col("column") == v, F.col("m"))).alias(f"median_{v}") for v in values])
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).join(wide, keys, "left")


def histogram(df: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """Equal-width bins over min..max with a closed last bin; empty bins are kept."""
    vals = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(value).alias("v"))
    span = vals.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / float(bins)
    index = F.least(F.floor((F.col("v") - F.col("lo")) * float(bins) / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    index = F.when(F.col("hi") > F.col("lo"), index).otherwise(F.lit(bins // 2))
    counted = attach(vals, span, []).groupBy(index.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = span.select("lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return spine.join(F.broadcast(counted), "bin", "left").select(  # at most `bins` rows
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("left_edge"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("right_edge"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )


def axis_limits(
    df: DataFrame, keys: Sequence[str], value: str, low: float, high: float, floor: float | None = None, min_factor: float | None = None
) -> DataFrame:
    """Pooled quantile limits; optionally floored below, and stretched so that hi >= min_factor * lo."""
    got = exact_quantiles(df, keys, value, {"lo": low, "hi": high})
    if floor is not None:
        got = got.withColumn("lo", F.greatest("lo", F.lit(float(floor))))
    if min_factor is not None:
        got = got.withColumn("hi", F.greatest(F.col("hi"), F.col("lo") * float(min_factor)))
    return got


def rank_comparison(df: DataFrame, keys: Sequence[str], value: str, is_first: Column) -> DataFrame:
    """KS, Mann-Whitney and Cliff's delta of the first sample against the second, per group.

    All three come from one running count over the pooled distinct values; no pair of rows is ever formed.
    p-values are the limit laws (KS series; normal with tie and continuity correction).
    """
    keys = list(keys)
    one = F.lit(1).cast("bigint")
    counts = value_counts(
        df, keys, value, a=F.when(is_first, one).otherwise(F.lit(0)), b=F.when(is_first, F.lit(0)).otherwise(one)
    )
    run = running_totals(counts, keys, "x", ["a", "b"])
    ties = (F.col("a") + F.col("b")).cast("double")
    below = F.col("cum_a") + F.col("cum_b") - ties
    n1, n2 = F.col("n_first").cast("double"), F.col("n_second").cast("double")
    stats = run.groupBy(*keys).agg(
        F.max("tot_a").alias("n_first"),
        F.max("tot_b").alias("n_second"),
        F.max(F.abs(F.col("cum_a") / F.col("tot_a") - F.col("cum_b") / F.col("tot_b"))).alias("ks_d"),
        F.sum(F.col("a") * (below + (ties + 1.0) / 2.0)).alias("_rank_sum"),
        F.sum(ties * ties * ties - ties).alias("_ties"),
    )
    stats = stats.filter((F.col("n_first") > 0) & (F.col("n_second") > 0))
    n = n1 + n2
    u = F.col("_rank_sum") - n1 * (n1 + 1.0) / 2.0
    # grouping the tie term with n keeps the variance exact to rounding
    sd = F.sqrt(n1 * n2 / 12.0 * (n + 1.0 - F.col("_ties") / (n * (n - 1.0))))
    z = (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / F.when(sd > 0, sd)
    en = F.sqrt(n1 * n2 / n)
    return stats.select(
        *keys,
        "n_first",
        "n_second",
        "ks_d",
        kolmogorov_sf(en * F.col("ks_d")).alias("ks_p"),
        u.alias("mwu_u"),
        z.alias("mwu_z"),
        F.coalesce(F.least(F.lit(1.0), normal_two_sided(F.greatest(z, F.lit(0.0)))), F.lit(1.0)).alias("mwu_p"),
        (2.0 * u / (n1 * n2) - 1.0).alias("cliffs_delta"),
    )


def median_difference(df: DataFrame, keys: Sequence[str], value: str, is_first: Column) -> DataFrame:
    """Median of the first sample minus median of the second."""
    keys = list(keys)
    flagged = df.withColumn("_first", is_first)
    med = exact_quantiles(flagged, [*keys, "_first"], value, {"m": 0.5})
    wide = med.groupBy(*keys).agg(
        F.max(F.when(F.col("_first"), F.col("m"))).alias("median_first"),
        F.max(F.when(~F.col("_first"), F.col("m"))).alias("median_second"),
    )
    return wide.withColumn("median_diff", F.col("median_first") - F.col("median_second"))


def bh_fdr(df: DataFrame, p: str, q: str, keys: Sequence[str] = ()) -> DataFrame:
    """Benjamini-Hochberg q-values over a table of any size; NULL p-values stay NULL and do not count.

    Works on distinct p: the smallest p*n/rank among ties is the one at the last rank. Their counts and q are written once, so the
    rows are read twice, and the planner knows how large the table of q is.
    """
    keys = list(keys)
    # NULL is left out after writing: a filter before would be pushed into the expression of p
    counts = cut(df.groupBy(*keys, F.col(p).alias("x")).agg(F.count(F.lit(1)).alias("n")), "p-counts")
    run = running_totals(counts.filter(F.col("x").isNotNull() & ~F.isnan("x")), keys, "x", ["n"])
    raw = run.withColumn("_raw", F.col("x") * F.col("tot_n") / F.col("cum_n"))
    later = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_slice").rowsBetween(1, W.unboundedFollowing)
    per_slice = raw.groupBy(*keys, "_slice").agg(F.min("_raw").alias("_slice_min"))
    per_slice = per_slice.select(*keys, "_slice", F.min("_slice_min").over(later).alias("_later"))
    onward = W.partitionBy(*keys, "_slice").orderBy("x").rowsBetween(0, W.unboundedFollowing)
    joined = raw.withColumn("_here", F.min("_raw").over(onward)).join(
        per_group(per_slice, "slice-minima"), [*keys, "_slice"]
    )
    table = joined.select(
        *keys, F.col("x").alias(p), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.least("_here", "_later"))).alias(q)
    )
    return df.join(cut(table, "q-values"), [*keys, p], "left")


def bh_fdr_results(df: DataFrame, p: str, q: str) -> DataFrame:
    """Benjamini-Hochberg over a finished result table (a row per sector and metric): one small window."""
    family = W.partitionBy(F.col(p).isNull())
    rank = F.row_number().over(family.orderBy(p))
    ranked = df.withColumn("_raw", F.col(p) * F.count(p).over(family) / rank)
    # a range frame takes tied p-values together
    onward = family.orderBy(p).rangeBetween(W.currentRow, W.unboundedFollowing)
    capped = F.least(F.lit(1.0), F.min("_raw").over(onward))  # least skips a NULL
    return ranked.withColumn(q, F.when(F.col(p).isNotNull(), capped)).drop("_raw")
