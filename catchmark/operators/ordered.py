"""Exact order statistics and running totals without sorting a whole group in one task.

A sector can hold a third of all rows, so a plain ``Window.partitionBy(sector)`` or ``percentile`` would put
that third on one executor. Here a bounded sketch finds approximate cut values first; the exact answer then
needs only the rows between two cuts (quantiles) or one window per slice of the value range (running totals).
The sketch decides only how work is split, never the result: quantiles check that the cuts enclose the answer.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catchmark.operators.lineage import cut

BROADCAST_ROWS = 10_000


def require(condition: Column, message: str) -> Column:
    """Filter condition that stops the query instead of dropping rows."""
    return F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))


def per_group(df: DataFrame, name: str) -> DataFrame:
    """A per-group table to join with rows: written once, broadcast while it has at most BROADCAST_ROWS rows.

    Beyond that the join is an ordinary one of two scans, which Spark may broadcast or split as it sees fit.
    """
    written = cut(df, name)
    return F.broadcast(written) if written.count() <= BROADCAST_ROWS else written


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Put per-group values on every row; few groups are broadcast, so the rows are not shuffled."""
    if keys:
        return df.join(per_group(stats, "per-group"), list(keys))
    return df.crossJoin(F.broadcast(stats))  # a keyless aggregate is exactly one row


def group_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float]) -> DataFrame:
    """Linear-interpolation quantiles for many groups of bounded size (days of a reach, reaches of a basin)."""
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(value))
    q = F.percentile(F.col(value), list(probs.values()))
    got = clean.groupBy(*keys).agg(q.alias("_q"))
    return got.select(*keys, *[F.col("_q")[i].alias(name) for i, name in enumerate(probs)])


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    accuracy: int = 10_000,
) -> DataFrame:
    """Exact linear-interpolation quantiles for groups of any size; columns are named by ``probs``.

    Pass 1 is a sketch per group (combined on the map side). Pass 2 counts the rows below each bracket and
    keeps, as (value, count), only those inside it: about 16/accuracy of a group.
    """
    keys, names = list(keys), list(probs)
    eps = 8.0 / accuracy
    vals = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(
        F.col("_v").isNotNull() & ~F.isnan("_v")
    )
    lows = [max(0.0, probs[n] - eps) for n in names]
    highs = [min(1.0, probs[n] + eps) for n in names]
    stats = vals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
        F.percentile_approx("_v", lows + highs, accuracy).alias("_cut"),
    )

    def edge(position, prob, end):
        # groups too small for the sketch's slack, and probabilities near 0 or 1, use the full range
        full = F.col("_n") * eps < 4
        return F.when(full | F.lit(prob in (0.0, 1.0)), F.col(end)).otherwise(F.col("_cut")[position])

    brackets = F.array(
        *[
            F.struct(
                F.lit(i).alias("i"),
                edge(i, lows[i], "_min").alias("lo"),
                edge(len(names) + i, highs[i], "_max").alias("hi"),
            )
            for i in range(len(names))
        ]
    )
    stats = stats.select(*keys, "_n", F.col("_cut").isNotNull().alias("_has"), brackets.alias("_brackets"))
    probed = (
        attach(vals, stats.drop("_has"), keys)
        .select(*keys, "_v", "_n", F.explode("_brackets").alias("_b"))
        .filter(F.col("_v") <= F.col("_b.hi"))
        .select(*keys, "_n", F.col("_b.i").alias("_i"), F.when(F.col("_v") >= F.col("_b.lo"), F.col("_v")).alias("_v"))
        .groupBy(*keys, "_i", "_v")
        .agg(F.count(F.lit(1)).alias("_c"), F.max("_n").alias("_n"))
    )
    up_to = W.partitionBy(*keys, "_i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    ranked = probed.withColumn("_cum", F.sum("_c").over(up_to))
    prob = F.element_at(F.array(*[F.lit(float(probs[n])) for n in names]), F.col("_i") + 1)
    ranked = ranked.withColumn("_pos", prob * (F.col("_n") - 1)).withColumn("_k", F.floor("_pos"))
    per_prob = ranked.groupBy(*keys, "_i").agg(
        F.max(F.col("_pos") - F.col("_k")).alias("_frac"),
        F.max(F.when(F.col("_v").isNull(), F.col("_c") - F.col("_k")).otherwise(F.lit(-1))).alias("_over"),
        F.min(F.when(F.col("_cum") >= F.col("_k") + 1, F.col("_v"))).alias("_lower"),
        F.min(F.when(F.col("_cum") >= F.col("_k") + 2, F.col("_v"))).alias("_upper"),
    )
    enclosed = (F.col("_over") <= 0) & F.col("_lower").isNotNull() & (
        F.col("_upper").isNotNull() | (F.col("_frac") < 1e-9)
    )
    upper = F.coalesce(F.col("_upper"), F.col("_lower"))
    per_prob = per_prob.filter(require(enclosed, "quantile bracket missed its value; raise accuracy")).withColumn(
        "_q", F.col("_lower") + (upper - F.col("_lower")) * F.col("_frac")
    )
    return per_prob.groupBy(*keys).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)])


def with_slices(df: DataFrame, keys: Sequence[str], order: str, splits: str, n_slices: int) -> DataFrame:
    """Slice number = how many of the group's sorted cut values lie below the row, by binary search."""
    out = df.withColumn("_slice", F.lit(0))
    step = n_slices // 2
    while step >= 1:
        cut = F.get(F.col(splits), F.col("_slice") + (step - 1))
        out = out.withColumn("_slice", F.col("_slice") + F.when(F.col(order) > cut, step).otherwise(0))
        step //= 2
    return out


def running_totals(
    counts: DataFrame,
    keys: Sequence[str],
    order: str,
    measures: Sequence[str],
    n_slices: int = 64,
) -> DataFrame:
    """Add ``cum_m`` (inclusive, ascending) and ``tot_m`` for each measure; also leaves ``_slice``.

    ``counts`` holds one row per (keys, order). Each slice of a group's value range is one window partition;
    the offsets between slices come from a table of at most ``n_slices`` rows per group.
    """
    keys, measures = list(keys), list(measures)
    cuts = [i / n_slices for i in range(1, n_slices)]
    # summing the measures here keeps this branch's columns equal to the others', so the exchange is reused
    stats = counts.groupBy(*keys).agg(
        F.percentile_approx(order, cuts, 100 * n_slices).alias("_cuts"),
        *[F.sum(m).alias(f"tot_{m}") for m in measures],
    )
    # the sketch depends on the order in which parts arrive, and rows and offsets must be cut at the same values: one written sketch serves both
    stats = cut(stats, "slice-cuts")
    sliced = with_slices(attach(counts, stats, keys), keys, order, "_cuts", n_slices).drop("_cuts")
    offsets = sliced.groupBy(*keys, "_slice").agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    before = W.partitionBy(*(keys or [F.lit(0)])).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = offsets.select(
        *keys, "_slice", *[F.coalesce(F.sum(f"_s_{m}").over(before), F.lit(0)).alias(f"_o_{m}") for m in measures]
    )
    within = W.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    local = sliced.withColumns({f"_c_{m}": F.sum(m).over(within) for m in measures})
    out = local.join(per_group(offsets, "slice-offsets"), [*keys, "_slice"])
    return out.withColumns({f"cum_{m}": F.col(f"_c_{m}") + F.col(f"_o_{m}") for m in measures}).drop(
        *[f"_c_{m}" for m in measures], *[f"_o_{m}" for m in measures]
    )


def first_n_by(
    df: DataFrame, rank: Column, span: int, tie: str, n: int, n_slices: int = 1024, must_fill: bool = False
) -> DataFrame:
    """The ``n`` rows smallest in (rank, tie), where rank is roughly uniform over [0, span).

    Slices below the cut are kept without sorting; only the slice where the n-th row falls is ranked. With
    ``must_fill`` fewer than ``n`` rows are an error.
    """
    rows = df.withColumn("_rank", rank).withColumn(
        "_slice", F.floor(F.col("_rank") * F.lit(float(n_slices)) / F.lit(float(span))).cast("int")
    )
    sizes = rows.groupBy("_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    if must_fill:
        got = F.sum("_size").over(W.partitionBy(F.lit(0)))
        sizes = sizes.withColumn("_got", got).filter(require(F.col("_got") >= n, f"fewer than {n} rows to choose from")).drop("_got")
    # at most n_slices + 1 rows by construction
    tagged = rows.join(F.broadcast(sizes), "_slice").filter(F.col("_before") < n)
    whole = tagged.filter(F.col("_before") + F.col("_size") <= n)
    cut = tagged.filter(F.col("_before") + F.col("_size") > n)
    cut = cut.withColumn("_rn", F.row_number().over(W.partitionBy("_slice").orderBy("_rank", tie)))
    cut = cut.filter(F.col("_before") + F.col("_rn") <= n).drop("_rn")
    return whole.unionByName(cut).drop("_rank", "_slice", "_size", "_before")
