"""Logistic models by Newton's method, for all groups of a key at once.

A step is one aggregate over the rows of the groups that still move: per group the gradient, the Hessian's triangle and the log-likelihood
at its present coefficients, which arrive as a small table. The normal equations are solved by a Cholesky factor on the group's row (``functions.linear``),
so nothing is gathered, a group may hold any share of the rows, and each group stops by itself. A step that lowers the likelihood is halved.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchmark.functions.linear import backward, cholesky, forward, inverse_diagonal
from catchmark.functions.tails import chi2_sf, normal_two_sided
from catchmark.operators.lineage import cut
from catchmark.operators.ordered import BROADCAST_ROWS, attach, exact_quantiles

Z95 = 1.959963984540054
TOLERANCE, STEPS = 1e-9, 60


def presence_frame(sector: DataFrame, random: DataFrame, dist: str = "dist_km", keys: Sequence[str] = ()) -> DataFrame:
    """presence 1/0, dist_km and log_dist = ln(dist + 1), with the keys."""
    rows = sector.select(*keys, F.lit(1.0).alias("presence"), F.col(dist).alias("dist_km")).unionByName(
        random.select(*keys, F.lit(0.0).alias("presence"), F.col(dist).alias("dist_km"))
    )
    return rows.withColumn("log_dist", F.log(F.col("dist_km") + 1.0))


def _moments(eta: Column, y: Column, x: list[Column]) -> list[Column]:
    """log-likelihood, gradient and Hessian triangle at linear predictor ``eta``."""
    p = 1.0 / (1.0 + F.exp(-eta))
    weight = p * (1.0 - p)
    # ln(1 + e^eta) without overflow
    loglik = y * eta - (F.greatest(eta, F.lit(0.0)) + F.log1p(F.exp(-F.abs(eta))))
    gradient = [F.sum((y - p) * a) for a in x]
    hessian = [F.sum(weight * x[i] * x[j]) for i in range(len(x)) for j in range(i + 1)]
    return [F.sum(loglik).alias("loglik"), F.array(*gradient).alias("_g"), F.array(*hessian).alias("_h")]


def fit_logistic(rows: DataFrame, keys: Sequence[str], label: str, predictors: Sequence[str], penalty: float = 0.0, steps: int = STEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """One row a group: n, coef (array, intercept first), variance (array), loglik, null_loglik, steps, converged.

    ``label`` is 0.0 or 1.0; rows with a null in any column of the model are left out. ``penalty`` times half the squared coefficients, without the intercept, is
    taken off the likelihood. A group of one class, with predictors that determine each other, or without a finite
    optimum (its classes are parted by a line) has no estimate: its arrays are NULL and ``converged`` is false. An empty table gives no groups.
    """
    keys, k = list(keys), len(predictors) + 1
    data = cut(rows.select(*keys, F.col(label).cast("double").alias("_y"), *[F.col(p).cast("double").alias(f"_x{i}") for i, p in enumerate(predictors, 1)]).dropna(), "logistic-rows")
    x = [F.lit(1.0), *[F.col(f"_x{i}") for i in range(1, k)]]
    zeros = [F.lit(0.0)] * (k - 1)

    counted = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("share")).filter("n > 0")
    odds = F.log(F.col("share") / F.when(F.col("share") < 1, 1.0 - F.col("share")))
    null_loglik = F.col("n") * (F.col("share") * F.log("share") + (1.0 - F.col("share")) * F.log(1.0 - F.col("share")))
    mixed = (F.col("share") > 0) & (F.col("share") < 1)
    state = cut(
        counted.select(
            *keys, "n", F.when(mixed, null_loglik).alias("null_loglik"), F.when(mixed, F.array(odds, *zeros)).alias("coef"), F.array(*zeros, F.lit(0.0)).alias("_delta"),
            F.lit(None).cast("double").alias("_before"), F.lit(None).cast("double").alias("loglik"), F.lit(None).cast("array<double>").alias("variance"),
            F.lit(0).alias("steps"), (~mixed).alias("_done"), F.lit(False).alias("converged"),
        ),
        "logistic-state",
    )

    # all expressions are by name, so they are built once for all steps
    ridge = [0.0] + [float(penalty)] * (k - 1)
    eta = sum((F.get("_b", F.lit(i)) * x[i] for i in range(1, k)), F.get("_b", F.lit(0)))
    sums = _moments(eta, F.col("_y"), x)
    # the penalty's share of the Hessian is on its diagonal, which closes the triangle's rows
    triangle = [(i, j) for i in range(k) for j in range(i + 1)]
    held = F.array(*[F.get("_h", F.lit(at)) + (ridge[i] if i == j else 0.0) for at, (i, j) in enumerate(triangle)])
    slope = F.array(*[F.get("_g", F.lit(i)) - F.get("coef", F.lit(i)) * r for i, r in enumerate(ridge)])
    worth = sum((F.get("coef", F.lit(i)) * F.get("coef", F.lit(i)) * (-r / 2.0) for i, r in enumerate(ridge)), F.col("loglik"))
    newton = backward(F.col("_factor"), F.col("_forwards"), k)
    worse = F.coalesce(F.col("_worth") < F.col("_before") - F.abs("_before") * 1e-12, F.lit(False))
    step = F.when(F.col("_worse"), F.transform("_delta", lambda d: -d / 2.0)).otherwise(newton)
    length = F.aggregate("_step", F.lit(0.0), lambda acc, d: F.greatest(acc, F.abs(d)))
    size = F.aggregate("coef", F.lit(1.0), lambda acc, b: F.greatest(acc, F.abs(b)))
    lost, small = F.col("_factor").isNull(), ~F.col("_worse") & (length <= size * tolerance)
    after = [
        *keys, "n", "null_loglik", F.when(~lost, F.zip_with("coef", "_step", lambda b, d: b + d)).alias("coef"),
        F.when(F.col("_worse"), F.transform("_delta", lambda d: d / 2.0)).otherwise(F.col("_step")).alias("_delta"),
        F.when(F.col("_worse"), F.col("_before")).otherwise(F.col("_worth")).alias("_before"), "loglik",
        inverse_diagonal(F.col("_factor"), k).alias("variance"), (F.col("steps") + 1).alias("steps"), (lost | small).alias("_done"), (~lost & small).alias("converged"),
    ]
    factored = {"_worth": worth, "_slope": slope, "_factor": cholesky(held, k)}
    forwards = {"_forwards": forward(F.col("_factor"), F.col("_slope"), k), "_worse": worse}
    few = F.broadcast if state.count() <= BROADCAST_ROWS else lambda df: df  # groups don't become more
    for _ in range(steps):
        moving = state.filter("not _done")
        if moving.isEmpty():
            break
        now = few(moving.select(*keys, F.col("coef").alias("_b")))
        at = data.join(now, keys) if keys else data.crossJoin(now)
        told, rest = at.groupBy(*keys).agg(*sums), moving.drop("loglik", "variance")
        solved = (rest.join(told, keys) if keys else rest.crossJoin(told)).withColumns(factored)
        solved = solved.withColumns(forwards).withColumn("_step", step)
        state = cut(state.filter("_done").unionByName(solved.select(*after)), "logistic-state")
    good = F.col("converged")
    return state.select(*keys, "n", *[F.when(good, F.col(c)).alias(c) for c in ("coef", "variance", "loglik")], "null_loglik", "steps", "converged")


def fit_distance_logit(frame: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One row a group: coefficient, odds ratio with 95% interval, p, McFadden pseudo-R2 and likelihood-ratio p."""
    fitted = fit_logistic(frame, keys, "presence", ["log_dist"])
    fitted = fitted.withColumns({"intercept": F.get("coef", F.lit(0)), "slope": F.get("coef", F.lit(1)), "se": F.sqrt(F.get("variance", F.lit(1)))})
    lr = (F.col("loglik") - F.col("null_loglik")) * 2.0
    return fitted.select(
        *keys,
        F.col("slope").alias("coef"),
        "intercept",
        "se",
        F.exp("slope").alias("odds_ratio"),
        F.exp(F.col("slope") - F.col("se") * Z95).alias("or_lo"),
        F.exp(F.col("slope") + F.col("se") * Z95).alias("or_hi"),
        normal_two_sided(F.col("slope") / F.col("se")).alias("p_value"),
        (1.0 - F.col("loglik") / F.col("null_loglik")).alias("pseudo_r2"),
        F.when(F.col("converged"), chi2_sf(F.greatest(lr, F.lit(0.0)), F.lit(1))).alias("llr_p"),
    )


def probability_curve(frame: DataFrame, fit: DataFrame, points: int = 300, floor: float = 50.0, keys: Sequence[str] = ()) -> DataFrame:
    """Predicted presence on an even grid from 0 to max(floor, 99.5th percentile of distance), for each group."""
    keys = list(keys)
    top = exact_quantiles(frame, keys, "dist_km", {"hi": 0.995}).select(*keys, F.greatest("hi", F.lit(floor)).alias("hi"))
    grid = attach(fit.select(*keys, "coef", "intercept"), top, keys).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumn("dist_km", F.col("hi") * F.col("g") / float(points - 1))
    eta = F.col("intercept") + F.col("coef") * F.log(F.col("dist_km") + 1.0)
    return grid.select(*keys, "g", "dist_km", (1.0 / (1.0 + F.exp(-eta))).alias("prob"))


def penalised_odds_ratios(df: DataFrame, label: str, predictors: Sequence[str], min_rows: int = 50, keys: Sequence[str] = ()) -> DataFrame:
    """L2-penalised (C = 1) odds ratios of standardised predictors, largest first, for each group of more than ``min_rows`` complete rows.

    A predictor without spread has the odds ratio 1.
    """
    keys, predictors = list(keys), list(predictors)
    rows = cut(df.select(*keys, F.col(label).cast("double").alias("_label"), *[F.col(p).cast("double").alias(p) for p in predictors]).dropna(), "penalised-rows")
    moments = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.avg(p).alias(f"_m_{p}") for p in predictors],
        *[F.stddev_pop(p).alias(f"_s_{p}") for p in predictors],
    )
    scaled = attach(rows, moments.filter(F.col("_n") > min_rows), keys)
    even = lambda p: (F.col(p) - F.col(f"_m_{p}")) / F.when(F.col(f"_s_{p}") > 0, F.col(f"_s_{p}")).otherwise(1.0)
    scaled = scaled.select(*keys, "_label", *[even(p).alias(p) for p in predictors])
    # the penalty is |w|^2 / 2 against the summed loss: C = 1
    fitted = fit_logistic(scaled, keys, "_label", predictors, penalty=1.0).filter("converged")
    each = F.array(*[F.struct(F.lit(p).alias("predictor"), F.get("coef", F.lit(i)).alias("coef")) for i, p in enumerate(predictors, 1)])
    told = fitted.select(*keys, F.explode(each).alias("x")).select(*keys, "x.predictor", "x.coef", F.exp("x.coef").alias("odds_ratio"))
    return told.orderBy(*keys, F.col("odds_ratio").desc(), "predictor")
