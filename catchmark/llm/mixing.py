"""Mixing sources to target weights by Poisson replication.

Each document is repeated a Poisson number of times whose mean is its source's repetition rate: the rows the source should
have in the mix over the rows it has. The number comes from inverting the Poisson distribution at a uniform drawn by hash from
(seed, doc_id), so it depends on nothing but the row, and a lost task draws the same again. Copies are then sorted by another
hash over all executors.

Cases: a null source is a source of its own; a source without a target weight gets rate 0; a null doc_id or text is drawn
like any other; repeated rows draw the same number (the draw is by doc_id); an empty table gives an empty mix. Columns named
like the added ones (copy, n_copies, mix_key) are replaced; all others are kept.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchmark.operators.lineage import cut

BROADCAST_STEPS = 1_000_000


def uniform(key: Column, seed: int) -> Column:
    """Uniform in [0, 1) from 52 bits of a digest of seed and key; any engine with md5 gives the same."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def _window(rate: float) -> tuple[int, np.ndarray]:
    """The first number that can be told from less, and the distribution function of Poisson(rate) from there on."""
    if not rate > 0:
        return 0, np.ones(1)
    reach, mode = 9 * math.sqrt(rate) + 24, math.floor(rate)
    first, last = max(0, math.floor(rate - reach)), math.ceil(rate + reach)
    up = np.cumsum(np.log(rate / np.arange(mode + 1, last + 1)))
    down = np.cumsum(np.log(np.arange(mode, first, -1) / rate))[::-1]
    terms = np.exp(np.concatenate([down, [0.0], up]))
    return first, np.cumsum(terms / math.fsum(terms))


def poisson_window(rate: Column) -> Column:
    """(first, steps): the distribution function of Poisson(rate) at first, first + 1, ..., as far as it can be told from 0 and 1.

    Terms are ratios from the mean outwards, so no rate underflows and the work is linear in their number; the window reaches
    nine deviations (and 24) to either side, where less than 2^-53 is left, so its length grows with the root of the rate.
    """

    @F.pandas_udf("struct<first: bigint, steps: array<double>>")
    def windows(rates: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_window(r) for r in rates], columns=["first", "steps"])

    return windows(rate)


def poisson_steps(rate: Column) -> Column:
    """The distribution function of Poisson(rate) at 0, 1, 2, ..., as far as it can be told from 1 (array of doubles)."""
    window = poisson_window(rate)
    return F.concat(F.array_repeat(F.lit(0.0), window["first"].cast("int")), window["steps"])


def rates(docs: DataFrame, weights: dict[str | None, float] | None, source: str = "source", total: int | None = None) -> DataFrame:
    """One row for each source: source, n_rows, rate. ``weights`` None gives all sources the same weight.

    ``total`` is the number of rows the mix should have, by default as many as ``docs`` has.
    """
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_rows"))
    facts = counts.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("rows"), F.count("*").alias("sources")).first()
    if weights is None:
        weight = F.lit(1.0 / max(1, facts["sources"]))
    else:
        scale = math.fsum(weights.values())
        weight = F.lit(0.0)
        for name, w in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), w / scale).otherwise(weight)
    size = facts["rows"] if total is None else total
    return counts.withColumn("rate", weight * float(size) / F.col("n_rows"))


def replicate(docs: DataFrame, weights: dict[str | None, float] | None = None, seed: int = 8, doc_id: str = "doc_id", source: str = "source", total: int | None = None) -> DataFrame:
    """``docs`` with each row as often as drawn, with copy (from 0), n_copies and mix_key, sorted by mix_key across partitions.

    The rates and their steps are one small row for each source, written once. They are broadcast while they hold at most
    BROADCAST_STEPS numbers and rows together, so the documents stay where they are; beyond that the join is an ordinary one. The
    copies cross the network once, by range of key.
    """
    plain = docs.drop("copy", "n_copies", "mix_key")
    steps = rates(docs, weights, source, total).select(F.col("source").alias("_source"), poisson_window(F.col("rate")).alias("_window"))
    steps = cut(steps, "steps")
    size = steps.agg(F.coalesce(F.sum(F.size("_window.steps") + F.lit(1)), F.lit(0))).first()[0]
    steps = F.broadcast(steps) if size <= BROADCAST_STEPS else steps
    drawn = plain.join(steps, plain[source].eqNullSafe(steps["_source"]))
    u = uniform(F.col(doc_id), seed)
    drawn = drawn.withColumn("n_copies", (F.col("_window.first") + F.size(F.filter("_window.steps", lambda c: c <= u))).cast("int")).filter("n_copies > 0").drop("_source", "_window")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    keyed = copies.withColumn("mix_key", F.xxhash64(F.lit(seed), doc_id, "copy"))
    return keyed.select(*plain.columns, "copy", "n_copies", "mix_key").repartitionByRange("mix_key").sortWithinPartitions("mix_key")


def mixed_sql(seed: int = 8) -> str:
    """DuckDB SQL for (doc_id, source, copy, n_copies) of ``replicate`` with equal weights."""
    return f"""
WITH counts AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
facts AS (SELECT sum(n)::DOUBLE / count(*) AS share FROM counts),
rates AS (SELECT source, share / n AS rate FROM counts, facts),
steps AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS c
  FROM (SELECT source, rate, unnest(range(0, 1 + ceil(rate + 9 * sqrt(rate) + 24)::BIGINT)) AS k FROM rates)),
draws AS (SELECT doc_id, source, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
drawn AS (SELECT doc_id, d.source, count(*) AS n FROM draws d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.c <= d.u GROUP BY ALL)
SELECT doc_id, source, unnest(range(0, n))::INT AS copy, n::INT AS n_copies FROM drawn"""
