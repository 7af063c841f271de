"""Seeded bootstrap of medians and ECDF bands against a pool.

A sample's median only needs the ranks that were drawn, so replicates draw rank numbers, not rows. A replicate's noise runs through
one task in blocks, of which that keeps a number each and the few draws near the middle or the cutoff, or counts of even slices of
ranks. So no task holds a replicate, nothing but two ranks or a curve leaves one, and only two pool values per replicate are looked up.

``ranked`` is (group, metric, i, x): the pools' values numbered 1..m (see ``ranked_rows``).
``spec`` has one row per comparison: its key columns, group, metric, n (sample size), m (pool size) and
``stream``, an integer that separates the noise of comparisons.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from catchmark.functions.random import HALF, MODULUS, SECOND, hash31, hashed_uniform
from catchmark.operators.lineage import cut
from catchmark.operators.ordered import exact_quantiles, group_quantiles, per_group

STREAM_STEP = 7919
CHUNK = 1 << 16
#: Draws in an array; small enough for a core's cache.
BLOCK = 1 << 14
#: Slices of a pool's ranks that a curve counts draws by: 2^12 at most.
SLICE_BITS = 12


def _replicates(spec: DataFrame, reps: int) -> DataFrame:
    return spec.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(reps - 1).cast("bigint"))))


def _numbers(replicates: DataFrame, keys: Sequence[str], total: str) -> DataFrame:
    """t = 0..total-1 for each replicate, a row each."""
    last = F.col(total).cast("bigint") - 1
    own = F.sequence(F.col("_chunk") * CHUNK, F.least((F.col("_chunk") + 1) * CHUNK - 1, last))
    return _chunks(replicates, keys, total).withColumn("t", F.explode(own)).drop("_chunk")


def _chunks(replicates: DataFrame, keys: Sequence[str], total: str) -> DataFrame:
    """The replicates' numbers in chunks of CHUNK, hashed over all shuffle partitions."""
    parts = int(replicates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = F.col(total).cast("bigint") - 1
    chunks = replicates.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / CHUNK))))
    return chunks.repartition(parts, *keys, "rep", "_chunk")


def _seed(seed: int) -> Column:
    return F.lit(seed).cast("bigint") + F.col("stream") * STREAM_STEP


def _width(total: str) -> Column:
    """Ranks in a slice."""
    return F.ceil(F.sqrt(F.col(total).cast("double"))).cast("bigint")


def _reach(counts: DataFrame, by: Sequence[str], order: str, k: Column) -> DataFrame:
    """The first row, in order, at which the running count reaches ``k``, with the count before it."""
    upto = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    ran = counts.withColumn("_cum", F.sum("c").over(upto)).withColumn("_before", F.col("_cum") - F.col("c"))
    return ran.filter((F.col("_before") < k) & (F.col("_cum") >= k))


def _cutoffs(replicates: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """Replicates with the n-th smallest (noise, t) of the pool's members: those up to it are a sample without replacement."""
    own = [*keys, "rep"]
    rows = _numbers(replicates, keys, "m").withColumn("_h", hash31(F.col("rep") * F.col("m") + F.col("t"), _seed(seed)))
    rows = rows.withColumn("_slice", F.floor(F.col("_h") / F.ceil(F.lit(float(MODULUS)) / F.sqrt(F.col("m").cast("double")))))
    sizes = rows.groupBy(*own, "_slice").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    last = cut(_reach(sizes, own, "_slice", F.col("n")).select(*own, F.col("_slice").alias("_last"), (F.col("n") - F.col("_before")).alias("_rest")), "cut-slices")
    close = rows.join(last, own).filter(F.col("_slice") == F.col("_last"))
    nth = F.row_number().over(W.partitionBy(*own).orderBy("_h", "t"))
    found = close.withColumn("_k", nth).filter(F.col("_k") == F.col("_rest")).select(*own, F.col("_h").alias("_hc"), F.col("t").alias("_tc"))
    return replicates.join(cut(found, "cutoffs"), own)


def _draws(replicates: DataFrame, keys: Sequence[str], seed: int, replace: bool) -> DataFrame:
    """The replicates' columns and i: a row for each draw of a rank 1..m. ``replicates`` come from ``_prepared``."""
    if replace:
        place = hashed_uniform(F.col("rep") * F.col("n") + F.col("t"), _seed(seed)) * F.col("m")
        return _numbers(replicates, keys, "n").withColumn("i", F.least(F.floor(place), F.col("m") - 1) + 1)
    rows = _numbers(replicates, keys, "m").withColumn("_h", hash31(F.col("rep") * F.col("m") + F.col("t"), _seed(seed)))
    chosen = (F.col("_h") < F.col("_hc")) | ((F.col("_h") == F.col("_hc")) & (F.col("t") <= F.col("_tc")))
    return rows.filter(chosen).withColumn("i", F.col("t") + 1)


def _counted(replicates: DataFrame, keys: Sequence[str], seed: int, wanted: str | None = None) -> DataFrame:
    """Counts of the draws with replacement: (keys, rep, _slice, c, n) by slice, or (.., _slice, i, c) by rank in the slices that the column ``wanted`` lists.

    A chunk's draws are numbers of one array, counted there: only counts leave a task. Same noise and rounding as ``hashed_uniform``.
    """
    own = [*keys, "rep"]
    chunks = _chunks(replicates, keys, "n").withColumns({"_seed": _seed(seed), "_width": _width("m"), "n": F.col("n").cast("bigint"), "m": F.col("m").cast("bigint")})
    chunks = chunks.select(*own, "n", "m", "_seed", "_width", "_chunk", *([wanted] if wanted else []))
    told = ["_slice", "i", "c"] if wanted else ["_slice", "c", "n"]
    schema = StructType([*[chunks.schema[c] for c in own], *[StructField(c, LongType()) for c in told]])
    modulus, half, second, size = MODULUS, HALF, SECOND, CHUNK

    def count(frames):  # holds all it needs, so executors need not have this package
        import numpy as np
        import pandas as pd

        def fold(x):
            return ((x * x) % modulus * 69621 + 12345) % modulus

        def noise(key, seeded):
            return fold((fold((key % half * 48271 + 11) % modulus) + (key >> 30) % modulus * 16807 + seeded % modulus * 40692) % modulus)

        for frame in frames:
            for row in frame.to_dict("records"):
                n, m, width, seeded = row["n"], row["m"], row["_width"], row["_seed"]
                key = row["rep"] * n + np.arange(row["_chunk"] * size, min((row["_chunk"] + 1) * size, n), dtype=np.int64)
                u = (noise(key, seeded) + noise(key, seeded + second) / float(modulus)) / float(modulus)
                rank = np.minimum(np.floor(u * m).astype(np.int64), m - 1)
                where = rank // width
                if wanted:
                    rank = rank[np.isin(where, np.asarray(row[wanted], dtype=np.int64))]
                    at, c = np.unique(rank, return_counts=True)
                    out = {"_slice": at // width, "i": at + 1, "c": c}
                else:
                    c = np.bincount(where)
                    at = np.flatnonzero(c)
                    out = {"_slice": at, "c": c[at], "n": np.full(len(at), n)}
                yield pd.DataFrame({**{k: [row[k]] * len(at) for k in own}, **out})

    counted = chunks.mapInPandas(count, schema)
    by = [*own, "_slice", "i"] if wanted else [*own, "_slice"]
    return counted.groupBy(*by).agg(F.sum("c").alias("c"), *([] if wanted else [F.max("n").alias("n")]))


def _array_noise():
    """``hash31`` of arrays in two steps, low(key) and noise(low, key, seed). Remainders of 2^31 - 1 are taken by shifts: in between, numbers are only congruent.

    Made by a call, so that executors get it whole and need not have this package.
    """
    modulus, half = MODULUS, HALF

    def down(x):  # below 2^63, in place: less than 2^31 + x / 2^31 remains
        high = x >> 31
        x &= modulus
        x += high

    def fold(x):  # at most 1.4 * 2^31, in place
        x *= x
        down(x)
        x *= 69621
        x += 12345
        down(x)

    def low(key):
        x = key & (half - 1)
        x *= 48271
        x += 11
        down(x)
        fold(x)
        return x

    def noise(lows, key, seed):
        x = key >> 30
        x *= 16807
        x += lows
        x += seed % modulus * 40692 % modulus
        down(x)
        fold(x)
        x -= (x >= modulus) * modulus
        return x

    return low, noise


def _spread(replicates: DataFrame, keys: Sequence[str], seed: int, *more: str) -> DataFrame:
    """The replicates with their seeds, hashed over all shuffle partitions."""
    parts = int(replicates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    told = replicates.withColumns({"_seed": _seed(seed), "n": F.col("n").cast("bigint"), "m": F.col("m").cast("bigint")})
    return told.select(*keys, "rep", "n", "m", "_seed", *more).repartition(parts, *keys, "rep")


def _array_sample():
    """A replicate's sample without replacement: noise(row, block), and sample(row) with the noise below which all belong, the other members, and the count below by block.

    The n smallest (noise, t) are the sample. Noise is even, so the cutoff is looked for in a bracket of a few deviations around n / m, and in the next
    bracket should that miss it: members below are counted by block, those inside are kept and sorted. Made by a call, as ``_array_noise``.
    """
    size, modulus = BLOCK, MODULUS
    low, noise = _array_noise()

    def made(row, b):
        import numpy as np

        key = row["rep"] * row["m"] + np.arange(b * size, min((b + 1) * size, row["m"]), dtype=np.int64)
        return noise(low(key), key, row["_seed"])

    def sample(row):
        import numpy as np

        n, m = row["n"], row["m"]
        blocks = -(-m // size)
        span = int(16 * modulus / m**0.5) + 1
        start = max(0, n * modulus // m - span // 2)
        while True:
            below, near = np.zeros(blocks, dtype=np.int64), []
            for b in range(blocks):
                h = made(row, b)
                under = h < start + span
                at = np.flatnonzero(under & (h >= start))
                below[b] = np.count_nonzero(under) - len(at)
                near.append((h[at], at + b * size))
            rest = n - below.sum()
            if rest < 0:
                start, span = max(0, start - 2 * span), start - max(0, start - 2 * span)
            elif rest > sum(len(t) for _, t in near):
                start, span = start + span, 2 * span
            else:
                break
        h, t = (np.concatenate(x) for x in zip(*near))
        return start, np.sort(t[np.lexsort((t, h))[:rest]]), below

    return made, sample


def _middle_members(replicates: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """(keys, rep, _low, _high): ranks of the middle members (one twice if n is odd) of each replicate's sample without replacement.

    Only the blocks that the middle lies in are made again.
    """
    own, size = [*keys, "rep"], BLOCK
    spread = _spread(replicates.filter((F.col("n") > 0) & (F.col("n") <= F.col("m"))), keys, seed)
    schema = StructType([*[spread.schema[c] for c in own], StructField("_low", LongType()), StructField("_high", LongType())])
    made, sample = _array_sample()

    def middles(frames):
        import numpy as np

        def middle(row):
            start, last, below = sample(row)
            upto = np.cumsum(below + np.bincount(last // size, minlength=len(below)))
            members = {}
            for k in ((row["n"] + 1) // 2, row["n"] // 2 + 1):
                b = int(np.searchsorted(upto, k))
                if b not in members:
                    under = np.flatnonzero(made(row, b) < start) + b * size
                    members[b] = np.sort(np.concatenate([under, last[last // size == b]]))
                yield int(members[b][k - 1 - (upto[b - 1] if b else 0)]) + 1

        for frame in frames:
            found = [tuple(middle(row)) for row in frame.to_dict("records")]
            yield frame[own].assign(_low=[a for a, _ in found], _high=[b for _, b in found])

    return spread.mapInPandas(middles, schema)


def _middle_draws(replicates: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """(keys, rep, _low, _high): the middle ranks (one twice if n is odd) of each replicate's draws with replacement.

    The first number of a draw's noise orders ranks, so its middle is looked for in a bracket of a few deviations around one half, which grows should it
    miss: draws below are counted, and only those inside get their second number and their rank.
    """
    own, size, modulus, second = [*keys, "rep"], BLOCK, MODULUS, SECOND
    spread = _spread(replicates.filter((F.col("n") > 0) & (F.col("m") > 0)), keys, seed)
    schema = StructType([*[spread.schema[c] for c in own], StructField("_low", LongType()), StructField("_high", LongType())])
    low, noise = _array_noise()

    def middles(frames):
        import numpy as np

        def middle(row):
            n, m, seeded = row["n"], row["m"], row["_seed"]
            places = (n + 1) // 2, n // 2 + 1
            span = int(6 * modulus / n**0.5) + 1
            start = max(0, modulus // 2 - span // 2)
            while True:
                below, near = 0, []
                for first in range(0, n, size):
                    key = row["rep"] * n + np.arange(first, min(first + size, n), dtype=np.int64)
                    h = noise(low(key), key, seeded)
                    under = h < start + span
                    at = np.flatnonzero(under & (h >= start))
                    below += np.count_nonzero(under) - len(at)
                    near.append((h[at], key[at]))
                if places[0] <= below:
                    start, span = max(0, start - 2 * span), start + span - max(0, start - 2 * span)
                elif places[1] > below + sum(len(k) for _, k in near):
                    span *= 3
                else:
                    break
            h, key = (np.concatenate(x) for x in zip(*near))
            u = (h + noise(low(key), key, seeded + second) / float(modulus)) / float(modulus)
            rank = np.sort(np.minimum(np.floor(u * m).astype(np.int64), m - 1) + 1)
            return tuple(int(rank[k - below - 1]) for k in places)

        for frame in frames:
            found = [middle(row) for row in frame.to_dict("records")]
            yield frame[own].assign(_low=[a for a, _ in found], _high=[b for _, b in found])

    return spread.mapInPandas(middles, schema)


def _curves(replicates: DataFrame, keys: Sequence[str], seed: int, replace: bool) -> DataFrame:
    """(keys, rep, g, y): the share of each replicate's draws whose ranks are at most ``_cuts[g]``, a column of sorted numbers from 0 to m.

    Draws are counted by even slices of ranks as they are made; only those in a slice that a cut splits are looked up among the cuts.
    """
    own, size, modulus, second, bits = [*keys, "rep"], BLOCK, MODULUS, SECOND, SLICE_BITS
    spread = _spread(replicates if replace else replicates.filter(F.col("n") <= F.col("m")), keys, seed, "_cuts")
    schema = StructType([*[spread.schema[c] for c in own], StructField("g", IntegerType()), StructField("y", DoubleType())])
    low, noise = _array_noise()
    made, sample = _array_sample()

    def curves(frames):
        import numpy as np
        import pandas as pd

        def places(row):  # ranks less one, in blocks
            n, m = row["n"], row["m"]
            if not replace:
                start, last, below = sample(row)
                for b in range(len(below)):
                    yield np.concatenate([np.flatnonzero(made(row, b) < start) + b * size, last[last // size == b]])
                return
            for first in range(0, n, size):
                key = row["rep"] * n + np.arange(first, min(first + size, n), dtype=np.int64)
                lows = low(key)
                u = (noise(lows, key, row["_seed"]) + noise(lows, key, row["_seed"] + second) / float(modulus)) / float(modulus)
                yield np.minimum(np.floor(u * m).astype(np.int64), m - 1)

        for frame in frames:
            for row in frame.to_dict("records"):
                cuts = np.asarray(row["_cuts"], dtype=np.int64)
                shift = max(0, int(row["m"]).bit_length() - bits)
                slices = ((row["m"] - 1) >> shift) + 1
                inner = cuts[(cuts & ((1 << shift) - 1) != 0) & (cuts < row["m"])]
                split = np.zeros(slices, dtype=bool)
                split[inner >> shift] = True
                whole, counts = np.zeros(slices, dtype=np.int64), np.zeros(len(cuts) + 1, dtype=np.int64)
                for place in places(row):
                    at = place >> shift
                    whole += np.bincount(at, minlength=slices)
                    if len(inner):
                        counts += np.bincount(np.searchsorted(cuts, place[split[at]], "right"), minlength=len(counts))
                whole[split] = 0
                np.add.at(counts, np.searchsorted(cuts, np.arange(slices) << shift, "right"), whole)
                y = np.cumsum(counts[:-1]) / row["n"]
                yield pd.DataFrame({**{k: [row[k]] * len(cuts) for k in own}, "g": np.arange(len(cuts), dtype=np.int32), "y": y})

    return spread.mapInPandas(curves, schema)


def _prepared(spec: DataFrame, keys: Sequence[str], reps: int, seed: int, replace: bool) -> DataFrame:
    replicates = _replicates(spec, reps)
    return replicates if replace else _cutoffs(replicates, keys, seed)


def draw_ranks(spec: DataFrame, keys: Sequence[str], reps: int, seed: int, replace: bool) -> DataFrame:
    """(keys, group, metric, n, rep, i, c): how often rank i (1..m) was drawn in each replicate."""
    own = list(dict.fromkeys([*keys, "group", "metric", "n"]))
    drawn = _draws(_prepared(spec, keys, reps, seed, replace), keys, seed, replace)
    return drawn.groupBy(*own, "rep", "i").agg(F.count(F.lit(1)).alias("c"))


def replicate_medians(spec: DataFrame, ranked: DataFrame, keys: Sequence[str], reps: int, seed: int, replace: bool = True) -> DataFrame:
    """(keys, rep, median) of each replicate's sample."""
    keys, own = list(keys), [*keys, "rep"]
    carried = [c for c in ("group", "metric") if c not in keys]
    middles = _middle_draws if replace else _middle_members
    # two ranks a replicate
    found = cut(middles(_replicates(spec, reps), keys, seed), "middle-ranks").withColumn("i", F.explode(F.array_distinct(F.array("_low", "_high"))))
    found = found.join(per_group(spec.select(*keys, *carried), "pools"), keys) if carried else found
    return _valued(found, ranked, own)


def _valued(middles: DataFrame, ranked: DataFrame, own: Sequence[str]) -> DataFrame:
    """The mean of the pool's values at each replicate's middle ranks."""
    values = ranked.select("group", "metric", "i", "x")
    return middles.join(values, ["group", "metric", "i"]).groupBy(*own).agg(F.avg("x").alias("median"))


def difference_interval(diffs: DataFrame, keys: Sequence[str], diff: str = "diff") -> DataFrame:
    """(keys, d_med, d_lo, d_hi, p_two) over replicate differences."""
    keys = list(keys)
    cuts = group_quantiles(diffs, keys, diff, {"d_med": 0.5, "d_lo": 0.025, "d_hi": 0.975})
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    sides = diffs.groupBy(*keys).agg(share(F.col(diff) <= 0).alias("_le"), share(F.col(diff) >= 0).alias("_ge"))
    p = F.least(F.lit(1.0), 2.0 * F.least("_le", "_ge"))
    return cuts.join(sides, keys).select(*keys, "d_med", "d_lo", "d_hi", p.alias("p_two"))


def sample_sizes(values: DataFrame) -> DataFrame:
    """(group, metric, n, median) of a long table (group, metric, x)."""
    sizes = values.groupBy("group", "metric").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(exact_quantiles(values, ["group", "metric"], "x", {"median": 0.5}), ["group", "metric"])


def stream_number(sector: str, metric: str, sectors: Sequence[str], metrics: Sequence[str]) -> Column:
    """Stable number of a (sector, metric) comparison."""
    pos = lambda c, names: F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c)) - 1
    return pos(sector, sectors) * len(metrics) + pos(metric, metrics)


def versus_pool(values: DataFrame, sectors: Sequence[str], metrics: Sequence[str], pool: str = "None") -> DataFrame:
    """One row per (sector, metric): n, m, median of the sector and of the whole pool, stream number."""
    sizes = sample_sizes(values)
    left = sizes.filter(F.col("group").isin(*sectors)).select(
        F.col("group").alias("sector"), "metric", "n", F.col("median").alias("median_sector")
    )
    right = sizes.filter(F.col("group") == pool).select("metric", F.col("n").alias("m"), F.col("median").alias("median_pool"))
    both = left.join(right, "metric").withColumn("group", F.lit(pool))
    # a row per sector and metric, written once: every step of a bootstrap starts from it
    return cut(both.withColumn("stream", stream_number("sector", "metric", sectors, metrics)), "comparisons")


def bootstrap_vs_pool(
    values: DataFrame,
    ranked: DataFrame,
    sectors: Sequence[str],
    metrics: Sequence[str],
    reps: int = 500,
    seed: int = 42,
    replace: bool = True,
    min_n: int = 3,
    pool: str = "None",
) -> DataFrame:
    """Sector median minus the median of size-matched pool samples, with a 95% interval and two-sided p.

    With replacement both sides need ``min_n`` values; without, the pool must also hold at least n.
    The reported pool median is that of the whole pool.
    """
    spec = versus_pool(values, sectors, metrics, pool)
    enough = (F.col("n") >= min_n) & (F.col("m") >= (F.lit(min_n) if replace else F.col("n")))
    spec = spec.filter(enough)
    keys = ["sector", "metric"]
    medians = replicate_medians(spec, ranked, keys, reps, seed, replace)
    table = per_group(spec.select(*keys, "n", "m", "median_sector", "median_pool"), "sizes")
    diffs = medians.join(table, keys).withColumn("diff", F.col("median_sector") - F.col("median"))
    return spec.select(*keys, "n", "m", "median_sector", "median_pool").join(difference_interval(diffs, keys), keys)


def bootstrap_two_sample(
    values: DataFrame,
    ranked: DataFrame,
    sectors: Sequence[str],
    metrics: Sequence[str],
    reps: int = 2000,
    seed: int = 7,
    min_n: int = 30,
    pool: str = "None",
) -> DataFrame:
    """Median difference with a 95% interval from resampling both sides with replacement."""
    spec = versus_pool(values, sectors, metrics, pool).filter((F.col("n") >= min_n) & (F.col("m") >= min_n))
    first = spec.select("sector", "metric", F.lit(0).alias("side"), F.col("sector").alias("group"), "n", F.col("n").alias("m"), (F.col("stream") * 2).alias("stream"))
    second = spec.select("sector", "metric", F.lit(1).alias("side"), "group", F.col("m").alias("n"), "m", (F.col("stream") * 2 + 1).alias("stream"))
    medians = replicate_medians(first.unionByName(second), ranked, ["sector", "metric", "side"], reps, seed)
    diffs = medians.groupBy("sector", "metric", "rep").agg(
        F.sum(F.when(F.col("side") == 0, F.col("median")).otherwise(-F.col("median"))).alias("diff")
    )
    out = spec.withColumn("d", F.col("median_sector") - F.col("median_pool"))
    return out.select("sector", "metric", "n", "m", "d").join(
        difference_interval(diffs, ["sector", "metric"]).select("sector", "metric", "d_lo", "d_hi"), ["sector", "metric"]
    )


def ecdf_band(
    values: DataFrame,
    grid: DataFrame,
    sectors: Sequence[str],
    metrics: Sequence[str],
    pool_ecdf: DataFrame,
    reps: int = 500,
    seed: int = 42,
    replace: bool = True,
    min_n: int = 3,
    pool: str = "None",
) -> DataFrame:
    """(sector, metric, g, x, b_med, b_lo, b_hi): band of the replicates' ECDFs on a grid.

    ``grid`` is (sector, metric, g, x) with g = 0, 1, ...; ``pool_ecdf`` is the pool's own ECDF y on it.
    A draw of rank i lies at or below grid point g exactly when i <= K_g, the pool's count there, so draws are
    counted between the K where they are made and never looked up; a replicate leaves its curve only.
    """
    keys = ["sector", "metric"]
    spec = versus_pool(values, sectors, metrics, pool)
    spec = spec.filter((F.col("n") >= min_n) & (F.col("m") >= (F.lit(min_n) if replace else F.col("n"))))
    sizes = spec.select(*keys, "m")
    edges = pool_ecdf.join(per_group(sizes, "sizes"), keys).withColumn("_k", F.round(F.col("y") * F.col("m")).cast("bigint"))
    edges = edges.groupBy(*keys).agg(F.sort_array(F.collect_list("_k")).alias("_cuts"))
    replicates = _replicates(spec, reps).join(per_group(edges, "grid-counts"), keys)
    curves = _curves(replicates, keys, seed, replace)
    band = group_quantiles(curves, [*keys, "g"], "y", {"b_med": 0.5, "b_lo": 0.025, "b_hi": 0.975})
    return band.join(grid, [*keys, "g"]).select(*keys, "g", "x", "b_med", "b_lo", "b_hi")
