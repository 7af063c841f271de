"""Seeded random reference points. The same seed gives the same points on any cluster."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catchmark.functions.bits import little_endian_hex, low_bytes
from catchmark.functions.random import MODULUS, hash31, hashed_uniform
from catchmark.operators.lineage import cut
from catchmark.operators.ordered import attach, first_n_by, running_totals

#: Whole numbers that the polygons' area is dealt out in: running areas are exact in any order of addition.
AREA_UNITS = float(1 << 52)
#: Draws of a group that one row makes.
PIECE = 1 << 16
#: What is added to a seed for a draw's three numbers. The noise squares its seed, so steps of equal size would make the three depend on one another.
STREAMS = (0, 15_485_863, 982_451_653)


def trapezoids(edges: DataFrame, id_col: str = "basin_id") -> DataFrame:
    """The polygons cut at the heights of their vertices: (id, y1, y2, left1, left2, right1, right2), each once.

    Between two neighbouring heights no edge of a polygon begins or ends, so its edges there, ordered by their middles, bound inside and outside
    in turn (holes and parts are just more edges). left and right are the x of the bounding edges at y1 and y2. Edges that lie level bound
    nothing. An edge that stands in the table several times bounds as often, as crossing parity has it. Edges of one polygon must not cross.
    """
    own = W.partitionBy("id")
    flat = edges.select(F.col(id_col).alias("id"), "x1", "y1", "x2", "y2").filter("y1 <> y2")
    up = F.col("y1") < F.col("y2")
    pick = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    edge = flat.select("id", pick("x1", "x2").alias("ax"), pick("y1", "y2").alias("ay"), pick("x2", "x1").alias("bx"), pick("y2", "y1").alias("by"))
    # a height's number among the polygon's heights, on both ends of each edge; all windows below are by polygon or finer
    named = edge.withColumn("edge", F.monotonically_increasing_id())
    ends = named.withColumn("y", F.explode(F.array("ay", "by"))).withColumn("k", F.dense_rank().over(own.orderBy("y")))
    spans = ends.groupBy("id", "edge").agg(*[F.first(c).alias(c) for c in ("ax", "ay", "bx", "by")], F.min("k").alias("lo"), F.max("k").alias("hi"))
    heights = ends.groupBy("id", "k").agg(F.first("y").alias("y1"))
    heights = heights.withColumn("y2", F.lead("y1").over(own.orderBy("k"))).filter("y2 is not null")
    cuts = spans.withColumn("k", F.explode(F.sequence("lo", F.col("hi") - 1))).join(heights, ["id", "k"])
    at = lambda y: F.when(F.col(y) == F.col("ay"), F.col("ax")).when(F.col(y) == F.col("by"), F.col("bx")).otherwise(
        F.col("ax") + (F.col(y) - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay"))
    )
    cuts = cuts.select("id", "k", "y1", "y2", at("y1").alias("left1"), at("y2").alias("left2"))
    across = W.partitionBy("id", "k").orderBy(F.col("left1") + F.col("left2"), "left1", "left2")
    paired = cuts.withColumns({"place": F.row_number().over(across), "right1": F.lead("left1").over(across), "right2": F.lead("left2").over(across)})
    return paired.filter("place % 2 = 1 and right1 is not null").select("id", "k", "place", "y1", "y2", "left1", "left2", "right1", "right2")


def area_index(edges: DataFrame, id_col: str = "basin_id", keys: Sequence[str] = ()) -> DataFrame:
    """The trapezoids with the running area before each: (before, units), in whole units of which a group's polygons together have ``whole``; written once.

    Each group of ``keys`` is a set of polygons of its own. Running sums are within a polygon, and over the polygons' sums by slices of them, so no task holds all of either.
    """
    keys = list(keys)
    shape = edges.withColumn("_polygon", F.struct(*keys, id_col)) if keys else edges.withColumn("_polygon", F.struct(id_col))
    pieces = trapezoids(shape, "_polygon").select(*[F.col(f"id.{c}").alias(c) for c in keys], F.col(f"id.{id_col}").alias("id"), "k", "place", "y1", "y2", "left1", "left2", "right1", "right2")
    pieces = cut(pieces.withColumn("area", (F.col("right1") - F.col("left1") + F.col("right2") - F.col("left2")) / 2.0 * (F.col("y2") - F.col("y1"))), "trapezoids")
    total = pieces.groupBy(*keys).agg(F.sum("area").alias("total"))
    units = F.round(F.col("area") / F.col("total") * AREA_UNITS).cast("bigint")
    pieces = attach(pieces, total, keys).withColumn("units", units).filter("units > 0")
    within = W.partitionBy(*keys, "id").orderBy("k", "place").rowsBetween(W.unboundedPreceding, -1)
    local = cut(pieces.withColumn("inside", F.coalesce(F.sum("units").over(within), F.lit(0))).drop("area", "total"), "local-areas")
    order = F.col("id") if dict(local.dtypes)["id"] in ("int", "bigint", "smallint", "tinyint") else F.xxhash64("id")
    polygons = local.groupBy(*keys, "id").agg(F.sum("units").alias("own")).withColumn("_order", order)
    before = running_totals(polygons, keys, "_order", ["own"]).select(*keys, "id", (F.col("cum_own") - F.col("own")).alias("first"), F.col("tot_own").alias("whole"))
    placed = local.join(before, [*keys, "id"]).withColumn("before", F.col("first") + F.col("inside"))
    return cut(placed.drop("inside", "first", "k", "place"), "area-index")


def points_in_areas(index: DataFrame, draws: DataFrame, seed: str | int, draw: str = "draw", id_col: str = "basin_id", keys: Sequence[str] = ()) -> DataFrame:
    """One uniform point for each row of ``draws`` (its columns, x, y, polygon) in the polygons of its group: every draw finds its place, none is refused.

    Three numbers of the draw and ``seed`` (a number or a column) choose the trapezoid by running area, the height and the place at that height. The axis of running area is
    cut into as many cells as there are trapezoids; a trapezoid is listed in the cells it reaches, so the lookup is an equi-join of about as many
    rows as there are draws and trapezoids, and no cell is crowded with draws whatever the polygons' sizes. Draws of a group without area are lost.
    """
    keys = list(keys)
    facts = index.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("whole").alias("_whole")).filter("_n > 0")
    facts = cut(facts.select(*keys, "_whole", F.expr("(_whole + _n - 1) div _n").alias("_wide")), "areas")
    if facts.isEmpty():
        raise ValueError("the polygons have no area to draw points in")
    seed = F.col(seed) if isinstance(seed, str) else F.lit(seed)
    key = F.col(draw)
    number = lambda k: hashed_uniform(key, seed + STREAMS[k])
    target = F.least(F.floor(number(0) * F.col("_whole").cast("double")), F.col("_whole") - 1)
    aimed = attach(draws, facts, keys).withColumns({"_at": target, "_u": number(1), "_v": number(2)}).withColumn("_cell", F.expr("_at div _wide"))
    listed = attach(index.drop("whole"), facts, keys).withColumn("_cell", F.explode(F.sequence(F.expr("before div _wide"), F.expr("(before + units - 1) div _wide"))))
    listed = listed.select(*keys, "_cell", *[F.col(c).alias(f"_t_{c}") for c in ("id", "before", "units", "y1", "y2", "left1", "left2", "right1", "right2")])
    met = aimed.join(listed, [*keys, "_cell"])
    met = met.filter((F.col("_at") >= F.col("_t_before")) & (F.col("_at") < F.col("_t_before") + F.col("_t_units")))
    w1, w2 = F.col("_t_right1") - F.col("_t_left1"), F.col("_t_right2") - F.col("_t_left2")
    # the share of the height below which a share u of the area lies
    rise = F.col("_u") * (w1 + w2) / F.greatest(w1 + F.sqrt(F.greatest(w1 * w1 + F.col("_u") * (w2 * w2 - w1 * w1), F.lit(0.0))), F.lit(1e-300))
    met = met.withColumn("_t", F.least(rise, F.lit(1.0)))
    between = lambda a, b, t: F.col(a) + (F.col(b) - F.col(a)) * F.col(t)
    met = met.withColumns({"_l": between("_t_left1", "_t_left2", "_t"), "_r": between("_t_right1", "_t_right2", "_t")})
    return met.select(*draws.columns, between("_l", "_r", "_v").alias("x"), between("_t_y1", "_t_y2", "_t").alias("y"), F.col("_t_id").alias(id_col))


def random_points_in_polygons(spark, edges: DataFrame, n: int, seed: int, id_col: str = "basin_id") -> DataFrame:
    """``n`` uniform points in the polygons: (draw, x, y, id). Where polygons overlap, each has its own points.

    Give equal-area coordinates for equal-area sampling.
    """
    return points_in_areas(area_index(edges, id_col), spark.range(n).withColumnRenamed("id", "draw"), seed, "draw", id_col)


def grouped_draws(sizes: DataFrame, keys: Sequence[str], count: str = "n") -> DataFrame:
    """Rows (keys, other columns, draw) with draw = 0 .. count - 1 of each row of ``sizes``; a group of any size is made in pieces.

    The number of partitions is named, as the planner would merge the few small rows of pieces, and one task make all draws.
    """
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = sizes.filter(F.col(count) > 0).withColumn("_piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(count) - 1) / PIECE))))
    last = F.least(F.col("_piece") * PIECE + (PIECE - 1), F.col(count).cast("bigint") - 1)
    return pieces.repartition(parts, *keys, "_piece").withColumn("draw", F.explode(F.sequence(F.col("_piece") * PIECE, last))).drop("_piece", count)


def disk_points(sites: DataFrame, site_id: str, n: int, radius: float, seed: int) -> DataFrame:
    """``n`` uniform points in the disk around each site (x, y): (site, copy, px, py)."""
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    spread = sites.select(site_id, "x", "y", copies.alias("copy"))
    key = F.col(site_id) * n + F.col("copy")
    angle = hashed_uniform(key, seed) * (2 * math.pi)
    r = F.sqrt(hashed_uniform(key, seed + 1)) * float(radius)
    return spread.select(
        site_id, "copy", (F.col("x") + r * F.cos(angle)).alias("px"), (F.col("y") + r * F.sin(angle)).alias("py")
    )


def reproducible_first(df: DataFrame, key: str, n: int, seed: int = 0, must_fill: bool = False) -> DataFrame:
    """A fixed scatter sample: the ``n`` rows first in hash order of their key."""
    return first_n_by(df, hash31(F.col(key), seed), MODULUS, key, n, must_fill=must_fill)


def first_by_bytes(df: DataFrame, n: int, x: str = "x", y: str = "y", must_fill: bool = False) -> DataFrame:
    """The ``n`` points first in the order of their binary text form: by the bytes of x, least significant first, then of y.

    Low mantissa bytes come first, so this is a scatter sample too; equal points are interchangeable. Points without finite coordinates are left out.
    """
    placed = df.withColumn("_bytes", F.concat(little_endian_hex(F.col(x)), little_endian_hex(F.col(y)))).filter("_bytes is not null")
    return first_n_by(placed, low_bytes(F.col(x)), 1 << 16, "_bytes", n, must_fill=must_fill).drop("_bytes")


def matched_polygons(edges: DataFrame, located: DataFrame, id_col: str = "basin_id") -> DataFrame:
    """Edges of only those polygons that hold at least one of the located points."""
    held = located.select(id_col).filter(F.col(id_col).isNotNull()).distinct()
    return edges.join(held, id_col, "left_semi")
