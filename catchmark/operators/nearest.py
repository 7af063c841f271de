"""Exact nearest-feature search: tiles for what is close by, branch and bound over two quadtrees of boxes for the rest.

Tiles fit the density of a group's segments; a segment goes to the tiles, grown by a margin, that its line passes, and a point to its own. There
a task searches them as arrays (``tile_search``). A distance that stays within the grown tile is final. So segments and points are moved once, and
no pair is a row.

The other points (far from any segment, as inland sites are from a coast) go to the trees. Points and segments are each summarised as a tree of bounding boxes (16 children per node). Starting from the
root pair, every level replaces a (point box, segment box) pair by its children and drops a segment box when its
smallest possible distance exceeds the largest possible distance to some other box.
What is left for a leaf of points goes to one task with its segments, where boxes within boxes are opened as arrays. The result does not depend
on the depth. Copies of a segment are measured once and expanded afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from catchmark.functions.geometry import segment_distance
from catchmark.operators.lineage import cut
from catchmark.operators.ordered import attach, per_group
from catchmark.operators.tile_search import array_search

MAX_DEPTH = 12
#: Segments and points are compared as arrays, so leaves need not be small.
SEGMENTS_PER_LEAF = 2048
#: Segments that a task of the trees holds, if one leaf of points does not need more.
SEGMENTS_PER_BLOCK = 1 << 17
#: Segments that a tile aims at: few enough for a task to hold, enough that the grown tile's margin is small.
SEGMENTS_PER_TILE = 8192
#: What a tile is grown by on each side, as a share of its size.
HALO = 1 / 16
#: Segments that a point is compared with in its tile at most; points that need more lie far from all of them and go to the trees.
MOST_SEGMENTS = 2048
#: Points beyond which a tile is dealt to several tasks.
POINTS_PER_TASK = 100_000
#: The same for the trees, whose points meet more segments.
POINTS_PER_BLOCK = 20_000
_ENDS = ("x1", "y1", "x2", "y2")
_BOX = ("lox", "loy", "hix", "hiy")


def _node(level: Column, ix: Column, iy: Column) -> Column:
    return F.shiftleft(level.cast("bigint"), 56) + F.shiftleft(ix.cast("bigint"), 28) + iy


def _leaf_cell(c: Column, origin: float, width: float, depth: int) -> Column:
    """Cell number 0..4**depth - 1; the bounds' far side belongs to the last cell. A place without number has no cell."""
    cell = F.floor((c - origin) * (4.0**depth / width))
    return F.when(~F.isnan(c), F.least(F.greatest(cell, F.lit(0)), F.lit(4**depth - 1)))


def _bounds(pts: DataFrame, segs: DataFrame) -> tuple[tuple[float, float, float], int]:
    """The square that holds all points and segments, and the number of segments: one row, read by the driver."""
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    corners = lambda xs, ys: [F.min(F.least(*map(number, xs))) if len(xs) > 1 else F.min(number(xs[0])), F.max(F.greatest(*map(number, xs))) if len(xs) > 1 else F.max(number(xs[0])), F.min(F.least(*map(number, ys))) if len(ys) > 1 else F.min(number(ys[0])), F.max(F.greatest(*map(number, ys))) if len(ys) > 1 else F.max(number(ys[0]))]
    names = ["lox", "hix", "loy", "hiy"]
    a = pts.agg(*[c.alias(n) for c, n in zip(corners(["_x"], ["_y"]), names)]).first()
    b = segs.agg(*[c.alias(n) for c, n in zip(corners(["x1", "x2"], ["y1", "y2"]), names)], F.count(F.lit(1)).alias("n")).first()
    known = [[r[n] for r in (a, b) if r[n] is not None] or [0.0] for n in names]
    lox, hix, loy, hiy = min(known[0]), max(known[1]), min(known[2]), max(known[3])
    return (lox, loy, max(hix - lox, hiy - loy) or 1.0), b["n"]


def _depth(n_segments: int) -> int:
    """Levels of 16 children that leave so many segments in a leaf."""
    return min(MAX_DEPTH, max(2, math.ceil(math.log(max(1, n_segments / SEGMENTS_PER_LEAF), 16))))


def _with_leaf(df: DataFrame, x: Column, y: Column, bounds, depth: int, name: str) -> DataFrame:
    x0, y0, width = bounds
    out = df.withColumns({"_ix": _leaf_cell(x, x0, width, depth), "_iy": _leaf_cell(y, y0, width, depth)})
    return out.withColumn(name, _node(F.lit(depth), F.col("_ix"), F.col("_iy")))


def _children(boxes: DataFrame, keys: Sequence[str], depth: int, name: str) -> DataFrame:
    """(keys, level, name, kids): the at most 16 occupied children of every node, with their boxes.

    ``boxes`` has one row per point or segment with its leaf cell and box; leaves are combined first (map side),
    then only leaves are listed under their ancestors.
    """
    merged = [F.min("lox").alias("lox"), F.min("loy").alias("loy"), F.max("hix").alias("hix"), F.max("hiy").alias("hiy")]
    leaves = boxes.groupBy(*keys, "_ix", "_iy").agg(*merged)
    nodes = leaves.withColumn("_level", F.explode(F.sequence(F.lit(1), F.lit(depth))))
    # 4**k as a division keeps the cell number exact for any level
    shrink = F.pow(F.lit(4.0), F.lit(depth) - F.col("_level"))
    nodes = nodes.withColumns({"_ix": F.floor(F.col("_ix") / shrink), "_iy": F.floor(F.col("_iy") / shrink)})
    nodes = nodes.groupBy(*keys, "_level", "_ix", "_iy").agg(*merged)
    up = F.col("_level") - 1
    kid = F.struct(_node(F.col("_level"), F.col("_ix"), F.col("_iy")).alias("node"), *_BOX)
    return nodes.groupBy(
        *keys, up.alias("_level"), _node(up, F.floor(F.col("_ix") / 4), F.floor(F.col("_iy") / 4)).alias(name)
    ).agg(F.collect_list(kid).alias(f"{name}_kids"))


def _gap(lo1, hi1, lo2, hi2):
    return F.greatest(F.lit(0.0), lo2 - hi1, lo1 - hi2)


def _reach(lo1, hi1, lo2, hi2):
    return F.greatest(hi2 - lo1, hi1 - lo2)


def _descend(pairs: DataFrame, p_kids: DataFrame, s_kids: DataFrame, level: int, p_keys, s_keys) -> DataFrame:
    p_kids = p_kids.filter(F.col("_level") == level).drop("_level")
    s_kids = s_kids.filter(F.col("_level") == level).drop("_level")
    keys = list(dict.fromkeys([*p_keys, *s_keys]))
    opened = (
        pairs.join(p_kids, [*p_keys, "p"])
        .join(s_kids, [*s_keys, "s"])
        .select(*keys, F.explode("p_kids").alias("pk"), "s_kids")
        .select(*keys, "pk", F.explode("s_kids").alias("sk"))
    )
    p, s = (lambda c: F.col(f"pk.{c}")), (lambda c: F.col(f"sk.{c}"))
    x, y = (p("lox"), p("hix"), s("lox"), s("hix")), (p("loy"), p("hiy"), s("loy"), s("hiy"))
    # squared distances are enough to compare; the slack absorbs rounding in the bounds
    near = _gap(*x) * _gap(*x) + _gap(*y) * _gap(*y)
    far = _reach(*x) * _reach(*x) + _reach(*y) * _reach(*y)
    sized = opened.select(*keys, F.col("pk.node").alias("p"), F.col("sk.node").alias("s"), near.alias("near"), far.alias("far"))
    best = F.min("far").over(W.partitionBy(*keys, "p"))
    return sized.withColumn("best", best).filter(F.col("near") <= F.col("best") * (1 + 1e-9)).select(*keys, "p", "s")


def _candidates(points, segments, point_id, point_keys, segment_keys, depth, bounds, ties=True) -> DataFrame:
    """(keys, point id, dist, segment ends) of the nearest segments: the leaves that the bounds cannot exclude are searched as arrays, all for one leaf of points in a task."""
    if depth is not None and not 1 <= depth <= MAX_DEPTH:
        raise ValueError(f"depth must be within 1..{MAX_DEPTH}")
    p_keys, s_keys = list(point_keys), list(dict.fromkeys([*point_keys, *segment_keys]))
    pts = points.select(*p_keys, F.col(point_id), F.col("x").alias("_x"), F.col("y").alias("_y"))
    segs = segments.select(*s_keys, *_ENDS)
    square, n_segments = _bounds(pts, segs)
    depth, bounds = depth or _depth(n_segments), bounds or square
    pts = _with_leaf(pts, F.col("_x"), F.col("_y"), bounds, depth, "p")
    segs = _with_leaf(segs, (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, bounds, depth, "s")

    p_boxes = pts.withColumns({"lox": F.col("_x"), "hix": F.col("_x"), "loy": F.col("_y"), "hiy": F.col("_y")})
    s_boxes = segs.withColumns(
        {"lox": F.least("x1", "x2"), "hix": F.greatest("x1", "x2"), "loy": F.least("y1", "y2"), "hiy": F.greatest("y1", "y2")}
    )
    # every level reads the trees; written once, their size is known and the small ones are broadcast
    p_kids = cut(_children(p_boxes, p_keys, depth, "p"), "point-tree")
    s_kids = cut(_children(s_boxes, s_keys, depth, "s"), "segment-tree")
    # the root pair of each key: both roots are node 0 of level 0
    pairs = s_kids.filter(F.col("_level") == 0).select(*s_keys, F.lit(0).cast("bigint").alias("p"), F.col("s"))
    for level in range(depth):
        pairs = _descend(pairs, p_kids, s_kids, level, p_keys, s_keys)
    blocks = _blocks(cut(pairs, "far-pairs"), segs, s_keys, depth)
    sizes = pts.join(blocks.select(*s_keys, "p", "_block"), [*p_keys, "p"]).groupBy(*s_keys, "_block").agg(F.ceil(F.count(F.lit(1)) / POINTS_PER_BLOCK).cast("int").alias("_parts"))
    tasks = blocks.groupBy(*s_keys, "_block").agg(F.collect_set("p").alias("_points"), F.array_distinct(F.flatten(F.collect_list("_leaves"))).alias("_leaves"))
    tasks = cut(tasks.join(sizes, [*s_keys, "_block"]).withColumn("_group", F.monotonically_increasing_id()), "far-blocks")
    placed = pts.join(tasks.select(*s_keys, F.explode("_points").alias("p"), "_group", "_parts"), [*p_keys, "p"])
    dealt = placed.withColumn("_part", F.pmod(F.xxhash64("_x", "_y", point_id), F.col("_parts")).cast("int"))
    wanted = tasks.select(*s_keys, "_group", "_parts", F.explode("_leaves").alias("s"))
    listed = segs.join(wanted, [*s_keys, "s"]).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    found = _searched(listed, dealt, ["_group", "_part"], point_id, ties, far=True)
    return found.join(tasks.select(*s_keys, "_group"), "_group").select(*s_keys, point_id, "dist", *(_ENDS if ties else ()))


def _blocks(pairs: DataFrame, segs: DataFrame, keys: Sequence[str], depth: int) -> DataFrame:
    """(keys, p, _block, _leaves): for each leaf of points the largest node above it whose leaves of segments a task can hold together, and the leaf's own; written once."""
    weights = segs.groupBy(*keys, "s").agg(F.count(F.lit(1)).alias("_n"))
    half = F.lit((1 << 28) - 1)
    up = F.pow(F.lit(4.0), F.lit(depth) - F.col("_level"))
    node = _node(F.col("_level"), F.floor(F.shiftright("p", 28).bitwiseAND(half) / up), F.floor(F.col("p").bitwiseAND(half) / up))
    each = pairs.join(weights, [*keys, "s"]).withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("_block", node)
    held = each.groupBy(*keys, "_level", "_block", "s").agg(F.max("_n").alias("_n")).groupBy(*keys, "_level", "_block").agg(F.sum("_n").alias("_n"))
    fits = held.filter((F.col("_n") <= SEGMENTS_PER_BLOCK) | (F.col("_level") == depth)).select(*keys, "_level", "_block")
    own = each.select(*keys, "p", "_level", "_block").distinct().join(fits, [*keys, "_level", "_block"]).groupBy(*keys, "p").agg(F.min_by("_block", "_level").alias("_block"))
    return cut(own.join(pairs.groupBy(*keys, "p").agg(F.collect_list("s").alias("_leaves")), [*keys, "p"]), "blocks")


def _inputs(points: DataFrame, segments: DataFrame, point_id: str, p_keys: Sequence[str], s_keys: Sequence[str], written: bool = False) -> tuple[DataFrame, DataFrame]:
    """Points (keys, id, _x, _y) and segments with finite ends, each written once (segments may be ``written`` before): every pass below reads them."""
    pts = points.select(*p_keys, F.col(point_id), F.col("x").alias("_x"), F.col("y").alias("_y"))
    finite = lambda c: F.abs(F.col(c)) < float("inf")
    # filtered as read: a filter on what is written would be pushed into the expressions of the ends
    segs = segments.select(*s_keys, *_ENDS)
    segs = (segs if written else cut(segs, "segments")).filter(finite("x1") & finite("y1") & finite("x2") & finite("y2"))
    return cut(pts, "points"), segs.dropna(subset=list(s_keys)) if s_keys else segs


def _groups(segs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _group, _size): a number for each group of segments and the size of its tiles, a power of two that fits its density and mean extent; written once."""
    lox, hix, loy, hiy = F.least("x1", "x2"), F.greatest("x1", "x2"), F.least("y1", "y2"), F.greatest("y1", "y2")
    facts = segs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), (F.max(hix) - F.min(lox)).alias("_wide"), (F.max(hiy) - F.min(loy)).alias("_high"), F.avg(F.greatest(hix - lox, hiy - loy)).alias("_mean")
    ).filter("_n > 0")
    fit = F.greatest(F.sqrt(F.col("_wide") * F.col("_high") * SEGMENTS_PER_TILE / F.col("_n")), F.greatest("_wide", "_high") * SEGMENTS_PER_TILE / F.col("_n"), F.col("_mean") * 4)
    # a group in one place has no extent: any size will do
    level = F.when(fit > 0, F.ceil(F.log2(fit))).otherwise(0).cast("int")
    return cut(facts.select(*keys, F.monotonically_increasing_id().alias("_group"), F.pow(F.lit(2.0), level.cast("double")).alias("_size")), "segment-groups")


def _tiled(pts: DataFrame, segs: DataFrame, groups: DataFrame, point_id: str, p_keys: Sequence[str], s_keys: Sequence[str], ties: bool) -> DataFrame:
    """(keys, id, _x, _y, dist, settled), with ``ties`` also the ends of a segment at that distance, a row for each; written once.

    A point's distance is settled if nothing outside its grown tile can be nearer. Every point has a row for each group of its keys, with infinity if its tile
    holds no segment. Segments come to the tiles that have points; a tile with many points is dealt to several tasks, each with its segments.
    """
    size, halo = F.col("_size"), F.col("_size") * (HALO * (1 + 1e-6))
    tile = lambda v: F.floor(v / size)
    known = pts.filter(F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y"))
    placed = attach(known, groups, p_keys) if p_keys else known.crossJoin(F.broadcast(groups))
    placed = placed.withColumns({"_tx": tile(F.col("_x")), "_ty": tile(F.col("_y"))})
    where = ["_group", "_tx", "_ty"]
    parts = F.ceil(F.count(F.lit(1)) / POINTS_PER_TASK).cast("int").alias("_parts")
    tiles = per_group(placed.groupBy(*where).agg(parts), "tiles")

    span = lambda a, b: F.sequence(tile(F.least(a, b) - halo), tile(F.greatest(a, b) + halo))
    listed = attach(segs, groups, s_keys).select("_group", "_size", *_ENDS, F.explode(span("x1", "x2")).alias("_tx"), span("y1", "y2").alias("_rows"))
    listed = listed.select("_group", "_size", *_ENDS, "_tx", F.size("_rows").alias("_high"), F.explode("_rows").alias("_ty")).join(tiles, where)
    # of the tiles in the box of a line over many, those that it passes
    middle = lambda c: (F.col(c) + 0.5) * size
    passes = (F.col("_high") <= 2) | (segment_distance(middle("_tx"), middle("_ty"), *[F.col(c) for c in _ENDS]) <= size * (0.70711 * (1 + 2.001 * HALO)))
    listed = listed.filter(passes).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    dealt = placed.join(tiles, where).withColumn("_part", F.pmod(F.xxhash64("_x", "_y", point_id), F.col("_parts")).cast("int"))

    found = _searched(listed, dealt, [*where, "_part"], point_id, ties, far=False)
    return cut(found.join(per_group(groups.drop("_size"), "group-numbers"), "_group").select(*s_keys, *[c for c in found.columns if c != "_group"]), "tiled")


def _searched(listed: DataFrame, dealt: DataFrame, by: Sequence[str], point_id: str, ties: bool, far: bool) -> DataFrame:
    """(_group, id, _x, _y, dist, settled), with ``ties`` also the ends of a segment at that distance: points met with all segments of their ``by`` in one task."""
    kind = dealt.schema[point_id].dataType
    row = [*by, *([] if far else ["_size"]), point_id, "_x", "_y", *_ENDS]
    none = F.lit(None).cast("double")
    rows = listed.withColumns({point_id: F.lit(None).cast(kind), "_x": none, "_y": none}).select(*row, F.lit(False).alias("_point"))
    rows = rows.unionByName(dealt.withColumns(dict.fromkeys(_ENDS, none)).select(*row, F.lit(True).alias("_point")))
    tasks = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, *by).sortWithinPartitions(*by, "_point")
    told = [StructField("_group", LongType()), StructField(point_id, kind), *[StructField(c, DoubleType()) for c in ("_x", "_y", "dist")], StructField("settled", BooleanType())]
    told += [StructField(c, DoubleType()) for c in _ENDS] if ties else []
    return rows.mapInArrow(_worker(by, point_id, ties, far), StructType(told))


def _worker(by: Sequence[str], point_id: str, ties: bool, far: bool):
    """Rows sorted by tile (or leaf, if ``far``), segments ahead of points, to points with their distances. A task holds one tile's segments and one batch of points."""
    search, halo, ends, most = array_search(), HALO * (1 - 1e-6), _ENDS, MOST_SEGMENTS

    def work(batches):  # holds all it needs, so executors need not have this package
        import numpy as np
        import pyarrow as pa

        index_of, nearest, boxes_of, nearest_box, *_ = search
        held, many, index, now = [], 0, None, None
        for batch in batches:
            names = batch.schema.names
            column = lambda c: batch.column(names.index(c))  # noqa: E731, B023
            place = np.stack([column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in by])
            point = column("_point").to_numpy(zero_copy_only=False)
            n = len(point)
            new = np.ones(n, dtype=bool)
            new[1:] = (place[:, 1:] != place[:, :-1]).any(axis=0) | (point[1:] != point[:-1])
            starts = np.flatnonzero(new)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n]):
                if (at := tuple(place[:, a].tolist())) != now:
                    held, many, index, now = [], 0, None, at
                value = lambda c: column(c).slice(a, b - a).to_numpy(zero_copy_only=False)  # noqa: E731, B023
                if not point[a]:
                    held.append(np.stack([value(c) for c in ends], axis=1))
                    if sum(map(len, held)) > 2 * many + 65536:  # copies are held once
                        held = [np.unique(np.concatenate(held), axis=0)]
                        many = len(held[0])
                    continue
                x, y = value("_x"), value("_y")
                if far:
                    index = index or boxes_of(np.concatenate(held))
                    dist, pairs = nearest_box(index, x, y, ties)
                    settled = np.ones(len(x), dtype=bool)
                else:
                    size = value("_size")[0]
                    left, low, edge = at[1] * size, at[2] * size, size * halo
                    if index is None and held:
                        index = index_of(np.concatenate(held), (left - edge, low - edge, left + size + edge, low + size + edge))
                    dist, pairs = nearest(index, x, y, ties, most) if index else (np.full(len(x), np.inf), None)
                    with np.errstate(invalid="ignore"):
                        room = np.minimum(np.minimum(x - left, left + size - x), np.minimum(y - low, low + size - y)) + edge
                    settled = dist * (1 + 1e-9) <= room
                held = []
                own = [column("_group").slice(a, b - a), column(point_id).slice(a, b - a), column("_x").slice(a, b - a), column("_y").slice(a, b - a), pa.array(dist), pa.array(settled)]
                told = ["_group", point_id, "_x", "_y", "dist", "settled"]
                if ties:
                    lone = np.flatnonzero(~np.isfinite(dist))
                    p = np.concatenate([pairs[0], lone]) if pairs is not None else lone
                    segs = index["segs"][pairs[1]] if pairs is not None else np.zeros((0, 4))
                    segs = np.concatenate([segs, np.full((len(lone), 4), np.nan)])
                    own = [c.take(pa.array(p)) for c in own] + [pa.array(np.ascontiguousarray(segs[:, k])) for k in range(4)]
                    told += list(ends)
                yield pa.RecordBatch.from_arrays(own, names=told)

    return work


def _close_by(pts: DataFrame, segs: DataFrame, point_id: str, p_keys: Sequence[str], s_keys: Sequence[str], ties: bool = False):
    """(settled, rest, segments, groups): points with their exact distance from the tiles, and those that these do not settle with the segments of their groups."""
    groups = _groups(segs, s_keys)
    found = _tiled(pts, segs, groups, point_id, p_keys, s_keys, ties)
    rest = found.filter(~F.col("settled")).select(*s_keys, point_id, F.col("_x").alias("x"), F.col("_y").alias("y")).distinct()
    rest = cut(rest, "far-points")
    if s_keys:
        segs = segs.join(per_group(rest.select(*s_keys).distinct(), "far-groups"), list(s_keys), "left_semi")
    return found.filter("settled").drop("settled"), rest, segs, groups


def nearest_distance(
    points: DataFrame,
    segments: DataFrame,
    point_id: str,
    point_keys: Sequence[str] = (),
    segment_keys: Sequence[str] = (),
    depth: int | None = None,
    bounds: tuple[float, float, float] | None = None,
) -> DataFrame:
    """(keys, point id, dist): exact distance from each point (x, y) to the closest segment.

    ``point_keys`` are columns that must match on both sides (a projection zone, say); ``segment_keys`` split the
    segments so that each key value gets its own nearest distance (a kind of water). Without them every point keeps a
    row, with NULL where no segment has its keys. Bounds and depth of the trees follow from the data.
    """
    keys = list(dict.fromkeys([*point_keys, *segment_keys]))
    pts, segs = _inputs(points, segments, point_id, point_keys, keys)
    found, rest, segs, _ = _close_by(pts, segs, point_id, point_keys, keys)
    found = found.select(*keys, point_id, "dist")
    if not rest.isEmpty():
        found = found.unionByName(_candidates(rest, segs, point_id, keys, (), depth, bounds, ties=False).select(*keys, point_id, "dist"))
    nearest = found.groupBy(*keys, point_id).agg(F.min("dist").alias("dist"))
    if segment_keys:
        return nearest
    return points.select(*point_keys, point_id).join(nearest, [*point_keys, point_id], "left")


def nearest_features(
    points: DataFrame,
    segments: DataFrame,
    point_id: str,
    feature_id: str = "feature_id",
    depth: int | None = None,
    bounds: tuple[float, float, float] | None = None,
) -> DataFrame:
    """(point id, feature, dist): the nearest feature of every point; equidistant features give several rows.

    Left join: with no segments at all each point keeps one row with NULLs.
    """
    # read again for the features' names
    segments = cut(segments.select(feature_id, *_ENDS), "features")
    pts, segs = _inputs(points, segments, point_id, (), (), written=True)
    settled, rest, segs, _ = _close_by(pts, segs, point_id, (), (), ties=True)
    found = settled.select(point_id, "dist", *_ENDS)
    if not rest.isEmpty():
        found = found.unionByName(_candidates(rest, segs, point_id, (), (), depth, bounds))
    ranked = found.withColumn("_rank", F.rank().over(W.partitionBy(point_id).orderBy("dist"))).filter("_rank = 1")
    named = ranked.join(segments.select(feature_id, "x1", "y1", "x2", "y2"), ["x1", "y1", "x2", "y2"])
    named = named.select(point_id, feature_id, "dist").distinct()
    return points.select(point_id).join(named, point_id, "left")
