"""Point-in-polygon, radius search and extents over edge tables.

A polygon is a set of directed or undirected edges (id, x1, y1, x2, y2); holes and multiparts are just more
edges. Membership is crossing parity with points on the boundary excluded.

``polygon_index`` turns the edges into grid cells that hold, for each polygon that reaches the cell, only the edges a
point in that cell has to look at. Cells come in powers of two and each polygon takes the size that fits it: its width,
and less the more edges it has. So a cell meets few polygons and few edges of each, however many polygons there are.
Locating points is an equi-join on the cell: no point is regrouped, all keep their columns, and a crowded cell can be
split by adaptive skew handling because the other side has one row. On which side of an edge a point lies is decided exactly (``functions.exact``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from catchmark.functions.exact import bound, side_of_line
from catchmark.functions.geometry import segment_distance
from catchmark.operators.lineage import cut
from catchmark.operators.ordered import require
from catchmark.operators.tile_search import array_search

EDGES_PER_CELL = 8
#: Sites beyond which a tile of the radius search is dealt to several tasks.
SITES_PER_TASK = 10_000


def _cell(c: Column, size: Column | float) -> Column:
    return F.floor(c / (size if isinstance(size, Column) else F.lit(float(size))))


def _power(level: Column) -> Column:
    return F.pow(F.lit(2.0), level.cast("double"))


def polygon_index(edges: DataFrame, id_col: str = "basin_id") -> DataFrame:
    """(level, cx, cy, polys) with polys = array of (id, base, local edges), written once; a cell is 2^level wide.

    For a ray going right from a point in cell (cx, cy), an edge wholly right of the cell that spans the cell's
    whole height is crossed by every such point: it only adds one to ``base``. Edges left of the cell or outside
    its strip cannot matter. Cells outside the polygon drop out; cells deep inside carry no edges at all.
    Comparisons use cell numbers, which are monotone in the coordinate, so rounding cannot lose an edge.
    """
    lox, hix = F.least("x1", "x2"), F.greatest("x1", "x2")
    loy, hiy = F.least("y1", "y2"), F.greatest("y1", "y2")
    own = W.partitionBy("id")
    boxed = edges.select(F.col(id_col).alias("id"), F.struct("x1", "y1", "x2", "y2").alias("edge"), lox.alias("lox"), hix.alias("hix"), loy.alias("loy"), hiy.alias("hiy"))
    boxed = boxed.withColumns(
        {
            "wide": F.max("hix").over(own) - F.min("lox").over(own),
            "high": F.max("hiy").over(own) - F.min("loy").over(own),
            "n": F.count(F.lit(1)).over(own),
        }
    ).filter((F.col("wide") > 0) & (F.col("high") > 0))  # others have no inside
    fit = F.greatest("wide", "high") / F.sqrt(F.greatest(F.lit(1.0), F.col("n") / float(EDGES_PER_CELL)))
    boxed = boxed.withColumn("level", F.ceil(F.log2(fit)).cast("int"))
    size = _power(F.col("level"))
    strips = boxed.select(
        "id", "level", "edge", _cell(F.col("lox"), size).alias("cx_lo"), _cell(F.col("hix"), size).alias("cx_hi"),
        _cell(F.col("loy"), size).alias("cy_lo"), _cell(F.col("hiy"), size).alias("cy_hi"),
    ).withColumn("cy", F.explode(F.sequence("cy_lo", "cy_hi")))
    strips = strips.withColumn("left", F.min("cx_lo").over(W.partitionBy("id", "cy")))
    cells = strips.withColumn("cx", F.explode(F.sequence("left", "cx_hi")))
    always = (F.col("cx_lo") > F.col("cx")) & (F.col("cy_lo") < F.col("cy")) & (F.col("cy_hi") > F.col("cy"))
    # all of this is grouped on data already placed by id: no further shuffle
    per_polygon = cells.groupBy("id", "level", "cy", "cx").agg(
        F.sum(F.when(always, 1).otherwise(0)).cast("int").alias("base"),
        F.collect_list(F.when(~always, F.col("edge"))).alias("edges"),
    )
    per_polygon = per_polygon.filter((F.size("edges") > 0) | (F.col("base") % 2 == 1))
    return cut(per_polygon.groupBy("level", "cx", "cy").agg(F.collect_list(F.struct("id", "base", "edges")).alias("polys")), "polygon-index")


def _crossings(poly: Column, px: Column, py: Column) -> Column:
    """Number of crossings right of the point, or -1 when the point lies on an edge. Decided exactly, however close the point is."""

    def met(acc, e):
        x1, y1, x2, y2 = e["x1"], e["y1"], e["x2"], e["y2"]
        beside = ((y1 > py) & (y2 > py)) | ((y1 < py) & (y2 < py)) | ((px > x1) & (px > x2))
        straddles = (y1 > py) != (y2 > py)
        ahead = lambda side: F.when(side == 0, -1).when(straddles & ((side > 0) == (y2 > y1)), acc + 1).otherwise(acc)
        # in the edge's box its line decides; left of the box the ray meets whatever straddles it
        left = F.when(straddles, acc + 1).otherwise(acc)
        return F.when((acc < 0) | beside, acc).when((px < x1) & (px < x2), left).otherwise(bound(side_of_line(px, py, x1, y1, x2, y2), ahead))

    return F.aggregate(poly["edges"], poly["base"], met)


def locate(points: DataFrame, index: DataFrame, how: str = "left", x: str = "lon", y: str = "lat", out: str = "basin_id") -> DataFrame:
    """Attach the id of the polygon a point lies in.

    ``left`` keeps unmatched points with NULL, ``inner`` drops them; overlapping polygons give one row each in
    both. ``semi`` keeps each matched point once, without an id.

    ``inner`` is one join: a point is listed in its cell of each size in use, so points are moved at most once. The others join one size after the
    other, as what a point met must be on one row; the driver reads the sizes for that.
    """
    px, py = F.col(x), F.col(y)

    def inside(poly):
        return _crossings(poly, px, py) % 2 == 1  # -1 % 2 is -1

    hits = lambda: F.transform(F.filter("_polys", inside), lambda poly: poly["id"])
    if how == "inner":
        levels = F.broadcast(index.agg(F.collect_set("level").alias("_levels")))  # one row of a few sizes
        spread = points.crossJoin(levels).withColumn("_level", F.explode("_levels")).drop("_levels")
        size = _power(F.col("_level"))
        placed = spread.withColumns({"_cx": _cell(px, size), "_cy": _cell(py, size)})
        cells = index.select(F.col("level").alias("_level"), F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), F.col("polys").alias("_polys"))
        return placed.join(cells, ["_level", "_cx", "_cy"]).select(*points.columns, F.explode(hits()).alias(out))
    levels = sorted(r["level"] for r in index.select("level").distinct().collect())
    kind = dict(index.select(F.explode("polys.id").alias("id")).dtypes)["id"]
    found = points
    gathered = F.array().cast(f"array<{kind}>")
    for k, level in enumerate(levels):
        placed = found.withColumns({"_cx": _cell(px, 2.0**level), "_cy": _cell(py, 2.0**level)})
        cells = index.filter(F.col("level") == level).select(F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), F.col("polys").alias("_polys"))
        joined = placed.join(cells, ["_cx", "_cy"], "left")
        own = F.coalesce(hits(), gathered)
        found = joined.select(*points.columns, (F.concat("_hits", own) if k else own).alias("_hits"))
    if not levels:
        found = points.withColumn("_hits", gathered)
    if how == "semi":
        return found.filter(F.size("_hits") > 0).select(*points.columns)
    return found.select(*points.columns, F.explode_outer("_hits").alias(out))


def points_in_polygons(points, edges, how="left", x="lon", y="lat", id_col="basin_id") -> DataFrame:
    return locate(points, polygon_index(edges, id_col), how, x, y, id_col)


def domain_filter(points, edges, x="lon", y="lat", id_col="basin_id", distinct_points=False) -> DataFrame:
    """Points inside any polygon. A point in k overlapping polygons appears k times unless ``distinct_points``."""
    if distinct_points:
        return points_in_polygons(points, edges, "semi", x, y, id_col)
    return points_in_polygons(points, edges, "inner", x, y, id_col).drop(id_col)


def reach_map(reaches: DataFrame, edges: DataFrame) -> DataFrame:
    """One basin per reach (the smallest id where basins overlap), with the reach's order."""
    hit = points_in_polygons(reaches, edges, "inner")
    return hit.groupBy("feature_id").agg(F.min("basin_id").alias("basin_id"), F.max("ord").alias("ord"))


def extent(edges: DataFrame) -> DataFrame:
    """One row: min and max of all edge end points."""
    return edges.agg(
        F.min(F.least("x1", "x2")).alias("minx"),
        F.min(F.least("y1", "y2")).alias("miny"),
        F.max(F.greatest("x1", "x2")).alias("maxx"),
        F.max(F.greatest("y1", "y2")).alias("maxy"),
    )


def boundary_lines(edges: DataFrame, kind: str, id_col: str) -> DataFrame:
    """Polygon rings as line segments of a water or boundary layer."""
    return edges.select(
        F.lit(kind).alias("kind"), F.col(id_col).alias("feature_id"), F.lit(None).cast("int").alias("ord"), "x1", "y1", "x2", "y2"
    )


def polygons_near(sites: DataFrame, edges: DataFrame, radius: float, site_id: str, id_col: str = "basin_id", split: int = 4) -> DataFrame:
    """Distinct (site, polygon) where the polygon meets the closed disk of ``radius`` around the site.

    Either an edge comes within the radius or the site lies inside. The plane is parted into tiles of ``split`` radii; an edge goes to the tiles that,
    grown by the radius, its line passes, a site to its own. So a task knows all of a site's polygons and writes each once: pairs are not exchanged.
    A polygon that the site lies in comes with the site's place and counts if no edge is near. A tile with many sites is dealt to several tasks.
    """
    # both are read several times below, and filters on them would be pushed into their own expressions
    sites, edges = cut(sites.select(site_id, "x", "y").distinct(), "near-sites"), cut(edges.select(id_col, "x1", "y1", "x2", "y2"), "near-edges")
    # ids that stand for several places
    sites = cut(sites.withColumn("_many", F.count(F.lit(1)).over(W.partitionBy(site_id)) > 1), "near-places")
    size, reach, names = float(radius) * split, float(radius) * (1 + 1e-6), ("x1", "y1", "x2", "y2")
    where, ends = ["_cx", "_cy"], [F.col(c) for c in names]
    here = sites.filter(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    inside = points_in_polygons(here, edges, "inner", "x", "y", id_col).withColumn("_kind", F.lit(2))
    here = here.withColumns({id_col: F.lit(None).cast(edges.schema[id_col].dataType), "_kind": F.lit(1)})
    placed = here.unionByName(inside).withColumns({"_cx": _cell(F.col("x"), size), "_cy": _cell(F.col("y"), size)})
    tiles = cut(placed.filter("_kind = 1").groupBy(*where).agg(F.ceil(F.count(F.lit(1)) / SITES_PER_TASK).cast("int").alias("_parts")), "near-tiles")
    dealt = placed.hint("merge").join(tiles, where).withColumn("_part", F.pmod(F.xxhash64("x", "y", site_id), F.col("_parts")).cast("int"))

    finite = lambda c: F.abs(F.col(c)) < float("inf")
    span = lambda a, b: F.sequence(_cell(F.least(a, b) - reach, size), _cell(F.greatest(a, b) + reach, size))
    listed = edges.filter(finite("x1") & finite("y1") & finite("x2") & finite("y2")).select(id_col, *names, F.explode(span("x1", "x2")).alias("_cx"), span("y1", "y2").alias("_rows"))
    listed = listed.select(id_col, *names, "_cx", F.size("_rows").alias("_high"), F.explode("_rows").alias("_cy"))
    # of the tiles in an edge's box, those that its line passes
    middle = lambda c: (F.col(c) + 0.5) * size
    listed = listed.filter((F.col("_high") <= 2) | (segment_distance(middle("_cx"), middle("_cy"), *ends) <= 0.70711 * (size + 2.001 * reach)))
    # the planner takes a list of tiles for as small as what it was made from, and would broadcast it
    listed = listed.hint("merge").join(tiles, where).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    none = lambda kind, *cols: {c: F.lit(None).cast(kind) for c in cols}
    row = [*where, "_part", "_kind", site_id, "x", "y", "_many", id_col, *names]
    rows = listed.withColumns({**none("double", "x", "y"), **none("boolean", "_many"), **none(sites.schema[site_id].dataType, site_id), "_kind": F.lit(0)}).select(*row)
    rows = rows.unionByName(dealt.withColumns(none("double", *names)).select(*row))
    tasks = int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, *where, "_part").sortWithinPartitions(*where, "_part", "_kind")
    told = StructType([sites.schema[site_id], edges.schema[id_col], StructField("_many", BooleanType())])
    found = rows.mapInArrow(_near_worker(site_id, id_col, float(radius), size), StructType([StructField(f.name, f.dataType) for f in told]))
    if sites.filter("_many").isEmpty():
        return found.drop("_many")
    found = cut(found, "near-polygons")
    return found.filter(~F.col("_many")).drop("_many").unionByName(found.filter("_many").drop("_many").distinct())


def _near_worker(site_id: str, id_col: str, radius: float, size: float):
    """Rows sorted by tile, edges ahead of sites ahead of sites with the polygon they lie in, to (site, polygon). A task holds one tile's edges and one batch."""
    search, names = array_search(), ("x1", "y1", "x2", "y2")

    def work(batches):  # holds all it needs, so executors need not have this package
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        *_, index_of, reached, polygons_within = search
        held, ids, index, known, now = [], [], None, None, None
        for batch in batches:
            at_name = batch.schema.names.index
            column = lambda c: batch.column(at_name(c))  # noqa: E731, B023
            place = np.stack([column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_cx", "_cy", "_part", "_kind")])
            starts = np.flatnonzero(np.append(True, (place[:, 1:] != place[:, :-1]).any(axis=0)))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows]):
                *at, kind = place[:, a].tolist()
                if at != now:
                    held, ids, index, known, now = [], [], None, None, at
                part = lambda c: column(c).slice(a, b - a)  # noqa: E731, B023
                value = lambda c: part(c).to_numpy(zero_copy_only=False)  # noqa: E731, B023
                if kind == 0:
                    held.append(np.stack([value(c) for c in names], axis=1))
                    ids.append(part(id_col))
                    continue
                if held:
                    coded = pa.concat_arrays(ids).dictionary_encode(null_encoding="encode")
                    known, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
                    low = [c * size - radius * (1 + 1e-7) for c in now[:2]]
                    index = index_of(np.concatenate(held), code, (*low, *(c + size + 2.0000002 * radius for c in low)), radius)
                    held, ids = [], []
                x, y = value("x"), value("y")

                def told(p, polygons):
                    return pa.RecordBatch.from_arrays([part(site_id).take(p), polygons, part("_many").take(p)], names=[site_id, id_col, "_many"])  # noqa: B023

                if kind == 2:
                    # counted with the site if an edge is near
                    polygon, alone = part(id_col), np.ones(b - a, dtype=bool)
                    if index:
                        k = pc.index_in(polygon, value_set=known)
                        p = np.flatnonzero(k.is_valid().to_numpy(zero_copy_only=False))
                        alone[p] = ~reached(index, x, y, p, k.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)[p], radius)
                    p = pa.array(np.flatnonzero(alone))
                    yield told(p, polygon.take(p))
                elif index:
                    for p, k in polygons_within(index, x, y, radius):
                        yield told(pa.array(p), known.take(pa.array(k)))

    return work


def basins_of_site(sites: DataFrame, located: DataFrame, keys: DataFrame, site: list[str], group: str, id_col: str = "basin_id") -> DataFrame:
    """All polygons that share the group (a coarser basin's number) of the polygon a site lies in.

    ``located`` is (site columns, polygon), ``keys`` is (polygon, group). A site in no polygon stops the query.
    """
    own = located.join(keys.select(id_col, group), id_col).select(*site, group)
    # a keyless aggregate is one row, also when every site has a basin
    missing = sites.select(*site).join(own, site, "left_anti").agg(F.count(F.lit(1)).alias("_missing"))
    checked = missing.filter(require(F.col("_missing") == 0, "a site lies in no basin")).drop("_missing")
    return own.distinct().join(keys, group).crossJoin(F.broadcast(checked))
