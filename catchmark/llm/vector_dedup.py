"""Embedding near-dedup by sorted projection passes.

In each pass every vector gets a key, the concatenated sign bits of random projections, and the vectors of a label and length are put
in order of their keys (ties by the vector's hash): one range-partitioned sort gives each its exact place. A vector is compared with
the next ``window`` places. Vectors that share the leading bits of a key stand together; such a run, where it is longer than the window, is
finished whole. So two vectors meet in a pass whenever they agree in the leading bits, whatever the number of partitions or
the size of the run: at an angle t they agree in a bit with probability 1 - t / pi, wherever their label's vectors lie, and there are as many
passes as a pair right at the threshold needs to meet with probability RECALL. Windows find further pairs on top of that.
The number of leading bits is the cheapest by the sizes that runs are measured to have over all rows.

Work is dealt out by place: a unit is a block of BLOCK places with the first ``window`` places of the next block, or, for a run that lies in
several blocks, a pair of these. A unit tells for each vector the number of its new links and one link of a spanning forest, never pairs,
so what is written grows with the rows and not with the links. A pair is counted in the first pass in which it meets: rows carry
their places and runs of earlier passes. Exact copies are one class, compared once and counted by its size.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors without a label, link with
nothing and stay; vectors of other lengths are never compared; repeated vec_ids are rows of their own; extra columns are not
read. Classes are known by a 64-bit hash of label and vector.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from catchmark.llm.components import components
from catchmark.operators.lineage import cut
from catchmark.operators.ordered import attach, per_group

THRESHOLD, WINDOW, RECALL, SEED, BITS = 0.93, 64, 0.9999, 10, 63
#: Places of a block. Comparisons that take as long as dealing out a row.
BLOCK, ROW_COST = 2048, 512


def passes_at(bits: float, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """Passes after which two vectors at the threshold have agreed in so many leading bits with probability ``recall``."""
    met = (1 - math.acos(threshold) / math.pi) ** bits
    return 1 if met >= recall else math.ceil(math.log(1 - recall) / math.log(1 - met))


def near_in_order(rows: np.ndarray, runs: np.ndarray, own: int, threshold: float, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs (i, j), i < j, of unit rows in order of their keys that are at most ``window`` places apart or in one run.

    Only the first ``own`` rows are of the block; the others follow it and are met by the window alone.
    """
    ends = np.append(np.flatnonzero(runs[1:own] != runs[: own - 1]) + 1, own)
    for at in range(0, own, window):
        stop = min(at + window, own)
        end = max(min(stop + window, len(rows)), ends[np.searchsorted(ends, stop - 1, "right")])
        i, j = np.nonzero(rows[at:stop] @ rows[at:end].T >= threshold - 1e-9)
        i, j = i + at, j + at
        met = (j > i) & ((j - i <= window) | ((runs[i] == runs[j]) & (j < own)))
        yield _sure(rows, i[met], j[met], threshold)


def near_across(rows: np.ndarray, places: np.ndarray, own: int, threshold: float, window: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Near pairs of one of the first ``own`` rows and one of the others, more than ``window`` places apart."""
    for at in range(0, own, window):
        i, j = np.nonzero(rows[at : min(at + window, own)] @ rows[own:].T >= threshold - 1e-9)
        i, j = i + at, j + own
        far = places[j] - places[i] > window
        yield _sure(rows, i[far], j[far], threshold)


def _sure(rows: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    near = np.einsum("ij,ij->i", rows[i], rows[j]) >= threshold
    return i[near], j[near]


def join_roots(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the trees of linked rows; every row's root is the smallest row of its tree."""
    while True:
        a, b = roots[i], roots[j]
        apart = a != b
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(roots, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (roots != (up := roots[roots])).any():
            roots[:] = up


def usable(embedding: str, label: str):
    """Labelled, of some length, finite throughout, and not all zero."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(label).isNotNull() & F.col(embedding).isNotNull() & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


@lru_cache(maxsize=64)
def _planes(seed: int, turn: int, wide: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, turn, wide])).standard_normal((wide, BITS))


def _by_length(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of the vectors of each length."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.cumsum(sizes) - sizes
    for wide in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == wide)
        yield wide, at, flat[(starts[at][:, None] + np.arange(wide)).reshape(-1)].reshape(-1, wide)


def _keys(rows: np.ndarray, seed: int, turn: int) -> np.ndarray:
    return (rows @ _planes(seed, turn, rows.shape[1]) > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def plan(vectors: DataFrame, label: str, embedding: str, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = SEED, window: int = WINDOW) -> DataFrame:
    """label, wide, bits, passes of each group of vectors that are compared.

    The bits are those of least cost, from the sizes that runs of 0, 1, 2, ... leading bits of the first pass's keys really have over all
    rows; bits need not halve a group. A group has no bits, and is one run, only if it fits a window or keys don't part it: more than half of it
    agree in as many bits as would part it into single rows.
    """
    kinds = dict(vectors.dtypes)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for wide, at, rows in _by_length(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), wide, np.int32)), pa.array(_keys(rows, seed, 0))], ["label", "wide", "key"])

    keyed = cut(vectors.select(label, embedding).mapInArrow(first, f"label {kinds[label]}, wide int, key bigint"), "first")
    largest = keyed.groupBy("label", "wide").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    passes = [passes_at(bits, threshold, recall) for bits in range(math.ceil(math.log2(max(2, largest))) + 1)]
    levels = keyed.withColumn("bits", F.explode(F.sequence(F.lit(0), F.lit(len(passes) - 1))))
    sizes = levels.groupBy("label", "wide", "bits", F.expr(f"shiftright(key, {BITS} - bits)")).agg(F.count("*").cast("double").alias("n"))
    n = F.col("n")
    cost = F.sum(F.lit(ROW_COST) * n + n * window + F.when(n > window, F.lit(ROW_COST) * n * n / BLOCK + n * n / 2).otherwise(0))
    rounds = F.element_at(F.array(*map(F.lit, passes)), F.col("bits") + 1)
    costs = sizes.groupBy("label", "wide", "bits").agg(cost.alias("cost"), F.sum("n").alias("all"), F.max("n").alias("longest")).withColumn("passes", rounds)
    finest = F.min_by("longest", -F.col("bits"))
    parts = (F.max("all") > window) & (finest * 2 <= F.max("all"))
    whole = F.min(F.when(F.col("bits") == 0, F.struct((F.col("cost") * F.col("passes")).alias("cost"), "bits", "passes")))
    parted = F.min(F.when(F.col("bits") > 0, F.struct((F.col("cost") * F.col("passes")).alias("cost"), "bits", "passes")))
    best = costs.groupBy("label", "wide").agg(F.when(parts, parted).otherwise(F.least(whole, parted)).alias("best"))
    return best.select("label", "wide", "best.bits", "best.passes")


def placed(planned: DataFrame, window: int, seed: int) -> DataFrame:
    """For each node its passes in order: place, run (leading bits), and first and last place of a run longer than the window.

    One sort by range over all groups and passes; a part's rows are numbered where they lie, and the places before a part come from
    a table of counts with a row for each part and for each pass of a group.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, passes = (batch.column(k).to_numpy() for k in (4, 5))
            for _, at, rows in _by_length(batch.column(2)):
                for k in range(passes[at].max()):
                    live = passes[at] > k
                    at, rows = at[live], rows[live]
                    key = _keys(rows, seed, k)
                    own = batch.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([own.column(1), own.column(3), pa.array(np.full(len(at), k, np.int32)), pa.array(key), pa.array(key >> (BITS - bits[at])), own.column(0)], ["label", "wide", "pass", "key", "run", "node"])

    group, order = ["label", "wide", "pass"], ["label", "wide", "pass", "key", "node"]
    keyed = planned.mapInArrow(keys, f"label {dict(planned.dtypes)['label']}, wide int, pass int, key bigint, run bigint, node bigint")
    inorder = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()})
    inorder = cut(inorder, "order")
    counts = inorder.groupBy(*group, "part").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    earlier = F.coalesce(F.sum("n").over(W.partitionBy(*group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = attach(inorder, counts.select(*group, "part", (earlier - F.col("first")).alias("shift")), [*group, "part"])
    rows = rows.select(*group, "run", "node", (F.col("seq") + F.col("shift")).alias("place"))
    runs = rows.groupBy(*group, "run").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter(F.col("last") - F.col("first") >= window)
    spans = rows.join(per_group(runs, "runs"), [*group, "run"], "left")
    return spans.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pass", "place", "run", "first", "last"))).alias("at"))


def _met(vectors: DataFrame, node: str, label: str, embedding: str, size, threshold: float, window: int, recall: float, seed: int, tell: Callable, schema: str) -> DataFrame:
    """``tell(ids, sizes, pairs)`` of every unit, where ``pairs`` are its near pairs that met in no earlier pass."""
    block = max(BLOCK, window)
    slim = vectors.select(F.col(node).alias("node"), F.col(label).alias("label"), F.col(embedding).alias("embedding"), F.size(embedding).alias("wide"), size.alias("size"))
    plans = plan(vectors, label, embedding, threshold, recall, seed, window)
    planned = attach(slim, plans, ["label", "wide"]).select("node", "label", "embedding", "wide", "bits", "passes")
    places = cut(placed(planned, window, seed), "places")
    each = slim.join(places, "node").select("*", F.posexplode("at").alias("k", "here")).withColumn("own", F.expr(f"here.place div {block}"))
    units = F.expr(f"""concat(
        array(struct(own AS lo, own AS hi, 0 AS side)),
        if(own > 0 AND here.place % {block} < {window}, array(struct(own - 1 AS lo, own - 1 AS hi, 1 AS side)), array()),
        if(here.first IS NOT NULL, transform(filter(sequence(here.first div {block}, here.last div {block}), v -> v <> own),
            v -> struct(least(v, own) AS lo, greatest(v, own) AS hi, if(v < own, 1, 0) AS side)), array()))""")
    unit = ["label", "wide", "k", "lo", "hi"]
    dealt = each.withColumn("unit", F.explode(units)).select(
        "label", "wide", "k", "unit.lo", "unit.hi", "unit.side", "here.place", "here.run", "node", "size", "embedding",
        F.expr("slice(at.place, 1, k)").alias("places"), F.expr("slice(at.run, 1, k)").alias("runs"),
    )
    dealt = dealt.repartition(*unit).sortWithinPartitions(*unit, "side", "place")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(group: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(group)
            ids, sizes, place, run, side = (table[c].to_numpy() for c in ("node", "size", "place", "run", "side"))
            own = int((side == 0).sum())
            across = table["lo"][0] != table["hi"][0]
            if own == 0 or len(ids) < 2 or (across and own == len(ids)):
                return
            flat = lambda name: np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table[name].chunks]).reshape(len(ids), -1)
            rows, places, runs = flat("embedding").astype(np.float64), flat("places"), flat("runs")
            rows /= np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
            found = near_across(rows, place, own, threshold, window) if across else near_in_order(rows, run, own, threshold, window)

            def fresh() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                for i, j in found:
                    for k in range(places.shape[1]):
                        new = (runs[i, k] != runs[j, k]) & (np.abs(places[i, k] - places[j, k]) > window)
                        i, j = i[new], j[new]
                    if len(i):
                        yield i, j

            yield from tell(ids, sizes, fresh())

        held, name = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(c) for c in range(len(unit))]
            moved = np.zeros(batch.num_rows - 1, bool)
            for c in own:
                moved |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(moved) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                now = [c[a].as_py() for c in own]
                if held and name != now:
                    yield from told(held)
                    held = []
                name = now
                held.append(batch.slice(a, b - a))
        if held:
            yield from told(held)

    return dealt.mapInArrow(compare, schema)


def links(vectors: DataFrame, node: str, label: str, embedding: str, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """Distinct pairs (a, b), a < b, of nodes with equal label that are found near. ``vectors``: one usable row for each node."""

    def pairs(ids, sizes, found):
        for i, j in found:
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[i], ids[j])), pa.array(np.maximum(ids[i], ids[j]))], ["a", "b"])

    return _met(vectors, node, label, embedding, F.lit(1).cast("bigint"), threshold, window, recall, seed, pairs, "a bigint, b bigint")


def link_counts(vectors: DataFrame, node: str, label: str, embedding: str, size: str, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """(node, linked, other) rows: ``linked`` adds up to the sizes of the nodes near it, the links (node, other) connect what is near.

    At most one row for each node of a unit, so its size does not depend on the number of links; ``other`` is null at a root.
    """

    def counted(ids, sizes, found):
        linked, roots = np.zeros(len(ids), np.int64), np.arange(len(ids))
        for i, j in found:
            np.add.at(linked, i, sizes[j])
            np.add.at(linked, j, sizes[i])
            join_roots(roots, i, j)
        at = np.flatnonzero(linked)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(linked[at]), pa.array(ids[roots[at]], mask=roots[at] == at)], ["node", "linked", "other"])

    return _met(vectors, node, label, embedding, F.col(size), threshold, window, recall, seed, counted, "node bigint, linked bigint, other bigint")


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """vec_id, n_links, component_id, kept (it stands for its component) for every row."""
    node = F.when(usable("embedding", "label"), F.xxhash64("label", "embedding"))
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).alias("embedding"), F.col(label).alias("label")).withColumn("node", node)
    members = rows.select("vec_id", "node")
    classes = cut(
        rows.filter("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("size"), F.min("vec_id").alias("first_id")), "classes"
    )
    counts = cut(link_counts(classes, "node", "label", "embedding", "size", threshold, window), "counts")
    linked = counts.groupBy("node").agg(F.sum("linked").alias("linked"))
    labels = cut(components(counts, "node", "other"), "labels")
    named = classes.select("node", "size", "first_id").join(labels, "node", "left").withColumn("group", F.coalesce(F.col("label"), F.col("node")))
    firsts = cut(named.groupBy("group").agg(F.min("first_id").alias("component_id")), "firsts")
    facts = cut(named.join(firsts, "group").join(linked, "node", "left").select("node", (F.col("size") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id"), "facts")
    out = members.join(facts, "node", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
