from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchmark.llm import vector_dedup as vd

SCHEMA = "vec_id bigint, embedding array<float>, label int, node string, size int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], g, "n", 1) for i, v, g in rows], SCHEMA)


def brute(rows):
    """(n_links, component_id) of each row by all pairs."""
    ok = {k: np.array(v, np.float32).astype(float) for k, (_, v, g) in enumerate(rows) if v is not None and g is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in ok:
        for j in ok:
            if j < i and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= 0.93:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return sorted((i, links[k], least[find(k)]) for k, (i, _, _) in enumerate(rows))


def sample(seed=1, groups=40, dense=120):
    g = np.random.default_rng(seed)
    rows = []
    for k in range(groups):
        base = g.normal(size=16)
        for e in (0, 0, 0.02, 0.08, 0.1, 0.12, 0.5):
            rows.append((len(rows), base + e * g.normal(size=16), k % 3))
    base = g.normal(size=16)
    rows += [(len(rows) + k, base + 0.05 * g.normal(size=16), 1) for k in range(dense)]
    return rows


def test_recall_against_all_pairs(spark):
    rows = sample()
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in vd.near_duplicates(table(spark, rows)).collect())
    want = brute(rows)
    assert sum(w[1] for w in want) * 0.99 <= sum(g[1] for g in got) <= sum(w[1] for w in want)
    assert sum(g != w for g, w in zip(got, want)) <= 0.02 * len(rows)


def test_passes_grow_with_the_bits():
    assert vd.passes_at(0) == 1 and vd.passes_at(20) > vd.passes_at(8) > vd.passes_at(1) > 1


@pytest.mark.parametrize("own", [1, 7, 150, 200])
def test_windows_and_runs_in_order(own):
    """Every near pair at most a window apart or in one run of the block, once; rows after the block only by the window."""
    g = np.random.default_rng(own)
    rows = g.normal(size=(200, 4)) * 0.4 + 1
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    runs = np.sort(g.integers(0, 12, 200))
    got = [(i, j) for a, b in vd.near_in_order(rows, runs, own, 0.93, 16) for i, j in zip(a.tolist(), b.tolist())]
    want = {(i, j) for i in range(own) for j in range(i + 1, 200) if rows[i] @ rows[j] >= 0.93 and (j - i <= 16 or (j < own and runs[i] == runs[j]))}
    assert len(got) == len(set(got)) and set(got) == want
    places = np.concatenate([np.arange(own), np.arange(own, 200)])
    got = [(i, j) for a, b in vd.near_across(rows, places, own, 0.93, 16) for i, j in zip(a.tolist(), b.tolist())]
    assert sorted(got) == [(i, j) for i in range(own) for j in range(own, 200) if j - i > 16 and rows[i] @ rows[j] >= 0.93]


def test_roots_of_links():
    roots = np.arange(9)
    vd.join_roots(roots, np.array([7, 5, 3]), np.array([8, 6, 4]))
    vd.join_roots(roots, np.array([4, 6]), np.array([5, 7]))
    assert roots.tolist() == [0, 1, 2, 3, 3, 3, 3, 3, 3]


def test_counts_and_forests_agree_with_the_pairs(spark, monkeypatch):
    """Links counted by unit, in blocks of 50 places, against the pairs; what is written does not grow with the links."""
    monkeypatch.setattr(vd, "BLOCK", 50)
    vectors = np.concatenate([spread(300, 0.95), np.random.default_rng(4).normal(size=(300, 64)).astype(np.float32)])
    table = nodes(spark, vectors, 3).withColumn("size", (F.col("node") % 3 + 1).cast("bigint"))
    pairs = [(r["a"], r["b"]) for r in vd.links(table, "node", "label", "embedding", window=16).collect()]
    rows = vd.link_counts(table, "node", "label", "embedding", "size", window=16).collect()
    want, got = Counter(), Counter()
    for a, b in pairs:
        want[a] += b % 3 + 1
        want[b] += a % 3 + 1
    for r in rows:
        got[r["node"]] += r["linked"]
    assert got == want and set(pairs) <= near_of(vectors)
    assert {(min(r["node"], r["other"]), max(r["node"], r["other"])) for r in rows if r["other"] is not None}
    bits, passes = vd.plan(table, "label", "embedding", window=16).first()[2:]
    assert bits >= 1 and len(rows) <= 600 * passes * 14 < len(pairs) * passes


@pytest.mark.parametrize("odd", [None, [], [0.0, 0.0], [1.0, None], [1.0, float("nan")], [float("inf"), 1.0]])
def test_odd_vectors_link_with_nothing(spark, odd):
    rows = [(7, odd, 1), (8, odd, 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [1.0, 0.0], None), (4, [1.0, 0.0], 2), (5, [1.0, 0.0, 0.0], 1)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vd.near_duplicates(table(spark, rows)).collect()}
    assert got == {1: (1, 1, True), 2: (1, 1, False), **{i: (0, i, True) for i in (3, 4, 5, 7, 8)}}


def test_repeated_ids_and_empty_table(spark):
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [0.0, 1.0], 1)]
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in vd.near_duplicates(table(spark, rows)).collect())
    assert got == [("1", 1, 1, True), ("1", 1, 1, True), ("None", 0, None, True)]
    assert vd.near_duplicates(table(spark, rows).limit(0)).count() == 0


def spread(n, mean, seed=3, wide=64):
    """Unit vectors around a centre, with a mean cosine of two of them as given."""
    g = np.random.default_rng(seed)
    centre = g.normal(size=wide)
    rows = centre / np.linalg.norm(centre) + np.sqrt((1 / mean - 1) / wide) * g.normal(size=(n, wide))
    return (rows / np.linalg.norm(rows, axis=1)[:, None]).astype(np.float32)


def nodes(spark, vectors, parts=1):
    return spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(vectors)], "node bigint, embedding array<float>, label int").repartition(parts)


def near_of(vectors):
    x = vectors.astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    return {(i, j) for i, j in zip(*np.nonzero(x @ x.T >= 0.93)) if i < j}


def test_dense_groups_that_are_no_cliques_are_compared_whole(spark):
    """2,000 vectors with cosines spread around the threshold; a window of 64 neighbours finds two thirds of the links."""
    cluster = spread(2000, 0.93)
    other = np.random.default_rng(4).normal(size=(500, 64)).astype(np.float32)
    pairs = [(r["a"], r["b"]) for r in vd.links(nodes(spark, np.concatenate([cluster, other])), "node", "label", "embedding").collect()]
    want = near_of(cluster)
    assert len(pairs) == len(set(pairs)) and set(pairs) <= want and len(pairs) >= 0.998 * len(want) > 500_000


def test_partitions_and_blocks_do_not_change_the_links(spark, monkeypatch):
    """A clique that spans many tasks; sorted ranges lost what lay across their edges."""
    clique = spread(1200, 0.975)
    want = near_of(clique)
    assert len(want) == 1200 * 1199 // 2
    monkeypatch.setattr(vd, "BLOCK", 100)
    before, coalesce = spark.conf.get("spark.sql.shuffle.partitions"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        for parts in (2, 40):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            pairs = [(r["a"], r["b"]) for r in vd.links(nodes(spark, clique, 3), "node", "label", "embedding").collect()]
            assert len(pairs) == len(set(pairs)) and set(pairs) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset(coalesce)


@pytest.mark.parametrize("background", [0.0, 0.7])
def test_recall_of_isolated_pairs_with_a_common_mean(spark, monkeypatch, background):
    """Pairs right above the threshold over a common direction, in passes of several bits (comparing all pairs is made dear)."""
    g = np.random.default_rng(8)
    rows = spread(8000, background, 6).astype(float) if background else g.normal(size=(8000, 64))
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    side = g.normal(size=rows[:1500].shape)
    side -= np.einsum("ij,ij->i", side, rows[:1500])[:, None] * rows[:1500]
    side /= np.linalg.norm(side, axis=1)[:, None]
    vectors = np.concatenate([rows, 0.935 * rows[:1500] + np.sqrt(1 - 0.935**2) * side]).astype(np.float32)
    monkeypatch.setattr(vd, "ROW_COST", 1)
    table = nodes(spark, vectors, 3)
    assert vd.plan(table, "label", "embedding").first()["bits"] >= 3
    pairs = [(r["a"], r["b"]) for r in vd.links(table, "node", "label", "embedding").collect()]
    want = near_of(vectors)
    assert len(pairs) == len(set(pairs)) and set(pairs) <= want and len(pairs) >= 0.997 * len(want) >= 1490


def test_bits_follow_the_measured_buckets(spark, monkeypatch):
    """A group that no bit parts is compared whole at once; one that bits part is not, once it is large."""
    monkeypatch.setattr(vd, "ROW_COST", 1)
    lone = vd.plan(nodes(spark, spread(3000, 0.9999)), "label", "embedding").first()
    apart = vd.plan(nodes(spark, np.random.default_rng(2).normal(size=(3000, 64)).astype(np.float32)), "label", "embedding").first()
    assert (lone["bits"], lone["passes"]) == (0, 1) and apart["bits"] >= 3 and apart["passes"] == vd.passes_at(apart["bits"])
