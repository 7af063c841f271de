import numpy as np
import pytest

from catchmark.llm import whitening as wh

SCHEMA = "vec_id bigint, embedding array<double>, component int, n string, rows int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, "n", 2) for i, v in rows], SCHEMA)


def brute(rows):
    """By the whole covariance, with Python integers where results are exact: {vec_id: (n, deviation, whitened)}, explained."""
    whole = {i: [int(np.floor(64 * x)) + 1_000_000 for x in v] for i, v in rows}
    fit = sorted({tuple(x) for x in whole.values()})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = lambda x: np.array([(n * a - s) / n for a, s in zip(x, sums)])
    c = np.array([centred(x) for x in fit])
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:16], u[:, ::-1][:, :16]
    return {i: (n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), centred(x) @ u / np.sqrt(e)) for i, x in whole.items()}, e / np.trace(v)


def check(rows, got):
    want, explained = brute(rows)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert by.keys() == want.keys()
    signs = None
    for i, parts in by.items():
        n, deviation, white = want[i]
        assert sorted(parts) == list(range(1, len(white) + 1))
        own = np.array([parts[k + 1]["whitened"] for k in range(len(white))])
        if signs is None:
            signs = np.sign(own * white)
        assert np.allclose(own, signs * white, atol=1e-8)
        assert all((p["n"], p["deviation"]) == (n, deviation) and p["identity_error"] < 1e-9 for p in parts.values())
        assert np.allclose([parts[k + 1]["explained"] for k in range(len(white))], explained, rtol=1e-9)


@pytest.mark.parametrize("wide,shape", [(20, "flat"), (64, "flat"), (96, "falling")])
def test_same_as_the_whole_covariance(spark, wide, shape):
    g = np.random.default_rng(wide)
    scale = np.ones(wide) if shape == "flat" else 0.93 ** np.arange(wide)
    rows = [(i, 30 + 2 * g.standard_normal(wide) * scale) for i in range(700)]
    rows += [(1000 + i, rows[i][1]) for i in range(300)]  # copies count once
    check(rows, wh.whiten(table(spark, rows).repartition(7)).collect())


def test_passes_go_on_until_certified(spark):
    g = np.random.default_rng(3)
    rows = [(i, g.standard_normal(60) * 0.97 ** np.arange(60)) for i in range(400)]
    blocks = wh.pack(table(spark, rows), "embedding")
    centre = wh.centres(blocks)[60]
    values, q, trace = wh.components_of(blocks, centre)
    assert np.abs(wh.multiply(blocks, centre, q) - q * values).max() < 1e-12 * values[0]
    assert np.abs(q.T @ q - np.eye(16)).max() < 1e-12 and (np.diff(values) <= 0).all()
    assert sum(values) < trace


def test_not_certified_raises(spark, monkeypatch):
    monkeypatch.setattr(wh, "MAX_PASSES", 1)
    g = np.random.default_rng(3)
    with pytest.raises(RuntimeError, match="not certified"):
        wh.fit(table(spark, [(i, g.standard_normal(64)) for i in range(300)]))


def test_lower_bound_holds():
    g = np.random.default_rng(5)
    a = g.standard_normal((200, 80))
    v = a.T @ a / 200 + 3 * np.eye(80)
    floor = wh.Floor(80, g)
    for _ in range(12):
        floor.step(v @ floor.basis[-1])
    least = np.linalg.eigvalsh(v)[0]
    assert 0 <= floor.bound() <= least * (1 + 1e-9) and floor.bound() > 0.5 * least


def test_partial_sums_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(wh, "FAN", 2)
    monkeypatch.setattr(wh, "BLOCK_ROWS", 8)
    g = np.random.default_rng(4)
    rows = [(i, g.standard_normal(6)) for i in range(200)]
    blocks = wh.pack(table(spark, rows), "embedding").repartition(9)
    centre = wh.centres(blocks)[6]
    x = np.array([np.floor(64 * v) for _, v in rows])
    c = x - x.mean(0)
    assert centre.n == 200 and np.allclose(wh.multiply(blocks, centre, np.eye(6)), c.T @ c / 200)


def test_cases(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [1, None, 2]), (3, [1, nan, 2]), (4, [1, inf, 2]), (5, [-inf, 0, 0])]
    flat = [(6, []), (7, []), (8, [3, 3]), (9, [3, 3])]  # no component, no variance
    three = [(10, [1, 2, 3]), (11, [2, 2, 3]), (12, [3, 1, 3]), (None, [3, 1, 3])]  # the last entry is constant
    got = wh.whiten(table(spark, bad + flat + three)).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in got) == [(i, c, 3) for i in (0, 10, 11, 12) for c in (1, 2)]
    assert wh.whiten(table(spark, [])).count() == 0 and wh.whiten(table(spark, bad)).count() == 0
    two = [(1, [1, 2]), (2, [2, 5]), (3, [1, 2, 3]), (4, [4, 2, 3]), (5, [9, 1, 3])]  # two lengths, two fits
    assert {r["vec_id"]: r["n"] for r in wh.whiten(table(spark, two)).collect()} == {1: 2, 2: 2, 3: 3, 4: 3, 5: 3}


def test_large_entries(spark):
    rows = [(1, [1e300, 0]), (2, [2e13, 1]), (3, [-2e13, 2])]
    got = {r["vec_id"]: r["deviation"] for r in wh.whiten(table(spark, rows)).collect()}
    assert got == {1: None, 2: None, 3: None}
    near = [(k, [2.0**38 + k / 64, 0]) for k in (1, 2, 6)]
    got = {r["vec_id"]: r["deviation"] for r in wh.whiten(table(spark, near)).collect()}
    assert got == {1: 36, 2: 9, 6: 81}
