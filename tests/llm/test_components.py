import numpy as np

from catchmark.llm.components import components


def check(spark, pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    rows = components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert len(rows) == len({r["node"] for r in rows}) and {r["node"] for r in rows} == set(parent)
    label = {r["node"]: r["label"] for r in rows}
    assert all((label[x] == label[y]) == (find(x) == find(y)) for x in label for y in label)


def test_chain_star_and_random(spark):
    g = np.random.default_rng(5)
    chain = g.permutation(60)
    pairs = [(int(chain[i]), int(chain[i + 1])) for i in range(59)]
    pairs += [(1000, 1001 + i) for i in range(40)] + [(2000 + int(a), 2000 + int(b)) for a, b in g.integers(0, 80, (60, 2))]
    check(spark, pairs + [(5, 5), (None, 3), (3, None)])


def test_nothing(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
