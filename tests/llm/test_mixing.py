import math

from pyspark.sql import functions as F

from catchmark.llm import mixing


def test_steps_are_the_distribution(spark):
    rates = [0.0, 1e-9, 0.3, 1.0, 7.5, 300.0]
    rows = spark.createDataFrame([(x,) for x in rates], "rate double").withColumn("s", mixing.poisson_steps(F.col("rate"))).collect()
    for r in rows:
        lam, c = r["rate"], 0.0
        for k, got in enumerate(r["s"]):
            c += math.exp(-lam + (k * math.log(lam) if lam else 0) - math.lgamma(k + 1)) if lam or not k else 0
            assert abs(got - c) < 1e-9
        assert r["s"][-1] > 1 - 1e-9


def test_draws_follow_the_rates(spark):
    docs = spark.range(60_000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 30 = 1 THEN 'small' ELSE NULL END AS source", "'x' AS copy", "1 AS node")
    out = mixing.replicate(docs, {"hot": 1.0, None: 2.0, "small": 1.0, "absent": 0.0})
    assert out.columns == ["doc_id", "source", "node", "copy", "n_copies", "mix_key"]
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    for source, share in (("hot", 0.25), (None, 0.5), ("small", 0.25)):
        assert abs(n[source] / 60_000 - share) < 0.015
    per = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_copies").alias("m"), F.countDistinct("copy").alias("d"), F.max("copy").alias("top"))
    assert per.filter("n <> m OR d <> n OR top <> n - 1").isEmpty()
    hot = out.filter("source = 'hot' AND copy = 0").groupBy("n_copies").count().collect()
    zero = 20_000 - sum(r["count"] for r in hot)
    assert abs(zero / 20_000 - math.exp(-0.75)) < 0.02


def test_same_draw_however_dealt_and_shuffled(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "'s' AS source")
    a = mixing.replicate(docs).collect()
    b = mixing.replicate(docs.repartition(7).orderBy(F.desc("doc_id"))).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert [r["mix_key"] for r in a] == sorted(r["mix_key"] for r in a) and [r["doc_id"] for r in a] != sorted(r["doc_id"] for r in a)


def test_weights_missing_and_odd_rows(docs_of):
    df = docs_of(["x", None, "", "x"], sources=["a", "a", None, "b"], ids=[1, 1, None, 2])
    out = mixing.replicate(df, {"a": 1.0}, total=400).collect()
    assert {r["source"] for r in out} == {"a"} and sum(r["text"] is None for r in out) == sum(r["text"] == "x" for r in out)
    assert mixing.replicate(df.limit(0)).count() == 0


def test_high_rates_are_not_cut(spark):
    """Rates beyond two thousand and beyond a million copies; the array stays short."""
    docs = spark.range(5).selectExpr("id AS doc_id", "'rare' AS source")
    n = [r["n"] for r in mixing.replicate(docs, total=5 * 2222).groupBy("doc_id").agg(F.count("*").alias("n")).collect()]
    assert len(n) == 5 and all(abs(x - 2222) < 6 * 2222**0.5 for x in n) and len(set(n)) > 1
    rare = spark.createDataFrame([(2.5e6,)], "rate double").select(mixing.poisson_window(F.col("rate")).alias("w")).first()["w"]
    middle = rare["first"] + sum(c <= 0.5 for c in rare["steps"])
    assert abs(middle - 2.5e6) <= 1 and len(rare["steps"]) < 30_000 and abs(rare["steps"][-1] - 1) < 1e-9
    assert mixing.replicate(docs.limit(1), total=1_200_000).count() > 1_190_000
