import time
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from catchmark.llm import fingerprints as fp


def shingles(text):
    w = re.findall(r"[^ \t-\r]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def sketched(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, text string").withColumn("s", fp.sketch(F.col("text")))


def test_small_sets_are_exact_and_counts_near(spark, prose):
    texts = [None, "", " \n", "one", "One two", prose(1, 60), prose(2, 3000)]
    rows = sketched(spark, texts).withColumn("n", fp.distinct_shingles(F.col("s"))).collect()
    for r in rows:
        true = len(shingles(r["text"]))
        assert len(r["s"]) == min(true, fp.K) and r["s"] == sorted(set(r["s"]))
        assert r["n"] == true if true < fp.K else abs(r["n"] / true - 1) < 0.3


def test_merging_parts_equals_the_whole(spark, prose):
    a, b = prose(1, 900), prose(2, 900)
    rows = sketched(spark, [a, b, "", a]).withColumn("g", F.lit(1))
    whole = sorted({h for r in rows.selectExpr("explode(s) AS h").distinct().collect() for h in r})[: fp.K]
    assert fp.merge_groups(rows, ["g"], "s").first()["s"] == whole


def test_resemblance_and_containment(spark, prose):
    base = prose(1, 2000).split()
    texts = [" ".join(base), " ".join(base[:1000]), " ".join(base[:1600]), prose(9, 400), ""]
    s = sketched(spark, texts)
    pairs = s.crossJoin(s.toDF("j", "other", "t")).withColumns({"r": fp.resemblance(F.col("s"), F.col("t")), "c": fp.containment(F.col("s"), F.col("t"))})
    for r in pairs.collect():
        a, b = shingles(r["text"]), shingles(r["other"])
        assert abs(r["r"] - jaccard(a, b)) < 0.17
        assert abs(r["c"] - (len(a & b) / len(a) if a else 1)) < 0.35
        assert r["i"] != r["j"] or r["r"] == 1


@pytest.mark.parametrize("buckets", [1, 2, 5, 40])
def test_next_document_across_buckets(docs_of, prose, buckets):
    texts = [prose(k, 5 + 9 * k) for k in range(20)] + [None, "", "a", "é😀x", "a", prose(3, 2000)]
    ids = [3 * k - 7 for k in range(len(texts))]
    rows = {r["doc_id"]: r for r in fp.compare_with_next(docs_of(texts, ids=ids).repartition(4), buckets=buckets).collect()}
    assert len(rows) == len(texts)
    for k, i in enumerate(ids):
        text, after = texts[k] or "", texts[(k + 1) % len(texts)] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r["near_edited"] - jaccard(shingles(text), shingles(edited))) < 0.2
        assert abs(r["near_next"] - jaccard(shingles(text), shingles(after))) < 0.2
    assert rows[ids[22]]["fingerprint"] == rows[ids[24]]["fingerprint"]


def test_null_repeated_and_single_ids(docs_of):
    rows = fp.compare_with_next(docs_of(["none has it", "b b", "c c", "d d"], ids=[None, 4, 4, 2]), buckets=3).collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in rows) == [("2", 3), ("4", 3), ("4", 3), ("None", 11)]
    alone = fp.compare_with_next(docs_of(["abcd"]), buckets=3).collect()
    assert [(r["near_next"], r["edited_sha256"]) for r in alone] == [(1.0, hashlib.sha256(b"abab").hexdigest())]


def test_empty_table(docs_of):
    assert fp.compare_with_next(docs_of(["x"]).limit(0), buckets=3).count() == 0


def test_no_python_in_the_plan(docs_of):
    plan = fp.compare_with_next(docs_of(["x"]), buckets=2)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_long_runs_of_blanks(spark):
    """Blanks at the ends and inside, of every kind, in linear time."""
    blank = " \t\n\x0b\x0c\r" * 30_000
    docs = spark.createDataFrame([(blank + "a" + blank + "b" + blank,), (blank,)], "t string")
    start = time.perf_counter()
    assert [r["w"] for r in docs.select(fp.words(F.col("t")).alias("w")).collect()] == [["a", "b"], []]
    assert time.perf_counter() - start < 20
