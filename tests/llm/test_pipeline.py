"""Each stage and the whole pipeline against the plain way on a small table, and the whole on the driver's smallest one."""

from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_ngram_join import brute

import corpus_pipeline as cp
from catchmark.llm import language_id, secret_scan
from catchmark.llm.queries import QUERIES, RANKS, vocabulary


@pytest.fixture(scope="module")
def small(docs_of, prose):
    texts = [prose(k, 60) for k in range(30)]
    texts += [texts[0] + " end", texts[1], "", None, "12 34", "口" * 300, "Avec.", texts[5] + " password=abcdefgh1"]
    return docs_of(texts, sources=["hot"] * 20 + ["cold"] * 18).select("doc_id", "text", "lang", "source", "n_chars")


def test_stages(spark, small):
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "secrets", "mixing", "tokens"] and cp.ORACLE_SQL is None
    docs = cp.language(spark, small, "")
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert docs.columns == small.columns and set(range(38)) - set(kept) == {32, 33, 34}
    one = cp.near_duplicates(spark, docs, "")
    want = {c for _, _, c in brute(list(kept), list(kept.values()))}
    assert {r["doc_id"] for r in one.collect()} == want and one.columns == small.columns
    masked = cp.secrets(spark, one, "")
    assert not any("abcdefgh1" in r["text"] for r in masked.collect()) and masked.count() == len(want)
    mixed = cp.mixed(spark, masked, "")
    assert mixed.columns == small.columns and {r["doc_id"] for r in mixed.collect()} <= want
    last = cp.tokens(spark, mixed, "").collect()
    assert len(last) == mixed.count() and all(r["parity"] and r["round_trip"] for r in last)


def test_rejects_only_what_is_foreign(spark, docs_of, prose):
    docs = docs_of([prose(k, 100) for k in range(20)] + ["口日本語漢字" * 60], langs=["en"] * 20 + [None])
    assert sorted(r["doc_id"] for r in cp.language(spark, docs, "").collect()) == list(range(20))


def test_short_foreign_texts_go_and_short_known_ones_stay(spark, docs_of, prose):
    known = [prose(k, 100) for k in range(20)] + [prose(1, 100)[:n] for n in (2, 5, 12, 30, 60)]
    docs = docs_of(known + ["日本語漢字口" * n for n in (3, 6, 10)], langs=["en"] * 20 + [None] * 8)
    assert sorted(r["doc_id"] for r in cp.language(spark, docs, "").collect()) == list(range(25))


def test_stages_on_an_empty_table_and_with_clashing_columns(spark, docs_of, prose):
    """Columns named like the operators' own come through as they are."""
    extra = ["lang_pred", "score", "spans", "copy", "n_copies", "component_id", "n_shingles", "_row"]
    docs = docs_of([prose(k, 60) for k in range(6)]).withColumns({c: F.concat(F.lit(c), F.col("doc_id")) for c in extra})
    for table, least in ((docs.limit(0), 0), (docs, 6)):
        got = table
        for name, stage in cp.STAGES:
            got = stage(spark, got, "")
            if name != "tokens":
                assert got.columns == docs.columns
                assert all(r[c] == c + str(r["doc_id"]) for r in got.collect() for c in extra)
        assert got.count() >= least and got.columns == [*cp.COLUMNS, "ids", "parity", "round_trip"]


def test_run_on_the_smallest_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    lettered = {i: t for i, t in docs.items() if t and any(map(str.isalpha, t))}
    stay = {c for _, _, c in brute(list(lettered), list(lettered.values()))}
    encoding = secret_scan._vocabulary(vocabulary(RANKS))
    rows = cp.run(spark, sf_dir).collect()
    assert rows and {r["doc_id"] for r in rows} <= stay
    times = Counter(r["doc_id"] for r in rows)
    assert max(times.values()) > 1
    for r in rows:
        text = docs[r["doc_id"]]
        spans = [(a, b) for _, a, b in secret_scan.find_spans(text, encoding)]
        assert r["text"] == secret_scan.mask_text(text, spans, "[SECRET]") and r["n_chars"] == len(r["text"]) and r["round_trip"]


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert language_id.UNDETERMINED == "und"
