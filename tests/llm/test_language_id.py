import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchmark.llm import language_id as li
from catchmark.llm import secret_scan


def test_vectors_are_sums_of_bound_trigrams():
    text = "Ab, b"
    v = li.letter_vector
    grams = [(0, 97, 98), (97, 98, 0), (0, 98, 0)]
    want = sum(np.roll(v(a), 2).astype(int) * np.roll(v(b), 1) * v(c) for a, b, c in grams)
    assert (li.text_vectors([text, "", None, "1 2"])[0] == want).all()
    assert not li.text_vectors(["", None, "1 2"]).any()


def test_texts_do_not_mix_in_a_batch():
    texts = ["alpha beta", "", "日本語 text", None, "é", "gamma " * 500]
    alone = np.stack([li.text_vectors([t])[0] for t in texts])
    assert (li.text_vectors(texts) == alone).all()


def test_memory_is_bounded_without_changing_sums(monkeypatch):
    texts = [f"words of text {chr(97 + i)}" for i in range(40)]
    whole = li.text_vectors(texts)
    monkeypatch.setattr(li, "DENSE", 64)
    assert (li.text_vectors(texts) == whole).all()


def test_vectors_of_many_trigrams_are_not_all_floats_at_once():
    text = "".join(np.random.default_rng(3).choice(list("abcdefghijklmnopqrstuvwxyz"), 200_000))
    codes = li.trigrams([text])[0]
    tracemalloc.start()
    li.text_vectors([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(codes) > 17_000 and peak < 4.5 * len(codes) * li.DIMENSIONS


def test_learning_lets_go_of_other_stages_models(docs_of, paths, monkeypatch):
    docs, functions = docs_of(["aa bb"]), []
    real = type(docs).mapInPandas
    monkeypatch.setattr(type(docs), "mapInPandas", lambda self, f, *a, **k: functions.append(f) or real(self, f, *a, **k))
    li.learn(docs)
    secret_scan._vocabulary(paths["ranks"])
    assert list(functions[0](iter([]))) == [] and secret_scan._vocabulary.cache_info().currsize == 0


def test_cases(docs_of):
    texts = ["the cat and the dog", "le chat et le chien", "the dog", None, "", "123 !!", "le chat", "the dog"]
    langs = ["en", "fr", None, "fr", "en", "en", None, None]
    df = docs_of(texts, langs).withColumn("score", F.lit("mine"))
    profiles = li.learn(df)
    assert profiles.languages == ["en", "fr"]
    out = li.predict(df, profiles)
    assert out.columns == [c for c in df.columns if c != "score"] + ["lang_pred", "score"]
    rows = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out.collect()}
    assert [rows[i][0] for i in (2, 3, 4, 5, 6, 7)] == ["en", "und", "und", "und", "fr", "en"]
    assert rows[3][1] == rows[5][1] == 0.0 and rows[2] == rows[7] and all(0 <= s <= 1 for _, s in rows.values())


def test_prototype_is_the_sum_over_all_rows(docs_of):
    texts = ["aa bb", "bb cc", "dd"]
    got = li.learn(docs_of(texts).repartition(3))
    want = li.text_vectors(texts).sum(0)
    assert np.allclose(got.vectors[0], want / np.linalg.norm(want))


def test_empty_table(docs_of):
    none = docs_of(["x"]).limit(0)
    profiles = li.learn(none)
    assert profiles.languages == [] and li.predict(none, profiles).count() == 0
    assert li.predict(docs_of(["some text"]), profiles).first()["lang_pred"] == "und"


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf_dir):
    from catchmark.llm.queries import language

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    said = language(spark, sf_dir).filter("held_out").join(docs, "doc_id")
    right = said.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right >= 0.98
