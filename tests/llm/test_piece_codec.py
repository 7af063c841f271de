from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catchmark.llm import piece_codec as pc

ODD = [None, "", " ", "  a  b ", "x", "<s> hi </s>", "日本語 😀 é\n\n\tfoo", "a   ", "▁x a▁b", "\x00 \x01", "a b  　 c", "word " * 20_000, "x", "Hello, world! 12345"]


@pytest.fixture(scope="module")
def codec(paths):
    return pc.Codec(paths["pieces"])


def test_model_is_read(codec):
    m = codec.model
    assert len(m.pieces) == 32_000 and m.model_type == pc.BPE and m.byte_fallback and codec.alone
    assert m.pieces[:3] == ["<unk>", "<s>", "</s>"] and m.kinds[:3] == [pc.UNKNOWN, pc.CONTROL, pc.CONTROL]


def test_ids_equal_the_other_library(codec):
    ids, n, same = codec.encode(ODD)
    for x, mine, ok in zip(ODD, np.split(ids, np.cumsum(n)[:-1]), same):
        assert mine.tolist() == (codec.other.encode(x) if x else []) and ok
        assert codec.decode(mine) == (x or "").replace("▁", " ")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=25), min_size=1, max_size=4))
def test_any_text(codec, texts):
    ids, n, same = codec.encode(texts)
    for x, mine in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
        assert mine.tolist() == codec.tokenizer.encode(x, add_special_tokens=False).ids * bool(x)
    assert all(same)


def test_a_disagreement_is_told(codec, monkeypatch, paths):
    class Other:
        def encode(self, x, **_):
            return [self.encode(t) for t in x] if isinstance(x, list) else [1]

    own = pc.Codec(paths["pieces"])
    own.other = Other()
    assert not any(own.encode(["some words", "other"])[2])


def test_unigram_models_are_rebuilt():
    model = pc.PieceModel(["<unk>", "<s>", "</s>", "▁", "▁a", "b", "ab", "▁ab"], [0, 0, 0, -3.0, -2.0, -2.5, -2.2, -1.0], [pc.UNKNOWN, pc.CONTROL, pc.CONTROL] + [pc.NORMAL] * 5)
    assert pc.build_tokenizer(model).encode("  ab  ab b ").tokens == ["▁ab", "▁ab", "▁", "b"]
    assert not pc.words_stand_alone(model)


def test_columns_and_round_trip(docs_of, paths):
    df = docs_of(ODD).withColumnRenamed("kind", "ids")
    out = pc.encode(df, paths["pieces"])
    assert out.columns == [c for c in df.columns if c != "ids"] + ["ids"]
    rows = {r["doc_id"]: r for r in out.collect()}
    assert all(r["ids"]["parity"] and r["ids"]["round_trip"] == ("▁" not in (ODD[i] or "")) for i, r in rows.items())
    back = pc.decode(out.select("doc_id", "ids.ids"), paths["pieces"])
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: (x or "").replace("▁", " ") for i, x in enumerate(ODD)}
    told = {r["doc_id"]: r for r in pc.summary(df, paths["pieces"]).collect()}
    for i, r in rows.items():
        assert told[i]["n_tokens"] == len(r["ids"]["ids"]) and told[i]["ids_crc32"] == crc32(np.array(r["ids"]["ids"], "<u4").tobytes())


def test_empty_table(docs_of, paths):
    assert pc.summary(docs_of(["x"]).limit(0), paths["pieces"]).count() == 0
