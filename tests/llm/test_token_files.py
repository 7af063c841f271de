import uuid
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catchmark.llm import token_files as tf
from catchmark.llm.word_cache import WordIds, Words
from catchmark.operators.lineage import shared_folder

ODD = [
    None, "", "  ", "Hello, world!", "it's they'll 'tis x1234y !?' a_b-c. b,.", "<|endoftext|> a <|startoftext|>b", "a\x1cb \x85c d", "é ́x ÀÉ İ ǅ J̌ ﬁ", "日本語 😀 é\n\n\tfoo",
    "Hello, world!", "long " * 30_000,
]


def plain_ids(path, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return [t.encode(x or "", add_special_tokens=False).ids + [1] for x in texts]


def folder(spark):
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 49_407), min_size=1, max_size=3000), st.integers(1, 200))
def test_any_ids_come_back(ids, repeat):
    ids = np.array(ids * (repeat if len(ids) < 300 else 1))
    row = tf.encode_segment(ids)
    assert (tf.decode_segment(row) == ids).all()


def test_blocks_lanes_and_single_spans(monkeypatch):
    monkeypatch.setattr(tf, "BLOCK", 200_000)
    ids = np.random.default_rng(1).zipf(1.3, 450_000) % 5000
    row = tf.encode_segment(ids)
    assert [b["n"] for b in row["blocks"]] == [200_000, 200_000, 50_000] and row["blocks"][0]["lanes"] == tf.LANES
    assert (tf.decode_segment(row) == ids).all()
    symbols, freqs = (np.frombuffer(row[k], "<u4").astype(np.int64) for k in ("symbols", "counts"))
    monkeypatch.setattr(tf, "STEPS", 64)
    block = tf.encode_block(np.searchsorted(symbols, ids[:200_000]), freqs, row["bits"])
    table = np.repeat(np.arange(len(freqs)), freqs)
    wide = 64 * block["lanes"]
    assert (tf.decode_span(block, 2, symbols, freqs, row["bits"], table) == ids[2 * wide : 3 * wide]).all()


def test_a_damaged_block_is_noticed():
    row = tf.encode_segment(np.arange(50_000) % 700)
    words = bytearray(row["blocks"][0]["words"])
    words[100] ^= 1
    row["blocks"][0]["words"] = bytes(words)
    with pytest.raises(ValueError):
        tf.decode_segment(row)


def test_frequencies_fit_however_skewed():
    for ids in (np.zeros(10, int), np.concatenate([np.arange(49_408), np.zeros(5_000_000, int)]), np.arange(40_000)):
        symbols, freqs, bits = tf.frequencies(ids)
        assert freqs.min() >= 1 and freqs.sum() == 1 << bits and len(symbols) == len(set(ids.tolist()))


def test_word_cache_equals_the_library(paths):
    tokenizer = tf.WordTokenizer(paths["words"])
    assert tokenizer.one_piece
    ids, n = tokenizer(ODD)
    want = [x[:-1] for x in plain_ids(paths["words"], ODD)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == want


def test_cache_forgets_and_still_tells_right():
    def encode(words):
        ids = [[len(w), w[0]] if len(w) % 2 else [w[0]] for w in words]
        return np.array([i for x in ids for i in x], np.int32), np.array([len(x) for x in ids]), None

    cache = WordIds(encode, room=3)
    for texts in ([b"a bb ccc"], [b"", b"d e f g ccc", b"a"], [b"a a bb"], [b""]):
        ids, n, _ = cache(Words(texts))
        assert ids.tolist() == [i for t in texts for w in t.split() for i in ([1 * len(w), w[0]] if len(w) % 2 else [w[0]])]
        assert n.tolist() == [sum(2 if len(w) % 2 else 1 for w in t.split()) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=30), min_size=1, max_size=5))
def test_words_are_those_of_split(texts):
    words = Words(texts)
    assert [words.word(i) for i in range(len(words.starts))] == [w for t in texts for w in t.split()]
    assert words.counts.tolist() == [len(t.split()) for t in texts]
    seen = {}
    assert all(seen.setdefault(int(h), words.word(i)) == words.word(i) for i, h in enumerate(words.hashes))


def test_files_come_back_in_order(spark, docs_of, paths):
    ids = [9, 3, 3, None, 100, 5, 6, 7, 8, 1, 0]
    to = folder(spark)
    tf.write(docs_of(ODD, ids=ids), paths["words"], to)
    rows = tf.read(spark, to, with_ids=True).collect()
    each = dict(enumerate(plain_ids(paths["words"], ODD)))
    got = sorted((r["start"], r["doc_id"], r["ids"]) for r in rows)
    assert [g[1] for g in got] == sorted(ids, key=lambda i: (i is not None, i))
    assert sorted(map(str, (g[2] for g in got))) == sorted(map(str, each.values()))
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) and r["ids_crc32"] == crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]


def test_segments_within_a_part(spark, docs_of, prose, paths, monkeypatch):
    texts = [prose(k, 30) for k in range(200)]
    to = folder(spark)
    monkeypatch.setattr(tf, "SEGMENT", 500)
    tf.write(docs_of(texts), paths["words"], to)
    at = 0
    for r, want in zip(sorted(tf.read(spark, to, with_ids=True).collect(), key=lambda r: r["doc_id"]), plain_ids(paths["words"], texts)):
        assert (r["start"], r["ids"]) == (at, want)
        at += len(want)


def test_empty_table(spark, docs_of, paths):
    to = folder(spark)
    tf.write(docs_of(["x"]).limit(0), paths["words"], to)
    assert tf.read(spark, to).count() == 0
