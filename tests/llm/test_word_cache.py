import numpy as np

from catchmark.llm import word_cache as wc
from catchmark.llm.ngram_join import join_components
from catchmark.llm.token_files import WordTokenizer


def thue_morse(n):
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return ["".join("ab"[b ^ x] for b in bits) for x in (0, 1)]


def test_hashes_tell_thue_morse_words_apart():
    for n in (1024, 2048, 4096):
        words = wc.Words([x.encode() for x in thue_morse(n)])
        assert len(set(words.hashes.tolist())) == 2


def test_hashes_do_not_depend_on_the_place():
    words = wc.Words([b"one two", b"", b"  two\tone two", b"\0two two\0"])
    said = [words.word(i) for i in range(len(words.starts))]
    by_word = dict(zip(said, words.hashes.tolist()))
    assert said == [b"one", b"two", b"two", b"one", b"two", b"\0two", b"two\0"] and words.counts.tolist() == [2, 0, 3, 2]
    assert [by_word[w] for w in said] == words.hashes.tolist() and len(set(by_word.values())) == 4


def test_long_texts_hash_alike(monkeypatch):
    text = " ".join(f"word{i}" for i in range(5000)).encode()
    plain = wc.Words([text]).hashes
    monkeypatch.setattr(wc, "PLAIN_BYTES", 100)
    assert np.array_equal(wc.Words([text]).hashes, plain)


def test_words_that_share_a_hash_keep_their_ids(monkeypatch):
    """All words hash alike: ids still are their own, whether they meet in one batch or in the cache."""
    encode = lambda ws: (np.concatenate([np.frombuffer(w, np.uint8) for w in ws]).astype(np.int32), np.array([len(w) for w in ws]), None)
    make = wc.Words.__init__

    def same(self, *args, **more):
        make(self, *args, **more)
        self.hashes[:] = 7

    monkeypatch.setattr(wc.Words, "__init__", same)
    ids = wc.WordIds(encode)
    for texts in ([b"aa bb"], [b"cc"], [b"dd", b"dd"], [b"cc dd"], [b"cc"], [b"ee cc", b"cc"]):
        flat, n, wrong = ids(wc.Words(texts))
        assert flat.tolist() == [c for t in texts for c in t if c != 32] and n.tolist() == [len(t.replace(b" ", b"")) for t in texts] and not wrong.any()


def test_ids_and_sets_of_thue_morse_texts(docs_of, paths):
    from tokenizers import Tokenizer

    texts, plain = thue_morse(1024), Tokenizer.from_file(paths["words"])
    ids, n = WordTokenizer(paths["words"])(texts)
    want = [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids.tolist() == want[0] + want[1] and n.tolist() == [len(w) for w in want]
    assert [r["component_id"] for r in join_components(docs_of(texts)).orderBy("doc_id").collect()] == [0, 1]
