"""The join against all pairs on small tables: near copies, hot groups, shared passages, odd rows."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from catchmark.llm import ngram_join as nj


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^ \t-\r]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute(ids, texts):
    sets, parent = sets_of(texts), list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            same_id = ids[i] is not None and ids[i] == ids[j] and sets[i] and sets[j]
            if same_id or (common and 100 * common >= 75 * len(sets[i] | sets[j])):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    roots = [find(i) for i in range(len(texts))]
    least = {r: min((ids[i] for i in range(len(ids)) if roots[i] == r and ids[i] is not None), default=None) for r in set(roots)}
    return sorted(((ids[i], len(sets[i]), least[roots[i]]) for i in range(len(ids))), key=str)


def result(df):
    return sorted((tuple(r) for r in nj.join_components(df).collect()), key=str)


def edited(text, share, g):
    words = text.split()
    for i in g.choice(len(words), max(1, int(share * len(words))), replace=False):
        words[i] = "x%d" % g.integers(1e9)
    return " ".join(words)


def corpus(prose):
    g = np.random.default_rng(3)
    texts = []
    for k in range(12):
        base = prose(k, int(g.integers(5, 200)))
        texts += [base, base.upper(), edited(base, 0.02, g), edited(base, 0.05, g), edited(base, 0.2, g)]
    hot = prose(100, 120)
    texts += [hot] * 15 + [edited(hot, 0.01 * (k % 6 + 1), g) for k in range(40)]
    passage = prose(101, 60)
    texts += [f"{passage} {prose(200 + k, 12 + k)}" for k in range(30)] + [f"{prose(300 + k, 100)} {passage}" for k in range(10)]
    return texts + [None, "", " \t\n", "one", "one", "one two", "a b c d", "A b C d", "x y z " * 4000]


def test_equals_all_pairs(docs_of, prose):
    texts = corpus(prose)
    assert result(docs_of(texts)) == brute(list(range(len(texts))), texts)


def test_rounds_and_rest_agree(docs_of, prose, monkeypatch):
    texts = corpus(prose)
    want = brute(list(range(len(texts))), texts)
    for rounds, factor, unfruitful in ((0, 2, 1), (3, 0, 10**9)):
        monkeypatch.setattr(nj, "ROUNDS", rounds)
        monkeypatch.setattr(nj, "REST_FACTOR", factor)
        monkeypatch.setattr(nj, "UNFRUITFUL", unfruitful)
        assert result(docs_of(texts)) == want


def test_repeated_and_null_ids(docs_of, prose):
    a, b = prose(1, 40), prose(2, 40)
    ids, texts = [5, 5, 3, None, 9, 9, None], [a, b, a, b, None, None, "alone"]
    assert result(docs_of(texts, ids=ids)) == brute(ids, texts)


def test_empty_table(docs_of):
    assert result(docs_of(["x"]).limit(0)) == []


def test_one_document_of_a_group_stays(docs_of, prose):
    a = prose(1, 60)
    df = docs_of([a, a + " end", None, prose(2, 60), a, ""])
    kept = nj.keep_representatives(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 5]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aB \t\né\x1c", max_size=40), min_size=1, max_size=6))
def test_sets_are_those_of_the_words(texts):
    assert [len(s) for s in nj.shingle_sets(texts)] == [len(s) for s in sets_of(texts)]
    plain, ids = sets_of(texts), [nj.set_id(s) if len(s) else None for s in nj.shingle_sets(texts)]
    assert all((ids[i] == ids[j]) == (plain[i] == plain[j]) for i in range(len(texts)) for j in range(len(texts)))


def test_one_row_of_a_repeated_id_stays(docs_of, prose):
    texts = [prose(1, 60), prose(1, 60), prose(2, 60), prose(3, 60), None, None]
    df = docs_of(texts, ids=[4, 4, 4, 9, 11, 11])
    kept = nj.keep_representatives(df)
    assert kept.columns == df.columns
    rows = sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["text"] is not None)
    assert [i for i, _ in rows] == [4, 9] and rows[0][1] in texts[:3]
    assert kept.filter("doc_id = 11").count() == 1
    assert sorted(rows) == sorted((r["doc_id"], r["text"]) for r in nj.keep_representatives(df.repartition(5)).collect() if r["text"] is not None)


def test_a_worker_turns_few_texts_at_once_into_sets(docs_of, prose, monkeypatch):
    """A batch of any size is taken in slices, with the sets of the whole."""
    texts = [prose(k, 7) for k in range(600)]
    docs, functions = docs_of(texts).select("doc_id", "text"), []
    real = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, *a, **k: functions.append(f) or real(self, f, *a, **k))
    nj._sized(docs, nj.N, nj.PERCENT)
    sets, taken = nj.shingle_sets, []
    monkeypatch.setattr(nj, "shingle_sets", lambda rows, n: taken.append(len(rows)) or sets(rows, n))
    out = list(functions[0](iter([pa.record_batch([list(range(600)), texts], ["doc_id", "text"])])))
    assert max(taken) <= 250 and sum(taken) == 600
    assert [x for b in out for x in b["node"].to_pylist()] == [nj.set_id(s) for s in sets(texts)] and [x for b in out for x in b["doc_id"].to_pylist()] == list(range(600))
