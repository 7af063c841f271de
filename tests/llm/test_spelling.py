import random
import zlib

import pytest

from catchmark.llm import spelling as sp
from oracle_check import rows_of

UPPER = str.maketrans(sp.UPPER, sp.LOWER)


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :])


def brute(counts):
    """Rows of group() by all pairs."""
    forms, rows = {}, []
    for w, n in counts.items():
        others = [v for v in counts if near(w, v)]
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        forms[w] = best if best is not None and counts[best] >= 2 * n else None
        rows.append([w, forms[w], None, n, len(others), counts[best] if forms[w] else None])
    for r in rows:
        at = r[0]
        while forms[at]:
            at = forms[at]
        r[2] = at
    return sorted(map(tuple, rows), key=str)


def got(df):
    return sorted([(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()], key=str)


def edits(rng, word, letters):
    k = rng.randrange(len(word) + 1)
    return rng.choice([word[:k] + rng.choice(letters) + word[k:], word[: max(k - 1, 0)] + word[k:], word[: max(k - 1, 0)] + rng.choice(letters) + word[k:]])


@pytest.mark.parametrize("letters,seed", [("ab", 1), ("abcéñ", 2), ("abcdefghijklmnopqrstuvwxyzßü", 3)])
def test_groups_equal_brute_force(spark, letters, seed):
    rng, counts = random.Random(seed), {}
    for _ in range(25):
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(4, 10)))
        for _ in range(9):
            counts[word] = rng.choice([1, 2, 3, 4, 8, 16, 40])
            word = edits(rng, word, letters)
    counts.pop("", None)
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert got(sp.group(words.repartition(3))) == brute(counts)


def test_signatures_lose_no_pair(spark):
    """Every pair at one edit shares a signature, whatever the place of the edit and however often a letter repeats."""
    rng = random.Random(7)
    counts = {}
    for word in ("aaaaaaaa", "abababab", "zyxwvuts", "éééaaañ", "mnomnomno"):
        counts[word] = 5
        for _ in range(60):
            counts[edits(rng, word, "abéz")] = 5
    pairs = {(r["a"], r["b"]) for r in sp.near_pairs(spark.createDataFrame(list(counts.items()), "word string, n bigint")).collect()}
    want = {frozenset((a, b)) for a in counts for b in counts if near(a, b)}
    assert {frozenset(p) for p in pairs} == want


def test_words_of_whole_texts(docs_of):
    texts = ["Hello, HELLO wörld ÀÉ xyz-abc don't", None, "", "123 _ ×÷", "naïve " * 300 + "tail", "z" * 5000]
    words = sp.noisy_words(docs_of(texts, ids=[10, 11, None, 13, 14, 15]))
    want = {}
    for i, t in zip([10, 11, None, 13, 14, 15], texts):
        run = ""
        for c in (t or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.translate(UPPER)
            elif run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                at = h % len(run)
                w = run[:at] + run[at + 1 :] if h % 97 == 0 else run
                want[w] = want.get(w, 0) + 1
                run = ""
    assert {r["word"]: r["count"] for r in words.groupBy("word").count().collect()} == want


def test_noise_deletes_one_code_point(docs_of, prose):
    texts = [prose(k, 400) for k in range(12)]
    words = sp.noisy_words(docs_of(texts)).collect()
    want = []
    for i, t in enumerate(texts):
        for run in t.split():
            h = zlib.crc32(f"{i}:{run}".encode())
            want.append(run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run)
    assert sorted(r["word"] for r in words) == sorted(want)
    assert want != [r for t in texts for r in t.split()]


def test_ties_chains_and_empty(spark):
    counts = {"abcde": 40, "abcdf": 40, "abcdx": 20, "abcxx": 10, "abxxx": 5, "axxxx": 2, "lonely": 9, "abcdeabcdeabcde" * 40: 3}
    words = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    assert got(sp.group(words)) == brute(counts)
    by = {r["word"]: r for r in sp.group(words).collect()}
    assert by["abcdx"]["form"] == "abcde" and by["axxxx"]["root"] == "abcde"
    assert sp.group(words.limit(0)).count() == 0


def test_whole_operator(spark, docs_of, prose):
    df = docs_of([prose(k, 300) for k in range(30)] + [None, ""])
    counts = {}
    for r in sp.noisy_words(df).collect():
        counts[r["word"]] = counts.get(r["word"], 0) + 1
    kept = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out = sp.variants(df)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and rows_of(out.columns, [tuple(r) for r in out.collect()])
    assert got(out) == brute(kept)
