"""Grouping of spelling variants: words one edit apart, found by PartEnum signatures of their letter multisets.

A word's letters are a set of (letter, how many of it came before in sorted order), so words at one edit differ in at most two elements: in one if
their lengths differ, in two if a letter is replaced. The elements are dealt to PARTS parts by a fixed rule. Two sets that differ
in at most k elements agree exactly on some PARTS - k of the parts, so a word gets a signature for each such choice of parts, a
hash of what the word has there: for words as long, k = 2, and for a word and one a letter longer, k = 1. An edit also leaves the first
half of the shorter word or its last half as it is, so each signature is made twice, with either half added; this keeps the buckets
of common letters small and loses no pair. Signatures are equi-joined and every pair that meets is verified by its edit distance, so hashes
and parts never change the result, and none of it caps a bucket. All word forms, counts and links are rows of tables; nothing is gathered.

Cases: a null text has no words, a null id stands as empty in the noise's key; repeated rows count as often as they are there; texts and words of any length
are taken whole; an empty table gives an empty result; extra columns aren't read. Ties of the largest count go to the smallest word by code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchmark.operators.lineage import cut

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Parts of the elements for words as long (two elements differ) and for words of which one is a letter longer (one differs).
PARTS_SAME, PARTS_LONGER = 4, 2
LEAST_CHARS, LEAST_COUNT, NOISE, RATIO = 5, 3, 97, 2


def noisy_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", noise: int = NOISE) -> DataFrame:
    """word: every maximal run of letters of every text, A-Z lower-cased; about one run in ``noise`` has lost a code point, by its crc32 with the id."""
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    return runs.withColumn("h", h).select(F.when(F.col("h") % noise == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    counted = words.filter(F.char_length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least_count)


def _mixed(a: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mix of each number."""
    a = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    a = (a ^ (a >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return a ^ (a >> np.uint64(31))


def part_sums(words: list[str], parts: int) -> np.ndarray:
    """For each word and part, the sum of hashes of the word's elements there: equal where the elements are equal."""
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    owner = np.repeat(np.arange(len(words)), sizes)
    order = np.lexsort((codes, owner))
    letter = codes[order]  # owners stay where they are
    new = np.ones(len(letter), bool)
    new[1:] = (letter[1:] != letter[:-1]) | (owner[1:] != owner[:-1])
    place = np.arange(len(letter))
    nth = place - np.maximum.accumulate(np.where(new, place, 0))
    cell = owner * parts + (letter + 3 * nth) % parts
    hashes = _mixed((letter.astype(np.uint64) << np.uint64(32)) + nth.astype(np.uint64) + np.uint64(1))
    out = np.zeros(len(words) * parts, np.uint64)
    np.add.at(out, cell, hashes)
    return out.reshape(len(words), parts)


def choices(parts: int, differ: int) -> list[tuple[int, ...]]:
    """Which parts may be the ones that agree when ``differ`` elements differ."""
    return list(combinations(range(parts), parts - differ))


def signatures(words: DataFrame) -> DataFrame:
    """word, n, chars and two lists of hashes: ``same`` (two elements may differ) and ``longer`` (one may)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, columns = batch.column(0).to_pylist(), []
            for parts, differ in ((PARTS_SAME, 2), (PARTS_LONGER, 1)):
                sums, own = part_sums(texts, parts), []
                for k, choice in enumerate(choices(parts, differ)):
                    key = np.full(len(texts), k + 1, np.uint64)
                    for p in choice:
                        key = _mixed(key ^ _mixed(sums[:, p] + np.uint64(p)))
                    own.append(key.view(np.int64))
                flat = np.column_stack(own)
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.reshape(-1))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["word", "n", "chars", "same", "longer"])

    rows = words.select("word", "n", F.char_length("word").alias("chars"))
    return rows.mapInArrow(made, "word string, n bigint, chars int, same array<bigint>, longer array<bigint>")


def _keyed(signed: DataFrame, roles: list[tuple[str, Column, str]]) -> DataFrame:
    """word, n and the key of each signature of each role: (kind, length of the shorter word of a pair, list of hashes)."""
    sides = []
    for kind, least, hashes in roles:
        front, back = F.floor(least / 2).cast("int"), F.ceil(least / 2).cast("int")
        halves = F.array(F.xxhash64(F.lit("front"), F.substring("word", F.lit(1), front)), F.xxhash64(F.lit("back"), F.substring("word", F.col("chars") - back + 1, back)))
        each = F.transform(F.col(hashes), lambda s: F.transform(halves, lambda half: F.xxhash64(F.lit(kind), least, s, half)))  # noqa: B023
        sides.append(F.flatten(each))
    return signed.select("word", "n", F.explode(F.concat(*sides)).alias("key"))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b of the pairs of words (word, n) one inserted, deleted or replaced code point apart; a pair comes as often as its words share a signature."""
    signed = cut(signatures(words), "signatures")
    chars = F.col("chars")
    # a pair as long meets in "same" with the smaller word on the left; the shorter of another pair is on the left
    left = _keyed(signed, [("same", chars, "same"), ("longer", chars, "longer")]).toDF("a", "n_a", "key")
    right = _keyed(signed, [("same", chars, "same"), ("longer", chars - 1, "longer")]).toDF("b", "n_b", "key")
    ordered = (F.char_length("a") < F.char_length("b")) | ((F.char_length("a") == F.char_length("b")) & (F.col("a") < F.col("b")))
    return left.join(right, "key").filter(ordered & (F.levenshtein("a", "b", 1) == 1)).select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form): the last word of each chain of forms, by doubling; chains have no cycle, as counts grow along them."""
    ends = cut(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = cut(ends.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.filter("moved").isEmpty():
            return ends
        ends = moved.select("word", "root")


def group(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of (word, n)."""
    words = cut(words.select("word", "n"), "vocabulary")
    pairs = near_pairs(words)
    one = lambda w, other, n: F.struct(F.col(w).alias("word"), F.col(other).alias("other"), F.col(n).alias("other_n"))
    both = pairs.select(F.explode(F.array(one("a", "b", "n_b"), one("b", "a", "n_a"))).alias("x")).select("x.*")
    # one shuffle by word serves both groupings; a word has at most some hundreds of near words for each of its letters
    distinct = both.repartition("word").groupBy("word", "other").agg(F.first("other_n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best")
    near = distinct.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    chosen = words.join(near, "word", "left").withColumn("fits", -F.col("best.less") >= F.col("n") * ratio)
    told = cut(
        chosen.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("fits"), F.col("best.other")).alias("form"), F.when(F.col("fits"), -F.col("best.less")).alias("form_n")),
        "forms",
    )
    ends = roots(told.filter("form is not null").select("word", "form"))
    out = told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    return out


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of whole texts with their forms and roots."""
    return group(vocabulary(noisy_words(docs, doc_id, text)))


def variants_sql() -> str:
    """The same from documents in plain SQL: near words are those that agree after one deletion, the CRC is taken byte by byte from a table made by its rule."""
    return f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
run AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
kept AS (SELECT doc_id, run, count(*) AS c FROM run GROUP BY ALL),
bytes AS (SELECT doc_id, run, c, flatten(list_transform(string_split(coalesce(cast(doc_id AS varchar), '') || ':' || run, ''),
        lambda x: CASE WHEN unicode(x) < 128 THEN [cast(unicode(x) AS bigint)] ELSE [cast(192 + (unicode(x) >> 6) AS bigint), cast(128 + (unicode(x) & 63) AS bigint)] END)) AS b FROM kept),
hashed AS (SELECT run, c, xor(list_reduce(list_concat([4294967295], b), lambda h, x: xor(h >> 8, t[1 + (xor(h, x) & 255)])), 4294967295) AS h FROM bytes, crc),
noisy AS (SELECT CASE WHEN h % {NOISE} = 0 THEN substring(run, 1, cast(h % length(run) AS bigint)) || substring(run, cast(h % length(run) AS bigint) + 2) ELSE run END AS word, c FROM hashed),
v AS MATERIALIZED (SELECT word, cast(sum(c) AS bigint) AS n FROM noisy WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(c) >= {LEAST_COUNT}),
gone AS MATERIALIZED (SELECT word, n, i, length(word) AS l, substring(word, 1, i) || substring(word, i + 2) AS less FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v) AS s),
pair AS (SELECT a.word AS a, b.word AS b, b.n AS n_b FROM gone AS a JOIN gone AS b ON a.less = b.less AND a.i = b.i AND a.l = b.l AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM gone AS a JOIN v AS b ON a.less = b.word UNION SELECT b.word, a.word, a.n FROM gone AS a JOIN v AS b ON a.less = b.word),
near AS (SELECT a AS word, count(*) AS n_near, min(struct_pack(less := -n_b, other := b)) AS best FROM pair GROUP BY a),
told AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= {RATIO} * v.n THEN best.other END AS form, CASE WHEN -best.less >= {RATIO} * v.n THEN -best.less END AS form_n
    FROM v LEFT JOIN near ON v.word = near.word),
walk AS (SELECT word, coalesce(form, word) AS at FROM told UNION SELECT walk.word, told.form FROM walk JOIN told ON walk.at = told.word WHERE told.form IS NOT NULL),
ends AS (SELECT walk.word, walk.at AS root FROM walk JOIN told ON walk.at = told.word WHERE told.form IS NULL)
SELECT told.word, form, root, n, n_near, form_n FROM told JOIN ends ON told.word = ends.word"""
