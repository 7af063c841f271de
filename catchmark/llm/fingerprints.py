"""Document fingerprints: bottom-k sketches of word-shingle hashes, with DataFrame functions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's five-word shingles (words as white space
parts them, lower-cased; fewer than five words are one shingle; no word, no shingle). Sketches of parts merge to the sketch of
all their shingles; they estimate resemblance, containment and the number of distinct shingles.

Cases: a null text counts as empty; two empty sketches resemble each other fully (1), an empty and another one not at all (0);
fewer than k shingles are compared exactly; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WORDS = 128, 5
SPACE = r"[ \t-\r]+"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words(text: Column) -> Column:
    trimmed = F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return once(trimmed, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE)))


def shingle_hashes(of: Column, n: int = WORDS) -> Column:
    """Hashes of all runs of ``n`` words of an array of words, repeats included."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(of) - (n - 1), F.lit(1)))
    return F.when(F.size(of) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(starts, lambda i: F.xxhash64(F.slice(of, i, n))))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K) -> Column:
    return once(words(text), lambda w: bottom(shingle_hashes(w), k))


def merge(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(sketches: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One merged sketch for each group, of any size: each hash is a row, duplicates go first, then the k smallest are kept."""
    hashes = sketches.select(*keys, F.explode(column).alias("_h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))
    kept = hashes.withColumn("_r", rank).filter(F.col("_r") <= k)
    return kept.groupBy(*keys).agg(F.sort_array(F.collect_list("_h")).alias(column))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's bottom k that both hold."""
    both = lambda union: F.size(F.array_intersect(union, F.array_intersect(a, b)))
    return once(merge(a, b, k), lambda u: F.when(F.size(u) == 0, 1.0).otherwise(both(u) / F.size(u)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Number of distinct shingles: exact below k, else (k - 1) over the k-th smallest hash as a share of the range."""
    share = (F.element_at(a, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Share of a's shingles that b has, from resemblance and the two counts."""
    na, nb = distinct_shingles(a, k), distinct_shingles(b, k)
    share = once(resemblance(a, b, k), lambda j: F.least(F.lit(1.0), j * (na + nb) / ((1 + j) * na)))
    return F.when(F.size(a) == 0, 1.0).otherwise(share)


def fingerprint(a: Column) -> Column:
    """The sketch as text, 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


# --- a document and the next one ---------------------------------------------------------------------------------------------


def in_order(docs: DataFrame, doc_id: str, buckets: int) -> tuple[DataFrame, Column]:
    """Rows with a bucket (a range of ids), and with the first rows of each bucket also in the one before (``_halo``), so that a
    window in each bucket sees every row's next one; the last bucket's halo is the first row of all. Null ids come first.

    The driver reads one bound for each bucket and one first id for each, ``buckets`` of either.
    """
    cuts = [i / buckets for i in range(1, buckets)]
    ids = docs.select(F.col(doc_id).cast("bigint").alias("id"))
    bounds = sorted(set((ids.agg(F.percentile_approx("id", cuts, 10_000)).first()[0] if cuts else None) or []))
    key = F.col(doc_id).cast("bigint")
    bucket = lambda c: F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<bigint>"), lambda b: b <= c))
    found = ids.groupBy(bucket(F.col("id")).alias("b")).agg(F.min("id").alias("first"), F.max(F.col("id").isNull()).alias("nulls")).collect()
    firsts = [(r["b"], None if r["nulls"] else r["first"]) for r in sorted(found, key=lambda r: r["b"])]
    places = F.array(F.struct(bucket(key).alias("bucket"), F.lit(False).alias("halo")))
    for k, (_, first) in enumerate(firsts):
        # One entry of a map would do, but a map has no null key: the first row of all may have no id.
        if k == 0:
            wrap = F.array(F.struct(F.lit(firsts[-1][0]).alias("bucket"), F.lit(True).alias("halo")))
            places = F.when(key.eqNullSafe(F.lit(first).cast("bigint")), F.concat(places, wrap)).otherwise(places)
    later = [(first, firsts[k - 1][0]) for k, (_, first) in enumerate(firsts) if k]
    if later:
        before = F.element_at(F.create_map(*[F.lit(x).cast("bigint") if i == 0 else F.lit(x) for pair in later for i, x in enumerate(pair)]), key)
        places = F.when(before.isNotNull(), F.concat(places, F.array(F.struct(before.alias("bucket"), F.lit(True).alias("halo"))))).otherwise(places)
    placed = docs.withColumn("_place", F.explode(places)).withColumns({"_bucket": F.col("_place.bucket"), "_halo": F.col("_place.halo")}).drop("_place")
    order = Window.partitionBy("_bucket").orderBy("_halo", F.col(doc_id).asc_nulls_first(), F.xxhash64("text"))
    return placed, order


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None, k: int = K) -> DataFrame:
    """For each row: doc_id, n_chars, the edited text's digest, both fingerprints, and how alike its fingerprint is to the edited
    text's and to the next document's; distinct_shingles and containment (of the text in its edited form) besides.

    The edited text has the last half of the characters replaced by as many from the start of the next document in order of id
    (after the last: the first). The texts cross the network once, and both windows share that order.
    """
    buckets = buckets or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed, order = in_order(plain, "doc_id", buckets)
    half = F.floor(F.length("text") / 2).cast("int")
    paired = placed.withColumn("_next", F.lead("text").over(order))
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.coalesce("_next", F.lit("")), F.lit(1), half))
    drawn = paired.withColumn("_edited", edited).withColumns({"_a": sketch(F.col("text"), k), "_e": F.when(F.col("_halo"), F.array().cast("array<bigint>")).otherwise(sketch(F.col("_edited"), k))})
    drawn = drawn.withColumns({"_digest": F.sha2("_edited", 256), "n_chars": F.length("text").cast("bigint")})
    slim = drawn.withColumn("_n", F.lead("_a").over(order)).filter(~F.col("_halo"))
    a, e, n = F.col("_a"), F.col("_e"), F.col("_n")
    return slim.select(
        "doc_id", "n_chars", F.col("_digest").alias("edited_sha256"), fingerprint(a).alias("fingerprint"), fingerprint(e).alias("edited_fingerprint"),
        resemblance(a, e, k).alias("near_edited"), resemblance(a, n, k).alias("near_next"), distinct_shingles(a, k).alias("distinct_shingles"), containment(a, e, k).alias("kept_share"),
    )
