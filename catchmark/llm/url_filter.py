"""URL filters: a blocked Bloom filter of listed canonical URLs, then an exact join that removes its false positives.

A list holds entries (host, path, verdict); an entry fits its host and all subdomains where the URL's path starts with the
entry's path, and the longest entry wins (host and path together, then the longer host). A URL is looked up by its keys, every suffix of its host with
every prefix of its path of a length that some entry has. Each Bloom block is one row of 256 bits in eight words; a key sets
and tests one bit in each word of one block, so building is a bit_or by block and probing is one equi-join by block. Keys
that pass go to the exact join. The filter is broadcast only while its blocks number at most BROADCAST_BLOCKS; beyond that
both joins are ordinary shuffle joins, and AQE splits hot blocks.

Cases: a null URL, or one without ``://``, has empty host and path and fits no entry; repeated rows and repeated entries are
allowed (an entry listed both ways blocks); extra columns are kept by ``judge`` and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_ENTRY, BLOCK_BITS = 16, 256
BROADCAST_BLOCKS = 250_000
#: An odd multiplier below 2^31 for each word of a block.
SALTS = (0x47B6137B, 0x44974D91, 0x0824AD5B, 0x22B7289D, 0x705495C7, 0x2DF1424B, 0x1EFC4947, 0x5C6BFB31)
WORDS = [f"w{i}" for i in range(len(SALTS))]


def host_of(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased; empty where there is none."""
    raw = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def _masks(key: Column) -> list[Column]:
    """One bit for each word of the key's block."""
    low = F.xxhash64(key, F.lit(1)).bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))
    bit = lambda salt: F.shiftright((low * F.lit(salt).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), 27)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), bit(s).cast("int")) for s in SALTS]


def bloom_blocks(keys: DataFrame, key: str, n_blocks: int) -> DataFrame:
    """One row for each block that holds an entry: block, w0..w7."""
    marked = keys.select(F.pmod(F.xxhash64(key), F.lit(n_blocks)).alias("block"), *[m.alias(w) for m, w in zip(_masks(F.col(key)), WORDS)])
    return marked.groupBy("block").agg(*[F.bit_or(w).alias(w) for w in WORDS])


def possible(keys: DataFrame, key: str, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """The rows of ``keys`` whose bits are all set in their block: every listed key, and few others."""
    table = F.broadcast(blocks) if n_blocks <= BROADCAST_BLOCKS else blocks
    probe = keys.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n_blocks)))
    hit = None
    joined = probe.join(table, "block")
    for m, w in zip(_masks(F.col(key)), WORDS):
        bit = F.col(w).bitwiseAND(m) != 0
        hit = bit if hit is None else hit & bit
    return joined.filter(hit).drop("block", *WORDS)


def judge(urls: DataFrame, entries: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``urls`` with host, path, rule (the winning entry, host and path) and verdict; unlisted URLs get ``default``.

    Columns of ``urls`` that have one of these four names are replaced. The only values read by the driver are the number of
    entries and the distinct lengths of their paths (no more than the longest path has characters).
    """
    listed = entries.select(F.lower("host").alias("e_host"), F.col("path").alias("e_path"), "verdict").filter("e_host is not null and e_path is not null")
    listed = listed.groupBy("e_host", "e_path").agg(F.max_by("verdict", F.col("verdict") == "block").alias("e_verdict"))
    facts = listed.agg(F.count("*").alias("n"), F.collect_set(F.length("e_path")).alias("lengths")).first()
    n_blocks = max(1, -(-facts["n"] * BITS_PER_ENTRY // BLOCK_BITS))
    listed = listed.withColumn("key", _key(F.col("e_host"), F.col("e_path")))

    plain = urls.drop("host", "path", "rule", "verdict")
    split = plain.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    # Each distinct (host, path) is looked up once, however many rows carry it; the paths are cut to the listed lengths first.
    lengths = sorted(facts["lengths"]) or [0]
    cut = F.substring("path", 1, lengths[-1])
    pairs = split.select("host", cut.alias("head")).filter("host <> ''").distinct()
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array_distinct(F.filter(F.array(*[F.when(F.length("head") >= n, F.substring("head", 1, n)) for n in lengths]), lambda p: p.isNotNull()))
    keys = pairs.select("host", "head", F.explode(suffixes).alias("suffix"), prefixes.alias("prefixes")).select("host", "head", "suffix", F.explode("prefixes").alias("prefix"))
    keys = keys.withColumn("key", _key(F.col("suffix"), F.col("prefix"))).select("host", "head", "key")
    passed = possible(keys, "key", bloom_blocks(listed, "key", n_blocks), n_blocks)
    exact = passed.join(listed, "key")
    longest = F.struct(F.length("e_host") + F.length("e_path"), F.length("e_host"))
    best = exact.groupBy("host", "head").agg(F.max_by(F.struct(F.concat("e_host", "e_path").alias("rule"), "e_verdict"), longest).alias("best"))
    out = split.withColumn("head", cut).join(best, ["host", "head"], "left")
    return out.select(*plain.columns, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.e_verdict", F.lit(default)).alias("verdict"))
