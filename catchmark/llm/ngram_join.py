"""N-gram Jaccard join with adaptive multi-match prefixes.

A text's set is its distinct five-word shingles as 64-bit hashes (A-Z lower-cased; words as ASCII white space parts them; fewer
words are one shingle). Two texts link when |A & B| / |A | B| is at least the threshold. Two such sets share at least o(n) =
ceil(threshold * n) of the n hashes of either, so under any order that all texts follow, the first n - o + m of each share at
least m: the m-match prefix.

1. Screening. Under the order of the hashes themselves, each text sends its m-match prefix with m a tenth of its size; a text
   stays only if at least m of these hashes come in another set too. What a task holds twice it sends once, so a hash that
   every text has is sent once by each task, and copies of a set never count as another one.
2. Prefixes. For the sets that stay, hashes are ordered by the number of sets that have them. Hashes of one set only come
   first and need not be sent at all. Each set then lengthens its prefix to the m in MATCHES with the least estimated cost,
   from the sum of its hashes' frequencies (rows to read) and that sum over m (candidates to verify); a pair is a candidate when its
   prefixes share the smaller m of the two.
3. Stars. In a round, all sets of a hash's list are paired with one of them only, and each set is held against the CENTRES ones it
   shares most with. These pairs are verified by intersecting the whole sets, links are joined to components, and lists shrink to those that still span several components; each round takes
   another centre. Two sets of one component need no verification, as the result tells components.
   A hash is counted for a pair only where what follows it in both sets can still make up the share they need, so the lists of
   frequent hashes, which come late in most sets, hold few pairs; and not where both sets were measured against one centre and
   that rules their link out.
4. Rest. When no more than REST_FACTOR pairs are left for each row of the lists, or rounds find little more, every pair of a list that
   spans two components is counted, and those that share enough are verified. Nothing is dropped anywhere.

Cases: a null or empty text, or one of white space, has an empty set and links with nothing; texts with equal sets are one
class; ids may repeat (each row is told, and rows with one id are one component); a null id gets the smallest id of its class, or
null; extra columns are not read. A class is known by 64 bits of its set's hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catchmark.llm.components import components
from catchmark.llm.word_cache import Words, pieces_of
from catchmark.operators.lineage import cut
from catchmark.llm.workers import only

N, PERCENT = 5, 75
SCREEN_SHARE = 10
MATCHES = (1, 2, 3, 4, 6, 8, 12, 16)
#: Cost of verifying a candidate, in rows of a list read.
VERIFY_COST = 20.0
ROUNDS, REST_FACTOR = 8, 2
#: Centres that a set is held against in a round; which ones decides only how soon a component is whole.
CENTRES, PARTS = 2, 32
#: Rounds end when one finds fewer than one link in so many rows of the lists.
UNFRUITFUL = 1000
BROADCAST_IDS = 1_000_000
PACKET = 1 << 20
#: Rows whose texts a worker holds as Python strings at once, and characters whose words it takes at once.
ROWS, CHARS = 250, 200_000


# --- sets ----------------------------------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit words over all of them (a public finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None], n: int = N) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words([(x or "").encode("utf-8", "surrogatepass") for x in texts], lower=True)
    total = len(words.hashes)
    h = _mix(words.hashes)
    rolled = np.zeros(max(0, total - n + 1), np.uint64)
    for k in range(n):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(rolled)]
    rolled = _mix(rolled)
    ends = np.cumsum(words.counts)
    out = []
    for stop, count in zip(ends.tolist(), words.counts.tolist()):
        first = stop - count
        if count >= n:
            own = np.sort(rolled[first : stop - n + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif count:
            whole = np.uint64(count)
            for w in h[first:stop]:
                whole = _mix(np.array([whole ^ w], np.uint64))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_id(own: np.ndarray) -> int:
    return int(_mix(np.array([np.add.reduce(_mix(own)) + np.uint64(len(own))], np.uint64)).view(np.int64)[0])


def needed(n, percent: int = PERCENT):
    """ceil(percent * n / 100)"""
    return (percent * n + 99) // 100


def screen_match(n, percent: int = PERCENT):
    """m of the screening prefix"""
    return np.minimum(1 + n // SCREEN_SHARE, needed(n, percent))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows, at most ROWS at once."""
    return (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS))


def _sized(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n, node (id of the set), prefix (48 bits of each hash of the screening prefix)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only()
        for batch in _sliced(batches):
            texts = batch.column(1).to_pylist()
            for a, b in pieces_of([x or "" for x in texts], CHARS):
                sets = shingle_sets(texts[a:b], n)
                sizes = np.array([len(s) for s in sets], np.int64)
                prefixes = []
                for s in sets:
                    k = len(s) - needed(len(s), percent) + int(screen_match(len(s), percent)) if len(s) else 0
                    prefixes.append(np.ascontiguousarray((s[:k] >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes())
                nodes = pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sizes), nodes, pa.array(prefixes, pa.binary())], ["doc_id", "n", "node", "prefix"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, node bigint, prefix binary")


# --- screening -----------------------------------------------------------------------------------------------------------------


def _shared_here(token: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token, node) distinct and in order of token, and whether the token comes with several nodes."""
    order = np.lexsort((node, token))
    token, node = token[order], node[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
    token, node = token[fresh], node[fresh]
    same = token[1:] == token[:-1]
    several = np.zeros(len(token), bool)
    several[1:] |= same
    several[:-1] |= same
    return token, node, several


def _screened(sized: DataFrame, shards: int, percent: int) -> DataFrame:
    """The nodes of which enough prefix hashes come in other sets too."""

    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def packet() -> pa.RecordBatch:
            token, node, several = _shared_here(*(np.concatenate(x) for x in zip(*held)))
            shard = (_mix(token) % np.uint64(shards)).astype(np.int64)
            order = np.lexsort((node, shard))
            rows = []
            edges = np.searchsorted(shard[order], np.arange(shards + 1))
            for k in np.flatnonzero(np.diff(edges)).tolist():
                at = order[edges[k] : edges[k + 1]]
                alone, many = at[~several[at]], at[several[at]]
                nodes, counts = np.unique(node[many], return_counts=True)
                pack = lambda x: np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
                rows.append((k, pack(token[alone]), node[alone].tobytes(), pack(np.unique(token[many])), nodes.tobytes(), counts.astype(np.int32).tobytes()))
            names = ["shard", "token", "node", "many", "sure", "times"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 0 else pa.binary()) for i, c in enumerate(zip(*rows))], names)

        size = 0
        for batch in batches:
            for node, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                token = np.zeros((len(raw) // 6, 8), np.uint8)
                token[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
                held.append((token.view(np.uint64).reshape(-1), np.full(len(token), node, np.int64)))
                size += len(token)
                if size >= PACKET:
                    yield packet()
                    held, size = [], 0
        if held:
            yield packet()

    def count(pdf):
        def unpack(column) -> np.ndarray:
            raw = np.frombuffer(b"".join(pdf[column]), np.uint8).reshape(-1, 6)
            out = np.zeros((len(raw), 8), np.uint8)
            out[:, :6] = raw
            return out.view(np.uint64).reshape(-1)

        # A hash that some task saw in several sets comes with a node that none has.
        many = unpack("many")
        token = np.concatenate([unpack("token"), many, many])
        node = np.concatenate([np.frombuffer(b"".join(pdf["node"]), np.int64), np.zeros(len(many), np.int64), np.ones(len(many), np.int64)])
        real = np.concatenate([np.ones(len(node) - 2 * len(many), bool), np.zeros(2 * len(many), bool)])
        order = np.lexsort((node, token))
        token, node, real = token[order], node[order], real[order]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.empty(0, np.int64)
        sizes = np.diff(np.append(starts, len(token)))
        low, high = (np.minimum.reduceat(node, starts), np.maximum.reduceat(node, starts)) if len(starts) else (starts, starts)
        shared = np.repeat(low != high, sizes) & real
        told = np.concatenate([node[shared], np.frombuffer(b"".join(pdf["sure"]), np.int64)])
        times = np.concatenate([np.ones(int(shared.sum()), np.int64), np.frombuffer(b"".join(pdf["times"]), np.int32)])
        nodes, back = np.unique(told, return_inverse=True)
        return pd.DataFrame({"node": nodes, "hits": np.bincount(back, times, len(nodes)).astype(np.int64)})

    rows = sized.filter("n > 0").select("node", "prefix")
    sent = rows.mapInArrow(packets, "shard int, token binary, node binary, many binary, sure binary, times binary")
    hits = sent.groupBy("shard").applyInPandas(count, "node bigint, hits bigint").groupBy("node").agg(F.sum("hits").alias("hits"))
    sizes = sized.filter("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.min("doc_id").alias("rep"))
    m = F.least(1 + F.floor(F.col("n") / SCREEN_SHARE), F.floor((percent * F.col("n") + 99) / 100))
    return sizes.join(hits, "node").filter(F.col("hits") >= m).select("node", "n", "rep")


# --- prefixes ------------------------------------------------------------------------------------------------------------------


def _whole_sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """node, n, hashes (sorted) of the wanted nodes, from the texts of their representatives."""
    ids = wanted.select(F.col("rep").alias("doc_id")).distinct()
    ids = F.broadcast(ids) if wanted.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    chosen = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            texts = batch.column(0).to_pylist()
            for a, b in pieces_of([x or "" for x in texts], CHARS):
                sets = [s for s in shingle_sets(texts[a:b], n) if len(s)]
                if sets:
                    flat = np.concatenate(sets).view(np.int64)
                    edges = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))], ["node", "n", "hashes"]
                    )

    found = cut(chosen.select("text").mapInArrow(run, "node bigint, n bigint, hashes array<bigint>"), "sets")
    # Repeated rows, and ids with several texts, can bring a set twice or one that isn't wanted.
    only = found.join(wanted.select("node"), "node", "left_semi")
    repeated = not found.groupBy("node").count().filter("count > 1").isEmpty()
    return cut(only.dropDuplicates(["node"]), "sets") if repeated else found


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """node, n, m, unique, token, rest: a row for each hash of each set's chosen prefix that another set has too; ``rest`` hashes
    follow it, ``unique`` ones of the set no other has."""
    tokens = sets.select("node", F.explode("hashes").alias("token"))
    counts = cut(tokens.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1"), "counts")
    shared = tokens.join(counts, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"))
    shared = shared.join(sets.select("node", "n"), "node")
    spare = F.col("n") - F.floor((percent * F.col("n") + 99) / 100)  # n - o
    unique = F.col("n") - F.size("own")
    reach = lambda m: F.least(spare + m - unique, F.size("own")).cast("int")  # noqa: E731  hashes of the m-match prefix that others have
    rows = lambda m: F.aggregate(F.slice("own", 1, reach(m)), F.lit(0.0), lambda a, t: a + t["df"])
    costs = [F.struct((rows(m) * (1 + VERIFY_COST / m)).alias("cost"), F.lit(m).alias("m"), reach(m).alias("reach")) for m in MATCHES]
    # A set with more than n - o hashes of its own links with nothing.
    live = shared.filter(unique <= spare)
    possible = F.filter(F.array(*costs), lambda c: (c["m"] <= F.col("n") - spare) & (c["reach"] >= c["m"]))
    chosen = live.withColumn("best", F.array_min(possible)).filter("best is not null")
    rows = chosen.select("node", "n", F.col("best.m").alias("m"), unique.alias("unique"), F.posexplode(F.slice("own", 1, F.col("best.reach"))).alias("at", "t"))
    return rows.select("node", "n", "m", "unique", F.col("t.token").alias("token"), (F.col("n") - F.col("unique") - F.col("at") - 1).alias("rest"))


# --- candidates ----------------------------------------------------------------------------------------------------------------


def _fits(a: str, b: str, percent: int) -> Column:
    """Are the sizes near enough?"""
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def _meets(percent: int) -> Column:
    """Can this shared hash be among the first m that two linked sets share? They must share percent / (100 + percent) of the sum of
    their sizes: those m and what follows the hash in both at most, and never more than the hashes of each that others have."""
    most = F.least(F.least("m", "mb") + F.least("rest", "rb"), F.col("n") - F.col("unique"), F.col("nb") - F.col("ub"))
    # By a set that both were measured against: what both share with it, part by part, and what others have but not it.
    within = F.aggregate(F.zip_with("parts", "pp", lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x)
    by_pivot = within + F.least(F.col("n") - F.col("o") - F.col("unique"), F.col("nb") - F.col("ob") - F.col("ub"))
    enough = lambda shared: (100 + percent) * shared >= percent * (F.col("n") + F.col("nb"))
    return enough(most) & F.when(F.col("pivot") == F.col("pb"), enough(by_pivot)).otherwise(True)


def _leads(percent: int) -> Column:
    """Can a hash of a set be among the first that it shares with a set of its size or larger?"""
    return (100 + percent) * F.least(F.col("m") + F.col("rest"), F.col("n") - F.col("unique")) >= 2 * percent * F.col("n")


def _parts(hashes: str) -> Column:
    """How many of the hashes fall in each of PARTS parts of all hashes."""
    part = lambda k: F.size(F.filter(hashes, lambda h: F.pmod(h, F.lit(PARTS).cast("bigint")) == k))
    return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), part)


def _measured(pairs: DataFrame, sets: DataFrame, percent: int, parted: bool = False) -> DataFrame:
    """a, b, linked (by the whole sets); if asked for, how many hashes they share and b has, by part."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").withColumn("both", F.array_intersect("x", "y"))
    common = F.size("both")
    linked = 100 * common >= percent * (F.size("x") + F.size("y") - common)
    more = [_parts("both").alias("common"), _parts("y").alias("own")] if parted else []
    return cut(both.select("a", "b", linked.alias("linked"), *more), "measured")


def _with_pivots(lists: DataFrame, measured: DataFrame) -> DataFrame:
    """The lists with, for each set, the centre that most sets were measured against (it may be the set itself), and what they share."""
    drawn = measured.groupBy("b").agg(F.count("*").alias("pull"))
    own = measured.groupBy("b").agg(F.first("own").alias("parts")).select(F.col("b").alias("node"), "b", "parts")
    either = cut(own.unionAll(measured.select(F.col("a").alias("node"), "b", F.col("common").alias("parts"))), "pulls")
    best = either.join(cut(drawn, "drawn"), "b").groupBy("node").agg(F.max_by(F.struct("b", "parts"), F.struct("pull", "b")).alias("p"))
    total = F.aggregate("parts", F.lit(0), lambda a, x: a + x).cast("bigint")
    joined = lists.drop("pivot", "o", "parts").join(cut(best, "pivots"), "node", "left")
    return joined.withColumns({"pivot": F.col("p.b"), "parts": F.col("p.parts")}).withColumn("o", total).drop("p")


def _spanning(lists: DataFrame) -> DataFrame:
    """Rows of the lists (token, node, n, m, rest, leads, group) whose list spans several groups, and has a row that leads."""
    spans = lists.groupBy("token").agg(F.min("group").alias("lo"), F.max("group").alias("hi"), F.max("leads").alias("leads")).filter("lo <> hi AND leads").select("token")
    return lists.join(cut(spans, "spans"), "token", "left_semi")


def _grouped(lists: DataFrame, links: DataFrame) -> DataFrame:
    """The lists with each node's component so far."""
    labels = components(links)
    return lists.drop("group").join(labels, "node", "left").withColumn("group", F.coalesce("label", "node")).drop("label")


def _candidate(pairs: DataFrame) -> DataFrame:
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("m").alias("m"))
    return counted.filter("shared >= m").select("a", "b")


def link_sets(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) of nodes that connect each component of the sets that link."""
    lists = cut(_prefixes(sets, percent).withColumns({"group": F.col("node"), "leads": _leads(percent), "pivot": F.lit(None).cast("bigint"), "o": F.lit(None).cast("bigint"), "parts": F.lit(None).cast("array<int>")}), "lists")
    links = None
    for turn in range(ROUNDS):
        lists = cut(_spanning(lists), "lists")
        each = lists.groupBy("token", "group").agg(F.count("*").alias("n"), F.count_if("leads").alias("k")).groupBy("token")
        facts = each.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.sum(F.col("n") * F.col("k")).alias("own"))
        left = facts.agg(F.sum(F.col("n") * F.col("k") - F.col("own")).alias("pairs"), F.sum("n").alias("rows")).first()
        if not left["rows"] or left["pairs"] <= REST_FACTOR * left["rows"]:
            break
        # A set of which others have nearly all hashes is the likeliest to link with them; ties and later rounds go by a hash.
        own = F.floor((F.col("unique") / F.col("n") + turn / 50 * F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(100)) / 100) * 50)
        order = F.struct(own, F.xxhash64(F.lit(turn), "group"), "node", "n", "m", "rest", "unique", "group", "pivot", "o", "parts")
        centre = {"b": "node", "nb": "n", "mb": "m", "rb": "rest", "ub": "unique", "gb": "group", "pb": "pivot", "ob": "o", "pp": "parts"}
        centres = lists.filter("leads").groupBy("token").agg(F.min(order).alias("c")).select("token", *[F.col(f"c.{c}").alias(k) for k, c in centre.items()])
        star = lists.join(cut(centres, "centres"), "token").filter((F.col("group") != F.col("gb")) & _fits("n", "nb", percent) & _meets(percent))
        shared = star.groupBy(F.col("node").alias("a"), "b").agg(F.count("*").alias("shared"))
        best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("shared"), "b"))
        pairs = shared.withColumn("_r", best).filter(F.col("_r") <= CENTRES).select("a", "b")
        measured = _measured(cut(pairs, "stars"), sets, percent, not turn)
        found = measured.filter("linked").select("a", "b")
        links = found if links is None else links.unionAll(found)
        lists = cut(_grouped(lists if turn else _with_pivots(lists, measured), links), "lists")
        if found.count() * UNFRUITFUL < left["rows"]:
            break
    lists = cut(_spanning(lists), "lists")
    # The smaller set of a pair (or the one with the smaller id) leads.
    other = lists.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("m").alias("mb"), F.col("rest").alias("rb"), F.col("unique").alias("ub"), F.col("group").alias("gb"), F.col("pivot").alias("pb"), F.col("o").alias("ob"), F.col("parts").alias("pp"))
    first = (F.col("n") < F.col("nb")) | ((F.col("n") == F.col("nb")) & (F.col("node") < F.col("b")))
    rest = lists.filter("leads").join(other, "token").filter(first & (F.col("group") != F.col("gb")) & _fits("n", "nb", percent) & _meets(percent))
    pairs = _candidate(rest.select(F.col("node").alias("a"), "b", F.least("m", "mb").alias("m")))
    found = _measured(cut(pairs, "rest"), sets, percent).filter("linked").select("a", "b")
    return found if links is None else links.unionAll(found)


def join_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of the document's component) of every row."""
    plain = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    sized = cut(_sized(plain, n, percent), "sized")
    shards = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = cut(_screened(sized, shards, percent), "wanted")
    links = link_sets(_whole_sets(plain, wanted, n), percent)
    members = sized.select("doc_id", "n", "node")
    # Rows that share an id are one component, whatever their texts.
    ids = members.filter("node is not null and doc_id is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b")
    labels = cut(components(links.unionAll(ids.select("a", "b"))), "labels")
    classes = members.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep")).join(labels, "node", "left").withColumn("group", F.coalesce("label", "node"))
    classes = cut(classes.select("node", "rep", "group"), "classes")
    firsts = cut(classes.groupBy("group").agg(F.min("rep").alias("component_id")), "firsts")
    named = cut(classes.join(firsts, "group").select("node", "component_id"), "named")
    out = members.join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document (the smallest id) of each component; all columns stay. Of rows that share that id the one with the
    smallest hash stays. Rows with a null id stay, as nothing tells which of them a component means."""
    found = join_components(docs, doc_id, text)
    gone = found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    gone = cut(gone, "gone")
    gone = F.broadcast(gone) if gone.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else gone
    kept = docs.join(gone, docs[doc_id] == gone["_gone"], "left_anti")
    ids = docs.select(F.col(doc_id).alias("_twice")).filter("_twice is not null")
    twice = cut(ids.groupBy("_twice").agg(F.count("*").alias("_n")).filter("_n > 1").select("_twice"), "twice")
    n = twice.limit(BROADCAST_IDS + 1).count()
    if not n:
        return kept
    twice = F.broadcast(twice) if n <= BROADCAST_IDS else twice
    row = F.struct(*[kept[c] for c in docs.columns])
    single = kept.join(twice, kept[doc_id] == twice["_twice"], "left_semi").groupBy(F.col(doc_id).alias("_id")).agg(F.min_by(row, F.xxhash64(*docs.columns)).alias("_row"))
    return kept.join(twice, kept[doc_id] == twice["_twice"], "left_anti").unionByName(single.select("_row.*"))
