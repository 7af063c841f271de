"""Token ids in files, compressed with a static range asymmetric numeral system (rANS).

Texts are sorted by id across executors and encoded where they lie. A task fills segments of about SEGMENT ids (documents stay
whole); a segment has one table of symbol frequencies, counted over all its ids, that its blocks share. A block is coded on its
own in up to LANES interleaved states, with a checkpoint (all states, place in the stream) and a checksum for every STEPS steps, so
that any span of any block can be decoded alone. Segments are rows of a Parquet folder: part (order of the range of ids), seq
(order within it), docs and lengths, table, blocks. Reading gives the ids back with each document's place in the whole.

Cases: a null text has no ids but the end id; a null doc_id sorts first; repeated ids keep one entry for each row; an empty
table gives an empty folder, read back as no rows. Extra columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catchmark.llm.word_cache import WordIds, Words, pieces_of

SEGMENT, BLOCK, LANES, STEPS = 1 << 22, 1 << 19, 1024, 256
LOW = 1 << 31
FILE_SCHEMA = (
    "part int, seq int, docs array<bigint>, lengths array<int>, n_tokens bigint, symbols binary, counts binary, bits int, "
    "blocks array<struct<n: int, lanes: int, words: binary, states: binary, places: array<int>, crcs: array<bigint>>>"
)
END_ID, JOINED = 1, 200
#: The splitter of the public CLIP-style vocabulary files (fixed value).
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


# --- coder ---------------------------------------------------------------------------------------------------------


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbols in order, their frequencies, bits): the frequencies are at least 1 and sum to 2^bits."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    bits = max(12, int(len(symbols)).bit_length() + 3)
    exact = counts * (float(1 << bits) / max(1, counts.sum()))
    freqs = np.maximum(1, np.floor(exact)).astype(np.int64)
    short = (1 << bits) - int(freqs.sum())
    if short > 0:
        freqs[np.argmax(freqs)] += short
    while short < 0:
        spare = np.flatnonzero(freqs > 1)
        spare = spare[np.argsort(-freqs[spare], kind="stable")]
        take = np.minimum(freqs[spare] - 1, np.maximum(1, freqs[spare] // 64))
        take = take[: int(np.searchsorted(np.cumsum(take), -short)) + 1]
        take[-1] -= max(0, int(take.sum()) + short)
        freqs[spare[: len(take)]] -= take
        short = (1 << bits) - int(freqs.sum())
    return symbols, freqs, bits


def encode_block(index: np.ndarray, freqs: np.ndarray, bits: int) -> dict:
    """One block of indexes into the table of symbols."""
    n = len(index)
    lanes = LANES if n >= 64 * LANES else max(1, n // 64)
    steps = -(-n // lanes)
    padded = np.full(steps * lanes, int(np.argmax(freqs)), np.int64)
    padded[:n] = index
    grid = padded.reshape(steps, lanes)
    f, shift = freqs.astype(np.uint64), np.uint64(bits)
    start = (np.cumsum(freqs) - freqs).astype(np.uint64)
    most = f << np.uint64(63 - bits)
    state = np.full(lanes, LOW, np.uint64)
    words, states = [], []
    for t in range(steps - 1, -1, -1):
        s = grid[t]
        full = state >= most[s]
        words.append((state[full] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        state = np.where(full, state >> np.uint64(32), state)
        q, r = np.divmod(state, f[s])
        state = (q << shift) + r + start[s]
        if t % STEPS == 0:
            states.append(state)
    sizes = np.array([len(w) for w in words[::-1]])
    before = np.concatenate([[0], np.cumsum(sizes)])
    return {
        "n": n, "lanes": lanes, "words": np.concatenate(words[::-1]).tobytes(), "states": np.stack(states[::-1]).astype("<u8").tobytes(),
        "places": [int(before[t]) for t in range(0, steps, STEPS)],
    }


def decode_span(block: dict, k: int, symbols: np.ndarray, freqs: np.ndarray, bits: int, table: np.ndarray) -> np.ndarray:
    """The ids of the ``k``-th checkpoint's span. ``table`` has the symbol's index for each of the 2^bits slots."""
    lanes, n = block["lanes"], block["n"]
    words = np.frombuffer(block["words"], "<u4").astype(np.uint64)
    state = np.frombuffer(block["states"], "<u8").reshape(-1, lanes)[k].astype(np.uint64)
    first, last = k * STEPS, min((k + 1) * STEPS, -(-n // lanes))
    at = block["places"][k]
    f, start = freqs.astype(np.uint64), (np.cumsum(freqs) - freqs).astype(np.uint64)
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    out = np.empty((last - first, lanes), np.int64)
    for t in range(last - first):
        slot = state & mask
        s = table[slot.astype(np.int64)]
        out[t] = s
        state = f[s] * (state >> shift) + slot - start[s]
        low = np.flatnonzero(state < LOW)
        state[low] = (state[low] << np.uint64(32)) | words[at : at + len(low)]
        at += len(low)
    return symbols[out.reshape(-1)[: n - first * lanes]]


def spans_of(block: dict) -> int:
    return len(block["places"])


def encode_segment(ids: np.ndarray) -> dict:
    symbols, freqs, bits = frequencies(ids)
    place = np.zeros(int(symbols[-1]) + 1, np.int64)
    place[symbols] = np.arange(len(symbols))
    index = place[ids]
    blocks = []
    for a in range(0, len(ids), BLOCK):
        block = encode_block(index[a : a + BLOCK], freqs, bits)
        wide = STEPS * block["lanes"]
        mine = ids[a : a + BLOCK].astype("<u4")
        block["crcs"] = [crc32(mine[i : i + wide].tobytes()) for i in range(0, len(mine), wide)]
        blocks.append(block)
    return {"symbols": symbols.astype("<u4").tobytes(), "counts": freqs.astype("<u4").tobytes(), "bits": bits, "blocks": blocks}


def decode_segment(row: dict) -> np.ndarray:
    """All ids of a segment; a span that does not match its checksum stops the read."""
    symbols, freqs = (np.frombuffer(row[k], "<u4").astype(np.int64) for k in ("symbols", "counts"))
    table = np.repeat(np.arange(len(freqs)), freqs)
    out = []
    for block in row["blocks"]:
        for k in range(spans_of(block)):
            ids = decode_span(block, k, symbols, freqs, row["bits"], table)
            if crc32(ids.astype("<u4").tobytes()) != block["crcs"][k]:
                raise ValueError("a span of a token file does not match its checksum")
            out.append(ids)
    return np.concatenate(out) if out else np.empty(0, np.int64)


# --- tokenizer -----------------------------------------------------------------------------------------------------


class WordTokenizer:
    """A tokenizers file whose normaliser and splitter never look past white space, so words can be encoded one by one."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.mark_id, mark = max(added.items()) if added else (None, None)
        self.mark = mark.content if mark else None
        said = json.loads(self.tokenizer.to_str())
        self.one_piece = [x.get("pattern") for x in said["pre_tokenizer"].get("pretokenizers", [])][:1] == [{"Regex": SPLITTER}] and said["normalizer"].get("normalizers", [{}])[-1] == {"type": "Lowercase"}
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.cache = WordIds(self._encode_words)

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, None]:
        """Words of letters are joined by spaces, as then each ends with the only id that ends a word; others are joined by a special
        token, which the library takes out before anything else."""
        words = [w.decode("utf-8", "surrogatepass") for w in words]
        plain = [i for i, w in enumerate(words) if w.isalpha()] if self.one_piece else []
        each: list = [None] * len(words)
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for group, ids in zip(groups, self._ids([" ".join([words[i] for i in g]) for g in groups])):
            flat = np.array(ids, np.int32)
            ends = np.flatnonzero(self.ends[flat]) + 1
            if len(ends) == len(group):
                for i, a, b in zip(group, [0, *ends.tolist()], ends.tolist()):
                    each[i] = flat[a:b]
        rest = [i for i, x in enumerate(each) if x is None]
        if rest:
            flat, n = self._marked([words[i] for i in rest])
            stops = np.cumsum(n).tolist()
            for i, a, b in zip(rest, [0, *stops], stops):
                each[i] = flat[a:b]
        return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each)), None

    def _marked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.mark is None or any(self.mark in w for w in words):
            each = self._ids(words)
            return np.array([i for x in each for i in x], np.int32), np.array([len(x) for x in each])
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        flat = np.concatenate([np.array([*x, self.mark_id], np.int32) for x in self._ids([self.mark.join(g) for g in groups])])
        ends = np.flatnonzero(flat == self.mark_id)
        return flat[flat != self.mark_id], np.diff(ends, prepend=-1) - 1

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, ids of each text). ASCII texts are lower-cased first where the file does so; the end of a sentence is a word of
        its own. Both only make fewer words differ."""
        raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
        if self.one_piece:
            raw = [x.lower() if x.isascii() and b"<|" not in x else x for x in raw]
        ids, n, _ = self.cache(Words(raw, clip=b".," if self.one_piece else b""))
        return ids, n


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


# --- files ---------------------------------------------------------------------------------------------------------


def write(docs: DataFrame, tokenizer_path: str, folder: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID) -> None:
    """Write the ids of all texts, each with ``end_id`` after it, in ascending order of ``doc_id`` to a new folder."""
    from pyspark.sql.types import _parse_datatype_string

    schema = _parse_datatype_string(FILE_SCHEMA)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, part, seq = _tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        docs_in, lengths, ids, size = [], [], [], 0

        def segment() -> pa.RecordBatch:
            row = {"part": part, "seq": seq, "docs": docs_in, "lengths": np.concatenate(lengths).tolist(), "n_tokens": size}
            return pa.RecordBatch.from_pylist([row | encode_segment(np.concatenate(ids))], schema=arrow)

        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in pieces_of([x or "" for x in texts]):
                flat, n = tokenizer(texts[a:b])
                flat = np.insert(flat, np.cumsum(n), end_id)
                docs_in, size = docs_in + keys[a:b], size + len(flat)
                lengths.append(n + 1)
                ids.append(flat)
                if size >= SEGMENT:
                    yield segment()
                    docs_in, lengths, ids, size, seq = [], [], [], 0, seq + 1
        if docs_in:
            yield segment()

    # Rows that share an id are sorted by text, so that their starts are the same in every run.
    ordered = docs.select(F.col(doc_id).cast("bigint"), text).repartitionByRange(doc_id).sortWithinPartitions(doc_id, F.xxhash64(text))
    ordered.mapInArrow(run, schema).write.parquet(folder)


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in a folder, and its ids if asked for."""
    files = spark.read.parquet(folder)
    kind = "part int, seq int, doc_id bigint, within bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids = decode_segment(row)
                n = np.array(row["lengths"], np.int64)
                starts = np.cumsum(n) - n
                raw = memoryview(ids.astype("<u4").tobytes())
                crcs = [crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(starts.tolist(), n.tolist())]
                columns = [pa.array(np.full(len(n), row[k], np.int32)) for k in ("part", "seq")]
                columns += [pa.array(row["docs"], pa.int64()), pa.array(starts), pa.array(n), pa.array(crcs, pa.int64())]
                names = ["part", "seq", "doc_id", "within", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    decoded = files.mapInArrow(run, kind)
    segments = files.select("part", "seq", "n_tokens")
    # One row for each part in the only window that spans them all; segments are then counted within their part.
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    own = Window.partitionBy("part").orderBy("seq")
    offsets = segments.select("part", "seq", (F.sum("n_tokens").over(own) - F.col("n_tokens")).alias("ahead")).join(parts, "part")
    out = decoded.join(offsets, ["part", "seq"]).withColumn("start", F.col("before") + F.col("ahead") + F.col("within"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))
