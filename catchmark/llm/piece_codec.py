"""SentencePiece encoding and decoding with the tokenizers library.

The model's protobuf is parsed here, and its normaliser, metaspace marker, scores (BPE merges or unigram) and byte fallback
are rebuilt as a tokenizers pipeline that encodes batches with several threads. Where no piece of the vocabulary has a marker
after another character, tokens never cross a word's edge, so texts are cut before each run of spaces, each distinct word is
encoded once and kept in a bounded cache; other vocabularies are encoded text by text. Parity with the sentencepiece library
is verified for every word when it is first met, and told for each document.

Cases: a null text encodes to no ids and decodes to null; an empty text to no ids and ''. Strings that look like control pieces
are ordinary text. Decoding gives the normalised text, which for a model with the identity normaliser is the text itself, but that
a marker character in it comes back as a space.
Repeated rows give repeated results; columns of the input that are named like the added ones are replaced.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from catchmark.llm.word_cache import BLANK, WordIds, Words, pieces_of
from catchmark.llm.workers import held, only

MARK = "▁"
#: Kinds of pieces and models in the public protobuf schema (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


@dataclass
class PieceModel:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field: an int, four or eight raw bytes, or the bytes of a nested one."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        elif tag & 7 in (1, 5):
            n = 8 if tag & 7 == 1 else 4
            value, at = data[at : at + n], at + n
        elif tag & 7 == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            raise ValueError("not a SentencePiece model")
        yield tag >> 3, value


def parse_model(data: bytes) -> PieceModel:
    out = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            out.pieces.append(own[1].decode())
            out.scores.append(float(np.frombuffer(own[2], "<f4")[0]) if 2 in own else 0.0)
            out.kinds.append(own.get(3, NORMAL))
        elif number == 2:
            own = dict(_fields(value))
            out.model_type, out.byte_fallback = own.get(3, UNIGRAM), bool(own.get(35, 0))
        elif number == 3:
            own = dict(_fields(value))
            out.charsmap = own.get(2, b"")
            out.add_dummy_prefix, out.remove_extra_whitespaces, out.escape_whitespaces = (bool(own.get(k, 1)) for k in (3, 4, 5))
    return out


def _merges(model: PieceModel) -> list[tuple[str, str]]:
    """Every way to make a piece of two others, best-scored piece first, then the left part with the lower id."""
    ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k in (NORMAL, USER, UNUSED)}
    found = []
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            a, b = piece[:cut], piece[cut:]
            if a in ids and b in ids:
                found.append((-model.scores[i], ids[a], ids[b], a, b))
    return [(a, b) for *_, a, b in sorted(found)]


def build_tokenizer(model: PieceModel):
    """The tokenizers pipeline that does what the model says; without a word cache."""
    from tokenizers import Tokenizer, decoders, models, normalizers

    vocab = {p: i for i, p in enumerate(model.pieces)}
    unknown = model.kinds.index(UNKNOWN)
    if model.model_type == BPE:
        core = models.BPE(vocab=vocab, merges=_merges(model), unk_token=model.pieces[unknown], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        core = models.Unigram(list(zip(model.pieces, model.scores)), unk_id=unknown, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        from tokenizers import Regex

        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    tail = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else [])
    tokenizer.decoder = decoders.Sequence(tail)
    return tokenizer


def words_stand_alone(model: PieceModel) -> bool:
    """Does no piece cross from a word into the next one, and is the text taken as it is?"""
    plain = model.escape_whitespaces and model.add_dummy_prefix and not model.charsmap and not model.remove_extra_whitespaces
    return plain and not any(k in (NORMAL, USER, UNUSED) and re.search(f"[^{MARK}]{MARK}", p) for p, k in zip(model.pieces, model.kinds))


#: Words that are joined to one text for the tokenizer.
JOINED = 200
#: Rows whose texts a worker holds as Python strings at once, and characters it encodes at once.
ROWS, CHARS = 250, 200_000
#: Words, and bytes of words, whose ids a worker keeps.
KEPT_WORDS, KEPT_BYTES = 250_000, 1 << 23


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, path: str, verify: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        with open(path, "rb") as f:
            self.model = parse_model(f.read())
        self.tokenizer = build_tokenizer(self.model)
        self.alone = words_stand_alone(self.model)
        self.other = None
        if verify:
            import sentencepiece

            self.other = sentencepiece.SentencePieceProcessor(model_file=path)
        self.cache = WordIds(self._encode_words, KEPT_WORDS, KEPT_BYTES)
        self.opens = np.array([p.startswith(MARK) for p in self.model.pieces])
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(MARK, " ").encode() for p, k in zip(self.model.pieces, self.model.kinds)]

    def _whole(self, text: str) -> tuple[np.ndarray, bool]:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids if text else []
        return np.array(ids, np.int32), self.other is None or not text or ids == self.other.encode(text)

    def _encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words are joined by spaces, as each then begins with the only piece that has a marker; the joined texts are a batch."""
        words = [w.decode("utf-8", "surrogatepass") for w in words]
        plain = [i for i, w in enumerate(words) if MARK not in w]
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        texts = [" ".join([words[i] for i in g]) for g in groups]
        each, right = [None] * len(words), np.ones(len(words), bool)
        theirs = self.other.encode(texts, num_threads=1) if self.other is not None else [None] * len(texts)
        for g, x, y in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), theirs):
            ids = x.ids
            flat = np.array(ids, np.int32)
            starts = np.flatnonzero(self.opens[flat]).tolist()
            if len(starts) == len(g) and (y is None or ids == y):
                for i, a, b in zip(g, starts, [*starts[1:], len(flat)]):
                    each[i] = flat[a:b]
        for i, w in enumerate(words):
            if each[i] is None:
                each[i], right[i] = self._whole(w)
        return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each)), right

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(all ids, ids of each text, whether each agrees with the sentencepiece library). A text with spaces at an end or side by
        side, or with a marker in it, is encoded whole."""
        texts = [x or "" for x in texts]
        plain = [self.alone and x != "" and x[0] != " " and x[-1] != " " and "  " not in x and MARK not in x for x in texts]
        ids, n, wrong = self.cache(Words([x.encode("utf-8", "surrogatepass") if p else b"" for x, p in zip(texts, plain)], BLANK))
        if all(plain):
            return ids, n, wrong == 0
        each, same = np.split(ids, np.cumsum(n)[:-1]), wrong == 0
        for i, p in enumerate(plain):
            if not p:
                each[i], same[i] = self._whole(texts[i])
        return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each)), same

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.model.add_dummy_prefix and text.startswith(" ") else text


@held
@lru_cache(maxsize=2)
def _codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model_path: str, text: str = "text", to: str = "ids") -> DataFrame:
    """``docs`` with ``to``, a struct of ids (array of int), parity (agrees with the sentencepiece library) and round_trip (decodes
    to the text). ``model_path`` is the model's path on every executor. Ids go back to Spark slice by slice as Arrow arrays."""
    plain = docs.drop(to)
    schema = StructType([*plain.schema.fields, StructField(to, _parse_datatype_string("struct<ids: array<int>, parity: boolean, round_trip: boolean>"))])
    place = plain.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only(_codec)
        codec = _codec(model_path)
        for batch in (whole.slice(i, ROWS) for whole in batches for i in range(0, whole.num_rows, ROWS)):
            rows = batch.column(place).to_pylist()
            for a, b in pieces_of([x or "" for x in rows], CHARS):
                ids, n, same = codec.encode(rows[a:b])
                ends = np.cumsum(n)
                trip = [codec.decode(ids[i:j]) == (x or "") for x, i, j in zip(rows[a:b], [0, *ends.tolist()], ends.tolist())]
                each = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                said = pa.StructArray.from_arrays([each, pa.array(np.asarray(same, bool)), pa.array(trip, pa.bool_())], ["ids", "parity", "round_trip"])
                own = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*own.columns, said], [*own.schema.names, to])

    return plain.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", to: str = "text") -> DataFrame:
    """``encoded`` with the text of its column of ids; null ids give null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        only(_codec)
        codec = _codec(model_path)
        for rows in batches:
            yield pd.Series([None if x is None else codec.decode(np.asarray(x, np.int64)) for x in rows], dtype=object)

    return encoded.withColumn(to, run(F.col(ids)))


def summary(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), parity, round_trip; no ids leave the task."""

    @F.pandas_udf("struct<n_tokens: bigint, ids_crc32: bigint, parity: boolean, round_trip: boolean>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        only(_codec)
        codec = _codec(model_path)
        for texts in batches:
            rows = texts.tolist()
            out = []
            for a, b in pieces_of([x or "" for x in rows], CHARS):
                ids, n, same = codec.encode(rows[a:b])
                for x, mine, ok in zip(rows[a:b], np.split(ids, np.cumsum(n)[:-1]), same.tolist()):
                    out.append((len(mine), crc32(mine.astype("<u4").tobytes()), ok, codec.decode(mine) == (x or "")))
            yield pd.DataFrame(out, columns=["n_tokens", "ids_crc32", "parity", "round_trip"])

    return docs.select(F.col(doc_id), run(F.col(text)).alias("_s")).select(doc_id, "_s.*")
