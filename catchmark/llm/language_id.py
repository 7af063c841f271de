"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point and a seed. A letter trigram is the product of its
letters' vectors, the first rolled by two places and the second by one; a text is the sum of its trigrams, a language the sum of its
labelled texts, and a document gets the language of the largest cosine. Text is lower-cased, and what isn't a letter parts
words (a word's edge is a symbol of its own). Sums are whole numbers, so no order of adding changes them.

Cases: a null text or one without letters is ``und`` with score 0, as is every text where no language was learned; ties go to the
first language in order of name; repeated rows count as often in training and get the same prediction; extra columns are kept
by ``predict`` except ones named like its results. The model (languages x DIMENSIONS numbers) is what the driver holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catchmark.llm.word_cache import pieces_of
from catchmark.llm.workers import held, only

DIMENSIONS, SEED, UNDETERMINED = 1024, 20, "und"
DENSE = 1 << 20
#: Trigrams whose vectors are multiplied at once, as floats; all of a batch are held as bytes.
BLOCK = 512


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@held
@lru_cache(maxsize=20_000)
def letter_vector(code: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    return (np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, dimensions, np.int8) * 2 - 1).astype(np.int8)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(three code points of each trigram that occurs, trigram of each place, text of each place); 0 is a word's edge."""
    lowered = ["\n" + (x or "").lower() + "\n" for x in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), [len(x) for x in lowered])
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:-1] |= letter[1:] & (codes[:-1] == 10)
    codes, owner = np.where(letter, codes, 0)[keep], owner[keep]
    if len(codes) < 3:
        return np.empty((0, 3), np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
    seen = np.zeros(0x110000, np.int64)
    seen[codes] = 1
    alphabet = np.flatnonzero(seen)
    seen[alphabet] = np.arange(len(alphabet))
    size = len(alphabet)
    index = seen[codes]
    grams = (index[:-2] * size + index[1:-1]) * size + index[2:]
    inside = (owner[:-2] == owner[2:]) & (codes[1:-1] != 0)
    grams, owner = grams[inside], owner[:-2][inside]
    if size**3 <= DENSE:
        there = np.zeros(size**3, np.int64)
        there[grams] = 1
        distinct = np.flatnonzero(there)
        there[distinct] = np.arange(len(distinct))
        places = there[grams]
    else:
        distinct, places = np.unique(grams, return_inverse=True)
    return alphabet[np.stack([distinct // size**2, distinct // size % size, distinct % size], 1)], places, owner


def gram_vectors(codes: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    alphabet, index = np.unique(codes, return_inverse=True)
    index = index.reshape(codes.shape)
    base = np.stack([letter_vector(int(c), dimensions) for c in alphabet])
    out = np.roll(base, 2, 1)[index[:, 0]]
    out *= np.roll(base, 1, 1)[index[:, 1]]
    out *= base[index[:, 2]]
    return out


def weighted(counts: np.ndarray, vectors: np.ndarray, kind: type) -> np.ndarray:
    """counts @ vectors in numbers of ``kind``, block by block; sums are whole, so blocks don't change them."""
    out = np.zeros((len(counts), vectors.shape[1]), kind)
    block = np.empty((min(BLOCK, len(vectors)), vectors.shape[1]), kind)
    for a in range(0, len(vectors), BLOCK):
        n = min(BLOCK, len(vectors) - a)
        block[:n] = vectors[a : a + n]
        out += counts[:, a : a + n].astype(kind) @ block[:n]
    return out


def text_vectors(texts: list[str | None], dimensions: int = DIMENSIONS) -> np.ndarray:
    """One row for each text; a text without letters is all zeros. Counts are summed in parts, so memory is bounded by DENSE."""
    codes, places, owner = trigrams(texts)
    out = np.zeros((len(texts), dimensions), np.float32)
    if not len(codes):
        return out
    vectors, wide = gram_vectors(codes, dimensions), len(codes)
    step = max(1, DENSE // wide)
    for a in range(0, len(texts), step):
        lo, hi = np.searchsorted(owner, [a, a + step])
        n = min(step, len(texts) - a)
        counts = np.bincount((owner[lo:hi] - a) * np.int64(wide) + places[lo:hi], minlength=n * wide).reshape(n, wide)
        used = np.flatnonzero(counts.any(0))
        out[a : a + n] = weighted(counts[:, used], vectors[used], np.float32)
    return out


@dataclass(frozen=True)
class Profiles:
    languages: list[str]
    vectors: np.ndarray


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS) -> Profiles:
    """Prototypes of all languages of ``labelled``, from every one of its rows with a language and a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only(letter_vector)
        sums: dict[str, np.ndarray] = {}
        for pdf in batches:
            rows, langs = pdf["text"].tolist(), pdf["lang"].to_numpy()
            for a, b in pieces_of(rows, 500_000):
                codes, places, owner = trigrams(rows[a:b])
                if not len(codes):
                    continue
                vectors = gram_vectors(codes, dimensions)
                names, index = np.unique(langs[a:b].astype(str), return_inverse=True)
                counts = np.bincount(index[owner] * np.int64(len(codes)) + places, minlength=len(names) * len(codes)).reshape(len(names), -1)
                for name, total in zip(names, weighted(counts, vectors, np.float64)):
                    sums[name] = sums.get(name, 0) + total.astype(np.int64)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "total": [x.tolist() for x in sums.values()]})

    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    parts = rows.mapInPandas(run, "lang string, total array<bigint>").select("lang", F.posexplode("total").alias("place", "value"))
    sums = parts.groupBy("lang", "place").agg(F.sum("value").alias("value"))
    learned: dict[str, np.ndarray] = {}
    for row in sums.collect():
        learned.setdefault(row["lang"], np.zeros(dimensions))[row["place"]] = row["value"]
    names = sorted(n for n, v in learned.items() if v.any())
    return Profiles(names, np.stack([learned[n] / np.linalg.norm(learned[n]) for n in names]) if names else np.zeros((0, dimensions)))


def judge(texts: list[str | None], profiles: Profiles) -> tuple[list[str], list[float]]:
    if not profiles.languages:
        return [UNDETERMINED] * len(texts), [0.0] * len(texts)
    vectors = text_vectors(texts, profiles.vectors.shape[1])
    norms = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))
    cosines = (vectors @ profiles.vectors.T.astype(np.float32)) / np.maximum(norms, 1e-30)[:, None]
    best = cosines.argmax(1)
    score = np.clip(cosines[np.arange(len(texts)), best].astype(float), 0.0, 1.0)
    lettered = [x is not None and any(map(str.isalpha, x)) for x in texts]
    return [profiles.languages[k] if ok else UNDETERMINED for k, ok in zip(best, lettered)], [float(s) if ok else 0.0 for s, ok in zip(score, lettered)]


def predict(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score; only ``text`` is looked at."""

    @F.pandas_udf("struct<lang_pred: string, score: double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        only(letter_vector)
        for texts in batches:
            rows = texts.tolist()
            names, scores = [], []
            for a, b in pieces_of([x or "" for x in rows], 500_000):
                n, s = judge(rows[a:b], profiles)
                names += n
                scores += s
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    plain = docs.drop("lang_pred", "score")
    return plain.withColumn("_said", run(F.col(text))).select(*plain.columns, "_said.*")


def held_out(doc_id) -> "Column":
    """Every fifth document by checksum of its id is kept from training."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0
