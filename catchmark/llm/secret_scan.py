"""Secret scans: fixed patterns, and random strings found by how badly a token vocabulary compresses them.

A vocabulary learned from prose spends about four characters a token on words and below two on random strings, so a run of
key-like characters with few characters per token is reported as a secret. Known digests (hexadecimal of a digest's length)
and identifiers (UUIDs, numbers, dates, words of one case joined by marks) are left out of that test first; what looks like words of
both cases must have still fewer characters per token, and of a path each name is tested by itself.

Cases: a null or empty text has no span; repeated rows give repeated results; further columns of the input are not read.
Spans count code points, end exclusive. Texts are scanned whole, however long.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catchmark.llm.workers import held, only

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: For runs that look like words (letters, joined or followed by short numbers) of both cases the limit is lower: names of code reach two.
MAX_CHARS_PER_TOKEN, MAX_LETTERS_PER_TOKEN = 2.2, 1.5
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
IDENTIFIERS = re.compile(
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"  # UUID
    r"|[0-9+=_/-]+"  # numbers, dates, rules
    r"|(?:[A-Za-z]+|[0-9]{1,4})(?:[_/+=-]+(?:[A-Za-z]+|[0-9]{1,4}))*[_/+=-]*"  # words joined by marks
    r"|[A-Za-z]+[0-9]{0,4}"  # a word with a number
)
SCHEMA = T.StructType([
    T.StructField("kind", T.StringType(), False), T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False),
])


@held
@lru_cache(maxsize=2)
def _vocabulary(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _random(run: str, encoding, limit: float) -> bool:
    if not re.search("[A-Za-z]", run) or (len(run) in DIGEST_LENGTHS and DIGEST.fullmatch(run)):
        return False
    if run[0] == "/" and "/" in run[1:]:
        # A path: its names are looked at one by one.
        return any(len(name) >= 16 and _random(name, encoding, limit) for name in run.split("/"))
    if IDENTIFIERS.fullmatch(run):
        if not (re.search("[a-z]", run) and re.search("[A-Z]", run)):
            return False
        limit = min(limit, MAX_LETTERS_PER_TOKEN)
    return len(run) <= limit * len(encoding.encode_ordinary(run))


def find_spans(text: str | None, encoding, limit: float = MAX_CHARS_PER_TOKEN) -> list[tuple[str, int, int]]:
    """All spans in order of start, then kind as listed in KINDS. A run of the token test that a base span covers is not told twice."""
    if not text:
        return []
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base, seen, reach = sorted(spans), 0, 0
    for m in RUN.finditer(text):
        while seen < len(base) and base[seen][0] <= m.start():
            reach = max(reach, base[seen][2])
            seen += 1
        if m.end() > reach and _random(m[0], encoding, limit):
            spans.append((m.start(), 3, m.end()))
    return [(KINDS[k], a, b) for a, k, b in sorted(spans)]


def with_spans(docs: DataFrame, vocabulary: str, text: str = "text", to: str = "spans", limit: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """``docs`` with a column of spans (kind, start, end). ``vocabulary`` is the path of a tiktoken rank file on every executor."""

    @F.pandas_udf(T.ArrayType(SCHEMA))
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        only(_vocabulary)
        encoding = _vocabulary(vocabulary)
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(x, encoding, limit)] for x in texts])

    return docs.withColumn(to, scan(F.col(text)))


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest_columns(found: DataFrame, spans: str = "spans") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text, in place of ``spans``."""
    of = lambda *kinds: F.filter(F.col("_found"), lambda s: s["kind"].isin(*kinds))
    return (
        found.withColumnRenamed(spans, "_found")
        .withColumns({f"n_{k}": F.size(of(k)).cast("long") for k in KINDS[:3]})
        .withColumn("base_sha256", F.sha2(span_text(of(*KINDS[:3])), 256))
        .withColumn("spans", span_text(F.col("_found")))
        .drop("_found")
    )


def mask_text(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """``text`` with each run of overlapping spans replaced by ``mask``."""
    out, at = [], 0
    for a, b in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mask]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, vocabulary: str, mask: str = "[SECRET]", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with every secret masked in ``text`` and ``n_chars`` (if there) counted anew; columns and rows stay."""
    columns = docs.columns

    @F.pandas_udf("string")
    def masked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        only(_vocabulary)
        encoding = _vocabulary(vocabulary)
        for texts in batches:
            yield pd.Series([x if x is None else mask_text(x, [(a, b) for _, a, b in find_spans(x, encoding)], mask) for x in texts], dtype=object)

    out = docs.withColumn(text, masked(F.col(text)))
    if n_chars in columns:
        out = out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return out.select(*columns)


def brute_base(text: str | None) -> tuple[int, int, int, str]:
    """The base columns of one text, in the plainest way; for tests."""
    text = text or ""
    found = []
    for k, (pattern, group, least) in enumerate(((ASSIGN, 1, 8), (ACCESS, 0, 16), (re.compile("[0-9a-f]+"), 0, 32))):
        found += [(m.start(), k, m.end()) for m in pattern.finditer(text) if len(m[group]) >= least]
    said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(found))
    return (*(sum(k == i for _, k, _ in found) for i in range(3)), hashlib.sha256(said.encode()).hexdigest())
