"""WARC archives whose repeated payloads are revisit records.

Only headers (id, URL, payload length and digest) are shuffled, by digest. The smallest id of a digest is the original; the others become
revisits, which are written from the headers alone, so their payloads move nowhere. Responses are written where their payload is read: a row is one
unless its header is among the revisits. Every record gets fresh headers; a revisit refers to the original's record.

Reading parses each file by the lengths its headers state, one record at a time, checks each payload against its digest, and joins
revisits to the response with their digest, which gives them length, id and URL. What is read can be written again, together with other records, so archives are
merged the same way: a revisit whose payload is elsewhere in the input is resolved by that.

A digest may be that of a third of all records. Digests that hold at least 1/HOT of the records are at most HOT, so their rows are
broadcast; all others are joined by a shuffle in which no key is larger.

The files are written by Spark's text sink (committed at the end, on any file system) with the blank line that ends each record as
its separator; payloads of any bytes go through. They are not compressed: one gzip member a record is not a thing that sink can write.

Cases: a null payload is empty; payloads under LEAST bytes and empty ones are all responses; equal ids with equal payloads give one response
and revisits for the other rows, equal ids with different payloads are records of their own; a null id is the largest; URLs that are null or hold blanks or control characters
are left out or escaped in the headers; an empty table gives an empty folder that reads as no records; extra columns aren't written.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catchmark.operators.lineage import cut

LEAST, HOT, FILE_BYTES = 100, 1024, 32 << 20
RESPONSE, REVISIT = "response", "revisit"
END, VERSION, PROFILE = "\r\n\r\n", "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PARSED = "id string, url string, record_type string, digest string, refers_to_record string, payload binary, length bigint"


def with_headers(records: DataFrame, id: str, url: str, payload: str) -> DataFrame:
    """id, url, payload (binary, never null), length and digest (lower-case hex SHA-256) of each record."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = records.select(F.col(id).alias("id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    return rows.withColumns({"length": F.octet_length("payload").cast("bigint"), "digest": F.sha2("payload", 256)})


def by_key(rows: DataFrame, sizes: DataFrame, table: DataFrame, key: str, how: str) -> DataFrame:
    """``rows`` joined (``left`` or ``inner``) with ``table``, one row a key. ``sizes`` is (key, members) of the rows' keys; keys with 1/HOT of all rows are broadcast."""
    members = sizes.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    hot = table.join(F.broadcast(sizes.filter(F.col("members") * HOT >= members).select(key)), key, "left_semi")  # at most HOT keys
    values = [c for c in table.columns if c != key]
    one = hot.select(F.col(key).alias("_hot"), F.struct(*values).alias("_first"))
    met = rows.join(F.broadcast(one), rows[key] == F.col("_hot"), "left")
    # rows that are through take a key of their own, so they are spread evenly
    met = met.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.concat(F.lit("-"), F.xxhash64(*[c for c in rows.columns if c != "payload"]).cast("string"), F.lit("-"), F.monotonically_increasing_id().cast("string"))))
    rest = table.join(F.broadcast(hot.select(key)), key, "left_anti").select(F.col(key).alias("_key"), F.struct(*values).alias("_rest"))
    out = met.join(rest, "_key", "left").withColumn("_value", F.coalesce("_first", "_rest"))
    out = out if how == "left" else out.filter("_value is not null")
    return out.select(*rows.columns, *[F.col(f"_value.{c}").alias(c) for c in values])


def resolve(headers: DataFrame) -> DataFrame:
    """(id, url, digest, length, times, first_id, first_url) of the revisits among headers (id, url, digest, length): first_* is the original, ``times`` counts equal rows.

    Of rows with the original's id, URL and digest one is the response and times - 1 are revisits.
    """
    least = F.struct(F.col("id").isNull().alias("last"), F.col("id").alias("first_id"), F.col("url").isNull().alias("no_url"), F.col("url").alias("first_url"))
    rows = cut(headers.filter(F.col("length") >= LEAST).groupBy("id", "url", "digest", "length").agg(F.count(F.lit(1)).alias("times")), "headers")
    groups = cut(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("members"), F.sum("times").alias("records"), F.min(least).alias("first")).filter("records > 1"), "digests")
    firsts = groups.select("digest", "first.first_id", "first.first_url", F.lit(True).alias("repeats"))
    met = by_key(rows, groups.select("digest", "members"), firsts, "digest", "inner")
    original = F.col("id").eqNullSafe(F.col("first_id")) & F.col("url").eqNullSafe(F.col("first_url"))
    return met.withColumn("times", F.col("times") - original.cast("int")).filter("times > 0").withColumn("original", original).drop("repeats")


def _record_id(kind: Column, *parts: Column) -> Column:
    """A URN that follows from the record's content and place, so a task that runs again writes the same."""
    text = F.concat_ws("\x1f", kind, *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts])
    h = F.md5(text)
    cut_at = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), cut_at(1, 8), F.lit("-"), cut_at(9, 4), F.lit("-5"), cut_at(14, 3), F.lit("-a"), cut_at(18, 3), F.lit("-"), cut_at(21, 12), F.lit(">"))


def _header_safe(text: Column) -> Column:
    """Blanks and control characters as escapes, so that a URL can't end its line."""
    text = F.replace(text, F.lit("\r"), F.lit("%0D"))
    for char, escape in (("\n", "%0A"), ("\t", "%09"), (" ", "%20")):
        text = F.replace(text, F.lit(char), F.lit(escape))
    return F.regexp_replace(text, r"[\x00-\x1F\x7F]", "%7F")


def _lines(*fields: tuple[str, Column]) -> Column:
    """Header lines; a null field has no line."""
    said = [F.concat(F.lit(f"{name}: "), value.cast("string")) for name, value in fields]
    return F.concat_ws("\r\n", F.lit(VERSION), *said)


def _responses(rows: DataFrame, date: Column) -> DataFrame:
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("length").cast("string"), F.lit(END))
    head = _lines(
        ("WARC-Type", F.lit(RESPONSE)), ("WARC-Record-ID", _record_id(F.lit(RESPONSE), F.col("id"), F.col("url"), F.col("digest"))), ("WARC-Target-URI", _header_safe(F.col("url"))),
        ("WARC-Date", date), ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), ("X-Source-ID", F.col("id")),
        ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length(http) + F.col("length")),
    )
    return rows.select(F.concat(head, F.lit(END), http, F.col("payload").cast("string")).alias("record"))


def _revisits(rows: DataFrame, date: Column) -> DataFrame:
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))))
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
    first = _record_id(F.lit(RESPONSE), F.col("first_id"), F.col("first_url"), F.col("digest"))
    head = _lines(
        ("WARC-Type", F.lit(REVISIT)), ("WARC-Record-ID", _record_id(F.lit(REVISIT), F.col("id"), F.col("url"), F.col("digest"), F.col("copy"))), ("WARC-Target-URI", _header_safe(F.col("url"))),
        ("WARC-Date", date), ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", first), ("WARC-Refers-To-Target-URI", _header_safe(F.col("first_url"))), ("WARC-Refers-To-Date", date),
        ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))), ("X-Source-ID", F.col("id")), ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.lit(len(http))),
    )
    return copies.select(F.concat(head, F.lit(END + http)).alias("record"))


def write(records: DataFrame, folder: str, id: str = "page_id", url: str = "url", payload: str = "html", file_bytes: int = FILE_BYTES) -> None:
    """Write one WARC record for each row to ``folder``/{responses, revisits}; repeated payloads are revisits of the smallest id."""
    rows = with_headers(records, id, url, payload)
    # one written table: the headers are read several times, and a record may not change between reads
    headers = cut(rows.drop("payload"), "warc-headers")
    revisits = cut(resolve(headers), "revisits")
    date = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    key = ["id", "url", "digest"]
    same = lambda gone: [rows[k].eqNullSafe(gone[k]) for k in key]
    others = revisits.filter("not original").select(*key)
    # the original's own repeats are equal in all that is written, so any one of them will do
    tied = revisits.filter("original").select(*key)
    kept = rows.join(others, same(others), "left_anti")
    single = kept.join(tied, [kept[k].eqNullSafe(tied[k]) for k in key], "left_anti")
    responses = _responses(single, date)
    if not tied.isEmpty():
        again = kept.join(tied, [kept[k].eqNullSafe(tied[k]) for k in key], "left_semi")
        responses = responses.unionByName(_responses(again.groupBy("id", "url", "digest", "length").agg(F.first("payload").alias("payload")), date))
    size = headers.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).first()
    per_file = max(1, int(file_bytes // (size["bytes"] / max(size["n"], 1) + 600)))
    for part, out in (("responses", responses), ("revisits", _revisits(revisits, date))):
        out.write.option("lineSep", END).option("maxRecordsPerFile", per_file).text(f"{folder.rstrip('/')}/{part}")


FIELD = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)")


def parse(content: bytes) -> Iterator[tuple[dict[str, str], memoryview]]:
    """(header fields in lower case, block) of each record of a file, by the lengths the headers state."""
    at, view = 0, memoryview(content)
    while at < len(content):
        stop = content.find(b"\r\n\r\n", at)
        if stop < 0 or not content.startswith(b"WARC/1.", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {m[1].decode().lower(): m[2].decode() for m in FIELD.finditer(content, content.find(b"\r\n", at) + 2, stop)}
        start, size = stop + 4, int(fields["content-length"])
        if content[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is not {size} bytes long")
        yield fields, view[start : start + size]
        at = start + size + 4


def payload_of(block: memoryview) -> memoryview:
    """What follows the HTTP header."""
    for size in (512, 8192, len(block)):
        if (stop := bytes(block[:size]).find(b"\r\n\r\n")) >= 0:
            return block[stop + 4 :]
    return block


def records(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """Every record as written: id, url, record_type, digest, refers_to_record, payload (null for revisits or if not asked for), length of a response's payload.

    A payload that doesn't have its digest stops the query.
    """

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for fields, block in parse(content.as_py()):
                    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha256:")
                    body = bytes(payload_of(block)) if kind == RESPONSE else None
                    if body is not None and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"record {fields['warc-record-id']}: the payload doesn't have its digest")
                    rows.append((fields.get("x-source-id"), fields.get("warc-target-uri"), kind, digest, fields.get("warc-refers-to"), body if payloads else None, None if body is None else len(body)))
                    held += len(body or b"") if payloads else 100
                    if held > 8 << 20:
                        yield told(rows)
                        rows, held = [], 0
                if rows:
                    yield told(rows)

    def told(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string()] * 5 + [pa.binary(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["id", "url", "record_type", "digest", "refers_to_record", "payload", "length"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folder)
    return files.select("content").mapInArrow(parsed, PARSED)


def read(spark: SparkSession, folder: str, id_type: str = "bigint") -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record of the archives, revisits resolved by their digest."""
    rows = cut(records(spark, folder, payloads=False).select(F.col("id").cast(id_type).alias("page_id"), "url", "record_type", "digest", "length"), "read-headers")
    responses = rows.filter(F.col("record_type") == RESPONSE)
    revisits = rows.filter(F.col("record_type") == REVISIT).drop("length")
    sizes = cut(revisits.groupBy("digest").agg(F.count(F.lit(1)).alias("members")), "revisit-sizes")
    # payloads that are revisited have one response; responses of others aren't asked for
    originals = responses.join(sizes.select("digest"), "digest", "left_semi").groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("last"), F.col("page_id").alias("refers_to"), "length")).alias("x"))
    originals = cut(originals.select("digest", "x.refers_to", "x.length"), "originals")
    resolved = by_key(revisits, sizes, originals, "digest", "left")
    columns = ["page_id", F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to", "url"]
    return responses.withColumn("refers_to", F.lit(None).cast(id_type)).select(*columns).unionByName(resolved.select(*columns))


DIGEST_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, cast(payload_bytes AS bigint) AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST} AND page_id <> first_id THEN '{REVISIT}' ELSE '{RESPONSE}' END AS record_type,
    CASE WHEN payload_bytes >= {LEAST} AND page_id <> first_id THEN first_id END AS refers_to FROM f"""
