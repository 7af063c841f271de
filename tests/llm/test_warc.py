import hashlib

import pytest

from catchmark.llm import warc

SCHEMA = "page_id bigint, url string, html string, digest string, length int, times int, _key string"


def table(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", 1, 2, "k") for i, u, h in rows], SCHEMA)


def brute(rows):
    """(id, bytes, digest, type, refers_to) of each record by gathering equal payloads."""
    groups, out = {}, []
    for i, u, h in rows:
        groups.setdefault((h or "").encode(), []).append((i is None, i, u is None, u))
    for body, members in groups.items():
        members.sort(key=lambda m: (m[0], m[1] or 0, m[2], m[3] or ""))
        for k, (_, i, _, _) in enumerate(members):
            revisit = len(body) >= 100 and k > 0
            out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", members[0][1] if revisit else None))
    return sorted(out, key=str)


def through(spark, rows, tmp_path, **how):
    folder = str(tmp_path / "warc")
    warc.write(table(spark, rows).repartition(5), folder, **how)
    got = warc.read(spark, folder).collect()
    return folder, sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=str)


LONG = "<p>" + "x" * 200 + "</p>"
ROWS = [
    (5, "http://a/5", LONG), (3, "http://a/3", LONG), (9, "http://a/9", LONG), (9, "http://a/9", LONG), (3, "http://a/3", LONG), (3, "http://b/3", LONG),  # repeated rows of the original and of a revisit
    (1, "http://a/1", None), (2, None, ""), (4, "u", "short"), (6, "u", "short"), (7, "u", "é" * 50), (8, "u", "é" * 50), (10, "u", "e" * 99), (11, "u", "e" * 99),
    (None, "http://n", "n" * 150), (None, None, "n" * 150), (12, "x", "n" * 150), (None, "only", "m" * 150), (None, "only", "m" * 150),
    (13, "http://evil/\r\nWARC-Type: warcinfo\r\n\r\n\tx y", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 9), (13, "other", "another body of this id"),
]


def test_same_as_brute_force(spark, tmp_path):
    _, got = through(spark, ROWS, tmp_path)
    assert got == brute(ROWS)


def test_many_files_and_hot_payload(spark, tmp_path, monkeypatch):
    rows = [(k, f"http://h/{k}", LONG if k % 3 == 0 else f"{k % 50}" + "y" * 120) for k in range(300)]
    monkeypatch.setattr(warc, "HOT", 4)
    _, got = through(spark, rows, tmp_path, file_bytes=5000)
    assert got == brute(rows)


def test_records_are_wellformed(spark, tmp_path):
    folder, _ = through(spark, ROWS, tmp_path)
    seen, refers = {}, []
    for file in (tmp_path / "warc").glob("*/part-*"):
        for fields, block in warc.parse(file.read_bytes()):
            assert {"warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"} <= fields.keys()
            assert int(fields["content-length"]) == len(block) and bytes(block).startswith(b"HTTP/1.1 200 OK\r\n")
            if fields["warc-type"] == "revisit":
                assert fields["warc-profile"].endswith("identical-payload-digest") and len(warc.payload_of(block)) == 0
                refers.append((fields["warc-refers-to"], fields["warc-payload-digest"]))
            assert fields["warc-record-id"] not in seen or fields["warc-type"] == "response"
            seen[fields["warc-record-id"]] = fields["warc-payload-digest"]
    assert refers and all(seen[i] == d for i, d in refers)
    urls = {r["id"]: r["url"] for r in warc.records(spark, folder).collect()}
    assert urls["13"] in ("other", "http://evil/%0D%0AWARC-Type:%20warcinfo%0D%0A%0D%0A%09x%20y")


def test_archives_merge_again(spark, tmp_path):
    folder, first = through(spark, ROWS[:6], tmp_path)
    back = warc.records(spark, folder)
    bodies = back.filter("payload is not null").select("digest", "payload").distinct()
    whole = back.drop("payload").join(bodies, "digest").selectExpr("cast(id as bigint) as page_id", "url", "payload as html")
    warc.write(whole.unionByName(table(spark, [(2, "http://a/2", LONG)]).selectExpr("page_id", "url", "cast(html as binary) as html")), str(tmp_path / "two"))
    got = warc.read(spark, str(tmp_path / "two")).collect()
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got) == sorted([(2, "response", None)] + [(i, "revisit", 2) for i in (3, 3, 3, 5, 9, 9)], key=lambda r: r[0])


def test_any_bytes(spark, tmp_path):
    body = bytes(range(256)) * 3
    df = spark.createDataFrame([(1, "u", bytearray(body))], "page_id bigint, url string, html binary")
    warc.write(df, str(tmp_path / "b"))
    assert bytes(warc.records(spark, str(tmp_path / "b")).first()["payload"]) == body


def test_empty_table_and_broken_files(spark, tmp_path):
    _, got = through(spark, [], tmp_path)
    assert got == []
    with pytest.raises(ValueError, match="bytes long"):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.parse(b"nonsense"))


def test_payload_without_its_digest_stops(spark, tmp_path):
    text = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nWARC-Payload-Digest: sha256:00\r\nContent-Length: 22\r\n\r\nHTTP/1.1 200 OK\r\n\r\nabc\r\n\r\n"
    (tmp_path / "part-0").write_bytes(text.encode())
    with pytest.raises(Exception, match="doesn't have its digest"):
        warc.records(spark, str(tmp_path)).collect()
