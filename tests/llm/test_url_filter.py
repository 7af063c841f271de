from catchmark.llm import url_filter as uf
from catchmark.llm.queries import URL_RULES, URL_SQL

URLS = [
    None, "", "no scheme", "https://Example.NET/en/a?x#y", "http://a.b.example.net/en", "http://example.net/de/1", "ftp://notexample.net/en/", "https://x.org/fr/", "https://x.org",
    "http://example.com/de/?q", "http://example.com?de/", "http://ünï.net/é", "x://y://z.net/", "http:///path", "http://net/", "https://x.org/fr/", "http://example.com/de/" + "a" * 50_000,
]


def listed(spark, rows=URL_RULES):
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "b", 1) for i, u in enumerate(urls)], "page_id bigint, url string, host string, block string, key int")


def slow(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    if rest is None:
        return "", "", None, None
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = rest[:cut].translate({c: c + 32 for c in range(65, 91)})
    stop = min([i for i in (rest.find(c, cut) for c in "?#") if i >= 0], default=len(rest))
    path = rest[cut:stop]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fit)[1:] if fit else (None, None)))


def test_rules_against_the_plain_way(spark):
    df = uf.judge(pages(spark, URLS), listed(spark))
    assert df.columns == ["page_id", "url", "block", "key", "host", "path", "rule", "verdict"]
    rows = {r["page_id"]: r for r in df.collect()}
    assert len(rows) == len(URLS)
    for i, url in enumerate(URLS):
        host, path, rule, verdict = slow(url, URL_RULES)
        assert (rows[i]["host"], rows[i]["path"], rows[i]["rule"], rows[i]["verdict"]) == (host, path, rule, verdict or "allow"), url


def test_a_long_list_loses_no_entry_and_gains_none(spark):
    rules = [(f"h{i}.com", f"/{'p' * (i % 7)}", "block") for i in range(3000)]
    urls = [f"http://www.h{i}.com/{'p' * (i % 9)}x" for i in range(0, 6000, 7)]
    got = {r["page_id"]: r["rule"] for r in uf.judge(pages(spark, urls), listed(spark, rules)).collect()}
    assert got == {i: slow(u, rules)[2] for i, u in enumerate(urls)}


def test_filter_has_no_false_negative_and_few_false_positives(spark):
    keys = spark.range(20_000).selectExpr("concat('k', id) AS key")
    n = 20_000 * uf.BITS_PER_ENTRY // uf.BLOCK_BITS
    blocks = uf.bloom_blocks(keys.filter("length(key) > 0"), "key", n)
    assert uf.possible(keys, "key", blocks, n).count() == 20_000
    others = spark.range(20_000).selectExpr("concat('other', id) AS key")
    assert uf.possible(others, "key", blocks, n).count() < 400


def test_empty_tables_and_double_entries(spark):
    assert uf.judge(pages(spark, URLS).limit(0), listed(spark)).count() == 0
    assert {r["verdict"] for r in uf.judge(pages(spark, URLS), listed(spark).limit(0)).collect()} == {"allow"}
    both = listed(spark, [("x.org", "/", "allow"), ("x.org", "/", "block"), (None, "/", "block")])
    assert uf.judge(pages(spark, ["http://x.org/"]), both).first()["verdict"] == "block"


def test_sql_says_the_same(spark, tmp_path):
    import duckdb
    from oracle_check import rows_of

    df = pages(spark, URLS).select("page_id", "url")
    con = duckdb.connect()
    table = df.toPandas()
    con.register("pages", table)
    cur = con.execute(URL_SQL)
    want = rows_of([c[0] for c in cur.description], cur.fetchall())
    got = uf.judge(df, listed(spark))
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == want
