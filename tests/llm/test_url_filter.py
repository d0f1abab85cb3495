import re

import duckdb

from ledgerloom.llm import url_filter


def plain(url, rules=url_filter.RULES):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h) + len(p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[3] if fits else None, max(fits)[2] if fits else "allow"


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/1?q#f", "http://net/x", "http://x.net", "http://notnet/", "http://www.example.com/de/a/b", "http://example.com/dex", "http://b.example.com./de/", "ftp://org/fr/?x", "a://b://c.net/", "http://example.net/en/", "http://example.net/en", "http://ÄÉ.net/ü/", "http://u.net#/en/", "http://" + "a." * 300 + "net/" + "p/" * 300, "http://x.net/en//en/"]
    df = spark.createDataFrame([(i if i else None, u, "r") for i, u in enumerate(urls * 2)], "page_id long, url string, rule string")
    got = sorted(((r.host, r.path, r.rule, r.verdict) for r in url_filter.query(df).collect()), key=repr)
    assert got == sorted((plain(u) for u in urls * 2), key=repr)
    assert url_filter.query(df.where("false")).count() == 0


def test_other_rules_and_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_RULES", 2)
    rules = [("block", "a.b", ""), ("allow", "b", "/x"), ("block", "A.B", "/x/y.htm"), ("allow", "a.b", "/x/y.htm"), ("block", "c", "/q/"), ("allow", None, "/"), ("allow", "", "")]
    known = [(v, h.lower(), p) for v, h, p in rules if h is not None]
    urls = ["http://a.b/x/y.html", "http://z.a.b/x", "http://b/xx/", "http://c/q", "http://c/q/", "", "http://b/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, url_filter.rules_frame(spark, rules)).collect()}
    assert got == {i: plain(u, known) for i, u in enumerate(urls)}
    none = url_filter.judge(df, url_filter.rules_frame(spark, rules).where("false")).collect()
    assert {r.verdict for r in none} == {"allow"}


def test_sql(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    db = duckdb.connect()
    db.execute("create view pages as select * from '/root/testdata/sf0.01/pages.parquet'")
    want = sorted(db.execute(url_filter.ORACLE_SQL).fetchall())
    out = url_filter.query(pages)
    assert sorted(map(tuple, out.select("page_id", "host", "path", "rule", "verdict").collect())) == want
    assert len({w[3] for w in want}) > 2
    assert "Python" not in out._jdf.queryExecution().toString()


def test_long_urls(spark):
    urls = ["http://x.net" + "/" * 1_000_000, "http://" + "a." * 300_000 + "net/", "http://b.org/fr/" + "p/" * 300_000, "x" * 1_000_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.query(df).collect()}
    assert got == {i: plain(u) for i, u in enumerate(urls)}
