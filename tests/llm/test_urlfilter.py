"""URL filters against hand-written hosts and verdicts."""

from pyspark.sql import functions as F

from stratograph.llm import urlfilter

HOSTS = {
    "http://user:pw@evil.example.com/": "evil.example.com", "http://a@b@evil.com/x@y": "evil.com", "http://[::1]:8080/": "[::1]", "http://evil.com./": "evil.com", "//evil.com/x": "evil.com",
    "HTTPS://WWW.Example.COM:443/a?b=http://other.org": "www.example.com", "http://evil.com?x@good.org": "evil.com", "http://evil.com#@good.org": "evil.com", "http://10.0.0.1/": "10.0.0.1",
    "http://evil.com\\@good.com/": "evil.com", "http:\\\\evil.com\\x": "evil.com", "http://good.com@evil.com\\y": "evil.com", "http://evil%2Ecom/a%20b": "evil.com", "http://%45vil.com": "evil.com",
    "http://a%2Fb.com/": None, "http://a%zz.com/": None, "http://a+b.com/": "a+b.com", "http://evil.com%2e/": "evil.com", "http://a%25.com": None, "/\\evil.com": "evil.com",
    "mailto:a@b.c": None, "not a url": None, "": None, None: None, "http:///path": None, " http://evil.com": "evil.com",
}


def test_hosts(spark):
    rows = spark.createDataFrame(list(HOSTS.items()), "url string, want string")
    assert [tuple(r) for r in rows.withColumn("host", urlfilter.host(F.col("url"))).filter("NOT host <=> want").collect()] == []


def test_parents(spark):
    want = {"a.b.evil.com": ["a.b.evil.com", "b.evil.com", "evil.com"], "evil.com": ["evil.com"], "localhost": ["localhost"], "10.0.0.1": ["10.0.0.1"], "[::1]": ["[::1]"]}
    rows = spark.createDataFrame([(h,) for h in want], "host string")
    assert {r["host"]: r["p"] for r in rows.withColumn("p", urlfilter.parents(F.col("host"))).collect()} == want


def test_verdicts_as_of_the_fetch(spark):
    entries = [("evil.com", "2024-02-10", 1, "add", "spam"), ("evil.com", "2024-05-01", 2, "remove", None), ("www.evil.com", "2024-03-05", 3, "add", "gambling"), ("com", "2024-01-01", 4, "add", "all"), (None, "2024-01-01", 5, "add", "x")]
    captures = [
        (1, "evil.com", "2024-02-09", "mine"), (2, "evil.com", "2024-02-10", "mine"), (3, "www.evil.com", "2024-03-04", "mine"), (4, "www.evil.com", "2024-03-05", None), (5, "x.www.evil.com", "2024-06-01", None),
        (6, "evil.com", "2024-05-01", None), (7, "notevil.com", "2024-03-05", None), (8, None, "2024-03-05", None), (9, "evil.com", None, None), (2, "evil.com", "2024-02-10", "mine"),
    ]
    e = spark.createDataFrame(entries, "domain string, day string, seq int, action string, category string").withColumn("day", F.to_date("day"))
    c = spark.createDataFrame(captures, "id int, domain string, fetched string, category string").withColumn("fetched", F.to_date("fetched"))
    out = urlfilter.listed_as_of(c, e, F.lit("2024-12-31").cast("date")).collect()
    assert len(out) == len(captures)
    found = {r["id"]: (r["listed"], r["category"]) for r in out}
    no = (False, None)
    assert found == {1: no, 2: (True, "spam"), 3: (True, "spam"), 4: (True, "gambling"), 5: (True, "gambling"), 6: no, 7: no, 8: no, 9: no}


def test_large_numbers_of_pages(spark):
    pages = spark.createDataFrame([(2 * 10**15, "http://evil.com/", None)], "page_id long, url string, html string")
    spark.conf.set("spark.sql.ansi.enabled", "true")
    assert urlfilter.filter_pages(pages).first()["fetched"].startswith("2024-")
