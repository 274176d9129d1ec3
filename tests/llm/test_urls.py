import re

from vacantia.llm import urls


def judge(spark, pages, outcomes, **options):
    table = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, host string")
    known = spark.createDataFrame(outcomes, "host string, bad int")
    return {r["page_id"]: r for r in urls.judge_urls(table, known, **options).collect()}


URLS = [
    "https://Example.ORG/es/1", "http://a.example.org/en/12?x", "http://a.example.org/en/2", "http://org",
    "http://www.shop.com/de/", "http://shop.com/fr/9#x", "http://notexample.org/es/1", "http://com/de/1",
    "no scheme", None, "", "://", "x://h?://g/de/", "http://u@H.com:80/de/a", "HTTP://É.Com/de/\n1?q", "a://b.com?/de/",
]


def plain(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    found = [
        rule for rule in urls.RULES
        if (host == rule.split("/")[0] or host.endswith("." + rule.split("/")[0]))
        and path.startswith("/" + rule.split("/", 1)[1])
    ]
    return host, path, max(found, key=len, default=None)


def test_hosts_paths_and_rules(spark):
    got = judge(spark, list(enumerate(URLS)), [])
    for i, url in enumerate(URLS):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == plain(url)
        assert got[i]["verdict"] == urls.RULES.get(got[i]["rule"], "allow")


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = judge(spark, [(r["page_id"], r["url"]) for r in pages.collect()], [])
    assert all((got[r["page_id"]]["host"], got[r["page_id"]]["path"], got[r["page_id"]]["rule"]) == plain(r["url"]) for r in pages.collect())


def test_reputation_shrinks_from_host_to_domain_to_suffix(spark):
    outcomes = [("bad.spam.net", 1)] * 60 + [("worse.spam.net", 1)] * 40 + [("ok.fine.net", 0)] * 90
    outcomes += [("few.fine.net", 1)] * 2 + [("site.info", 0)] * 50 + [("x.co.uk", 1), (None, 1), ("y.info", None)]
    pages = [
        (1, "http://bad.spam.net/a"), (2, "http://new.spam.net/a"), (3, "http://few.fine.net/a"),
        (4, "http://other.info/"), (5, "http://unknown.xyz/"), (6, "http://ok.fine.net/"),
    ]
    got = judge(spark, pages, outcomes)
    assert {i: got[i]["verdict"] for i in got} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow"}
    assert got[2]["lower_bound"] < got[1]["lower_bound"] and got[5]["lower_bound"] is None
    assert got[6]["lower_bound"] < got[3]["lower_bound"] < 0.5


def test_posteriors_by_hand(spark):
    outcomes = [("a.x.net", 1)] * 3 + [("a.x.net", 0)] + [("b.y.net", 0)] * 6
    rows = {
        (r["level"], r["name"]): (r["alpha"], r["beta"])
        for r in urls.host_reputation(spark.createDataFrame(outcomes, "host string, bad int")).collect()
    }
    # One suffix can't vary, so its prior is as strong as it gets.
    mean, strength = 4 / 12, urls.STRENGTH_RANGE[1]
    assert rows["suffix", "net"] == (3 + strength * mean, 7 + strength * (1 - mean))
    n, bad, squares, between, spare = 10, 3, 16 + 36, 9 / 4, 1
    noise = bad / n * (1 - bad / n)
    share = (between - bad * bad / n - noise * spare) / (noise * (n - squares / n - spare))
    k = min(strength, max(2.0, 1 / share - 1))
    suffix = rows["suffix", "net"][0] / sum(rows["suffix", "net"])
    assert abs(rows["domain", "x.net"][0] - (3 + k * suffix)) < 1e-9
    domain = rows["domain", "x.net"][0] / sum(rows["domain", "x.net"])
    assert abs(rows["host", "a.x.net"][0] - (3 + k * domain)) < 1e-9


def test_domains_and_suffixes(spark):
    rows = spark.createDataFrame([("a.b.co.uk",), ("co.uk",), ("b.c.net",), ("net",), ("",)], "h string")
    got = rows.select("h", urls.domain(rows["h"]), urls.suffix(rows["h"])).collect()
    assert [tuple(r) for r in got] == [
        ("a.b.co.uk", "b.co.uk", "co.uk"), ("co.uk", "co.uk", "co.uk"), ("b.c.net", "c.net", "net"), ("net", "net", "net"), ("", "", ""),
    ]


def test_edges(spark):
    assert judge(spark, [], []) == {}
    rows = judge(spark, [(None, None)], [("", 1)] * 9)
    assert rows[None]["host"] == "" and rows[None]["rule"] is None
    table = spark.createDataFrame([(1, "http://a.net/")] * 3, "page_id long, url string")
    assert urls.judge_urls(table, spark.createDataFrame([], "host string, bad int")).count() == 3
