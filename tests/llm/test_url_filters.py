import random

from wedgeworks.llm.url_filters import RULES, filter_urls

TYPE = "verdict string, host string, path string"


def brute(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
    fits = [(len(h + p), v, h + p) for v, h, p in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, default
    _, verdict, rule = max(fits)
    return host, path, rule, verdict


def check(spark, urls, rules, **more):
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' as host", "1 as verdict", "2 as key")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in filter_urls(pages, spark.createDataFrame(rules, TYPE), **more).collect()}
    assert got == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_contract_rules_and_odd_urls(spark):
    urls = [
        None, "", "no scheme/org/", "http://", "http:///x", "http://ORG/", "http://org", "https://example.org/es/a?b=/en/1", "https://m.example.org/es/", "https://notexample.org/es/",
        "http://example.org/en/12#f", "ftp://a.com/fr/://b", "http://com/de/x", "http://x.com?/fr/", "http://x.com#/de/", "http://É.com/de/", "http://a.b.c.d.e.example.org/en/1",
        "http://.org/", "http://a..org/", "http://org./", "http://example.org:80/es/", "x" * 100_000 + "://y.com/de/",
    ]
    check(spark, urls + urls[:9], RULES)
    check(spark, urls + urls[:9], RULES, hot_rows=2)  # some hosts are hot, some of them without rules


def test_nested_rules_over_many_cells_and_salts(spark):
    rng = random.Random(4)
    label = lambda: rng.choice(["a", "b", "ab", "c-d", "a0", "z"])
    host = lambda n: ".".join(label() for _ in range(n))
    rules = sorted({(host(rng.randint(1, 4)), rng.choice(["/", "/x", "/x/y", ""])) for _ in range(60)})
    rules = [(rng.choice(["allow", "block"]), h, p) for h, p in rules]
    urls = [f"http://{host(rng.randint(1, 6))}{rng.choice(['', '/', '/x', '/x/y/z', '/y'])}" for _ in range(400)]
    check(spark, urls, rules)
    from wedgeworks.llm.url_filters import host_of, sweep
    from pyspark.sql import functions as F

    hosts = spark.createDataFrame([(u,) for u in urls], "url string").select(host_of(F.col("url")).alias("host")).distinct()
    frame = spark.createDataFrame(rules, TYPE)
    few = lambda n: sorted((r.host, sorted(map(tuple, r.active))) for r in sweep(hosts, frame, n).collect())
    assert few(3) == few(10**6) != []


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    assert filter_urls(none, spark.createDataFrame(RULES, TYPE)).count() == 0
    assert filter_urls(spark.createDataFrame([(1, "http://a.com/de/")], "page_id long, url string"), spark.createDataFrame([], TYPE)).first().verdict == "allow"
