import random

from lectern.llm import urls

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[cut:]
    end = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:cut].translate(LOWER), path[:end]


def plain(url, rules):
    host, path = parts(url)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


URLS = [
    "http://www.example.com/en/1", "https://EXAMPLE.com/en/x?y=/fr/", "http://a.b.example.com/en/", "http://example.com/e", "http://example.com", "http://x.net/es/", "http://x.net/esp",
    "http://notexample.com/en/", "http://net/fr/#z", "no scheme", None, "", "http://", "://com/", "http://com/", "http://a.com?x", "http://É.net/fr/", "http://..com/en/", "x" * 5000 + "://com/" + "y" * 90_000,
]


def test_verdicts_equal_the_plain_version(spark):
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(URLS)], "page_id bigint, url string, host string, rule string")
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, rules).collect()}
    assert got == {i: plain(u, urls.RULES) for i, u in enumerate(URLS)}


def test_random_rules_small_and_large_lists(spark, monkeypatch):
    rnd = random.Random(1)
    host = lambda: ".".join(rnd.choice(["a", "b", "com", "net"]) for _ in range(rnd.randint(1, 4)))
    path = lambda: "/" + "/".join(rnd.choice(["x", "y", "xy"]) for _ in range(rnd.randint(0, 3)))
    rules = list({(h, p): (h, p, rnd.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(60))}.values())
    found = [f"http://{host()}{path()}" for _ in range(200)]
    pages = spark.createDataFrame(list(enumerate(found)), "page_id bigint, url string")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = {i: plain(u, rules) for i, u in enumerate(found)}
    for limit in (urls.BROADCAST_RULES, 3):
        monkeypatch.setattr(urls, "BROADCAST_RULES", limit)
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, frame).collect()}
        assert got == want


def test_repeated_rows_and_empty_tables(spark):
    rules = spark.createDataFrame(urls.RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://com/"), (1, "http://com/"), (1, "http://x.net/fr/"), (None, None)], "page_id bigint, url string")
    assert sorted((str(r["page_id"]), r["verdict"]) for r in urls.judge_urls(pages, rules).collect()) == [("1", "allow"), ("1", "allow"), ("1", "block"), ("None", "allow")]
    assert urls.judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
