import datetime
import random

from pyspark.sql import functions as F

from slipscope.llm import url_lists as u

DAY = lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)


def test_hosts_and_segments(spark):
    cases = [
        ("http://a.Example.com/x/y?q", "a.example.com", "x"), ("https://u:p@b.org:8080", "b.org", ""), ("ftp://c.net./", "c.net", ""), ("HTTP://d.e?x=/y", "d.e", ""),
        ("no url", None, ""), ("", None, ""), (None, None, ""), ("http:///path", None, "path"), ("http://localhost/z#f", "localhost", "z"),
    ]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, url string").select("i", u.host(F.col("url")).alias("h"), u.segment(F.col("url")).alias("s")).collect()
    assert {r.i: (r.h, r.s) for r in rows} == {i: c[1:] for i, c in enumerate(cases)}


def test_as_of_join_equals_brute_force(spark):
    r = random.Random(6)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "c", "hot.net"]
    captures = [(i, "https://%s/%s/z" % (r.choice(hosts + ["hot.net"] * 6), r.choice(["de", "en", ""])), DAY(r.randrange(60)), "key", i) for i in range(300)]
    captures += [(900, None, DAY(1), "key", 0), (901, "https://a.com/", None, "key", 0), (902, "junk", DAY(3), "key", 0), captures[0], captures[0]]
    names = ["domain:" + h for h in hosts] + ["prefix:a.com/de", "prefix:hot.net/en", "domain:com"]
    events = [(r.choice(names), r.choice(["add", "remove"]), DAY(r.randrange(60))) for _ in range(80)]
    got = u.evaluate(spark.createDataFrame(captures, "id long, url string, fetched date, key string, host_id long"), spark.createDataFrame(events + [(None, "add", DAY(0)), ("domain:b.org", "other", DAY(0)), ("domain:b.org", "add", None)], "key string, action string, at date"))

    def active(key, day):
        past = sorted((at, act) for k, act, at in events if k == key and at <= day)
        return bool(past) and past[-1][1] == "add"

    def want(url, day):
        if not url or not day or "//" not in url:
            return 0, None
        host, seg = url.split("/")[2], url.split("/")[3]
        parts = host.split(".")
        keys = {"domain:" + ".".join(parts[k:]) for k in range(max(1, len(parts) - 1))} | {f"prefix:{host}/{seg}"}
        hit = sorted(k for k in keys if active(k, day))
        return len(hit), hit[0] if hit else None

    rows = got.collect()
    assert len(rows) == len(captures) and got.columns[:5] == ["id", "url", "fetched", "key", "host_id"]
    assert all((x.n_entries, x.entry) == want(x.url, x.fetched) for x in rows)


def test_empty_tables(spark):
    captures = spark.createDataFrame([(1, "http://a.b/c", DAY(0))], "id long, url string, fetched date")
    events = spark.createDataFrame([], "key string, action string, at date")
    assert u.evaluate(captures, events).first().n_entries == 0 and u.evaluate(captures.limit(0), events).count() == 0
