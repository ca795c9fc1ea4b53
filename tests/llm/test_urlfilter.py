import datetime as dt
import random

from tagwright.llm import urlfilter


def d(day):
    return dt.date(2020, 1, 1) + dt.timedelta(days=day)


def brute(captures, entries):
    out = []
    for i, url, day in captures:
        best = ""
        host, _, path = (url.split("://", 1)[1] if url and "://" in url else "").partition("/")
        host = host.lower()
        segs = [s for s in path.split("?")[0].split("#")[0].split("/") if s]
        keys = {".".join(host.split(".")[k:]) for k in range(host.count(".") + 1)} | {host + "/" + "/".join(segs[:k + 1]) for k in range(len(segs))}
        for p in {e[0] for e in entries if e[0]}:
            state = [(day2, a == "block") for q, day2, a in entries if q and q.lower() == p.lower() and day2 is not None and day is not None and day2 <= day]
            if host and p.lower() in keys and state and max(state)[1]:
                best = max(best, p.lower(), key=lambda x: (len(x), x))
        out.append((i, bool(best), best or None))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    hosts = ["a.example.com", "b.example.com", "example.com", "x.y.b.example.com", "other.org"]
    urls = [f"http://{h}{p}" for h in hosts for p in ("", "/", "/en", "/en/1?x=/fr", "/fr/2#en", "//en//1")] + [None, "", "nonsense", "HTTP://B.Example.com/en"]
    captures = [(i, rng.choice(urls), rng.choice([None] + list(range(0, 900, 7)))) for i in range(400)]
    patterns = ["example.com", "b.example.com", "b.example.com/en", "EXAMPLE.com", "org", "a.example.com/en/1", None]
    entries = [(rng.choice(patterns), rng.choice([None] + list(range(0, 900, 3))), rng.choice(["block", "allow"])) for _ in range(120)]
    got = urlfilter.filter_urls(
        spark.createDataFrame([(i, u, None if x is None else d(x)) for i, u, x in captures], "id int, url string, fetched date").repartition(4),
        spark.createDataFrame([(p, None if x is None else d(x), a) for p, x, a in entries], "pattern string, date date, action string"))
    assert sorted(((r["id"], r["blocked"], r["pattern"]) for r in got.collect()), key=str) == brute(captures, entries)


def test_ties_repeats_and_empty(spark):
    schema = "url string, fetched date, blocked int, _id string"
    rows = [("http://a.com/", d(5), 1, "x")] * 3 + [("http://a.com/", None, None, None), (None, d(5), 1, "y")]
    captures = spark.createDataFrame(rows, schema)
    entries = spark.createDataFrame([("a.com", d(5), "allow"), ("a.com", d(5), "block"), ("a.com", d(5), "block")], "pattern string, date date, action string")
    got = urlfilter.filter_urls(captures, entries)
    assert got.columns == ["url", "fetched", "_id", "blocked", "pattern"]
    assert sorted(r["blocked"] for r in got.collect()) == [False, False, True, True, True]
    assert urlfilter.filter_urls(captures.limit(0), entries).count() == 0
    assert urlfilter.filter_urls(captures, entries.limit(0)).where("blocked").count() == 0
