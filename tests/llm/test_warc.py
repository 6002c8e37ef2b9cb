"""Operator 4: exact round trip, and look-ups by URL."""

import hashlib

from quarry.llm import warc as W

SCHEMA = "page_id bigint, url string, html string, key string, file int"


def rows():
    big = "<p>é</p>" * 40
    out = [(7, "http://b.example/x", big), (3, "http://a.example/y?q=1", big), (9, None, big), (4, "http://a.example/", "short"),
           (5, "http://a.example/", "short"), (1, "", None), (2, "http://a.b.example:8080/z\nz", "x" * 100), (6, "http://[bad", "x" * 100),
           (8, "http://a.example/", "y" * 300_000), (3, "http://a.example/y?q=1", big), (None, "http://n.example/", big)]
    return [(*r, "k", None) for r in out]


def test_round_trip(spark):
    got = sorted((tuple(r) for r in W.round_trip(spark.createDataFrame(rows(), SCHEMA)).collect()), key=str)
    low = {}
    for i, _, h, *_ in rows():
        if i is not None:
            low[h] = min(i, low.get(h, i))
    want = []
    for i, _, h, *_ in rows():
        p = (h or "").encode()
        again = len(p) >= 100 and i != low[h]
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", low[h] if again else None))
    assert got == sorted(want, key=str)


def lookups(spark, directory, urls, **options):
    df = spark.createDataFrame([(u, 1) for u in urls], "url string, key int")
    return sorted((tuple(r) for r in W.read_records(W.lookup(directory, df, **options)).collect()), key=str)


def test_lookup(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    folder = W._folder(spark)
    directory = W.write_index(W.write_archives(df, folder), folder, block=2)
    assert directory.count() >= 6
    found = lookups(spark, directory, ["http://A.example/", "https://www.a.example/", "http://none.example/"])
    assert [(r[0], r[2]) for r in found] == [(4, 5), (5, 5), (8, 300_000)]
    assert lookups(spark, directory, ["http://none.example/", "zzz://q"]) == [] == lookups(spark, directory, [])
    assert [r[0] for r in lookups(spark, directory, [None])] == [1, 9]
    assert W.url_key("http://www.a.example.org:80/x?y#z") == "org,example,a)/x?y"
    assert W.url_key("http://[bad\tx\n") == ")http://[bad%09x%0A"
    whole = sorted((tuple(r) for r in W.read_records(W.scan(directory)).collect()), key=str)
    assert lookups(spark, directory, [r[1] for r in rows()]) == whole and len(whole) == len(rows())


def test_lookup_equals_scan(spark):
    """Hot keys over many blocks, borders inside a key, fences thinner than blocks."""
    import random

    rnd = random.Random(4)
    urls = [rnd.choice(["http://hot.example/", f"http://h{rnd.randrange(9)}.example/{rnd.randrange(30)}", f"http://[{rnd.randrange(5)}\t\n"])
            for _ in range(400)]
    df = spark.createDataFrame([(i, u, "x", "k", None) for i, u in enumerate(urls)], SCHEMA)
    folder = W._folder(spark)
    directory = W.write_index(W.write_archives(df, folder), folder, block=3)
    assert directory.where("first_key = last_key").count() > 20
    ask = rnd.sample(sorted(set(urls)), 90) + ["http://hot.example/", "http://absent.example/", ""]
    keys = {W.url_key(u) for u in ask}
    want = sorted(i for i, u in enumerate(urls) if W.url_key(u) in keys)
    for most in (4096, 7, 1):
        assert sorted(r[0] for r in lookups(spark, directory, ask * 2, most=most)) == want


def test_empty_table(spark):
    assert W.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
