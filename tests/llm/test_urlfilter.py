from datetime import date, timedelta


from hazeline.llm import urlfilter
from tests.oracle import compare, duck

DAY = date(2024, 1, 1)


def day(k):
    return None if k is None else DAY + timedelta(k)


def brute(captures, entries):
    out = []
    for page, url, at in captures:
        hits = []
        if url and at is not None and "://" in url:
            host, _, path = url.split("://")[1].partition("/")
            labels, steps = host.lower().split("."), [s for s in path.split("?")[0].split("#")[0].split("/") if s]
            keys = {"d:" + ".".join(labels[k:]) for k in range(len(labels))} | {f"p:{host.lower()}/" + "/".join(steps[: k + 1]) for k in range(len(steps))}
            for name, key in {(n, k) for n, k, _, _ in entries if k in keys}:
                known = [(d, not added) for n, k, d, added in entries if (n, k) == (name, key) and d is not None and d <= at]
                if known and not max(known)[1]:
                    hits.append(name)
        out.append((page, url, at, len(hits), ",".join(sorted(set(hits))), bool(hits)))
    return sorted(out, key=str)


def test_odd_rows(spark):
    entries = [
        ("bad", "d:evil.example", 10, True), ("bad", "d:evil.example", 10, True), ("bad", "d:evil.example", 40, False), ("bad", "d:evil.example", 300, True),
        ("worse", "p:a.evil.example/x/y", 0, True), ("worse", "d:tie.example", 5, True), ("worse", "d:tie.example", 5, False), ("worse", None, 1, True), ("worse", "d:tie.example", None, True), ("worse", "d:com", 200, True),
    ]
    entries += [("flips", "d:hot.example", k, k % 2 == 0) for k in range(0, 365, 3)]
    urls = ["http://EVIL.example/", "https://a.evil.example/x/y/z?q#f", "http://a.evil.example/x", "http://notevil.example/", "http://tie.example", None, "no address", "", "http://x.com/a"]
    captures = [(k, urls[k % len(urls)], k * 7 % 366) for k in range(60)] + [(900 + k, f"http://hot.example/{k % 4}", k * 11 % 366) for k in range(100)] + [(1, urls[1], None), (None, urls[1], 3), (2, urls[2], 14), (2, urls[2], 14)]
    frame = spark.createDataFrame([(p, u, day(d), 1, "z") for p, u, d in captures], "page_id bigint, url string, fetched_on date, n_active int, key string").repartition(3)
    listed = spark.createDataFrame([(n, k, day(d), a) for n, k, d, a in entries], "list_name string, key string, listed_on date, added boolean")
    found = urlfilter.evaluated(frame, listed)
    expected = brute([(p, u, day(d)) for p, u, d in captures], [(n, k, day(d), a) for n, k, d, a in entries])
    assert sorted((tuple(r) for r in found.collect()), key=str) == expected
    assert urlfilter.evaluated(frame.limit(0), listed).count() == 0
    assert urlfilter.evaluated(frame, listed.limit(0)).filter("blocked").count() == 0


def test_intervals(spark):
    rows = [("l", "k", 1, True), ("l", "k", 3, True), ("l", "k", 5, False), ("l", "k", 7, False), ("l", "k", 9, True)]
    found = urlfilter.intervals(spark.createDataFrame([(n, k, day(d), a) for n, k, d, a in rows], "list_name string, key string, listed_on date, added boolean"))
    assert sorted((r.since, r.until) for r in found.collect()) == [(day(1), day(5)), (day(9), None)]


def test_sql(spark):
    from hazeline.llm.queries import ORACLES, QUERIES

    sf = "/root/testdata/sf0.01"
    assert compare(QUERIES["op6_temporal_url_lists"](spark, sf), ORACLES["op6_temporal_url_lists"], duck(sf)) == []
