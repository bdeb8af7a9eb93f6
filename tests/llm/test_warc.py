import random

import pytest
from pyspark.sql import functions as F

from sigsearch.llm import warc

SCHEMA = "record_id long, url string, at long, kind string, headers map<string,string>, digest string, page string, part string"


@pytest.mark.parametrize("url, page", [
    ("https://www.Example.com:443/a/b/?b=2&utm_source=x&a=1#top", "example.com/a/b?a=1&b=2"),
    ("HTTP://user@example.com", "example.com"), ("example.com/A?gclid=3", "example.com/A"), ("http://x.org/?", "x.org"), (None, None), ("", ""),
])
def test_canonical_urls(spark, url, page):
    assert spark.createDataFrame([(url,)], "u string").select(warc.canonical_url(F.col("u"))).first()[0] == page


def brute(rows):
    """Resolution row by row."""
    out = {}
    for r in rows:
        number, page, at, kind, headers, digest = r
        if kind != "revisit":
            continue
        headers = {k.lower(): v for k, v in (headers or {}).items()}
        if None in (number, page, at):
            out[number] = (None, "orphan", headers, None)
            continue
        earlier = [q for q in rows if q[3] == "response" and q[1] == page and None not in (q[0], q[2]) and (q[2], q[0]) < (at, number)]
        if not earlier:
            out[number] = (None, "orphan", headers, None)
            continue
        full = max(earlier, key=lambda q: (q[2], q[0]))
        theirs = {k.lower(): v for k, v in (full[4] or {}).items()}
        if "etag" in headers and "etag" in theirs:
            same = headers["etag"].removeprefix("W/") == theirs["etag"].removeprefix("W/")
        elif "last-modified" in headers and "last-modified" in theirs:
            same = headers["last-modified"] == theirs["last-modified"]
        else:
            same = digest is not None and digest == full[5]
        merged = theirs | {k: v for k, v in headers.items() if k in warc.PERMITTED}
        out[number] = (full[0], "resolved", merged, full[5]) if same else (full[0], "mismatch", headers, None)
    return out


def test_resolution_equals_brute_force_with_a_hot_page(spark, monkeypatch):
    monkeypatch.setattr(warc, "ROWS_PER_TASK", 40)  # a third of the rows, one page, spans many tasks
    rng = random.Random(6)
    rows = []
    for i in range(900):
        page = "hot.example" if rng.random() < 0.4 else f"p{rng.randrange(60)}.example"
        headers = {k: v for k, v in (("ETag", rng.choice(['"1"', 'W/"1"', '"2"', None])), ("Last-Modified", rng.choice(["d1", "d2", None])),
                                     ("Content-Type", "text/html"), ("Date", f"t{i}")) if v is not None}
        rows.append((i, page, rng.randrange(200), "response" if rng.random() < 0.05 else "revisit", rng.choice([headers, headers, None]), rng.choice(["x", "y", None])))
    rows += [(2000, None, 5, "revisit", None, "x"), (2001, "hot.example", None, "revisit", {"Date": "t"}, None), (2002, "hot.example", 3, "metadata", None, None)]
    frame = spark.createDataFrame([(n, p and f"http://www.{p}/", at, k, h, d, "clash", "clash") for n, p, at, k, h, d in rows], SCHEMA)
    found = {r.record_id: (r.refers_to, r.status, r.headers, r.digest) for r in warc.resolve(frame).collect()}
    assert found == brute(rows)
    bodies = frame.where("kind = 'response'").select("record_id", F.col("digest").alias("body"))
    merged = warc.with_bodies(warc.resolve(frame), bodies)
    assert merged.count() == sum(x[1] == "resolved" for x in found.values())


def test_empty_table(spark):
    assert warc.resolve(spark.createDataFrame([], SCHEMA)).collect() == []
