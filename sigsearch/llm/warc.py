"""Not-modified revisits of a web archive, resolved to the full responses they repeat.

A revisit has headers but no body.  It stands for the latest earlier full response of the same canonical URL, if
its validators agree; its permitted headers then replace those of the response.  The as-of join is a carry
forward over rows that are range-partitioned by URL and time, so one URL may fill many tasks: what a task needs
from before its first row is the last response of one earlier task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigsearch.llm.common import ready, task_id, written

# --- fixed values: header fields that a not-modified answer may update --------------------------------
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
# ------------------------------------------------------------------------------------------------------
ROWS_PER_TASK = 250_000
RECORDS = "record_id long, url string, at long, kind string, headers map<string,string>, digest string"


def canonical_url(url: Column) -> Column:
    """One spelling for addresses of one page.

    Without scheme, user and fragment; host in lower case without ``www.`` and the default ports; no slash at the
    end of the path; query fields sorted, those that only track a visit left out.  Null stays null.
    """
    plain = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    plain = F.regexp_replace(plain, r"^(?i)https?://", "")
    host = F.lower(F.regexp_extract(plain, r"(?s)^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(80|443)$", "")
    host = F.regexp_replace(host, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(plain, r"(?s)^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(plain, r"(?s)^[^?]*\?(.*)$", 1)
    fields = F.array_sort(F.filter(F.split(query, "&"), lambda f: (f != "") & ~f.rlike(r"^(?i)(utm_[a-z]+|gclid|fbclid)(=|$)")))
    return F.concat(host, path, F.when(F.size(fields) > 0, F.concat(F.lit("?"), F.array_join(fields, "&"))).otherwise(""))


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that then repeat, the last value in the order of the names counts."""
    entries = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    named = F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(named, lambda e: ~F.exists(named, lambda o: (o["key"] == e["key"]) & (o["value"] > e["value"])))
    return F.map_from_entries(F.array_distinct(last))


def _carry(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number of the latest earlier response within this task, and each task's last one (for the task behind)."""
    part, page, last = task_id(), None, None
    for frame in frames:
        refers = []
        for key, kind, number in zip(frame["page"], frame["kind"], frame["record_id"], strict=True):
            if key != page:
                page, last = key, None
            refers.append(last)
            if kind == "response":
                last = number
        yield pd.DataFrame({"record_id": frame["record_id"], "page": frame["page"], "kind": frame["kind"],
                            "refers_to": pd.array(refers, "Int64"), "part": part})


def resolve(records: DataFrame) -> DataFrame:
    """One row for every revisit: (record_id, page, refers_to, status, headers, digest).

    ``records`` has the columns of RECORDS and may have others, which are not read; ``kind`` is response or revisit
    (others are left out).  ``refers_to`` is the latest response of the same canonical URL that stands before the
    revisit by (at, record_id), whatever became of its validators.  ``status``: ``resolved``; ``mismatch`` if an
    entity tag (compared weakly), or without tags a modification date, or without either the payload digest
    differs or nothing can be compared; ``orphan`` without any earlier response.  ``headers`` are the response's, permitted fields replaced by the
    revisit's, if resolved, else the revisit's own; ``digest`` the response's if resolved.  Rows with a null URL,
    time or id cannot be placed and are orphans.  Record ids are taken as unique; exact repeats count once.
    """
    spark = records.sparkSession
    ready(spark)
    rows = records.select(
        "record_id", "at", "kind", lower_keys(F.col("headers")).alias("headers"), "digest",
        canonical_url(F.col("url")).alias("page")).where(F.col("kind").isin("response", "revisit"))
    rows = written(rows, "records")
    placed = F.col("page").isNotNull() & F.col("at").isNotNull() & F.col("record_id").isNotNull()
    keys = rows.where(placed).select("page", "at", "record_id", "kind").distinct()
    tasks = max(spark.sparkContext.defaultParallelism, keys.count() // ROWS_PER_TASK)
    order = ["page", "at", "record_id"]
    ordered = keys.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    carried = written(ordered.mapInPandas(_carry, "record_id long, page string, kind string, refers_to long, part int"), "carried")

    # what a task hands to the next: one row a task, filled forward along the tasks of one page
    edge = carried.groupBy("part").agg(
        F.min("page").alias("first"), F.max("page").alias("page"))
    ends = carried.where("kind = 'response'").join(F.broadcast(edge.select("part", "page")), ["part", "page"])
    latest = written(_latest(ends, rows), "latest")
    handed = edge.join(latest, "part", "left").select("part", "first", "page", "response")
    run = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a task
    past = handed.select(
        "part", "first", F.last(F.when(F.col("response").isNotNull(), F.struct("page", "response")), ignorenulls=True).over(run).alias("past"))
    past = past.where("past.page = first").select("part", F.col("first").alias("page"), F.col("past.response").alias("before"))
    refers = carried.where("kind = 'revisit'").join(F.broadcast(past), ["part", "page"], "left").select(
        "record_id", F.coalesce("refers_to", "before").alias("refers_to"))

    theirs = rows.where(placed & (F.col("kind") == "response")).select(
        F.col("record_id").alias("refers_to"), F.col("headers").alias("full"), F.col("digest").alias("payload")).dropDuplicates(["refers_to"])
    mine = rows.where(placed & (F.col("kind") == "revisit")).dropDuplicates(["record_id"])
    met = mine.join(refers, "record_id", "left").join(theirs, "refers_to", "left")
    lost = rows.where(~placed & (F.col("kind") == "revisit")).select(
        "record_id", "page", F.lit(None).cast("long").alias("refers_to"), F.lit("orphan").alias("status"), "headers",
        F.lit(None).cast("string").alias("digest"))
    status = F.when(F.col("refers_to").isNull(), "orphan").when(_agree(), "resolved").otherwise("mismatch")
    good = F.col("status") == "resolved"
    merged = F.map_concat(
        F.map_filter("full", lambda k, _: ~F.array_contains(F.map_keys(_kept("headers")), k)), _kept("headers"))
    done = met.withColumn("status", status).select(
        "record_id", "page", "refers_to", "status", F.when(good, merged).otherwise(F.col("headers")).alias("headers"),
        F.when(good, F.col("payload")).alias("digest"))
    return done.unionByName(lost)


def _latest(ends: DataFrame, rows: DataFrame) -> DataFrame:
    """(part, response): the last response of the page that a task ends with."""
    times = rows.where("kind = 'response'").select("record_id", "at")
    return ends.join(times, "record_id").groupBy("part").agg(F.max(F.struct("at", "record_id")).alias("x")).select(
        "part", F.col("x.record_id").alias("response"))


def _kept(headers: str) -> Column:
    return F.map_filter(headers, lambda k, _: k.isin(*PERMITTED))


def _agree() -> Column:
    def weak(c: Column) -> Column:
        return F.regexp_replace(c, "^W/", "")

    tag, other = F.col("headers")["etag"], F.col("full")["etag"]
    date, then = F.col("headers")["last-modified"], F.col("full")["last-modified"]
    both = F.when(tag.isNotNull() & other.isNotNull(), weak(tag) == weak(other)).when(
        date.isNotNull() & then.isNotNull(), date == then).otherwise(F.col("digest") == F.col("payload"))
    return F.coalesce(both, F.lit(False))


def with_bodies(resolved: DataFrame, bodies: DataFrame) -> DataFrame:
    """Resolved revisits with the body of the response they stand for (``bodies``: record_id, body)."""
    theirs = bodies.select(F.col("record_id").alias("refers_to"), "body")
    return resolved.where("status = 'resolved'").join(theirs, "refers_to")


def header_text(headers: Column) -> Column:
    """Headers as lines, sorted by name."""
    entries = F.array_sort(F.map_entries(headers))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")


def derived_records(pages: DataFrame) -> DataFrame:
    """A crawl log from a table of pages: each page fetched in full, some again in full, most revisited.

    Times and kinds follow from the page's number.  Every fifth page is fetched anew later, with other content; each
    page but every seventh has revisits before and after, of which some bring other validators or only a date.
    """
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 12), F.lit('"'))
    day = F.col("page_id") % 97
    visits = F.filter(F.array(
        F.struct(F.lit(0).alias("n"), F.lit("response").alias("kind"), (day * 10).alias("at")),
        F.struct(F.lit(1).alias("n"), F.lit("revisit").alias("kind"), (day * 10 + F.col("page_id") % 40 - 5).alias("at")),
        F.struct(F.lit(2).alias("n"), F.lit("response").alias("kind"), (day * 10 + 20).alias("at")),
        F.struct(F.lit(3).alias("n"), F.lit("revisit").alias("kind"), (day * 10 + F.col("page_id") % 60).alias("at")),
    ), lambda v: F.when(v["n"] == 2, F.col("page_id") % 5 == 0).when(v["n"] == 0, True).otherwise(F.col("page_id") % 7 != 6))
    rows = pages.select("page_id", "url", "html", tag.alias("tag"), F.explode(visits).alias("v"))
    number = F.col("page_id") * 4 + F.col("v.n")
    own = F.when(F.col("v.n") == 2, F.concat(F.lit('"new-'), F.substring("tag", 2, 20))).when(
        (F.col("v.kind") == "revisit") & (F.col("page_id") % 11 == 3), F.lit('"gone"')).when(
        (F.col("v.kind") == "revisit") & (F.col("page_id") % 3 == 1), F.concat(F.lit("W/"), F.col("tag"))).otherwise(F.col("tag"))
    own = F.when((F.col("v.kind") == "revisit") & (F.col("page_id") % 13 == 5), F.lit(None)).otherwise(own)
    headers = F.map_filter(F.create_map(
        F.lit("Date"), F.concat(F.lit("t"), F.col("v.at").cast("string")), F.lit("ETag"), own,
        F.lit("Last-Modified"), F.when(F.col("page_id") % 4 != 0, F.concat(F.lit("d"), day.cast("string"))),
        F.lit("Content-Type"), F.when(F.col("v.kind") == "response", "text/html").otherwise("text/plain"),
        F.lit("Cache-Control"), F.when(F.col("v.n") != 1, F.concat(F.lit("max-age="), number.cast("string")))),
        lambda _, x: x.isNotNull())
    body = F.when(F.col("v.n") == 2, F.concat("html", F.lit("2"))).when(F.col("v.kind") == "response", F.col("html"))
    digest = F.when(F.col("v.kind") == "response", F.md5(F.coalesce(body, F.lit("")))).otherwise(F.md5(F.coalesce("html", F.lit(""))))
    return rows.select(number.alias("record_id"), "url", F.col("v.at").alias("at"), F.col("v.kind").alias("kind"),
                       headers.alias("headers"), digest.alias("digest"))
