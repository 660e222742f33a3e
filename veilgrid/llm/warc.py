"""Not-modified revisits of a crawl, resolved to the responses that they stand for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgrid.llm.frames import hash_128
from veilgrid.llm.urls import host_and_path
from veilgrid.session import cut_lineage

#: Headers of a not-modified answer that never replace the stored ones: they describe its own (empty) body or the hop.
NOT_MERGED = (
    "content-length", "content-encoding", "content-range", "content-type", "transfer-encoding", "connection", "keep-alive",
    "proxy-authenticate", "proxy-authorization", "te", "trailer", "upgrade",
)
#: Query parameters that follow a visitor and do not select a page.
TRACKING = "^(utm_[a-z]+|gclid|fbclid|ref)="


def canonical_url(url: Column) -> Column:
    """Host in lower case without user, default port and final dot, path without final slash, sorted query without tracking.

    The scheme and the fragment go. Null stays null; a url without ``://`` stays as it is.
    """
    host, path = host_and_path(url)
    host = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"\.?(:80|:443)?$", "")
    path = F.when(F.length(path) > 1, F.regexp_replace(path, "/+$", "")).otherwise(path)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.rlike(TRACKING)))
    full = F.concat(host, F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))
    return F.when(F.contains(url, F.lit("://")), full).otherwise(url)


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only, one value (the largest) stays. Null is no header."""
    entries = F.sort_array(F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    names = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.coalesce(F.map_from_entries(F.transform(names, lambda n: F.struct(
        n, F.element_at(F.filter(entries, lambda e: e["key"] == n), -1)["value"]))), F.create_map().cast("map<string,string>"))


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored response's headers, updated by what a not-modified answer may change."""
    permitted = F.map_filter(update, lambda k, v: ~k.isin(*NOT_MERGED) & v.isNotNull())
    kept = F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(permitted), k))
    return F.map_concat(kept, permitted)


def resolve_revisits(
    captures: DataFrame, *, record: str = "record_id", url: str = "url", ts: str = "ts", kind: str = "kind", headers: str = "headers",
) -> DataFrame:
    """One row per revisit: ``record``, ``canonical``, ``response`` (record id), ``outcome`` and merged ``headers``.

    ``captures`` has records of ``kind`` 'response' (full answers) and 'revisit' (not modified); others are left out.
    A revisit looks at the latest response of its canonical url with an earlier ``ts`` (of equal ts, the largest
    record id). Both their ETags must be equal (weakly: without ``W/``) or, where one of them has none, both their
    Last-Modified. Outcomes: 'resolved', 'validator_mismatch', 'no_validator' (nothing to compare), 'no_response'.
    Headers are merged where resolved, else null; the body is that of ``response``.

    As-of without a task per url: captures are range-partitioned by url hash, ts and record, so a url with any
    share of the captures lies over many partitions. Rows take the last response of their own partition; if there is none
    the last one of the url's partitions before, of which each gives one row.

    A null url is resolved with nothing, a null ts with nothing; null headers are none. Repeated records give a row each.
    """
    rows = captures.where(F.col(kind).isin("response", "revisit")).select(
        F.col(record).alias("record"), canonical_url(F.col(url)).alias("canonical"), F.col(ts).alias("ts"),
        (F.col(kind) == "response").alias("full"), lower_keys(F.col(headers)).alias("headers"))
    keyed = rows.withColumn("h", hash_128(F.col("canonical"))).withColumn(
        "answer", F.when(F.col("full") & F.col("ts").isNotNull() & F.col("canonical").isNotNull(), F.struct("record", "headers")))
    # of equal ts the revisits come first, so they do not see a response that is not earlier
    order = ["ts", "full", "record"]
    dealt = cut_lineage(keyed.repartitionByRange("h", *order).withColumn("part", F.spark_partition_id()), "captures")
    inside = Window.partitionBy("h", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("near", F.last("answer", ignorenulls=True).over(inside)).where("not full")
    ends = dealt.groupBy("h", "part").agg(F.max_by("answer", F.when(F.col("answer").isNotNull(), F.struct(*order))).alias("last"))
    carried = Window.partitionBy("h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("h", "part", F.last("last", ignorenulls=True).over(carried).alias("far"))
    found = near.join(ends, ["h", "part"]).withColumn(
        "base", F.when(F.col("ts").isNotNull() & F.col("canonical").isNotNull(), F.coalesce("near", "far")))
    tag = lambda h: F.regexp_replace(F.element_at(h, "etag"), "^W/", "")
    day = lambda h: F.element_at(h, "last-modified")
    stored, own = F.col("base.headers"), F.col("headers")
    outcome = (
        F.when(F.col("base").isNull(), "no_response")
        .when(tag(stored) == tag(own), "resolved").when(tag(stored) != tag(own), "validator_mismatch")
        .when(day(stored) == day(own), "resolved").when(day(stored) != day(own), "validator_mismatch")
        .otherwise("no_validator"))
    judged = found.withColumn("outcome", outcome)
    return judged.select(
        F.col("record").alias(record), "canonical", F.col("base.record").alias("response"), "outcome",
        F.when(F.col("outcome") == "resolved", merged_headers(stored, own)).alias("headers"))


def header_lines(headers: Column) -> Column:
    """``name: value`` lines in the order of names; null stays null."""
    return F.array_join(F.transform(F.array_sort(F.map_keys(headers)), lambda k: F.concat(k, F.lit(": "), F.element_at(headers, k))), "\n")


def crawl_of(pages: DataFrame) -> DataFrame:
    """Captures that a crawl of ``pages`` (page_id, url, html) gives: a full answer and a later not-modified one for each page.

    page_id counts the seconds of the first crawl. A page is asked again a day later with its ETag; every fifth
    answer has another tag, every seventh none and only a date, and every eleventh came a day before the page.
    """
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    day = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    full = pages.select(
        F.concat(F.lit("r"), "page_id").alias("record_id"), "page_id", "url", F.col("page_id").alias("ts"), F.lit("response").alias("kind"),
        F.create_map(
            F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"),
            F.lit("ETag"), tag, F.lit("Last-Modified"), day, F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"))
    changed, dated, early = (F.col("page_id") % n == 0 for n in (5, 7, 11))
    again = pages.select(
        F.concat(F.lit("v"), "page_id").alias("record_id"), "page_id", F.concat("url", F.lit("#again")).alias("url"),
        (F.col("page_id") + F.when(early, -86400).otherwise(86400)).alias("ts"), F.lit("revisit").alias("kind"),
        F.when(dated, F.create_map(F.lit("last-modified"), day, F.lit("Date"), F.lit("tomorrow"), F.lit("Content-Length"), F.lit("0"))).otherwise(
            F.create_map(F.lit("etag"), F.concat(F.lit("W/"), F.when(changed, F.lit('"changed"')).otherwise(tag)), F.lit("Cache-Control"),
                         F.lit("max-age=600"), F.lit("Content-Length"), F.lit("0"))).alias("headers"))
    return full.unionByName(again)
