"""Not-modified revisit resolution for web archives.

A revisit (a 304 answer) is joined as of its time to the latest earlier full response of its
canonical URL.  Its validators are then checked against that response, and the headers that a
304 may update are merged into the response's.

The as-of join is a union and a window, so it costs one sort and no pair enumeration.  Time is
cut into buckets: a window sees one URL and one bucket, and each bucket begins with the last
response of the buckets before it, which comes from a small aggregate.  So a URL that holds
a third of all captures is spread over its buckets.

Defined cases: a null or blank URL or a null time resolves to ``no_response``; a response at the very time of the
revisit is not earlier; of responses at one time the highest record id wins; a revisit without
any validator is ``unchecked`` (and merged); null header maps are empty; header names are
compared in lower case; repeated rows each report; an empty table gives no rows; extra columns
are ignored, whatever their names; a long URL or header map costs its own size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 must not change (RFC 9111, section 3.2, and framing fields).
KEPT_FIELDS = [
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
]
TRACKING = "^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host and path in one form: no scheme, ``www.``, default port, fragment, tracking parameters or final slash; sorted parameters."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    parts = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(""))


def _lowered(headers: Column) -> Column:
    """Field names in lower case; of names that differ in case only, the last in order stays."""
    pairs = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    return F.aggregate(
        pairs, F.create_map().cast("map<string,string>"),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != F.lower(e["key"])), F.create_map(F.lower(e["key"]), e["value"])),
    )


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored fields, with those that the 304 may update replaced or added."""
    stored, update = _lowered(stored), F.map_filter(_lowered(update), lambda k, _: ~k.isin(KEPT_FIELDS))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.map_contains_key(update, k)), update)


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, bucket_width: int = 3600) -> DataFrame:
    """One row per revisit: record_id, url_key, ts, response_id, verdict, payload_digest, headers.

    ``records`` has record_id, url, ts (long), kind (``response`` or ``revisit``), status, etag,
    last_modified, payload_digest and headers (map); other columns are ignored.  Only responses
    with status 200 are full.  Verdicts: resolved, unchecked, changed (a validator differs),
    no_response.
    """
    base = records.filter((F.col("kind") == "revisit") | ((F.col("kind") == "response") & (F.col("status") == 200)))
    base = base.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), F.col("ts").cast("long").alias("ts"), (F.col("kind") == "response").cast("int").alias("full"),
        F.floor(F.col("ts") / bucket_width).cast("long").alias("bucket"), F.struct("record_id", "etag", "last_modified", "payload_digest", "headers").alias("rec"),
    )
    placed = F.coalesce(F.col("url_key") != "", F.lit(False)) & F.col("ts").isNotNull()
    timed = base.filter(placed)
    lost = base.filter(~placed & (F.col("full") == 0))

    # the last response of each URL and bucket, carried to the next bucket in which the URL occurs
    latest = timed.groupBy("url_key", "bucket").agg(F.max_by(F.when(F.col("full") == 1, F.col("rec")), F.when(F.col("full") == 1, F.struct("ts", "record_id"))).alias("rec"))
    before = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = latest.select("url_key", "bucket", F.last("rec", ignorenulls=True).over(before).alias("rec")).filter("rec is not null")
    carried = carried.select(F.col("rec.record_id").alias("record_id"), "url_key", F.lit(None).cast("long").alias("ts"), F.lit(1).alias("full"), "bucket", "rec")

    inside = Window.partitionBy("url_key", "bucket").orderBy(F.col("ts").asc_nulls_first(), "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    found = timed.unionByName(carried).withColumn("response", F.last(F.when(F.col("full") == 1, F.col("rec")), ignorenulls=True).over(inside))
    rows = found.filter("full = 0").drop("full", "bucket").unionByName(lost.drop("full", "bucket").withColumn("response", F.lit(None).cast(lost.schema["rec"].dataType)))

    r, s = F.col("rec"), F.col("response")
    by_tag = F.when(r["etag"].isNotNull(), _strong(r["etag"]).eqNullSafe(_strong(s["etag"])))
    by_date = F.when(r["etag"].isNull() & r["last_modified"].isNotNull(), r["last_modified"].eqNullSafe(s["last_modified"]))
    by_digest = F.when(r["payload_digest"].isNotNull(), r["payload_digest"].eqNullSafe(s["payload_digest"]))
    none = F.coalesce(r["etag"], r["last_modified"], r["payload_digest"]).isNull()
    agrees = F.coalesce(by_tag, by_date, F.lit(True)) & F.coalesce(by_digest, F.lit(True))
    verdict = F.when(s.isNull(), "no_response").when(none, "unchecked").when(agrees, "resolved").otherwise("changed")
    good = verdict.isin("resolved", "unchecked")
    return rows.select(
        "record_id", "url_key", "ts", s["record_id"].alias("response_id"), verdict.alias("verdict"),
        F.when(good, s["payload_digest"]).alias("payload_digest"), F.when(good, merged_headers(s["headers"], r["headers"])).alias("headers"),
    )


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A capture history over the table ``pages``: a full response and a later revisit of each page.

    Every tenth revisit comes before its response; of the others a quarter each has the same tag,
    the weak form of it, only the date, or an outdated tag.
    """
    page = F.col("page_id").cast("long")
    digest = F.md5(F.col("html").cast("binary"))
    common = [F.col("url").cast("string").alias("url")]
    response = pages.select(
        (page * 2).alias("record_id"), *common, page.alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), F.concat(F.lit('"'), digest, F.lit('"')).alias("etag"),
        F.concat(F.lit("day "), page % 7).alias("last_modified"), digest.alias("payload_digest"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.octet_length("html").cast("string"), F.lit("Cache-Control"), F.concat(F.lit("max-age="), (page % 100).cast("string"))).alias("headers"),
    )
    tag = F.concat(F.lit('"'), digest, F.lit('"'))
    revisit = pages.select(
        (page * 2 + 1).alias("record_id"), F.concat(F.col("url").cast("string"), F.lit("#again")).alias("url"),
        F.when(page % 10 == 9, page - 1).otherwise(page + 500).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"),
        F.when(page % 4 == 0, tag).when(page % 4 == 1, F.concat(F.lit("W/"), tag)).when(page % 4 == 3, F.lit('"old"')).alias("etag"),
        F.concat(F.lit("day "), page % 7).alias("last_modified"), F.lit(None).cast("string").alias("payload_digest"),
        F.create_map(F.lit("content-length"), F.lit("0"), F.lit("Cache-Control"), F.lit("no-cache"), F.lit("X-Cache"), F.lit("hit")).alias("headers"),
    )
    return response.unionByName(revisit)


def header_text(headers: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")


#: The same rows for ``records_of_pages`` by an ASOF join.
SQL = r"""
WITH u AS (SELECT page_id AS p, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
v AS (SELECT p, html, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
  regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
  list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))) AS parts FROM u),
c AS (SELECT p, md5(html) AS digest, strlen(html) AS size, host || path || CASE WHEN len(parts) > 0 THEN '?' || array_to_string(parts, '&') ELSE '' END AS url_key FROM v),
r AS (SELECT *, CASE WHEN p % 10 = 9 THEN p - 1 ELSE p + 500 END AS ts FROM c),
j AS (SELECT r.p, r.url_key, r.ts, r.digest AS own, s.p AS sp, s.digest, s.size FROM r ASOF LEFT JOIN c s ON r.url_key = s.url_key AND r.ts > s.p),
k AS (SELECT *, CASE WHEN sp IS NULL THEN 'no_response' WHEN p % 4 IN (0, 1) AND own = digest THEN 'resolved' WHEN p % 4 = 2 AND p % 7 = sp % 7 THEN 'resolved' ELSE 'changed' END AS verdict FROM j)
SELECT 2 * p + 1 AS record_id, url_key, ts, 2 * sp AS response_id, verdict, CASE WHEN verdict = 'resolved' THEN digest END AS payload_digest,
  CASE WHEN verdict = 'resolved' THEN 'cache-control=no-cache;content-length=' || size || ';content-type=text/html;x-cache=hit' END AS headers FROM k
"""
