"""WARC: resolving not-modified revisits against the archive's own responses.

A revisit record says that a server answered "not modified": it has headers
and validators, but no payload. It is resolved by an as-of join: the latest
earlier full response of the same canonical URL. Its payload counts only if
the validators agree (entity tag, or else the modification time); then the
revisit takes over the response's headers, updated by those that a
not-modified answer may carry.

One URL may hold a third of all records, so no window spans a URL's history:
records are cut into slices of about equal size in order of URL and time, a
window runs within (URL, slice), and what a slice inherits comes from a running
maximum over one row per (URL, slice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

#: Headers that a 304 answer may update in a stored response (RFC 9111 leaves the rest).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme, leading www. or m., default port, fragment, tracking parameters
    and a trailing slash do not tell pages apart; the host is in lower case,
    and parameters are in order. Null stays null."""
    rest = F.regexp_replace(F.trim(url), r"#.*$", "")
    rest = F.regexp_replace(rest, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^(www|m)\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    params = F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"))
    query = F.array_join(F.array_sort(params), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def folded(headers: Column) -> Column:
    """Headers by lower-case name (null: none). Of several spellings of a name
    the one that comes last in order of characters counts."""
    entries = F.coalesce(F.map_entries(headers), F.expr("cast(array() as array<struct<key:string,value:string>>)"))
    later = lambda e: F.exists(entries, lambda x: (F.lower(x["key"]) == F.lower(e["key"])) & (x["key"] > e["key"]))
    last = F.filter(entries, lambda e: ~later(e))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))


def weak(tag: Column) -> Column:
    """An entity tag for weak comparison, as a not-modified answer is made."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """One row per revisit of ``records``.

    ``records``: record_id, kind ('response' or 'revisit'), url, at (long),
    etag, modified (nullable strings), headers map<string,string> and digest
    of the payload; more columns are ignored. Result: record_id, url, at,
    status ('resolved', 'validators differ', 'no earlier response'),
    response_id, digest (null unless resolved) and headers, with names in lower
    case (of several spellings of a name the last in order counts).

    Earlier means a smaller ``at``; of responses at the same time the largest
    record_id counts. Entity tags compare weakly. A revisit without validators,
    or with a null URL or time, is not resolved. Repeated revisits each give a
    row; an empty table gives none.
    """
    valid = F.col("url").isNotNull() & F.col("at").isNotNull()
    rows = records.select("record_id", "kind", "url", "at", "etag", "modified", folded(F.col("headers")).alias("headers"), "digest")
    # All records of a URL and time are in one slice; a written number is the same on a retry.
    rows = stage(rows.repartitionByRange("url", "at").withColumn("slice", F.spark_partition_id()), "slices")
    kept = F.struct("at", "record_id", "etag", "modified", "headers", "digest")
    response = F.col("kind") == "response"
    # max_by over a map-free key; one row per (URL, slice) that has a response.
    last = rows.filter(valid & response).groupBy("url", "slice").agg(F.max_by(kept, F.struct("at", "record_id")).alias("last"))
    revisited = rows.filter(valid & ~response).select("url", "slice").distinct()
    history = last.select("url", "slice", "last").unionByName(revisited.select("url", "slice", F.lit(None).cast(last.schema["last"].dataType).alias("last")))
    history = history.groupBy("url", "slice").agg(F.first("last", ignorenulls=True).alias("last"))
    before = Window.partitionBy("url").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    inherited = history.select("url", "slice", F.last("last", ignorenulls=True).over(before).alias("inherited"))
    within = Window.partitionBy("url", "slice").orderBy("at", F.when(response, 1).otherwise(0), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = rows.filter(valid).withColumn("near", F.last(F.when(response, kept), ignorenulls=True).over(within)).filter(~response)
    joined = near.join(inherited, ["url", "slice"], "left").withColumn("got", F.coalesce("near", "inherited"))
    lost = rows.filter(~valid & ~F.coalesce(response, F.lit(False))).withColumn("got", F.lit(None).cast(last.schema["last"].dataType))
    cols = ["record_id", "url", "at", "etag", "modified", "headers", "got"]
    joined = joined.select(*cols).unionByName(lost.select(*cols))
    same = F.when(F.col("etag").isNotNull(), weak(F.col("etag")) == weak(F.col("got.etag"))).otherwise(F.col("modified") == F.col("got.modified"))
    status = F.when(F.col("got").isNull(), "no earlier response").when(F.coalesce(same, F.lit(False)), "resolved").otherwise("validators differ")
    new = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    stored = F.map_filter("got.headers", lambda k, v: ~F.map_contains_key(F.col("new"), k))
    out = joined.withColumn("status", status).withColumn("new", new)
    ok = F.col("status") == "resolved"
    return out.select(
        "record_id",
        "url",
        "at",
        "status",
        F.when(ok, F.col("got.record_id")).alias("response_id"),
        F.when(ok, F.col("got.digest")).alias("digest"),
        F.when(ok, F.map_concat(stored, "new")).otherwise(F.col("headers")).alias("headers"),
    )


def crawl_log(pages: DataFrame) -> DataFrame:
    """The crawl that the pages tell of: page n is a full response at time 2n,
    with the MD5 of its payload as entity tag; at the odd time 2n + 1 + 2d, d
    from the payload's length, the crawler asked for it again with that tag,
    and was answered "not modified"."""
    url = canonical_url(F.col("url"))
    tag = F.md5(F.coalesce(F.col("html"), F.lit("")))
    wait = F.length(F.coalesce(F.col("html"), F.lit(""))) * 37 % 1000
    size = F.octet_length(F.coalesce(F.col("html"), F.lit(""))).cast("string")
    base = pages.select("page_id", url.alias("url"), tag.alias("etag"), wait.alias("wait"), size.alias("size"))
    pair = lambda k, v: (F.lit(k), v)
    response = F.struct(
        F.lit("response").alias("kind"),
        (F.col("page_id") * 2).alias("at"),
        F.create_map(*pair("content-type", F.lit("text/html")), *pair("content-length", F.col("size")), *pair("date", (F.col("page_id") * 2).cast("string"))).alias("headers"),
        F.col("etag").alias("digest"),
    )
    again = F.col("page_id") * 2 + 1 + F.col("wait") * 2
    revisit = F.struct(
        F.lit("revisit").alias("kind"),
        again.alias("at"),
        F.create_map(*pair("Date", again.cast("string")), *pair("Set-Cookie", F.lit("s=1"))).alias("headers"),
        F.lit(None).cast("string").alias("digest"),
    )
    rows = base.select("page_id", "url", "etag", F.explode(F.array(response, revisit)).alias("r"))
    return rows.select(F.col("page_id").alias("record_id"), "r.kind", "url", "r.at", "etag", F.lit(None).cast("string").alias("modified"), "r.headers", "r.digest")


def resolved_pages(pages: DataFrame) -> DataFrame:
    """The revisits of all pages, with the merged headers as text."""
    got = resolve(crawl_log(pages.select("page_id", "url", "html")))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(F.lower(e["key"]), F.lit("="), e["value"]))), ";")
    return got.select(F.col("record_id").alias("page_id"), F.col("url").alias("canonical_url"), F.col("at").alias("revisit_at"), "status", F.col("response_id").alias("response_page"), F.col("digest").alias("payload_md5"), text.alias("headers"))


SQL = r"""
WITH parts AS (
  SELECT page_id, html, url AS raw,
    regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM pages),
bits AS (
  SELECT page_id, html, raw,
    regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^(www|m)\.|:(80|443)$', '', 'g') AS host,
    regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))), '&') AS query
  FROM parts),
response AS (
  SELECT page_id, CASE WHEN raw IS NULL THEN NULL ELSE host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS url,
    md5(coalesce(html, '')) AS etag, page_id * 2 AS t, strlen(coalesce(html, '')) AS size, html
  FROM bits),
later AS (
  SELECT page_id, url, etag, page_id * 2 + 1 + 2 * (length(coalesce(html, '')) * 37 % 1000) AS t FROM response),
matched AS (
  SELECT l.page_id, l.url, l.t, l.etag, r.page_id AS rid, r.etag AS retag, r.size
  FROM later l ASOF LEFT JOIN response r ON l.url = r.url AND l.t > r.t)
SELECT page_id, url AS canonical_url, t AS revisit_at,
  CASE WHEN rid IS NULL THEN 'no earlier response' WHEN etag = retag THEN 'resolved' ELSE 'validators differ' END AS status,
  CASE WHEN etag = retag THEN rid END AS response_page,
  CASE WHEN etag = retag THEN retag END AS payload_md5,
  CASE WHEN etag = retag THEN 'content-length=' || size || ';content-type=text/html;date=' || t
       ELSE 'date=' || t || ';set-cookie=s=1' END AS headers
FROM matched"""
