"""WARC revisits: a not-modified record takes its body from the latest earlier full response of its canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loamline.llm.common import checkpoint, read_table

# Header fields that a 304 must not replace in a stored response (RFC 9111, 3.2, and hop-by-hop fields).
KEPT_FIELDS = [
    "connection",
    "content-encoding",
    "content-length",
    "content-range",
    "content-type",
    "keep-alive",
    "proxy-authenticate",
    "proxy-authorization",
    "proxy-connection",
    "te",
    "trailer",
    "transfer-encoding",
    "upgrade",
]
# Query parameters that don't name a resource.
TRACKING = ["fbclid", "gclid", "ref", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term"]


def canonical_url(url: Column) -> Column:
    """Host and path of a URL in one spelling: no scheme, user, leading ``www.``, default port, fragment or last slash,
    the host in lower case, the query's parameters sorted and without ``TRACKING``. Null for null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    place, query = F.substring_index(bare, "?", 1), F.when(F.instr(bare, "?") > 0, F.regexp_replace(bare, r"^[^?]*\?", "")).otherwise("")
    host = F.regexp_replace(F.lower(F.substring_index(place, "/", 1)), r"^(?:[^@]*@)?(?:www\.)?|:(?:80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(place, "^[^/]*", ""), "/+$", "")
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(TRACKING))
    query = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _field(headers: Column, name: str) -> Column:
    """The last value of a header field, names in any case; null if there is none."""
    found = F.filter(headers, lambda h: F.lower(F.trim(h["name"])) == name)
    return F.trim(F.try_element_at(found, F.lit(-1))["value"])


def merged_headers(stored: Column, fresh: Column) -> Column:
    """Stored fields with those of a 304 that it may replace; names in lower case, sorted by name, else in their order."""
    lower = lambda hs: F.transform(F.coalesce(hs, F.array().cast("array<struct<name:string,value:string>>")), lambda h: F.struct(F.lower(F.trim(h["name"])).alias("name"), h["value"].alias("value")))
    named = F.transform(F.split(F.coalesce(F.lower(_field(fresh, "connection")), F.lit("")), ","), lambda x: F.trim(x))
    allowed = F.filter(lower(fresh), lambda h: ~h["name"].isin(KEPT_FIELDS) & ~F.array_contains(named, h["name"]))
    names = F.transform(allowed, lambda h: h["name"])
    both = F.concat(F.filter(lower(stored), lambda h: ~F.array_contains(names, h["name"])), allowed)
    placed = F.array_sort(F.transform(both, lambda h, i: F.struct(h["name"].alias("name"), i.alias("i"), h["value"].alias("value"))))
    return F.transform(placed, lambda h: F.struct(h["name"].alias("name"), h["value"].alias("value")))


def latest_earlier(records: DataFrame) -> DataFrame:
    """(record_id, ref_id) of the revisits in a table (record_id, key, ts, full): the latest full record of an earlier ts.

    The rows are dealt by ranges of (key, ts), so a key of any size is spread over blocks by time. A window finds the
    latest in the block; what a key brings into a block from earlier ones comes from one row for each block that the key
    spans. Ties of ts go to the larger record_id. Rows without key or ts match nothing.
    """
    rows = records.where("key is not null and ts is not null").repartitionByRange("key", "ts")
    rows = checkpoint(rows.withColumn("block", F.spark_partition_id()))
    full = F.when(F.col("full"), F.struct("ts", "record_id"))
    inside = Window.partitionBy("block", "key").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max(full).over(inside)).where(~F.col("full"))
    by_block = rows.groupBy("key", "block").agg(F.max(full).alias("last"), F.min("ts").alias("from"))
    spread = by_block.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("block", "last")).alias("lasts")).where("n > 1")
    spread = spread.select("key", F.explode("lasts").alias("x")).select("key", "x.block", "x.last")  # at most two rows for each block border
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    brought = spread.select("key", "block", F.max("last").over(before).alias("brought")).where("brought is not null")
    found = near.join(brought, ["key", "block"], "left").withColumn("ref", F.greatest("near", F.when(F.col("brought")["ts"] < F.col("ts"), F.col("brought"))))
    return found.select("record_id", F.col("ref")["record_id"].alias("ref_id"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Each revisit of ``records`` (record_id, url, ts, status, headers, payload) with what it stands for.

    A record of status 304 is a revisit, one of 200 a full response; others are neither. headers is an array of (name,
    value), ts a whole number such as microseconds. Returns record_id, canonical_url, ref_id, outcome, status, headers,
    payload: for the outcome ``resolved`` the status 200, the body of the latest full response of the same canonical URL
    that is earlier, and its headers with the revisit's permitted ones. Validators are compared first: entity tags weakly if both have one, else modification
    dates if both have one. Other outcomes keep the revisit's status and headers and have no body: ``no earlier
    response``, ``validator mismatch``, ``no validator``.

    Null url or ts match nothing. Records of equal ts aren't earlier. Repeated revisits are resolved alike; a
    full response whose record_id comes twice gives each of its revisits two rows. A response
    that very many revisits refer to is one row of a join that may be split on the other side. Further columns are
    ignored.
    """
    key = canonical_url(F.col("url"))
    light = records.where("status in (200, 304)").select("record_id", key.alias("key"), "ts", (F.col("status") == 200).alias("full"))
    refs = latest_earlier(light)
    revisits = records.where("status = 304").select("record_id", key.alias("canonical_url"), "status", F.col("headers").alias("fresh"))
    fulls = records.where("status = 200").select(F.col("record_id").alias("ref_id"), F.col("headers").alias("stored"), "payload", F.lit(True).alias("there"))
    joined = revisits.join(refs.distinct(), "record_id", "left").join(fulls, "ref_id", "left")
    tag = lambda hs: F.regexp_replace(_field(F.col(hs), "etag"), "^W/", "")
    date = lambda hs: _field(F.col(hs), "last-modified")
    match = F.when(tag("fresh").isNotNull() & tag("stored").isNotNull(), tag("fresh") == tag("stored")).otherwise(date("fresh") == date("stored"))
    outcome = F.when(F.col("there").isNull(), "no earlier response").when(match.isNull(), "no validator").when(match, "resolved").otherwise("validator mismatch")
    joined = joined.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    return joined.select(
        "record_id", "canonical_url", "ref_id", "outcome", F.when(good, 200).otherwise(F.col("status")).alias("status"),
        F.when(good, merged_headers(F.col("stored"), F.col("fresh"))).otherwise(F.col("fresh")).alias("headers"),
        F.when(good, F.col("payload")).alias("payload"),
    )


#: A second visit follows the first after so many steps of the page number.
LATER = 1000


def page_records(pages: DataFrame) -> DataFrame:
    """Two records of each page: the full response, at its page_id, and a revisit ``LATER`` steps on that the server calls
    not modified, by the page's entity tag. Full records have even ids, revisits odd ones."""
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    full = F.struct(
        (F.col("page_id") * 2).alias("record_id"), F.col("page_id").alias("ts"), F.lit(200).alias("status"),
        F.array(header("Content-Type", F.lit("text/html")), header("Content-Length", F.octet_length("html")), header("ETag", tag), header("Date", F.col("page_id"))).alias("headers"),
        F.col("html").alias("payload"),
    )
    revisit = F.struct(
        (F.col("page_id") * 2 + 1).alias("record_id"), (F.col("page_id") + LATER).alias("ts"), F.lit(304).alias("status"),
        F.array(header("Content-Length", F.lit(0)), header("etag", F.concat(F.lit("W/"), tag)), header("Date", F.col("page_id") + LATER), header("Cache-Control", F.lit("max-age=60"))).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    return pages.select("url", F.explode(F.array(full, revisit)).alias("r")).select("url", "r.*")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All revisits of ``page_records`` of whole ``pages``, resolved."""
    found = resolve_revisits(page_records(read_table(spark, sf_dir, "pages")))
    fields = F.array_join(F.transform("headers", lambda h: F.concat_ws(": ", h["name"], h["value"])), "\n")
    return found.select(
        F.floor(F.col("record_id") / 2).alias("page_id"), "canonical_url", F.floor(F.col("ref_id") / 2).alias("ref_page_id"), "outcome",
        F.col("status").cast("long").alias("status"), fields.alias("fields"), F.sha2("payload", 256).alias("payload_sha256"),
    )


#: The same rows for DuckDB.
OP9_SQL = rf"""
WITH a AS (SELECT page_id, html, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM pages),
b AS (SELECT page_id, html, split_part(bare, '?', 1) AS place, CASE WHEN contains(bare, '?') THEN regexp_replace(bare, '^[^?]*\?', '') ELSE '' END AS query FROM a),
c AS (
  SELECT page_id, html,
         regexp_replace(lower(split_part(place, '/', 1)), '^(?:[^@]*@)?(?:www\.)?|:(?:80|443)$', '', 'g') AS host,
         regexp_replace(regexp_replace(place, '^[^/]*', ''), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT list_contains({TRACKING!r}, lower(split_part(p, '=', 1))))), '&') AS query
  FROM b),
d AS (SELECT page_id, html, concat(host, path, CASE WHEN query <> '' THEN concat('?', query) ELSE '' END) AS key, concat('"', md5(html), '"') AS tag FROM c),
e AS (SELECT r.page_id, r.key, r.tag, max(f.page_id) AS ref_page_id FROM d r LEFT JOIN d f ON f.key = r.key AND f.page_id < r.page_id + {LATER} GROUP BY r.page_id, r.key, r.tag)
SELECT e.page_id, e.key AS canonical_url, ref_page_id,
       CASE WHEN f.page_id IS NULL THEN 'no earlier response' WHEN f.tag = e.tag THEN 'resolved' ELSE 'validator mismatch' END AS outcome,
       CAST(CASE WHEN f.tag = e.tag THEN 200 ELSE 304 END AS BIGINT) AS status,
       CASE WHEN f.tag = e.tag THEN concat('cache-control: max-age=60', chr(10), 'content-length: ', strlen(f.html), chr(10), 'content-type: text/html', chr(10), 'date: ', e.page_id + {LATER}, chr(10), 'etag: W/', e.tag)
            ELSE concat('Content-Length: 0', chr(10), 'etag: W/', e.tag, chr(10), 'Date: ', e.page_id + {LATER}, chr(10), 'Cache-Control: max-age=60') END AS fields,
       CASE WHEN f.tag = e.tag THEN sha256(f.html) END AS payload_sha256
FROM e LEFT JOIN d f ON f.page_id = ref_page_id
"""
