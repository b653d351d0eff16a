"""Resolve not-modified revisits of web captures: an as-of join by canonical URL.

A revisit record holds no body, only the headers of a 304 answer. It is joined to the latest earlier full response of
the same canonical URL; if a validator agrees (payload digest, entity tag or modification time), the response's body
stands for it, with the response's headers updated by those that a 304 may change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cuts, let, part_of, written

#: Headers of a 304 answer that must not replace stored ones, as they describe a body or a connection.
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "etag", "keep-alive", "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that don't choose a page.
DROPPED_PARAMS = ("utm_[a-z]*", "fbclid", "gclid", "jsessionid", "phpsessid", "sessionid", "sid")
#: Time ranges that a URL's captures are cut into, so that one URL's history is never one task's.
SLICES = 64


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and default port, path without trailing slashes, parameters sorted and without
    those that track; neither scheme nor fragment. Null stays null."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.regexp_extract(bare, "^[^/?]*", 0)
    rest = F.substring(bare, F.length(host) + 1, F.length(bare))
    name = F.regexp_replace(F.regexp_replace(F.lower(host), "^www[0-9]*[.]", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^?]*", 0), "/+$", "")
    params = F.filter(F.split(F.regexp_replace(F.regexp_extract(rest, "[?].*$", 0), "^[?]", ""), "&"), lambda p: (p != "") & ~p.rlike(f"^({'|'.join(DROPPED_PARAMS)})(=|$)"))
    query = F.array_join(F.array_sort(params), "&")
    return F.concat(name, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def folded(headers: Column) -> Column:
    """Header names in lower case without outer blanks, as they don't tell cases apart. Of names that then agree the
    one that is last in code-point order stays. Null is no headers."""
    none = F.create_map().cast("map<string,string>")
    rows = F.array_sort(F.transform(F.map_entries(F.coalesce(headers, none)), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("name"), e["key"].alias("key"), e["value"].alias("value"))))
    last = let(rows, lambda es: F.filter(es, lambda e, i: F.coalesce(F.get(es, i + 1)["name"] != e["name"], F.lit(True))))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["name"], e["value"])))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers, updated by the fresh ones that a 304 may change; either may be null. Names are folded."""
    allowed = F.map_filter(folded(fresh), lambda k, v: ~k.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(folded(stored), lambda k, v: ~F.map_contains_key(allowed, k)), allowed)


def latest_response(records: DataFrame, slices: int = SLICES) -> DataFrame:
    """record_id of each revisit with url_key, and base: the latest full response of the same key at an earlier ts.

    The history is cut into time ranges of about equal numbers of records. Within a range a window finds the latest; from earlier ranges comes the last
    response of each, of which there are at most `slices` a URL. A URL with very many captures is so dealt out, and
    only ids and validators are moved. Of responses at the same time the one with the larger record_id is later.
    """
    edges = [int(x) for x in cuts(records, "ts", slices)]
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "modified", "digest"))
    x = records.where("url_key IS NOT NULL AND ts IS NOT NULL").select("record_id", "url_key", "ts", "kind", part_of(F.col("ts"), edges).alias("slice"), full.alias("full"))
    within = Window.partitionBy("url_key", "slice").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    seen = x.withColumn("here", F.max("full").over(within)).where("kind = 'revisit'")
    ends = x.where("full IS NOT NULL").groupBy("url_key", "slice").agg(F.max("full").alias("last"))
    # Every range of a URL in which anything happens, with the last response before it.
    used = x.select("url_key", "slice").distinct().join(ends, ["url_key", "slice"], "left")
    before = used.withColumn("carried", F.max("last").over(Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))).select("url_key", "slice", "carried")
    return seen.join(before, ["url_key", "slice"]).select("record_id", F.coalesce("here", "carried").alias("base"))


def resolve(records: DataFrame) -> DataFrame:
    """Revisits of `records` (record_id long, url, ts long, kind, etag, modified, digest, headers map, body), resolved.

    Returns record_id, url_key, base_id, status, validator, headers, body. status: `resolved`; `changed`: a validator
    that both have differs, or they have none in common; `missing`: no earlier response. The first validator that both
    have decides: digest, then etag (weak or strong alike), then modified. Body and headers are null unless resolved.

    Rows of other kinds than response and revisit, and rows without record_id, take no part; a revisit without url or
    ts is `missing`. Of rows that repeat a record_id one, with the greatest (ts, url), counts. An empty table gives
    an empty result; other columns are ignored. Header names are compared and returned in lower case. Very long bodies
    move once, to the revisits that they resolve.
    """
    cols = ["record_id", "url", "ts", "kind", "etag", "modified", "digest", "headers", "body"]
    x = records.select(*cols).where("record_id IS NOT NULL AND kind IN ('response', 'revisit')")
    if not x.groupBy("record_id").count().where("count > 1").isEmpty():
        last = Window.partitionBy("record_id").orderBy(F.desc_nulls_last("ts"), F.desc_nulls_last("url"), "kind", "digest", "etag", "modified")
        x = x.withColumn("_k", F.row_number().over(last)).where("_k = 1").drop("_k")
    x = x.withColumn("url_key", canonical_url(F.col("url")))
    tag = lambda c: F.regexp_replace(c, "^W/", "")
    found = latest_response(x.select("record_id", "url_key", "ts", "kind", "etag", "modified", "digest"))
    visits = x.where("kind = 'revisit'").select("record_id", "url_key", "etag", "modified", "digest", F.col("headers").alias("fresh"))
    y = visits.join(found, "record_id", "left")
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    validator = F.when(both("digest", "base.digest"), "digest").when(both("etag", "base.etag"), "etag").when(both("modified", "base.modified"), "modified")
    agree = F.when(F.col("validator") == "digest", F.col("digest") == F.col("base.digest")).when(F.col("validator") == "etag", tag(F.col("etag")) == tag(F.col("base.etag"))).when(F.col("validator") == "modified", F.col("modified") == F.col("base.modified")).otherwise(False)
    y = y.withColumn("validator", validator).withColumn("base_id", F.col("base.record_id"))
    y = y.withColumn("status", F.when(F.col("base_id").isNull(), "missing").when(agree, "resolved").otherwise("changed"))
    y = written(y.select("record_id", "url_key", "base_id", "status", "validator", "fresh"), "revisits")
    stored = x.where("kind = 'response'").select(F.col("record_id").alias("base_id"), F.col("headers").alias("stored"), "body")
    # Only resolved revisits meet a body; the others would all meet under one key, null.
    done = y.where("status = 'resolved'").join(stored, "base_id")
    done = done.select("record_id", "url_key", "base_id", "status", "validator", merged_headers(F.col("stored"), F.col("fresh")).alias("headers"), "body")
    rest = y.where("status <> 'resolved'").select("record_id", "url_key", "base_id", "status", "validator", F.lit(None).cast("map<string,string>").alias("headers"), F.lit(None).cast("string").alias("body"))
    return done.unionByName(rest)


def records_of_pages(pages: DataFrame) -> DataFrame:
    """A capture history from `pages` (page_id, url, html): each page is a full response at time page_id, and 100 later
    a revisit by a variant of its URL. A fifth of the revisits have another entity tag; of the rest, a third have only
    the modification time. The pages hold no WARC records, so the query makes these."""
    i, etag = F.col("page_id").cast("long"), F.md5(F.coalesce("html", F.lit("")).cast("binary"))
    none = F.lit(None).cast("string")
    length = F.length(F.coalesce("html", F.lit(""))).cast("string")
    response = pages.select((2 * i).alias("record_id"), "url", i.alias("ts"), F.lit("response").alias("kind"), etag.alias("etag"), i.cast("string").alias("modified"), none.alias("digest"), F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), length, F.lit("cache-control"), F.lit("max-age=60")).alias("headers"), F.col("html").alias("body"))
    seen = F.when(i % 5 == 0, F.lit("W/stale")).when(i % 3 == 0, none).otherwise(F.concat(F.lit("W/"), etag))
    fresh = F.create_map(F.lit("content-length"), F.lit("0"), F.lit("cache-control"), F.concat(F.lit("max-age="), (i % 100).cast("string")), F.lit("date"), (i + 100).cast("string"))
    revisit = pages.select((2 * i + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), (i + 100).alias("ts"), F.lit("revisit").alias("kind"), seen.alias("etag"), i.cast("string").alias("modified"), none.alias("digest"), fresh.alias("headers"), none.alias("body"))
    return response.unionByName(revisit)


def digest(resolved: DataFrame) -> DataFrame:
    """record_id, url_key, base_id, status, validator, headers as text, n_chars and sha256 of the body."""
    text = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return resolved.select("record_id", "url_key", "base_id", "status", "validator", text.alias("headers"), F.length("body").cast("long").alias("n_chars"), F.sha2(F.col("body").cast("binary"), 256).alias("body_sha256"))


SQL = r"""
WITH p AS (
  SELECT page_id::BIGINT AS i, url, html, md5(coalesce(html, '')) AS etag,
         regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS bare FROM pages),
q AS (SELECT *, regexp_extract(bare, '^[^/?]*', 0) AS host FROM p),
r AS (SELECT *, substr(bare, length(host) + 1) AS rest FROM q),
k AS (
  SELECT i, html, etag, regexp_replace(regexp_replace(lower(host), '^www[0-9]*[.]', ''), ':(80|443)$', '') AS name,
         regexp_replace(regexp_extract(rest, '^[^?]*', 0), '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(regexp_replace(regexp_extract(rest, '[?].*$', 0), '^[?]', ''), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]*|fbclid|gclid|jsessionid|phpsessid|sessionid|sid)(=|$)'))), '&') AS query FROM r),
u AS (SELECT i, html, etag, name || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS url_key FROM k),
v AS (
  SELECT a.i, a.url_key, a.etag AS own, max(b.i) AS base
  FROM u a LEFT JOIN u b ON a.url_key = b.url_key AND b.i < a.i + 100 GROUP BY ALL),
w AS (
  SELECT v.*, b.html, b.etag AS stored, length(coalesce(b.html, ''))::VARCHAR AS len, CASE WHEN v.i % 5 = 0 THEN 'stale' WHEN v.i % 3 = 0 THEN NULL ELSE v.own END AS seen
  FROM v LEFT JOIN u b ON v.base = b.i),
s AS (
  SELECT *, CASE WHEN base IS NULL THEN NULL WHEN seen IS NOT NULL THEN 'etag' ELSE 'modified' END AS validator,
         CASE WHEN base IS NULL THEN 'missing' WHEN CASE WHEN seen IS NOT NULL THEN seen = stored ELSE i = base END THEN 'resolved' ELSE 'changed' END AS status FROM w)
SELECT 2 * i + 1 AS record_id, url_key, 2 * base AS base_id, status, validator,
       CASE WHEN status = 'resolved' THEN 'cache-control=max-age=' || (i % 100) || ';content-length=' || len || ';content-type=text/html;date=' || (i + 100) END AS headers,
       CASE WHEN status = 'resolved' THEN length(html) END AS n_chars,
       CASE WHEN status = 'resolved' THEN sha256(html) END AS body_sha256
FROM s
"""
