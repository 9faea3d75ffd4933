"""Not-modified revisit resolution of web archives: an as-of join by canonical URL to the latest earlier full response.

Records: record_id, url, ts (timestamp), kind ('response' or 'revisit'), status, headers (map of lower-case names), payload_digest.
A full response has status 200; other responses (errors, redirects, partial content) store no body to revisit. A revisit takes the
payload of the last full response of its canonical URL that is not later; where its headers name ``warc-refers-to-target-uri``, of that URL.
Validators are then checked: under the profile identical-payload-digest (``warc-profile``) the digests must agree; else, where both
records carry an ETag, these must (weak comparison), else the Last-Modified dates must; a revisit without common
validators is not confirmed. Headers that a 304 may update replace those of the response.

One URL may hold a third of all records, in one hour too. The last response of each URL and hour, and of each second of an hour,
is found by partial aggregates; only these rows, 3,600 for an hour at most, are ordered across hours and seconds. One task orders the
records of one URL and second.

Null URLs or timestamps resolve nothing ('no-response'), nor does a null status make a full response. Ties in time go to responses first,
then to the greater record_id. Repeated rows get a row each. Empty tables give no rows. Extra columns of the revisits are kept, but for those that
clash with the result's names. No text is held but the headers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a 304 response may not change: they describe the stored body.
BODY_HEADERS = ("content-length", "content-encoding", "content-type", "content-range", "transfer-encoding", "content-md5")
BUCKET_SECONDS = 3600
INPUT = ("record_id", "url", "ts", "kind", "status", "headers", "payload_digest")
RESULT = ("record_id", "canonical_url", "ts", "response_id", "verdict", "payload_digest", "headers", "status")


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host without 'www.', default port, fragment, trailing slash and tracking parameters; the rest
    of the query is sorted. http and https are one."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www[.]", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "[?](.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike("^(utm_[a-z]+|ref|fbclid|gclid)="))
    text = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(text != "", F.concat(F.lit("?"), text)).otherwise(""))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def _last_before(full: DataFrame, wanted: DataFrame, within: list[str], by: str, name: str) -> DataFrame:
    """For each wanted ``by`` of the keys ``within``: the last full response of an earlier one."""
    keys = [*within, by]
    last = full.groupBy(*keys).agg(F.max_by("response", F.struct("ts", "record_id")).alias("last"))
    places = last.join(wanted.select(*keys).distinct().withColumn("wanted", F.lit(True)), keys, "full")
    upto = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return places.withColumn(name, F.last("last", ignorenulls=True).over(upto)).where("wanted").select(*keys, name)


def resolve_revisits(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row per revisit: record_id, canonical_url, ts, response_id, verdict, payload_digest, merged headers and status.

    ``verdict`` is 'resolved', 'validators-differ', 'unconfirmed' (no common validator) or 'no-response'; payload, headers and
    the stored status are given where it is 'resolved'.
    """
    response = F.struct("ts", "record_id", "status", "headers", "payload_digest")
    seconds = F.unix_timestamp("ts")
    revisit, named = F.col("kind") == "revisit", F.col("headers")["warc-refers-to-target-uri"]
    taken = {c.lower() for c in (*INPUT, *RESULT)}
    extra = F.struct(*(c for c in records.columns if c.lower() not in taken), F.lit(0).alias("_none"))
    rows = records.select(
        "record_id", canonical_url(F.when(revisit, F.coalesce(named, "url")).otherwise(F.col("url"))).alias("canonical_url"), "ts", "kind", "headers", "payload_digest", F.floor(seconds / bucket_seconds).alias("bucket"),
        seconds.alias("second"), F.when((F.col("kind") == "response") & (F.col("status") == 200), response).alias("response"), F.when(revisit, extra).alias("_extra"),
    )
    usable = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    full, wanted = rows.where(F.col("response").isNotNull() & usable), rows.where(revisit & usable)
    before = _last_before(full, wanted, ["canonical_url"], "bucket", "before")
    earlier = _last_before(full, wanted, ["canonical_url", "bucket"], "second", "earlier")
    # records without URL or time stand alone
    alone = F.when(~usable, F.col("record_id").cast("string"))
    within = Window.partitionBy("canonical_url", "second", alone).orderBy("ts", F.col("kind") == "revisit", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("inside", F.last("response", ignorenulls=True).over(within)).where(revisit).drop("response", "kind")
    found = inside.join(earlier, ["canonical_url", "bucket", "second"], "left").join(before, ["canonical_url", "bucket"], "left")
    found = found.withColumn("response", F.when(usable, F.coalesce("inside", "earlier", "before")))
    tag, old_tag = F.col("headers")["etag"], F.col("response.headers")["etag"]
    date, old_date = F.col("headers")["last-modified"], F.col("response.headers")["last-modified"]
    same_payload = F.when(F.col("payload_digest") == F.col("response.payload_digest"), "resolved").otherwise("validators-differ")
    verdict = (
        F.when(F.col("response").isNull(), "no-response")
        .when(F.coalesce(F.col("headers")["warc-profile"].contains("identical-payload-digest"), F.lit(False)), same_payload)
        .when(tag.isNotNull() & old_tag.isNotNull(), F.when(_weak(tag) == _weak(old_tag), "resolved").otherwise("validators-differ"))
        .when(date.isNotNull() & old_date.isNotNull(), F.when(date == old_date, "resolved").otherwise("validators-differ"))
        .otherwise("unconfirmed")
    )
    found = found.withColumn("verdict", verdict)
    ok = F.col("verdict") == "resolved"
    update = F.map_filter("headers", lambda k, _: ~k.isin(*BODY_HEADERS))
    kept = F.map_filter("response.headers", lambda k, _: ~F.map_contains_key(F.coalesce("update", F.create_map().cast("map<string,string>")), k))
    found = found.withColumn("update", update)
    return found.select(
        "record_id", "canonical_url", "ts", F.col("response.record_id").alias("response_id"), "verdict", F.when(ok, F.col("response.payload_digest")).alias("payload_digest"),
        F.when(ok, F.map_concat(kept, "update")).alias("headers"), F.when(ok, F.col("response.status")).alias("status"), "_extra.*",
    ).drop("_none")


def records_from_pages(pages: DataFrame) -> DataFrame:
    """Crawl records of a page table: each page is a full response and, later, two revisits of its URL.

    Times follow page_id. Every fifth page's first revisit has another ETag; every third page is checked by date alone.
    """
    ident, at = F.col("page_id").cast("long"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    digest = F.sha1(F.coalesce("html", F.lit("")))
    tag = F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"'))
    date = F.concat(F.lit("day "), (ident % 365).cast("string"))
    when = lambda seconds: F.timestamp_seconds(F.unix_timestamp(at) + ident * 60 + F.lit(seconds))
    by_date = ident % 3 == 0
    stored = F.map_from_arrays(F.array(F.lit("etag"), F.lit("last-modified"), F.lit("content-length"), F.lit("server")), F.array(tag, date, F.length(F.coalesce("html", F.lit(""))).cast("string"), F.lit("a")))
    sent = lambda e: F.when(by_date, F.map_from_arrays(F.array(F.lit("last-modified"), F.lit("server")), F.array(date, F.lit("b")))).otherwise(
        F.map_from_arrays(F.array(F.lit("etag"), F.lit("content-length"), F.lit("date")), F.array(e, F.lit("0"), date))
    )
    first = F.when(ident % 5 == 0, F.lit('"other"')).otherwise(F.concat(F.lit("W/"), tag))
    kinds = F.array(
        F.struct((ident * 3).alias("record_id"), when(0).alias("ts"), F.lit("response").alias("kind"), F.lit(200).alias("status"), stored.alias("headers"), digest.alias("payload_digest")),
        F.struct((ident * 3 + 1).alias("record_id"), when(1800).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), sent(first).alias("headers"), F.lit(None).cast("string").alias("payload_digest")),
        F.struct((ident * 3 + 2).alias("record_id"), when(90000).alias("ts"), F.lit("revisit").alias("kind"), F.lit(304).alias("status"), sent(tag).alias("headers"), F.lit(None).cast("string").alias("payload_digest")),
    )
    return pages.select("url", F.explode(kinds).alias("r")).select("url", "r.*")
