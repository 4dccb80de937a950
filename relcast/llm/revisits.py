"""Not-modified revisits: as-of join by canonical URL to the latest earlier full response.

A revisit record says that a page is as it was. It takes the payload of the latest full response of the same canonical URL that
is earlier than the revisit, if the validators agree (the entity tag if both have one, else the time of last change), and
that response's headers, updated by those headers of the revisit that may be updated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .url_filter import url_host, url_path

#: Headers that a not-modified answer doesn't update (they describe its own message, or the stored payload).
NOT_UPDATED = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that don't change a page.
TRACKING = "^(utm_.*|ref|gclid|fbclid|sessionid)(=.*)?$"


def canonical_url(url: Column) -> Column:
    """host/path?query without scheme, ``www.``, default port, fragment, closing slash and tracking parameters; sorted parameters."""
    host = F.regexp_replace(F.regexp_replace(url_host(url), ":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(url_path(url), "/+$", "")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(url.isNotNull(), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def clean_headers(headers: Column) -> Column:
    """Names in lower case, of several equal names the last; null is no header."""
    entries = F.transform(F.map_entries(F.coalesce(headers, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def merged_headers(stored: Column, update: Column) -> Column:
    """The stored headers, with what the update may replace or add."""
    allowed = F.map_filter(update, lambda name, _: ~name.isin(*NOT_UPDATED))
    return F.map_concat(F.map_filter(stored, lambda name, _: ~F.map_contains_key(allowed, name)), allowed)


def weak_tag(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row for each revisit in ``records``: record_id, url_key, refers_to, outcome, digest and headers.

    ``records`` has record_id, url, ts (timestamp), kind (``response`` or ``revisit``), etag, last_modified, digest and
    headers (map of strings); more columns are left out, so their names can't clash. ``outcome`` is

    * ``resolved``: validators agree; digest and headers are those of the payload found,
    * ``mismatch``: both sides have a validator and it differs,
    * ``unverified``: they have no validator in common,
    * ``no_response``: there is no earlier full response, or the url or the time of the revisit is null.

    Only ``resolved`` has digest and headers. Earlier means a smaller ts; of responses at one time the greatest record_id
    counts. Repeated revisits are judged each; an empty table gives an empty result. Records are dealt to ranges of url
    and time, so a url with many records is sorted in pieces of equal size; the last response of each piece is carried to
    the next ones through a small table.
    """
    found = F.struct("record_id", "etag", "last_modified", "digest", "headers")
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), F.unix_micros("ts").alias("us"), "kind", "etag", "last_modified", "digest", clean_headers(F.col("headers")).alias("headers"))
    rows = rows.where(F.col("kind").isin("response", "revisit"))
    known = rows.where("url_key IS NOT NULL AND us IS NOT NULL").withColumn("full", F.when(F.col("kind") == "response", found))
    # the order of a url's records: a response is no answer to revisits of its own time
    by_time = [F.col("us"), F.col("full").isNotNull(), F.col("record_id")]
    placed = cut(known.repartitionByRange("url_key", *by_time).withColumn("part", F.spark_partition_id()))
    order = Window.partitionBy("url_key", "part").orderBy(*by_time).rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("near", F.last("full", ignorenulls=True).over(order)).where("kind = 'revisit'")
    ends = placed.where("full IS NOT NULL").groupBy("url_key", "part").agg(F.max_by("full", F.struct("us", "record_id")).alias("end"))
    marks = placed.select("url_key", "part").distinct().join(ends, ["url_key", "part"], "left")
    before = Window.partitionBy("url_key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = cut(marks.select("url_key", "part", F.last("end", ignorenulls=True).over(before).alias("far")).where("far IS NOT NULL"))
    joined = near.join(carried, ["url_key", "part"], "left").withColumn("hit", F.coalesce("near", "far"))
    tags = F.col("etag").isNotNull() & F.col("hit.etag").isNotNull()
    times = F.col("last_modified").isNotNull() & F.col("hit.last_modified").isNotNull()
    agrees = F.when(tags, weak_tag(F.col("etag")) == weak_tag(F.col("hit.etag"))).when(times, F.col("last_modified") == F.col("hit.last_modified"))
    outcome = F.when(F.col("hit").isNull(), "no_response").when(agrees.isNull(), "unverified").when(agrees, "resolved").otherwise("mismatch")
    judged = joined.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    known = judged.select("record_id", "url_key", F.col("hit.record_id").alias("refers_to"), "outcome", F.when(good, F.col("hit.digest")).alias("digest"), F.when(good, merged_headers(F.col("hit.headers"), F.col("headers"))).alias("headers"))
    lost = rows.where("kind = 'revisit' AND (url_key IS NULL OR us IS NULL)")
    kinds = {f.name: f.dataType for f in known.schema.fields}
    lost = lost.select("record_id", "url_key", F.lit(None).cast(kinds["refers_to"]).alias("refers_to"), F.lit("no_response").alias("outcome"), F.lit(None).cast(kinds["digest"]).alias("digest"), F.lit(None).cast(kinds["headers"]).alias("headers"))
    return known.unionByName(lost)
