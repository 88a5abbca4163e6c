"""Not-modified revisits of a web archive, resolved by an as-of join.

A revisit record (WARC type ``revisit``, profile server-not-modified) has no
payload: it stands for the latest earlier full response of the same canonical
URL.  The join finds that response, checks that the revisit's validators agree
with it, and merges the headers: the stored response's headers, updated by
those that a 304 response may carry.

* Canonical URL: scheme and host in lower case, no ``www.``, no default port,
  no fragment, no user, an empty path as ``/``, query parameters sorted and
  those of ``TRACKING`` left out; http and https are the same.
* Earlier: by (time, record id).  Only ``response`` records with status 200
  and a payload digest count.
* Validators: a revisit's ETag must equal the response's (weakly: without
  ``W/``), else, if it has none, its Last-Modified must; one that has neither
  is ``unvalidated`` and is resolved only if its refers-to digest agrees.

As-of join without a URL in one task: the records are range-sorted by (URL,
time, id), so a URL with many records lies in many sorted partitions.  Each
partition's last response of a URL is a partial aggregate and is carried to the
URL's later partitions over these few rows; within a partition the running last
response is a window over the URL's records there.  Payloads are not moved: the
result names the response record.

Defined cases: a NULL URL or time is never resolved (``no_url``); a URL that
has no host keeps its text; a revisit before any response is ``no_response``;
records of equal (time, id) are tied by their type, responses first, and
repeated records give equal rows; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import require, written

# Query parameters without meaning for the page, and the header
# fields that a 304 response may send to update a stored one (RFC 9110, 15.4.5;
# RFC 9111, 3.2 keeps Content-Length and the like of the stored response).
TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content gclid fbclid ref".split()
PERMITTED = "cache-control content-location date etag expires vary last-modified age warning set-cookie".split()


def canonical_url(url: Column) -> Column:
    """The URL under which captures of one page meet."""
    text = F.trim(url)
    rest = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    rest = F.regexp_replace(rest, r"#.*$", "")
    host = F.lower(F.regexp_extract(rest, r"^(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)?$", ""), r"^www\.", "")
    path = F.regexp_extract(rest, r"^[^/?]*(/[^?]*)?", 1)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(
        F.substring_index(p, "=", 1)).isin(*TRACKING)))
    full = F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&")))
                    .otherwise(F.lit("")))
    return F.when(host == "", text).otherwise(full)


def _header(name: str) -> Column:
    """A header field by its lower-case name."""
    held = F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == name)
    return F.get(held, F.lit(0))["value"]


def _weak(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), r"^W/", "")


def merged_headers(stored: Column, sent: Column) -> Column:
    """The stored fields, those that a 304 may update taken from it, by lower-case names."""
    def lower(entries: Column) -> Column:
        return F.transform(entries, lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    old = lower(F.map_entries(F.coalesce(stored, F.expr("cast(map() as map<string,string>)"))))
    new = F.filter(lower(F.map_entries(F.coalesce(sent, F.expr("cast(map() as map<string,string>)")))),
                   lambda e: e["key"].isin(*PERMITTED))
    stay = F.filter(old, lambda e: ~F.array_contains(F.transform(new, lambda n: n["key"]), e["key"]))
    one_each = F.array_sort(F.concat(stay, new))
    # of a field that one record repeats under two spellings, the greatest value holds
    return F.map_from_entries(F.filter(one_each, lambda e: F.array_max(F.filter(
        one_each, lambda x: x["key"] == e["key"])) == e))


def capture_rows(records: DataFrame) -> DataFrame:
    """The full responses and the revisits, with canonical URL and validators."""
    require(records, "record_id", "type", "url", "time", "status", "headers", "digest")
    full = (F.col("type") == "response") & (F.col("status") == 200) & F.col("digest").isNotNull()
    return records.filter(full | (F.col("type") == "revisit")).select(
        "record_id", F.when(full, 0).otherwise(1).alias("revisit"), canonical_url(F.col("url")).alias("canon"),
        "time", "headers", "digest", _header("etag").alias("etag"), _header("last-modified").alias("modified"))


def latest_responses(rows: DataFrame) -> DataFrame:
    """(canon, time, record_id, r): every revisit and the (time, record_id) of the latest earlier
    response of its URL, or NULL."""
    order = ["canon", "time", "record_id", "revisit"]
    able = rows.filter(F.col("canon").isNotNull() & F.col("time").isNotNull() & F.col("record_id").isNotNull())
    placed = written(able.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
                     .withColumn("part", F.spark_partition_id()), "warc-sorted")
    at = F.when(F.col("revisit") == 0, F.struct("time", "record_id"))
    before = Window.partitionBy("canon").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (placed.groupBy("canon", "part").agg(F.max(at).alias("last"))
               .withColumn("carried", F.last("last", ignorenulls=True).over(before)).drop("last"))
    within = (Window.partitionBy("canon", "part").orderBy("time", "record_id", "revisit")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    here = placed.withColumn("near", F.last(at, ignorenulls=True).over(within)).filter("revisit = 1")
    return (here.join(carried, ["canon", "part"], "left")
            .select("canon", "time", "record_id", F.coalesce("near", "carried").alias("r")).distinct())


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per revisit record: record_id, url, time, response_id, outcome, digest, headers.

    ``outcome`` is resolved, unvalidated, mismatch, no_response or no_url; the
    last two have no response, and only ``resolved`` rows get digest and headers.
    """
    rows = written(capture_rows(records), "warc-records")
    found = latest_responses(rows)
    revisits = rows.filter("revisit = 1").drop("revisit")
    stored = (rows.filter("revisit = 0").groupBy("record_id", "time", "canon")
              .agg(F.max(F.struct("digest", "etag", "modified", F.map_entries("headers").alias("headers"))).alias("s")))
    met = (found.filter(F.col("r").isNotNull())
           .select("canon", "time", "record_id", F.col("r.record_id").alias("response_id"),
                   F.col("r.time").alias("response_time")))
    s = stored.select(F.col("record_id").alias("response_id"), F.col("time").alias("response_time"), "canon", "s")
    met = met.join(s, ["response_id", "response_time", "canon"])
    out = revisits.join(met, ["canon", "time", "record_id"], "left")
    same_tag = _weak(F.col("etag")) == _weak(F.col("s.etag"))
    outcome = (F.when(F.col("canon").isNull() | F.col("time").isNull() | F.col("record_id").isNull(), "no_url")
               .when(F.col("response_id").isNull(), "no_response")
               .when(F.col("etag").isNotNull(), F.when(F.coalesce(same_tag, F.lit(False)), "resolved").otherwise("mismatch"))
               .when(F.col("modified").isNotNull(), F.when(
                   F.coalesce(F.col("modified") == F.col("s.modified"), F.lit(False)), "resolved").otherwise("mismatch"))
               .when(F.col("digest") == F.col("s.digest"), "resolved").otherwise("unvalidated"))
    ok = F.col("outcome") == "resolved"
    return out.withColumn("outcome", outcome).select(
        "record_id", F.col("canon").alias("url"), "time", "response_id", "outcome",
        F.when(ok, F.col("s.digest")).alias("digest"),
        F.when(ok, merged_headers(F.map_from_entries("s.headers"), F.col("headers"))).alias("headers"))
