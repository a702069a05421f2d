"""Captures checked against dated block lists by an as-of join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("url", "host", "domain")


def host_of(url: str) -> Column:
    """Host of an http(s) address in lower case, without user, port and final dot; null without one."""
    found = F.regexp_extract(F.lower(F.col(url)), r"^\s*https?://(?:[^/?#@]*@)?([^/?#:\s]+)", 1)
    return F.nullif(F.regexp_replace(found, r"\.+$", ""), F.lit(""))


def page_of(url: str) -> Column:
    """Host and path of an address, without scheme, query, fragment and final slash."""
    path = F.regexp_extract(F.col(url), r"(?i)^\s*https?://[^/?#]*(/[^?#]*)", 1)
    return F.concat(host_of(url), F.regexp_replace(path, r"/+$", ""))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """Dated entries (list, kind, value, action, at) as intervals (list, kind, value, start, end).

    ``add`` opens an interval and ``remove`` ends it; a repeated ``add`` changes nothing and an
    unmatched ``remove`` is ignored. Where both carry the same time, ``remove`` counts last.
    ``end`` is null while the entry is listed. Entries with a null in kind, value, action or
    time, or of an unknown kind or action, are ignored.
    """
    rows = entries.filter(
        F.col("kind").isin(*KINDS) & F.col("action").isin("add", "remove") & F.col("value").isNotNull() & F.col("at").isNotNull()
    )
    keys = ["list", "kind", "value"]
    state = rows.groupBy(*keys, "at").agg(F.max(F.col("action") == "add").alias("on"), F.max(F.col("action") == "remove").alias("off"))
    listed = state.select(*keys, "at", (~F.col("off")).alias("listed"))
    order = Window.partitionBy(*keys).orderBy("at")
    changes = listed.withColumn("was", F.coalesce(F.lag("listed").over(order), F.lit(False))).filter(
        F.col("listed") != F.col("was")
    )
    return (
        changes.withColumn("end", F.lead("at").over(order)).filter("listed").select(*keys, F.col("at").alias("start"), "end")
    )


def _suffixes(host: str) -> Column:
    """The host and every parent domain of at least two labels."""
    labels = F.split(F.col(host), r"\.")
    return F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(labels) - 2, F.lit(0))),
        lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."),
    )


def filter_captures(captures: DataFrame, entries: DataFrame, id_: str, url: str, at: str) -> DataFrame:
    """One row per capture: id, host, blocked, matches, first_list, listed_since.

    A capture is blocked by the entries whose interval holds its fetch time (start included,
    end not): its own page, its own host, or a domain it lies under. ``matches`` counts the
    entries, ``first_list`` and ``listed_since`` name the one listed earliest (ties: smallest
    list). A capture without host or time is not blocked. Repeated captures give a row each.
    Extra columns are not read.

    Only hosts that a list names at any time are looked up again: the distinct hosts meet the
    lists first, so captures are joined once, on their host, with few intervals.
    """
    spans = validity_intervals(entries)
    rows = captures.select(
        F.col(id_).alias("id"), host_of(url).alias("host"), page_of(url).alias("page"), F.col(at).alias("at")
    ).withColumn("row", F.monotonically_increasing_id())
    hosts = rows.select("host").filter(F.col("host").isNotNull()).distinct()
    own = spans.filter(F.col("kind") == "host").select(F.col("value").alias("host"), "list", "start", "end")
    domains = spans.filter(F.col("kind") == "domain").select(F.col("value").alias("name"), "list", "start", "end")
    under = hosts.withColumn("name", F.explode(_suffixes("host"))).join(domains, "name").drop("name")
    by_host = own.unionByName(under)
    pages = spans.filter(F.col("kind") == "url").select(F.col("value").alias("page"), "list", "start", "end")
    active = (F.col("start") <= F.col("at")) & (F.col("end").isNull() | (F.col("at") < F.col("end")))

    def hits(key: str, listed: DataFrame) -> DataFrame:
        return rows.join(listed, key).filter(active).select("row", "list", "start")

    found = (
        hits("host", by_host)
        .unionByName(hits("page", pages))
        .groupBy("row")
        .agg(F.count("*").alias("matches"), F.min(F.struct("start", "list")).alias("first"))
    )
    return rows.join(found, "row", "left").select(
        F.col("id").alias(id_),
        "host",
        F.col("matches").isNotNull().alias("blocked"),
        F.coalesce("matches", F.lit(0)).alias("matches"),
        F.col("first.list").alias("first_list"),
        F.col("first.start").alias("listed_since"),
    )
