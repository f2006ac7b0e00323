"""Captured URLs against dated block lists.

Dated list entries (a key, what happens to it, from when) become validity
intervals: each event of a key holds until its next one; removals end an
interval and open none. A capture is looked up under every key that could name
it - its host and parent domains, its host with each leading part of the path,
the whole URL - and an as-of join keeps the entries that were active when it
was fetched. The most specific active entry decides (URL over path over domain,
longer over shorter, block over allow).

The join is on the key and the month: intervals are laid out over the months
they touch, so the captures of a hot host spread over the months, and each
meets only that month's intervals.

A verdict depends on the URL and the fetch date alone: each distinct pair is judged
once and its captures get the verdict by that pair, whatever their ids are (null or
repeated ids do not matter), so a URL that was captured a million times costs one
look-up.

Null or relative URLs, and captures without a date, match nothing and pass. Of
several events of a key on one day the last by ``seq`` (then action) holds. A
key, action or date that is null is no entry. Repeated captures get a row each.
Extra columns pass through; columns named like an output are replaced. An empty
list blocks nothing. Paths are looked up as deep as the list's deepest entry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK, ALLOW, REMOVE = "block", "allow", "remove"
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
_REST = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)"


def host(url: Column) -> Column:
    """Lower-case host without user and port; empty for what is no absolute URL."""
    h = F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1), "^.*@", "")
    return F.lower(F.regexp_replace(h, ":[0-9]*$", ""))


def keys(url: Column, depth: int = 4) -> Column:
    """Every key that names the URL: ``d:domain``, ``p:host/segments/`` of up to
    ``depth`` segments, ``u:host/path?query``."""
    u = F.coalesce(url, F.lit(""))
    h, path, rest = host(u), F.regexp_extract(u, _PATH, 1), F.regexp_extract(u, _REST, 1)
    labels = F.split(h, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
                          lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    parts = F.slice(F.filter(F.split(path, "/"), lambda s: s != ""), 1, depth)
    paths = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))),
                        lambda i: F.concat(F.lit("p:"), h, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    paths = F.when(F.size(parts) > 0, paths).otherwise(F.array().cast("array<string>"))
    return F.when(h != "", F.concat(domains, paths, F.array(F.concat(F.lit("u:"), h, rest)))).otherwise(
        F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, action, valid_from, valid_to) from (key, action, at[, seq]); an open end is null."""
    if "seq" not in entries.columns:
        entries = entries.withColumn("seq", F.lit(0))
    events = (entries.where(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("action").isin(BLOCK, ALLOW, REMOVE))
              .groupBy("key", "at").agg(F.max(F.struct("seq", "action")).alias("e"))
              .select("key", "at", F.col("e.action").alias("action")))
    nxt = F.lead("at").over(Window.partitionBy("key").orderBy("at"))
    return (events.withColumn("valid_to", nxt).where(F.col("action") != REMOVE)
            .select("key", "action", F.col("at").alias("valid_from"), "valid_to"))


def active(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """(url, fetched, key, action) of every list entry that was active for a distinct
    (url, fetched) of the captures. Path keys go as deep as the list's deepest entry, and
    intervals are laid out up to the captures' last date."""
    at_most = captures.agg(F.max(F.col(fetched).cast("date"))).first()[0]
    last = F.lit(at_most).cast("date")
    deepest = entries.where(F.col("key").startswith("p:")).agg(F.max(F.size(F.split("key", "/")) - 2)).first()[0]
    month = lambda d: F.year(d) * 12 + F.month(d)
    until = F.least(F.coalesce(F.date_sub("valid_to", 1), last), last)
    valid = (intervals(entries).where(F.col("valid_from") <= last)
             .withColumn("month", F.explode(F.sequence(month(F.col("valid_from")), month(until)))))
    looked = (captures.where(F.col(url).isNotNull() & F.col(fetched).isNotNull())
              .select(F.col(url).alias("_url"), F.col(fetched).alias("_at")).distinct()
              .select("_url", "_at", month(F.col("_at")).alias("month"),
                      F.explode(F.array_distinct(keys(F.col("_url"), max(deepest or 0, 0)))).alias("key")))
    return (looked.join(valid, ["key", "month"])
            .where((F.col("_at") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to"))))
            .select(F.col("_url").alias(url), F.col("_at").alias(fetched), "key", "action"))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """(url, fetched, active, matched, blocked) of every distinct (url, fetched) that an
    entry was active for: how many there were, the key that decides, what it says."""
    rank = F.struct(F.when(F.col("key").startswith("u:"), 3).when(F.col("key").startswith("p:"), 2).otherwise(1).alias("kind"),
                    F.length("key").alias("length"), (F.col("action") == BLOCK).alias("blocks"), F.col("key").alias("key"))
    return (active(captures, entries, url, fetched).groupBy(url, fetched)
            .agg(F.count_distinct("key").alias("active"), F.max(rank).alias("top"))
            .select(url, fetched, "active", F.col("top.key").alias("matched"), F.col("top.blocks").alias("blocked")))


def filter_captures(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """Every capture with ``active`` (0 without any), ``matched`` and ``blocked``."""
    found = judge(captures, entries, url, fetched)
    return (captures.drop("active", "matched", "blocked").join(found, [url, fetched], "left").select(
        *[f"`{c}`" for c in captures.columns if c not in ("active", "matched", "blocked")],
        F.coalesce("active", F.lit(0)).cast("long").alias("active"), "matched", F.coalesce("blocked", F.lit(False)).alias("blocked")))
