"""URL filtering by a temporal list join.

A list is a log of dated entries that add or remove a pattern: a domain (with all below it), a host, or a prefix of
host and path. Each pattern's log becomes disjoint validity intervals. A capture looks up every pattern that could
cover its URL and takes the entries active when it was fetched: an as-of join, done as an equi-join on pattern and
time bucket with the exact bounds as a condition, so no pattern's history meets all captures of a hot host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a time bucket.
BUCKET = 32


def host_of(url: Column) -> Column:
    """The lower-case host of an absolute URL; null otherwise."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(F.length(host) > 0, host)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def intervals(entries: DataFrame) -> DataFrame:
    """``entries(list, kind, pattern, action, at)`` -> ``(list, kind, pattern, valid_from, valid_to)``.

    ``at`` is a date; an entry holds from its day on. ``add`` opens an interval, ``remove`` closes it; repeated adds
    or removes change nothing. Of entries of one day ``remove`` comes first, so a pattern removed and added on a day is
    active. An interval never closed has a null end. Rows with a null list, kind, pattern, date or another action are ignored.
    """
    known = entries.where("list is not null and kind is not null and pattern is not null and at is not null and action in ('add', 'remove')")
    key = ["list", "kind", "pattern"]
    days = known.groupBy(*key, "at").agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    order = Window.partitionBy(*key).orderBy("at")
    turns = days.withColumn("before", F.coalesce(F.lag("on").over(order), F.lit(0))).where("on <> before")
    spans = turns.withColumn("valid_to", F.lead("at").over(order)).where("on = 1")
    return spans.select(*key, F.col("at").alias("valid_from"), "valid_to")


def lengths(entries: DataFrame) -> tuple[list[int], list[int]]:
    """The numbers of path segments and of labels that occur among the prefix and domain patterns."""
    n = F.when(F.col("kind") == "prefix", F.size(F.split("pattern", "/")) - 1).when(F.col("kind") == "domain", F.size(F.split("pattern", r"\.")))
    found = entries.where("pattern is not null").select("kind", n.alias("n")).where("n >= 1").distinct().collect()
    return sorted(x.n for x in found if x.kind == "prefix"), sorted(x.n for x in found if x.kind == "domain")


def patterns_of(url: Column, segments: list[int], label_counts: list[int]) -> Column:
    """All (kind, pattern, rank) that could cover a URL; a higher rank is more specific.

    Domains are the host's trailing labels, prefixes whole path segments, as many as ``label_counts`` and ``segments`` list.
    """
    host, labels = host_of(url), F.split(host_of(url), r"\.")
    n = F.size(labels)
    up_to = lambda counts, most: F.filter(F.array(*map(F.lit, counts)).cast("array<int>"), lambda k: k <= most)
    domains = F.transform(up_to(label_counts, n), lambda k: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, n - k + 1, k), ".").alias("pattern"), k.alias("rank")))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern"), F.lit(150).alias("rank")))
    parts = F.filter(F.split(path_of(url), "/"), lambda p: p != "")
    prefixes = F.transform(
        up_to(segments, F.size(parts)),
        lambda k: F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), k), "/")).alias("pattern"), (k + 200).alias("rank")),
    )
    none = F.array().cast("array<struct<kind:string,pattern:string,rank:int>>")
    return F.when(host.isNotNull(), F.concat(own, F.coalesce(domains, none), F.coalesce(prefixes, none)))


def _bucket(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / BUCKET).cast("int")


def filter_urls(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched", default: str = "allow") -> DataFrame:
    """Evaluate every capture against the entries active on the day it was fetched.

    Returns ``(page_id, url, fetched, verdict, kind, pattern, active_from, n_active)``: the list name of the most
    specific active entry (ties: the latest start, then list name, then pattern) is the verdict, else
    ``default``; ``n_active`` counts the active entries. A null or relative URL, a null time and an empty list give the
    default. Captures that repeat an id and URL and time get one verdict each.
    """
    rows = captures.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{time_col}`").cast("date").alias("fetched"))
    # each distinct URL and day is evaluated once
    asked = rows.where("url is not null and fetched is not null").select("url", "fetched").distinct()
    looked = asked.select("url", "fetched", _bucket(F.col("fetched")).alias("bucket"), F.explode(patterns_of(F.col("url"), *lengths(entries))).alias("p")).select("url", "fetched", "bucket", "p.*")
    last = asked.agg(F.max("fetched").alias("last"))
    spans = intervals(entries).crossJoin(F.broadcast(last)).where("valid_from <= last")
    until = F.least(F.coalesce(F.date_sub("valid_to", 1), F.col("last")), F.col("last"))
    spans = spans.withColumn("bucket", F.explode(F.sequence(_bucket(F.col("valid_from")), _bucket(until)))).drop("last")
    active = looked.join(spans, ["kind", "pattern", "bucket"]).where((F.col("fetched") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("fetched") < F.col("valid_to"))))
    best = F.max_by(F.struct("list", "kind", "pattern", "valid_from"), F.struct("rank", "valid_from", _backwards("list"), _backwards("pattern")))
    verdicts = active.groupBy("url", "fetched").agg(best.alias("b"), F.count(F.lit(1)).alias("n_active"))
    out = rows.join(verdicts, ["url", "fetched"], "left")
    return out.select("page_id", "url", "fetched", F.coalesce("b.list", F.lit(default)).alias("verdict"), F.col("b.kind").alias("kind"), F.col("b.pattern").alias("pattern"), F.col("b.valid_from").alias("active_from"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"))


def _backwards(name: str) -> Column:
    """A key whose greatest value belongs to the first name in byte order (a prefix comes before its extensions)."""
    digits = F.hex(F.encode(F.col(name), "UTF-8"))
    return F.concat(F.translate(digits, "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))
