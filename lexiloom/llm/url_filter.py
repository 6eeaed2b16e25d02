"""URL filtering against a dated list: every capture is judged by the entries active when it was fetched.

Changes of the list (an entry is added or removed on a day) become validity intervals; an as-of
join on an entry's key finds the interval that holds the capture's day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The list is broadcast up to so many intervals (about 100 bytes each); beyond that both sides are shuffled by key.
BROADCAST_ROWS = 200_000
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and final dot; empty if there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1)), r"\.$", "")


def intervals(changes: DataFrame) -> DataFrame:
    """entry, since, until (exclusive; null: open) from changes: entry, action (``add`` or ``remove``), day.

    The last change of an entry up to a day holds; of several on one day a removal wins. Repeated
    additions continue an interval as one that touches it. Entries and days that are null, and other actions, are left out.
    """
    clean = changes.filter("entry is not null and day is not null and action in ('add', 'remove')").groupBy("entry", "day").agg(F.max("action").alias("action"))
    following = F.lead("day").over(W.partitionBy("entry").orderBy("day"))
    return clean.withColumn("until", following).filter("action = 'add'").select("entry", F.col("day").alias("since"), "until")


def keys_of(url: Column, labels: Column | None = None, depth: Column | None = None) -> Column:
    """What an entry may be to match a URL: the host, each parent domain of two or more labels, and the host with each leading part of the path up to a slash.

    labels and depth: the most labels and slashes that an entry has; longer keys than those match nothing and are not made, which keeps the
    keys of a URL with very many dots or slashes short.
    """
    host, most = host_of(url), labels
    labels = F.split(host, r"\.")
    n = F.size(labels)
    last = F.greatest(n - 1, F.lit(1))
    first = F.lit(1) if most is None else F.least(last, F.greatest(F.lit(1), n - most + 1))
    domains = F.transform(F.sequence(first, last), lambda i: F.array_join(F.slice(labels, i, n), "."))
    path = F.regexp_extract(F.coalesce(url, F.lit("")), _PATH, 1)
    parts = F.split(path, "/")
    slashes = F.size(parts) - 1 if depth is None else F.least(F.size(parts) - 1, depth)
    prefixes = F.when(slashes > 0, F.transform(F.sequence(F.lit(1), F.greatest(slashes, F.lit(1))), lambda i: F.concat(host, F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(domains, prefixes)))


def filter_urls(pages: DataFrame, changes: DataFrame, day: Column, page_id: str = "page_id", url: str = "url", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row per capture: page_id, fetch_day, blocked, n_entries (active ones that match), entry (the smallest of them).

    A null or unparsable URL and a null day match nothing. Repeated rows stay apart, an empty table gives an empty one, URLs may be of any length. A
    capture's keys are joined by key; where the list is too long to broadcast the join is a shuffle
    of narrow rows whose hot hosts adaptive execution splits, since no list entry has more
    rows than changes. The count per capture is summed before it is shuffled.
    """
    spans = intervals(changes)
    if spans.limit(broadcast_rows + 1).count() <= broadcast_rows:
        spans = F.broadcast(spans)
    count = lambda sign: F.coalesce(F.max(F.size(F.split("entry", sign))), F.lit(1))
    labels, slashes = changes.agg(count(r"\."), count("/") - 1).first()
    keys = keys_of(F.col(url), F.lit(labels), F.lit(slashes))
    rows = pages.select(F.col(page_id).alias("page_id"), day.alias("fetch_day"), F.monotonically_increasing_id().alias("row"), keys.alias("keys"))
    asked = rows.select("page_id", "fetch_day", "row", F.explode_outer("keys").alias("key"))
    active = (F.col("key") == F.col("list.entry")) & (F.col("fetch_day") >= F.col("list.since")) & (F.col("list.until").isNull() | (F.col("fetch_day") < F.col("list.until")))
    met = asked.join(spans.alias("list"), active, "left")
    out = met.groupBy("row", "page_id", "fetch_day").agg(F.count("list.entry").alias("n_entries"), F.min("list.entry").alias("entry"))
    return out.select("page_id", "fetch_day", (F.col("n_entries") > 0).alias("blocked"), "n_entries", "entry")
