"""URL filters with dated lists.

A list is a log: on some day a pattern is put on it or taken off. Entries become
validity intervals, from their day to the day of the pattern's next entry. Each
capture is then judged by an as-of join: for each pattern its URL could match, the
entry that was the latest at fetch time. Patterns are hosts, their parent domains
and path prefixes; of the listed patterns that match, the longest one decides.

The as-of join runs on distinct (pattern, time) pairs, which one map-side aggregate
forms, so a host with any share of the captures counts once per time. Captures come
back by equality, where a hot host can be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lookups import lookup
from tidemark.operators.ordered import latest_value, previous_value
from tidemark.sources.scratch import materialize

BLOCK, ALLOW = "block", "allow"


def url_host(url: Column) -> Column:
    """Host in lower case, without user, port and final dot; NULL if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def url_path(url: Column) -> Column:
    """Path without query and fragment, starting with a slash."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def url_patterns(url: Column) -> Column:
    """All patterns a URL matches: host, parent domains, and the host with each path prefix."""
    host, path = url_host(url), url_path(url)
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    prefixes = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(parts)), lambda i: i > 0),
        lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")),
    )
    return F.when(host.isNotNull(), F.array_distinct(F.concat(domains, prefixes)))


def list_intervals(entries: DataFrame) -> DataFrame:
    """(pattern, action, valid_from, valid_to) of `entries(pattern, listed_on, action)`.

    `valid_to` is exclusive, NULL while nothing follows. Of several entries of one
    pattern and time the first action in order counts, so 'allow' wins over 'block'.
    Entries without pattern or time are left out.
    """
    usable = entries.filter("pattern is not null and listed_on is not null")
    one = usable.groupBy("pattern", F.col("listed_on").alias("valid_from")).agg(F.min("action").alias("action"))
    ended = previous_value(one, ["pattern"], [F.col("valid_from").desc()], F.col("valid_from"), "valid_to")
    return ended.select("pattern", "action", "valid_from", "valid_to")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """`captures(capture_id, url, fetched_on)` judged by the list as it was at fetch time.

    Returns capture_id, host, pattern, action, valid_from, valid_to and blocked. The
    longest listed pattern decides (ties of length: the smallest in order); without
    any, pattern to valid_to are NULL and blocked is false. So are captures whose URL
    has no host or that have no fetch time. An entry holds from its own day on, and
    one with an action other than 'block' and 'allow' takes its pattern off the list.
    Captures are told apart by a written row number, so equal ones, ones without a
    capture_id and ones that share it are judged each by their own URL and time. Other
    columns are ignored; empty tables give an empty result or one without matches.
    """
    intervals = materialize(list_intervals(entries), "intervals")
    seen = materialize(
        captures.select(
            F.monotonically_increasing_id().alias("row"), "capture_id", "fetched_on", url_host(F.col("url")).alias("host"), "url"
        ),
        "captures",
    )
    asked = seen.filter("fetched_on is not null").select(
        "row", "fetched_on", F.explode(url_patterns(F.col("url"))).alias("pattern")
    )
    # Every URL has its top-level domain among its patterns, so this side has hot keys.
    listed = lookup(asked, intervals.select("pattern").distinct(), ["pattern"], "left_semi")
    pairs = listed.select("pattern", F.col("fetched_on").alias("at"), F.lit(None).cast(intervals.schema["valid_from"].dataType).alias("valid_from")).distinct()
    starts = intervals.select("pattern", F.col("valid_from").alias("at"), "valid_from")
    # An entry comes before the captures of its own time.
    order = [F.col("at"), F.col("valid_from").asc_nulls_last()]
    dated = latest_value(pairs.unionByName(starts), ["pattern"], order, F.col("valid_from"), "since")
    known = dated.filter("valid_from is null and since is not null").select("pattern", F.col("at").alias("fetched_on"), "since")
    active = known.join(
        intervals.withColumnRenamed("valid_from", "since"), ["pattern", "since"]
    ).filter(F.col("action").isin(BLOCK, ALLOW))
    matches = lookup(listed, active, ["pattern", "fetched_on"], "inner")
    length = F.length("pattern")
    best = matches.groupBy("row").agg(
        F.min(F.struct((-length).alias("order"), "pattern", "action", "since", "valid_to")).alias("best")
    )
    judged = lookup(seen.select("row", "capture_id", "host"), best, ["row"], "left")
    return judged.select(
        "capture_id",
        "host",
        F.col("best.pattern").alias("pattern"),
        F.col("best.action").alias("action"),
        F.col("best.since").alias("valid_from"),
        F.col("best.valid_to").alias("valid_to"),
        F.coalesce(F.col("best.action") == BLOCK, F.lit(False)).alias("blocked"),
    )
