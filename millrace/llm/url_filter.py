"""Temporal join of captures with dated list entries, in DataFrame functions only.

Dated entries (add or remove a key of a list) become validity intervals; an as-of join finds, for every capture, the
entries of its host and of the host's parent domains that were active at its fetch time. Intervals are cut at time
buckets, so that the equality part of the join is (key, bucket) and only intervals of the capture's own bucket are
compared. The longest key decides, then the latest start, then the list's name. Verdicts are made once for each host and
time; only then do they meet the captures, whose other columns are moved once.

Defined results: a null or hostless url, or a null fetch time, matches nothing and is allowed; an entry with a null
list, key or date is void; keys are compared without case or final dots; entries of one key and moment count once, a removal
wins over an addition; parents of more than LABELS labels are no names; a repeated capture keeps its own row; columns of the input other than url and time pass through unless the result has their name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scheme and user info before a host (a fixed pattern).
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
BUCKET_DAYS = 30
#: Labels of a domain name at most.
LABELS = 127
RESULT = ["host", "n_active", "blocked", "matched_key", "matched_list", "active_since"]


def host_of(url: Column) -> Column:
    """Lower-case host without a final dot; null if there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", ""), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains of two to LABELS labels; a host of one label stands alone."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.greatest(F.lit(2), n - LABELS + 1), F.greatest(n - 1, F.lit(2))), lambda i: F.array_join(F.slice(labels, i, F.greatest(n - i + 1, F.lit(0))), "."))
    return F.when(n > 2, F.concat(F.array(host), parents)).otherwise(F.array(host))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, action, key, since, until) from entries (list, action, key, at, added): until is null while still listed."""
    # keys as hosts are written: entries that differ in case or a final dot are of one key
    held = entries.withColumn("key", F.regexp_replace(F.lower("key"), r"\.+$", ""))
    held = held.filter(F.col("list").isNotNull() & (F.col("key") != "") & F.col("at").isNotNull())
    held = held.groupBy("list", "key", "at").agg(F.min(F.coalesce("added", F.lit(True))).alias("added"), F.min("action").alias("action"))
    order = Window.partitionBy("list", "key").orderBy("at")
    return held.withColumn("until", F.lead("at").over(order)).filter("added").select("list", "action", "key", F.col("at").alias("since"), "until")


def _bucket(at: Column) -> Column:
    return F.floor(F.unix_seconds(at) / F.lit(86_400 * BUCKET_DAYS)).cast("long")


def matched(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """``captures`` with host, n_active (entries in force), blocked, matched_key, matched_list, active_since."""
    names = [c for c in captures.columns if c not in RESULT]
    own, at = host_of(F.col(f"`{url}`")), F.col(f"`{fetched}`")
    asked = captures.select(own.alias("_host"), at.alias("_at")).filter("_host IS NOT NULL AND _at IS NOT NULL").distinct()
    keyed = asked.select("*", _bucket(F.col("_at")).alias("_bucket"), F.explode(suffixes(F.col("_host"))).alias("_key"))
    last = captures.agg(F.max(_bucket(at)).alias("_last"))
    spans = intervals(entries).crossJoin(F.broadcast(last))  # one row
    spans = spans.withColumn("_until", F.least(F.coalesce(_bucket(F.col("until")), F.col("_last")), F.col("_last")))
    spans = spans.filter(_bucket(F.col("since")) <= F.col("_until")).withColumn("_in", F.explode(F.sequence(_bucket(F.col("since")), F.col("_until"))))
    spans = spans.select(F.col("key").alias("_listed"), "_in", "list", "action", "since", "until")
    active = (F.col("_key") == F.col("_listed")) & (F.col("_bucket") == F.col("_in")) & (F.col("_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("_at") < F.col("until")))
    best = F.max_by(F.struct(F.col("_key").alias("key"), "list", "action", "since"), F.struct(F.length("_key"), F.col("since"), F.col("list")))
    verdicts = keyed.join(spans, active).groupBy("_host", "_at").agg(F.count("*").alias("_n"), best.alias("_best"))
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_own"), own.alias("host"), at.alias("_fetched"))
    out = rows.join(verdicts, (F.col("host") == F.col("_host")) & (F.col("_fetched") == F.col("_at")), "left")
    found = F.col("_n").isNotNull()
    return out.select(
        *[F.col(f"_own.`{c}`") for c in names],
        "host",
        F.coalesce("_n", F.lit(0)).cast("long").alias("n_active"),
        (found & F.coalesce(F.col("_best.action") == "block", F.lit(False))).alias("blocked"),
        F.col("_best.key").alias("matched_key"),
        F.col("_best.list").alias("matched_list"),
        F.col("_best.since").alias("active_since"),
    )
