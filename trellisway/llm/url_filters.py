"""URL filters by a temporal list join.

Dated list entries (a domain is added to or removed from a list on a day) become validity
intervals [since, until). Each capture asks for its host and the parent domains of it; an
interval join on the domain keeps the entries active when the page was fetched.

Bounds: intervals are broadcast only if they number at most `broadcast_rows`; beyond it the
join shuffles, with captures dealt over `salts` and the intervals copied to each salt, as a
third of all captures may ask for one host. A capture asks for at most as many domains as
its host has labels.

Defined results: a null or hostless url is never listed; a null fetch day meets no
interval; of entries of one domain and list on one day the one with the largest action
counts ('remove' after 'add'), repeated ones once; an empty list blocks nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellisway.llm.common import checkpointed

#: Scheme, optional user, host, which may be an address in brackets; ports, paths, queries and fragments end the host.
HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#@\]]*\]|[^/?#:@]+)"


def host_of(url: Column) -> Column:
    """The host in lower case without a final dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, HOST_PATTERN, 1))
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def asked_domains(host: Column) -> Column:
    """The host and its parents down to two labels: a.b.example.com, b.example.com, example.com."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(n < 3, F.array(host)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.greatest(n - i + 1, F.lit(0))), "."))
    )


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, domain, since, until) from (list, domain, day, action); until is null while the entry stands.

    Entries of the same kind that follow one another are one interval."""
    daily = entries.where("domain IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')").groupBy("list", "domain", "day").agg(F.max("action").alias("action"))
    order = Window.partitionBy("list", "domain").orderBy("day")
    changes = daily.withColumn("previous", F.lag("action").over(order)).where("previous IS NULL OR previous <> action")
    return changes.withColumn("until", F.lead("day").over(order)).where("action = 'add'").select("list", "domain", F.col("day").alias("since"), "until")


def active_entries(captures: DataFrame, intervals: DataFrame, id_col: str, host_col: str, day_col: str, broadcast_rows: int = 100_000, salts: int = 16) -> DataFrame:
    """(id, host, day, list, domain, since) for each entry that is active at a capture."""
    intervals = checkpointed(intervals)
    hosted = captures.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), F.col(day_col).alias("fetched")).where("host IS NOT NULL")
    asked = hosted.withColumn("asked", F.explode(asked_domains(F.col("host"))))
    match = (F.col("asked") == F.col("domain")) & (F.col("fetched") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    if intervals.limit(broadcast_rows + 1).count() <= broadcast_rows:
        met = asked.join(F.broadcast(intervals), match)
    else:
        copies = intervals.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = asked.withColumn("salt", F.pmod(F.xxhash64("id", "fetched"), F.lit(salts)).cast("int")).join(copies, match & (F.col("salt") == F.col("copy")))
    return met.select("id", "host", "fetched", "list", "domain", "since")


def url_filter(captures: DataFrame, entries: DataFrame, id_col: str, url_col: str, day_col: str, broadcast_rows: int = 100_000) -> DataFrame:
    """One row for each (id, host, day) of the captures: `blocked`, and `reasons` as sorted 'list:domain'."""
    hosted = captures.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), F.col(day_col).alias("fetched"))
    met = active_entries(hosted, validity_intervals(entries), "id", "host", "fetched", broadcast_rows)
    said = met.select("id", "host", "fetched", F.concat_ws(":", "list", "domain").alias("reason"))
    every = hosted.withColumn("reason", F.lit(None).cast("string")).unionByName(said)
    return every.groupBy("id", "host", "fetched").agg(F.sort_array(F.collect_set("reason")).alias("reasons")).withColumn("blocked", F.size("reasons") > 0)
