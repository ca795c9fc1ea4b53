"""URL filters: dated list entries as validity intervals, joined as of each capture's fetch date.

An entry says from which day on a pattern (a domain with its subdomains, or a host with a
path prefix) is on the list (``block``) or off it again (``allow``). The last entry
of a pattern on a day counts (of entries on one day: block). Entries become intervals
[from, to); a capture has one key per suffix of its host and per path prefix and is
blocked if any key lies in a blocking interval at its fetch date.

The join is an equality on (pattern, month): an interval is repeated for each month it
touches up to the last capture, so a pattern with many entries meets a capture at most
31 times, and a host with any share of the captures is an equality key that adaptive execution
may split. Intervals are built after entries are pre-aggregated to one per
pattern and day, so a window holds at most one row per day.

Defined results: null or unparsable URLs have no keys and are never blocked; a capture without a
date is matched by no entry; entries without pattern, action or date are ignored; repeated entries and
captures are allowed; patterns and hosts are compared in lower case; empty tables
give no rows, respectively no blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tagwright.llm.common import packed, unpacked

HOST = "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def keys_of(url: Column) -> Column:
    """Every suffix of the host, and the host with each prefix of whole path segments."""
    host = host_of(url)
    labels = F.split(host, "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1), "/"), lambda x: x != "")
    prefixes = F.transform(F.when(F.size(path) > 0, F.sequence(F.lit(1), F.size(path))).otherwise(F.array().cast("array<int>")),
                           lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(path, 1, i), "/")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(suffixes, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, from_date, to_date) in which a pattern is blocked; to_date null: still."""
    daily = (entries.where(F.col("pattern").isNotNull() & F.col("action").isNotNull() & F.col("date").isNotNull())
             .groupBy(F.lower("pattern").alias("pattern"), F.col("date").cast("date").alias("from_date"))
             .agg(F.max(F.col("action") == "block").alias("on")))
    days = W.partitionBy("pattern").orderBy("from_date")
    return (daily.withColumn("to_date", F.lead("from_date").over(days)).where("on").select("pattern", "from_date", "to_date"))


def _month(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def filter_urls(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """The captures with ``blocked`` and ``pattern``, the longest pattern that blocks them (of equal length the largest);
    these two replace columns of their names."""
    last = captures.agg(F.max(F.col(fetched).cast("date"))).first()[0]   # one value: no interval is read beyond it
    at = F.col(fetched).cast("date")
    # equal rows are one capture with a count
    rows = captures.groupBy(packed(captures)).agg(F.count(F.lit(1)).alias("_times")).select(
        "_row", "_times", F.sha2(F.to_json("_row"), 256).alias("_id"))
    keyed = rows.select("_id", F.col(f"_row.{fetched}").cast("date").alias("_date"), F.explode(keys_of(F.col(f"_row.{url}"))).alias("_key"))
    keyed = keyed.where(F.col("_date").isNotNull()).withColumn("_at", _month(F.col("_date")))
    on = intervals(entries).where(F.col("from_date") <= F.lit(last))
    until = F.least(F.coalesce(F.date_sub("to_date", 1), F.lit(last)), F.lit(last))
    monthly = on.select(F.col("pattern").alias("_pattern"), "from_date", "to_date",
                        F.explode(F.sequence(_month(F.col("from_date")), F.greatest(_month(F.col("from_date")), _month(until)))).alias("_month"))
    hit = (F.col("_key") == F.col("_pattern")) & (F.col("_at") == F.col("_month"))
    active = keyed.join(monthly, hit).where((F.col("_date") >= F.col("from_date"))
                                            & (F.col("to_date").isNull() | (F.col("_date") < F.col("to_date"))))
    longest = active.groupBy("_id").agg(F.max(F.struct(F.length("_pattern").alias("n"), F.col("_pattern").alias("p"))).alias("_best"))
    out = rows.join(longest, "_id", "left").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return out.select(*unpacked(captures, ("blocked", "pattern")),
                      F.col("_best").isNotNull().alias("blocked"), F.col("_best.p").alias("pattern"))
