"""URL filters by a temporal list join.

Block lists change: an entry puts a domain on a list or takes it off on a day.
The dated entries become validity intervals, and an as-of join evaluates every
capture against the intervals that hold on the day it was fetched.

Captures of one host on one day share one answer, so the join runs over distinct
(host, day) pairs: a host with a third of all captures is as many rows as it has days.
Intervals are cut at month borders, which makes the join an equality on (domain,
month) followed by a comparison within the month. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidentia.llm.common import renamed, table


def url_host(url: Column) -> Column:
    """The host of a URL in lower case without user, port and final dot; null if there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def domains(host: Column) -> Column:
    """A host and its parent domains of two labels or more; an IPv4 address has no parents."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    return F.when(host.rlike(r"^[0-9.]+$"), F.array(host)).otherwise(parents)


def validity(entries: DataFrame) -> DataFrame:
    """Intervals (list_name, domain, valid_from, valid_to) of dated entries.

    entries has list_name, domain, action ("add" or "remove") and day. An interval
    starts on the day of an add and ends before the day of the next remove, or never
    (valid_to null). Of entries for one day a remove comes last. A second add
    changes nothing; entries with nulls don't count.
    """
    entries = renamed(entries, list_name="list_name", domain="domain", action="action", day="day").where(
        "list_name is not null and domain is not null and day is not null and action in ('add', 'remove')"
    )
    w = Window.partitionBy("list_name", "domain").orderBy("day", "action")
    changes = entries.distinct().withColumn("before", F.lag("action").over(w)).where("before is null and action = 'add' or before <> action")
    return (
        changes.withColumn("valid_to", F.lead("day").over(w)).where("action = 'add'")
        .select("list_name", "domain", F.col("day").alias("valid_from"), "valid_to")
        .where("valid_to is null or valid_to > valid_from")
    )


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, fetched, lists (sorted names, comma-joined), n_matches, blocked of each capture.

    captures has page_id, url and fetched (a date). A URL without host, or a null
    date, is on no list. n_matches counts pairs of a list and a domain (the host or
    a parent) that hold. Repeated captures have a row each. No captures give no
    rows, no entries block nothing; other columns are ignored, whatever their names.
    Hosts and days are asked about once each, so a domain that many captures share
    isn't a hot key before its answers are joined to them.
    """
    pages = renamed(captures, page_id="page_id", url="url", fetched="fetched").select("page_id", url_host(F.col("url")).alias("host"), "fetched")
    asked = pages.where("host is not null and fetched is not null").select("host", F.col("fetched").alias("day")).distinct()
    last = asked.agg(F.max("day").alias("last_day"))
    months = F.sequence(F.trunc("valid_from", "month"), F.trunc(F.greatest("valid_from", F.least(F.col("valid_to"), F.col("last_day"))), "month"), F.expr("interval 1 month"))
    # one row on the right: the last day asked about, where open intervals end
    pieces = validity(entries).crossJoin(F.broadcast(last)).where("last_day is not null").withColumn("month", F.explode(months)).drop("last_day")
    keys = asked.withColumn("domain", F.explode(domains(F.col("host")))).withColumn("month", F.trunc("day", "month"))
    held = (
        keys.join(pieces, ["domain", "month"]).where("day >= valid_from and (valid_to is null or day < valid_to)")
        .groupBy(F.col("host").alias("asked_host"), F.col("day").alias("asked_day")).agg(F.array_join(F.array_sort(F.collect_set("list_name")), ",").alias("lists"), F.count("*").alias("n_matches"))
    )
    return pages.join(held, (F.col("host") == F.col("asked_host")) & (F.col("fetched") == F.col("asked_day")), "left").select(
        "page_id", "host", "fetched", F.coalesce("lists", F.lit("")).alias("lists"),
        F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"), F.col("lists").isNotNull().alias("blocked"),
    )


FIRST_DAY = "2024-01-01"


def example_captures(pages: DataFrame) -> DataFrame:
    """The pages, fetched on a day that follows from page_id: the table has no dates."""
    return pages.select("page_id", "url", F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod("page_id", F.lit(360)).cast("int")).alias("fetched"))


def example_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for a quarter of the pages' domains, by a hash of the name: some
    are taken off again, and some of those put back."""
    names = pages.select(url_host(F.col("url")).alias("host")).where("host is not null").distinct().select(F.explode(domains(F.col("host"))).alias("domain")).distinct()
    h = F.conv(F.substring(F.md5("domain"), 1, 6), 16, 10).cast("int")
    on = names.withColumn("h", h).where("h % 4 = 0").select(
        "domain", "h", F.when(F.expr("h % 8 = 0"), "adult").otherwise("malware").alias("list_name"), F.expr("h % 300").alias("d1"),
    )
    events = F.array(
        F.struct(F.lit("add").alias("action"), F.col("d1").alias("d")),
        F.when(F.expr("h % 5 <> 0"), F.struct(F.lit("remove").alias("action"), F.expr("d1 + 30 + h % 60").alias("d"))),
        F.when(F.expr("h % 5 <> 0 and h % 3 = 0"), F.struct(F.lit("add").alias("action"), F.expr("d1 + 50 + h % 60 + h % 50").alias("d"))),
    )
    return on.select("list_name", "domain", F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select(
        "list_name", "domain", "e.action", F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("e.d").cast("int")).alias("day")
    )


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(example_captures(pages), example_entries(pages)).withColumn("fetched", F.col("fetched").cast("string"))


OP5_SQL = r"""
WITH p AS (
  SELECT page_id, nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '.'), '') AS host,
         DATE '2024-01-01' + CAST(page_id % 360 AS INTEGER) AS fetched
  FROM pages),
hosts AS (SELECT DISTINCT host, CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN [host] ELSE
    list_transform(generate_series(1, greatest(len(string_split(host, '.')) - 1, 1)),
      lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')) END AS names
  FROM p WHERE host IS NOT NULL),
hd AS (SELECT host, unnest(names) AS domain FROM hosts),
on_list AS (SELECT domain, h, CASE WHEN h % 8 = 0 THEN 'adult' ELSE 'malware' END AS list_name, h % 300 AS d1
  FROM (SELECT DISTINCT domain, CAST('0x' || substr(md5(domain), 1, 6) AS INTEGER) AS h FROM hd) WHERE h % 4 = 0),
spans AS (
  SELECT list_name, domain, d1 AS a, CASE WHEN h % 5 <> 0 THEN d1 + 30 + h % 60 END AS b FROM on_list
  UNION ALL
  SELECT list_name, domain, d1 + 50 + h % 60 + h % 50, NULL FROM on_list WHERE h % 5 <> 0 AND h % 3 = 0),
m AS (
  SELECT p.page_id, array_to_string(list_sort(list(DISTINCT s.list_name)), ',') AS lists, count(*) AS n_matches
  FROM p JOIN hd ON p.host = hd.host JOIN spans s ON s.domain = hd.domain
   AND p.fetched >= DATE '2024-01-01' + CAST(s.a AS INTEGER) AND (s.b IS NULL OR p.fetched < DATE '2024-01-01' + CAST(s.b AS INTEGER))
  GROUP BY p.page_id)
SELECT p.page_id, p.host, CAST(p.fetched AS VARCHAR) AS fetched, coalesce(m.lists, '') AS lists,
       coalesce(m.n_matches, 0) AS n_matches, m.lists IS NOT NULL AS blocked
FROM p LEFT JOIN m USING (page_id)
"""
