"""URL filters by a temporal list join, in DataFrame functions only.

A list's dated events (an entry is added or removed) become validity intervals: an addition holds until the entry's
next event. Each capture is evaluated as of its fetch date: it is blocked if an entry for its domain, any parent
domain, or its host with the first segment of its path was active then. Captures that agree in host, segment and date
are evaluated once (a crawl repeats them), and the join is salted, because one parent domain may hold a large share.

Defined cases: a url without a host, and a null url or date, match nothing (blocked is false); hosts are lower-cased,
without user, port and closing dots; of events of one entry on one date, the removal comes last; events with a null
key, date or action are ignored; repeated captures each get a row; extra columns pass through (columns made here
start with ``_url``); empty captures or events give no rows or no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts into which each key's captures are dealt.
SALT = 32


def host(url: Column) -> Column:
    """Lower-case host, or null if there is none."""
    authority = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\\s]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")
    return F.when(bare != "", F.lower(bare))


def segment(url: Column) -> Column:
    """First segment of the path, empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\\s]*/([^/?#]*)", 1), F.lit(""))


def keys(host_: Column, segment_: Column) -> Column:
    """The entries that would match: the host and its parents of two labels or more, and the host with the segment."""
    labels = F.split(host_, r"\.")
    n = F.size(labels)
    parents = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, n - i + 1), "."))))
    whole = F.when(n < 2, F.array(F.concat(F.lit("domain:"), host_)))
    return F.concat(F.coalesce(parents, whole), F.array(F.concat(F.lit("prefix:"), host_, F.lit("/"), segment_)))


def intervals(events: DataFrame) -> DataFrame:
    """key, valid_from, valid_to (null: still valid) from key, action (add or remove) and at."""
    rows = events.where("key is not null and at is not null and action in ('add', 'remove')").select("key", "action", "at")
    later = F.lead("at").over(Window.partitionBy("key").orderBy("at", "action"))
    spans = rows.withColumn("valid_to", later).where("action = 'add' and (valid_to is null or valid_to > at)")
    return spans.select("key", F.col("at").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """captures and host, n_entries (active entries that match) and entry (the first of them by name).

    Columns of captures with these names are replaced.
    """
    captures = captures.drop("host", "n_entries", "entry")
    rows = captures.withColumn("_url_host", host(F.col(url))).withColumn("_url_segment", segment(F.col(url)))
    points = rows.where(F.col("_url_host").isNotNull() & F.col(fetched).isNotNull()).groupBy("_url_host", "_url_segment", F.col(fetched).alias("_url_at")).agg(F.lit(1).alias("_one"))
    salt = F.pmod(F.xxhash64("_url_host", "_url_segment", "_url_at"), F.lit(SALT)).cast("int")
    asked = points.select("_url_host", "_url_segment", "_url_at", salt.alias("_salt"), F.explode(keys(F.col("_url_host"), F.col("_url_segment"))).alias("key"))
    spans = intervals(events).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    met = asked.join(spans, ["key", "_salt"]).where("valid_from <= _url_at and (valid_to is null or _url_at < valid_to)")
    verdicts = met.groupBy("_url_host", "_url_segment", "_url_at").agg(F.count_distinct("key").alias("n_entries"), F.min("key").alias("entry"))
    at = F.col(fetched) == F.col("_url_at")
    out = rows.alias("c").join(verdicts.alias("v"), (F.col("c._url_host") == F.col("v._url_host")) & (F.col("c._url_segment") == F.col("v._url_segment")) & at, "left")
    return out.select(*[F.col(f"c.`{c}`") for c in captures.columns], F.col("c._url_host").alias("host"), F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"), "entry")


def pages_with_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages have no fetch date; the query takes one of 365 days from the page's id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int")))


def listed_hosts(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' own hosts, by a hash of their names: some are added, of those some removed and added again."""
    hosts = pages.select(host(F.col("url")).alias("host")).where("host is not null").groupBy("host").agg(F.lit(1).alias("one"))
    h = F.conv(F.substring(F.md5("host"), 1, 4), 16, 10).cast("int")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    event = lambda key, action, n, if_: F.when(if_, F.struct(key.alias("key"), F.lit(action).alias("action"), day(n).alias("at")))
    domain, prefix = F.concat(F.lit("domain:"), "host"), F.concat(F.lit("prefix:"), "host", F.lit("/de"))
    events = F.array(
        event(domain, "add", h % 300, h % 4 == 0),
        event(domain, "remove", h % 300 + 60, h % 8 == 0),
        event(domain, "add", h % 300 + 120, h % 16 == 0),
        event(prefix, "add", h % 200, h % 5 == 1),
    )
    return hosts.select(F.explode(events).alias("e")).where("e is not null").select("e.*")


def filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pages_with_dates(spark, sf_dir)
    out = evaluate(pages, listed_hosts(pages))
    return out.select("page_id", "host", (F.col("n_entries") > 0).alias("blocked"), "n_entries", "entry")


ORACLE = r"""
WITH c AS (
  SELECT page_id, date '2024-01-01' + CAST(((page_id % 365) + 365) % 365 AS INT) AS fetched,
    NULLIF(lower(regexp_replace(regexp_replace(regexp_replace(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\\s]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\.+$', '')), '') AS host,
    regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\\s]*/([^/?#]*)', 1) AS seg
  FROM pages),
h AS (SELECT host, CAST('0x' || substr(md5(host), 1, 4) AS INT) AS h FROM (SELECT DISTINCT host FROM c WHERE host IS NOT NULL)),
e AS (
  SELECT 'domain:' || host AS key, 'add' AS action, date '2024-01-01' + h % 300 AS dt FROM h WHERE h % 4 = 0
  UNION ALL SELECT 'domain:' || host, 'remove', date '2024-01-01' + (h % 300 + 60) FROM h WHERE h % 8 = 0
  UNION ALL SELECT 'domain:' || host, 'add', date '2024-01-01' + (h % 300 + 120) FROM h WHERE h % 16 = 0
  UNION ALL SELECT 'prefix:' || host || '/de', 'add', date '2024-01-01' + h % 200 FROM h WHERE h % 5 = 1),
i AS (SELECT * FROM (SELECT key, action, dt, lead(dt) OVER (PARTITION BY key ORDER BY dt, action) AS valid_to FROM e) WHERE action = 'add'),
k AS (
  SELECT page_id, host, fetched, 'prefix:' || host || '/' || seg AS key FROM c WHERE host IS NOT NULL
  UNION ALL
  SELECT page_id, host, fetched, 'domain:' || array_to_string(list_slice(string_split(host, '.'), n, len(string_split(host, '.'))), '.')
  FROM c, unnest(range(1, greatest(len(string_split(host, '.')), 2))) AS u(n) WHERE host IS NOT NULL),
m AS (SELECT k.page_id, count(DISTINCT k.key) AS n, min(k.key) AS entry FROM k JOIN i ON k.key = i.key AND i.dt <= k.fetched AND (i.valid_to IS NULL OR k.fetched < i.valid_to) GROUP BY k.page_id)
SELECT c.page_id, c.host, coalesce(m.n, 0) > 0 AS blocked, CAST(coalesce(m.n, 0) AS BIGINT) AS n_entries, m.entry FROM c LEFT JOIN m ON c.page_id = m.page_id
"""
