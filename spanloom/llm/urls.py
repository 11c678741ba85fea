"""URL filters: block lists with dated entries, joined as of the time of each capture.

A list is a log of (pattern, kind, action, time): an entry is active from the moment of its ``add`` until the next ``remove`` of the same
pattern. The log becomes validity intervals, and every capture is joined with the intervals that hold at its fetch time, to the
microsecond. Patterns are of two kinds: a domain (which covers its subdomains) or a path word (a whole segment of the URL's path).
A capture is looked up under each of its domain suffixes and path segments, so the join is an equi-join with a range on
top, never a comparison of all captures with all patterns.

Lists up to BROADCAST_INTERVALS intervals go to all tasks; longer ones are joined by shuffle, after patterns that no capture has are
left out. There a pattern that many captures have (a top-level domain) is salted: its captures are dealt over as many parts as its share asks,
and its intervals are repeated for each part.

Defined results: a null URL or one without a host is looked up under its path alone; a null fetch time matches nothing; times without a
zone are the session's; days count from their midnight; an entry added twice stays active from the first time; add and remove at one time: the
remove wins; patterns are compared in lower case; entries with null fields count as absent; repeated captures are judged each; an empty list
blocks nothing; extra columns of either table don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.core import HOT_ONE_IN, col, durable, plainly

#: Lists up to this many intervals are broadcast (at under 200 bytes each, 20 MB); longer ones are joined by shuffle.
BROADCAST_INTERVALS = 100_000


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))


def suffixes(host: Column) -> Column:
    """a.b.c: a.b.c, b.c, c."""
    parts = F.filter(F.split(host, r"\."), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).otherwise(F.array().cast("array<string>"))


def intervals(log: DataFrame, kind: str = "timestamp_ntz") -> DataFrame:
    """(kind, pattern, since, until) with until null while it lasts: [since, until), as values of the type ``kind``."""
    rows = log.select(F.col("kind"), F.lower("pattern").alias("pattern"), F.col("time").cast(kind).alias("time"), F.col("action")).dropna()
    times = rows.groupBy("kind", "pattern", "time").agg(F.bool_and(F.col("action") == "add").alias("on"))
    order = W.partitionBy("kind", "pattern").orderBy("time")
    turns = times.withColumn("was", F.lag("on").over(order)).filter((F.col("on") & ~F.coalesce("was", F.lit(False))) | (~F.col("on") & F.col("was")))
    return turns.withColumn("until", F.lead("time").over(order)).filter("on").select("kind", "pattern", F.col("time").alias("since"), "until")


def _salted(tries: DataFrame, keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tries (k) and keyed (p) with a salt each, such that no (pattern, salt) has more than about a HOT_ONE_IN-th of all tries."""
    tries = durable(tries)
    asked = durable(tries.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("m")))
    total = asked.agg(F.sum("m")).first()[0] or 0
    parts = F.ceil(F.col("m") / F.lit(max(1, total // HOT_ONE_IN))).cast("int")
    hot = asked.select(F.col("k").alias("hk"), parts.alias("parts")).filter("parts > 1")  # by counting, fewer than HOT_ONE_IN
    some = keyed.join(asked.select(F.col("k").alias("hk"), parts.alias("parts")), F.col("p") == F.col("hk")).drop("hk")
    some = some.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("ps")).drop("parts")
    dealt = tries.join(F.broadcast(hot), F.col("k") == F.col("hk"), "left")
    salt = F.pmod(F.xxhash64("key", "url", "fetched"), F.coalesce("parts", F.lit(1))).cast("int")
    return dealt.withColumn("s", salt).drop("hk", "parts"), some


def judge_captures(captures: DataFrame, log: DataFrame, key: str = "page_id", url: str = "url", at: str = "fetched") -> DataFrame:
    """(key, url, fetched, blocked, n_entries, entry) for every capture: whether an entry is active at its fetch time, how
    many are, and the first of them (by kind and pattern)."""
    # instants if either side has them, else times as they stand: no zone's clock change may move one past the other
    kind = "timestamp" if "timestamp" in (dict(log.dtypes)["time"], dict(captures.dtypes)[at]) else "timestamp_ntz"
    keyed = intervals(log, kind).select(F.concat_ws(":", "kind", "pattern").alias("p"), "since", "until")
    rows = captures.select(col(key).alias("key"), col(url).alias("url"), col(at).alias("fetched"))
    domains = F.transform(suffixes(host_of(F.col("url"))), lambda d: F.concat(F.lit("domain:"), d))
    words = F.transform(F.filter(F.split(path_of(F.col("url")), "/"), lambda p: p != ""), lambda p: F.concat(F.lit("path:"), p))
    keys = F.array_distinct(F.coalesce(F.concat(domains, words), F.array().cast("array<string>")))
    # distinct captures are judged once and the verdict is spread over the repeats only by their count
    looked = rows.groupBy("key", "url", "fetched").agg(F.count(F.lit(1)).alias("copies"))
    tries = looked.select("*", F.explode_outer(keys).alias("k"))
    # the list's own size decides: limit() reads no further than the bound
    if keyed.limit(BROADCAST_INTERVALS + 1).count() <= BROADCAST_INTERVALS:
        same, keyed = F.col("k") == F.col("p"), F.broadcast(keyed)
    else:
        tries, keyed = _salted(tries, keyed)
        same = (F.col("k") == F.col("p")) & (F.col("s") == F.col("ps"))
    time = F.col("fetched").cast(kind)
    hit = tries.join(keyed, same & (time >= F.col("since")) & (F.col("until").isNull() | (time < F.col("until"))), "left")
    found = hit.groupBy("key", "url", "fetched").agg(F.first("copies").alias("copies"), F.count("p").alias("n_entries"), F.min("p").alias("entry"))
    each = found.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return each.select(F.col("key").alias(key), F.col("url").alias(url), F.col("fetched").alias(at), (F.col("n_entries") > 0).alias("blocked"), "n_entries", "entry")


def drop_blocked(captures: DataFrame, log: DataFrame, key: str = "page_id", url: str = "url", at: str = "fetched") -> DataFrame:
    """The captures that no active entry covers, with their columns as they are."""
    rows, (k, u, t) = plainly(captures, key, url, at)
    bad = judge_captures(rows, log, k, u, t).filter("blocked").select(F.col(k).alias("__k"), F.col(u).alias("__u"), F.col(t).alias("__t")).distinct()
    kept = rows.join(bad, F.col(k).eqNullSafe(F.col("__k")) & F.col(u).eqNullSafe(F.col("__u")) & F.col(t).eqNullSafe(F.col("__t")), "left_anti")
    return kept.toDF(*captures.columns)


#: A dated list: pattern, kind, action, time.
LIST = [
    ("example.net", "domain", "add", "2024-03-01 00:00:00"),
    ("example.net", "domain", "remove", "2024-05-15 12:30:00"),
    ("example.net", "domain", "add", "2024-10-01 00:00:00"),
    ("blog.thand.example.com", "domain", "add", "2024-01-01 00:00:00"),
    ("m.ththth.example.net", "domain", "add", "2024-01-20 20:00:00"),
    ("m.ththth.example.net", "domain", "remove", "2024-02-20 08:00:00"),
    ("com", "domain", "add", "2024-12-24 18:00:00"),
    ("com", "domain", "remove", "2024-12-27 06:00:00"),
    ("fr", "path", "add", "2024-06-01 09:15:00"),
    ("fr", "path", "add", "2024-06-20 00:00:00"),
    ("fr", "path", "remove", "2024-07-01 00:00:00"),
    ("es", "path", "add", "2024-07-01 00:00:00"),
    ("es", "path", "remove", "2024-07-01 00:00:00"),
    ("DE", "path", "add", "2024-08-01 13:00:00"),
]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against LIST; the tables have no fetch times, so page_id deals the captures over the minutes of 2024."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    minute = F.pmod(F.col("page_id") * 5237, F.lit(366 * 1440)).cast("int")
    captures = pages.withColumn("fetched", F.timestamp_add("MINUTE", minute, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    log = spark.createDataFrame(LIST, "pattern string, kind string, action string, time string").withColumn("time", F.col("time").cast("timestamp_ntz"))
    return judge_captures(captures, log).withColumn("fetched", F.date_format("fetched", "yyyy-MM-dd HH:mm:ss"))


OP8_SQL = (
    "WITH log(pattern, kind, action, time) AS (VALUES "
    + ", ".join(f"('{p.lower()}', '{k}', '{a}', TIMESTAMP '{d}')" for p, k, a, d in LIST)
    + r"""),
times AS (SELECT kind, pattern, time, bool_and(action = 'add') AS onn FROM log GROUP BY ALL),
spans AS (
  SELECT kind || ':' || pattern AS p, time AS since, lead(time) OVER w AS until, onn FROM (
    SELECT *, lag(onn) OVER (PARTITION BY kind, pattern ORDER BY time) AS was FROM times)
  WHERE (onn AND NOT coalesce(was, FALSE)) OR (NOT onn AND was) WINDOW w AS (PARTITION BY kind, pattern ORDER BY time)),
caps AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * CAST((page_id * 5237) % (366 * 1440) AS INTEGER) AS fetched,
    lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS host,
    '/' || lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)) || '/' AS path FROM pages),
hits AS (
  SELECT c.page_id, c.url, s.p FROM caps c JOIN spans s ON s.onn AND c.fetched >= s.since AND (s.until IS NULL OR c.fetched < s.until)
    AND CASE WHEN s.p LIKE 'domain:%' THEN ends_with('.' || c.host, '.' || substr(s.p, 8))
             ELSE contains(c.path, '/' || substr(s.p, 6) || '/') END)
SELECT c.page_id, c.url, strftime(c.fetched, '%Y-%m-%d %H:%M:%S') AS fetched, count(h.p) > 0 AS blocked, count(h.p) AS n_entries, min(h.p) AS entry
FROM caps c LEFT JOIN hits h ON c.page_id = h.page_id AND c.url = h.url GROUP BY c.page_id, c.url, c.fetched
"""
)
