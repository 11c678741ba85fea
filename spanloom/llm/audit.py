"""Source divergence audit: which sources of a language use its words unlike one another, and which words set a source apart.

DuckDB does the counting inside the tasks. First each slice of texts: one SQL statement cuts and counts its terms by (lang, source). Spark adds these counts
up and deals them to shards by the hash of (lang, term), so all sources of a term meet, however frequent it is: a shard gets one row per (lang, source, term).
In a shard SQL keeps the terms that enough documents of the language have, and adds up the language. Spark sums the groups' totals, and in a second
pass over the kept terms' shards SQL works out smoothed shares, partial sums over pairs of sources and each group's foremost terms; Spark merges sums and ranks.

Pairs cost what the sources of each term cost: over all kept terms, two sources of which none has a term differ by the same amount z for each, so
a pair's sum is V times the difference of the z, plus corrections from the terms that one has (by a histogram of shares of each source) and from those that both have
(by a join of the shard with itself, summed at once). All sums are of integers.

Defined results: a null text, lang or source is empty; a (lang, source) without terms is a group all the same; a language without kept terms gives its
pairs with value 0 and no terms; a language with one source gives no pairs. Ties rank by the item's bytes. An empty table gives no rows. A document is a row,
so repeated rows count as documents of their own. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.core import col, durable, lean, slices

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS, PRIOR, SCALE, TOP = 30, 5, 1_000_000_000, 50
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _engine() -> duckdb.DuckDBPyConnection:
    """One thread, bounded memory and no files of its own: Spark has the cores, and a task's data is a slice or a shard."""
    return duckdb.connect(config={"threads": 1, "memory_limit": "768MB", "temp_directory": ""})


_COUNT = f"""
WITH t AS (SELECT row_number() OVER () AS r, lang, source, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}') AS w FROM part),
g AS (SELECT lang, source, row_number() OVER () AS g FROM (SELECT DISTINCT lang, source FROM part)),
o AS (SELECT r, g, w FROM t JOIN g USING (lang, source)),
x AS (SELECT r, g, term, count(*) AS n FROM (SELECT r, g, unnest(w) AS term FROM o) GROUP BY ALL),
y AS (SELECT g, term, CAST(sum(n) AS BIGINT) AS n, count(*) AS docs FROM x GROUP BY ALL)
SELECT lang, source, term, n, docs FROM y JOIN g USING (g) UNION ALL SELECT lang, source, '', 0, 0 FROM g
"""


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a row with an empty term for each group."""
    src = docs.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _engine() as db:
            for batch in batches:
                for some in slices(batch, "text", 16 << 20):
                    db.register("part", pa.Table.from_batches([some]))
                    yield from db.sql(_COUNT).to_arrow_table().to_batches()

    parts = src.mapInArrow(run, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _sharded(rows: DataFrame, sql: str, schema: str) -> DataFrame:
    """SQL over each shard (a partition of the hash of lang and term), whose rows it sees as ``shard``."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _engine() as db:
            begun = False
            for batch in batches:
                db.register("batch", pa.Table.from_batches([batch]))
                db.execute("INSERT INTO shard SELECT * FROM batch" if begun else "CREATE TABLE shard AS SELECT * FROM batch")
                begun = True
            if begun:
                yield from db.sql(sql).to_arrow_table().to_batches()

    return rows.repartition("lang", "term").mapInArrow(run, schema)


def kept_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n) of the terms in at least ``min_docs`` documents of a language; the language itself has a null source. Groups keep their rows with an
    empty term."""
    sql = f"""
WITH k AS (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM shard WHERE term <> '' GROUP BY ALL HAVING sum(docs) >= {min_docs})
SELECT lang, source, term, s.n FROM shard s SEMI JOIN k USING (lang, term)
UNION ALL SELECT lang, source, '', 0 FROM shard WHERE term = ''
UNION ALL SELECT lang, NULL, term, n FROM k
UNION ALL SELECT DISTINCT lang, CAST(NULL AS VARCHAR), '', 0 FROM shard WHERE term = ''"""
    return _sharded(counts, sql, "lang string, source string, term string, n bigint")


def share(n: Column, total: Column, terms: Column, prior: int, scale: int) -> Column:
    """1 + floor(scale * (n + prior) / (total + prior * terms)) in exact decimals; null without terms."""
    wide = lambda c: c.cast("decimal(18,0)")
    # of two decimals div gives the whole number
    return F.when(terms > 0, F.call_function("div", wide(n + prior) * F.lit(scale).cast("decimal(18,0)"), wide(total + prior * terms)) + 1).cast("bigint")


def totals(kept: DataFrame, prior: int, scale: int) -> DataFrame:
    """(lang, source, total, terms, z): each group's sum over kept terms, the language's number of them, and the share of a term it doesn't have."""
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum((F.col("term") != "").cast("bigint")).alias("v"))
    terms = sums.filter("source is null").select(F.col("lang").alias("l"), F.col("v").alias("terms"))
    rows = sums.join(terms, F.col("lang") == F.col("l")).drop("l", "v")
    return rows.withColumn("z", share(F.lit(0).cast("bigint"), F.col("total"), F.col("terms"), prior, scale))


_PARTS = """
WITH g AS (SELECT * FROM shard WHERE source IS NOT NULL),
f AS (SELECT g.lang, g.source, g.term, g.p - q.p AS f FROM g JOIN shard q ON q.source IS NULL AND q.lang = g.lang AND q.term = g.term WHERE g.p > q.p AND g.n > 0)
SELECT 'both' AS part, a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p) - abs(a.p - b.z) - abs(a.z - b.p) + abs(a.z - b.z)) AS BIGINT) AS value, CAST(NULL AS BIGINT) AS k
  FROM g a JOIN g b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY a.lang, a.source, b.source
UNION ALL SELECT 'one', lang, source, NULL, p, count(*) FROM g GROUP BY lang, source, p
UNION ALL SELECT 'term', lang, source, term, f, NULL FROM f QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY f DESC, term) <= {top}
"""


def divergence(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", min_docs: int = MIN_DOCS, prior: int = PRIOR, scale: int = SCALE, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group the other sources of its language by difference (part pair, all of them), and the terms that it has
    more of than the language (part term, the first ``top``)."""
    kept = durable(kept_terms(term_counts(docs, lang, source, text), min_docs))
    groups = durable(totals(kept, prior, scale))
    g = groups.select(F.col("lang").alias("gl"), F.col("source").alias("gs"), "total", "terms", "z")
    rows = kept.filter("term <> ''").join(g, (F.col("lang") == F.col("gl")) & F.col("source").eqNullSafe(F.col("gs")))
    shares = rows.select("lang", "source", "term", "n", share(F.col("n"), F.col("total"), F.col("terms"), prior, scale).alias("p"), "z")
    parts = durable(_sharded(shares, _PARTS.format(top=int(top)), "part string, lang string, source string, item string, value bigint, k bigint"))

    one = groups.filter("source is not null").select("lang", "source", "z", "terms")
    other = one.select(F.col("lang").alias("ol"), F.col("source").alias("item"), F.col("z").alias("oz"))
    # a row per pair of sources of a language: the result's own size
    pairs = one.join(other, (F.col("lang") == F.col("ol")) & (F.col("source") != F.col("item"))).drop("ol")
    base = pairs.select("lang", "source", "item", F.coalesce(F.col("terms") * F.abs(F.col("z") - F.col("oz")), F.lit(0)).alias("value"))
    shared = parts.filter("part = 'both'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    shared = shared.unionByName(shared.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    levels = parts.filter("part = 'one'").groupBy("lang", "source", F.col("value").alias("p")).agg(F.sum("k").alias("k"))
    alone = levels.join(pairs, ["lang", "source"]).groupBy("lang", "source", "item").agg(F.sum(F.col("k") * (F.abs(F.col("p") - F.col("oz")) - F.abs(F.col("z") - F.col("oz")))).alias("value"))
    alone = alone.unionByName(alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    summed = base.unionByName(shared).unionByName(alone).groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    terms = parts.filter("part = 'term'").select("lang", "source", "item", "value", "part")
    place = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")).alias("rank")
    names = ["lang", "source", "part", "item", "value"]
    return summed.select(*names, place).unionByName(terms.select(*names, place).filter(F.col("rank") <= top))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
m AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total FROM m),
p AS (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (s.total + 5 * v.v) AS p FROM s JOIN v USING (lang)),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (total + 5 * v) AS q FROM k JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT 'pair' AS part, a.lang, a.source, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT 'term', p.lang, source, term, CAST(p - q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
y AS (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM y WHERE part = 'pair' OR rank <= 50
"""
