"""Fill-in-middle: texts cut into prefix, middle and suffix at the ends of units (lines), as relations.

Units are the matches of a pattern, exploded with their places (their lengths alone, so no text is copied into unit rows); a running sum of the lengths gives
each unit's end. Each document asks for two cuts, which are joined with the units by their number; the offsets found are gathered per document, and the
text is cut there by substring. The texts are shuffled once, to meet their offsets.

Documents are told apart by two 64-bit hashes of id and text, so repeated rows are worked on once and all get the result.

Defined results: a null text is empty; an empty text or one that contains a marker stays plain, without cuts; a null id is hashed as an empty string. A
text without units has no cuts but at 0; where a pattern leaves gaps between units, cuts count the units' characters alone. An empty table gives no rows; other columns pass through, whatever they are called.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.core import durable, plainly

LINES = r"[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Plan:
    """``rate`` and ``spm`` in hundredths: how many documents are transformed, and how many of those with the suffix first."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    units: str = LINES

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if len(set(marks)) < 3 or any(len(m) < 2 or m[0] in m[1:] for m in marks) or len({m[0] for m in marks}) > 1:
            raise ValueError("markers must differ, begin with one character, and have it nowhere else")


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document's id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def _ids(key: Column, text: Column) -> tuple[Column, Column]:
    return tuple(F.xxhash64(F.lit(i), key.isNull(), key, text) for i in (1, 2))


def unit_ends(docs: DataFrame, key: str, text: str, units: str) -> DataFrame:
    """(i, j, unit, end, n): number (from 1) and end of every unit of each distinct document, and how many it has."""
    body = F.coalesce(F.col(text), F.lit(""))
    i, j = _ids(F.col(key), body)
    lengths = F.transform(F.regexp_extract_all(body, F.lit(units), F.lit(0)), lambda u: F.length(u))
    # hashes before the explosion: behind it they would be worked out for each unit
    rows = docs.select(i.alias("i"), j.alias("j"), lengths.alias("sizes")).select("i", "j", F.posexplode("sizes").alias("pos", "size"))
    once = rows.groupBy("i", "j", "pos").agg(F.max("size").alias("size"))  # repeated rows
    doc = W.partitionBy("i", "j")
    ends = F.sum("size").over(doc.orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow))
    return once.select("i", "j", (F.col("pos") + 1).alias("unit"), ends.alias("end"), F.count(F.lit(1)).over(doc).alias("n"))


def cut_points(ends: DataFrame, asked: DataFrame) -> DataFrame:
    """(i, j, n, a, b): the offsets of the first and the second cut of each document; asked: (i, j, n, which, unit)."""
    found = asked.join(ends.select("i", "j", "unit", "end"), ["i", "j", "unit"], "left")
    at = lambda which: F.coalesce(F.max(F.when(F.col("which") == which, F.col("end"))), F.lit(0))
    return found.groupBy("i", "j").agg(F.max("n").alias("n"), at("a").alias("a"), at("b").alias("b"))


def transformed(docs: DataFrame, key: str = "doc_id", text: str = "text", plan: Plan = Plan()) -> DataFrame:
    """docs with a struct ``fim``: n, form, prefix, middle, suffix (null if plain) and output."""
    rows, (k, t) = plainly(docs, key, text)
    ends = durable(unit_ends(rows.select(k, t), k, t, plan.units))
    h = draws(F.col(k), plan.seed)
    # a cut request is a row of a document's first unit; the id's draws come back by its hashes
    ids = _ids(F.col(k), F.coalesce(F.col(t), F.lit("")))
    drawn = rows.select(ids[0].alias("i"), ids[1].alias("j"), h[0].alias("h1"), h[1].alias("h2")).groupBy("i", "j").agg(F.max("h1").alias("h1"), F.max("h2").alias("h2"))
    sized = ends.filter("unit = 1").select("i", "j", "n").join(drawn, ["i", "j"])
    cuts = F.array(*[F.pmod(F.col(c), F.col("n") + 1) for c in ("h1", "h2")])
    one = lambda which, unit: F.struct(F.lit(which).alias("which"), unit.alias("unit"))
    asked = sized.select("i", "j", "n", F.explode(F.array(one("a", F.array_min(cuts)), one("b", F.array_max(cuts)))).alias("r")).select("i", "j", "n", "r.which", F.col("r.unit").cast("int").alias("unit"))
    offsets = cut_points(ends, asked).select(F.col("i").alias("__i"), F.col("j").alias("__j"), F.col("n").alias("__n"), F.col("a").alias("__a"), F.col("b").alias("__b"))

    body = F.coalesce(F.col(t), F.lit(""))
    keyed = rows.withColumn("__x", ids[0]).withColumn("__y", ids[1])
    met = keyed.join(offsets, (F.col("__x") == F.col("__i")) & (F.col("__y") == F.col("__j")), "left")
    a, b = (F.coalesce(c, F.lit(0)).cast("int") for c in ("__a", "__b"))
    marked = F.lit(False)
    for m in (plan.prefix, plan.suffix, plan.middle):
        marked = marked | F.contains(body, F.lit(m))
    plain = (body == "") | marked | (h[2] % 100 >= plan.rate)
    form = F.when(plain, "plain").when(h[3] % 100 < plan.spm, "spm").otherwise("psm")
    cut = lambda x: F.when(F.col("__form") != "plain", x)
    pieces = F.struct(
        F.coalesce("__n", F.lit(0)).cast("bigint").alias("n"),
        F.col("__form").alias("form"),
        cut(F.substr(body, F.lit(1), a)).alias("prefix"),
        cut(F.substr(body, a + 1, b - a)).alias("middle"),
        cut(F.substr(body, b + 1)).alias("suffix"),
    )
    p, s, m = (F.lit(x) for x in (plan.prefix, plan.suffix, plan.middle))
    out = F.when(F.col("__form") == "psm", F.concat(p, "__f.prefix", s, "__f.suffix", m, "__f.middle")).when(F.col("__form") == "spm", F.concat(s, "__f.suffix", p, "__f.prefix", m, "__f.middle")).otherwise(body)
    done = met.withColumn("__form", form).withColumn("__f", pieces).withColumn("fim", F.struct("__f.*", out.alias("output")))
    return done.select(*rows.columns, "fim").toDF(*docs.columns, "fim")


def restored(output: Column, form: Column, plan: Plan = Plan()) -> Column:
    """The text from an output and its form alone."""

    def between(first: str, second: str) -> tuple[Column, Column, Column]:
        at = lambda m: F.instr(output, m)
        one, two = F.substr(output, F.lit(len(first) + 1), at(second) - 1 - len(first)), F.substr(output, at(second) + len(second), at(plan.middle) - at(second) - len(second))
        return one, two, F.substr(output, at(plan.middle) + len(plan.middle))

    prefix, suffix, middle = between(plan.prefix, plan.suffix)
    late, early, core = between(plan.suffix, plan.prefix)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(early, core, late)).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    f = transformed(docs)
    size = lambda part: F.length(f"fim.{part}").cast("bigint")
    return f.select(
        "doc_id",
        "fim.n",
        "fim.form",
        size("prefix").alias("prefix_chars"),
        size("middle").alias("middle_chars"),
        F.sha2("fim.output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("fim.output"), F.col("fim.form")), 256).alias("restored_sha256"),
    )


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || substr(s, 8 * i + 1, 8) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
