"""The extraction plan: documents to units, rules, dictionary and proposals, merged to spans that are clean, disjoint and verbatim."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import anchor, drugs, rules, spans
from spanloom.sources import work


def rule_spans(docs: DataFrame) -> DataFrame:
    found = rules.lab_pairs(docs)
    return found.select("doc_id", "start", "end", F.col("kind").alias("type"), F.lit("rule").alias("source"), F.lit(None).cast("string").alias("heading"), F.lit(100).cast("bigint").alias("score"), "text")


def dictionary_spans(docs: DataFrame, names: DataFrame) -> DataFrame:
    """Known names with their doses, and unknown names before a dose."""
    found = drugs.find(docs, drugs.dictionary(names))
    return found.select("doc_id", "start", "end", F.lit("THUỐC").alias("type"), "source", F.lit(None).cast("string").alias("heading"), F.when(F.col("source") == "dict", 95).otherwise(85).cast("bigint").alias("score"), "text")


def extract(docs: DataFrame, names: DataFrame, proposals: DataFrame | None = None) -> DataFrame:
    """(doc_id, start, end, type, source, heading, score, text): proposals have the same columns."""
    every = rule_spans(docs).unionByName(dictionary_spans(docs, names))
    if proposals is not None:
        every = every.unionByName(proposals.filter(~F.col("text").rlike(rules.PLACEHOLDER) & ~spans.over_cap(F.col("type"), F.col("text"))))
    return spans.merge(without_edges(every), "start", "type", "source")


def without_edges(found: DataFrame) -> DataFrame:
    """Spans without bullets and punctuation at their ends; those with nothing else go."""
    piece = T.without_edges(F.struct("text", "start", "end"))
    return found.withColumn("__p", piece).filter("__p is not null").withColumn("text", F.col("__p.text")).withColumn("start", F.col("__p.start")).withColumn("end", F.col("__p.end")).drop("__p")


def pooled(branches: list[DataFrame], *order: str) -> DataFrame:
    """The best disjoint spans of several branches by their own scores, without priors and without sources that always win."""
    every = branches[0]
    for other in branches[1:]:
        every = every.unionByName(other)
    return spans.best_disjoint(every, *(order or ("start", "type", "source")))


def finalize(found: DataFrame, docs: DataFrame, names: DataFrame) -> DataFrame:
    """Spans for export: bare ends, diagnoses grown to names, and checked. Found spans are read several times, so they are written once."""
    grown = anchor.extended_by_names(work.written(without_edges(found)), docs, names, only=F.col("type") == "CHẨN_ĐOÁN")
    return checked(grown, docs)


def checked(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The same spans; the query fails at one whose text isn't the document's at its place, or that overlaps the next."""
    after = F.lead("start").over(W.partitionBy("doc_id").orderBy("start", "end"))
    rows = verified(found, docs).withColumn("__next", after)
    where = F.concat(F.col("doc_id").cast("string"), F.lit(": "), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    broken = F.when(~F.col("verbatim"), F.raise_error(F.concat(F.lit("not verbatim: "), where))).when(F.col("__next") < F.col("end"), F.raise_error(F.concat(F.lit("overlap: "), where)))
    return rows.filter(broken.cast("string").isNull()).select(*found.columns)


def verified(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The spans with ``verbatim``: whether the text at their place is theirs."""
    rows = found.join(docs.select("doc_id", F.col("text").alias("__t")), "doc_id")
    return rows.withColumn("verbatim", F.substr(F.col("__t"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")) == F.col("text")).drop("__t")
