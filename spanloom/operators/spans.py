"""Algebra of typed, scored spans (doc_id, start, end, type, score, source, ord): priors, consensus, conflicts, selection.

Scores are integers (hundredths), so that sums compare exactly. ``ord`` breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators.grouped import best_chain, greedy, pick_in_groups

# Weights of sources, adjustments and heading priors, in order.
SOURCE_WEIGHT = {"rule": 100, "dict": 95, "rule_strength": 85, "encoder+kb": 60, "llm": 70}
ABSOLUTE = ("rule", "dict", "rule_strength")
HEADING_MATCH, HEADING_CONFLICT, CONSENSUS, UNKNOWN = 15, -30, 20, 50
HEADING_TYPES = [
    (("bệnh lý mạn", "bệnh lý mãn", "bệnh mãn", "bệnh mạn", "chẩn đoán", "phát hiện chẩn đoán", "kết quả chẩn đoán"), "CHẨN_ĐOÁN"),
    (("triệu chứng", "dấu hiệu lâm sàng", "biểu hiện"), "TRIỆU_CHỨNG"),
    (("thủ thuật", "phẫu thuật"), "TÊN_XÉT_NGHIỆM"),
    (("thuốc", "điều trị"), "THUỐC"),
]
MAX_WORDS = {"THUỐC": 4, "TÊN_XÉT_NGHIỆM": 5, "KẾT_QUẢ_XÉT_NGHIỆM": 4, "TRIỆU_CHỨNG": 6, "CHẨN_ĐOÁN": 8}
MAX_WORDS_OTHER = 6


def base_score(source: Column, own: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for kv in SOURCE_WEIGHT.items() for x in kv])
    return F.coalesce(F.try_element_at(weights, source), own, F.lit(UNKNOWN)).cast("bigint")


def heading_type(heading: Column) -> Column:
    out, low = F.lit(None).cast("string"), F.lower(heading)
    for words, kind in reversed(HEADING_TYPES):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, kind).otherwise(out)
    return out


def with_priors(spans: DataFrame) -> DataFrame:
    """Replaces score by the source's weight, moved by what the heading announces."""
    prior = heading_type(F.col("heading"))
    change = F.when(prior.isNull(), 0).when(prior == F.col("type"), HEADING_MATCH).otherwise(HEADING_CONFLICT)
    return spans.withColumn("score", base_score(F.col("source"), F.col("score")) + change)


def with_consensus(spans: DataFrame) -> DataFrame:
    """Adds the bonus to all spans of a place that two sources or more gave with one type."""
    w = W.partitionBy("doc_id", "start", "end")
    least, most = (lambda c: F.min(c).over(w)), (lambda c: F.max(c).over(w))
    agree = (least("source") < most("source")) & (least("type") == most("type"))
    return spans.withColumn("score", F.col("score") + F.when(agree, CONSENSUS).otherwise(0))


def overlaps(a: str, b: str) -> Column:
    return (F.col(f"{a}.doc_id") == F.col(f"{b}.doc_id")) & (F.col(f"{a}.start") < F.col(f"{b}.end")) & (F.col(f"{b}.start") < F.col(f"{a}.end"))


def without_beaten(spans: DataFrame) -> DataFrame:
    """Drops spans that touch one of an absolute source: an interval anti-join within documents, in one sorted pass.

    In order of the absolute spans' starts and the others' ends, a span is touched if an absolute one before it ends behind its start: the furthest
    end so far says so.
    """
    sure = F.coalesce(F.col("source").isin(*ABSOLUTE), F.lit(False))
    order = W.partitionBy("doc_id").orderBy(F.when(sure, F.col("start")).otherwise(F.col("end")), sure).rowsBetween(W.unboundedPreceding, W.currentRow)
    reach = F.max(F.when(sure, F.col("end"))).over(order)
    return spans.withColumn("__reach", reach).filter(sure | F.col("__reach").isNull() | (F.col("__reach") <= F.col("start"))).drop("__reach")


def best_disjoint(spans: DataFrame, *order: str) -> DataFrame:
    """The spans of each document with the largest sum of scores that don't overlap (weighted interval scheduling), by end, ``order`` and the other columns
    where ends are equal; a span is taken only if that is strictly better. n log n in the spans of a document."""
    return pick_in_groups(spans, ["doc_id"], _by("end", order, spans, ["doc_id"]), ["start", "end", "score"], best_chain)


def _by(first: str, order: tuple[str, ...], spans: DataFrame, keys: list[str]) -> list[str]:
    return list(dict.fromkeys([first, *order, *[c for c in spans.columns if c not in keys]]))


def merge(spans: DataFrame, *order: str) -> DataFrame:
    """Priors, consensus, absolute sources, best disjoint selection."""
    # dealt by document once: the windows of places and of documents both stand on that
    return best_disjoint(without_beaten(with_consensus(with_priors(spans).repartition("doc_id"))), *order)


def first_of_each(spans: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return spans.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def violations(spans: DataFrame, *order: str) -> DataFrame:
    """Neighbours of a document that overlap."""
    w = W.partitionBy("doc_id").orderBy("start", "end", *order)
    return spans.withColumn("next_start", F.lead("start").over(w)).filter(F.col("next_start") < F.col("end"))


def longest_first(spans: DataFrame, *order: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Greedy: longest spans first, those that overlap a taken one are dropped. n log n in the spans of a document."""
    rest = _by("start", order, spans, list(keys))
    return pick_in_groups(spans, list(keys), [F.col("start") - F.col("end"), *(order or ()), *[c for c in rest if c not in order]], ["start", "end"], greedy)


def covered_words(words: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_covered): words (doc_id, start, end) of which a span covers a character; one sorted pass over each document's words and spans."""
    both = words.select("doc_id", F.col("end").alias("at"), F.lit(False).alias("span"), F.col("start").alias("from"), F.lit(None).cast("bigint").alias("to"))
    both = both.unionByName(spans.select("doc_id", F.col("start").alias("at"), F.lit(True).alias("span"), F.lit(None).cast("bigint").alias("from"), F.col("end").alias("to")))
    reach = F.max("to").over(W.partitionBy("doc_id").orderBy("at", "span").rowsBetween(W.unboundedPreceding, W.currentRow))
    hit = both.withColumn("hit", (reach > F.col("from")).cast("int")).filter("not span")
    return hit.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_words"), F.coalesce(F.sum("hit"), F.lit(0)).cast("bigint").alias("n_covered"))


def word_cap(kind: Column) -> Column:
    caps = F.create_map(*[F.lit(x) for kv in MAX_WORDS.items() for x in kv])
    return F.coalesce(F.try_element_at(caps, kind), F.lit(MAX_WORDS_OTHER))


def over_cap(kind: Column, text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))) > word_cap(kind)


def share_gaps(spans: DataFrame, target: dict[str, float], drift: float = 0.15) -> DataFrame:
    """(type, n, gap, off): each type's share of all spans less its target, and whether that is more than ``drift``; null without a target."""
    goals = F.create_map(*[F.lit(x) for kv in target.items() for x in kv])
    counts = spans.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    gap = F.col("n") / F.sum("n").over(W.partitionBy()) - F.try_element_at(goals, F.col("type"))
    return counts.select("type", "n", gap.alias("gap"), (F.abs(gap) > drift).alias("off"))
