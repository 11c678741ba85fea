"""Token labels: BIO to spans and back, sub-words, sliding windows, strict entity scores."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bio_spans(tokens: DataFrame, seq: str = "seq", pos: str = "pos", label: str = "label", join_other_type: bool = True) -> DataFrame:
    """(seq, type, first, last) from labels B-x, I-x, O. B begins a span, I goes on or begins one; with ``join_other_type`` an I of
    another type goes on, else it begins a new span."""
    order = W.partitionBy(seq).orderBy(pos)
    rows = tokens.select(seq, pos, F.substring(label, 1, 1).alias("b"), F.expr(f"substring({label}, 3)").alias("type"))
    was, was_type = F.lag("b", 1, "O").over(order), F.lag("type").over(order)
    new = (F.col("b") == "B") | ((F.col("b") == "I") & ((was == "O") | (F.lit(not join_other_type) & (was_type != F.col("type")))))
    rows = rows.withColumn("new", new.cast("int")).filter("b <> 'O'").withColumn("span", F.sum("new").over(order))
    return rows.groupBy(seq, "span").agg(F.min_by("type", pos).alias("type"), F.min(pos).alias("first"), F.max(pos).alias("last")).drop("span")


def span_labels(n: Column, spans: Column) -> Column:
    """The labels of n tokens from array<struct<first, last, type>> (both inclusive); later spans overwrite, those outside are skipped."""
    blank = F.array_repeat(F.lit("O"), n)
    good = F.filter(spans, lambda s: (s["first"] >= 0) & (s["first"] <= s["last"]) & (s["last"] < n))

    def paint(acc: Column, s: Column) -> Column:
        return F.transform(acc, lambda old, i: F.when(i == s["first"], F.concat(F.lit("B-"), s["type"])).when((i > s["first"]) & (i <= s["last"]), F.concat(F.lit("I-"), s["type"])).otherwise(old))

    return F.aggregate(good, blank, paint)


def renamed(labels: Column, kinds: dict[str, str]) -> Column:
    """BIO labels with their types renamed; types that ``kinds`` lacks become O."""
    names = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    new = lambda x: F.try_element_at(names, F.substr(x, F.lit(3)))
    return F.transform(labels, lambda x: F.when(x.rlike("^[BI]-") & new(x).isNotNull(), F.concat(F.substr(x, F.lit(1), F.lit(2)), new(x))).otherwise("O"))


def ends_inclusive(rows: DataFrame, tokens: str = "tokens", spans: str = "spans") -> DataFrame:
    """One row: ``inclusive``, whether all span ends (first, last) lie within their tokens. Over all rows, not the first few."""
    return rows.agg(F.coalesce(F.bool_and(F.forall(spans, lambda s: s["last"] < F.size(tokens))), F.lit(True)).alias("inclusive"))


def subword_labels(rows: DataFrame, seq: str, pos: str, word: str, label: str) -> DataFrame:
    """First sub-words keep their word's label; other sub-words and special tokens get -100."""
    before = F.lag(word).over(W.partitionBy(seq).orderBy(pos))
    return rows.withColumn("aligned", F.when(F.col(word).isNull() | (F.col(word) == before), -100).otherwise(F.col(label)).cast("bigint"))


def central_window(n: Column, size: int = 120, stride: int = 100) -> Column:
    """For each of n positions, the window (of those beginning every ``stride``) in which it is most central; the first of equals."""
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride))

    def best(i: Column) -> Column:
        holds = F.filter(starts, lambda s: (s <= i) & (i < s + size))
        ranked = F.transform(holds, lambda s: F.struct((-F.least(i - s, F.least(F.lit(size), n - s) - 1 - (i - s))).alias("c"), s.alias("s")))
        return F.array_min(ranked)["s"]

    return F.transform(F.sequence(F.lit(0), n - 1), best)


def _aligned(raws: pd.Series, words: pd.Series) -> pd.DataFrame:
    out = []
    for raw, ws in zip(raws, words, strict=True):
        seen: list[tuple[str, int, int]] = []  # visible characters with their marks
        for i, c in enumerate(raw or ""):
            if seen and unicodedata.combining(c) and seen[-1][2] == i:
                seen[-1] = (seen[-1][0] + c, seen[-1][1], i + 1)
            elif not c.isspace():
                seen.append((c, i, i + 1))
        shown = [unicodedata.normalize("NFC", c) for c, _, _ in seen]
        at, places = 0, []
        for w in () if ws is None else ws:
            core = list(unicodedata.normalize("NFC", w.replace("_", "")))
            if shown[at : at + len(core)] != core:
                break
            if core:
                places.append({"word": w, "start": seen[at][1], "end": seen[at + len(core) - 1][2]})
            at += len(core)
        out.append((places, at == len(seen)))
    return pd.DataFrame(out, columns=["words", "whole"])


def aligned_words(text: Column, words: Column) -> Column:
    """struct<words array<struct<word, start, end>>, whole>: a tokenizer's words (``_`` joins their parts) at their places in the text, up to
    the first that differs; ``whole`` if all of the text is covered. White space and the way marks are composed don't count."""
    return F.pandas_udf(_aligned, "words array<struct<word:string,start:bigint,end:bigint>>, whole boolean")(text, words)


def scores(gold: DataFrame, found: DataFrame, keys: list[str], kind: str = "type") -> DataFrame:
    """(label, tp, fp, fn, support, precision, recall, f1) per label and for all (micro); a division by zero is 0."""
    a = gold.select(*keys, kind).distinct().withColumn("g", F.lit(1))
    b = found.select(*keys, kind).distinct().withColumn("p", F.lit(1))
    both = a.join(b, [*keys, kind], "full")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    sums = both.rollup(kind).agg(count(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"), count(F.col("g").isNull()).alias("fp"), count(F.col("p").isNull()).alias("fn"), F.grouping(kind).alias("__all"))
    rate = lambda x, y: F.when(y == 0, 0.0).otherwise(x / y)
    out = sums.select(F.when(F.col("__all") == 1, "micro").otherwise(F.col(kind)).alias("label"), "tp", "fp", "fn", (F.col("tp") + F.col("fn")).alias("support"))
    out = out.withColumn("precision", rate(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", rate(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def word_cost(gold: DataFrame, found: DataFrame, keys: list[str], words: str = "n_words", kind: str = "type") -> DataFrame:
    """One row: words missed, spurious and of the wrong type (which count twice) against the words of gold."""
    a = gold.select(*keys, F.col(kind).alias("gk"), F.col(words).alias("gw"))
    b = found.select(*keys, F.col(kind).alias("fk"), F.col(words).alias("fw"))
    cost = F.when(F.col("fk").isNull(), F.col("gw")).when(F.col("gk").isNull(), F.col("fw")).when(F.col("gk") != F.col("fk"), 2 * F.col("gw")).otherwise(0)
    return a.join(b, keys, "full").agg(F.sum(cost).cast("bigint").alias("cost"), F.sum("gw").cast("bigint").alias("n_ref"))
