"""Bringing phrases back to the place in a text that they came from, and trimming or extending them by a dictionary.

The ladder: the phrase itself; its words with any white space between, in any case; the same without marks at its ends; and at last the run of
as many words whose spelling is nearest. What a rung finds is not tried again, so the Python rung sees only the rest.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.sources import work

NEAREST = 0.85
SHARE_FOUND = 0.6


def _quoted(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), r"\s+")


def _flexible(text: Column, phrase: Column) -> Column:
    """(start, end) of a phrase with other white space or case, null without."""
    words = F.filter(F.split(phrase, r"(?U)\s+"), lambda w: w != "")
    hit = F.regexp_substr(text, F.concat(F.lit("(?iuU)"), _quoted(words)))
    start = (F.instr(text, hit) - 1).cast("bigint")  # what is found stands nowhere before, as it would have been found there
    return F.when((F.size(words) > 0) & (F.length(hit) > 0), F.struct(start.alias("start"), (start + F.length(hit)).cast("bigint").alias("end")))


def _counted(text: str) -> tuple[list[str], list[int]]:
    """The lower-case characters of a text, one after another, and where those of each character begin. A sigma at the end of a word is one like any other."""
    parts = [c.lower().replace("ς", "σ") for c in text]
    at = [0]
    for p in parts:
        at.append(at[-1] + len(p))
    return list("".join(parts)), at


def best_run(text: str, phrase: str, least: float = NEAREST) -> tuple[int, int] | None:
    """The run of as many words as the phrase has whose ratio to it is largest, and at least ``least``; the first of equals.

    A ratio is at most twice the characters in common over all characters. Running counts of the phrase's characters give that bound for all runs at once; the ratio itself is
    worked out from the largest bound on, until no bound is over the best.
    """
    words, n = list(re.finditer(r"\S+", text)), len(phrase.split())
    if not n or len(words) < n:
        return None
    wanted = " ".join(phrase.lower().split())
    chars, at = _counted(text)
    codes = np.array([ord(c) for c in chars], np.int64)
    first = np.array([at[w.start()] for w in words[: len(words) - n + 1]])
    last = np.array([at[w.end()] for w in words[n - 1 :]])
    common = np.zeros(len(first), np.int64)
    for c, k in Counter(wanted.replace("ς", "σ")).items():
        sums = np.concatenate([[0], np.cumsum(codes == ord(c))])
        common += np.minimum(sums[last] - sums[first], k)
    bound = 2 * common / (last - first + len(wanted))
    best, place = least, None
    matcher = difflib.SequenceMatcher(None, b="", autojunk=True)
    for i in np.lexsort((np.arange(len(bound)), -bound)).tolist():
        if bound[i] < best - 1e-12:
            break
        a, b = words[i].start(), words[i + n - 1].end()
        matcher.set_seqs(wanted, text[a:b].lower())
        ratio = matcher.ratio()
        if ratio > best or (ratio == best and (place is None or a < place[0])):
            best, place = ratio, (a, b)
    return place


def _nearest(texts: pd.Series, phrases: pd.Series) -> pd.DataFrame:
    at, none = np.zeros((len(texts), 2), np.int64), np.ones(len(texts), bool)
    for i in np.flatnonzero((texts.notna() & phrases.notna()).to_numpy()).tolist():  # those that no rung before found
        got = best_run(texts.iloc[i], phrases.iloc[i])
        if got:
            at[i], none[i] = got, False
    return pd.DataFrame({c: pd.arrays.IntegerArray(np.ascontiguousarray(at[:, k]), none.copy()) for k, c in enumerate(("start", "end"))})


def anchor(rows: DataFrame, text: str = "text", phrase: str = "phrase") -> DataFrame:
    """rows with start and end of the phrase in the text, null where no rung finds it. Rows need no key."""
    exact = F.instr(F.col(text), F.col(phrase))
    exact = F.when((F.col(phrase) != "") & (exact > 0), F.struct((exact - 1).cast("bigint").alias("start"), (exact - 1 + F.length(phrase)).cast("bigint").alias("end")))
    bare = F.rtrim(F.ltrim(F.col(phrase), F.lit(T.EDGES)), F.lit(T.EDGES))
    found = F.coalesce(exact, _flexible(F.col(text), F.col(phrase)), _flexible(F.col(text), bare))
    near = F.pandas_udf(_nearest, "start bigint, end bigint")
    open_ = F.col("__at").isNull()
    rest = F.coalesce(F.nullif(bare, F.lit("")), F.col(phrase))
    tried = rows.withColumn("__at", found).withColumn("__near", near(F.when(open_, F.col(text)), F.when(open_, rest)))
    at = F.coalesce("__at", "__near")
    return tried.select(*rows.columns, at["start"].alias("start"), at["end"].alias("end"))


def core_in_names(rows: DataFrame, names: DataFrame, cap: int | Column, text: str = "text", name: str = "name") -> DataFrame:
    """Rows whose text has more than ``cap`` words get the longest run of at most cap words that is a name (the leftmost of equals), with start
    and end moved; those without one are dropped."""
    cap = cap if isinstance(cap, Column) else F.lit(cap)
    words = T.words(F.col(text))
    fits = rows.filter(F.size(words) <= cap)
    # rows that agree in all columns are worked on once and counted
    long = rows.filter(F.size(words) > cap).groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__n")).withColumn("__id", F.xxhash64(*rows.columns)).withColumn("__w", words)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), cap), lambda n: F.transform(F.sequence(F.lit(1), F.size("__w") - n + 1), lambda i: F.struct(n.alias("n"), i.alias("i")))))
    grams = long.withColumn("g", F.explode(runs))
    a, b = F.element_at("__w", F.col("g.i"))["start"], F.element_at("__w", F.col("g.i") + F.col("g.n") - 1)["end"]
    grams = grams.withColumn("__a", a).withColumn("__b", b).withColumn("__c", F.substr(F.col(text), (a + 1).cast("int"), (b - a).cast("int")))
    known = names.select(T.key_form(F.col(name)).alias("__k")).distinct()
    hits = grams.join(known, T.key_form(F.col("__c")) == F.col("__k"), "left_semi")
    first = hits.withColumn("__r", F.row_number().over(W.partitionBy("__id").orderBy(F.col("g.n").desc(), F.col("g.i")))).filter("__r = 1")
    cut = first.withColumn("end", F.col("start") + F.col("__b")).withColumn("start", F.col("start") + F.col("__a")).withColumn(text, F.col("__c"))
    return fits.unionByName(cut.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n").cast("int")))).select(*rows.columns))


def extended_by_names(spans: DataFrame, docs: DataFrame, names: DataFrame, most: int = 8, name: str = "name", only: Column | None = None) -> DataFrame:
    """Spans (those of which ``only`` holds) that aren't names themselves grow to the shortest name that they begin (or else end), up to
    ``most`` words, if that touches no other span of the document."""
    known = names.select(T.key_form(F.col(name)).alias("__k")).distinct()
    ids = spans.withColumn("__id", F.xxhash64(*spans.columns))
    asked = ids if only is None else ids.filter(only)
    own = asked
    # written, so that its size is known: where few spans may grow, neither documents nor spans are shuffled for them, and words are made of no other documents
    own = work.written(own.join(known, T.key_form(F.col("text")) == F.col("__k"), "left_anti"))
    theirs = docs.select("doc_id", F.col("text").alias("__t")).join(own.select("doc_id").distinct(), "doc_id", "left_semi")
    own = own.join(theirs.withColumn("__w", T.words(F.col("__t"))), "doc_id")
    cut = lambda a, b: F.substr(F.col("__t"), (a + 1).cast("int"), (b - a).cast("int"))
    after = F.transform(F.slice(F.filter("__w", lambda w: w["start"] >= F.col("end")), 1, most), lambda w, i: F.struct(F.lit(0).alias("side"), (i + 1).alias("n"), F.col("start").alias("a"), w["end"].alias("b"), cut(F.col("start"), w["end"]).alias("c")))
    left = F.reverse(F.filter("__w", lambda w: w["end"] <= F.col("start")))
    before = F.transform(F.slice(left, 1, most), lambda w, i: F.struct(F.lit(1).alias("side"), (i + 1).alias("n"), w["start"].alias("a"), F.col("end").alias("b"), cut(w["start"], F.col("end")).alias("c")))
    tries = own.select("__id", "doc_id", F.explode(F.concat(after, before)).alias("g")).withColumn("__c", F.col("g.c"))
    tries = tries.filter(F.size(F.split("__c", r"(?U)\s+")) <= most).join(known, T.key_form(F.col("__c")) == F.col("__k"), "left_semi")
    best = tries.withColumn("__r", F.row_number().over(W.partitionBy("__id").orderBy("g.side", "g.n"))).filter("__r = 1").select("__id", F.col("doc_id").alias("__d"), F.col("g.a").alias("__a"), F.col("g.b").alias("__b"), F.col("__c").alias("__x"))
    best = work.written(best)
    others = ids.select(F.col("doc_id").alias("__od"), F.col("start").alias("__os"), F.col("end").alias("__oe"), F.col("__id").alias("__oi"))
    others = others.join(best.select(F.col("__d").alias("__od")).distinct(), "__od", "left_semi")
    free = best.join(others, (F.col("__d") == F.col("__od")) & (F.col("__id") != F.col("__oi")) & (F.col("__a") < F.col("__oe")) & (F.col("__os") < F.col("__b")), "left_anti")
    rows = asked.join(free, "__id", "left")
    grown = rows.withColumn("text", F.coalesce("__x", "text")).withColumn("start", F.coalesce("__a", "start")).withColumn("end", F.coalesce("__b", "end")).select(*spans.columns)
    return grown if only is None else grown.unionByName(spans.filter(~F.coalesce(only, F.lit(False))))


def all_occurrences(rows: DataFrame, key: str = "doc_id", text: str = "text", phrases: str = "phrases") -> DataFrame:
    """(key, phrase, start, end, score): every occurrence of each phrase between word boundaries, in any case; a document of whose
    phrases less than SHARE_FOUND occur gives none."""
    asked = rows.select(F.col(key), F.col(text).alias("__t"), F.explode(phrases).alias("phrase")).filter("phrase <> ''")
    pattern = F.concat(F.lit(r"(?iuU)(?<![\wÀ-ỹ])\Q"), F.replace(F.col("phrase"), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![\wÀ-ỹ])"))
    parts = T.placed(F.regexp_extract_all(F.col("__t"), F.concat(F.lit("(?sd)(.*?)(?:"), pattern, F.lit("|$)")), F.lit(0)))
    hit = F.filter(parts, lambda p: F.lower(F.substr(p["text"], F.greatest(F.length(p["text"]) - F.length("phrase") + 1, F.lit(1)))) == F.lower("phrase"))
    found = asked.withColumn("__h", hit).withColumn("__n", F.size("__h"))
    share = found.groupBy(F.col(key).alias("__d")).agg(F.avg((F.col("__n") > 0).cast("int")).alias("__share")).filter(F.col("__share") >= SHARE_FOUND)
    rows = found.join(share, F.col(key) == F.col("__d"), "left_semi").select(key, "phrase", F.explode("__h").alias("p"))
    n = F.length("phrase")
    return rows.select(key, "phrase", (F.col("p.end") - n).cast("bigint").alias("start"), F.col("p.end").alias("end"), (F.lit(1.0) + n * 0.001).alias("score"))
