"""Deterministic generators and samplers: every choice is a hash of a seed and the row's key."""

from __future__ import annotations

import re
from collections.abc import Callable
from hashlib import md5
from heapq import nsmallest

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators import choice


def draw(seed: int, *keys) -> Column:
    """A number in [0, 1) of a row: its ticket's share of all."""
    return choice.ticket(seed, *keys) / float(1 << 60)


def pick(options: Column, u: Column) -> Column:
    return F.element_at(options, (F.floor(u * F.size(options)) + 1).cast("int"))


def per_stratum(rows: DataFrame, stratum: str, quota: int, seed: int, *keys: str) -> DataFrame:
    """``quota`` rows of each stratum, all where it has fewer."""
    order = W.partitionBy(stratum).orderBy(draw(seed, *keys), *keys)
    return rows.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= quota).drop("__r")


def proportional(rows: DataFrame, stratum: str, n: int, seed: int, key: str) -> DataFrame:
    """n rows without repeats: each stratum its share, one at least; then any others up to n."""
    return choice.weighted_sample(rows, stratum, key, n, seed, F.col("m"))


def number(u: Column, v: Column, low: float, high: float) -> Column:
    """A number as text: whole or with one or two decimals, 40 % of those with a comma."""
    x = low + u * (high - low)
    text = F.when(v < 0.34, F.round(x).cast("bigint").cast("string")).when(v < 0.67, F.format_string("%.1f", x)).otherwise(F.format_string("%.2f", x))
    return F.when(F.pmod(F.xxhash64(text), F.lit(10)) < 4, F.replace(text, F.lit("."), F.lit(","))).otherwise(text)


# Qualitative results, trends, notes of thresholds and results in words.
QUALITIES = (
    "âm tính", "dương tính", "(+)", "(-)", "(++)", "(--)", "(±)", "bình thường", "bất thường", "tăng cao", "giảm thấp", "trong giới hạn bình thường", "không thấy bất thường", "có biểu hiện bất thường",
)
TRENDS = (
    "tăng", "giảm", "tăng nhẹ", "giảm nhẹ", "bình thường", "trong giới hạn bình thường", "không thấy bất thường", "men gan tăng", "↑", "↓", "tăng cao", "giảm thấp", "ổn định", "cải thiện", "chưa cải thiện",
)
THRESHOLDS = (("< ", ""), ("> ", ""), ("≤ ", ""), ("≥ ", ""), ("< ", " (bình thường)"), ("> ", " (tăng cao)"))
IN_WORDS = (
    "không có tổn thương đặc hiệu", "hình ảnh bình thường", "phù nề nhẹ", "không phát hiện bất thường", "có biểu hiện viêm", "kết quả trong giới hạn bình thường", "giảm so với lần trước", "tăng so với lần trước",
)
FORMATS = ("number", "comma", "pressure", "quality", "trend", "threshold", "words", "pairs")
TENTH = 10


def value(seed: int, *keys) -> Column:
    """A number from 1 to 200 as text, in a third of cases each whole, with one and with two decimals, behind a comma in 40 % of cases; a fraction isn't zero."""
    base = choice.die(200, seed, F.lit("base"), *keys) + 1
    digits = choice.die(3, seed, F.lit("digits"), *keys)
    mark = F.when(choice.die(10, seed, F.lit("mark"), *keys) < 4, ",").otherwise(".")
    one, two = choice.die(9, seed, F.lit("frac"), *keys) + 1, choice.die(99, seed, F.lit("frac"), *keys) + 1
    some = F.when(digits == 1, one.cast("string")).otherwise(F.format_string("%02d", two))
    return F.when(digits == 0, base.cast("string")).otherwise(F.concat(base.cast("string"), mark, some))


def lab_results(rows: DataFrame, units: list[str], seed: int, key: str, names: tuple[str, ...] = ("WBC", "NEUT%", "ALT", "AST", "CRP")) -> DataFrame:
    """rows with ``format`` and ``result``: of n rows exactly n // 10 (one at least) have each of the eight FORMATS, the others a number, a quality or a trend.

    Rows are numbered by key, and a permutation of the numbers deals the formats, so nothing is sorted in one place; the rest is decided by tickets of the key.
    """
    n = rows.count()
    at = choice.numbered(rows, key, name="__no")
    place = choice.permuted(F.col("__no"), max(n, 1), seed)
    each = max(1, n // TENTH)
    t = lambda what, m, *k: choice.die(m, seed, F.lit(what), key, *k)
    one = lambda options, what, *k: choice.one_of(list(options), seed, F.lit(what), key, *k)
    number = lambda what, *k: F.concat(value(seed, F.lit(what), key, *k), F.lit(" "), one(units, what + "unit", *k))
    comma = F.concat((t("whole", 99) + 1).cast("string"), F.lit(","), F.format_string("%02d", t("part", 99) + 1), F.lit(" "), one(units, "cunit"))
    pressure = F.concat((t("high", 61) + 100).cast("string"), F.lit("/"), (t("low", 41) + 60).cast("string"), F.lit(" mmHg"))
    limit = F.element_at(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in THRESHOLDS]), (t("limit", len(THRESHOLDS)) + 1).cast("int"))
    threshold = F.concat(limit["a"], value(seed, F.lit("threshold"), key), limit["b"])
    first = lambda i: F.substring_index(one(names, "name", i), " ", 1)
    pairs = F.array_join(F.transform(F.sequence(F.lit(1), (t("pairs", 3) + 2).cast("int")), lambda i: F.concat(first(i), F.lit(": "), number("pair", i))), "  ")
    other = F.element_at(F.array(F.lit("number"), F.lit("quality"), F.lit("trend")), (t("other", 3) + 1).cast("int"))
    turn = F.call_function("div", F.col("__p"), F.lit(each).cast("bigint"))
    form = F.when(turn < len(FORMATS), F.element_at(F.array(*map(F.lit, FORMATS)), (F.least(turn, F.lit(len(FORMATS) - 1)) + 1).cast("int"))).otherwise(other)
    made = {"number": number("number"), "comma": comma, "pressure": pressure, "quality": one(QUALITIES, "quality"), "trend": one(TRENDS, "trend"), "threshold": threshold, "words": one(IN_WORDS, "words"), "pairs": pairs}
    out = F.lit(None).cast("string")
    for kind, text in made.items():
        out = F.when(F.col("format") == kind, text).otherwise(out)
    return at.withColumn("__p", place).withColumn("format", form).withColumn("result", out).select(*rows.columns, "format", "result")


def block(items: Column, heading: Column, bullet: str = "- ") -> Column:
    """struct<text, spans array<struct<start, end>>> of a heading and a bullet line per item; offsets by construction."""
    head = F.concat(heading, F.lit("\n"))
    first = F.struct(head.alias("text"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, item: Column) -> Column:
        start = (F.length(acc["text"]) + len(bullet)).cast("bigint")
        return F.struct(F.concat(acc["text"], F.lit(bullet), item, F.lit("\n")).alias("text"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), (start + F.length(item)).cast("bigint").alias("end")))).alias("spans"))

    return F.aggregate(items, first, step)


LETTERS = r"[A-Za-zÀ-ỹ]"
NEAR, LEAST_MASKED, MASK = 5, 5, "***"


_WORDS = re.compile(f"{LETTERS}{{{LEAST_MASKED},}}")


def _drawn(n: int, k: int, lot: str) -> list[int]:
    """k of the numbers 1 .. n (all where there are fewer): those with the smallest tickets ``lot``:number."""
    if k <= 0 or not n:
        return []
    begun = md5(f"{lot}:".encode())
    tickets = []
    for i in range(1, n + 1):
        h = begun.copy()
        h.update(b"%d" % i)
        tickets.append((h.hexdigest()[:15], i))
    return [i for _, i in nsmallest(k, tickets)]


def _edited(texts: pd.Series, cuts: pd.Series, numbers: pd.Series, keys: pd.Series, seed: int, what: str, places: Callable[[str], list[tuple[int, int]]], put: str) -> pd.Series:
    """Texts of which as many places behind their cut as numbers says are replaced."""
    out = []
    for text, cut, n, key in zip(texts, cuts, numbers, keys, strict=True):
        if text is None or pd.isna(cut):
            out.append(None)
            continue
        at = places(text[int(cut) :]) if not pd.isna(n) and n > 0 else []
        parts, done = [], 0
        for a, b in sorted(at[i - 1] for i in _drawn(len(at), int(n), f"{seed}:{what}:{key}")) if at else ():
            parts += [text[done : int(cut) + a], put]
            done = int(cut) + b
        out.append("".join([*parts, text[done:]]))
    return pd.Series(out, dtype=object)


def _between_letters(text: str) -> list[tuple[int, int]]:
    return [(m.start(), m.end()) for m in _SINGLE.finditer(text) if text[m.start() - 1].isalpha() and text[m.end()].isalpha()]


#: A space that stands between characters of words; whether these are letters is looked at after.
_SINGLE = re.compile(r"(?<=\w) (?=\w)")


def glued(text: Column, last_end: Column, n: Column, seed: int, key: Column) -> Column:
    """The text without n of its single spaces between letters that stand more than NEAR characters behind the last span."""

    def run(texts: pd.Series, cuts: pd.Series, numbers: pd.Series, keys: pd.Series) -> pd.Series:
        return _edited(texts, cuts, numbers, keys, seed, "glue", _between_letters, "")

    return F.pandas_udf(run, "string")(text, (last_end + NEAR).cast("int"), n.cast("int"), F.coalesce(key.cast("string"), F.lit("")))


def masked(text: Column, last_end: Column, n: Column, seed: int, key: Column) -> Column:
    """The text with n of its words of LEAST_MASKED letters or more behind the last span masked."""

    def run(texts: pd.Series, cuts: pd.Series, numbers: pd.Series, keys: pd.Series) -> pd.Series:
        return _edited(texts, cuts, numbers, keys, seed, "mask", lambda t: [m.span() for m in _WORDS.finditer(t)], MASK)

    return F.pandas_udf(run, "string")(text, last_end.cast("int"), n.cast("int"), F.coalesce(key.cast("string"), F.lit("")))


def with_noise(text: Column, last_end: Column, seed: int, key: Column, n_glue: Column | None = None, n_mask: Column | None = None) -> Column:
    """Spaces glued, then words masked, all behind the last span (``last_end``, 0 without spans), so no offset moves. One to three spaces (no more than can be) and
    none to two words, where the numbers aren't given."""
    n_glue = choice.die(3, seed, F.lit("n_glue"), key) + 1 if n_glue is None else n_glue
    n_mask = choice.die(3, seed, F.lit("n_mask"), key) if n_mask is None else n_mask
    return masked(glued(text, last_end, n_glue, seed, key), last_end, n_mask, seed, key)


def joined(first: Column, second: Column, spans: Column) -> Column:
    """struct<text, spans>: a text without spans of its own before another, with a blank line between, and the spans (start, end) of the second. Where both have
    spans see ``merging.merged``."""
    shift = F.length(first) + 2
    return F.struct(F.concat(first, F.lit("\n\n"), second).alias("text"), F.transform(spans, lambda s: F.struct((s["start"] + shift).cast("bigint").alias("start"), (s["end"] + shift).cast("bigint").alias("end"))).alias("spans"))


# What stands before a test's name and between it and its result, and what a name alone may have behind it.
LINE_LAYOUTS = (("", ": "), ("", " : "), ("", " = "), ("", " "), ("- ", ": "), ("• ", ": "))
LINE_TRENDS = ("tăng", "giảm", "↑", "↓")
SOLO, TREND = 0.42, 0.2


def lab_lines(rows: DataFrame, seed: int, key: str, solo: float = SOLO, trend: float = TREND) -> DataFrame:
    """rows (name, result) with ``line``, ``name_start``, ``value`` and ``value_start``: name and result in one of six layouts; exactly floor(solo * n) of the n lines have no
    result but the name alone, of which a share ``trend`` has a trend as its value, the others none (null)."""
    n = rows.count()
    at = choice.numbered(rows, key, name="__no")
    alone = choice.permuted(F.col("__no"), max(n, 1), seed) < int(n * solo)
    layout = F.element_at(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in LINE_LAYOUTS]), (choice.die(len(LINE_LAYOUTS), seed, F.lit("layout"), key) + 1).cast("int"))
    moves = choice.die(1000, seed, F.lit("trend"), key) < round(1000 * trend)
    rows_ = at.withColumn("__a", alone).withColumn("__l", layout)
    value = F.when(~F.col("__a"), F.col("result")).when(moves, choice.one_of(list(LINE_TRENDS), seed, F.lit("which"), key))
    lead, gap = F.when(F.col("__a"), "").otherwise(F.col("__l.a")), F.when(F.col("__a"), " ").otherwise(F.col("__l.b"))
    begin = F.length(lead) + F.length("name") + F.length(gap)
    made = rows_.withColumn("value", value).withColumn("line", F.concat(lead, "name", F.when(F.col("value").isNull(), "").otherwise(F.concat(gap, "value"))))
    return made.select(*rows.columns, "line", F.length(lead).cast("bigint").alias("name_start"), "value", F.when(F.col("value").isNotNull(), begin).cast("bigint").alias("value_start"))
