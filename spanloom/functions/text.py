"""Text to pieces with code-point offsets, as column expressions: nothing here shuffles.

Offsets are half-open and count code points, so ``substring(text, start + 1, end - start)`` gives a piece back.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = " \t.,;:!?()[]{}\"'-–—•·*”“’‘"
PIECES = "array<struct<text:string,start:bigint,end:bigint>>"
#: Unicode's white space, which is ``(?U)\\s`` of the JVM; Python's own ``\\s`` holds four control characters more.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: expressions inside lambdas are otherwise evaluated at each mention, for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Pieces of a text that are folded at once; offsets of these runs come from their total lengths, so that long texts cost no squares.
_RUN = 64


def _run(parts: Column, gap: int, at: Column) -> Column:
    first = F.struct(at.cast("bigint").alias("at"), F.array().cast(PIECES).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        end = acc["at"] + F.length(part)
        return F.struct((end + gap).cast("bigint").alias("at"), F.concat(acc["out"], F.array(F.struct(part.alias("text"), acc["at"].alias("start"), end.cast("bigint").alias("end")))).alias("out"))

    return F.aggregate(parts, first, step, lambda acc: acc["out"])


def placed(parts: Column, gap: int = 0, origin: Column | int = 0) -> Column:
    """Pieces that follow one another, ``gap`` characters apart, with their offsets."""
    at = (origin if isinstance(origin, Column) else F.lit(origin)).cast("bigint")
    return let(parts, lambda p: _placed(p, gap, at))


def _placed(parts: Column, gap: int, at: Column) -> Column:
    n = F.ceil(F.size(parts) / _RUN).cast("int")
    runs = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda r: F.slice(parts, r * _RUN + 1, F.lit(_RUN)))).otherwise(F.array().cast("array<array<string>>"))
    sized = F.transform(runs, lambda r: F.struct(r.alias("parts"), F.aggregate(r, F.lit(0).cast("bigint"), lambda acc, p: acc + F.length(p) + gap).alias("chars")))
    first = F.struct(at.alias("at"), F.array().cast("array<struct<parts:array<string>,at:bigint>>").alias("out"))
    begun = F.aggregate(sized, first, lambda acc, r: F.struct((acc["at"] + r["chars"]).alias("at"), F.concat(acc["out"], F.array(F.struct(r["parts"].alias("parts"), acc["at"].alias("at")))).alias("out")), lambda acc: acc["out"])
    return F.flatten(F.transform(begun, lambda r: _run(r["parts"], gap, r["at"])))


def lines(text: Column) -> Column:
    return placed(F.split(F.coalesce(text, F.lit("")), "\n", -1), 1)


def sentences(text: Column, origin: Column | int = 0) -> Column:
    """Cut after ``. ; ! ?`` runs that white space or the end follows; the marks and the space stay with the left piece."""
    parts = F.filter(F.regexp_extract_all(text, F.lit(r"(?sdU).*?(?:[.;!?]+(?:\s+|$)|$)"), F.lit(0)), lambda x: x != "")
    return placed(parts, 0, origin)


def clauses(text: Column, origin: Column | int = 0) -> Column:
    parts = F.filter(F.regexp_extract_all(text, F.lit(r"(?sdU).*?(?:,\s+|$)"), F.lit(0)), lambda x: x != "")
    return placed(parts, 0, origin)


def words(text: Column) -> Column:
    """White-space tokens."""
    lead = F.length(text) - F.length(F.regexp_replace(text, r"(?U)^\s+", ""))
    parts = placed(F.regexp_extract_all(text, F.lit(r"(?U)\S+\s*"), F.lit(0)), 0, lead)
    return F.transform(parts, lambda p: trimmed(p))


def trimmed(piece: Column) -> Column:
    """A piece without the white space around it."""
    left = F.regexp_replace(piece["text"], r"(?U)^\s+", "")
    place = let(left, lambda x: F.struct(F.regexp_replace(x, r"(?dU)\s+$", "").alias("text"), (piece["start"] + F.length(piece["text"]) - F.length(x)).cast("bigint").alias("start")))
    return let(place, lambda x: F.struct(x["text"], x["start"], (x["start"] + F.length(x["text"])).cast("bigint").alias("end")))


def without_edges(piece: Column, chars: str = EDGES) -> Column:
    """A piece without bullets and punctuation at its ends; null if nothing is left."""
    left = F.ltrim(piece["text"], F.lit(chars))
    core = F.rtrim(left, F.lit(chars))
    start = piece["start"] + F.length(piece["text"]) - F.length(left)
    return F.when(core != "", F.struct(core.alias("text"), start.cast("bigint").alias("start"), (start + F.length(core)).cast("bigint").alias("end")))


def key_form(text: Column) -> Column:
    """Lower case, white space collapsed: the form in which names are compared."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """Characters composed with their marks. Texts of ASCII alone, which are so anyway, are empty to the Python worker."""
    other = text.rlike(r"[^\x00-\x7F]")
    return F.when(other, F.pandas_udf(_composed, "string")(F.when(other, text))).otherwise(text)


def _bare_letters() -> tuple[str, str]:
    """Every character that decomposes into one character and marks, and that character."""
    pairs = []
    for c in map(chr, range(0x80, sys.maxunicode + 1)):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and unicodedata.category(parts[0]) != "Mn" and all(unicodedata.category(x) == "Mn" for x in parts[1:]):
            pairs.append((c, parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _BARE = _bare_letters()


def without_accents(text: Column) -> Column:
    """A letter with a stroke stays."""
    bare = F.regexp_replace(F.translate(text, _MARKED, _BARE), r"\p{Mn}+", "")
    return F.when(text.rlike(r"[^\x00-\x7F]"), bare).otherwise(text)


def plain_form(text: Column) -> Column:
    """Without accents, in lower case, white space collapsed: the form in which drug names are compared. A letter with a stroke stays."""
    return key_form(without_accents(text))


def clean_reply(text: Column) -> Column:
    """Model output without thinking blocks, bold marks and heading marks."""
    out = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    out = F.regexp_replace(out, r"\*\*(.+?)\*\*", "$1")
    out = F.regexp_replace(out, r"(?m)^#{1,4}\s+", "")
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")
