"""Drug names in text: the dictionary with its spelling variants, names that need a dose to count, and unknown names before a dose."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import names as N
from spanloom.functions import text as T
from spanloom.functions import words
from spanloom.operators import rules

# Fixed values, in plain form where they are compared with names.
LEAST_CHARS = 4
STOP_NAMES = ("water", "oxygen", "air", "oral", "tablet", "capsule", "solution", "injection", "cream", "gel", "kit", "pack", "unit", "nam", "can", "chi", "ban", "cam", "tam", "chan", "bao", "chat", "sinh", "hoa")
DUAL_USE = (
    "glucose", "creatinine", "creatinin", "prothrombin", "lactate", "albumin", "urea", "ure", "bilirubin", "cholesterol", "triglyceride", "triglycerid", "protein", "hemoglobin", "ferritin", "insulin",
    "calcium", "magnesium", "potassium", "sodium", "phosphate", "chloride", "bicarbonate", "ammonia", "lactose", "fibrinogen", "transferrin", "troponin", "amylase", "lipase",
)
NOT_NAMES = (
    "uống", "tiêm", "truyền", "ngày", "lần", "viên", "ống", "gói", "lọ", "chai", "liều", "sáng", "chiều", "tối", "trưa", "giờ", "x", "và", "với", "sau", "trước", "mỗi", "cho", "của", "là", "có", "không",
    "còn", "thêm", "dùng", "truyen", "tinh", "mach", "nong", "do", "ml", "mg", "kg",
)
MARKS = ".,;:()[]"
BLOCKED = sorted({"".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn") for w in NOT_NAMES} | set(DUAL_USE) | set(STOP_NAMES))
DOSE = r"(?i)\s*\d+(?:[.,]\d+)?\s*(?:MG|G|ML|MCG|IU|UI|MEQ|MMOL)(?:\s*/\s*\d*\s*(?:MG|G|ML|MCG|IU|UI|MEQ|MMOL))*"
FORM = (
    r"(?iU)\b(?:Oral\s+(?:Tablet|Capsule|Solution|Suspension|Syrup|Powder|Drops?|Film|Pill)|Injectable|Injection|Inhalation|Topical|Cream|Ointment|Patch|Suppository|Granules?|Effervescent|Extended\s+Release|Delayed\s+Release"
    r"|Sublingual|Ophthalmic|Otic|Nasal|Rectal|Vaginal|Implant|Kit|Spray|Gel|Lotion|Foam|Concentrate|Infusion|Powder|Vial|Ampule)\b"
)


def dictionary(names: DataFrame, name: str = "name") -> DataFrame:
    """(name): distinct plain forms of LEAST_CHARS or more that aren't stop names, each also without a final e where that leaves as many."""
    plain = names.select(T.plain_form(F.col(name)).alias("n")).filter((F.length("n") >= LEAST_CHARS) & ~F.col("n").isin(*STOP_NAMES))
    short = F.when(F.col("n").endswith("e") & (F.length("n") > LEAST_CHARS), F.substr("n", F.lit(1), F.length("n") - 1))
    return plain.select(F.explode(F.array_compact(F.array("n", short))).alias("name")).distinct()


def ingredients(terms: DataFrame, term: str = "term") -> DataFrame:
    """(term): ingredient names from product names: no combinations, without doses, forms and brackets; 3 characters or more, 4 words at
    most. Names that end in -mide or -side come without the e too. One spelling (the smallest) for each name in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.col(term), DOSE, ""), FORM, "")
    bare = F.trim(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")), F.lit("/ "))
    fit = terms.filter(~F.col(term).rlike(r"[/\[]")).select(bare.alias("t")).filter((F.length("t") >= 3) & (F.size(F.split("t", " ")) <= 4))
    local = F.when(F.lower("t").rlike("(?:mide|side)$"), F.substr("t", F.lit(1), F.length("t") - 1))
    return fit.select(F.explode(F.array_compact(F.array("t", local))).alias("t")).groupBy(F.lower("t").alias("k")).agg(F.min("t").alias("term")).select("term")


def _dose(words: Column, raw: Column, last: Column) -> Column:
    """The dose that follows word ``last`` (from 1), empty without one. Three words hold a dose and what may not follow it."""
    gap = F.substr(F.element_at(raw, last), (F.length(F.element_at(words, last)["text"]) + 1).cast("int"))
    return F.regexp_extract(F.concat(gap, F.array_join(F.slice(raw, last + 1, F.lit(3)), "")), rules.STRENGTH, 0)


def find(docs: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", name: str = "name", most: int = 5) -> DataFrame:
    """(key, text, start, end, score, source): dictionary names with their doses (``dict``), and words right before a dose that look like
    names (``rule_strength``). A name that is a test too counts only before a dose; without one its words stay free.

    ``names`` are as ``dictionary`` gives them; null and empty texts have none. A dictionary that all tasks can hold is looked up in one pass over the texts, without a
    shuffle; a longer one is joined on every n-gram, for which keys must be unique.
    """
    held = N.lexicon_of(names, name, T.plain_form)
    if held is None:
        return _find_by_join(docs, names, key, text, name, most)
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for batch in batches:
            for part in words.slices(batch, "t"):
                t = N.Texts(part.column(1), N.plain_word, kept)
                rows = sorted(_in_batch(t, sent.value, most))
                if rows:
                    first, last, cut, more, score, source = (list(c) for c in zip(*rows, strict=True))
                    texts = [(t.text(i, j) + d)[c:] for i, j, c, d in zip(first, last, cut, more, strict=True)]
                    start = [t.start(i) + c for i, c in zip(first, cut, strict=True)]
                    end = [t.end(j) + len(d) for j, d in zip(last, more, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(t.owner[first])), *map(pa.array, (texts, start, end, score, source))], names=["k", "text", "start", "end", "score", "source"])

    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, text string, start bigint, end bigint, score double, source string").withColumnRenamed("k", key)


_STRENGTH = re.compile(rules.STRENGTH.removeprefix("(?iuU)"), re.I)
_BLOCKED, _DUAL = frozenset(BLOCKED), frozenset(DUAL_USE)


def _in_batch(t: N.Texts, names: N.Lexicon, most: int) -> Iterator[tuple]:
    """(first word, last word, characters cut off its front, dose, score, source) of each drug in a batch of texts."""

    def dose(last: int) -> str:
        m = _STRENGTH.match(t.behind(last))
        return m[0] if m else ""

    at, size = (x.tolist() for x in t.grams(names, most))
    doses = [dose(i + n - 1) for i, n in zip(at, size, strict=True)]
    good = [k for k in range(len(at)) if doses[k] or t.form(at[k], size[k], N.plain_word) not in _DUAL]
    used: set[int] = set()
    for k in N.longest([at[k] for k in good], [size[k] for k in good]):
        i, n = at[good[k]], size[good[k]]
        used.update(range(i, i + n))
        yield i, i + n - 1, 0, doses[good[k]], 1.0, "dict"
    w = t.w
    # a dose begins with a digit: of ASCII, or of what isn't
    head = w.data[w.start] if len(w.start) else w.start
    number = ((head >= 48) & (head <= 57)) | (head >= 128)
    for i in (np.flatnonzero(number[1:] & (t.owner[1:] == t.owner[:-1]))).tolist():
        if i in used:
            continue
        word = t.word(i)
        left = word.lstrip(MARKS)
        core = left.rstrip(MARKS)
        if len(core) >= 3 and core[0].isalpha() and N.plain_word(core) not in _BLOCKED and (d := dose(i)):
            yield i, i, len(word) - len(left), d, 0.7, "rule_strength"


def _find_by_join(docs: DataFrame, names: DataFrame, key: str, text: str, name: str, most: int) -> DataFrame:
    """As ``find``, of a dictionary of any length."""
    hits = rules._lookup(docs, names, key, text, name, most, T.plain_form).withColumnRenamed(key, "__key")
    words = T.words(F.col(text))
    raw = F.regexp_extract_all(text, F.lit(r"(?U)\S+\s*"), F.lit(0))
    rows = docs.select(F.col(key), F.col(text).alias("__t"), words.alias("__w"), raw.alias("__r")).filter(F.size("__w") > 0).join(hits, F.col(key) == F.col("__key"), "left")
    w, r = F.col("__w"), F.col("__r")
    dosed = F.transform("all", lambda x: F.struct(x["i"].alias("i"), x["n"].alias("n"), x["start"].alias("start"), x["end"].alias("end"), x["norm"].alias("norm"), _dose(w, r, x["i"] + x["n"] - 1).alias("dose")))
    rows = rows.select(key, "__t", "__w", "__r", F.coalesce(dosed, F.array().cast("array<struct<i:int,n:int,start:bigint,end:bigint,norm:string,dose:string>>")).alias("__all"))
    rows = rows.withColumn("__all", F.filter("__all", lambda x: ~(x["norm"].isin(*DUAL_USE) & (x["dose"] == ""))))
    rows = rows.withColumn("__hit", rules._greedy(F.col("__all")))
    known = F.transform("__hit", lambda x: F.struct(x["start"].alias("start"), (x["end"] + F.length(x["dose"])).cast("bigint").alias("end"), F.lit(1.0).alias("score"), F.lit("dict").alias("source")))

    def candidate(word: Column, i: Column) -> Column:
        return F.struct((i + 1).alias("i"), (word["start"] + F.length(word["text"]) - F.length(F.ltrim(word["text"], F.lit(MARKS)))).alias("start"), word["end"].alias("end"), F.rtrim(F.ltrim(word["text"], F.lit(MARKS)), F.lit(MARKS)).alias("core"), _dose(w, r, i + 1).alias("dose"))

    free = F.filter(F.transform("__w", candidate), lambda c: (c["dose"] != "") & (F.length(c["core"]) >= 3) & c["core"].rlike(r"^\p{L}") & ~F.exists("__hit", lambda x: (x["i"] <= c["i"]) & (c["i"] < x["i"] + x["n"])))
    unknown = F.transform(F.filter(free, lambda c: ~T.plain_form(c["core"]).isin(*BLOCKED)), lambda c: F.struct(c["start"].alias("start"), (c["end"] + F.length(c["dose"])).cast("bigint").alias("end"), F.lit(0.7).alias("score"), F.lit("rule_strength").alias("source")))
    found = rows.select(key, "__t", F.explode(F.concat(known, unknown)).alias("x"))
    return found.select(key, F.substr(F.col("__t"), (F.col("x.start") + 1).cast("int"), (F.col("x.end") - F.col("x.start")).cast("int")).alias("text"), F.col("x.start").cast("bigint").alias("start"), "x.end", "x.score", "x.source")
