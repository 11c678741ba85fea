"""Rules and dictionaries over text: laboratory pairs, names by longest n-gram, strengths, model replies, anchoring."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import names as N
from spanloom.functions import text as T
from spanloom.functions import words

# Fixed values.
UNITS = "mmol/l|mmol/L|micromol/l|µmol/l|umol/l|mol/l|g/l|g/L|mg/dl|mg/dL|mg/l|g/dl|mg%|T/l|G/l|U/l|UI/l|IU/l|U/L|ng/ml|pg/ml|µg/l|mcg/l|µg/ml|mcg/ml|mmHg|cmH2O|ml/phút|ml/min|l/ngày|tế bào/mm3|/mm3|/µl|%|kg|cm|mm|ml|dl"
NAME_CHARS = 40
STRENGTH = r"(?iuU)^\s*\d+(?:[.,]\d+)?\s*(?:(?:mg|g|mcg|µg|ml|l|ui|iu)\b(?!\s*/)|%)"
CODES = {"TC": "TRIỆU_CHỨNG", "CD": "CHẨN_ĐOÁN", "TH": "THUỐC", "TX": "TÊN_XÉT_NGHIỆM", "KQ": "KẾT_QUẢ_XÉT_NGHIỆM"}
REPLY_LINE = r"(?iu)^\s*(?:\d+[.):]\s*)?([A-Za-zÀ-ỹ]{2})\s*[|:]\s*(.+?)\s*$"
PLACEHOLDER = r"(?iu)^(?:không ghi rõ|không rõ|chưa rõ|n/?a|không có|không|có)\.?$"


_CUT = re.compile(rf"(?<!\d),(?!\d)|[;:\n]|(?<=[a-zA-ZÀ-ỹ])\.(?=[{T.WHITE}]|\Z)")
#: A comma behind a number that a line's or text's end follows ends no piece, but isn't part of one either.
_LAST_COMMA = re.compile(r",(?=(?:\r\n|[\n\r\x85\u2028\u2029])?\Z)")
_SPACES = r"[ \t\n\x0b\f\r]*"
_VALUE = re.compile(rf"[<>≤≥]?{_SPACES}[0-9]+(?:[.,][0-9]+)?{_SPACES}(?:{UNITS})\.?\Z|\({_SPACES}[-+–±]{{1,3}}{_SPACES}\)\Z|(?:âm tính|dương tính)\Z", re.I)


def lab_segments(text: str) -> Iterator[tuple[str, int]]:
    """(text, start) of the pieces between line feeds, colons, semicolons, commas outside numbers and full stops after letters, trimmed."""
    at = 0
    for m in (*_CUT.finditer(text), None):
        piece = text[at : m.start() if m else len(text)]
        if "," in piece and (m is None or m[0] == "\n"):
            piece = _LAST_COMMA.sub("", piece)
        left = piece.lstrip(T.WHITE)
        if left:
            yield left.rstrip(T.WHITE), at + len(piece) - len(left)
        at = m.end() if m else at


def _named_values(text: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, start) of results, each behind its name."""
    before: tuple[str, int] | None = None
    for piece, start in lab_segments(text):
        if not _VALUE.match(piece):
            before = piece, start
            continue
        if before is not None:
            left = before[0].lstrip(":=–-•·*").lstrip(T.WHITE)
            core = left.rstrip(":=–").rstrip(T.WHITE)
            if len(core) <= NAME_CHARS and any(map(str.isalpha, core)):
                yield "TÊN_XÉT_NGHIỆM", core, before[1] + len(before[0]) - len(left)
        yield "KẾT_QUẢ_XÉT_NGHIỆM", piece.rstrip("."), start
        before = None  # a result is no name


def lab_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, kind, text, start, end): results, and the names right before them; each name once. One pass over each text, batch by batch, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, *x) for i, t in enumerate(batch.column(1).to_pylist()) if t for x in _named_values(t)]
            if found:
                owner, kind, said, start = zip(*found, strict=True)
                begin = pa.array(start, pa.int64())
                end = pc.add(begin, pa.array(list(map(len, said)), pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(kind, pa.string()), pa.array(said, pa.string()), begin, end], names=["k", "kind", "text", "start", "end"])

    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, kind string, text string, start bigint, end bigint").withColumnRenamed("k", key)


def _lookup(docs: DataFrame, names: DataFrame, key: str, text: str, name: str, most: int, form: Callable[[Column], Column]) -> DataFrame:
    """(key, all): each document's n-grams that are names, longest first, then from the left. Each n-gram is looked up by an equi-join."""
    rows = docs.select(F.col(key), T.words(F.col(text)).alias("__w"), F.regexp_extract_all(text, F.lit(r"(?U)\S+\s*"), F.lit(0)).alias("__r"))
    rows = rows.withColumn("__f", F.transform("__w", lambda w: form(w["text"])))  # once a word: an n-gram's form is that of its words, which marks alone leave empty

    def gram(i: Column, n: Column) -> Column:  # holds its own text, so that no row carries the document along
        last = F.element_at("__w", i + n - 1)
        raw = F.concat(F.array_join(F.slice("__r", i, n - 1), ""), last["text"])
        norm = F.array_join(F.filter(F.slice("__f", i, n), lambda f: f != ""), " ")
        return F.struct((-n).alias("rank"), i.alias("i"), n.alias("n"), F.element_at("__w", i)["start"].alias("start"), last["end"].alias("end"), raw.alias("text"), norm.alias("norm"))

    none = F.array().cast("array<struct<rank:int,i:int,n:int,start:bigint,end:bigint,text:string,norm:string>>")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.when(F.size("__w") >= n, F.transform(F.sequence(F.lit(1), F.size("__w") - n + 1), lambda i: gram(i, n))).otherwise(none)))
    grams = rows.select(key, F.explode(spans).alias("g")).select(key, "g.*")
    known = names.select(form(F.col(name)).alias("__k")).distinct()
    hits = grams.join(known, F.col("norm") == F.col("__k"), "left_semi")
    return hits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", "i", "n", "start", "end", "text", "norm"))).alias("all"))


def _greedy(hits: Column) -> Column:
    """The hits in order, without those that use a word of one before."""
    return F.aggregate(hits, F.slice(hits, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda a: (a["i"] < x["i"] + x["n"]) & (x["i"] < a["i"] + a["n"])), acc).otherwise(F.concat(acc, F.array(x))))


def names_longest(docs: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", name: str = "name", most: int = 5) -> DataFrame:
    """(key, text, start, end, n): dictionary names found by n-gram, longest first, then from the left; no word is used twice.

    A dictionary that all tasks can hold is looked up in one pass over the texts, without a shuffle; a longer one is joined on every n-gram.
    """
    held = N.lexicon_of(names, name, T.key_form)
    if held is None:
        per = _lookup(docs, names, key, text, name, most, T.key_form)
        return per.select(key, F.explode(_greedy(F.col("all"))).alias("x")).select(key, "x.text", "x.start", "x.end", F.col("x.n").cast("bigint").alias("n"))
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict = {}
        for batch in batches:
            for part in words.slices(batch, "t"):
                t = N.Texts(part.column(1), N.key_word, kept)
                at, size = (x.tolist() for x in t.grams(sent.value, most))
                got = [(at[k], size[k]) for k in N.longest(at, size)]  # words are numbered over the batch, so texts don't meet
                if got:
                    first, last = [i for i, _ in got], [i + n - 1 for i, n in got]
                    found = [[t.text(i, j) for i, j in zip(first, last, strict=True)], [t.start(i) for i in first], [t.end(j) for j in last], [n for _, n in got]]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(t.owner[first])), *[pa.array(c) for c in found]], names=["k", "text", "start", "end", "n"])

    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    return src.mapInArrow(run, f"k {src.schema['k'].dataType.simpleString()}, text string, start bigint, end bigint, n bigint").withColumnRenamed("k", key)


def with_strength(found: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Extends spans over a dose that follows them."""
    rows = found.join(docs.select(F.col(key), F.col(text).alias("__t")), key)
    more = F.regexp_extract(F.substr(F.col("__t"), (F.col("end") + 1).cast("int")), STRENGTH, 0)
    end = F.col("end") + F.length(more)
    return rows.select(key, F.substr(F.col("__t"), (F.col("start") + 1).cast("int"), (end - F.col("start")).cast("int")).alias("text"), "start", end.cast("bigint").alias("end"), (F.length(more) > 0).alias("has_strength"))


def parse_replies(replies: DataFrame, key: str = "doc_id", reply: str = "reply") -> DataFrame:
    """(key, line, kind, text) of the lines of a model's reply that read ``code|text`` with a known code."""
    kinds = F.create_map(*[F.lit(x) for kv in CODES.items() for x in kv])
    rows = replies.select(F.col(key), F.posexplode(F.split(F.col(reply), "\n")).alias("line", "l"))
    rows = rows.filter(~F.col("l").rlike(r"(?iu)^\s*KH[ÔO]NG\s*\.?\s*$"))
    kind = F.try_element_at(kinds, F.upper(F.regexp_extract("l", REPLY_LINE, 1)))
    return rows.select(key, F.col("line").cast("bigint").alias("line"), kind.alias("kind"), F.regexp_extract("l", REPLY_LINE, 2).alias("text")).filter("kind is not null")


def occurrences(docs: DataFrame, phrases: DataFrame, key: str = "doc_id", text: str = "text", phrase_id: str = "item_id", phrase: str = "phrase", lead: int = 4) -> DataFrame:
    """(key, phrase_id, start, end): where phrases stand in texts, word by word; phrases without a word stand nowhere.

    Only places where a phrase's first ``lead`` words (all words of a shorter one) stand are compared. A list of phrases within MOST_PHRASES and
    MOST_CHARS goes to all tasks, which look these words up in one pass over their texts; a longer one is joined on them.
    """
    named = phrases.select(F.col(phrase_id).alias("id"), F.col(phrase).alias("p")).filter("id is not null and p is not null")
    size = named.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("p")).alias("chars")).first()
    types = dict(named.dtypes)
    if size["n"] <= words.MOST_PHRASES and (size["chars"] or 0) <= words.MOST_CHARS and types["id"] in ("bigint", "int", "string"):
        found = words.phrase_rows(docs, [tuple(r) for r in named.collect()], types["id"], key, text, lead)
        return found.select(F.col("k").alias(key), F.col("p").alias(phrase_id), "start", "end")
    rows = docs.select(F.col(key), F.col(text).alias("__t"), T.words(F.col(text)).alias("__w"))
    parts = F.filter(F.split(F.col(phrase), r"(?U)\s+"), lambda w: w != "")
    asked = phrases.select(F.col(phrase_id), F.col(phrase).alias("__p"), parts.alias("__q")).filter(F.size("__q") > 0).withColumn("n", F.least(F.size("__q"), F.lit(lead)))
    sizes = sorted(r["n"] for r in asked.select("n").distinct().collect())  # lead of them at most
    asked = asked.select(phrase_id, "__p", F.xxhash64(F.array_join(F.slice("__q", F.lit(1), F.col("n")), " ")).alias("h"))

    def gram(i: Column, n: int) -> Column:
        return F.struct(F.try_element_at("__w", i)["start"].alias("start"), F.xxhash64(F.array_join(F.transform(F.slice("__w", i, n), lambda w: w["text"]), " ")).alias("h"))

    def starts(n: int) -> Column:
        at = F.transform(F.sequence(F.lit(1), F.greatest(F.size("__w") - n + 1, F.lit(1))), lambda i: gram(i, n))
        return F.when(F.size("__w") >= n, at).otherwise(F.slice(at, 1, 0))

    grams = rows.select(key, F.explode(F.concat(*[starts(n) for n in sizes or [lead]])).alias("g")).select(key, "g.*")
    near = grams.join(asked, "h").join(rows.select(F.col(key), "__t"), key)
    hit = near.filter(F.substr(F.col("__t"), (F.col("start") + 1).cast("int"), F.length("__p")) == F.col("__p"))
    hit = hit.filter(~F.substr(F.col("__t"), (F.col("start") + 1 + F.length("__p")).cast("int"), F.lit(1)).rlike(r"(?U)\S"))
    return hit.select(key, phrase_id, "start", (F.col("start") + F.length("__p")).cast("bigint").alias("end"))
