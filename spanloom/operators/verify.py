"""What a model proposed, held against its unit: placeholders, anchoring, structure, length, repeats and density; and names against lists."""

from __future__ import annotations

import difflib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import anchor, rules, spans
from spanloom.sources import work

# Fixed values.
NUMBER = r"(?U)^[<>≤≥]?\s*\d+(?:[.,]\d+)?\s*%?$"
QUALITY = r"(?iU)^\(?\s*[-+–±]{1,3}\s*\)?$|^(?:âm tính|dương tính)$"
SHORT_UNIT, MOST_IN_SHORT = 15, 6
NOT_TESTS = r"^(?:phuong phap|quan sat|theo doi|danh gia lam sang|kham lam sang|thuc hien|tien hanh|lay mau|ghi nhan)"
DRUG_RATIO, TEST_RATIO = 0.72, 0.75
FREE_DRUGS = ("kháng sinh", "corticoid", "thuốc hạ sốt", "thuốc giảm đau", "paracetamol", "ibuprofen", "vitamin", "dịch truyền", "insulin", "metformin", "omeprazole", "aspirin", "amoxicillin")
NO_DRUGS = (
    "thuoc dac tri", "thuoc uong", "thuoc tiem", "thuoc bo", "thuoc nam", "thuoc dong y", "thuoc ha sot", "thuoc giam dau", "thuoc khang viem", "thuoc tang cuong", "thuoc boi ngoai da", "thuoc dat",
    "thuoc nho mat", "thuoc nho tai", "antibiotic", "nhu tuong codein",
)
DRUG_GROUPS = (
    "kháng sinh", "corticoid", "vitamin", "dịch truyền", "insulin", "paracetamol", "ibuprofen", "aspirin", "amoxicillin", "metformin", "omeprazole", "furosemid", "furosemide", "atorvastatin",
    "thuốc lợi tiểu", "thuốc hạ áp", "thuốc chống đông", "thuốc an thần", "thuốc chống nôn", "thuốc đái tháo đường", "thuốc giãn phế quản", "thuốc trị nấm", "thuốc chống dị ứng", "kháng histamin",
    "thuốc ức chế bơm proton", "thuốc kháng acid", "thuốc ho", "thuốc long đờm", "statin", "thuốc chống lao", "thuốc kháng virus", "thuốc sốt rét", "thuốc chống động kinh", "thuốc chống trầm cảm",
    "thuốc chống loạn thần",
)
DRUG_KINDS, TEST_KINDS = ("THUOC", "THUỐC"), ("TEN_XET_NGHIEM", "TÊN_XÉT_NGHIỆM")


def fits_type(kind: Column, text: Column) -> Column:
    """False for test names that are bare numbers and for results with neither a digit nor a qualitative value."""
    t = F.trim(text)
    number = (kind == "TÊN_XÉT_NGHIỆM") & t.rlike(NUMBER)
    vague = (kind == "KẾT_QUẢ_XÉT_NGHIỆM") & ~t.rlike(r"(?U)\d") & ~t.rlike(QUALITY)
    return ~(number | vague)


def verified_units(proposals: DataFrame, units: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(doc_id, unit, start, end, type, source, heading, zone, text) of proposals (doc_id, unit, line, kind, text) that hold in their units.

    Offsets are the document's. Of equal spans the first line stays; texts over their type's length shrink to a name in ``names`` or go; a
    short unit with too many spans keeps the longest that don't overlap. Proposals for unknown units, or with null texts, go.
    """
    asked = proposals.filter(F.col("text").isNotNull() & F.col("kind").isNotNull() & ~F.trim("text").rlike(rules.PLACEHOLDER))
    here = units.select("doc_id", "unit", F.col("text").alias("unit_text"), F.col("start").cast("bigint").alias("unit_start"), "heading", "zone")
    rows = asked.select("doc_id", "unit", "line", F.col("kind").alias("type"), F.col("text").alias("phrase")).join(here.hint("merge"), ["doc_id", "unit"])  # both grow, and bytes in files say little of texts that are made: never broadcast
    at = anchor.anchor(rows, "unit_text", "phrase").filter("start is not null")
    at = at.withColumn("text", F.substr(F.col("unit_text"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))).drop("phrase").filter(fits_type(F.col("type"), F.col("text")))
    cap = spans.word_cap(F.col("type"))
    at = at.filter(~spans.over_cap(F.col("type"), F.col("text"))) if names is None else anchor.core_in_names(at, names, cap)
    n_words = F.size(F.regexp_extract_all("unit_text", F.lit(r"(?U)\S+"), F.lit(0)))
    item = F.struct("start", "end", "type", "line", "text")
    per = at.groupBy("doc_id", "unit").agg(F.sort_array(F.collect_list(item)).alias("all"), *[F.first(c).alias(c) for c in ("unit_start", "heading", "zone")], F.first(n_words).alias("n_words"))
    place = lambda x: F.struct(x["start"], x["end"], x["type"])
    once = F.filter("all", lambda x, i: (i == 0) | (place(x) != place(F.col("all")[F.greatest(i - 1, F.lit(0))])))
    per = per.withColumn("all", once)
    long_first = F.array_sort(F.transform("all", lambda x: F.struct((x["start"] - x["end"]).alias("rank"), x["line"].alias("line"), x.alias("x"))))
    kept = F.aggregate(F.transform(long_first, lambda y: y["x"]), F.slice("all", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda a: (a["start"] < x["end"]) & (x["start"] < a["end"])), acc).otherwise(F.concat(acc, F.array(x))))
    dense = (F.col("n_words") < SHORT_UNIT) & (F.size("all") > MOST_IN_SHORT)
    out = per.select("doc_id", "unit", "unit_start", "heading", "zone", F.explode(F.when(dense, kept).otherwise(F.col("all"))).alias("x"))
    return out.select("doc_id", "unit", (F.col("x.start") + F.col("unit_start")).alias("start"), (F.col("x.end") + F.col("unit_start")).alias("end"), "x.type", F.lit("llm").alias("source"), "heading", "zone", "x.text")


def close_to_names(texts: DataFrame, names: DataFrame, ratio: float, text: str = "text", name: str = "name", band: int | None = None) -> DataFrame:
    """(text): distinct texts whose plain form is like one of ``names`` by a Ratcliff-Obershelp ratio of at least ``ratio`` (over 2/3);
    with ``band`` only names whose length differs by less count.

    Two strings of S characters together that match in M places, so with a ratio of 2M / S, do so in at most S - 2M + 1 runs, as each gap between runs takes a character. So
    they share 3M - S - 1 pairs of neighbouring characters or more, and M characters. Of each string only the rarest pairs are looked up, as many as must hold a
    shared one by that count (all but the least number shared, plus one), and only among strings of a length that can do; where no shared pair is sure, which
    takes short strings, the rarest characters are. Of the pairs of strings that are left difflib sees those that have enough characters in common.
    """
    if not ratio > 2 / 3:
        raise ValueError("pairs of characters find all matches only for ratios over 2/3")
    low, high = ratio / (2 - ratio), (2 - ratio) / ratio  # of lengths
    slack = 1e-9
    enough = lambda total: F.ceil(total * (1.5 * ratio - 1) - 1 - slack)  # noqa: E731  shared pairs
    short = int(2 / (1.5 * ratio - 1)) + 1  # from this total on, a shared pair is sure

    def plain(rows: DataFrame, column: str) -> DataFrame:
        return rows.select(T.plain_form(F.col(column)).alias("s")).filter("s <> ''").distinct().withColumn("n", F.length("s"))

    left, right = work.written(plain(texts, text)), work.written(plain(names, name))

    def tokens(rows: DataFrame) -> DataFrame:
        """(s, n, of, t, k): pairs of characters (of: 2) and, of strings that may be short of them, characters (1), each with its number in the string."""
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1))), lambda i: F.struct(F.lit(2).alias("of"), F.substr(F.col("s"), i, F.lit(2)).alias("t")))
        chars = F.transform(F.split("s", ""), lambda c: F.struct(F.lit(1).alias("of"), c.alias("t")))
        each = rows.select("s", "n", F.posexplode(F.when(F.col("n") * (1 + low) <= short, F.concat(pairs, chars)).otherwise(pairs)).alias("p", "x")).select("s", "n", "p", "x.*")
        return each.select("s", "n", "of", "t", F.row_number().over(W.partitionBy("s", "of", "t").orderBy("p")).alias("k"))

    held, asked = tokens(right), tokens(left)
    seen = held.unionByName(asked).groupBy("of", "t").agg(F.count(F.lit(1)).alias("f"))

    def rarest(rows: DataFrame) -> DataFrame:
        total = F.col("n") + F.ceil(F.col("n") * low - slack)  # with the shortest partner
        sure = F.greatest(F.lit(1), F.when(F.col("of") == 2, enough(total)).otherwise(F.ceil(ratio * total / 2 - slack)))
        place = F.row_number().over(W.partitionBy("s", "of").orderBy("f", "t", "k"))
        n_tokens = F.when(F.col("of") == 2, F.greatest(F.col("n") - 1, F.lit(1))).otherwise(F.col("n"))
        return rows.join(seen, ["of", "t"]).withColumn("r", place).filter(F.col("r") <= n_tokens - sure + 1).select("s", "n", "of", "t", "k")

    lengths = F.sequence(F.ceil(F.col("n") * low - slack), F.floor(F.col("n") * high + slack))
    if band:
        lengths = F.filter(lengths, lambda m: F.abs(m - F.col("n")) < band)
    a = rarest(asked).select(F.col("s").alias("a"), F.col("n").alias("la"), "of", "t", "k", F.explode(F.transform(lengths, lambda m: m.cast("int"))).alias("m"))
    b = rarest(held).select(F.col("s").alias("b"), F.col("n").alias("m"), "of", "t", "k")
    pairs = a.join(b, ["of", "t", "k", "m"]).filter((F.col("of") == 2) | (F.col("la") + F.col("m") <= short)).select("a", "b").distinct()

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yes = []
            for x, y in zip(rows["a"], rows["b"], strict=True):
                m = difflib.SequenceMatcher(None, x, y)
                yes.append(m.quick_ratio() >= ratio and m.ratio() >= ratio)
            yield rows.loc[yes, ["a"]]

    found = pairs.mapInPandas(check, "a string").distinct()
    return texts.select(F.col(text).alias("text")).distinct().join(found, T.plain_form(F.col("text")) == F.col("a"), "left_semi")


def nearest_names(names: DataFrame, band: int = 4, name: str = "name", bounds: tuple[int, ...] = (1, 3)) -> DataFrame:
    """(name, distance, nearest): of the other distinct names whose length differs by less than ``band`` the one at the smallest edit distance, the
    first by order of equals; names without any are left out.

    If d edits make one string of another, one of d + 1 pieces of the first stands in the second, moved by d places at most. So for each bound strings are
    joined on such pieces; a nearest name within the bound is final, and only names that have none go on to the next. Those that are further
    from all others than the last bound are compared with the whole band, as no shared piece is sure there.
    """
    every = names.select(F.col(name).alias("name")).filter("name is not null").distinct()
    other = every.select(F.col("name").alias("other"), F.length("name").alias("m"))
    best = F.min(F.struct(F.levenshtein("name", "other").cast("bigint").alias("d"), "other")).alias("b")
    left, done = every, []
    for d in bounds:
        reach = min(d, band - 1)
        piece = lambda m, i, d=d: F.floor(m * i / F.lit(d + 1)).cast("int")
        cuts = F.transform(F.sequence(F.lit(0), F.lit(d)), lambda i: F.struct(i.alias("i"), F.substr("other", piece(F.col("m"), i) + 1, piece(F.col("m"), i + 1) - piece(F.col("m"), i)).alias("s")))
        keyed = other.select("other", "m", F.explode(cuts).alias("c")).select("other", "m", "c.*")
        at = left.select("name", F.explode(F.sequence(F.greatest(F.length("name") - reach, F.lit(0)), F.length("name") + reach)).alias("m"))
        at = at.select("*", F.explode(F.sequence(F.lit(0), F.lit(d))).alias("i"))
        at = at.select("*", F.explode(F.sequence(F.lit(-d), F.lit(d))).alias("by"))
        a, n = piece(F.col("m"), F.col("i")), piece(F.col("m"), F.col("i") + 1) - piece(F.col("m"), F.col("i"))
        tried = at.filter((a + F.col("by") >= 0) & (a + F.col("by") + n <= F.length("name"))).select("name", "m", "i", F.substr("name", a + F.col("by") + 1, n).alias("s")).distinct()
        near = tried.join(keyed, ["m", "i", "s"]).filter("name <> other").select("name", "other").distinct().groupBy("name").agg(best).filter(F.col("b.d") <= d)
        done.append(near)
        left = left.join(near.select("name"), "name", "left_anti")
    far = left.join(other, (F.length("name") - F.col("m")).between(1 - band, band - 1) & (F.col("name") != F.col("other"))).groupBy("name").agg(best)
    return reduce(DataFrame.unionByName, [*done, far]).select("name", F.col("b.d").alias("distance"), F.col("b.other").alias("nearest"))


def in_lists(entities: DataFrame, drugs: DataFrame, tests: DataFrame) -> DataFrame:
    """Entities (type, text) without drugs and test names that no name of their list (name) resembles; other types stay, drugs that name
    a common group stay too."""
    plain = T.plain_form(F.col("text"))
    drug, test = F.col("type").isin(*DRUG_KINDS), F.col("type").isin(*TEST_KINDS)
    groups = plain.isin(*_plain(FREE_DRUGS))
    asked_drugs, asked_tests = entities.filter(drug & ~groups), entities.filter(test)
    good_drugs = asked_drugs.join(close_to_names(asked_drugs, drugs, DRUG_RATIO), "text", "left_semi")
    good_tests = asked_tests.join(close_to_names(asked_tests, tests, TEST_RATIO), "text", "left_semi")
    rest = entities.filter(F.col("type").isNull() | ~(drug | test) | (drug & groups))
    return rest.unionByName(good_drugs.select(*entities.columns)).unionByName(good_tests.select(*entities.columns))


def is_test_name(text: Column) -> Column:
    """3 characters or more, 8 words at most, and no description of an act."""
    t = F.trim(text)
    return (F.length(t) >= 3) & (F.size(F.split(t, r"(?U)\s+")) <= 8) & ~T.plain_form(t).rlike(NOT_TESTS)


def _plain(words: tuple[str, ...]) -> list[str]:
    import unicodedata

    return ["".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn") for w in words]


def scenarios(replies: DataFrame, key: str = "doc_id", reply: str = "reply", least: int = 3, most: int = 5) -> DataFrame:
    """(key, symptoms, drugs): the first ``most`` TC and TH lines (``code|text``, 2 characters or more) of replies with ``least`` TC lines."""
    lines = F.transform(F.filter(F.split(reply, "\n"), lambda x: F.contains(x, F.lit("|"))), lambda x: F.struct(F.upper(F.trim(F.substring_index(x, "|", 1))).alias("code"), F.regexp_replace(F.regexp_replace(x, r"^[^|]*\|", ""), r"(?U)^\s+|\s+$", "").alias("text")))
    of = lambda code: F.transform(F.filter("__l", lambda x: (x["code"] == code) & (F.length(x["text"]) >= 2)), lambda x: x["text"])
    rows = replies.select(key, lines.alias("__l")).select(key, of("TC").alias("symptoms"), F.slice(of("TH"), 1, most).alias("drugs"))
    return rows.filter(F.size("symptoms") >= least).withColumn("symptoms", F.slice("symptoms", 1, most))


def good_drugs(rows: DataFrame, names: DataFrame, key: str = "doc_id", drugs: str = "drugs") -> DataFrame:
    """rows with lists of drugs without vague groups and descriptions: known groups stay, names in ``names``, short ones (3 words) that
    resemble one, and those of 2 words; a list of which nothing is left keeps its first two entries. Keys must be unique."""
    each = rows.select(F.col(key).alias("__k"), F.posexplode(drugs).alias("__i", "__d")).withColumn("__t", F.regexp_replace("__d", r"(?U)^\s+|\s+$", ""))
    plain, n = T.plain_form(F.col("__t")), F.size(F.split("__t", r"(?U)\s+"))
    each = each.withColumn("__p", plain).withColumn("__n", n).filter((F.length("__t") >= 2) & (F.col("__n") <= 5) & ~F.col("__p").isin(*NO_DRUGS))
    sure = F.col("__p").isin(*_plain(DRUG_GROUPS)) | (F.col("__n") <= 2)
    known = names.select(T.plain_form(F.col("name")).alias("__x")).distinct()
    asked = each.filter(~sure)
    exact = asked.join(known, F.col("__p") == F.col("__x"), "left_semi")
    close = close_to_names(asked.filter("__n <= 3").select(F.col("__t").alias("text")), names, DRUG_RATIO, band=4)
    near = asked.filter("__n <= 3").join(known, F.col("__p") == F.col("__x"), "left_anti").join(close, F.col("__t") == F.col("text"), "left_semi")
    kept = each.filter(sure).unionByName(exact).unionByName(near).groupBy("__k").agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__t"))), lambda x: x["__t"]).alias("__kept"))
    return rows.join(kept, F.col(key) == F.col("__k"), "left").withColumn(drugs, F.coalesce("__kept", F.slice(drugs, 1, 2))).select(*rows.columns)
