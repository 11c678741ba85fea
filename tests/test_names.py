"""Drug names, verification of proposals, lists, and tables of terms on small cases."""

import difflib
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import drugs, generate, knowledge, labels, rules, verify
from spanloom.plans import extract


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


def names(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "name string")


def bare(text):
    return " ".join("".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").lower().split())


def test_plain_form(spark):
    texts = ["Đau  BỤNG dữ\tdội ", "naïve café é", "", "Ωμέγα Ёлка", "ǖ ṩ ắ"]
    got = docs(spark, *texts).select("doc_id", T.plain_form(F.col("text")).alias("p")).orderBy("doc_id").collect()
    assert [r["p"] for r in got] == [bare(t) for t in texts]


DRUGS = {
    "Medrol 16mg x 3 viên, uống 8h sáng sau ăn no": {("Medrol 16mg", "dict")},
    "Furosemid 40 mg x 1 viên, uống sáng": {("Furosemid 40 mg", "dict")},
    "Glucose 5% x 1000ml truyền tĩnh mạch": {("Glucose 5%", "dict")},
    "Glucose máu: 13,2 mmol/l": set(),
    "Rocephin 1g tiêm tĩnh mạch": {("Rocephin 1g", "rule_strength")},
    "Protein: 52 g/l": set(),
    "uống 40 mg và (Omezol 20 mg)": {("Omezol 20 mg", "rule_strength")},
    "Zestril": {("Zestril", "dict")},
    "": set(),
}


def test_drugs(spark):
    rows = docs(spark, *DRUGS, None)
    known = drugs.dictionary(names(spark, "Medrol", "Furosemide", "Zestril", "Glucose", "Medrol", "air", "abc", None))
    assert {r["name"] for r in known.collect()} == {"medrol", "furosemide", "furosemid", "zestril", "glucose", "glucos"}
    got = drugs.find(rows, known).collect()
    for i, (text, want) in enumerate(DRUGS.items()):
        assert {(r["text"], r["source"]) for r in got if r["doc_id"] == i} == want
        assert all(text[r["start"] : r["end"]] == r["text"] for r in got if r["doc_id"] == i)
    assert not [r for r in got if r["doc_id"] == len(DRUGS)]


def test_ingredients(spark):
    terms = spark.createDataFrame([("Amlodipine 5 MG / HCTZ 12.5 MG Oral Tablet [X]",), ("Furosemide 40 MG Oral Tablet",), ("furosemide 20 MG/ML Injection",), ("Aspirin",), ("ab",), (None,)], "term string")
    assert {r["term"].lower() for r in drugs.ingredients(terms).collect()} == {"furosemide", "furosemid", "aspirin"} - set()


def test_verified_units(spark):
    units = spark.createDataFrame([(1, 0, "bệnh nhân đau bụng dữ dội, ALT 45 U/l", 10, "h", "z"), (1, 1, "tụ máu ngoài màng cứng bán cầu trái lượng lớn chèn ép", 99, None, "z"), (2, 0, "a b c d e f g h", 0, None, "z")], "doc_id bigint, unit bigint, text string, start bigint, heading string, zone string")
    said = [
        (1, 0, 0, "TRIỆU_CHỨNG", "đau bụng"), (1, 0, 1, "TRIỆU_CHỨNG", "ĐAU BỤNG"), (1, 0, 2, "TÊN_XÉT_NGHIỆM", "45"), (1, 0, 3, "KẾT_QUẢ_XÉT_NGHIỆM", "45 U/l"), (1, 0, 4, "KẾT_QUẢ_XÉT_NGHIỆM", "ALT"),
        (1, 0, 5, "THUỐC", "không có"), (1, 0, 6, "THUỐC", "aspirin"), (1, 0, 7, None, "đau"), (1, 0, 8, "THUỐC", None), (1, 1, 0, "CHẨN_ĐOÁN", "tụ máu ngoài màng cứng bán cầu trái lượng lớn chèn ép"), (9, 0, 0, "THUỐC", "đau"),
        *[(2, 0, i, "TRIỆU_CHỨNG", c) for i, c in enumerate(["a b", "b", "c", "d", "e", "f", "g"])],
    ]
    asked = spark.createDataFrame(said, "doc_id bigint, unit bigint, line bigint, kind string, text string")
    got = {(r["doc_id"], r["start"], r["end"], r["type"], r["text"]) for r in verify.verified_units(asked, units, names(spark, "Tụ máu ngoài màng cứng")).collect()}
    assert {g for g in got if g[0] == 1} == {(1, 20, 28, "TRIỆU_CHỨNG", "đau bụng"), (1, 41, 47, "KẾT_QUẢ_XÉT_NGHIỆM", "45 U/l"), (1, 99, 121, "CHẨN_ĐOÁN", "tụ máu ngoài màng cứng")}
    assert {g[4] for g in got if g[0] == 2} == {"a b", "c", "d", "e", "f", "g"}
    assert 1 == len([g for g in verify.verified_units(asked, units).collect() if g["unit"] == 1 or g["text"] == "45 U/l"])


def test_close_to_names(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcde") for _ in range(draw.randint(1, 16)))
    listed = [word() for _ in range(60)] + ["axbxcxd"]
    asked = [word() for _ in range(150)] + [w[:-1] + "é" for w in listed[:20]] + ["ABCD", "", None]
    for ratio, band in ((0.72, None), (0.75, None), (0.72, 4)):
        want = {t for t in asked if t and any((band is None or abs(len(bare(t)) - len(n)) < band) and difflib.SequenceMatcher(None, bare(t), n).ratio() >= ratio for n in listed)}
        rows = spark.createDataFrame([(t,) for t in asked], "text string")
        assert {r["text"] for r in verify.close_to_names(rows, names(spark, *listed, None, ""), ratio, band=band).collect()} == want


def test_in_lists(spark):
    rows = spark.createDataFrame([("THUỐC", "Paracetamol"), ("THUOC", "furosemid"), ("THUỐC", "xyz"), ("TÊN_XÉT_NGHIỆM", "công thức mau"), ("TÊN_XÉT_NGHIỆM", "qqq"), ("CHẨN_ĐOÁN", "qqq"), (None, "w")], "type string, text string")
    got = verify.in_lists(rows, names(spark, "furosemide"), names(spark, "Công thức máu"))
    assert {r["text"] for r in got.collect()} == {"Paracetamol", "furosemid", "công thức mau", "qqq", "w"} and got.count() == 5
    flags = docs(spark, "nội soi", "Theo dõi thêm", "ab", "một hai ba bốn năm sáu bảy tám chín").orderBy("doc_id").select(verify.is_test_name(F.col("text")).alias("x")).collect()
    assert [r["x"] for r in flags] == [True, False, False, False]


def test_scenarios(spark):
    rows = spark.createDataFrame([(1, "tc| sốt\nTC|ho | khan\nTH|aspirin\nTC|đau\nTX|x\nTC|y"), (2, "TC|sốt\nTC|ho"), (3, None), (4, "")], "doc_id bigint, reply string")
    got = verify.scenarios(rows).collect()
    assert [(r["doc_id"], r["symptoms"], r["drugs"]) for r in got] == [(1, ["sốt", "ho | khan", "đau"], ["aspirin"])]


def test_terms(spark):
    terms = spark.createDataFrame([("A00", "tả"), ("A01.1", "thương hàn")], "code string, term string")
    other = spark.createDataFrame([("A00.0", "cholera"), ("A01.1", "paratyphoid"), ("B99", "none"), (None, "null")], "code string, term string")
    assert {tuple(r) for r in knowledge.attach_aliases(other, terms).collect()} == {("A00", "cholera"), ("A01.1", "paratyphoid")}
    cells = spark.createDataFrame([(1, i, c) for i, c in enumerate(["01", "DƯ-X", "", "ACTH", "81.500", "75000", "note", "ADH", "", "90.100"])], "table int, pos int, text string")
    assert {r["name"] for r in knowledge.names_before_prices(cells).collect()} == {"ACTH", "ADH"}
    texts = docs(spark, "ho và sốt cao", "ho")
    marked = spark.createDataFrame([(0, 0, 2)], "doc_id bigint, start bigint, end bigint")
    assert {(r["doc_id"], r["text"]) for r in knowledge.unlabelled_names(texts, marked, names(spark, "ho", "sốt cao")).collect()} == {(0, "sốt cao"), (1, "ho")}


def test_label_tools(spark):
    rows = spark.createDataFrame([(["B-SYMPTOM_AND_DISEASE", "I-SYMPTOM_AND_DISEASE", "O", "B-AGE"],)], "labels array<string>")
    assert rows.select(labels.renamed(F.col("labels"), {"SYMPTOM_AND_DISEASE": "SYM_DIS"}).alias("x")).first()["x"] == ["B-SYM_DIS", "I-SYM_DIS", "O", "O"]
    kind = "tokens array<string>, spans array<struct<first:int,last:int,type:string>>"
    for last, want in ((1, True), (2, False)):
        assert labels.ends_inclusive(spark.createDataFrame([(["a", "b"], [(0, last, "x")])], kind)).first()["inclusive"] is want
    assert labels.ends_inclusive(spark.createDataFrame([], kind)).first()["inclusive"] is True
    rows = spark.createDataFrame([("Hội  chứng thận", ["Hội_chứng", "thận"]), ("học", ["họ", "c"]), ("a b", ["a", "x"]), ("", []), (None, None)], "text string, words array<string>")
    got = [r["a"] for r in rows.select(labels.aligned_words(F.col("text"), F.col("words")).alias("a")).collect()]
    assert [[(w["start"], w["end"]) for w in g["words"]] for g in got] == [[(0, 10), (11, 15)], [(0, 3), (3, 4)], [(0, 1)], [], []]
    assert [g["whole"] for g in got] == [True, True, False, True, True]


def test_good_drugs(spark):
    rows = [(1, ["thuốc bổ", "Kháng sinh", "furosemit liều cao", "một hai ba bốn", "Furosemid uong", "thuốc x y z t u"]), (2, ["thuốc bổ", "thuốc nam", "x"]), (3, []), (4, None), (5, ["amoxicillin va clavulanat", "hoan toan khac nhe"])]
    frame = spark.createDataFrame(rows, "doc_id bigint, drugs array<string>")
    got = {r["doc_id"]: r["drugs"] for r in verify.good_drugs(frame, names(spark, "Furosemit lieu", "amoxicillin và clavulanate")).collect()}
    assert got == {1: ["Kháng sinh", "Furosemid uong"], 2: ["thuốc bổ", "thuốc nam"], 3: [], 4: None, 5: ["amoxicillin va clavulanat"]}


SPAN = "doc_id bigint, start bigint, end bigint, type string, source string, heading string, score bigint, text string"


def test_finalize(spark):
    text = "- ALT: 45 U/l. sỏi đoạn cuối ống mật chủ rõ"
    rows = docs(spark, text, "a b")
    found = spark.createDataFrame([(0, 0, 14, "TÊN_XÉT_NGHIỆM", "rule", None, 100, text[:14]), (0, 15, 18, "CHẨN_ĐOÁN", "llm", None, 70, "sỏi"), (1, 1, 2, "THUỐC", "llm", None, 70, " ")], SPAN)
    got = extract.finalize(found, rows, names(spark, "sỏi đoạn cuối ống mật chủ")).collect()
    assert {r["text"] for r in got} == {"ALT: 45 U/l", "sỏi đoạn cuối ống mật chủ"}
    for broken in ([(1, 0, 1, "THUỐC", "llm", None, 70, "x")], [(1, 0, 3, "THUỐC", "llm", None, 70, "a b"), (1, 2, 3, "THUỐC", "llm", None, 70, "b")]):
        with pytest.raises(Exception, match="verbatim|overlap"):
            extract.checked(spark.createDataFrame(broken, SPAN), rows).collect()
    rule = found.filter("doc_id = 0").withColumn("end", F.lit(20).cast("bigint"))
    assert [r["score"] for r in extract.pooled([rule, found.filter("false")]).collect()] == [100]


def test_generators(spark):
    rows = spark.range(400).select("id", F.lit("ALT").alias("name"), F.lit("45 U/l").alias("result"))
    lines = generate.lab_lines(rows, 3, "id").collect()
    for r in lines:
        assert r["line"][r["name_start"] : r["name_start"] + 3] == "ALT"
        assert r["value"] is None and r["line"] == "ALT" or r["line"][r["value_start"] :] == r["value"]
    assert sum(r["value"] != "45 U/l" for r in lines) == 168 and 0 < sum(r["value"] in generate.LINE_TRENDS for r in lines) < 80
    assert generate.lab_lines(rows.filter("false"), 3, "id").count() == 0


def test_lookup_of_forms_by_word(spark):
    """N-grams have the form of their whole text: marks alone, accents, other white space, null and empty texts."""
    rows = [(1, "dùng Amoxicillin \tClav  500 mg"), (2, "Äspirin ́́ fôrte, x"), (3, None), (4, ""), (5, "amoxicillin")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    names = spark.createDataFrame([("Amoxicillin  clav",), ("aspirin fôrte,",), ("amoxicillin",)], "name string")
    hits = rules._lookup(docs, names, "doc_id", "text", "name", 5, T.plain_form).selectExpr("doc_id", "inline(all)").collect()
    got = sorted((r["doc_id"], r["i"], r["n"], r["start"], r["end"], r["text"], r["norm"]) for r in hits)
    texts = dict(rows)
    assert [(d, i, n, norm) for d, i, n, _, _, _, norm in got] == [(1, 2, 1, "amoxicillin"), (1, 2, 2, "amoxicillin clav"), (2, 1, 3, "aspirin forte,"), (5, 1, 1, "amoxicillin")]
    assert all(texts[d][a:b] == t for d, _, _, a, b, t, _ in got)


def test_best_runs_against_all_windows():
    import re

    from spanloom.operators import anchor

    def plain(text, phrase):
        best, place = anchor.NEAREST, None
        words, n = list(re.finditer(r"\S+", text)), len(phrase.split())
        wanted = " ".join(phrase.lower().split())
        for i in range(len(words) - n + 1) if n else ():
            a, b = words[i].start(), words[i + n - 1].end()
            ratio = difflib.SequenceMatcher(None, wanted, text[a:b].lower()).ratio()
            if ratio > best or (ratio == best and place is None):
                best, place = ratio, (a, b)
        return place

    r = random.Random(9)
    found = 0
    for _ in range(1500):
        words = ["".join(r.choices("abcΣςİé", k=r.randint(1, 7))) for _ in range(r.randint(0, 14))]
        text = "".join(w + r.choice([" ", "  ", "\n"]) for w in words)
        i = r.randint(0, max(0, len(words) - 1))
        phrase = " ".join(words[i : i + r.randint(1, 4)])
        phrase = "".join(c if r.random() > 0.08 else r.choice("abcé") for c in phrase)
        want = plain(text, phrase)
        found += want is not None
        assert anchor.best_run(text, phrase) == want
    assert found > 300
    assert anchor.best_run("", "a") is anchor.best_run("a b", "") is anchor.best_run("a", "a b") is None
    long = "word " * 50_000 + "needle in haystack " + "word " * 1000
    assert long[slice(*anchor.best_run(long, "needl in haystack"))] == "needle in haystack"


def test_close_names_over_the_tables(spark):
    import duckdb

    from spanloom.plans import catalog

    got = sorted(r["text"] for r in catalog.QUERIES["close_names"](spark, "/root/testdata/sf0.001").collect())
    rows = duckdb.sql("SELECT p_name, p_size FROM '/root/testdata/sf0.001/part.parquet'").fetchall()
    listed = [bare(n) for n, size in rows if size % 5]
    asked = {n[1:101] + "x" for n, _ in rows}
    want = [t for t in asked if any(difflib.SequenceMatcher(None, bare(t), n).ratio() >= 0.72 for n in listed)]
    assert got == sorted(want) and 0 < len(want)
