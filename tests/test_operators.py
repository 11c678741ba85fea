"""Operators on small cases with known results."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import anchor, gates, generate, labels, rules, segment, spans
from spanloom.plans import extract
from spanloom.sources import tables


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


LABS = {
    "Ure: 6,4 mmol/l": {"Ure", "6,4 mmol/l"},
    "Cl-: 106 mmol/l": {"Cl-", "106 mmol/l"},
    "• CRP: 12 mg/l": {"CRP", "12 mg/l"},
    "Bệnh nhân nam 17 tuổi": set(),
    "uống ít nước < 1l/ngày": set(),
    "HBsAg: dương tính; Protein: (++)": {"HBsAg", "dương tính", "Protein", "(++)"},
    "": set(),
}


def test_lab_pairs(spark):
    rows = docs(spark, *LABS)
    got = rules.lab_pairs(rows).join(rows.withColumnRenamed("text", "t"), "doc_id").collect()
    for r in got:
        assert r["t"][r["start"] : r["end"]] == r["text"]
    for i, (_, want) in enumerate(LABS.items()):
        assert {r["text"] for r in got if r["doc_id"] == i} == want


def test_dictionary_and_strength(spark):
    rows = docs(spark, "Furosemide 40 mg x 1 viên, uống sáng", "Truyền Glucose 5% x 1000ml", "Protein 52 g/l", "dùng vitamin b complex hai lần", "")
    names = spark.createDataFrame([("furosemide",), ("glucose",), ("Vitamin B",), ("vitamin b complex",), ("complex",), ("protein",)], "name string")
    got = rules.with_strength(rules.names_longest(rows, names), rows).collect()
    assert {(r["doc_id"], r["text"], r["has_strength"]) for r in got} == {(0, "Furosemide 40 mg", True), (1, "Glucose 5%", True), (2, "Protein", False), (3, "vitamin b complex", False)}


def test_segment(spark):
    text = "Triệu chứng hiện tại\n- đau bụng\n- sốt cao\nBệnh nhân đau đầu. Không sốt. Đã dùng paracetamol.\n2.  Tiền sử bệnh hiện tại\n* ho"
    got = segment.segment(docs(spark, text, "", None)).orderBy("doc_id", "unit").collect()
    assert [(r["text"], r["is_bullet"], r["zone"]) for r in got] == [
        ("đau bụng", True, "advice"), ("sốt cao", True, "advice"), ("Bệnh nhân đau đầu.", False, "advice"), ("Không sốt.", False, "advice"), ("Đã dùng paracetamol.", False, "advice"), ("ho", True, "clinical"),
    ]
    assert {r["heading"] for r in got[:5]} == {"Triệu chứng hiện tại"} and got[5]["heading"] == "Tiền sử bệnh hiện tại"
    assert all(text[r["start"] : r["end"]] == r["text"] for r in got)


def test_offsets_of_long_texts(spark):
    text = "  " + " ".join(f"từ{i}" for i in range(500)) + " \n"
    got = docs(spark, text).select(F.explode(T.words(F.col("text"))).alias("w")).select("w.*").collect()
    assert len(got) == 500 and all(text[r["start"] : r["end"]] == r["text"] for r in got)


def span_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, start bigint, end bigint, type string, source string, heading string, score bigint")


def test_best_disjoint_against_subsets(spark):
    r, rows = random.Random(3), []
    for d in range(40):
        for _ in range(r.randint(1, 9)):
            s = r.randint(0, 30)
            rows.append((d, s, s + r.randint(1, 12), "A", "llm", None, r.randint(1, 9)))
    got = {x["doc_id"]: x["t"] for x in spans.best_disjoint(span_rows(spark, rows), "start").groupBy("doc_id").agg(F.sum("score").alias("t")).collect()}
    for d in range(40):
        mine = [x for x in rows if x[0] == d]
        best = 0
        for k in range(1 << len(mine)):
            some = sorted(x for i, x in enumerate(mine) if k >> i & 1)
            if all(a[2] <= b[1] for a, b in itertools.pairwise(some)):
                best = max(best, sum(x[6] for x in some))
        assert got[d] == best


def test_merge_priors_and_consensus(spark):
    h = "Các bệnh lý mạn tính"
    rows = [(1, 0, 5, "CHẨN_ĐOÁN", "encoder+kb", h, 0), (1, 0, 5, "TRIỆU_CHỨNG", "llm", h, 0), (2, 0, 5, "THUỐC", "encoder+kb", None, 0), (2, 0, 5, "THUỐC", "llm", None, 0), (3, 0, 9, "THUỐC", "llm", None, 0), (3, 8, 12, "THUỐC", "rule", None, 0)]
    got = {(x["doc_id"], x["type"], x["source"], x["score"]) for x in spans.merge(span_rows(spark, rows), "start", "type", "source").collect()}
    assert got == {(1, "CHẨN_ĐOÁN", "encoder+kb", 75), (2, "THUỐC", "llm", 90), (3, "THUỐC", "rule", 100)}


ANCHORS = [
    ("đau bụng", "bị đau bụng nhiều", "đau bụng"),
    ("Đau   bụng", "bị đau \n bụng nhiều", "đau \n bụng"),
    ("- sốt cao.", "có sốt cao hôm qua", "sốt cao"),
    ("đau bụng dữ dội", "thấy đau bụng dử dội từ sáng", "đau bụng dử dội"),
    ("không liên quan", "thấy đau bụng", None),
    ("", "thấy đau bụng", None),
]


def test_anchor_ladder(spark):
    rows = spark.createDataFrame([(p, t, w) for p, t, w in ANCHORS], "phrase string, text string, want string")
    for r in anchor.anchor(rows).collect():
        assert (r["text"][r["start"] : r["end"]] if r["start"] is not None else None) == r["want"]


def test_all_occurrences(spark):
    rows = spark.createDataFrame([(1, "sot cao. Sau 2 ngay sot cao them. Kham thay Sot cao ro.", ["sot cao"]), (2, "abc", ["x1", "x2", "abc", "x4", "x5"]), (3, "sot caox sot cao", ["sot cao"])], "doc_id bigint, text string, phrases array<string>")
    got = anchor.all_occurrences(rows).orderBy("doc_id", "start").collect()
    assert [(r["doc_id"], r["start"]) for r in got] == [(1, 0), (1, 20), (1, 44), (3, 9)]


def test_core_and_extension(spark):
    names = spark.createDataFrame([("tụ máu ngoài màng cứng",), ("sỏi đoạn cuối ống mật chủ",)], "name string")
    long = "nghĩ nhiều đến tụ máu ngoài màng cứng phải cấp tính sau tai nạn giao thông"
    rows = spark.createDataFrame([(1, 10, 10 + len(long), long), (2, 0, 3, "abc"), (3, 0, 40, "một hai ba bốn năm sáu bảy tám chín mười")], "doc_id bigint, start bigint, end bigint, text string")
    got = {r["doc_id"]: r for r in anchor.core_in_names(rows, names, 8).collect()}
    assert got[1]["text"] == "tụ máu ngoài màng cứng" and got[1]["start"] == 10 + long.index("tụ") and 3 not in got and got[2]["text"] == "abc"
    text = "Có sỏi đoạn cuối ống mật chủ rõ."
    found = spark.createDataFrame([(1, 3, 6, "sỏi")], "doc_id bigint, start bigint, end bigint, text string")
    assert anchor.extended_by_names(found, spark.createDataFrame([(1, text)], "doc_id bigint, text string"), names).first()["text"] == "sỏi đoạn cuối ống mật chủ"


def test_reply_parse(spark):
    rows = spark.createDataFrame([(1, "1. tc : sốt cao\n2) KQ|92 g/l\nrác\nKHÔNG\nzz|x\n")], "doc_id bigint, reply string")
    assert [(r["kind"], r["text"]) for r in rules.parse_replies(rows).orderBy("line").collect()] == [("TRIỆU_CHỨNG", "sốt cao"), ("KẾT_QUẢ_XÉT_NGHIỆM", "92 g/l")]


def test_bio(spark):
    rows = spark.createDataFrame([(s, i, x) for s, seq in enumerate(["B-A B-A", "I-A I-A", "B-A I-B O I-B", "O"]) for i, x in enumerate(seq.split())], "seq int, pos int, label string")
    spans_ = lambda **k: {tuple(r) for r in labels.bio_spans(rows, **k).collect()}
    assert spans_() == {(0, "A", 0, 0), (0, "A", 1, 1), (1, "A", 0, 1), (2, "A", 0, 1), (2, "B", 3, 3)}
    assert spans_(join_other_type=False) == {(0, "A", 0, 0), (0, "A", 1, 1), (1, "A", 0, 1), (2, "A", 0, 0), (2, "B", 1, 1), (2, "B", 3, 3)}
    one = spark.range(1).select(labels.span_labels(F.lit(5), F.expr("array(named_struct('first',1,'last',2,'type','X'), named_struct('first',4,'last',9,'type','Y'))")).alias("l"))
    assert one.first()["l"] == ["O", "B-X", "I-X", "O", "O"]
    best = spark.range(1).select(labels.central_window(F.lit(230)).alias("w")).first()["w"]
    starts = [0, 100, 200]
    want = [max((s for s in starts if s <= i < s + 120), key=lambda s: (min(i - s, min(120, 230 - s) - 1 - (i - s)), -s)) for i in range(230)]
    assert best == want
    sub = spark.createDataFrame([(0, 0, None, 9), (0, 1, 0, 3), (0, 2, 0, 3), (0, 3, 1, 4)], "seq int, pos int, word int, label int")
    assert [r["aligned"] for r in labels.subword_labels(sub, "seq", "pos", "word", "label").orderBy("pos").collect()] == [-100, 3, -100, 4]


def test_scores(spark):
    make = lambda rows: spark.createDataFrame(rows, "seq int, first int, last int, type string")
    got = {r["label"]: r for r in labels.scores(make([(0, 0, 1, "A"), (0, 3, 3, "B")]), make([(0, 0, 1, "A"), (0, 3, 3, "C")]), ["seq", "first", "last"]).collect()}
    assert (got["micro"]["tp"], got["micro"]["fp"], got["micro"]["fn"]) == (1, 1, 1) and got["C"]["f1"] == 0.0 and got["A"]["f1"] == 1.0
    words = lambda rows: spark.createDataFrame(rows, "seq int, first int, type string, n_words int")
    cost = labels.word_cost(words([(0, 0, "A", 2), (0, 5, "B", 3)]), words([(0, 0, "B", 2), (0, 9, "B", 4)]), ["seq", "first"]).first()
    assert (cost["cost"], cost["n_ref"]) == (4 + 3 + 4, 5)


def gate_doc(n_words=400, n_spans=40, **change):
    words = [f"từ{i:03d}" for i in range(n_words)]
    text, spans_ = " ".join(words), []
    for i in range(0, n_words, n_words // n_spans):
        spans_.append({"text": words[i], "type": change.get("type", "THUỐC"), "start": i * 6, "end": i * 6 + 5})
    return {"text": text, "entities": spans_}


def test_gates(spark):
    good, wrong, lapped, few, odd, short = gate_doc(), gate_doc(), gate_doc(), gate_doc(n_spans=4), gate_doc(type="KHÁC"), gate_doc(100, 10)
    wrong["entities"][0]["text"] = "khác"
    lapped["entities"].append({"text": lapped["text"][2:7], "type": "THUỐC", "start": 2, "end": 7})
    schema = "text string, entities array<struct<text:string,type:string,start:bigint,end:bigint>>"
    rows = spark.createDataFrame([(d["text"], [tuple(e[k] for k in ("text", "type", "start", "end")) for e in d["entities"]]) for d in (good, wrong, few, lapped, odd, short)], schema)
    assert [r["reason"] for r in gates.first_failure(rows).collect()] == [None, "C1", "C2", "C3", "C5", "C7"]
    one = rows.limit(1)
    assert gates.first_failure(one, negatives=["TỪ000"]).first()["reason"] == "C6"
    assert gates.first_failure(one, baits=["thiếu"]).first()["reason"] == "C8"
    assert gates.first_failure(one, target={"THUỐC": 0.5}).first()["reason"] == "C9"
    assert sum(r["n"] for r in gates.rejected(gates.first_failure(rows)).collect()) == 6


def test_generators(spark):
    rows = spark.range(300).select("id", (F.col("id") % 3).cast("string").alias("k"))
    a = generate.per_stratum(rows, "k", 10, 1, "id")
    assert a.count() == 30 and sorted(a.collect()) == sorted(generate.per_stratum(rows, "k", 10, 1, "id").collect())
    assert generate.proportional(rows, "k", 60, 1, "id").count() == 60
    made = spark.range(1).select(generate.block(F.array(F.lit("sốt"), F.lit("ho")), F.lit("Triệu chứng")).alias("b")).first()["b"]
    assert [made["text"][s["start"] : s["end"]] for s in made["spans"]] == ["sốt", "ho"]
    both = spark.range(1).select(generate.joined(F.lit("abc"), F.lit("sốt"), F.expr("array(named_struct('start', 0L, 'end', 3L))")).alias("b")).first()["b"]
    assert both["text"][both["spans"][0]["start"] : both["spans"][0]["end"]] == "sốt"
    text = "thuốc " + "từ " * 200
    noisy = spark.range(1).select(generate.with_noise(F.lit(text), F.lit(5), 7, F.lit(1)).alias("t")).first()["t"]
    assert noisy[:10] == text[:10] and 1 <= len(text) - len(noisy) <= 3
    assert generate.lab_results(spark.range(50), ["g/l", "%"], 3, "id").filter("result is null").count() == 0


def test_extract_plan(spark):
    rows = docs(spark, "Ure: 6,4 mmol/l\nUống Furosemide 40 mg sáng", "không có gì")
    names = spark.createDataFrame([("furosemide",)], "name string")
    prop = spark.createDataFrame([(0, 0, 3, "TÊN_XÉT_NGHIỆM", "llm", None, 0, "Ure"), (1, 0, 8, "THUỐC", "llm", None, 0, "không có")], "doc_id bigint, start bigint, end bigint, type string, source string, heading string, score bigint, text string")
    got = extract.verified(extract.extract(rows, names, prop), rows).collect()
    assert all(r["verbatim"] for r in got) and {r["text"] for r in got} == {"Ure", "6,4 mmol/l", "Furosemide 40 mg"}
    assert tables.entities(extract.extract(rows, names)).count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "t").mkdir()
    for n in (10, 2, 1):
        (tmp_path / "t" / f"{n}.txt").write_text(f"văn bản {n}")
    assert [r["name"] for r in tables.read_texts(spark, str(tmp_path / "t")).collect()] == ["1", "2", "10"]
    (tmp_path / "a.conll").write_text("Tôi O\nđau B-SYM\n\nX\nho\tB-SYM\n")
    got = tables.read_conll(spark, str(tmp_path / "a.conll")).orderBy("sentence").collect()
    assert [(r["tokens"], r["labels"]) for r in got] == [(["Tôi", "đau"], ["O", "B-SYM"]), (["ho"], ["B-SYM"])]
    (tmp_path / "k.csv").write_text("code,term\n1,Sốt  cao\n2,sốt cao\n3,Ho\n")
    assert {r["name"] for r in tables.read_names(spark, str(tmp_path / "k.csv"), least=2).collect()} == {"sốt cao", "ho"}
    with pytest.raises(ValueError):
        tables.read_names(spark, str(tmp_path / "k.csv"), least=5)
    (tmp_path / "s.csv").write_text("form,usan\nparacetamol,acetaminophen\n")
    assert tables.read_synonyms(spark, str(tmp_path / "s.csv")).count() == 2 and tables.read_all_columns(spark, str(tmp_path / "s.csv")).count() == 2
    (tmp_path / "j.json").write_text('[{"sentence": "tôi bị ho", "seq_label": [[2, 2, "SYM"]]}]')
    r = tables.read_span_json(spark, str(tmp_path / "j.json")).first()
    assert r["tokens"] == ["tôi", "bị", "ho"] and tuple(r["spans"][0]) == (2, 2, "SYM")


def test_streaming(spark, tmp_path):
    from spanloom.streaming import units

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Thuốc đang dùng\n- panadol\n- vitamin")
    for name, n in (("b", 4), (None, 4)):
        if name:
            (tmp_path / "in" / "b.txt").write_text("Khác\n- ho\n- sốt")
        units.write_units(units.stream_units(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == n


def brute_nearest(asked, rows):
    import numpy as np

    unit = lambda v: np.array(v, float) / max(np.linalg.norm(np.array(v, float)), 1e-300)
    good = [(i, unit(v), c) for i, v, c in rows if v is not None and len(v) == 3 and None not in v]
    out = {}
    for i, v, _ in asked:
        top = [None, None]
        if v is not None and len(v) == 3 and None not in v:
            for j, w, c in good:
                if i != j:
                    k, x = int(c != 0), float(unit(v) @ w)
                    top[k] = x if top[k] is None else max(top[k], x)
        out[i] = tuple(top)
    return out


@pytest.mark.parametrize("tile_bytes,centres,few", [(24 * 3, 4, 0), (24 * 5, 7, 0), (1 << 20, 256, 64), (24 * 9, 1, 1 << 20), (48, 1, 0)])
def test_nearest_by_tiles(spark, tile_bytes, centres, few):
    from spanloom.operators import nearest

    r = random.Random(centres)
    rows = [(i, [r.gauss(0, 1) + 6 * (i % 4 == k) for k in range(3)], [0, 1, 2, None][i % 4 if i % 3 else 1]) for i in range(70)]
    rows += [(100, [0.0, 0.0, 0.0], 1), (101, None, 0), (102, [1.0, 2.0], 0), (103, [1.0, None, 2.0], 1), (104, [1.0, 1.0, 1.0], 0), (106, [1.0, 1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>, label int").repartition(3)
    asked = [x for x in rows if x[0] % 2 == 0]
    got = {x[0]: tuple(x[1:]) for x in nearest.nearest_by_class(df.filter("id % 2 = 0"), df, "id", "v", F.col("label") == 0, tile_bytes, centres, few).collect()}
    want = brute_nearest(asked, rows)
    assert set(got) == set(want)
    for i, pair in want.items():
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-12) for a, b in zip(got[i], pair, strict=True)), i
    for q, every in ((df.filter("false"), df), (df, df.filter("false"))):
        assert all(x[1] is None for x in nearest.nearest_by_class(q, every, "id", "v", F.col("label") == 0, tile_bytes, centres).collect())


def test_nearest_names(spark):
    from spanloom.operators import verify

    r = random.Random(3)
    names = {"".join(r.choices("abc", k=r.randint(0, 9))) for _ in range(80)} | {"q" * 30, "q" * 26, "zebra crossing", "xebra crossing", "alone" * 9}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            row, last = [i + 1], row
            for j, y in enumerate(b):
                row.append(min(row[j] + 1, last[j + 1] + 1, last[j] + (x != y)))
        return row[-1]

    want = {a: min((distance(a, b), b) for b in names if b != a and abs(len(a) - len(b)) < 4) for a in names if any(b != a and abs(len(a) - len(b)) < 4 for b in names)}
    got = verify.nearest_names(spark.createDataFrame([(x,) for x in names], "name string")).collect()
    assert {x["name"]: (x["distance"], x["nearest"]) for x in got} == want and len(got) == len(want)


def test_trimmed_spans_keep_repeated_rows(spark):
    from spanloom.operators import anchor

    names = spark.createDataFrame([("sốt cao",)], "name string")
    rows = [(1, "bị sốt cao rồi", 0, 14)] * 3 + [(2, "ho", 0, 2)] * 2 + [(3, "không có gì cả", 0, 14)]
    got = sorted(map(tuple, anchor.core_in_names(spark.createDataFrame(rows, "doc_id bigint, text string, start bigint, end bigint"), names, 2).collect()))
    assert got == [(1, "sốt cao", 3, 10)] * 3 + [(2, "ho", 0, 2)] * 2


def test_longer_phrase_lists_are_joined(spark, monkeypatch):
    from spanloom.functions import words
    from spanloom.operators import rules

    docs = spark.createDataFrame([(1, "a b c d e a b"), (2, "é  a b c"), (3, None), (4, "xa b")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(10, "a b"), (11, "a b c d e"), (12, ""), (13, None), (14, "é  a")], "item_id bigint, phrase string")
    both = []
    for most in (words.MOST_PHRASES, 0):
        monkeypatch.setattr(words, "MOST_PHRASES", most)
        both.append(sorted(map(tuple, rules.occurrences(docs, asked).distinct().collect())))
    assert both[0] == both[1] == [(1, 10, 0, 3), (1, 10, 10, 13), (1, 11, 0, 9), (2, 10, 3, 6), (2, 14, 0, 4)]
