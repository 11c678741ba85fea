"""What must hold at sizes and values that the given tables don't have: plans, orders of large keys, and vectorised passes over odd texts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import anchor, compose, generate, merging, nearest, rules, segment, verify
from spanloom.plans import catalog, generated, library
from spanloom.sources import tables, work

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_units_are_never_broadcast(spark):
    assert "BroadcastHashJoin" not in plan(generated.dense_units(spark, SF))
    units = spark.createDataFrame([(1, 0, "a b c", 7, None, "clinical")], "doc_id int, unit int, text string, start int, heading string, zone string")
    said = spark.createDataFrame([(1, 0, 0, "THUỐC", "b c"), (2, 0, 0, "THUỐC", "b c")], "doc_id int, unit int, line int, kind string, text string")
    got = verify.verified_units(said, units)
    assert "BroadcastHashJoin" not in plan(got)
    assert [tuple(r) for r in got.select("start", "end", "text").collect()] == [(9, 12, "b c")]


def test_entities_by_number_of_their_keys(spark):
    rows = spark.createDataFrame([(1, 7, 9, "THUỐC", k, 1) for k in (1000000, 999999, 5)], "doc_id int, start bigint, end bigint, type string, k1 int, k2 int")
    got = tables.entities(rows.withColumn("text", F.format_string("%06d %06d", "k1", "k2")), "k1", "k2").first()["entities"]
    assert [e["text"] for e in got] == ["000005 000001", "999999 000001", "1000000 000001"]


def test_accents_go_and_white_space_stays(spark):
    row = spark.createDataFrame([("Épi  Đường ÂM  Tính",)], "t string").select(F.lower(T.without_accents(F.col("t"))), T.plain_form(F.col("t"))).first()
    assert tuple(row) == ("epi  đuong am  tinh", "epi đuong am tinh")
    assert "x" in catalog.QUERIES["name_forms"](spark, SF).columns


def test_lab_pairs_of_odd_texts_in_one_pass(spark):
    texts = ["- ALT: 5,\n", "ALT;12 mg/l.x CRP: (+)", "Na, 1,5 mmol/l\nK: âm tính", " : 3 %", "½: 3 g/l", "a.ế: 7\x1c%", None, "", "HBsAg : DƯƠNG TÍNH\r"]
    got = rules.lab_pairs(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    assert "Exchange" not in plan(got) and "MapInArrow" in plan(got)
    rows = sorted(tuple(r) for r in got.collect())
    assert [(k, said, start) for k, _, said, start, _ in rows if k in (1, 2, 8)] == [(1, "(+)", 19), (1, "12 mg/l.x CRP", 4), (2, "1,5 mmol/l", 4), (2, "âm tính", 18), (2, "K", 15), (2, "Na", 0), (8, "DƯƠNG TÍNH", 8), (8, "HBsAg", 0)]
    for k, _, said, start, end in rows:
        assert texts[k][start:end] == said


def test_units_of_odd_texts_in_one_pass(spark):
    texts = ["1. Đau đầu:\n- ho ;\xa0\nsốt. Ho!\x1c x; y\n2.  Tiền sử\n• a\r\nabc", None, "", "٣. Ho 3. X\nab"]
    got = segment.segment(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    assert "Exchange" not in plan(got) and "MapInArrow" in plan(got)
    rows = sorted(tuple(r) for r in got.select("doc_id", "unit", "text", "start", "heading", "zone", "is_bullet").collect())
    assert rows == [
        (0, 0, "ho ;", 14, "Đau đầu", "advice", True), (0, 1, "sốt.", 20, "Đau đầu", "advice", False), (0, 2, "Ho!\x1c x;", 25, "Đau đầu", "advice", False),
        (0, 3, "abc", 52, "Tiền sử", "clinical", False), (3, 0, "ab", 11, "٣. Ho 3. X", "advice", False),
    ]


def test_noise_between_letters_beyond_the_first_plane(spark):
    rows = spark.createDataFrame([(1, "xxxxxx 𝒜 b 1 c ² d")], "id int, text string")
    got = rows.select(generate.with_noise(F.col("text"), F.lit(0), 5, F.col("id"), F.lit(9), F.lit(0)))
    assert "ArrowEvalPython" in plan(got) and got.first()[0] == "xxxxxx𝒜b 1 c ² d"


def test_small_files_of_much_work_are_spread(spark):
    n = spark.conf.get("spark.sql.shuffle.partitions")
    rows = spark.range(40).selectExpr("id", "'b' AS diagnosis", "array('ho') AS symptoms", "array('x') AS drugs")
    made = compose.article_inputs(rows.coalesce(1), ["ALT"], ["a"], ["x"], ["không {tc}"], ["gia"], ["sử"], ["{d} là gì", "vì sao"], 6)
    blocks = compose.blocks(spark.range(3).selectExpr("id", "array(named_struct('text', 'a', 'type', 'T')) AS items").coalesce(1), ["H"], ["K"], ["không"], 11)
    for df in (made, blocks, catalog.QUERIES["gate_histogram"](spark, SF), catalog.QUERIES["anchor_ladder"](spark, SF)):
        assert f", {n}), REPARTITION_BY_NUM" in plan(df)
    assert made.filter("size(titles) = 2").count() == 40
    assert all(r["text"][s["start"] : s["end"]] == "a" for r in blocks.collect() for s in r["spans"])


def test_mixed_texts_meet_by_a_number_of_tasks(spark):
    n = spark.conf.get("spark.sql.shuffle.partitions")
    assert plan(generated.mixed_texts(spark, SF)).count(f", {n}), REPARTITION_BY_NUM") >= 2


def test_written_documents_are_read_by_name(spark, tmp_path, monkeypatch):
    """Tasks open the files, so no folder is listed on the driver and no file is a task's share; contents are those that a listing gives."""
    monkeypatch.setattr(work, "_HELD", 30)
    texts = {"1": "văn bản 1\r\n", "2": "", "x.y": "½\x00 😀", "10": " a\n\n"}
    folder = str(tmp_path / "d")
    rows = spark.createDataFrame([(k, json.dumps({"text": v, "entities": []})) for k, v in texts.items()], "name string, content string")
    files = work.write_files(rows.withColumn("name", F.concat("name", F.lit(".json"))), folder)
    got = tables.read_documents(spark, folder, files)
    assert "Scan text" in plan(tables.read_documents(spark, folder)) and "Scan text" not in plan(got)
    assert {r["name"].removesuffix(".y"): r["text"] for r in got.collect()} == {k.removesuffix(".y"): v for k, v in texts.items()}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, tables.read_documents(spark, folder).collect()))
    assert "Scan text" not in plan(library.document_files(spark, SF))
    (tmp_path / "d" / "1.json").unlink()
    with pytest.raises(Exception, match="1.json"):
        tables.read_documents(spark, folder, files).collect()


def test_tiles_meet_in_bounded_groups(spark, monkeypatch):
    """A task is given a group of a query tile and a few others, not all its pairs of tiles in one batch; the number in a group decides nothing."""
    r = random.Random(4)
    rows = spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(3)], i % 3) for i in range(60)], "id bigint, v array<double>, label int")
    got = []
    for together in (1, 1000):
        monkeypatch.setattr(nearest, "TOGETHER", together)
        found = nearest.nearest_by_class(rows.filter("id % 2 = 0"), rows, "id", "v", F.col("label") == 0, 24 * 3, 4, 1 << 20)
        assert "FlatMapCoGroupsInArrow" in plan(found)
        got.append(sorted((x[0], round(x[1], 12), round(x[2], 12)) for x in found.collect()))
    assert got[0] == got[1] and len(got[0]) == 30


def test_prose_is_dealt_once_and_not_to_every_block(spark):
    """Long texts that stand before many blocks are shuffled by their own numbers; one of few is dealt to all tasks, and no block meets two."""
    prose = spark.createDataFrame([(100 + j, "é" * 2000, [("é", "C", 1, 2)]) for j in range(2)], "id bigint, text string, spans array<struct<text:string,type:string,start:int,end:int>>")
    blocks = spark.range(300).selectExpr("id", "concat('mục ', id) AS text", "array(named_struct('text', concat('', id), 'type', 'T', 'start', 4, 'end', 4 + length(concat('', id)))) AS spans")
    got = merging.mixed(blocks, prose, 9)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert "hashpartitioning(number#" in plan(got) and "hashpartitioning(__n#" in plan(got)
    rows = got.select("*", F.spark_partition_id().alias("task")).collect()
    assert len(rows) == 300 and sum(r["tried"] for r in rows) == sum(r["prose_id"] is not None for r in rows) == 180
    assert all(r["text"][s["start"] : s["end"]] == s["text"] for r in rows for s in r["spans"]) and {len(r["spans"]) for r in rows if r["tried"]} == {2}
    assert len({r["task"] for r in rows if r["tried"]}) > tasks // 2 and {r["prose_id"] for r in rows if r["tried"]} == {100, 101}


def test_units_of_proposals_are_made_once(spark):
    """Not for the proposals and for the join; and phrases that a rung before the last has found aren't worked on in Python."""
    assert "MapInArrow" not in plan(catalog.verified_proposals(spark, SF))
    rows = spark.createDataFrame([(1, "a B\\E  c", "b\\e C"), (2, "x Ho", "- ho ."), (3, "x", None), (4, None, "x"), (5, "đau đầux nhẹ", "đau đầu nhẹ")], "id int, text string, phrase string")
    assert sorted((r["id"], r["start"], r["end"]) for r in anchor.anchor(rows).collect()) == [(1, 2, 8), (2, 2, 4), (3, None, None), (4, None, None), (5, 0, 12)]


def test_only_spans_that_grow_need_words_and_neighbours(spark):
    """Documents and spans aren't shuffled for those that may grow where these are few: their number is known, as they are written first."""
    docs = spark.createDataFrame([(i, "đau ruột thừa cấp") for i in range(50)], "doc_id bigint, text string")
    found = spark.createDataFrame([(i, 4, 13, "CHẨN_ĐOÁN" if i == 7 else "THUỐC", "ruột thừa") for i in range(50)] + [(7, 0, 3, "THUỐC", "đau")], "doc_id bigint, start bigint, end bigint, type string, text string")
    names = spark.createDataFrame([("Ruột thừa cấp",)], "name string")
    got = anchor.extended_by_names(found, docs, names, only=F.col("type") == "CHẨN_ĐOÁN")
    assert "regexp_extract_all" not in plan(got)  # no words of whole tables beside the joins
    assert [(r["start"], r["end"], r["text"]) for r in got.filter("type = 'CHẨN_ĐOÁN'").collect()] == [(4, 17, "ruột thừa cấp")] and got.count() == 51
