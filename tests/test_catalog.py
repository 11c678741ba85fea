"""Every registered query of the engine against its SQL at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from spanloom.plans import catalog, generated, library  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.SQL[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    got, want = (d[cols].sort_values(cols, ignore_index=True) for d in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_registry_without_llm(monkeypatch):
    import importlib

    import __spark_entry__ as entry

    real = importlib.import_module
    monkeypatch.setattr(entry.importlib, "import_module", lambda n: (_ for _ in ()).throw(ModuleNotFoundError(name=n)) if n.startswith(("spanloom.llm", "corpus")) else real(n))
    assert set(entry.queries()) == set(catalog.QUERIES) and set(entry.oracle_sql()) == set(catalog.SQL)


def test_greedy_longest(spark):
    rows = catalog.QUERIES["density_longest"](spark, SF).toPandas()
    for _, g in rows.sort_values("start").groupby("doc_id"):
        assert (g["end"].to_numpy()[:-1] <= g["start"].to_numpy()[1:]).all()


def held(spark, name, sql, sf=SF):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), con.execute(sql).df()
    cols = sorted(want.columns)
    got, want = (d[cols].sort_values(cols, ignore_index=True) for d in (got, want))
    assert len(want)
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_fuzzy_names_over_all_letters(spark):
    held(spark, "fuzzy_names", """
WITH n AS (SELECT DISTINCT lower(p_name) AS name FROM part),
j AS (SELECT a.name, b.name AS other, levenshtein(a.name, b.name) AS d FROM n a JOIN n b ON a.name <> b.name AND abs(length(a.name) - length(b.name)) < 4)
SELECT name, min(d) AS distance, arg_min(other, (d, other)) AS nearest FROM j GROUP BY name""")


_LINES = "l AS (SELECT conv_id AS doc_id, turn, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM conversations WHERE text <> '')"


def test_reply_parse_reads_every_line(spark):
    held(spark, "reply_parse", f"""
WITH {_LINES}, r AS (SELECT doc_id, turn % 4 AS m, row_number() OVER (PARTITION BY doc_id ORDER BY turn, k) - 1 AS line, trim(t) AS t FROM l)
SELECT doc_id, line, CASE m WHEN 0 THEN 'TRIỆU_CHỨNG' WHEN 1 THEN 'THUỐC' ELSE 'KẾT_QUẢ_XÉT_NGHIỆM' END AS kind, t AS text FROM r WHERE m <> 2 AND t <> ''""")


def test_reply_scenarios_read_every_line(spark):
    held(spark, "reply_scenarios", f"""
WITH {_LINES}, r AS (SELECT doc_id, turn, k, CASE WHEN turn % 3 = 0 THEN 'TH' ELSE 'TC' END AS code, trim(t) AS t FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, code ORDER BY turn, k) AS n FROM r WHERE length(t) >= 2)
SELECT doc_id, string_agg(t, ' / ' ORDER BY n) FILTER (code = 'TC' AND n <= 5) AS symptoms, coalesce(string_agg(t, ' / ' ORDER BY n) FILTER (code = 'TH' AND n <= 5), '') AS drugs
FROM n GROUP BY doc_id HAVING count(*) FILTER (code = 'TC') >= 3""")


def test_phrase_anchor_whole_items_everywhere(spark, tmp_path):
    item = "a b c d e f g h i j"
    texts = [(1, f"x {item} y\n{item}"), (2, "a b c d e f g h z"), (3, "q r"), (4, "so q r q r"), (5, "r"), (6, None), (7, "c d e f g h i j")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(10, item), (11, "q r"), (12, ""), (13, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted(map(tuple, catalog.QUERIES["phrase_anchor"](spark, str(tmp_path)).collect()))
    assert got == [(1, 10, 2), (1, 10, 24), (3, 11, 0), (4, 11, 3), (4, 11, 7)]
