"""Further registered queries: readers and writers, anchors, gates, generators and labels, each with the SQL it is held against.

What is random in a generator can't be told by SQL; there the query returns what must hold of every row, counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import anchor, compose, drugs, generate, knowledge, labels, nearest, rules, segment, spans, verify
from spanloom.plans import extract
from spanloom.plans.catalog import _RX, MARK, NOTE_SQL, QUERIES, SPAN_SQL, event_labels, line_spans, notes, prescriptions, query, table
from spanloom.sources import tables, work

_BEFORE = set(QUERIES)


def counted(rows: DataFrame, **conditions) -> DataFrame:
    """One row: n, and how many rows each condition holds of."""
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias(k) for k, c in conditions.items()])


# ---------------------------------------------------------------------------------------------------------------------
# readers and writers


@query("SELECT CAST(n_nationkey AS VARCHAR) AS name, n_name || chr(10) || 'region ' || CAST(n_regionkey AS VARCHAR) AS text FROM nation")
def text_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per nation, written and read back."""
    folder = work.work_path(spark)
    rows = table(spark, sf_dir, "nation").select(F.format_string("%d.txt", "n_nationkey").alias("name"), F.concat("n_name", F.lit("\nregion "), F.col("n_regionkey").cast("string")).alias("content"))
    work.write_files(rows, folder)
    return tables.read_texts(spark, folder)


@query("SELECT printf('%04d', n_nationkey * 997) AS name, n_name AS text, '[{\"text\":\"' || n_name || '\"}]' AS entities, CAST(length(n_name) AS BIGINT) AS bytes FROM nation")
def pair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, names = work.work_path(spark), work.work_path(spark)
    rows = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 997).alias("index"), F.col("n_name").alias("text"), F.to_json(F.array(F.struct(F.col("n_name").alias("text")))).alias("entities"))
    sizes = tables.write_pairs(rows, texts, names).select(F.substring_index("name", ".", 1).alias("name"), "bytes")
    return tables.read_texts(spark, texts).join(tables.read_texts(spark, names).withColumnRenamed("text", "entities"), "name").join(sizes, "name").select("name", "text", "entities", "bytes")


@query("SELECT DISTINCT lower('Order ' || CAST(o_orderkey AS VARCHAR)) AS name FROM orders")
def csv_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from the first known column of a CSV, of which there must be a thousand."""
    folder = work.work_path(spark)
    table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit(" Order   "), F.col("o_orderkey").cast("string")).alias("STR")).write.option("ignoreLeadingWhiteSpace", False).csv(folder, header=True)
    return tables.read_names(spark, folder)


@query("SELECT DISTINCT c_name AS name FROM customer UNION SELECT DISTINCT c_mktsegment FROM customer")
def csv_all_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work.work_path(spark)
    table(spark, sf_dir, "customer").select("c_name", "c_mktsegment").write.csv(folder, header=True)
    return tables.read_all_columns(spark, folder)


@query("SELECT 'Part ' || p_name AS name FROM part")
def line_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without the white space around them, and without blank ones."""
    folder = work.work_path(spark)
    rows = table(spark, sf_dir, "part").select(F.explode(F.array(F.concat(F.lit("\t Part "), "p_name", F.lit("  ")), F.lit(" \t"), F.lit(""))).alias("value"))
    rows.write.text(folder)
    return tables.read_lines(spark, folder)


@query("SELECT lower(n_name) AS name, lower(r_name) AS other FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT lower(r_name), lower(n_name) FROM nation JOIN region ON n_regionkey = r_regionkey")
def synonym_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = work.work_path(spark)
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("form"), F.col("r_name").alias("usan"))
    both.write.csv(folder, header=True)
    return tables.read_synonyms(spark, folder)


@query("""SELECT 'terms' AS name, count(*) AS n, min(code) AS least FROM (SELECT CAST(p_partkey AS VARCHAR) AS code FROM part)
UNION ALL SELECT 'heads', count(*), min(n_name) FROM nation""")
def kb_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of a CSV table and a line list, loaded as views."""
    folder = work.work_path(spark)
    table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), F.col("p_partkey").alias("code")).write.csv(f"{folder}/terms.csv", header=True)
    table(spark, sf_dir, "nation").select("n_name").write.text(f"{folder}/heads.txt")
    tables.bundle(spark, folder, {"terms": "code string, term string"}, ("heads",))
    return spark.sql("SELECT 'terms' AS name, count(*) AS n, min(code) AS least FROM terms UNION ALL SELECT 'heads', count(*), min(name) FROM heads")


@query("""WITH s AS (SELECT p_name AS name FROM part UNION ALL SELECT p_brand || ' ' || p_type || ' ' || p_name || ' a b c' FROM part UNION ALL SELECT n_name FROM nation)
SELECT DISTINCT lower(name) AS name FROM s WHERE len(string_split(name, ' ')) <= 8""")
def short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    long = part.select(F.concat_ws(" ", "p_brand", "p_type", "p_name", F.lit("a b c")).alias("name"))
    return tables.short_names(part.select(F.col("p_name").alias("name")), long, table(spark, sf_dir, "nation").select(F.col("n_name").alias("name")))


@query(f"""WITH {_RX}
SELECT p_partkey AS doc_id, text, CAST(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n, CASE WHEN p_size % 2 = 0 THEN p_name END AS first, CASE WHEN p_size % 2 = 0 THEN CAST(5 AS BIGINT) END AS "start" FROM part JOIN rx ON p_partkey = doc_id""")
def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON file per prescription with its spans, written and read back."""
    folder, rx = work.work_path(spark), prescriptions(spark, sf_dir)
    found = rx.filter("p_size % 2 = 0").select("doc_id", F.lit(5).cast("bigint").alias("start"), (5 + F.length("p_name")).cast("bigint").alias("end"), F.lit("THUỐC").alias("type"), F.col("p_name").alias("text"))
    rows = tables.read_documents(spark, folder, work.write_files(tables.documents_json(rx, found), folder))
    one = F.try_element_at("entities", F.lit(1))
    return rows.select(F.col("name").cast("bigint").alias("doc_id"), "text", F.size("entities").cast("bigint").alias("n"), one["text"].alias("first"), one["position"][0].alias("start"))


@query("""SELECT CASE WHEN p_size % 2 = 0 THEN 'THUỐC' ELSE 'CHẨN_ĐOÁN' END AS type, count(*) AS n FROM part GROUP BY 1
UNION ALL SELECT 'entities', count(*) FROM part UNION ALL SELECT 'files', count(*) FROM part""")
def submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rx = prescriptions(spark, sf_dir)
    found = rx.select("doc_id", F.lit(5).cast("bigint").alias("start"), (5 + F.length("p_name")).cast("bigint").alias("end"), F.when(F.col("p_size") % 2 == 0, "THUỐC").otherwise("CHẨN_ĐOÁN").alias("type"), F.col("p_name").alias("text"))
    return tables.write_submission(rx.select("doc_id", "text"), found, work.work_path(spark))


@query("SELECT o_orderstatus AS status, count(*) AS n, 1 AS made FROM orders GROUP BY 1")
def cached_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Made once, though asked for twice."""
    path, made = work.work_path(spark), []

    def make() -> DataFrame:
        made.append(1)
        return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))

    work.cached(spark, path, make)
    return work.cached(spark, path, make).withColumn("made", F.lit(len(made)))


@query("""WITH t AS (SELECT n_regionkey AS r, n_nationkey AS k, n_name AS w FROM nation)
SELECT CAST(dense_rank() OVER (ORDER BY r) AS BIGINT) AS sentence, CAST(row_number() OVER (PARTITION BY r ORDER BY k) AS BIGINT) AS pos, w AS token, CASE WHEN k % 2 = 0 THEN 'B-X' ELSE 'O' END AS label FROM t""")
def conll_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence per region, blank lines between them, and lines of one column that are dropped."""
    folder, rows = work.work_path(spark), table(spark, sf_dir, "nation")
    line = F.concat("n_name", F.lit("\tx  "), F.when(F.col("n_nationkey") % 2 == 0, "B-X").otherwise("O"))
    part = rows.groupBy("n_regionkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda x: x["l"]), "\n").alias("s"))
    whole = part.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_regionkey", "s"))), lambda x: x["s"]), "\n\nalone\n\n").alias("content"))
    work.write_files(whole.select(F.lit("a.conll").alias("name"), "content"), folder)
    got = tables.read_conll(spark, folder).select("sentence", F.posexplode(F.arrays_zip("tokens", "labels")).alias("pos", "x"))
    return got.select(F.col("sentence").cast("bigint").alias("sentence"), (F.col("pos") + 1).cast("bigint").alias("pos"), F.col("x.tokens").alias("token"), F.col("x.labels").alias("label"))


@query("SELECT n_nationkey AS id, CAST(i AS BIGINT) AS pos, CASE i WHEN 1 THEN 'B-SYM_DIS' WHEN 2 THEN 'I-SYM_DIS' ELSE 'O' END AS label, TRUE AS inclusive FROM nation, (SELECT unnest(range(4)) AS i)")
def span_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span JSON to BIO labels with renamed types; a type that has no new name becomes O."""
    folder = work.work_path(spark)
    one = F.concat(F.lit('{"sentence": "n'), F.col("n_nationkey").cast("string"), F.lit(' a b c", "seq_label": [[1, 2, "SYMPTOM_AND_DISEASE"], [3, 3, "DRUG"], [2, 9, "SYMPTOM_AND_DISEASE"]]}'))
    whole = table(spark, sf_dir, "nation").agg(F.concat(F.lit("["), F.array_join(F.collect_list(one), ","), F.lit("]")).alias("content"))
    work.write_files(whole.select(F.lit("a.json").alias("name"), "content"), folder)
    rows = tables.read_span_json(spark, folder)
    found = rows.withColumn("good", F.filter("spans", lambda s: s["last"] < F.size("tokens")))
    painted = labels.renamed(labels.span_labels(F.size("tokens"), F.col("spans")), {"SYMPTOM_AND_DISEASE": "SYM_DIS"})
    all_in = labels.ends_inclusive(found, "tokens", "good")
    out = rows.select(F.expr("cast(substring(tokens[0], 2) as int)").alias("id"), F.posexplode(painted).alias("pos", "label"))
    return out.select("id", F.col("pos").cast("bigint").alias("pos"), "label").crossJoin(F.broadcast(all_in))


@query("""WITH s AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1)
SELECT rpad(label, 24, ' ') || '    0.5000    0.2500    0.3333' || lpad(CAST(n AS VARCHAR), 10, ' ') AS line FROM s""")
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("support"))
    return tables.report(rows.select("label", F.lit(0.5).alias("precision"), F.lit(0.25).alias("recall"), F.lit(1 / 3).alias("f1"), "support"))


# ---------------------------------------------------------------------------------------------------------------------
# text forms and matching


@query("SELECT p_partkey AS id, lower(strip_accents('Épi ' || p_name || ' Đường ÂM  Tính')) AS x, replace(lower(strip_accents('Épi ' || p_name || ' Đường ÂM  Tính')), '  ', ' ') AS plain, 'épi ' || lower(p_name) AS composed FROM part")
def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without accents (in lower case, white space as it was), and the two normal forms: plain, and composed."""
    raw, split = F.concat(F.lit("Épi "), "p_name", F.lit(" Đường ÂM  Tính")), F.concat(F.lit("E\u0301PI   "), "p_name")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower(T.without_accents(raw)).alias("x"), T.plain_form(raw).alias("plain"), T.key_form(T.nfc(split)).alias("composed"))


_VARIANT = "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(replace(p_name, ' ', '   ')) WHEN 2 THEN '- ' || p_name || '.' ELSE substr(p_name, 1, length(p_name) - 1) || 'x' END"


@query(f"""SELECT p_partkey AS id, {_VARIANT} AS phrase, CAST(5 AS BIGINT) AS "start", CAST(5 + length(p_name) AS BIGINT) AS "end" FROM part
UNION ALL SELECT p_partkey, 'nowhere to be found in it', NULL, NULL FROM part""")
def anchor_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as they are, in other case and spacing, with marks at their ends, with another last letter; and a phrase that no rung finds."""
    rx = work.spread(prescriptions(spark, sf_dir), "doc_id")
    last = F.concat(F.substr("p_name", F.lit(1), F.length("p_name") - 1), F.lit("x"))
    k = F.col("doc_id") % 4
    phrase = F.when(k == 0, F.col("p_name")).when(k == 1, F.upper(F.replace("p_name", F.lit(" "), F.lit("   ")))).when(k == 2, F.concat(F.lit("- "), "p_name", F.lit("."))).otherwise(last)
    rows = rx.select(F.col("doc_id").alias("id"), "text", F.explode(F.array(phrase, F.lit("nowhere to be found in it"))).alias("phrase"))
    return anchor.anchor(rows).select("id", "phrase", "start", "end")


@query("""WITH p AS (SELECT p_partkey AS doc_id, string_split(p_name, ' ') AS w FROM part),
t AS (SELECT doc_id, w[1] AS a, 'x' || w[1] || ' ' || upper(w[1]) || ' b ' || w[1] || '.' AS text FROM p)
SELECT doc_id, a AS phrase, CAST(x AS BIGINT) AS "start", CAST(x + length(a) AS BIGINT) AS "end", round(1 + length(a) * 0.001, 6) AS score FROM (SELECT *, unnest([length(a) + 2, 2 * length(a) + 5]) AS x FROM t) WHERE doc_id % 3 <> 0
UNION ALL SELECT doc_id, 'b', 2 * length(a) + 3, 2 * length(a) + 4, 1.001 FROM t WHERE doc_id % 3 = 1""")
def phrase_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole-word occurrence of a document's phrases; documents that lack most of theirs give none."""
    rx = prescriptions(spark, sf_dir)
    a = F.element_at(F.split("p_name", " "), 1)
    text = F.concat(F.lit("x"), a, F.lit(" "), F.upper(a), F.lit(" b "), a, F.lit("."))
    k = F.col("doc_id") % 3
    asked = F.when(k == 0, F.array(a, F.lit("zz"), F.lit("yy"))).when(k == 1, F.array(a, F.lit("b"), F.lit("zz"))).otherwise(F.array(a))
    return anchor.all_occurrences(rx.select("doc_id", text.alias("text"), asked.alias("phrases"))).withColumn("score", F.round("score", 6))


@query("""SELECT o_orderkey AS doc_id, k.kind, k.text, CAST(k.s AS BIGINT) AS "start", CAST(k.s + length(k.text) AS BIGINT) AS "end" FROM (
  SELECT o_orderkey, o_orderkey % 3 AS m, unnest([{'kind': 'TÊN_XÉT_NGHIỆM', 'text': 'HBsAg', 's': 2}, {'kind': 'KẾT_QUẢ_XÉT_NGHIỆM', 'text': CASE o_orderkey % 3 WHEN 0 THEN 'âm tính' WHEN 1 THEN '(+)' ELSE 'Dương tính' END, 's': 9}]) AS k FROM orders)""")
def lab_qualitative(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("o_orderkey") % 3
    value = F.when(m == 0, "âm tính").when(m == 1, "(+)").otherwise("Dương tính")
    return rules.lab_pairs(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("- HBsAg: "), value, F.lit("\nVi khuẩn")).alias("text")))


_DUAL = "[" + ", ".join(f"'{n}'" for n in drugs.DUAL_USE) + "]"


@query(f"""WITH t AS (SELECT p_partkey AS doc_id, {_DUAL}[p_partkey % {len(drugs.DUAL_USE)} + 1] AS name, p_size AS n FROM part)
SELECT doc_id, upper(name) || '  ' || n || CASE doc_id % 4 WHEN 0 THEN ' mg' ELSE '%' END AS text, CAST(4 AS BIGINT) AS "start", CAST(6 + length(name) + length(CAST(n AS VARCHAR)) + CASE doc_id % 4 WHEN 0 THEN 3 ELSE 1 END AS BIGINT) AS "end", 'dict' AS source
FROM t WHERE doc_id % 4 < 2 AND length(name) >= 4""")
def dual_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are tests too, before a dose, a share, a concentration or a word: only the first two make them drugs."""
    k = F.col("p_partkey")
    name = F.upper(F.element_at(F.array(*map(F.lit, drugs.DUAL_USE)), (k % len(drugs.DUAL_USE) + 1).cast("int")))
    tail = F.when(k % 4 == 0, " mg").when(k % 4 == 1, "%").when(k % 4 == 2, " mg/l máu").otherwise(" lần")
    docs = table(spark, sf_dir, "part").select(k.alias("doc_id"), F.concat(F.lit("- X "), name, F.lit("  "), F.col("p_size").cast("string"), tail).alias("text"))
    known = drugs.dictionary(spark.createDataFrame([(n,) for n in drugs.DUAL_USE], "name string"))
    return drugs.find(docs, known).select("doc_id", "text", "start", "end", "source")


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\n]+[ \\n]*')) AS t, generate_subscripts(regexp_extract_all(text, '[^ \\n]+[ \\n]*'), 1) AS k, length(text) - length(ltrim(text, ' ' || chr(10))) AS lead FROM (SELECT o_orderkey AS doc_id, ' ' || o_orderpriority || '  ' || o_orderstatus || chr(10) || 'état' AS text FROM orders)),
o AS (SELECT *, lead + coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w)
SELECT doc_id, rtrim(t, ' ' || chr(10)) AS word, CAST(s AS BIGINT) AS "start", CAST(s + length(rtrim(t, ' ' || chr(10))) AS BIGINT) AS "end", doc_id % 2 = 0 AS whole FROM o WHERE doc_id % 2 = 0 OR rtrim(t, ' ' || chr(10)) <> 'état'""")
def word_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tokenizer's words at their places; in odd documents its last word differs from the text."""
    orders = table(spark, sf_dir, "orders")
    text = F.concat(F.lit(" "), "o_orderpriority", F.lit("  "), "o_orderstatus", F.lit("\nétat"))
    said = F.concat(F.split("o_orderpriority", " "), F.array("o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "état").otherwise("etat")))
    rows = orders.select(F.col("o_orderkey").alias("doc_id"), labels.aligned_words(text, F.filter(said, lambda w: w != "")).alias("a"))
    at = rows.select("doc_id", "a.whole", F.explode("a.words").alias("w"))
    return at.select("doc_id", "w.word", "w.start", "w.end", "whole")


@query("SELECT p_partkey AS doc_id, CAST(CASE WHEN p_size % 2 = 0 THEN 1 ELSE 3 END AS BIGINT) AS n FROM part")
def word_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of one, four and nine words of three types, those over their type's cap left out (names of four words and nine go; diagnoses of eight stay)."""
    n = F.array(F.lit(1), F.lit(4), F.lit(9))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_size") % 2 == 0, "KẾT_QUẢ_XÉT_NGHIỆM").otherwise("CHẨN_ĐOÁN").alias("type"), F.explode(n).alias("k"))
    rows = rows.withColumn("text", F.array_join(F.array_repeat(F.lit("w"), F.when((F.col("type") != "CHẨN_ĐOÁN") & (F.col("k") > 1), F.col("k") + 1).otherwise(F.least("k", F.lit(8)))), " "))
    return rows.filter(~spans.over_cap(F.col("type"), F.col("text"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH t AS (SELECT p_partkey AS id, CASE p_size % 6 WHEN 0 THEN 'Theo dõi ' || p_name WHEN 1 THEN 'LẤY  MẪU ' || p_name WHEN 2 THEN ' ' || substr(p_name, 1, 1 + p_partkey % 3) || ' ' WHEN 3 THEN p_name || repeat(' x', p_partkey % 9) WHEN 4 THEN 'Mẫu ' || p_name ELSE p_name END AS name FROM part)
SELECT id, name, length(trim(name)) >= 3 AND len(regexp_extract_all(name, '[^ ]+')) <= 8 AND NOT regexp_matches(lower(strip_accents(trim(name))), '^(theo doi|lay +mau)') AS kept FROM t""")
def test_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of tests: parts' names, some with what is done before them, some cut short, some with words behind them."""
    k, name = F.col("p_partkey"), F.col("p_name")
    n = F.col("p_size") % 6
    said = F.when(n == 0, F.concat(F.lit("Theo dõi "), name)).when(n == 1, F.concat(F.lit("LẤY  MẪU "), name)).when(n == 2, F.concat(F.lit(" "), F.substr(name, F.lit(1), (k % 3 + 1).cast("int")), F.lit(" ")))
    said = said.when(n == 3, F.concat(name, F.repeat(F.lit(" x"), (k % 9).cast("int")))).when(n == 4, F.concat(F.lit("Mẫu "), name)).otherwise(name)
    return table(spark, sf_dir, "part").select(k.alias("id"), said.alias("name")).withColumn("kept", verify.is_test_name(F.col("name")))


@query("""SELECT p_partkey AS doc_id, CASE WHEN p_size % 2 = 0 THEN 'statin|' || p_name || ' a b c|two words' ELSE 'thuốc bổ|one two three four five six' END AS drugs FROM part""")
def drug_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups, exact names of up to five words and names of two words stay; a list of which nothing stays keeps its first two."""
    part = table(spark, sf_dir, "part")
    long = F.concat(F.col("p_name"), F.lit(" a b c"))
    said = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("statin"), long, F.lit("two words"), F.lit("quite another thing here"))).otherwise(F.array(F.lit("thuốc bổ"), F.lit("one two three four five six"), F.lit("thuốc uống")))
    rows = part.select(F.col("p_partkey").alias("doc_id"), said.alias("drugs"))
    return verify.good_drugs(rows, part.select(long.alias("name"))).select("doc_id", F.array_join("drugs", "|").alias("drugs"))


@query("""SELECT 'THUOC' AS type, p_name AS text, count(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'TEN_XET_NGHIEM', p_name || 's', count(*) FROM part GROUP BY 2
UNION ALL SELECT 'CHAN_DOAN', '#####', count(*) FROM part UNION ALL SELECT 'THUOC', 'Kháng sinh', count(*) FROM part""")
def listed_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drugs and tests that resemble a name of their list, common groups, and other types; what resembles none goes."""
    part = table(spark, sf_dir, "part")
    item = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    rows = part.select(F.explode(F.array(item("THUOC", F.col("p_name")), item("THUOC", F.lit("#####")), item("THUOC", F.lit("Kháng sinh")), item("TEN_XET_NGHIEM", F.concat("p_name", F.lit("s"))), item("TEN_XET_NGHIEM", F.lit("@@@@")), item("CHAN_DOAN", F.lit("#####")))).alias("x")).select("x.type", "x.text")
    names = part.select(F.col("p_name").alias("name"))
    return verify.in_lists(rows, names, names).groupBy("type", "text").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH w AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), q AS (SELECT * FROM w WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id, w.label = 0 AS r, list_dot_product(q.v, w.v) / sqrt(list_dot_product(w.v, w.v) * list_dot_product(q.v, q.v)) AS c FROM q JOIN w ON q.vec_id <> w.vec_id),
t AS (SELECT vec_id, coalesce(max(c) FILTER (r), -1) AS r, coalesce(max(c) FILTER (NOT r), -1) AS o FROM s GROUP BY vec_id)
SELECT vec_id, CASE WHEN r > 0.5 AND r >= o THEN 'TRIỆU_CHỨNG' WHEN o >= 0.93 THEN 'CHẨN_ĐOÁN' END AS type FROM t""")
def cascade_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    got = nearest.nearest_by_class(rows.filter("vec_id % 20 = 0"), rows, "vec_id", "embedding", F.col("label") == 0)
    return nearest.cascade(got, "TRIỆU_CHỨNG", "CHẨN_ĐOÁN").select("vec_id", "type")


@query(f"""WITH RECURSIVE {SPAN_SQL}, pool AS (SELECT doc_id, s, e, score FROM spans UNION ALL SELECT doc_id, s + 1, e + 1, score + 1 FROM spans WHERE source = 'llm'),
chains AS (
  SELECT doc_id, e, score AS total FROM pool WHERE score > 0
  UNION SELECT c.doc_id, n.e, c.total + n.score FROM chains c JOIN pool n ON n.doc_id = c.doc_id AND n.s >= c.e WHERE n.score > 0)
SELECT doc_id, CAST(max(total) AS BIGINT) AS best FROM chains GROUP BY doc_id""")
def pooled_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = line_spans(spark, sf_dir)
    other = every.filter("source = 'llm'").withColumn("start", F.col("start") + 1).withColumn("end", F.col("end") + 1).withColumn("score", F.col("score") + 1)
    return extract.pooled([every, other]).groupBy("doc_id").agg(F.sum("score").alias("best"))


@query("SELECT CAST(sum(CASE WHEN l_returnflag = 'A' THEN 2 WHEN l_returnflag = 'N' THEN 6 ELSE 3 END) AS BIGINT) AS cost, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 0 ELSE CASE WHEN l_returnflag = 'A' THEN 2 ELSE 3 END END) AS BIGINT) AS n_ref FROM lineitem")
def word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans missed (A, two words), of the wrong type (N, three words, counted twice) and spurious (R, three words)."""
    rows = table(spark, sf_dir, "lineitem").select(F.monotonically_increasing_id().alias("k"), "l_returnflag")
    gold = rows.filter("l_returnflag <> 'R'").select("k", F.lit("A").alias("type"), F.when(F.col("l_returnflag") == "A", 2).otherwise(3).alias("n_words"))
    found = rows.filter("l_returnflag <> 'A'").select("k", F.lit("B").alias("type"), F.lit(3).alias("n_words"))
    return labels.word_cost(gold, found, ["k"])


@query("SELECT o_orderkey AS \"table\", CAST(2 AS BIGINT) AS pos, 'Ure ' || CAST(o_custkey AS VARCHAR) AS name FROM orders UNION ALL SELECT o_orderkey, 5, 'Calci' FROM orders")
def price_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A flattened price table: code, name, price; a text before another text is a code."""
    cells = F.array(F.lit("XN01"), F.lit(" "), F.concat(F.lit(" Ure "), F.col("o_custkey").cast("string")), F.lit("12.000"), F.lit("15.2"), F.lit("Calci"), F.lit("9000"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("table"), F.posexplode(cells).alias("pos", "text")).withColumn("pos", F.col("pos").cast("bigint"))
    return knowledge.names_before_prices(rows)


@query("""WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber * 7 AS s, l_linenumber * 7 + CAST(l_quantity AS INTEGER) AS e, l_partkey AS k1, l_suppkey AS k2 FROM lineitem)
SELECT count(*) AS n, 0 AS overlaps, 0 AS untouched FROM (SELECT DISTINCT doc_id FROM s WHERE e > s)""")
def longest_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of a greedy choice: a longest span of each document is taken, no taken ones overlap, and each that isn't touches a taken one as long or longer."""
    every = line_spans(spark, sf_dir).select("doc_id", "start", "end", "type", "k1", "k2").filter("`end` > start")
    kept = spans.longest_first(every, "start", "k1", "k2")
    lapped = spans.violations(kept, "k1", "k2").agg(F.count(F.lit(1)).cast("int").alias("overlaps"))
    k = kept.select(F.col("doc_id").alias("d"), F.col("start").alias("a"), F.col("end").alias("b"))
    free = every.join(k, (F.col("doc_id") == F.col("d")) & (F.col("start") < F.col("b")) & (F.col("a") < F.col("end")) & (F.col("b") - F.col("a") >= F.col("end") - F.col("start")), "left_anti")
    top = every.groupBy("doc_id").agg(F.max(F.col("end") - F.col("start")).alias("n")).join(kept.groupBy("doc_id").agg(F.max(F.col("end") - F.col("start")).alias("n")), ["doc_id", "n"])
    return top.agg(F.count(F.lit(1)).alias("n")).crossJoin(lapped).crossJoin(free.agg(F.count(F.lit(1)).cast("int").alias("untouched")))


# ---------------------------------------------------------------------------------------------------------------------
# generators


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all letters with terms of two to eleven words."""
    k = F.col("o_orderkey")
    term = F.concat(F.array_join(F.array_repeat(F.lit("từ"), (2 + k % 10).cast("int")), " "), F.lit(" "), k.cast("string"))
    return table(spark, sf_dir, "orders").select(F.concat(F.char(65 + k % 26), F.format_string("%02d", k % 100)).alias("code"), term.alias("term"))


_TERM_SQL = "t AS (SELECT chr(CAST(65 + o_orderkey % 26 AS INTEGER)) AS ch, 3 + o_orderkey % 10 AS w, chr(CAST(65 + o_orderkey % 26 AS INTEGER)) || printf('%02d', o_orderkey % 100) AS code, repeat('từ ', CAST(2 + o_orderkey % 10 AS BIGINT)) || o_orderkey AS term FROM orders)"
_QUOTA_SQL = "CASE ch " + " ".join(f"WHEN '{c}' THEN {max(n, compose.LEAST_QUOTA)}" for c, n in compose.CHAPTER_QUOTA.items()) + f" ELSE {compose.LEAST_QUOTA} END"


@query(f"""WITH {_TERM_SQL}, r AS (SELECT ch AS chapter, code, term, row_number() OVER (PARTITION BY ch ORDER BY CAST('0x' || substr(md5('5:' || code || ':' || term), 1, 15) AS BIGINT), code, term) AS r FROM t WHERE w <= 6 AND ch NOT IN ('V', 'W', 'X', 'Y', 'U', 'R'))
SELECT chapter, code, term FROM r WHERE r <= {_QUOTA_SQL.replace('ch ', 'chapter ', 1)}""")
def diagnosis_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagnoses drawn of each chapter."""
    return compose.diagnoses(_terms(spark, sf_dir), 5).filter("linkable").select("chapter", "code", "term")


@query(f"WITH {_TERM_SQL} SELECT count(DISTINCT ch) AS chapters, count(*) AS terms FROM t")
def chapter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = _terms(spark, sf_dir)
    return compose.chapters(terms.withColumn("chapter", compose.chapter(F.col("code"))))


@query(f"""WITH {NOTE_SQL}, b AS (SELECT DISTINCT substr(line, 3) AS text FROM lines WHERE line LIKE '- part %'),
t AS (SELECT repeat('từ ', CAST(2 + o_orderkey % 10 AS BIGINT)) || CAST(o_orderkey AS VARCHAR) AS text FROM orders WHERE o_orderkey % 26 = 17 AND 3 + o_orderkey % 10 <= 7)
SELECT text FROM b UNION ALL SELECT text FROM t""")
def symptom_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.symptoms(_terms(spark, sf_dir), segment.segment(notes(spark, sf_dir)))


@query("""WITH a AS (SELECT trim(p_name) AS term, TRUE AS linkable FROM part UNION ALL SELECT n_name, FALSE FROM nation UNION ALL SELECT upper(p_name), FALSE FROM part)
SELECT arg_min(term, (NOT linkable, term)) AS term, bool_or(linkable) AS linkable FROM a WHERE length(term) >= 3 GROUP BY lower(term)""")
def linkable_drugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    generic = table(spark, sf_dir, "nation").select(F.col("n_name").alias("term")).unionByName(part.select(F.upper("p_name").alias("term")))
    return compose.linked(part.select(F.col("p_name").alias("term")), generic)


@query("SELECT DISTINCT 'acid ' || CAST(k AS VARCHAR) || s AS term FROM (SELECT p_partkey % 50 AS k FROM part), (VALUES (' mide'), (' mid')) v(s)")
def drug_ingredients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingredients of product names, without doses and forms, with a variant without the last e; combinations go."""
    k = (F.col("p_partkey") % 50).cast("string")
    rows = table(spark, sf_dir, "part").select(F.explode(F.array(F.concat(F.lit("acid "), k, F.lit(" mide 20 MG Oral Tablet")), F.concat(F.lit("acid "), k, F.lit(" / base 5 MG")), F.concat(F.lit("brand ["), k, F.lit("]")))).alias("term"))
    return drugs.ingredients(rows)


_UNIT_COUNT = len(compose.units())


_HEADS, _NO_HEADS, _NO = ["Khám lâm sàng", "Hỏi đáp"], ["Phủ nhận"], ["không sốt", "không ho", "không phù", "không nôn"]


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = F.struct(F.concat(F.lit("mục "), F.col("l_partkey").cast("string")).alias("text"), F.when(F.col("l_linenumber") % 2 == 0, "THUOC").otherwise("CHAN_DOAN").alias("type"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_partkey", "l_linenumber")
    return work.spread(lines, "id").groupBy("id").agg(F.collect_list(one).alias("items"))  # no lists are made, and merged, before the lines of an order meet


@query("SELECT count(*) AS n, count(*) AS verbatim, count(*) AS complete, count(*) AS ordered, CAST(sum(m) AS BIGINT) AS spans, TRUE AS denied FROM (SELECT l_orderkey, count(*) AS m FROM lineitem GROUP BY 1)")
def built_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of a block is a span at its place, spans don't overlap, about six blocks in ten end in denials."""
    items = _items(spark, sf_dir)
    made = work.cached(spark, work.work_path(spark), lambda: compose.blocks(items, _HEADS, _NO_HEADS, _NO, 11))
    sure = compose.verbatim_only(made).select("id", F.lit(True).alias("sure"))
    rows = made.join(items, "id").join(sure, "id", "left")
    bag = lambda c: F.sort_array(F.transform(c, lambda x: F.concat(x["type"], x["text"])))
    steps = F.zip_with("spans", F.concat(F.slice("spans", 2, 1000), F.slice("spans", 1, 0)), lambda x, y: F.coalesce(x["end"] <= y["start"], F.lit(True)))
    got = counted(rows, verbatim=F.coalesce("sure", F.lit(False)), complete=bag("spans") == bag("items"), ordered=F.forall(steps, lambda x: x), spans=F.size("spans"), denied=F.lower("text").contains("phủ nhận"))
    return got.select("n", "verbatim", "complete", "ordered", "spans", (F.col("denied") / F.col("n")).between(0.5, 0.7).alias("denied"))


@query("SELECT count(*) AS n, count(*) AS verbatim, count(*) AS known FROM customer")
def drawn_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block for each customer from one of the orders' pools."""
    items = _items(spark, sf_dir)
    made = compose.drawn_blocks(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), items.select("items"), 5, headings=_HEADS, negative_headings=_NO_HEADS, negatives=_NO)
    bag = lambda c: F.sort_array(F.transform(c, lambda x: F.concat(x["type"], x["text"])))
    pools = items.select(bag("items").alias("bag")).distinct().withColumn("is", F.lit(True))
    rows = made.withColumn("bag", bag("spans")).join(pools, "bag", "left")
    good = compose.verbatim_only(made).agg(F.count(F.lit(1)).alias("verbatim"))
    return counted(rows, known=F.coalesce("is", F.size("bag") == 0)).crossJoin(good).select("n", "verbatim", "known")


@query("SELECT o_orderkey AS id, 'II. ' || upper(o_orderstatus || ' x') || ' -' || chr(10) AS head, '  • ' AS lead, o_orderstatus || ': ' || o_orderpriority || ', b' || chr(10) AS line, CAST(length(o_orderstatus) + 2 AS BIGINT) AS \"start\", CAST(length(o_orderstatus) + 2 + length(o_orderpriority) AS BIGINT) AS \"end\" FROM orders")
def line_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = compose.inline_line(F.col("o_orderstatus"), F.array("o_orderpriority", F.lit("b")))
    head = compose.heading_line(F.concat("o_orderstatus", F.lit(" x")), F.lit("II."), F.lit(" -"), F.lit("upper"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), head.alias("head"), compose.bullet_prefix(F.lit("•"), F.lit("  ")).alias("lead"), line.alias("l"))
    first = F.element_at("l.spans", 1)
    return rows.select("id", "head", "lead", F.col("l.text").alias("line"), first["start"].alias("start"), first["end"].alias("end"))


@query("""SELECT o_orderkey AS id, '<|im_start|>user' || chr(10) || 'Viết về ' || o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN ' /no_think' ELSE '' END || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)
  || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '/no_think' || chr(10) END AS prompt FROM orders""")
def chat_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts as turns of a chat; those that ask for no thinking themselves aren't told again."""
    said = compose.filled("Viết về {what}{hint}", what=F.col("o_orderpriority"), hint=F.when(F.col("o_orderkey") % 2 == 0, " /no_think"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), compose.as_turn(said).alias("prompt"))


@query("SELECT o_orderkey AS id, 'Viết về ' || o_orderstatus || ' {x}: ' || o_orderpriority || '.' AS prompt FROM orders")
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = compose.filled("Viết về {topic} {{x}}: {what}.", topic=F.col("o_orderstatus"), what=F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), said.alias("prompt"))


@query("""SELECT count(*) AS n, count(*) AS capped, count(*) AS diagnosed, count(*) AS mentioned, count(*) AS titled, count(*) AS noisy, TRUE AS context FROM orders""")
def article_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounds of an article's inputs hold of every scenario."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("bệnh "), k.cast("string")).alias("diagnosis"), F.array_repeat(F.lit("ho"), (k % 8).cast("int")).alias("symptoms"), F.array_repeat(F.lit("thuốc"), (k % 5).cast("int")).alias("drugs"))
    made = compose.article_inputs(rows, ["ALT", "AST", "CRP", "WBC", "HbA1c", "Ure"], ["a1", "a2"], ["x1", "x2"], ["không {tc}"], ["gia đình"], ["tiền sử"], ["{d} là gì", "vì sao {d}", "khi nào", "điều trị {d}", "phòng {d}"], 6)
    rows = made.join(rows, "id")
    asked = F.size("symptoms") + F.size("drugs") + 1
    got = counted(
        rows, capped=F.size("required").between(F.least(asked, F.lit(14)), F.least(asked + 5, F.lit(14))),
        diagnosed=(F.size("required") == 14) | F.exists("required", lambda x: (x["type"] == "CHAN_DOAN") & (x["text"] == F.col("diagnosis"))), mentioned=F.size("mentioned").between(2, 4),
        titled=(F.size(F.array_distinct("titles")) == 4) & F.exists("titles", lambda t: F.contains(t, F.col("diagnosis"))), noisy=F.col("n_glue").between(1, 4) & F.col("n_mask").between(0, 2), said=F.size("context"),
    )
    return got.select("n", "capped", "diagnosed", "mentioned", "titled", "noisy", (F.col("said") / F.col("n")).between(1.35, 1.7).alias("context"))


@query("""SELECT 'accepted' AS what, o_orderkey % 4 AS round, count(*) AS n FROM orders WHERE o_orderkey % 4 < 3 GROUP BY 2
UNION ALL SELECT 'short', r, count(*) FROM orders, (SELECT unnest(range(3)) AS r) WHERE o_orderkey % 4 > r GROUP BY 2""")
def retry_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs whose replies are good from round 0, 1 or 2 on, or never; the stand-in model grows with its temperature and the rounds that it has seen."""
    rows, seen = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), []

    def model(asked: DataFrame, heat: float) -> DataFrame:
        seen.append(heat)
        return asked.withColumn("reply", F.when(F.col("id") % 4 < len(seen), "a long reply").otherwise("?"))

    good, bad = compose.with_retries(rows, model, lambda d: d.withColumn("reason", F.when(F.length("reply") < 5, "short")))
    return good.groupBy("round").agg(F.count(F.lit(1)).alias("n")).select(F.lit("accepted").alias("what"), F.col("round").cast("bigint").alias("round"), "n").unionByName(bad.select(F.col("reason").alias("what"), F.col("round").cast("bigint").alias("round"), "n"))


@query("SELECT user_id AS seq, count(*) AS n, count(*) AS kept FROM events GROUP BY 1")
def label_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types renamed and back again are as they were; others are O."""
    rows = event_labels(spark, sf_dir).groupBy("seq").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("l"))
    there = labels.renamed(F.col("l"), {"A": "X"})
    back = labels.renamed(there, {"X": "A"})
    same = F.zip_with("l", back, lambda a, b: F.when(F.endswith(a, F.lit("A")), a == b).otherwise(b == "O"))
    return rows.select("seq", F.size("l").cast("bigint").alias("n"), F.size(F.filter(same, lambda x: x)).cast("bigint").alias("kept"))


NAMES = [n for n in QUERIES if n not in _BEFORE]
