"""Registered queries of the span engine, each with the SQL it is held against.

The tables hold invented prose and a star schema, so the domain's texts and spans are derived from them, alike in both engines:
notes and prescriptions from orders, spans from order lines, label sequences from events, replies from conversations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions import words
from spanloom.operators import anchor, drugs, gates, generate, knowledge, labels, rules, segment, spans, verify
from spanloom.plans import extract
from spanloom.sources import tables, work

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------------------------------------------------------------
# derived views

HEAD, MARK, TAIL = "Kết quả chung", "2.  Tiền sử bệnh hiện tại", "Bệnh nhân ổn. Hẹn tái khám; uống thuốc."
LINE_KEY = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(F.lit("- part "), F.col("l_partkey").cast("string"), F.lit(": "), F.col("l_quantity").cast("int").cast("string"), F.lit(" mmol/l"))
    # few bytes but much work a row: by a number of its own, the shuffle isn't coalesced to the bytes
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), *LINE_KEY).repartition(parts, "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*LINE_KEY, item.alias("line")))).alias("x"))
    odd = F.transform(F.filter("x", lambda i: i["l_linenumber"] % 2 == 1), lambda i: i["line"])
    even = F.transform(F.filter("x", lambda i: i["l_linenumber"] % 2 == 0), lambda i: i["line"])
    return rows.select("doc_id", F.array_join(F.concat(F.array(F.lit(HEAD)), odd, F.array(F.lit(MARK)), even, F.array(F.lit(TAIL))), "\n").alias("text"))


NOTE_SQL = f"""
items AS (
  SELECT l_orderkey AS doc_id, l_linenumber % 2 AS odd, l_linenumber, l_partkey, l_suppkey, l_quantity,
    '- part ' || CAST(l_partkey AS VARCHAR) || ': ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' mmol/l' AS line FROM lineitem),
notes AS (
  SELECT doc_id, '{HEAD}' || chr(10)
    || coalesce(string_agg(line || chr(10), '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) FILTER (odd = 1), '')
    || '{MARK}' || chr(10)
    || coalesce(string_agg(line || chr(10), '' ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) FILTER (odd = 0), '')
    || '{TAIL}' AS text FROM items GROUP BY doc_id),
split_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM notes),
lines AS (
  SELECT doc_id, k, line, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
  FROM split_lines)"""

SOURCE = {"A": "rule", "N": "llm", "R": "encoder+kb"}
KIND = {"O": "CHẨN_ĐOÁN", "F": "TRIỆU_CHỨNG"}


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of order lines: (doc_id, start, end, type, source, heading, score, and the line key as tie-break)."""
    lines = table(spark, sf_dir, "lineitem")
    source = F.create_map(*[F.lit(x) for kv in SOURCE.items() for x in kv])
    kind = F.create_map(*[F.lit(x) for kv in KIND.items() for x in kv])
    return lines.select(
        F.col("l_orderkey").alias("doc_id"),
        (F.col("l_linenumber") * 7).cast("bigint").alias("start"),
        (F.col("l_linenumber") * 7 + F.col("l_quantity").cast("int")).cast("bigint").alias("end"),
        kind[F.col("l_linestatus")].alias("type"),
        source[F.col("l_returnflag")].alias("source"),
        F.when(F.col("l_suppkey") % 3 == 0, "Chẩn đoán ban đầu").when(F.col("l_suppkey") % 3 == 1, "Triệu chứng hiện tại").alias("heading"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("score"),
        F.col("l_partkey").alias("k1"),
        F.col("l_suppkey").alias("k2"),
    )


SPAN_SQL = """
spans AS (
  SELECT l_orderkey AS doc_id, CAST(l_linenumber * 7 AS BIGINT) AS s, CAST(l_linenumber * 7 + CAST(l_quantity AS INTEGER) AS BIGINT) AS e,
    CASE l_linestatus WHEN 'O' THEN 'CHẨN_ĐOÁN' WHEN 'F' THEN 'TRIỆU_CHỨNG' END AS type,
    CASE l_returnflag WHEN 'A' THEN 'rule' WHEN 'N' THEN 'llm' WHEN 'R' THEN 'encoder+kb' END AS source,
    CASE l_suppkey % 3 WHEN 0 THEN 'CHẨN_ĐOÁN' WHEN 1 THEN 'TRIỆU_CHỨNG' END AS prior,
    CAST(round(l_discount * 100) AS BIGINT) AS score, l_partkey AS k1, l_suppkey AS k2 FROM lineitem),
weighted AS (
  SELECT doc_id, s, e, type, source, k1, k2, CASE source WHEN 'rule' THEN 100 WHEN 'llm' THEN 70 ELSE 60 END
    + CASE WHEN prior IS NULL THEN 0 WHEN prior = type THEN 15 ELSE -30 END AS score FROM spans),
places AS (SELECT doc_id, s, e, count(DISTINCT source) >= 2 AND count(DISTINCT type) = 1 AS agree FROM spans GROUP BY ALL),
agreed AS (SELECT w.* EXCLUDE (score), CAST(w.score + CASE WHEN p.agree THEN 20 ELSE 0 END AS BIGINT) AS score FROM weighted w JOIN places p USING (doc_id, s, e)),
unbeaten AS (
  SELECT * FROM agreed a WHERE source = 'rule' OR NOT EXISTS (
    SELECT 1 FROM agreed b WHERE b.source = 'rule' AND a.doc_id = b.doc_id AND a.s < b.e AND b.s < a.e))"""

SIGNS = {"click": "B-A", "view": "I-A", "purchase": "B-B", "signup": "I-B"}


def event_labels(spark: SparkSession, sf_dir: str, changed: bool = False) -> DataFrame:
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    signs = F.create_map(*[F.lit(x) for kv in SIGNS.items() for x in kv])
    kind = F.when(F.lit(changed) & (F.col("event_id") % 10 == 0), "error").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), (F.row_number().over(order) - 1).cast("bigint").alias("pos"), F.coalesce(F.try_element_at(signs, kind), F.lit("O")).alias("label"))


def _bio_sql(name: str, kind: str, join_other: bool) -> str:
    other = "" if join_other else " OR t <> lag(t) OVER w"
    return f"""
{name}_l AS (
  SELECT user_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
    CASE {kind} WHEN 'click' THEN 'B-A' WHEN 'view' THEN 'I-A' WHEN 'purchase' THEN 'B-B' WHEN 'signup' THEN 'I-B' ELSE 'O' END AS l FROM events),
{name}_n AS (
  SELECT seq, pos, l, t, l[1] = 'B' OR (l[1] = 'I' AND (coalesce(lag(l) OVER w, 'O') = 'O'{other})) AS new
  FROM (SELECT *, substr(l, 3) AS t FROM {name}_l) WINDOW w AS (PARTITION BY seq ORDER BY pos)),
{name} AS (
  SELECT seq, arg_min(t, pos) AS type, min(pos) AS first, max(pos) AS last FROM (
    SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY seq ORDER BY pos) AS k FROM {name}_n) WHERE l <> 'O' GROUP BY seq, k)"""


CHANGED = "CASE WHEN event_id % 10 = 0 THEN 'error' ELSE event_type END"

# ---------------------------------------------------------------------------------------------------------------------
# text


@query("""
WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)
SELECT doc_id, CAST(k - 1 AS BIGINT) AS line_no, line,
  CAST(coalesce(sum(length(line) + 1) OVER w, 0) AS BIGINT) AS "start", CAST(coalesce(sum(length(line) + 1) OVER w, 0) + length(line) AS BIGINT) AS "end"
FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def doc_lines_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("line_no", "p"))
    return docs.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), F.col("p.text").alias("line"), "p.start", "p.end")


_SENTENCES = r"""
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
lo AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM l),
p AS (SELECT doc_id, k, o, unnest(x) AS piece, generate_subscripts(x, 1) AS j FROM (
  SELECT *, list_filter(regexp_extract_all(line, '(?s).*?(?:[.;!?]+(?:\s+|$)|$)'), lambda z: z <> '') AS x FROM lo)),
po AS (SELECT *, o + coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p)"""


@query(f"WITH {_SENTENCES} SELECT doc_id, rtrim(ltrim(piece)) AS sentence, CAST(b + length(piece) - length(ltrim(piece)) AS BIGINT) AS \"start\" FROM po WHERE length(trim(piece)) >= 2")
def doc_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.flatten(F.transform(T.lines(F.col("text")), lambda x: T.sentences(x["text"], x["start"])))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.transform(cut, T.trimmed)).alias("s"))
    return rows.select("doc_id", F.col("s.text").alias("sentence"), "s.start").filter(F.length("sentence") >= 2)


@query(rf"""
WITH {_SENTENCES},
long AS (SELECT doc_id, k, j, b, regexp_replace(piece, '\s+$', '') AS s FROM (SELECT doc_id, k, j, piece, b FROM po) WHERE len(regexp_extract_all(piece, '\S+')) > 40),
q AS (SELECT doc_id, k, j, b, unnest(x) AS c, generate_subscripts(x, 1) AS m FROM (SELECT *, list_filter(regexp_extract_all(s, '(?s).*?(?:,\s+|$)'), lambda z: z <> '') AS x FROM long)),
r AS (SELECT doc_id, c, b + coalesce(sum(length(c)) OVER (PARTITION BY doc_id, k, j ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM q)
SELECT doc_id, rtrim(ltrim(c)) AS clause, CAST(a + length(c) - length(ltrim(c)) AS BIGINT) AS "start" FROM r WHERE length(trim(c)) >= 2""")
def doc_clauses_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.flatten(F.transform(T.lines(F.col("text")), lambda x: T.sentences(x["text"], x["start"])))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(cut).alias("s")).filter(F.size(F.regexp_extract_all("s.text", F.lit(r"\S+"), F.lit(0))) > 40)
    parts = T.clauses(F.regexp_replace("s.text", r"\s+$", ""), F.col("s.start"))
    return rows.select("doc_id", F.explode(F.transform(parts, T.trimmed)).alias("c")).select("doc_id", F.col("c.text").alias("clause"), "c.start").filter(F.length("clause") >= 2)


@query(r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\S+\s*')) AS t, generate_subscripts(regexp_extract_all(text, '\S+\s*'), 1) AS k,
  length(text) - length(regexp_replace(text, '^\s+', '')) AS lead FROM documents),
o AS (SELECT *, lead + coalesce(sum(length(t)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w)
SELECT doc_id, regexp_replace(t, '\s+$', '') AS word, CAST(s AS BIGINT) AS "start", CAST(s + length(regexp_replace(t, '\s+$', '')) AS BIGINT) AS "end" FROM o""")
def doc_words_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return words.word_rows(table(spark, sf_dir, "documents")).withColumnRenamed("text", "word")


@query(r"""
WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\S+')) AS t FROM documents),
c AS (SELECT doc_id, rtrim(ltrim(t, ' .,;:!?()[]{}"''-–—•·*”“’‘'), ' .,;:!?()[]{}"''-–—•·*”“’‘') AS core FROM w)
SELECT core, count(*) AS n FROM c WHERE core <> '' GROUP BY core""")
def boundary_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = words.word_rows(table(spark, sf_dir, "documents"))
    return rows.select(T.without_edges(F.struct("text", "start", "end")).alias("c")).filter("c is not null").groupBy(F.col("c.text").alias("core")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace('# ' || text || ' <think>x' || chr(10) || 'y</think>', '(?s)<think>.*?</think>', '', 'g'), '\*\*(.+?)\*\*', '\1', 'g'), '(?m)^#{1,4}\s+', '', 'g'), ' ' || chr(10)) AS text
FROM documents""")
def reply_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("# "), "text", F.lit(" <think>x\ny</think>"))
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_reply(raw).alias("text"))


# ---------------------------------------------------------------------------------------------------------------------
# units and rules


@query(rf"""
WITH {NOTE_SQL},
marked AS (SELECT *, regexp_matches(line, '^[ \t]*[-•*]\s+\S') AS bullet, line IN ('{HEAD}', '{MARK}') AS head FROM lines),
headed AS (SELECT *, last_value(CASE WHEN head THEN regexp_replace(line, '^\d+\.\s*', '') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY k) AS heading,
  min(CASE WHEN line = '{MARK}' THEN s END) OVER (PARTITION BY doc_id) AS cut FROM marked),
b AS (SELECT doc_id, substr(line, 3) AS text, s + 2 AS s, heading, cut, TRUE AS is_bullet FROM headed WHERE bullet),
q AS (SELECT doc_id, s, heading, cut, unnest(x) AS piece, generate_subscripts(x, 1) AS j FROM (
  SELECT *, list_filter(regexp_extract_all(line, '(?s).*?(?:[.;!?]+(?:\s+|$)|$)'), lambda z: z <> '') AS x FROM headed WHERE NOT bullet AND NOT head)),
t AS (SELECT doc_id, trim(piece) AS text, s + coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, s ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, heading, cut, FALSE AS is_bullet FROM q),
u AS (SELECT * FROM b UNION ALL SELECT * FROM t)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS BIGINT) AS unit, text, CAST(s AS BIGINT) AS "start", CAST(s + length(text) AS BIGINT) AS "end",
  heading, CASE WHEN s >= cut THEN 'clinical' ELSE 'advice' END AS zone, is_bullet FROM u""")
def note_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment.segment(notes(spark, sf_dir))


@query(rf"""
WITH {NOTE_SQL},
v AS (SELECT *, strpos(line, ': ') AS c FROM lines WHERE line LIKE '- part %')
SELECT doc_id, 'TÊN_XÉT_NGHIỆM' AS kind, substr(line, 3, c - 3) AS text, s + 2 AS "start", CAST(s + c - 1 AS BIGINT) AS "end" FROM v
UNION ALL SELECT doc_id, 'KẾT_QUẢ_XÉT_NGHIỆM', substr(line, c + 2), CAST(s + c + 1 AS BIGINT), CAST(s + length(line) AS BIGINT) FROM v""")
def note_lab_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.lab_pairs(notes(spark, sf_dir))


_RX = """
rx AS (SELECT p_partkey AS doc_id, 'Take ' || p_name || ' ' || CAST(p_size AS VARCHAR) || CASE WHEN p_size % 2 = 0 THEN ' mg daily' ELSE ' mg/l daily' END AS text FROM part),
hit AS (SELECT p_partkey AS doc_id, p_name AS text, 5 AS s, 5 + length(p_name) AS e FROM part WHERE p_size % 5 <> 0)"""


def prescriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    dose = F.when(F.col("p_size") % 2 == 0, " mg daily").otherwise(" mg/l daily")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("Take "), "p_name", F.lit(" "), F.col("p_size").cast("string"), dose).alias("text"), "p_name", "p_size")


@query(f"""WITH {_RX}, names AS (SELECT DISTINCT lower(p_name) AS n FROM part WHERE p_size % 5 <> 0)
SELECT p_partkey AS doc_id, p_name AS text, CAST(5 AS BIGINT) AS "start", CAST(5 + length(p_name) AS BIGINT) AS "end", CAST(len(string_split(p_name, ' ')) AS BIGINT) AS n
FROM part JOIN names ON lower(p_name) = n""")
def ngram_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rx = prescriptions(spark, sf_dir)
    return rules.names_longest(rx.select("doc_id", "text"), rx.filter("p_size % 5 <> 0").select(F.col("p_name").alias("name")))


@query("""
SELECT p_partkey AS doc_id, p_name || CASE WHEN p_size % 2 = 0 THEN ' ' || CAST(p_size AS VARCHAR) || ' mg' ELSE '' END AS text, CAST(5 AS BIGINT) AS "start",
  CAST(5 + length(p_name) + CASE WHEN p_size % 2 = 0 THEN 4 + length(CAST(p_size AS VARCHAR)) ELSE 0 END AS BIGINT) AS "end", p_size % 2 = 0 AS has_strength FROM part""")
def strength_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    rx = prescriptions(spark, sf_dir)
    found = rules.names_longest(rx.select("doc_id", "text"), rx.select(F.col("p_name").alias("name")))
    return rules.with_strength(found, rx.select("doc_id", "text"))


_REPLY_LINES = "l AS (SELECT conv_id AS doc_id, turn, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM conversations WHERE text <> '')"


@query(f"""
WITH {_REPLY_LINES}, r AS (SELECT doc_id, turn % 4 AS m, row_number() OVER (PARTITION BY doc_id ORDER BY turn, k) - 1 AS line, trim(t) AS t FROM l)
SELECT doc_id, line, CASE m WHEN 0 THEN 'TRIỆU_CHỨNG' WHEN 1 THEN 'THUỐC' ELSE 'KẾT_QUẢ_XÉT_NGHIỆM' END AS kind, t AS text FROM r WHERE m <> 2 AND t <> ''""")
def reply_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("text <> ''")
    code = F.when(F.col("turn") % 4 == 0, "1. tc : ").when(F.col("turn") % 4 == 1, "TH|").when(F.col("turn") % 4 == 2, "zz|").otherwise("KQ | ")
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(code, x))
    replies = rows.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("turn", lines.alias("l")))), lambda x: x["l"])), "\n").alias("reply"))
    return rules.parse_replies(replies)


@query(r"""
WITH p AS (SELECT item_id, ' ' || trim(regexp_replace(text, '\s', ' ', 'g')) || ' ' AS phrase FROM benchmark WHERE trim(regexp_replace(text, '\s', ' ', 'g')) <> ''),
c AS (SELECT DISTINCT doc_id, ' ' || regexp_replace(text, '\s', ' ', 'g') || ' ' AS t FROM documents),
h AS (SELECT doc_id, item_id, phrase, t FROM c JOIN p ON contains(t, phrase))
SELECT DISTINCT doc_id, item_id, CAST(i AS BIGINT) AS "start" FROM (SELECT *, unnest(range(length(t))) AS i FROM h) WHERE substr(t, i + 1, length(phrase)) = phrase""")
def phrase_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = F.regexp_replace("text", r"\s", " ")
    asked = table(spark, sf_dir, "benchmark").select("item_id", F.trim(flat).alias("phrase"))
    docs = table(spark, sf_dir, "documents").select("doc_id", flat.alias("text"))
    return rules.occurrences(docs, asked).select("doc_id", "item_id", "start").distinct()


# ---------------------------------------------------------------------------------------------------------------------
# spans


@query(f"WITH {SPAN_SQL} SELECT doc_id, s AS \"start\", e AS \"end\", type, source, score, k1, k2 FROM agreed")
def span_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.with_consensus(spans.with_priors(line_spans(spark, sf_dir))).select("doc_id", "start", "end", "type", "source", "score", "k1", "k2")


@query(f"WITH {SPAN_SQL} SELECT doc_id, s AS \"start\", e AS \"end\", type, source, score, k1, k2 FROM unbeaten")
def interval_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spans.without_beaten(spans.with_consensus(spans.with_priors(line_spans(spark, sf_dir))))
    return got.select("doc_id", "start", "end", "type", "source", "score", "k1", "k2")


def _chains(source: str) -> str:
    return f"""
chains AS (
  SELECT doc_id, e, score AS total FROM {source} WHERE score > 0
  UNION SELECT c.doc_id, n.e, c.total + n.score FROM chains c JOIN {source} n ON n.doc_id = c.doc_id AND n.s >= c.e WHERE n.score > 0)
SELECT doc_id, CAST(max(total) AS BIGINT) AS best FROM chains GROUP BY doc_id"""


@query(f"WITH RECURSIVE {SPAN_SQL}, {_chains('spans')}")
def best_disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.best_disjoint(line_spans(spark, sf_dir), "start", "k1", "k2").groupBy("doc_id").agg(F.sum("score").alias("best"))


@query(f"WITH RECURSIVE {SPAN_SQL}, {_chains('unbeaten')}")
def merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.merge(line_spans(spark, sf_dir), "start", "k1", "k2").groupBy("doc_id").agg(F.sum("score").alias("best"))


@query(f"""WITH {SPAN_SQL}, n AS (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY s, e, k1, k2) AS next_start FROM spans)
SELECT doc_id, count(*) AS n FROM n WHERE next_start < e GROUP BY doc_id""")
def overlap_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.violations(line_spans(spark, sf_dir), "k1", "k2").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SPAN_SQL} SELECT doc_id, s AS "start", e AS "end", type, min(k1) AS k1 FROM spans GROUP BY ALL""")
def dedup_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.first_of_each(line_spans(spark, sf_dir), ["doc_id", "start", "end", "type"], "k1", "k2").select("doc_id", "start", "end", "type", "k1")


@query(f"""WITH {SPAN_SQL}, c AS (SELECT type, source, count(*) AS n, CAST(sum(score) AS BIGINT) AS score FROM spans GROUP BY ROLLUP (type, source))
SELECT coalesce(type, 'all') AS type, coalesce(source, 'all') AS source, n, score, round(CAST(n AS DOUBLE) / max(n) OVER (), 6) AS share FROM c""")
def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = line_spans(spark, sf_dir).rollup("type", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))
    return c.select(F.coalesce("type", F.lit("all")).alias("type"), F.coalesce("source", F.lit("all")).alias("source"), "n", "score", F.round(F.col("n") / F.max("n").over(W.partitionBy()), 6).alias("share"))


@query(f"""WITH {NOTE_SQL}, {SPAN_SQL.strip()},
w AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\S+\\s*')) AS t, generate_subscripts(regexp_extract_all(text, '\\S+\\s*'), 1) AS k FROM notes),
o AS (SELECT doc_id, coalesce(sum(length(t)) OVER x, 0) AS a, coalesce(sum(length(t)) OVER x, 0) + length(rtrim(t, ' ' || chr(10))) AS b
  FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, count(*) AS n_words, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = o.doc_id AND s.s < o.b AND o.a < s.e) THEN 1 ELSE 0 END) AS BIGINT) AS n_covered
FROM o GROUP BY doc_id""")
def word_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.covered_words(words.word_rows(notes(spark, sf_dir)), line_spans(spark, sf_dir))


_GATED = """
p AS (SELECT p_partkey AS doc_id, p_partkey % 41 AS m FROM part),
b AS (SELECT doc_id, m, repeat('word gap ', CAST(CASE WHEN m = 3 THEN 60 WHEN m = 5 THEN 500 ELSE 190 END AS BIGINT)) AS body FROM p),
t AS (SELECT doc_id, m, CASE WHEN m = 1 THEN '' ELSE body || CASE WHEN m = 7 THEN 'end' ELSE 'bait end' END END AS text FROM b)"""


@query(f"""WITH {_GATED}
SELECT CASE WHEN m = 1 THEN 'C2' WHEN m = 9 THEN 'C1' WHEN m IN (11, 3, 5) THEN 'C2' WHEN m = 13 THEN 'C3' WHEN m = 15 THEN 'C5' WHEN m = 17 THEN 'C6' WHEN m = 19 THEN 'C7' WHEN m = 7 THEN 'C8' WHEN m = 21 THEN 'C9' ELSE 'pass' END AS reason,
  count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 9) AS share FROM t GROUP BY 1""")
def gate_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that break one gate each, by the rest of their part's key: 380 words, of which 50 or so are spans."""
    m = (F.col("p_partkey") % 41).cast("int")
    times = F.when(m == 3, 60).when(m == 5, 500).otherwise(190)
    body = F.concat(F.repeat(F.lit("word gap "), times), F.when(m == 7, "end").otherwise("bait end"))
    part = work.spread(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")
    docs = part.select(F.col("p_partkey").alias("doc_id"), m.alias("m"), F.when(m == 1, "").when(m == 19, F.repeat(F.lit("word g "), F.lit(190))).otherwise(body).alias("text"))
    step = F.when(F.col("m") == 19, 7).otherwise(9)
    kind = lambda i: F.when((F.col("m") == 15) & (i == 2), "nothing").when((i % 2 == 0) | (F.col("m") == 21), "THUỐC").otherwise("CHẨN_ĐOÁN")
    wide = F.when(F.col("m") == 11, 20).otherwise(50)
    start = lambda i: (i * step * 3 + F.when((F.col("m") == 13) & (i == 5), -step * 3).otherwise(0)).cast("bigint")
    said = lambda i: F.when((F.col("m") == 9) & (i == 3), "gap ").when((F.col("m") == 17) & (i == 4), "word").otherwise("word")
    items = F.transform(F.sequence(F.lit(0), wide - 1), lambda i: F.struct(said(i).alias("text"), kind(i).alias("type"), start(i).alias("start"), (start(i) + 4).alias("end")))
    docs = docs.withColumn("entities", F.when((F.col("m") == 1) | (F.col("m") == 3), F.slice(items, 1, 1)).otherwise(items))
    marked = F.transform("entities", lambda x, i: F.when((F.col("m") == 17) & (i == 4), F.struct(F.lit("gap").alias("text"), x["type"].alias("type"), (x["start"] + 5).alias("start"), (x["start"] + 8).alias("end"))).otherwise(x))
    docs = docs.withColumn("entities", F.when(F.col("m") == 1, F.slice(items, 1, 0)).otherwise(marked))
    got = gates.first_failure(docs, ["GAP"], ["bait"], {"THUỐC": 0.5, "CHẨN_ĐOÁN": 0.5})
    return gates.rejected(got).withColumn("share", F.round("share", 9))


@query(f"""WITH {SPAN_SQL}
SELECT doc_id, count(*) AS n, string_agg(type || ':' || CAST(s AS VARCHAR) || '-' || CAST(e AS VARCHAR) || '=' || printf('%06d %06d', k1, k2), ' ' ORDER BY s, e, k1, k2) AS entities FROM spans GROUP BY doc_id""")
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.entities(line_spans(spark, sf_dir).withColumn("text", F.format_string("%06d %06d", "k1", "k2")), "k1", "k2")
    said = lambda e: F.concat(e["type"], F.lit(":"), e["position"][0].cast("string"), F.lit("-"), e["position"][1].cast("string"), F.lit("="), e["text"])
    return rows.select("doc_id", F.size("entities").cast("bigint").alias("n"), F.array_join(F.transform("entities", said), " ").alias("entities"))


# ---------------------------------------------------------------------------------------------------------------------
# labels, vectors, sampling


@query(f"WITH {_bio_sql('g', 'event_type', True)} SELECT * FROM g")
def bio_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.bio_spans(event_labels(spark, sf_dir))


@query(f"""WITH {_bio_sql('g', 'event_type', False)}, {_bio_sql('f', CHANGED, False)},
j AS (SELECT coalesce(g.type, f.type) AS type, g.seq IS NOT NULL AS ing, f.seq IS NOT NULL AS inf FROM g FULL JOIN f ON g.seq = f.seq AND g.first = f.first AND g.last = f.last AND g.type = f.type),
c AS (SELECT coalesce(type, 'micro') AS label, CAST(sum(CASE WHEN ing AND inf THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN NOT ing THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN NOT inf THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM j GROUP BY ROLLUP (type))
SELECT label, tp, fp, fn, tp + fn AS support, round(tp / (tp + fp), 9) AS "precision", round(tp / (tp + fn), 9) AS recall, round(2 * tp / (2 * tp + fp + fn), 9) AS f1 FROM c""")
def bio_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, found = (labels.bio_spans(event_labels(spark, sf_dir, c), join_other_type=False) for c in (False, True))
    got = labels.scores(gold, found, ["seq", "first", "last"])
    return got.select("label", "tp", "fp", "fn", "support", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("""
WITH w AS (SELECT vec_id, embedding, label FROM embeddings), q AS (SELECT * FROM w WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id, w.label = 0 AS r, list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(w.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(w.embedding AS DOUBLE[]), CAST(w.embedding AS DOUBLE[])) * list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) AS c
  FROM q JOIN w ON q.vec_id <> w.vec_id),
t AS (SELECT vec_id, max(c) FILTER (r) AS r_top, max(c) FILTER (NOT r) AS o_top FROM s GROUP BY vec_id)
SELECT vec_id, round(r_top, 6) AS r_top, round(o_top, 6) AS o_top, CASE WHEN r_top > 0.3 AND r_top >= o_top THEN 'TRIỆU_CHỨNG' WHEN o_top >= 0.35 THEN 'CHẨN_ĐOÁN' END AS type FROM t""")
def cosine_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spanloom.operators.nearest import nearest_by_class

    rows = table(spark, sf_dir, "embeddings")
    got = nearest_by_class(rows.filter("vec_id % 20 = 0"), rows, "vec_id", "embedding", F.col("label") == 0)
    kind = F.when((F.col("r_top") > 0.3) & (F.col("r_top") >= F.col("o_top")), "TRIỆU_CHỨNG").when(F.col("o_top") >= 0.35, "CHẨN_ĐOÁN")
    return got.select("vec_id", F.round("r_top", 6).alias("r_top"), F.round("o_top", 6).alias("o_top"), kind.alias("type"))


@query("""
WITH n AS (SELECT DISTINCT lower(p_name) AS name FROM part),
j AS (SELECT a.name, b.name AS other, levenshtein(a.name, b.name) AS d FROM n a JOIN n b ON a.name <> b.name AND abs(length(a.name) - length(b.name)) < 4)
SELECT name, min(d) AS distance, arg_min(other, (d, other)) AS nearest FROM j GROUP BY name""")
def fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.nearest_names(table(spark, sf_dir, "part").select(F.lower("p_name").alias("name")))


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY CAST('0x' || substr(md5('7:' || doc_id), 1, 15) AS BIGINT) / 1152921504606846976.0, doc_id) <= 30")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.per_stratum(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", 30, 7, "doc_id")


@query(f"""WITH {NOTE_SQL}, {SPAN_SQL.strip()}
SELECT s.doc_id, s.s + length(d.text) + 2 AS "start", s.e + length(d.text) + 2 AS "end", length(d.text) + 2 + length(n.text) AS n_chars
FROM spans s JOIN notes n USING (doc_id) JOIN documents d ON d.doc_id = s.doc_id""")
def concat_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("lead"))
    own = line_spans(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = notes(spark, sf_dir).join(lead, "doc_id").join(own, "doc_id").select("doc_id", generate.joined(F.col("lead"), F.col("text"), F.col("spans")).alias("x"))
    return rows.select("doc_id", F.length("x.text").cast("bigint").alias("n_chars"), F.explode("x.spans").alias("s")).select("doc_id", "s.start", "s.end", "n_chars")


@query(f"""WITH {SPAN_SQL}, r AS (SELECT DISTINCT doc_id, s, e, type FROM spans WHERE source = 'rule'), l AS (SELECT DISTINCT doc_id, s, e, type FROM spans WHERE source = 'llm')
SELECT 'both' AS what, count(*) AS n FROM (SELECT * FROM r INTERSECT SELECT * FROM l)
UNION ALL SELECT 'first', count(*) FROM (SELECT * FROM r EXCEPT SELECT * FROM l) UNION ALL SELECT 'second', count(*) FROM (SELECT * FROM l EXCEPT SELECT * FROM r)""")
def source_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = line_spans(spark, sf_dir)
    r, m = (s.filter(F.col("source") == x).select("doc_id", "start", "end", "type") for x in ("rule", "llm"))
    count = lambda d, what: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    return count(r.intersect(m), "both").unionByName(count(r.subtract(m), "first")).unionByName(count(m.subtract(r), "second"))


@query("""
WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, CAST(k AS BIGINT) AS session, count(*) AS n FROM s GROUP BY ALL""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    new = F.when(F.col("ts") - F.lag("ts").over(order) <= F.expr("interval 6 hours"), 0).otherwise(1)
    rows = table(spark, sf_dir, "events").withColumn("new", new).withColumn("session", F.sum("new").over(order))
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------------------------------------------------------------
# names, proposals, labels of tokens


@query("""
WITH p AS (SELECT p_partkey, p_name, p_size, p_size % 2 = 0 AS dosed, string_split(p_name, ' ') AS w FROM part),
known AS (SELECT * FROM p WHERE p_size % 5 <> 0),
dict AS (SELECT DISTINCT lower(p_name) AS n FROM known)
SELECT p_partkey AS doc_id, CASE WHEN d.n IS NOT NULL THEN p_name ELSE w[len(w)] END || CASE WHEN dosed THEN ' ' || CAST(p_size AS VARCHAR) || ' mg' ELSE '' END AS text,
  CAST(CASE WHEN d.n IS NOT NULL THEN 5 ELSE 5 + length(p_name) - length(w[len(w)]) END AS BIGINT) AS "start",
  CAST(5 + length(p_name) + CASE WHEN dosed THEN 4 + length(CAST(p_size AS VARCHAR)) ELSE 0 END AS BIGINT) AS "end", CASE WHEN d.n IS NOT NULL THEN 'dict' ELSE 'rule_strength' END AS source
FROM p LEFT JOIN dict d ON lower(p_name) = d.n WHERE d.n IS NOT NULL OR (dosed AND length(w[len(w)]) >= 3)""")
def drug_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rx = prescriptions(spark, sf_dir)
    known = drugs.dictionary(rx.filter("p_size % 5 <> 0").select(F.col("p_name").alias("name")))
    return drugs.find(rx.select("doc_id", "text"), known).select("doc_id", "text", "start", "end", "source")


@query("""
WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part), n AS (SELECT DISTINCT lower(w[len(w)]) AS name FROM p),
t AS (SELECT p_partkey AS doc_id, list_concat(['Take'], w, ['daily']) AS t FROM p),
g AS (SELECT doc_id, i, t[i] AS core, coalesce(list_sum(list_transform(t[1:i - 1], lambda x: length(x) + 1)), 0) AS s FROM t, range(1, 20) r(i) WHERE i <= len(t)),
h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g JOIN n ON lower(core) = name)
SELECT doc_id, core AS text, CAST(s AS BIGINT) AS "start", CAST(s + length(core) AS BIGINT) AS "end" FROM h WHERE k = 1""")
def core_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rx = table(spark, sf_dir, "part")
    rows = rx.select(F.col("p_partkey").alias("doc_id"), F.concat(F.lit("Take "), "p_name", F.lit(" daily")).alias("text"))
    rows = rows.withColumn("start", F.lit(0).cast("bigint")).withColumn("end", F.length("text").cast("bigint"))
    return anchor.core_in_names(rows, rx.select(F.element_at(F.split("p_name", " "), -1).alias("name")), 1)


@query("""
SELECT p_partkey AS doc_id, p_name AS text, CAST(5 AS BIGINT) AS "start", CAST(5 + length(p_name) AS BIGINT) AS "end" FROM part""")
def span_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    rx = prescriptions(spark, sf_dir)
    last = F.element_at(F.split("p_name", " "), -1)
    at = rx.select("doc_id", last.alias("text"), (5 + F.length("p_name") - F.length(last)).cast("bigint").alias("start"), (5 + F.length("p_name")).cast("bigint").alias("end"))
    return anchor.extended_by_names(at, rx.select("doc_id", "text"), rx.select(F.col("p_name").alias("name")))


@query(rf"""WITH {NOTE_SQL},
v AS (SELECT doc_id, k, s, line, strpos(line, ': ') AS c, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS r FROM lines WHERE line LIKE '- part %'),
cut AS (SELECT doc_id, min(s) AS cut_at FROM lines WHERE line = '{MARK}' GROUP BY doc_id)
SELECT v.doc_id, substr(line, c + 2) AS text, CAST(s + c + 1 AS BIGINT) AS "start", CAST(s + length(line) AS BIGINT) AS "end", 'KẾT_QUẢ_XÉT_NGHIỆM' AS type, CASE WHEN s >= cut_at THEN 'clinical' ELSE 'advice' END AS zone
FROM v JOIN cut USING (doc_id)""")
def verified_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = work.written(segment.segment(notes(spark, sf_dir)))  # read twice
    value, name = F.regexp_extract("text", ": (.*)$", 1), F.regexp_extract("text", r"part (\d+)", 1)
    item = lambda line, kind, text: F.struct(F.lit(line).alias("line"), F.lit(kind).alias("kind"), text.alias("text"))
    said = F.array(item(0, "KẾT_QUẢ_XÉT_NGHIỆM", F.upper(value)), item(1, "TÊN_XÉT_NGHIỆM", name), item(2, "THUỐC", F.lit("không rõ")))
    asked = units.filter("is_bullet").select("doc_id", "unit", F.explode(said).alias("p")).select("doc_id", "unit", "p.*")
    return verify.verified_units(asked, units).select("doc_id", "text", "start", "end", "type", "zone")


@query("""
WITH n AS (SELECT DISTINCT lower(p_name) AS name FROM part WHERE p_size % 5 <> 0),
h AS (SELECT p_partkey AS doc_id, p_name AS text, p_size FROM part JOIN n ON lower(p_name) = name)
SELECT doc_id, text, CAST(5 AS BIGINT) AS "start", CAST(5 + length(text) AS BIGINT) AS "end" FROM h WHERE p_size % 3 <> 0""")
def unlabelled_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rx = prescriptions(spark, sf_dir)
    marked = rx.filter("p_size % 3 = 0").select("doc_id", F.lit(4).cast("bigint").alias("start"), F.lit(6).cast("bigint").alias("end"))
    return knowledge.unlabelled_names(rx.select("doc_id", "text"), marked, rx.filter("p_size % 5 <> 0").select(F.col("p_name").alias("name")))


@query()
def close_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), "p_size")
    asked = names.select(F.concat(F.substring("name", 2, 100), F.lit("x")).alias("text"))
    return verify.close_to_names(asked, names.filter("p_size % 5 <> 0"), verify.DRUG_RATIO)


@query(f"""
WITH {_REPLY_LINES}, r AS (SELECT doc_id, turn, k AS j, CASE WHEN turn % 3 = 0 THEN 'TH' ELSE 'TC' END AS code, trim(t) AS t FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, code ORDER BY turn, j) AS n FROM r WHERE length(t) >= 2)
SELECT doc_id, string_agg(t, ' / ' ORDER BY n) FILTER (code = 'TC' AND n <= 5) AS symptoms, coalesce(string_agg(t, ' / ' ORDER BY n) FILTER (code = 'TH' AND n <= 5), '') AS drugs
FROM k GROUP BY doc_id HAVING count(*) FILTER (code = 'TC') >= 3""")
def reply_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("text <> ''")
    code = F.when(F.col("turn") % 3 == 0, "th |").otherwise("TC| ")
    lines = F.transform(F.split("text", "\n"), lambda x: F.concat(code, F.trim(x)))
    replies = rows.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_join(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("turn", lines.alias("l")))), lambda x: x["l"])), "\n").alias("reply"))
    return verify.scenarios(replies).select("doc_id", F.array_join("symptoms", " / ").alias("symptoms"), F.array_join("drugs", " / ").alias("drugs"))


@query("""
WITH a AS (SELECT l_orderkey * 100 + l_linenumber AS code, l_partkey AS term FROM lineitem), t AS (SELECT DISTINCT CAST(l_orderkey * 100 + l_linenumber AS VARCHAR) AS code FROM lineitem WHERE l_linenumber % 2 = 0
  UNION SELECT DISTINCT substr(CAST(l_orderkey * 100 + l_linenumber AS VARCHAR), 1, 3) FROM lineitem WHERE l_suppkey % 10 = 0)
SELECT coalesce(o.code, u.code) AS code, count(*) AS n FROM a LEFT JOIN t o ON CAST(a.code AS VARCHAR) = o.code LEFT JOIN t u ON substr(CAST(a.code AS VARCHAR), 1, 3) = u.code
WHERE coalesce(o.code, u.code) IS NOT NULL GROUP BY 1""")
def alias_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (F.col("l_orderkey") * 100 + F.col("l_linenumber")).cast("string").alias("code")
    lines = table(spark, sf_dir, "lineitem")
    terms = lines.filter("l_linenumber % 2 = 0").select(code).unionByName(lines.filter("l_suppkey % 10 = 0").select(F.substring(code, 1, 3).alias("code")))
    return knowledge.attach_aliases(lines.select(code, F.col("l_partkey").alias("term")), terms).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_bio_sql('g', 'event_type', True)}
SELECT l.seq, l.pos, coalesce(CASE WHEN l.pos = g.first THEN 'B-' ELSE 'I-' END || g.type, 'O') AS label FROM g_l l LEFT JOIN g ON l.seq = g.seq AND l.pos BETWEEN g.first AND g.last""")
def spans_to_bio(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = event_labels(spark, sf_dir)
    found = labels.bio_spans(tokens).groupBy("seq").agg(F.collect_list(F.struct("first", "last", "type")).alias("spans"))
    rows = tokens.groupBy("seq").agg(F.count(F.lit(1)).cast("int").alias("n")).join(found, "seq", "left")
    painted = labels.span_labels(F.col("n"), F.coalesce("spans", F.array().cast("array<struct<first:bigint,last:bigint,type:string>>")))
    return rows.select("seq", F.posexplode(painted).alias("pos", "label")).select("seq", F.col("pos").cast("bigint").alias("pos"), "label")


@query("""
WITH t AS (SELECT user_id AS seq, event_id AS pos, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(event_id / 3) AS BIGINT) END AS word, length(event_type) AS label FROM events)
SELECT seq, pos, CAST(CASE WHEN word IS NULL OR word = lag(word) OVER (PARTITION BY seq ORDER BY pos) THEN -100 ELSE label END AS BIGINT) AS aligned FROM t""")
def subword_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.when(F.col("event_id") % 7 != 0, F.floor(F.col("event_id") / 3))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("seq"), F.col("event_id").alias("pos"), word.alias("word"), F.length("event_type").alias("label"))
    return labels.subword_labels(rows, "seq", "pos", "word", "label").select("seq", "pos", "aligned")


@query("""
WITH c AS (SELECT user_id AS seq, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id),
p AS (SELECT seq, n, unnest(range(n)) AS pos FROM c), w AS (SELECT seq, n, unnest(range(0, n, 100)) AS s FROM c),
k AS (SELECT p.seq, pos, s, row_number() OVER (PARTITION BY p.seq, pos ORDER BY least(pos - s, least(120, p.n - s) - 1 - (pos - s)) DESC, s) AS r FROM p JOIN w ON p.seq = w.seq AND s <= pos AND pos < s + 120)
SELECT seq, s AS "window", min(pos) AS first, max(pos) AS last, count(*) AS n FROM k WHERE r = 1 GROUP BY seq, s""")
def central_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("seq")).agg(F.count(F.lit(1)).cast("int").alias("m"))
    at = rows.select("seq", F.posexplode(labels.central_window(F.col("m"))).alias("pos", "window"))
    return at.groupBy("seq", F.col("window").cast("bigint").alias("window")).agg(F.min("pos").cast("bigint").alias("first"), F.max("pos").cast("bigint").alias("last"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SPAN_SQL}, c AS (SELECT type, count(*) AS n FROM spans GROUP BY type)
SELECT type, n, round(CAST(n AS DOUBLE) / sum(n) OVER () - CASE type WHEN 'CHẨN_ĐOÁN' THEN 0.25 WHEN 'TRIỆU_CHỨNG' THEN 0.33 END, 9) AS gap, abs(CAST(n AS DOUBLE) / sum(n) OVER () - CASE type WHEN 'CHẨN_ĐOÁN' THEN 0.25 WHEN 'TRIỆU_CHỨNG' THEN 0.33 END) > 0.15 AS off FROM c""")
def type_share_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = spans.share_gaps(line_spans(spark, sf_dir), {"CHẨN_ĐOÁN": 0.25, "TRIỆU_CHỨNG": 0.33})
    return got.select("type", "n", F.round("gap", 9).alias("gap"), "off")


@query(rf"""
WITH {NOTE_SQL},
v AS (SELECT *, strpos(line, ': ') AS c FROM lines WHERE line LIKE '- part %')
SELECT doc_id, 'TÊN_XÉT_NGHIỆM' AS type, substr(line, 3, c - 3) AS text, s + 2 AS "start", CAST(s + c - 1 AS BIGINT) AS "end", 'rule' AS source FROM v
UNION ALL SELECT doc_id, 'KẾT_QUẢ_XÉT_NGHIỆM', substr(line, c + 2), CAST(s + c + 1 AS BIGINT), CAST(s + length(line) AS BIGINT), 'rule' FROM v""")
def extract_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, names = work.written(notes(spark, sf_dir)), table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))
    return extract.finalize(extract.extract(docs, names), docs, names).select("doc_id", "type", "text", "start", "end", "source")
