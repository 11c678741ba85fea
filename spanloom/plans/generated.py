"""Registered queries of exact choices, generated texts and chosen spans. Choices are MD5 tickets, which SQL draws too, so rows are compared and not only conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import choice, compose, generate, merging, models, rules, segmenter, spans, verify
from spanloom.plans import extract, library
from spanloom.plans.catalog import MARK, NOTE_SQL, SPAN_SQL, line_spans, notes, query, table
from spanloom.sources import work


def _tick(seed: int, *parts: str) -> str:
    """SQL of ``choice.ticket``; parts are SQL expressions."""
    return "CAST('0x' || substr(md5('" + f"{seed}'" + "".join(f" || ':' || CAST({p} AS VARCHAR)" for p in parts) + "), 1, 15) AS BIGINT)"


def _die(sides: int | str, seed: int, *parts: str) -> str:
    return f"({_tick(seed, *parts)} % {sides})"


def _list(options) -> str:
    return "[" + ", ".join(f"'{o}'" for o in options) + "]"


def _one(options, seed: int, *parts: str) -> str:
    return f"{_list(options)}[{_die(len(options), seed, *parts)} + 1]"


# ---------------------------------------------------------------------------------------------------------------------
# samples

#: Weights of languages, of which others have 30.
_WEIGHTS = {"en": 120, "de": 40, "fr": 7}
_SAMPLED = """
s AS (SELECT k, w, greatest(1, 200 * w // sum(w) OVER ()) AS q FROM (SELECT lang AS k, {weight} AS w FROM documents GROUP BY lang)),
r AS (SELECT d.doc_id, d.lang, s.q, row_number() OVER (PARTITION BY d.lang ORDER BY {one}, d.doc_id) AS r FROM documents d JOIN s ON d.lang = s.k),
f AS (SELECT doc_id, lang, r <= q AS sure, row_number() OVER (PARTITION BY r <= q ORDER BY {two}, doc_id) AS i FROM r),
n AS (SELECT least(200 - count(*) FILTER (sure), count(*)) AS more FROM f)
SELECT doc_id, lang FROM f, n WHERE sure OR i <= more"""


@query(f"WITH {_SAMPLED.format(weight='CASE lang ' + ' '.join(f'WHEN {k!r} THEN {v}' for k, v in _WEIGHTS.items()) + ' ELSE 30 END', one=_tick(3, 'd.doc_id'), two=_tick(4, 'doc_id'))}")
def weighted_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 documents, by weights of their languages."""
    weights = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _WEIGHTS.items() for x in kv]), F.col("lang")), F.lit(30))
    return choice.weighted_sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", "doc_id", 200, 3, weights)


@query(f"WITH {_SAMPLED.format(weight='count(*)', one=_tick(3, 'd.doc_id'), two=_tick(4, 'doc_id'))}")
def proportional_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 documents, of each language its share."""
    return generate.proportional(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", 200, 3, "doc_id")


# ---------------------------------------------------------------------------------------------------------------------
# results

_SEED = 3
_UNITS = ("mmol/l", "g/l", "%", "mg/dL", "U/l")


def _rounds(x: str) -> str:
    """SQL of ``choice.permuted``'s rounds: halves l and r, moved by turns."""
    l0, r0 = f"(({x}) // b)", f"(({x}) % b)"
    l1 = f"(({l0} + {_tick(_SEED, '0', r0)}) % a)"
    r1 = f"(({r0} + {_tick(_SEED, '1', l1)}) % b)"
    l2 = f"(({l1} + {_tick(_SEED, '2', r1)}) % a)"
    return f"({l2} * b + ({r1} + {_tick(_SEED, '3', l2)}) % b)"


def _value(what: str, *more: str) -> str:
    k = (f"'{what}'", "k", *more)
    t = lambda name, m: _die(m, _SEED, f"'{name}'", *k)
    mark = f"CASE WHEN {t('mark', 10)} < 4 THEN ',' ELSE '.' END"
    return f"(CAST({t('base', 200)} + 1 AS VARCHAR) || CASE {t('digits', 3)} WHEN 0 THEN '' WHEN 1 THEN {mark} || CAST({t('frac', 9)} + 1 AS VARCHAR) ELSE {mark} || lpad(CAST({t('frac', 99)} + 1 AS VARCHAR), 2, '0') END)"


def _measured(what: str, *more: str) -> str:
    return f"({_value(what, *more)} || ' ' || {_one(_UNITS, _SEED, repr(what + 'unit'), 'k', *more)})"


def _t(what: str, m: int, *more: str) -> str:
    return _die(m, _SEED, f"'{what}'", "k", *more)


def _o(options, what: str, *more: str) -> str:
    return _one(options, _SEED, f"'{what}'", "k", *more)


_NAMES = ("WBC", "NEUT% total", "ALT", "AST", "CRP")
_FIRST = "split_part(" + _o(_NAMES, "name", "i") + ", ' ', 1)"


@query(f"""WITH RECURSIVE o AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders),
z AS (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS b FROM o),
p(k, x, n, a, b) AS (SELECT k, {_rounds('place')}, n, a, b FROM z UNION ALL SELECT k, {_rounds('x')}, n, a, b FROM p WHERE x >= n),
g AS (SELECT k, x // greatest(1, n // 10) AS turn FROM p WHERE x < n),
f AS (SELECT k, CASE WHEN turn < 8 THEN {_list(generate.FORMATS)}[turn + 1] ELSE ['number', 'quality', 'trend'][{_t('other', 3)} + 1] END AS format FROM g)
SELECT k AS o_orderkey, format, CASE format
  WHEN 'number' THEN {_measured('number')}
  WHEN 'comma' THEN CAST({_t('whole', 99)} + 1 AS VARCHAR) || ',' || lpad(CAST({_t('part', 99)} + 1 AS VARCHAR), 2, '0') || ' ' || {_o(_UNITS, 'cunit')}
  WHEN 'pressure' THEN CAST({_t('high', 61)} + 100 AS VARCHAR) || '/' || CAST({_t('low', 41)} + 60 AS VARCHAR) || ' mmHg'
  WHEN 'quality' THEN {_o(generate.QUALITIES, 'quality')}
  WHEN 'trend' THEN {_o(generate.TRENDS, 'trend')}
  WHEN 'threshold' THEN {_o([a for a, _ in generate.THRESHOLDS], 'limit')} || {_value('threshold')} || {_o([b for _, b in generate.THRESHOLDS], 'limit')}
  WHEN 'words' THEN {_o(generate.IN_WORDS, 'words')}
  ELSE array_to_string([{_FIRST} || ': ' || {_measured('pair', 'i')} FOR i IN range(1, {_t('pairs', 3)} + 3)], '  ') END AS result
FROM f""")
def generated_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result for every order, a tenth of them in each of the eight formats."""
    return generate.lab_results(table(spark, sf_dir, "orders").select("o_orderkey"), list(_UNITS), _SEED, "o_orderkey", _NAMES)


_DEALT = f"""o AS (SELECT o_orderkey AS k, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders),
z AS (SELECT *, CAST(ceil(sqrt(n)) AS BIGINT) AS a, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS b FROM o),
p(k, x, n, a, b) AS (SELECT k, {_rounds('place')}, n, a, b FROM z UNION ALL SELECT k, {_rounds('x')}, n, a, b FROM p WHERE x >= n)"""


@query(f"""WITH RECURSIVE {_DEALT}, q AS (SELECT p.k, x < floor(n * 0.42) AS alone FROM p WHERE x < n),
l AS (SELECT k, alone, 'Xn ' || o_custkey AS name, k % 200 || ' g/l' AS result, {_t('layout', 6)} + 1 AS y, {_t('trend', 1000)} < 200 AS moves, {_o(generate.LINE_TRENDS, 'which')} AS trend FROM q JOIN o USING (k)),
v AS (SELECT *, CASE WHEN NOT alone THEN result WHEN moves THEN trend END AS value, CASE WHEN alone THEN '' ELSE {_list(a for a, _ in generate.LINE_LAYOUTS)}[y] END AS lead, CASE WHEN alone THEN ' ' ELSE {_list(b for _, b in generate.LINE_LAYOUTS)}[y] END AS gap FROM l)
SELECT k AS o_orderkey, lead || name || coalesce(gap || value, '') AS line, length(lead) AS name_start, value, CASE WHEN value IS NOT NULL THEN length(lead || name || gap) END AS value_start FROM v""")
def generated_lab_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for every order: names with results in six layouts, and 42 in a hundred names alone."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k, F.concat(F.lit("Xn "), F.col("o_custkey").cast("string")).alias("name"), F.concat((k % 200).cast("string"), F.lit(" g/l")).alias("result"))
    return generate.lab_lines(rows, _SEED, "o_orderkey").select("o_orderkey", "line", "name_start", "value", "value_start")


# ---------------------------------------------------------------------------------------------------------------------
# noise and merging

_L = r"[A-Za-zÀ-ỹ]"


#: SQL of ``generate.with_noise`` with seed 5 over d (k, text, z): z is where the last span ends.
_NOISY = rf"""
c AS (SELECT *, string_split(substr(text, z + 6), '') AS c, 1 + {_die(3, 5, "'n_glue'", 'k')} AS g, {_die(3, 5, "'n_mask'", 'k')} AS m FROM d),
s AS (SELECT *, [i FOR i IN range(2, len(c)) IF c[i] = ' ' AND regexp_matches(c[i - 1], '^\p{{L}}$') AND regexp_matches(c[i + 1], '^\p{{L}}$')] AS spots FROM c),
t AS (SELECT *, [x.i FOR x IN list_sort([{{'t': {_tick(5, "'glue'", 'k', 'i')}, 'i': i}} FOR i IN range(1, len(spots) + 1)])[1:g]] AS gone FROM s),
u AS (SELECT k, z, m, substr(text, 1, z + 5) || array_to_string([CASE WHEN list_contains(list_transform(gone, lambda j: spots[j]), i) THEN '' ELSE c[i] END FOR i IN range(1, len(c) + 1)], '') AS text FROM t),
v AS (SELECT *, regexp_extract_all(substr(text, z + 1), '{_L}+|[^A-Za-zÀ-ỹ]+') AS r FROM u),
w AS (SELECT *, [i FOR i IN range(1, len(r) + 1) IF length(r[i]) >= 5 AND regexp_matches(r[i], '^{_L}')] AS spots FROM v),
y AS (SELECT *, [spots[x.i] FOR x IN list_sort([{{'t': {_tick(5, "'mask'", 'k', 'i')}, 'i': i}} FOR i IN range(1, len(spots) + 1)])[1:m]] AS gone FROM w)
SELECT k AS doc_id, substr(text, 1, z) || array_to_string([CASE WHEN list_contains(gone, i) THEN '***' ELSE r[i] END FOR i IN range(1, len(r) + 1)], '') AS noisy FROM y"""


@query("WITH d AS (SELECT doc_id AS k, text, length(split_part(text, chr(10), 1)) AS z FROM documents)," + _NOISY)
def noisy_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one to three spaces glued and none to two words masked behind their first line."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", generate.with_noise(F.col("text"), F.length(F.substring_index("text", "\n", 1)), 5, F.col("doc_id")).alias("noisy"))


@query(f"WITH {NOTE_SQL}, d AS (SELECT doc_id AS k, text, strpos(text, '{MARK}') AS z FROM notes)," + _NOISY)
def noisy_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with noise behind the beginning of their second part."""
    rows = notes(spark, sf_dir)
    return rows.select("doc_id", generate.with_noise(F.col("text"), F.instr("text", MARK), 5, F.col("doc_id")).alias("noisy"))


_BLOCKS = """
b AS (SELECT p_partkey AS id, 'Mục: ' || p_name || chr(10) || repeat('dòng ', (p_partkey % 9) * 70) AS text,
  CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE p_name END AS said, length(p_name) AS m, p_partkey % 13 = 0 AS twice FROM part),
q AS (SELECT doc_id AS id, text, row_number() OVER (ORDER BY doc_id) - 1 AS j, count(*) OVER () AS size FROM documents WHERE length(text) BETWEEN 1500 AND 4000)"""


@query(f"""WITH RECURSIVE {_BLOCKS},
n AS (SELECT *, row_number() OVER (ORDER BY {_tick(9, 'id')}, id) <= floor(count(*) OVER () * 0.6) AS tried FROM b),
t AS (SELECT id, length(text) AS n, twice, row_number() OVER (ORDER BY id) AS i FROM n WHERE tried AND id % 11 <> 0),
c(i, cursor, id, j) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) UNION ALL
  SELECT t.i, CASE WHEN ok THEN cursor + 1 ELSE cursor END, t.id, CASE WHEN ok THEN q.j END FROM c JOIN t ON t.i = c.i + 1 JOIN q ON q.j = cursor % q.size,
    LATERAL (SELECT NOT t.twice AND length(q.text) + 2 + t.n BETWEEN 1500 AND 6000 AS ok)),
r AS (SELECT n.id, n.tried, q.id AS prose_id, n.text, n.m, n.twice, q.text AS lead FROM n LEFT JOIN c ON c.id = n.id LEFT JOIN q ON q.j = c.j WHERE n.id % 11 <> 0)
SELECT id, tried, prose_id, CASE WHEN lead IS NULL THEN text ELSE lead || chr(10) || chr(10) || text END AS text,
  CASE WHEN lead IS NULL THEN '' ELSE '0-9 ' END || CAST(coalesce(length(lead) + 2, 0) + 5 AS VARCHAR) || '-' || CAST(coalesce(length(lead) + 2, 0) + 5 + m AS VARCHAR)
    || CASE WHEN twice THEN ' 5-' || CAST(5 + m AS VARCHAR) ELSE '' END AS places FROM r""")
def mixed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks (of parts), six in ten tried behind prose within its own bounds, with the spans of both; some blocks aren't verbatim, some have a span twice."""
    part, docs = table(spark, sf_dir, "part"), table(spark, sf_dir, "documents")
    k = F.col("p_partkey")
    span = F.struct(F.when(k % 11 == 0, "x").otherwise(F.col("p_name")).alias("text"), F.lit("MỤC").alias("type"), F.lit(5).alias("start"), (F.length("p_name") + 5).alias("end"))
    blocks = part.select(k.alias("id"), F.concat(F.lit("Mục: "), "p_name", F.lit("\n"), F.repeat(F.lit("dòng "), ((k % 9) * 70).cast("int"))).alias("text"), F.when(k % 13 == 0, F.array(span, span)).otherwise(F.array(span)).alias("spans"))
    lead = F.struct(F.substring("text", 1, 9).alias("text"), F.lit("ĐẦU").alias("type"), F.lit(0).alias("start"), F.lit(9).alias("end"))
    prose = docs.filter(F.length("text").between(1500, 4000)).select(F.col("doc_id").alias("id"), "text", F.array(lead).alias("spans"))
    got = merging.mixed(blocks, prose, 9)
    places = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), " ")
    return got.select("id", "tried", "prose_id", "text", places.alias("places"))


@query("WITH o AS (SELECT DISTINCT l_orderkey FROM lineitem) SELECT count(*) AS n, count(*) AS verbatim, CAST(floor(count(*) * 0.6) AS BIGINT) AS tried, TRUE AS behind FROM o")
def mixed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built blocks behind prose: every span is at its place, and exactly six in ten are tried."""
    made = work.written(compose.blocks(library._items(spark, sf_dir), library._HEADS, library._NO_HEADS, library._NO, 11))
    prose = table(spark, sf_dir, "documents").filter(F.length("text").between(1500, 4000)).select(F.col("doc_id").alias("id"), "text", F.array().cast(compose.SPANS).alias("spans"))
    got = merging.mixed(made, prose, 9).withColumn("said", merging.verbatim(F.col("text"), F.col("spans")))
    counts = library.counted(got, verbatim=F.col("said"), tried=F.col("tried"), behind=F.col("prose_id").isNotNull())
    return counts.withColumn("behind", F.col("behind").between(1, F.col("tried")))


# ---------------------------------------------------------------------------------------------------------------------
# chosen spans


def _chosen(source: str) -> str:
    """SQL of the best chain of spans: the programme's sums and choices as lists, then read back."""
    return f"""
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY e, s, k1, k2, type, source, score) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM {source}),
h AS (SELECT a.doc_id, a.i, count(b.i) AS p FROM o a LEFT JOIN o b ON b.doc_id = a.doc_id AND b.i < a.i AND b.e <= a.s GROUP BY a.doc_id, a.i),
x AS (SELECT * FROM o JOIN h USING (doc_id, i)),
dp(doc_id, i, best, took) AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT), [CAST(0 AS BIGINT)], CAST([] AS BOOLEAN[]) FROM o
  UNION ALL SELECT x.doc_id, x.i, list_append(best, greatest(best[x.i], x.score + best[x.p + 1])), list_append(took, x.score + best[x.p + 1] > best[x.i]) FROM dp JOIN x ON x.doc_id = dp.doc_id AND x.i = dp.i + 1),
last AS (SELECT doc_id, took FROM dp QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1),
back(doc_id, i) AS (SELECT doc_id, max(i) FROM x GROUP BY doc_id UNION ALL SELECT b.doc_id, CASE WHEN l.took[b.i] THEN x.p ELSE b.i - 1 END FROM back b JOIN last l ON l.doc_id = b.doc_id JOIN x ON x.doc_id = b.doc_id AND x.i = b.i WHERE b.i > 0)
SELECT x.doc_id, x.s AS "start", x.e AS "end", x.type, x.source, CAST(x.score AS BIGINT) AS score, x.k1, x.k2 FROM back b JOIN last l ON l.doc_id = b.doc_id JOIN x ON x.doc_id = b.doc_id AND x.i = b.i WHERE l.took[b.i]"""


_OUT = ["doc_id", "start", "end", "type", "source", "score", "k1", "k2"]


@query(f"WITH RECURSIVE {SPAN_SQL}, {_chosen('spans')}")
def chosen_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.best_disjoint(line_spans(spark, sf_dir).drop("heading"), "start", "k1", "k2", "type", "source").select(*_OUT)


@query(f"WITH RECURSIVE {SPAN_SQL}, {_chosen('unbeaten')}")
def chosen_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.merge(line_spans(spark, sf_dir), "start", "k1", "k2", "type", "source").select(*_OUT)


@query(f"WITH RECURSIVE {SPAN_SQL}, pool AS (SELECT * FROM spans UNION ALL SELECT * REPLACE (s + 1 AS s, e + 1 AS e, score + 1 AS score) FROM spans WHERE source = 'llm'), {_chosen('pool')}")
def chosen_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = line_spans(spark, sf_dir).drop("heading")
    other = every.filter("source = 'llm'").withColumn("start", F.col("start") + 1).withColumn("end", F.col("end") + 1).withColumn("score", F.col("score") + 1)
    return extract.pooled([every, other], "start", "k1", "k2").select(*_OUT)


@query(f"""WITH RECURSIVE {SPAN_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s - e, s, k1, k2, type) AS i FROM spans),
g(doc_id, i, held) AS (SELECT DISTINCT doc_id, CAST(0 AS BIGINT), CAST([] AS STRUCT(a BIGINT, b BIGINT, i BIGINT)[]) FROM o
  UNION ALL SELECT o.doc_id, o.i, CASE WHEN len([h FOR h IN held IF h.a < o.e AND o.s < h.b]) > 0 THEN held ELSE list_append(held, {{'a': o.s, 'b': o.e, 'i': o.i}}) END FROM g JOIN o ON o.doc_id = g.doc_id AND o.i = g.i + 1),
l AS (SELECT doc_id, unnest(held).i AS i FROM (SELECT doc_id, held FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) = 1))
SELECT o.doc_id, o.s AS "start", o.e AS "end", o.type, o.k1, o.k2 FROM l JOIN o USING (doc_id, i)""")
def density_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest spans of each document that don't overlap, as the greedy choice takes them."""
    return spans.longest_first(line_spans(spark, sf_dir).select("doc_id", "start", "end", "type", "k1", "k2"), "start", "k1", "k2")


# ---------------------------------------------------------------------------------------------------------------------
# segmentation

_SAID = """
t AS (SELECT n.l_orderkey AS doc_id, string_agg(p.p_name, ' ' ORDER BY n.l_linenumber, n.l_partkey, n.l_suppkey) AS text FROM lineitem n JOIN part p ON p.p_partkey = n.l_partkey GROUP BY 1),
n AS (SELECT p_partkey AS k, string_split(p_name, ' ') AS s FROM part),
d AS (SELECT word, CAST(count(*) * 7 AS BIGINT) AS w FROM (SELECT s[1] || ' ' || s[2] AS word FROM n WHERE k % 3 = 0 UNION ALL SELECT s[2] || ' ' || s[1] FROM n WHERE k % 5 = 0) GROUP BY word
  UNION ALL SELECT s[1], CAST(count(*) AS BIGINT) FROM n WHERE s[1] < 'm' GROUP BY s[1])"""


@query(f"""WITH RECURSIVE {_SAID}, y AS (SELECT doc_id, text, string_split(text, ' ') AS y FROM t),
e AS (SELECT doc_id, i, y[i] AS one, y[i] || ' ' || y[i + 1] AS two, len(y) AS n FROM (SELECT doc_id, y, unnest(range(1, len(y) + 1)) AS i FROM y)),
l AS (SELECT e.doc_id, e.i, e.n, coalesce(a.w, -20) AS w1, b.w AS w2 FROM e LEFT JOIN d a ON a.word = e.one LEFT JOIN d b ON b.word = e.two),
dp(doc_id, i, b1, b2, took) AS (SELECT DISTINCT doc_id, n + 1, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST([] AS INTEGER[]) FROM l
  UNION ALL SELECT l.doc_id, l.i, greatest(l.w1 + b1, coalesce(l.w2 + b2, l.w1 + b1)), b1, list_prepend(CASE WHEN l.w2 + b2 >= l.w1 + b1 THEN 2 ELSE 1 END, took) FROM dp JOIN l ON l.doc_id = dp.doc_id AND l.i = dp.i - 1),
f AS (SELECT doc_id, took FROM dp WHERE i = 1),
w(doc_id, i, k) AS (SELECT doc_id, CAST(1 AS BIGINT), took[1] FROM f UNION ALL SELECT w.doc_id, w.i + w.k, f.took[w.i + w.k] FROM w JOIN f ON f.doc_id = w.doc_id WHERE w.i + w.k <= len(f.took))
SELECT w.doc_id, array_to_string(y[w.i:w.i + w.k - 1], '_') AS word, CAST(length(array_to_string(y[1:w.i - 1], ' ')) + CASE WHEN w.i > 1 THEN 1 ELSE 0 END AS BIGINT) AS "start",
  CAST(length(array_to_string(y[1:w.i + w.k - 1], ' ')) AS BIGINT) AS "end" FROM w JOIN y ON y.doc_id = w.doc_id""")
def segmented_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of an order's parts in a row, cut into words of one syllable or two by a dictionary of some names, with weights by how often they occur."""
    part, lines = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    named = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "p_name"))).alias("x"))
    docs = named.select("doc_id", F.array_join(F.transform("x", lambda i: i["p_name"]), " ").alias("text"))
    s = F.split("p_name", " ")
    two = part.filter("p_partkey % 3 = 0").select(F.col("p_name").alias("word")).unionByName(part.filter("p_partkey % 5 = 0").select(F.concat(s[1], F.lit(" "), s[0]).alias("word")))
    words = two.groupBy("word").agg((F.count(F.lit(1)) * 7).alias("weight")).unionByName(part.filter(s[0] < "m").groupBy(s[0].alias("word")).agg(F.count(F.lit(1)).alias("weight")))
    got = segmenter.segmented(docs, words, unknown=-20)
    return got.select("doc_id", F.explode("words").alias("w")).select("doc_id", "w.word", "w.start", "w.end")


# ---------------------------------------------------------------------------------------------------------------------
# models (stand-ins: what is held against SQL is what stands around them)


def _echo():
    """A model that answers a prompt by questions of its lines, numbered."""
    return lambda prompts: ["\n".join(f"{i}. TC|{line}?" for i, line in enumerate(p.split("\n"), 1)) for p in prompts]


def _letters():
    """A model whose vector of a word is its length and whether it begins with a letter before m."""
    import numpy as np

    return lambda texts: [np.array([[len(w), w[0] < "m"] for w in t.split(" ") if w], float).reshape(-1, 2) for t in texts]


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)
SELECT doc_id, k - 1 AS line, 'TRIỆU_CHỨNG' AS kind, ltrim(t, ' ' || chr(9)) || '?' AS text FROM l""")
def model_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a model to whole documents, read line by line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))
    return rules.parse_replies(models.replied(docs, _echo).select("doc_id", "reply"))


@query("""WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents), m AS (SELECT doc_id, avg(length(w)) AS a, avg(CASE WHEN w < 'm' THEN 1.0 ELSE 0.0 END) AS b FROM w WHERE w <> '' GROUP BY doc_id)
SELECT doc_id, round(a / sqrt(a * a + b * b), 9) AS x, round(b / sqrt(a * a + b * b), 9) AS y FROM m""")
def model_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vectors of a model's tokens, scaled to length 1."""
    got = models.embedded(table(spark, sf_dir, "documents").select("doc_id", "text"), _letters)
    return got.filter("vector is not null").select("doc_id", F.round(F.col("vector")[0], 9).alias("x"), F.round(F.col("vector")[1], 9).alias("y"))


@query("""WITH p AS (SELECT p_partkey AS doc_id, p_size % 9 AS n, p_partkey % 2 = 0 AS short FROM part),
s AS (SELECT doc_id, n, short, i AS a, i + 1 AS b FROM p, range(0, 9) t(i) WHERE i < n UNION ALL SELECT doc_id, n, short, 1, 3 FROM p UNION ALL SELECT doc_id, n, short, 2, 5 FROM p)
SELECT doc_id, CAST(3 * a AS BIGINT) AS "start", CAST(3 * b - 1 AS BIGINT) AS "end" FROM s WHERE NOT (short AND n + 2 > 6) OR (a = 2 AND b = 5) OR (b = a + 1 AND a NOT BETWEEN 2 AND 4)""")
def dense_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of ten or twenty words with two to ten proposals: in short units with more than six only the longest that don't overlap stay."""
    part = table(spark, sf_dir, "part")
    k, n = F.col("p_partkey"), F.col("p_size") % 9
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.when(k % 2 == 0, 9).otherwise(19)), lambda i: F.concat(F.lit("a"), i.cast("string"))), " ")
    units = part.select(k.alias("doc_id"), F.lit(0).alias("unit"), text.alias("text"), F.lit(0).alias("start"), F.lit(None).cast("string").alias("heading"), F.lit("clinical").alias("zone"))
    ones = F.transform(F.filter(F.sequence(F.lit(0), F.lit(8)), lambda i: i < n), lambda i: F.concat(F.lit("a"), i.cast("string")))
    said = part.select(k.alias("doc_id"), F.lit(0).alias("unit"), F.lit("TRIỆU_CHỨNG").alias("kind"), F.posexplode(F.concat(ones, F.array(F.lit("a1 a2"), F.lit("a2 a3 a4")))).alias("line", "text"))
    return verify.verified_units(said, units).select("doc_id", "start", "end")
