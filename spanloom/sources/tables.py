"""Readers and writers: documents, dictionaries, labelled token files, span JSON, entity exports."""

from __future__ import annotations

import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions.text import key_form, nfc
from spanloom.operators import choice
from spanloom.sources import work
from spanloom.sources.work import write_files

ENTITY = "struct<text:string,type:string,candidates:array<string>,assertions:array<string>,position:array<bigint>>"
# Fixed values.
NAME_COLUMNS = ("term", "name", "str", "STR")
LEAST_NAMES = 1000


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text): a document per file, named by its file without ending; order by number where names are numbers."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*?)(?:\.[^.]*)?$", 1).alias("name"), F.col("value").alias("text"))
    return rows.orderBy(F.expr("try_cast(name as bigint)"), "name")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(name): the lines of a list without blanks."""
    return spark.read.text(path).select(F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("name")).filter("name <> ''")


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, its columns by name as the schema says; a column that it lacks fails."""
    rows = spark.read.csv(path, header=True)
    wanted = T.StructType.fromDDL(schema)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted])


def read_documents(spark: SparkSession, path: str, files: DataFrame | None = None) -> DataFrame:
    """(name, text, entities) of documents that were written as a JSON file each: {"text", "entities"}, entities in the export's form.

    Where the files' names are known (files, as write_files gives them), tasks open them by name; else Spark lists the folder, on the driver, and has a
    task for few files."""
    schema = f"text string, entities array<{ENTITY}>"
    if files is None:
        rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))
    else:
        rows = work.read_files(files, path)
    rows = rows.select(F.regexp_extract("name", r"^(.*?)(?:\.[^.]*)?$", 1).alias("name"), F.from_json("content", schema).alias("d"))
    return rows.select("name", "d.text", "d.entities")


def bundle(spark: SparkSession, folder: str, tables: dict[str, str], lists: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """A knowledge base: the CSV tables (name to schema) and line lists of a folder by name, each also a temporary view; fails on an empty one."""
    out = {name: read_rows(spark, f"{folder}/{name}.csv", schema) for name, schema in tables.items()} | {name: read_lines(spark, f"{folder}/{name}.txt") for name in lists}
    for name, rows in out.items():
        if not rows.limit(1).count():
            raise ValueError(f"{folder}: {name} has no rows")
        rows.createOrReplaceTempView(name)
    return out


def name_set(rows: DataFrame, column: str) -> DataFrame:
    """(name): distinct names, composed (NFC), in lower case, white space collapsed."""
    return rows.select(key_form(nfc(F.col(column))).alias("name")).filter("name <> ''").distinct()


def short_names(*sources: DataFrame, most: int = 8) -> DataFrame:
    """(name): distinct names of several sources (name) that have 1 to ``most`` words."""
    every = sources[0].select("name")
    for other in sources[1:]:
        every = every.unionByName(other.select("name"))
    return name_set(every, "name").filter(F.size(F.split("name", " ")).between(1, most))


def read_names(spark: SparkSession, path: str, columns: tuple[str, ...] = NAME_COLUMNS, least: int = LEAST_NAMES) -> DataFrame:
    """(name): distinct names in key form from the first of ``columns`` that a CSV has; fails on none, or on fewer than ``least`` names."""
    rows = spark.read.csv(path, header=True)
    column = next((c for c in columns if c in rows.columns), None)
    if column is None:
        raise ValueError(f"{path} has none of the columns {', '.join(columns)}")
    names = rows.select(key_form(F.col(column)).alias("name")).filter("name <> ''").distinct()
    if names.limit(least).count() < least:
        raise ValueError(f"{path} has fewer than {least} names")
    return names


def read_all_columns(spark: SparkSession, path: str) -> DataFrame:
    """(name): the values of all columns of a CSV, as of a table of synonyms."""
    rows = spark.read.csv(path, header=True)
    return rows.select(F.explode(F.array(*[F.trim(F.col(f"`{c}`").cast("string")) for c in rows.columns])).alias("name")).filter("name is not null and name <> ''").distinct()


def read_synonyms(spark: SparkSession, path: str) -> DataFrame:
    """(name, other) of a two-column CSV, in both directions."""
    rows = spark.read.csv(path, header=True)
    a, b = rows.columns[:2]
    pairs = rows.select(key_form(F.col(a)).alias("name"), key_form(F.col(b)).alias("other"))
    return pairs.unionByName(pairs.select(F.col("other").alias("name"), F.col("name").alias("other"))).filter("name <> other").distinct()


def read_conll(spark: SparkSession, path: str) -> DataFrame:
    """(file, sentence, tokens, labels): token first, label last on each line; blank lines end sentences, lines of one column are dropped.

    Files are read by splits, so a large one is many tasks. A split counts its blank lines; the splits before it in its file, of which there are few, say what its
    sentences begin at. Sentences are numbered from 1 in each file, those without a labelled token left out.
    """
    lines = spark.read.text(path, lineSep="\n").select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("k"), F.regexp_replace("value", "\r$", "").alias("line"))
    parts = F.split(F.trim(F.regexp_replace("line", r"(?U)\s+", " ")), " ")
    lines = lines.withColumn("p", parts).select("file", "split", "k", (F.trim("line") == "").cast("int").alias("blank"), F.when(F.size("p") >= 2, F.struct(F.element_at("p", 1).alias("t"), F.element_at("p", -1).alias("l"))).alias("x"))
    lines = work.written(lines)  # the order of lines in a split is settled
    counts = lines.groupBy("file", "split").agg(F.sum("blank").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begun = counts.select(F.col("file").alias("f"), F.col("split").alias("s"), before.alias("before"))
    here = F.sum("blank").over(W.partitionBy("file", "split").orderBy("k"))
    rows = lines.withColumn("here", here).filter("blank = 0 and x is not null").join(begun, (F.col("file") == F.col("f")) & (F.col("split") == F.col("s")))
    got = rows.groupBy("file", (F.col("before") + F.col("here")).alias("at")).agg(F.sort_array(F.collect_list(F.struct("split", "k", "x.t", "x.l"))).alias("x"))
    got = choice.numbered(got, "file", "at", name="n")
    first = got.groupBy(F.col("file").alias("f")).agg(F.min("n").alias("first"))
    rows = got.join(first, F.col("file") == F.col("f"))
    return rows.select("file", (F.col("n") - F.col("first") + 1).cast("int").alias("sentence"), F.transform("x", lambda i: i["t"]).alias("tokens"), F.transform("x", lambda i: i["l"]).alias("labels"))


SPAN_JSON = T.StructType([T.StructField("sentence", T.StringType()), T.StructField("seq_label", T.ArrayType(T.ArrayType(T.StringType())))])


def read_span_json(spark: SparkSession, path: str) -> DataFrame:
    """(tokens, spans array<struct<first, last, type>>) of a JSON list of {sentence, seq_label: [[first, last, label]]}, bounds inclusive."""
    rows = spark.read.json(path, schema=SPAN_JSON, multiLine=True)
    item = F.transform("seq_label", lambda s: F.struct(F.element_at(s, 1).cast("int").alias("first"), F.element_at(s, 2).cast("int").alias("last"), F.element_at(s, 3).alias("type")))
    return rows.select(F.split(F.trim("sentence"), r"\s+").alias("tokens"), item.alias("spans"))


def entities(spans: DataFrame, *order: str) -> DataFrame:
    """(doc_id, entities): the spans of each document by start, end and the columns ``order``, in the export's form."""
    one = F.struct("start", "end", *order, *[c for c in ("text", "type") if c not in order])
    rows = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(one)).alias("x"))
    none = F.array().cast("array<string>")
    made = F.transform("x", lambda e: F.struct(e["text"].alias("text"), e["type"].alias("type"), none.alias("candidates"), none.alias("assertions"), F.array(e["start"], e["end"]).cast("array<bigint>").alias("position")))
    return rows.select("doc_id", made.alias("entities"))


def write_entities(spans: DataFrame, path: str) -> None:
    """A JSON line per document: its id and entities."""
    entities(spans).write.mode("overwrite").json(path)


def documents_json(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(name, content): a JSON file for each document (doc_id, text) with its spans, in the form that ``read_documents`` reads; documents without spans too."""
    rows = docs.join(entities(found), "doc_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast(f"array<{ENTITY}>")))
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("name"), F.to_json(F.struct("text", "entities"), {"ignoreNullFields": "false"}).alias("content"))


def write_submission(docs: DataFrame, found: DataFrame, folder: str) -> DataFrame:
    """Checks the spans (verbatim, disjoint), writes a JSON list of entities for each document into the folder, and gives (type, n) with the numbers of files
    and entities as types "files" and "entities"."""
    from spanloom.plans.extract import checked

    good = entities(checked(found, docs))
    rows = docs.select("doc_id").join(good, "doc_id", "left").withColumn("entities", F.coalesce("entities", F.array().cast(f"array<{ENTITY}>")))
    written = write_files(rows.select(F.concat(F.col("doc_id").cast("string"), F.lit(".json")).alias("name"), F.to_json("entities").alias("content")), folder)
    count = F.count(F.lit(1)).alias("n")
    return found.groupBy("type").agg(count).unionByName(found.agg(count).select(F.lit("entities").alias("type"), "n")).unionByName(written.agg(count).select(F.lit("files").alias("type"), "n"))


def write_pairs(rows: DataFrame, texts: str, labels: str) -> DataFrame:
    """Writes rows (index, text, entities json) as pairs of files with four-digit names; gives the texts' (name, bytes)."""
    named = rows.withColumn("__n", pair_name(F.col("index")))
    write_files(named.select(F.concat("__n", F.lit(".json")).alias("name"), F.col("entities").alias("content")), labels)
    return write_files(named.select(F.concat("__n", F.lit(".txt")).alias("name"), F.col("text").alias("content")), texts)


def pair_name(index):
    """Four-digit file names that grow beyond 9999."""
    return F.format_string("%04d", index)


def report(scored: DataFrame) -> DataFrame:
    """Fixed-width lines of a table of scores."""
    return scored.select(F.concat(F.rpad("label", 24, " "), *[F.lpad(F.format_number(F.col(c), 4), 10, " ") for c in ("precision", "recall", "f1")], F.lpad(F.col("support").cast("string"), 10, " ")).alias("line"))


def zip_folder(folder: str, archive: str) -> str:
    """Packs a local folder; a tool for the driver's machine."""
    return shutil.make_archive(archive.removesuffix(".zip"), "zip", folder)
