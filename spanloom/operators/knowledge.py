"""Tables of terms: aliases attached to known codes, names from flattened price tables, and dictionary words that no label covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.operators import rules, spans

PRICE = r"^\d{1,3}(?:[.,]?\d{3})*$"


def attach_aliases(aliases: DataFrame, terms: DataFrame, parent: int = 3) -> DataFrame:
    """(code, term) of aliases at codes that ``terms`` has: their own, else its first ``parent`` characters; others go. No code is new."""
    own = terms.select(F.col("code").alias("own")).distinct()
    up = terms.select(F.col("code").alias("up")).distinct()
    rows = aliases.join(own, F.col("code") == F.col("own"), "left").join(up, F.substring("code", 1, parent) == F.col("up"), "left")
    return rows.select(F.coalesce("own", "up").alias("code"), "term").filter("code is not null")


def names_before_prices(cells: DataFrame, table: str = "table", pos: str = "pos", text: str = "text") -> DataFrame:
    """(table, pos, name): texts right before a price. A text before another text is a code, whatever it looks like."""
    after = F.lead(text).over(W.partitionBy(table).orderBy(pos))
    rows = cells.filter(F.trim(text) != "").withColumn("__after", after)
    return rows.filter(~F.trim(text).rlike(PRICE) & F.trim("__after").rlike(PRICE)).select(table, pos, F.trim(text).alias("name"))


def unlabelled_names(docs: DataFrame, labelled: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, text, start, end): dictionary names in texts that no labelled span (doc_id, start, end) touches."""
    found = rules.names_longest(docs, names).drop("n")
    return found.alias("s").join(labelled.alias("t"), spans.overlaps("s", "t"), "left_anti")
