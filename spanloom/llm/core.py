"""What the corpus operators share: durable tables, joins that survive hot keys, components; and the words of a batch, which the rest of the
library has too."""

from __future__ import annotations

import ctypes
import functools
import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.words import Words, mix, rolling, slices, span_hashes, whole
from spanloom.sources.work import delete, shared_dir, work_path

__all__ = ["WORD", "Words", "col", "components", "discard", "durable", "lean", "lookup", "mix", "plainly", "rolling", "shared_dir", "slices", "span_hashes", "whole", "work_path"]

WORD = r"[^\x20\x09-\x0D]+"

# ---------------------------------------------------------------------------------------------------------------------
# durable intermediate tables


def durable(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: lineage is cut, a lost executor loses nothing.

    Unlike checkpoint() the files are compressed, and the optimizer knows their size, so that it broadcasts only what
    is under spark.sql.autoBroadcastJoinThreshold.
    """
    spark = df.sparkSession
    path = work_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table made by durable() that nothing reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/spanloom-" in path:
            delete(df.sparkSession, path)


def col(name: str) -> Column:
    """A column by its exact name, whatever characters that has."""
    return F.col("`" + name.replace("`", "``") + "`")


def plainly(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """df with its columns renamed c0, c1, ... by place, and the new names of ``names``: whatever other columns are called, helper columns with
    other names can't clash with them. ``out.toDF(*df.columns)`` gives the names back."""
    low = [c.lower() for c in df.columns]
    return df.toDF(*[f"c{i}" for i in range(len(low))]), [f"c{df.columns.index(n) if n in df.columns else low.index(n.lower())}" for n in names]


def lean(f: Callable) -> Callable:
    """Decorates a function over Arrow batches or tables: when it has ended, the worker gives free memory back to the system, as workers
    live on beside the executor's heap."""

    def trim() -> None:
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    if inspect.isgeneratorfunction(f):

        @functools.wraps(f)
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from f(batches)
            trim()

        return run

    if len(inspect.signature(f).parameters) == 2:

        @functools.wraps(f)
        def two(left: pa.Table, right: pa.Table) -> pa.Table:
            out = f(left, right)
            if left.nbytes + right.nbytes > 1 << 20:
                trim()
            return out

        return two

    @functools.wraps(f)
    def one(table: pa.Table) -> pa.Table:
        out = f(table)
        if table.nbytes > 1 << 20:
            trim()
        return out

    return one


# ---------------------------------------------------------------------------------------------------------------------
# joins

#: A key is hot if it holds more than one in so many of all rows; so there are at most that many hot keys.
HOT_ONE_IN = 1000


def lookup(big: DataFrame, small: DataFrame, on: str, weight: str, total: int) -> DataFrame:
    """big left-joined with small (one row per value of ``on``), whatever share of big's rows one key has.

    ``weight`` is a column of small with the number of big's rows that have the key, ``total`` their sum. Keys with more than
    total/HOT_ONE_IN rows (at most HOT_ONE_IN of them, by counting) are broadcast; the rest is joined by shuffle, where
    the rows of hot keys are dealt evenly under values that match nothing. ``weight`` is dropped. Neither side may have columns named __hk, __hv,
    __ck, __cv or __jk.
    """
    cols = [c for c in small.columns if c not in (on, weight)]
    least = max(1, total // HOT_ONE_IN)
    hot = small.filter(F.col(weight) > least).select(F.col(on).alias("__hk"), F.struct(*cols).alias("__hv"))
    cold = small.filter(F.col(weight) <= least).select(F.col(on).cast("string").alias("__ck"), F.struct(*cols).alias("__cv"))
    rows = big.join(F.broadcast(hot), col(on) == F.col("__hk"), "left")
    spread = F.concat(F.lit("\x00"), F.xxhash64(*[col(c) for c, t in big.dtypes if "map<" not in t and t != "variant"]).cast("string"))
    rows = rows.withColumn("__jk", F.when(F.col("__hk").isNotNull() | col(on).isNull(), spread).otherwise(col(on).cast("string")))
    rows = rows.join(cold, F.col("__jk") == F.col("__ck"), "left")
    value = F.coalesce("__hv", "__cv")
    return rows.select(*[col(c) for c in big.columns], *[value[c].alias(c) for c in cols])


# ---------------------------------------------------------------------------------------------------------------------
# connected components


#: Up to this many edges (two bigints each: 64 MB) are closed in one task; more are closed by rounds of joins.
EDGES_IN_TASK = 1 << 22


def _closed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node connected) of the edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        new = root.copy()
        least = np.minimum(root[x], root[y])
        for end in (x, y, root[x], root[y]):
            np.minimum.at(new, end, least)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def components(edges: DataFrame, in_task: int = EDGES_IN_TASK) -> DataFrame:
    """(node, comp) for every node of the undirected edges (a, b) of bigints: comp is the smallest node it is connected with.

    The tasks first reduce their own edges to a spanning forest. If what is left is no more than ``in_task`` edges, one task closes them; else
    alternating large-star and small-star rounds (Kiveris et al. 2014): every round is two aggregations with partial
    sums and two joins; each round's edges are written to the shared folder. Ends when a round changes nothing, after a number of rounds
    that grows with the logarithm of the edges.
    """

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, root = _closed(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            some = node != root
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(root[some])], names=["a", "b"])

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            node, root = _closed(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], names=["node", "comp"])

    e = durable(edges.filter("a is not null and b is not null and a <> b").select("a", "b").mapInArrow(forest, "a bigint, b bigint"))
    if e.count() <= in_task:
        return durable(e.coalesce(1).mapInArrow(close, "node bigint, comp bigint"))
    e = durable(e.distinct())
    before = _mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = lookup(both.filter("b > a"), least, "a", "n", 2 * before[0])
        large = durable(large.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = lookup(large, least, "a", "n", before[0]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b")))
        new = durable(small.filter("a <> b").distinct())
        discard(large)
        discard(e)
        e, after = new, _mark(new)
        if after == before:
            break
        before = after
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _mark(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]
