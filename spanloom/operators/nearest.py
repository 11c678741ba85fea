"""Nearest neighbours of a stated query set against all rows, by class: a join of tiles.

Vectors are dealt by the centre that is nearest to them (CENTRES at most, rows with the smallest tickets: a bounded sample that decides about speed alone) and packed into
tiles of TILE_BYTES; a tile knows its centre and the widest angle to it. A query tile first meets, of each class, the tile whose centre is nearest to its own; what
that gives each query is a bound. Then it meets only tiles that may hold better: two vectors are no nearer than the angle between their centres less the two
widest angles. Tiles meet by shuffle, in groups of a query tile and about TOGETHER others, so no task or driver holds more than a group and
the centres, whatever the number of queries and rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators import choice
from spanloom.sources import work

#: Bytes of a tile's vectors, and the most centres.
TILE_BYTES, CENTRES = 1 << 20, 256
#: So many tiles, about, meet a query tile at once.
TOGETHER = 8
#: So many pairs of tiles are all compared.
FEW_PAIRS = 64
#: Room for rounding in bounds on angles.
_SLACK = 1e-6


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows; zero vectors stay zero."""
    flat = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = flat.reshape(len(vectors), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _usable(rows: DataFrame, vector: str, size: int) -> DataFrame:
    return rows.filter((F.size(vector) == size) & F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))))


def _dealt(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """rows (k, v, first) with the nearest centre (of which -1 is none: a zero vector's) and the angle to it."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("v"))
                c = x @ sent.value.T
                at = c.argmax(axis=1)
                angle = np.arccos(np.clip(c[np.arange(len(at)), at], -1, 1))
                zero = ~x.any(axis=1)
                at[zero], angle[zero] = -1, np.pi
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(angle)], names=[*batch.schema.names, "centre", "angle"])

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in kind.items()) + ", centre int, angle double")


def _tiles(rows: DataFrame, centres: np.ndarray, tile_bytes: int) -> DataFrame:
    """(tile, centre, first, angle, ids, raw) of rows (k, v, first): tiles of one centre and class, the vectors packed as unit rows of doubles."""
    dealt = _dealt(rows, centres).repartitionByRange("centre", "first", F.xxhash64("k")).sortWithinPartitions("centre", "first")
    most = max(1, tile_bytes // (8 * centres.shape[1]))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        label = None

        def pack() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            raw = _matrix(t.column("v").combine_chunks()).tobytes()
            ids = pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column("k").combine_chunks())
            return pa.RecordBatch.from_arrays([pa.array([label[0]], pa.int32()), pa.array([label[1]]), pa.array([float(t.column("angle").to_numpy().max())]), ids, pa.array([raw], pa.binary())], names=["centre", "first", "angle", "ids", "raw"])

        for batch in batches:
            marks = list(zip(batch.column("centre").to_pylist(), batch.column("first").to_pylist(), strict=True))
            i = 0
            while i < len(marks):
                if held and (marks[i] != label or sum(b.num_rows for b in held) >= most):
                    yield pack()
                    held = []
                label = marks[i]
                room = most - sum(b.num_rows for b in held)
                j = i + 1
                while j < len(marks) and marks[j] == label and j - i < room:
                    j += 1
                held.append(batch.slice(i, j - i))
                i = j
        if held:
            yield pack()

    packed = dealt.mapInArrow(run, f"centre int, first boolean, angle double, ids array<{kind}>, raw binary")
    return work.written(packed.withColumn("tile", F.monotonically_increasing_id()))


def _met(pairs: DataFrame, q: DataFrame, r: DataFrame, kind: str, size: int, n_rows: int) -> DataFrame:
    """(k, q, first, best): the largest cosine of each query of the paired tiles (q, r), itself left out; n_rows: how many tiles r has.

    A query tile meets about TOGETHER others at once, a group of its own; it goes to each group once, and a task holds one group at a time, however many it has.
    """
    deal = pairs.select("q", F.col("r").alias("tile"), F.pmod(F.xxhash64("r"), F.lit(max(1, n_rows // TOGETHER))).alias("part"))
    left = deal.select(F.col("q").alias("tile"), F.col("part").alias("to")).distinct().join(q.select("tile", "ids", "raw"), "tile")
    right = deal.join(r.select("tile", "first", "ids", "raw"), "tile").select("q", "part", "first", "ids", "raw")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tile, qids = left.column("tile")[0].as_py(), left.column("ids")[0].values
        a, mine = np.frombuffer(left.column("raw")[0].as_buffer(), np.float64).reshape(-1, size), np.asarray(qids.to_numpy(zero_copy_only=False))
        out = []
        for first, ids, raw in zip(*(right.column(c) for c in ("first", "ids", "raw")), strict=True):
            c = a @ np.frombuffer(raw.as_buffer(), np.float64).reshape(-1, size).T
            c[mine[:, None] == np.asarray(ids.values.to_numpy(zero_copy_only=False))[None, :]] = -np.inf
            best = c.max(axis=1)
            some = best > -np.inf
            n = int(some.sum())
            out.append(pa.table({"k": qids.filter(pa.array(some)), "q": pa.array([tile] * n, pa.int64()), "first": pa.array([first.as_py()] * n, pa.bool_()), "best": best[some]}))
        return pa.concat_tables(out)

    return left.groupBy("tile", "to").cogroup(right.groupBy("q", "part")).applyInArrow(run, f"k {kind}, q bigint, first boolean, best double")


def nearest_by_class(queries: DataFrame, rows: DataFrame, key: str, vector: str, first_class: Column, tile_bytes: int | None = None, most_centres: int | None = None, few_pairs: int = FEW_PAIRS) -> DataFrame:
    """(key, r_top, o_top): each query's largest cosine with rows of the first class and with the others, itself left out; null where there is none.

    Keys must be unique. Vectors that are null, hold null or NaN, or aren't as long as the queries' longest have no cosine; that with a zero vector is 0. A null class is one of the others.
    """
    tile_bytes, most_centres = tile_bytes or TILE_BYTES, most_centres or CENTRES
    kind = rows.schema[key].dataType.simpleString()
    empty = queries.select(key).distinct().withColumn("r_top", F.lit(None).cast("double")).withColumn("o_top", F.lit(None).cast("double"))
    size = queries.agg(F.max(F.size(vector))).first()[0]
    if not size or size < 0:
        return empty
    every = _usable(rows.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.coalesce(first_class, F.lit(False)).alias("first")), "v", size)
    asked = _usable(queries.select(F.col(key).alias("k"), F.col(vector).alias("v"), F.lit(False).alias("first")), "v", size)
    # no more centres than a few tiles each: tiles are of one centre, and should be full
    most_centres = max(1, min(most_centres, every.count() // (4 * max(1, tile_bytes // (8 * size)))))
    sample = every.orderBy(choice.ticket("centre", "k"), "k").limit(most_centres).select("v").toArrow()  # the first of each task, most_centres rows
    if not sample.num_rows:
        return empty
    centres = _matrix(sample.column("v").combine_chunks())
    centres = centres[centres.any(axis=1)]
    centres = centres if len(centres) else np.eye(1, size)
    q, r = _tiles(asked, centres, tile_bytes), _tiles(every, centres, tile_bytes)

    n_rows = r.count()
    if q.count() * n_rows <= few_pairs:  # what bounds could save is less than what they cost
        every_pair = q.select(F.col("tile").alias("q")).join(r.select(F.col("tile").alias("r")))
        return _named(queries, key, _met(every_pair, q, r, kind, size, n_rows))

    # centres with centres: most_centres squared at most
    angle = np.arccos(np.clip(centres @ centres.T, -1, 1))
    n = len(centres)
    turns = pa.table({"cq": np.repeat(np.arange(n, dtype=np.int32), n), "cr": np.tile(np.arange(n, dtype=np.int32), n), "turn": angle.ravel()})
    turns = F.broadcast(rows.sparkSession.createDataFrame(turns.to_pandas()))
    heads = lambda t, c, name: t.select(F.col("tile").alias(name), F.col("centre").alias(c), F.col("angle").alias(f"{name}_angle"), *([F.col("first")] if name == "r" else []))
    # tiles with tiles, by their heads alone; those of zero vectors (centre -1) are never ruled out
    pairs = heads(q, "cq", "q").join(heads(r, "cr", "r")).join(turns, ["cq", "cr"], "left")
    gap = F.coalesce(F.col("turn") - F.col("q_angle") - F.col("r_angle"), F.lit(0.0))
    top = F.when(gap > _SLACK, F.cos(gap - _SLACK)).otherwise(1.0)  # no cosine of the pair is larger
    pairs = work.written(pairs.select("q", "r", "first", top.alias("top"), F.coalesce("turn", F.lit(9.0)).alias("turn")))
    begun = pairs.groupBy("q", "first").agg(F.min(F.struct("turn", "r")).alias("x")).select("q", "first", F.col("x.r").alias("r"))
    one = work.written(_met(begun, q, r, kind, size, n_rows))
    # a class's bound holds for a tile only if all its queries have one
    found = one.groupBy("q", "first").agg(F.min("best").alias("least"), F.count(F.lit(1)).alias("n"))
    found = found.join(q.select(F.col("tile").alias("q"), F.size("ids").alias("m")), "q").select("q", "first", F.when(F.col("n") == F.col("m"), F.col("least")).alias("least"))
    rest = pairs.join(begun.select("q", "r", F.lit(True).alias("__done")), ["q", "r"], "left").filter("__done is null").join(found, ["q", "first"], "left").filter(F.col("least").isNull() | (F.col("top") > F.col("least")))
    return _named(queries, key, one.unionByName(_met(rest, q, r, kind, size, n_rows)))


def _named(queries: DataFrame, key: str, got: DataFrame) -> DataFrame:
    best = got.groupBy("k").agg(F.max(F.when(F.col("first"), F.col("best"))).alias("r_top"), F.max(F.when(~F.col("first"), F.col("best"))).alias("o_top"))
    return queries.select(F.col(key).alias("__k")).distinct().join(best, F.col("__k") == F.col("k"), "left").select(F.col("__k").alias(key), "r_top", "o_top")


# The least cosine with the first class, and with the others.
FIRST_TIER, OTHER_TIER = 0.5, 0.93


def cascade(nearest: DataFrame, first: str, other: str, first_tier: float = FIRST_TIER, other_tier: float = OTHER_TIER) -> DataFrame:
    """nearest (r_top, o_top) with ``type``: ``first`` where r_top is over its tier and not under o_top, else ``other`` from its tier on, else null."""
    r, o = F.coalesce("r_top", F.lit(-1.0)), F.coalesce("o_top", F.lit(-1.0))
    return nearest.withColumn("type", F.when((r > first_tier) & (r >= o), first).when(o >= other_tier, other))
