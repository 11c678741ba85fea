"""Near-duplicates among embeddings by collision-counting projections.

Every vector is scaled to length 1 and projected on many random lines. Two vectors collide on a line if the one's projection lies in the
window of half-width ``w`` centred at the other's. Pairs with at least ``least`` collisions on ``lines`` lines are verified by their cosine in
double precision. For a pair exactly at the threshold the differences on the lines are independent normal variates, so ``least`` follows from
the binomial distribution: such a pair reaches it with the probability asked for, closer pairs more often.

Collisions are counted over sorted projections: on each line the vectors are put in order, and every query's window is a stretch of that order. This is done among vectors
that share a cell of one of several tables: each table has ``depth`` lines of its own, cut into cells of width ``cell`` with a random shift (with one cell where a label is small,
depth 0). A pair at the threshold shares a cell of a table with probability
same(distance)^depth, an unrelated one with same(sqrt(2))^depth. So the depth follows from the size of the largest label, such that a cell holds
about CELL unrelated vectors whatever that size, and the number of tables from the depth, such that a pair at the threshold shares some
cell with the probability asked for. Both grow with the logarithm of a label, and a small power (0.12) of it: work isn't its square.

What is sent to the cells is a sketch of a vector: its projections on the counting lines in one byte each, the window being widened by the
rounding. Vectors that pass a count there with some other are then sent to these cells whole, counted again and verified. A pair belongs to the first
table in which it shares a cell, so it is counted once. Cells with many vectors are cut into chunks, and every pair of chunks is a piece
of work of its own; no pairs leave it, only sums of links by vector and a spanning tree of them.

Vectors that are equal in label and all components are one class, which is searched once and counts as often as it has members.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those without a label, link with nothing; vectors of
unlike length never link; a null id is kept, and isn't anybody's component unless the group has no other; extra columns don't matter; a table
without rows gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.core import col, components, durable, lean, lookup, mix

#: Vectors of a cell that are compared with each other in one piece.
_CHUNK = 2048
#: Unrelated vectors of the largest label that a cell should hold.
_CELL = 256
#: Rows, and pairs of rows, that a piece of work should hold.
_PIECE_ROWS, _PIECE_PAIRS = 1 << 16, 1 << 26
#: Up to this many cells that are cut into chunks are broadcast (under 40 bytes each); more are joined by shuffle.
_BROADCAST_CELLS = 100_000
#: A sketch's step, and the largest value that it tells apart (further ones are at 6 standard deviations).
_STEP = 0.05


@dataclass(frozen=True)
class Lines:
    cosine: float = 0.98
    lines: int = 24
    sigmas: float = 2.33
    cell: float = 2.0
    recall: float = 0.999
    seed: int = 98

    @property
    def distance(self) -> float:
        return math.sqrt(2 - 2 * self.cosine)

    @property
    def window(self) -> float:
        return self.sigmas * self.distance

    @property
    def steps(self) -> int:
        """The window in steps of the sketch; rounding moves either end by half a step at most."""
        return math.ceil(self.window / _STEP) + 1

    @property
    def least(self) -> int:
        """The largest count that a pair at the threshold reaches with probability 1 - (1 - recall) / 2."""
        p, tail = math.erf(self.sigmas / math.sqrt(2)), 0.0
        for hits in range(self.lines, -1, -1):
            tail += math.comb(self.lines, hits) * p**hits * (1 - p) ** (self.lines - hits)
            if tail >= 1 - (1 - self.recall) / 2:
                return hits
        return 0

    def same(self, distance: float) -> float:
        """The probability that vectors at this distance are in one cell of one line."""
        r = self.cell / distance
        return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))

    def depth(self, most: int) -> int:
        """Lines of each table, for a largest label of so many vectors."""
        return max(0, math.ceil(math.log(max(most, 1) / _CELL) / math.log(1 / self.same(math.sqrt(2)))))

    def tables(self, depth: int) -> int:
        """Tables for a pair at the threshold to share a cell with probability 1 - (1 - recall) / 2."""
        both = self.same(self.distance) ** depth
        return 1 if depth == 0 else math.ceil(math.log((1 - self.recall) / 2) / math.log(1 - both))

    def sketch(self, x: np.ndarray) -> np.ndarray:
        """The projections of unit vectors on the counting lines, rounded to steps."""
        on = x @ _normal(self.seed, x.shape[1], self.lines)
        return np.clip(np.rint(on / _STEP), -127, 127).astype(np.int8)

    def codes(self, x: np.ndarray, depth: int) -> np.ndarray:
        """For each unit vector a 64-bit name of its cell in every table."""
        n = self.tables(depth)
        if depth == 0:
            return np.zeros((len(x), 1), np.uint64)
        shift = np.random.default_rng(self.seed + 2).uniform(0, self.cell, n * depth)
        at = np.floor((x @ _normal(self.seed + 1, x.shape[1], n * depth) + shift) / self.cell).astype(np.int64).view(np.uint64).reshape(len(x), n, depth)
        out = np.tile(np.arange(1, n + 1, dtype=np.uint64), (len(x), 1))
        with np.errstate(over="ignore"):
            for k in range(depth):
                out = mix(out * np.uint64(0x9E3779B97F4A7C15) + at[:, :, k])
        return out


@lru_cache(maxsize=64)
def _normal(seed: int, rows: int, columns: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((rows, columns))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_length(vectors: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) for every length."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat, edge = vectors.flatten().to_numpy(), vectors.offsets.to_numpy()
    edge = edge - edge[0]
    size = np.diff(edge)
    for n in np.unique(size):
        at = np.flatnonzero(size == n)
        yield at, flat[edge[at][:, None] + np.arange(n)[None, :]]


def _first(nodes: list[int], seen: set) -> list[int]:
    """The places of nodes that were not seen yet: copies of a vector leave a task once."""
    out = []
    for i, n in enumerate(nodes):
        if n not in seen:
            seen.add(n)
            out.append(i)
    return out


def _blocks(table: pa.Table) -> Iterator[tuple[np.ndarray, bool]]:
    """The rows of each (cell, i, j) of a piece, every node once, and whether it is one chunk with itself."""
    cell, i, j, node = (table.column(c).to_numpy() for c in ("cell", "i", "j", "node"))
    order = np.lexsort((node, j, i, cell))
    c, a, b, n = cell[order], i[order], j[order], node[order]
    new = np.concatenate([[True], (c[1:] != c[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    keep = new.copy()
    keep[1:] |= n[1:] != n[:-1]
    order, new = order[keep], new[keep]
    edge = np.append(np.flatnonzero(new), len(order))
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        if hi - lo > 1:
            at = order[lo:hi]
            yield at, bool(i[at[0]] == j[at[0]])


def _windows(left: np.ndarray, right: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank, lo, size) on every line: the places of the right rows in the order of their projections, and the window that is centred at each left row's
    projection, as the place where it begins in this order and how many it holds."""
    n, line = len(right), np.arange(right.shape[1], dtype=np.int32)[:, None]
    values = right.T.astype(np.int32) + line * 1024  # all lines in one ascending sequence
    order = np.argsort(values, axis=1, kind="stable")
    rank = np.empty_like(order, dtype=np.uint16)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(n, dtype=np.uint16), order.shape), axis=1)
    ordered = np.take_along_axis(values, order, axis=1).ravel()
    centre = left.T.astype(np.int32) + line * 1024
    lo = np.searchsorted(ordered, (centre - steps).ravel()).reshape(centre.shape) - line * n
    hi = np.searchsorted(ordered, (centre + steps).ravel(), "right").reshape(centre.shape) - line * n
    return rank, lo.astype(np.uint16), (hi - lo).astype(np.uint16)


def _collisions(s: np.ndarray, own: np.ndarray, whole: bool, p: Lines) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with enough collisions, of one chunk (``whole``) or of two: the windows of each row are cut from the sorted projections, and the lines on which a
    pair's one lies in the window of the other are counted."""
    side = own == own[0]
    left, right = (np.arange(len(s)),) * 2 if whole else (np.flatnonzero(side), np.flatnonzero(~side))
    if not len(left) or not len(right):
        return
    rank, begin, size = _windows(s[left], s[right], p.steps)
    for lo in range(0, len(left), 256):
        some = slice(lo, lo + 256)
        from_ = lo if whole else 0
        count = np.zeros((len(left[some]), len(right) - from_), np.uint8)
        for r, b, n in zip(rank[:, from_:], begin[:, some], size[:, some], strict=True):
            count += (r[None, :] - b[:, None]) < n[:, None]  # unsigned: places before the window are far behind it
        close = count >= p.least
        if whole:
            close &= right[from_:][None, :] > left[some][:, None]
        a, b = np.nonzero(close)
        yield left[some][a], right[from_:][b]


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", lines: Lines = Lines()) -> DataFrame:
    """(key, n_links, component_id, kept) for every row."""
    v = col(vector)
    real = v.cast("array<double>")
    fit = col(label).isNotNull() & F.coalesce((F.size(real) > 0) & F.forall(real, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(real, lambda x: x != 0), F.lit(False))
    rows = df.select(col(key).alias("id"), F.xxhash64(col(label).cast("string")).alias("label"), v.alias("v"), F.when(fit, F.xxhash64(col(label).cast("string"), real)).alias("node"))
    good = rows.filter("node is not null")
    classes = durable(good.groupBy("node").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("label").alias("label")))
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    depth = lines.depth(most)

    @lean
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            batch = batch.take(pa.array(_first(batch.column(0).to_pylist(), seen), pa.int64()))
            node, name = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            for at, x in _by_length(batch.column(2)):
                x = _unit(x)
                codes = lines.codes(x, depth)
                n = codes.shape[1]
                cell = mix(codes ^ mix(name[at] + np.uint64(x.shape[1]))[:, None]).view(np.int64)
                raw = lines.sketch(x)
                sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(lines.lines), len(at) * n, [None, pa.py_buffer(np.repeat(raw, n, axis=0).tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(cell.reshape(-1)), pa.array(np.repeat(node[at], n)), sketch.cast(pa.binary())], names=["cell", "node", "sketch"])

    cells = good.select("node", "label", "v").mapInArrow(pack, "cell bigint, node bigint, sketch binary")
    sizes = durable(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").groupBy("m").agg(F.count(F.lit(1)).alias("n")))
    made = sizes.agg(F.sum(F.col("m") * F.col("n")).alias("rows"), F.sum(F.col("m") * F.col("m") * F.col("n")).alias("pairs")).first()
    crowded = (sizes.agg(F.max("m")).first()[0] or 0) > _CHUNK
    large = durable(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > _CHUNK).select(F.col("cell").alias("__c"), F.ceil(F.col("m") / _CHUNK).cast("int").alias("c"))) if crowded else None
    sent = _dealt(cells, large, made["rows"] or 0, made["pairs"] or 0)

    @lean
    def count(table: pa.Table) -> pa.Table:
        raw = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.int8).reshape(table.num_rows, lines.lines)
        own, node, cell = (table.column(c).to_numpy() for c in ("own", "node", "cell"))
        hit = np.zeros(table.num_rows, bool)
        for at, whole in _blocks(table):
            for a, b in _collisions(raw[at], own[at], whole, lines):
                hit[at[a]] = hit[at[b]] = True
        return pa.table({"cell": pa.array(cell[hit]), "node": pa.array(node[hit])})

    hits = durable(sent.groupBy("piece").applyInArrow(count, "cell bigint, node bigint").distinct())

    @lean
    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            yield batch.take(pa.array(_first(batch.column(0).to_pylist(), seen), pa.int64()))

    wanted = hits.select("node").distinct()
    vectors = good.select("node", "label", "v").mapInArrow(once, good.select("node", "label", "v").schema).join(wanted, "node", "left_semi").dropDuplicates(["node"])
    whole_ = hits.join(vectors.select(F.col("node").alias("__n"), "label", "v"), F.col("node") == F.col("__n")).join(classes.select(F.col("node").alias("__m"), "copies"), F.col("node") == F.col("__m")).drop("__n", "__m")
    full = hits.groupBy("cell").agg(F.count(F.lit(1)).alias("m"))
    work = full.agg(F.sum("m").alias("rows"), F.sum(F.col("m") * F.col("m")).alias("pairs"), F.max("m").alias("most")).first()
    large = durable(full.filter(F.col("m") > _CHUNK).select(F.col("cell").alias("__c"), F.ceil(F.col("m") / _CHUNK).cast("int").alias("c"))) if (work["most"] or 0) > _CHUNK else None
    sent = _dealt(whole_, large, 8 * (work["rows"] or 0), work["pairs"] or 0)

    @lean
    def verify(table: pa.Table) -> pa.Table:
        own, node, name, copies, cell = (table.column(c).to_numpy() for c in ("own", "node", "label", "copies", "cell"))
        vectors = table.column("v").combine_chunks()
        _, one, which = np.unique(node, return_index=True, return_inverse=True)
        out = [[np.zeros(0, np.int64)] for _ in range(3)]
        # what follows from a vector alone is worked out once for each in the piece
        held = [(one[at], _unit(x)) for at, x in _by_length(vectors.take(pa.array(one)))]
        kind, place = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        for k, (rows_, x) in enumerate(held):
            kind[which[rows_]], place[which[rows_]] = k, np.arange(len(x))
        held = [(x, lines.sketch(x), mix(lines.codes(x, depth) ^ mix(name[rows_].view(np.uint64) + np.uint64(x.shape[1]))[:, None]).view(np.int64)) for rows_, x in held]
        for at, whole in _blocks(table):
            for k in np.unique(kind[which[at]]):
                me = at[kind[which[at]] == k]
                if len(me) < 2 or (not whole and (own[me] == own[me[0]]).all()):
                    continue
                x, sketch, cells_ = (y[place[which[me]]] for y in held[k])
                table_ = (cells_ == cell[me][:, None]).argmax(axis=1)  # the table that this cell belongs to
                links, forest = np.zeros(len(me), np.int64), _Forest(len(me))
                for a, b in _collisions(sketch, own[me], whole, lines):
                    for lo in range(0, len(a), 1 << 15):
                        i, j = a[lo : lo + (1 << 15)], b[lo : lo + (1 << 15)]
                        # not found by an earlier table, of one label, and close
                        ok = ((cells_[i] == cells_[j]).argmax(axis=1) == table_[i]) & (name[me[i]] == name[me[j]])
                        i, j = i[ok], j[ok]
                        ok = np.einsum("ij,ij->i", x[i], x[j]) >= lines.cosine
                        i, j = i[ok], j[ok]
                        links += np.bincount(i, copies[me[j]], len(me)).astype(np.int64) + np.bincount(j, copies[me[i]], len(me)).astype(np.int64)
                        forest.join(i, j)
                has = np.flatnonzero(links > 0)
                for o, y in zip(out, (node[me[has]], links[has], node[me[forest.root[has]]]), strict=True):
                    o.append(y)
        return pa.table({c: pa.array(np.concatenate(o).astype(np.int64)) for c, o in zip(("node", "links", "root"), out, strict=True)})

    found = durable(sent.groupBy("piece").applyInArrow(verify, "node bigint, links bigint, root bigint"))
    links = found.groupBy(F.col("node").alias("__n")).agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    placed = classes.select("node", "least", "copies").join(links, F.col("node") == F.col("__n"), "left").join(comp.select(F.col("node").alias("__m"), "comp"), F.col("node") == F.col("__m"), "left")
    placed = durable(placed.select("node", "least", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "node").alias("comp")).filter("n_links > 0"))
    least = placed.groupBy(F.col("comp").alias("__c")).agg(F.min("least").alias("component"))
    named = durable(placed.join(least, F.col("comp") == F.col("__c")).select("node", "copies", "n_links", "component"))
    total = named.agg(F.sum("copies")).first()[0] or 0
    got = lookup(rows.select("id", "node"), named, "node", "copies", total)
    out = got.select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", col(key).eqNullSafe(F.col("component_id")))


class _Forest:
    """Roots of the connected groups of so many nodes: the smallest place in each."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            low = np.minimum(self.root[a], self.root[b])
            new = self.root.copy()
            for end in (a, b, self.root[a], self.root[b]):
                np.minimum.at(new, end, low)
            new = new[new]
            if (new == self.root).all():
                return
            self.root = new


def _dealt(rows: DataFrame, large: DataFrame | None, n: int, pairs: int) -> DataFrame:
    """rows (cell, node, ...) with own, i, j and piece: in cells that ``large`` (__c, c) cuts into c chunks, a row for each pair of chunks that has its own."""
    if large is None:
        out = rows.withColumn("own", F.lit(0)).withColumn("i", F.lit(0)).withColumn("j", F.lit(0))
    else:
        some = F.broadcast(large) if large.limit(_BROADCAST_CELLS + 1).count() <= _BROADCAST_CELLS else large
        out = rows.join(some, F.col("cell") == F.col("__c"), "left").drop("__c").withColumn("c", F.coalesce("c", F.lit(1)))
        out = out.withColumn("own", F.pmod(F.xxhash64("node", F.lit(1)), F.col("c")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        out = out.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("c", "other")
    pieces = max(16, n // _PIECE_ROWS, pairs // _PIECE_PAIRS)
    return out.withColumn("piece", F.pmod(F.xxhash64("cell", "i", "j"), F.lit(pieces)))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
