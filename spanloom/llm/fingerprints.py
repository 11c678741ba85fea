"""Document fingerprints from prefix polynomial hashes.

The code points of all texts of a batch are one sequence, over which two arrays of prefix hashes are held, each modulo a prime below 2^31. With them
any two spans are compared in constant time (``Prefixes.equal``), and the longest common extension of any two places is found by binary search over
its length (``Prefixes.extension``); both work on whole arrays of questions.

A fingerprint is ``<length>-<hash of the whole text>-<sketch>`` in hexadecimal. The sketch holds a byte for each of 128 bins: of the spans of WINDOW code
points that end at each place of the text (shorter ones at its beginning, so that every text has as many as code points), whose hashes the prefix arrays
give, each bin keeps the smallest; 0 says that it is empty. The likeness of two fingerprints is 1 if length and hash are equal; otherwise the share of
spans that two texts have in common (twice the common ones over all), as the bins that agree estimate it.

``neighbours`` puts documents into descending order of their ids, each beside the next, by one range shuffle: tasks hold one document of a
partition besides the batch at hand, and only the first and the last document of each partition meet those of other partitions, in a second small join.

Defined results: a null text is empty; an empty one has length 0 and no spans, so it is like another empty one (1) and unlike all others (0). Null ids
come last; rows that share an id follow each other by a hash of their texts, rows that agree in both in any order, which gives the same rows of
results. After the last comes the first; a single row is its own next. An empty table gives no rows. Names of other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.core import col, durable, lean, mix, slices

#: (prime, base): two of them, so that unlike spans agree by chance once in 2^61 or so.
MODULI = ((2147483647, 1020847469), (2147483629, 1683972061))
WINDOW, BINS = 32, 128
_RUN = 1 << 12


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after another, and where each text's begin."""
    raw = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    at = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=at[1:])
    return (np.concatenate(raw) if raw else np.zeros(0, np.uint32)), at


def power(base: int, exponent, prime: int) -> np.ndarray:
    """base to each exponent, modulo the prime."""
    e = np.asarray(exponent, np.int64)
    out, square = np.ones(e.shape, np.uint64), base
    for bit in range(int(e.max(initial=0)).bit_length()):
        out = np.where(e >> bit & 1, out * np.uint64(square) % np.uint64(prime), out)
        square = square * square % prime
    return out


def _tables(prime: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    steps = np.arange(1, _RUN + 1)
    return power(base, steps, prime), power(pow(base, -1, prime), steps, prime)


_TABLES = [_tables(*m) for m in MODULI]


class Prefixes:
    """Prefix hashes of a sequence of code points: ``at[m][i]`` is that of the first i, modulo the m-th prime."""

    def __init__(self, points: np.ndarray):
        self.at = []
        for (prime, _), (up, down) in zip(MODULI, _TABLES, strict=True):
            p, out, before = np.uint64(prime), np.zeros(len(points) + 1, np.uint32), np.uint64(0)
            for i in range(0, len(points), _RUN):
                some = points[i : i + _RUN].astype(np.uint64) + np.uint64(1)
                n = len(some)
                sums = np.cumsum(some * down[:n] % p) % p  # of up to 2^12 residues below 2^31
                run = (sums + before) % p * up[:n] % p
                out[i + 1 : i + 1 + n] = run
                before = run[-1]
            self.at.append(out)

    def __len__(self) -> int:
        return len(self.at[0]) - 1

    def span(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """The hash of each span, modulo each prime; equal spans have equal ones wherever they stand."""
        n = np.asarray(end) - start
        return [_less(a[end], a[start], power(base, n, prime), prime) for a, (prime, base) in zip(self.at, MODULI, strict=True)]

    def equal(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n code points from a on are those from b on."""
        return np.logical_and.reduce([x == y for x, y in zip(self.span(a, a + n), self.span(b, b + n), strict=True)])

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The length of the longest common extension of the places a and b, up to ``most``: by binary search, from the largest power of two down."""
        a, b, most = (np.asarray(x, np.int64) for x in (a, b, most))
        got = np.zeros(a.shape, np.int64)
        for bit in reversed(range(int(most.max(initial=0)).bit_length())):
            fits = got + (1 << bit) <= most
            n = np.where(fits, 1 << bit, 0)
            got += np.where(fits & self.equal(a + np.where(fits, got, 0), b + np.where(fits, got, 0), n), 1 << bit, 0)
        return got

    def windows(self, first: np.ndarray, begin: np.ndarray, size: int = WINDOW) -> np.ndarray:
        """A 64-bit hash of the span of ``size`` code points that ends behind each place (``first``), but begins no earlier than ``begin``."""
        start = np.maximum(first + 1 - size, begin)
        n = first + 1 - start
        (p1, b1), (p2, b2) = MODULI
        one, two = (_less(a[first + 1], a[start], power(b, np.arange(size + 1), p)[n], p) for a, b, p in ((self.at[0], b1, p1), (self.at[1], b2, p2)))
        return mix(one << np.uint64(31) | two)


def _less(end: np.ndarray, start: np.ndarray, shift: np.ndarray, prime: int) -> np.ndarray:
    p = np.uint64(prime)
    return (end.astype(np.uint64) + p - start.astype(np.uint64) * shift % p) % p


_EDGES = np.arange(BINS, dtype=np.uint64) << np.uint64(57)
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _least(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash in each bin (the first seven bits), _NONE in empty ones."""
    ordered = np.sort(hashes)
    at = np.searchsorted(ordered, _EDGES)
    out = np.append(ordered, _NONE)[at]
    return np.where(np.append(at[1:], len(ordered)) > at, out, _NONE)


def _bytes(least: np.ndarray) -> np.ndarray:
    return np.where(least == _NONE, 0, (least & np.uint64(0xFFFFFFFF)) % np.uint64(255) + np.uint64(1)).astype(np.uint8)


def alike(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sketches: the estimated share of common spans."""
    some = int(((a > 0) | (b > 0)).sum())
    same = int(((a == b) & (a > 0)).sum()) / some if some else 1.0
    jaccard = max(0.0, (same - 1 / 255) / (1 - 1 / 255))  # bytes of unlike spans agree once in 255
    return 2 * jaccard / (1 + jaccard)


def likeness(a: str, b: str) -> float:
    """Of two fingerprints."""
    (one, x), (two, y) = a.rsplit("-", 1), b.rsplit("-", 1)
    return 1.0 if one == two else alike(*(np.frombuffer(bytes.fromhex(s), np.uint8) for s in (x, y)))


def likeness_of(a: Column, b: Column) -> Column:
    """Of two columns of fingerprints; null where one is."""
    f = F.pandas_udf(lambda x, y: pd.Series([None if p is None or q is None else likeness(p, q) for p, q in zip(x, y, strict=True)], dtype="float64"), "double")
    return f(a, b)


def _name(n: int, whole: tuple[int, int], sketch: np.ndarray) -> str:
    return f"{n:x}-{whole[0]:08x}{whole[1]:08x}-{sketch.tobytes().hex()}"


#: What ``compared`` gives of each text but the last.
RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix bigint, next_prefix bigint"
_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def compared(texts: list[str], share: int = 3) -> list[tuple]:
    """For each of two texts or more but the last, and the one after it: fingerprints of the text and of its edited form, whose last one in ``share`` code points are replaced by
    the next text's first ones, their likeness and the next text's, and how far both agree with the text from its beginning (common extensions)."""
    points, at = codes(texts)
    size = np.diff(at)
    held = Prefixes(points)
    owner = np.repeat(np.arange(len(texts)), size)
    hashes = held.windows(np.arange(len(points)), at[owner])
    whole = list(zip(*(h.tolist() for h in held.span(at[:-1], at[1:])), strict=True))
    n, follow, here, there = size[:-1], size[1:], at[:-2], at[1:-1]
    tail = n // share
    keep, took = n - tail, np.minimum(tail, follow)
    # what is new in an edited text, behind as much of the old as its spans reach into
    back = np.minimum(keep, WINDOW - 1)
    patches = [np.concatenate([points[a + k - b : a + k], points[c : c + t]]) for a, k, b, c, t in zip(here, keep, back, there, took, strict=True)]
    begin = np.concatenate([[0], np.cumsum(back + took)])
    fresh = Prefixes(np.concatenate(patches))
    new = fresh.windows(np.arange(len(fresh)), np.repeat(begin[:-1], back + took))
    # hash of the edited text: that of the kept part, shifted, and that of the next text's beginning
    kept, added = held.span(here, here + keep), held.span(there, there + took)
    joined = [((k * power(base, took, prime) + a) % np.uint64(prime)).tolist() for k, a, (prime, base) in zip(kept, added, MODULI, strict=True)]
    common = keep + held.extension(here + keep, there, took)
    both = held.extension(here, there, np.minimum(n, follow))
    last = _bytes(_least(hashes[at[-2] :]))
    out, sketches = [], []
    for i in range(len(n)):
        head, rest = _least(hashes[at[i] : at[i] + keep[i]]), _least(hashes[at[i] + keep[i] : at[i + 1]])
        sketches.append((_bytes(np.minimum(head, rest)), _bytes(np.minimum(head, _least(new[begin[i] + back[i] : begin[i + 1]])))))
    for i, (own, other) in enumerate(sketches):
        ahead = sketches[i + 1][0] if i + 1 < len(sketches) else last
        edited = texts[i][: keep[i]] + texts[i + 1][: took[i]]
        length = int(keep[i] + took[i])
        h = (joined[0][i], joined[1][i])
        near = 1.0 if (length, h) == (int(n[i]), whole[i]) else alike(own, other)
        near_next = 1.0 if (int(follow[i]), whole[i + 1]) == (int(n[i]), whole[i]) else alike(own, ahead)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        out.append((int(n[i]), digest, _name(int(n[i]), whole[i], own), _name(length, h, other), near, near_next, int(common[i]), int(both[i])))
    return out


#: In tables that are written, digests and fingerprints are bytes, half as long.
_HELD = RESULT.replace("string", "binary")


def _columns(rows: list[tuple]) -> list[pa.Array]:
    """The columns of _HELD."""
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
    raw = lambda i, x: x if x is None or i not in (1, 2, 3) else bytes.fromhex(x) if i == 1 else _bytes_of(x)
    return [pa.array([raw(i, r[i]) for r in rows], k) for i, k in enumerate(kinds)]


def _bytes_of(name: str) -> bytes:
    n, whole, sketch = name.split("-")
    return int(n, 16).to_bytes(8, "big") + bytes.fromhex(whole) + bytes.fromhex(sketch)


def _name_of(raw: Column) -> Column:
    """The fingerprint of such bytes."""
    digits = F.lower(F.hex(raw))
    return F.concat_ws("-", F.regexp_replace(F.substring(digits, 1, 16), "^0+(?=.)", ""), F.substring(digits, 17, 16), F.substring(digits, 33, 2 * BINS))


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, common_prefix, next_prefix) of every row."""
    src = docs.select(col(key).alias("k"), F.coalesce(col(text), F.lit("")).alias("t"))
    src = src.withColumn("h", F.xxhash64("t"))
    order = [F.col("k").desc_nulls_last(), F.col("h")]
    kind = src.schema["k"].dataType.simpleString()
    ordered = src.repartitionByRange(*order).sortWithinPartitions(*order).select("k", "t")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, carry, k_type = TaskContext.get().partitionId(), None, None

        def edge(at: str, key: pa.Scalar, text: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([part], pa.int64()), pa.array([key.as_py()], k_type), pa.array([text], pa.string()), *_columns([(None,) * len(_NAMES)])], names=["at", "part", "k", "t", *_NAMES])

        for batch in batches:
            k_type = batch.column(0).type
            for some in slices(batch, "t"):
                keys, texts = some.column(0), some.column(1).to_pylist()
                if carry is None:
                    yield edge("head", keys[0], texts[0])
                else:
                    keys, texts = pa.concat_arrays([pa.array([carry[0].as_py()], k_type), keys]), [carry[1], *texts]
                carry = (keys[len(texts) - 1], texts[-1])
                n = len(texts) - 1
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(["row"] * n), pa.array([part] * n, pa.int64()), keys.slice(0, n), pa.nulls(n, pa.string()), *_columns(compared(texts))], names=["at", "part", "k", "t", *_NAMES])
        if carry is not None:
            yield edge("tail", *carry)

    done = durable(ordered.mapInArrow(run, f"at string, part bigint, k {kind}, t string, {_HELD}"))
    heads = done.filter("at = 'head'").select(F.col("part").alias("p"), F.col("t").alias("u"))
    # a row per partition
    every = W.orderBy("p").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = heads.select("p", F.coalesce(F.lead("p").over(W.orderBy("p")), F.min("p").over(every)).alias("q"))
    ends = done.filter("at = 'tail'").select("part", "k", "t").join(after, F.col("part") == F.col("p")).drop("p").join(heads, F.col("q") == F.col("p")).select("k", "t", "u")

    @lean
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [compared([t, u])[0] for t, u in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(rows)], names=["k", *_NAMES])

    rows = done.filter("at = 'row'").select("k", *_NAMES).unionByName(ends.mapInArrow(meet, f"k {kind}, {_HELD}"))
    shown = {"edited_sha256": F.lower(F.hex("edited_sha256")), "fingerprint": _name_of(F.col("fingerprint")), "edited_fingerprint": _name_of(F.col("edited_fingerprint"))}
    return rows.select(F.col("k").alias(key), *[shown.get(c, F.col(c)).alias(c) for c in _NAMES])


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/documents.parquet"))
