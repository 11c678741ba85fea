"""N-gram Jaccard join with token-combination prefixes.

A document's set holds the 64-bit hashes of its distinct 5-word shingles (A-Z lower-cased). Documents with the same set are one
class from the start; all that follows is about classes. Tokens (shingles) are ordered: those of the rare class by hash, then
those of the frequent class by hash. Sets r, s with Jaccard >= t share o >= t|r| tokens, so the first shared one stands
in the first |r| - ceil(t|r|) + 1 of either:

* if it is rare, both sets index that single token within this prefix;
* if it is frequent, no rare token is shared at all, so o tokens are shared among the frequent ones alone, and at most
  D = (1-t)/(1+t) (|r|+|s|) <= (1/t-1)|r| tokens aren't shared. Every unshared token spoils at most one gap between neighbouring
  shared tokens, so within the prefix, extended to (1/t-1)|r| + (1-t)|r| + 2 frequent tokens, some two shared tokens stand next to each
  other in both sets. It is enough to index combinations of neighbours, a number that is linear in the set's size, and only for
  sets of which a share t is frequent.

So no linked pair is missed, whatever class a token is put into; classes only govern the work. The frequent class holds every token
that at least tau documents have, counted over all tokens of all documents (by 32 bits of their hashes). tau follows from the
total number of tokens so that there are at most 2**22 frequent tokens: that list (16 MB at most) is broadcast.

Candidates: within the classes that share an index entry, each is first compared with one class of about its size (a star: as many
pairs as members; twice, with different centres). A pair whose sizes or set bitmaps already rule a link out is dropped; of the others, whole sets are compared. Verified links are closed to components, and then only members of one entry that are still in different components are compared with each other. After
that all pairs that share an entry have been compared or are known to be connected, so components are exact.

Defined results: a null text or one without words has an empty set (n_shingles 0) and links with nothing; fewer than five words make one
shingle; a null id is kept, and its component is the smallest id in the group that isn't null; repeated rows are copies of each other;
a table without rows gives none. Distinct sets are told apart by a 64-bit hash and their size.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.core import Words, components, discard, durable, lean, lookup, mix, plainly, rolling, slices, whole

SHINGLE = 5
#: Jaccard of at least PART / OF.
PART, OF = 75, 100
FREQUENT = 1 << 22
LEAST_FREQUENT = 64
#: Rounds of stars before the members of an entry that are still apart are all compared.
TURNS = 2
#: Tokens of a task that are sorted at once.
_FLUSH = 1 << 21


def sets_of(texts: pa.Array, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(texts, lower=True)
    grams, out = rolling(w.hash, k), []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        else:
            out.append(np.array([whole(w.hash[a:b])] if b > a else [], np.uint64))
    return out


def class_key(s: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed integer."""
    with np.errstate(over="ignore"):
        h = mix(np.array([np.sum(mix(s), dtype=np.uint64) + np.uint64(len(s))], np.uint64))
    return int(h.view(np.int64)[0])


def outline(s: np.ndarray) -> bytes:
    """A bitmap of a set: one bit per token by its highest bits, 2 to 4 bits for each token, a power of two in all."""
    bits = max(3, (2 * len(s) - 1).bit_length())
    out = np.zeros(1 << bits, bool)
    out[(s >> np.uint64(64 - bits)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def keyed_docs(docs: DataFrame, key: str, text: str, k: int = SHINGLE) -> DataFrame:
    """(id, hash, key, n, bits): text hash, class, set size and set bitmap of each document; key is null for empty sets."""
    src = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = sets_of(part.column(2), k)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([class_key(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([outline(s) if len(s) else None for s in sets], pa.binary())],
                    names=["id", "hash", "key", "n", "bits"],
                )

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, hash bigint, key bigint, n bigint, bits binary")


# ---------------------------------------------------------------------------------------------------------------------
# token frequencies


def _pack(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted distinct uint32 with counts: 16-bit gaps (65535: the gap is in a list) and the counts above one."""
    gaps = np.diff(values, prepend=np.uint32(0)).astype(np.uint32)
    wide, more = gaps >= 65535, np.flatnonzero(counts > 1).astype(np.uint32)
    head = np.array([len(values), wide.sum(), len(more)], np.uint32)
    return b"".join(x.tobytes() for x in (head, np.minimum(gaps, 65535).astype(np.uint16), gaps[wide], more, counts[more].astype(np.uint32)))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, w, m = np.frombuffer(data, np.uint32, 3)
    gaps = np.frombuffer(data, np.uint16, n, 12).astype(np.uint32)
    at = 12 + 2 * int(n)
    rest = np.frombuffer(data[at:], np.uint32)
    gaps[gaps == 65535] = rest[:w]
    counts = np.ones(n, np.int64)
    counts[rest[w : w + m]] = rest[w + m :]
    return np.cumsum(gaps, dtype=np.uint32), counts


def _bits(total: int, each: int = 1 << 21, least: int = 6) -> int:
    return min(20, max(least, math.ceil(math.log2(max(total, 1) / each)) if total > each else least))


def frequent_tokens(docs: DataFrame, text: str, total: int, k: int = SHINGLE) -> tuple[np.ndarray, int]:
    """The 32-bit token prefixes that at least tau documents have, sorted, and tau; at most FREQUENT of them."""
    tau = max(LEAST_FREQUENT, -(-total // FREQUENT))
    bits = _bits(total)

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            cut = np.searchsorted(values, np.arange(1 << bits, dtype=np.uint64) << np.uint64(32 - bits)).tolist() + [len(values)]
            full = [b for b in range(1 << bits) if cut[b] < cut[b + 1]]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([_pack(values[cut[b] : cut[b + 1]], counts[cut[b] : cut[b + 1]]) for b in full], pa.binary())], names=["bucket", "data"])

        for batch in batches:
            for part in slices(batch, "text"):
                for s in sets_of(part.column(0), k):
                    held.append((s >> np.uint64(32)).astype(np.uint32))
                    n += len(s)
                if n >= _FLUSH:
                    yield flush()
                    held, n = [], 0
        if n:
            yield flush()

    @lean
    def often(table: pa.Table) -> pa.Table:
        parts = [_unpack(x.as_py()) for x in table.column("data")]
        values = np.concatenate([p[0] for p in parts])
        order = np.argsort(values, kind="stable")
        values, counts = values[order], np.concatenate([p[1] for p in parts])[order]
        first = np.flatnonzero(np.diff(values, prepend=values[:1] + np.uint32(1)))
        keep = np.add.reduceat(counts, first) >= tau
        return pa.table({"token": pa.array(values[first][keep].astype(np.int64))})

    counted = docs.select(F.col(text).alias("text")).mapInArrow(count, "bucket int, data binary")
    found = durable(counted.groupBy("bucket").applyInArrow(often, "token bigint"))
    # at most FREQUENT rows: each stands for at least tau of the total number of tokens
    return np.sort(found.toArrow().column("token").to_numpy().astype(np.uint32)), tau


# ---------------------------------------------------------------------------------------------------------------------
# index entries


def entries(s: np.ndarray, frequent: np.ndarray, part: int = PART, of: int = OF) -> tuple[np.ndarray, np.ndarray]:
    """(single rare tokens, combinations of neighbouring frequent tokens) that a set is indexed under."""
    n = len(s)
    if len(frequent):
        high = (s >> np.uint64(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(frequent, high), len(frequent) - 1)
        often = frequent[at] == high
        rare, many = s[~often], s[often]
    else:
        rare, many = s, s[:0]
    need = -(-part * n // of)
    singles = rare[: n - need + 1]
    if len(many) < need or len(many) < 2:
        return singles, many[:0]
    reach = (of - part) * n // part + (n - need) + 2
    some = many[:reach]
    with np.errstate(over="ignore"):
        return singles, mix(some[:-1] * np.uint64(0x9E3779B97F4A7C15) + some[1:])


def index(docs: DataFrame, text: str, frequent: np.ndarray, total: int, k: int = SHINGLE, part: int = PART, of: int = OF) -> DataFrame:
    """(sig, key): index entries that at least two classes share (combinations: possibly shared).

    Single tokens are dealt by ranges of their hashes; none is in more than tau documents. Combinations may be in any number of documents, so they
    are not gathered by entry but dealt at random.
    """
    spark, bits = docs.sparkSession, _bits(total // 4)
    held_frequent = spark.sparkContext.broadcast(frequent)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, seen = held_frequent.value, set()
        sigs, keys, n = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            sig, key = np.concatenate(sigs), np.concatenate(keys)
            order = np.argsort(sig, kind="stable")
            sig, key = sig[order], key[order]
            cut = np.searchsorted(sig, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).tolist() + [len(sig)]
            full = [b for b in range(1 << bits) if cut[b] < cut[b + 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array([sig[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary()), pa.array([key[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary())],
                names=["bucket", "sigs", "keys"],
            )

        for batch in batches:
            for part_ in slices(batch, "text"):
                pairs = []
                for s in sets_of(part_.column(0), k):
                    if not len(s) or (key := class_key(s)) in seen:
                        continue
                    seen.add(key)  # one task's classes: 8 bytes for each of its documents
                    one, two = entries(s, often, part, of)
                    sigs.append(one)
                    keys.append(np.full(len(one), key, np.int64))
                    n += len(one)
                    if len(two):
                        pairs.append((two, np.full(len(two), key, np.int64)))
                if pairs:
                    spread = -1 - (int(pairs[0][1][0]) & 0xFFFF)
                    yield pa.RecordBatch.from_arrays([pa.array([spread], pa.int32()), pa.array([np.concatenate([p[0] for p in pairs]).tobytes()], pa.binary()), pa.array([np.concatenate([p[1] for p in pairs]).tobytes()], pa.binary())], names=["bucket", "sigs", "keys"])
                if n >= _FLUSH:
                    yield from flush()
                    sigs, keys, n = [], [], 0
        if n:
            yield from flush()

    @lean
    def shared(table: pa.Table) -> pa.Table:
        sig = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("sigs")])
        key = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("keys")])
        if table.column("bucket")[0].as_py() < 0:
            return pa.table({"sig": pa.array(sig.view(np.int64)), "key": pa.array(key)})
        order = np.lexsort((key, sig))
        sig, key = sig[order], key[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])
        sig, key = sig[new], key[new]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        size = np.diff(np.append(first, len(sig)))
        with np.errstate(over="ignore"):  # entries with the same members say the same: one of them is enough
            lists = np.add.reduceat(mix(key.view(np.uint64)), first) ^ mix(size.astype(np.uint64))
        one = np.zeros(len(first), bool)
        one[np.unique(lists, return_index=True)[1]] = True
        keep = np.repeat(one & (size > 1), size)
        return pa.table({"sig": pa.array(sig[keep].view(np.int64)), "key": pa.array(key[keep])})

    made = docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, sigs binary, keys binary")
    return durable(made.groupBy("bucket").applyInArrow(shared, "sig bigint, key bigint"))


def groups(raw: DataFrame, classes: DataFrame, part: int = PART, of: int = OF) -> DataFrame:
    """(sig, key, n, band) of entries with two classes or more, one entry for each list of members. Sets of one band differ by less
    than a factor of/part in size."""
    own = durable(raw.distinct())
    lists = own.groupBy("sig").agg(F.count(F.lit(1)).alias("m"), F.min("key").alias("lo"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")).filter("m > 1")
    one = durable(lists.groupBy("m", "lo", "x", "y").agg(F.min("sig").alias("sig")).select("sig", "m", F.lit(True).alias("one")))
    kept = lookup(own, one, "sig", "m", own.count()).filter("one").drop("one").join(classes.select(F.col("key").alias("__k"), "n"), F.col("key") == F.col("__k"))
    kept = durable(kept.select("sig", "key", "n", F.floor(F.log("n") / math.log(of / part)).alias("band")))
    for table in (own, one):
        discard(table)
    return kept


def stars(placed: DataFrame, turn: int) -> DataFrame:
    """(a, b): in each entry and band, one class (another each turn) with all those of other components: as many pairs as members."""
    first = F.min(F.struct(F.xxhash64("key", F.lit(turn)), F.col("key").alias("lead"), F.col("comp").alias("lead_comp")))
    rows = placed.select("key", "comp", F.xxhash64("sig", "band").alias("place"))
    leads = durable(rows.groupBy("place").agg(first.alias("f"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("place", "m", "f.lead", "f.lead_comp"))
    rays = lookup(rows, leads, "place", "m", placed.count()).filter("comp <> lead_comp")
    return durable(rays.select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b")).distinct())


#: Members of an entry that are compared with each other in one piece.
_CHUNK = 2048


def across(placed: DataFrame, outlines: DataFrame, part: int = PART, of: int = OF) -> DataFrame:
    """(a, b): the pairs of classes that share an entry and are in different components, but for those that sizes or bitmaps
    rule out; each pair once.

    Members are put into cells of two neighbouring bands, each pair of sizes that fits in one cell alone; cells without two
    components fall away. The members of a cell are compared in place, by products of their bitmap matrices, and only what is left becomes rows. Cells
    with many members are cut into chunks, and every pair of chunks is a piece of work of its own. A pair that shares
    several entries is left once: within a piece at once, then among the packed lists of pairs that the pieces give.
    """
    celled = placed.withColumn("cell", F.explode(F.array(F.col("band"), F.col("band") + 1))).withColumn("top", F.col("band") == F.col("cell"))
    celled = celled.select("key", "n", "comp", "top", F.xxhash64("sig", "cell").alias("place"))
    several = celled.groupBy("place").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m"), F.max("top").alias("any"))
    several = durable(several.filter("lo <> hi and any").select("place", "m", F.ceil(F.col("m") / _CHUNK).cast("int").alias("c")))
    rows = durable(lookup(celled, several, "place", "m", 2 * placed.count()).filter("c is not null"))
    full = rows.join(outlines.select(F.col("key").alias("__k"), "bits"), F.col("key") == F.col("__k"))
    own = F.pmod(F.xxhash64("key"), F.col("c")).cast("int")
    full = full.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    full = full.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    full = full.withColumn("work", F.xxhash64("place", "i", "j"))
    pieces = max(16, rows.count() // 8192)
    parts = max(16, pieces // 4)
    full = full.withColumn("piece", F.pmod(F.col("work"), F.lit(pieces)))

    @lean
    def compare(table: pa.Table) -> pa.Table:
        work, key, n, comp, i, j, own_, top = (table.column(x).to_numpy() for x in ("work", "key", "n", "comp", "i", "j", "own", "top"))
        bits = table.column("bits").combine_chunks()
        order = np.argsort(work, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], np.diff(work[order]) != 0, [True]]))
        out = []
        for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            at = order[lo:hi]
            whole_ = i[at[0]] == j[at[0]]
            length = np.array([len(bits[int(x)].as_buffer()) for x in at])
            for short in np.unique(length):
                left = at[length == short]
                maps = _matrix(bits, left, int(short))
                for long in (short, 2 * short):
                    right = at[length == long]
                    if not len(right):
                        continue
                    more = maps if long == short else _matrix(bits, right, int(short))
                    both = maps @ more.T
                    both = np.minimum(n[left][:, None] - maps.sum(1)[:, None] + both, n[right][None, :] - more.sum(1)[None, :] + both)
                    ok = of * both >= part * (n[left][:, None] + n[right][None, :] - both)
                    ok &= (comp[left][:, None] != comp[right][None, :]) & (top[left][:, None] | top[right][None, :])
                    if not whole_:
                        ok &= own_[left][:, None] != own_[right][None, :]
                    if long == short:
                        ok = np.triu(ok, 1)
                    x, y = np.nonzero(ok)
                    x, y = key[left[x]], key[right[y]]
                    out.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
        to = (mix(pairs[:, 0].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
        return pa.table({"part": pa.array(np.unique(to)), "pairs": pa.array([pairs[to == t].tobytes() for t in np.unique(to)], pa.binary())})

    @lean
    def once(table: pa.Table) -> pa.Table:
        pairs = np.unique(np.concatenate([np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 2) for x in table.column("pairs")]), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    found = full.select("piece", "work", "key", "n", "comp", "i", "j", "own", "top", "bits").groupBy("piece").applyInArrow(compare, "part bigint, pairs binary")
    return found.groupBy("part").applyInArrow(once, "a bigint, b bigint")


def _matrix(bits: pa.Array, at: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps as rows of 0 and 1, folded to ``size`` bytes."""
    rows = np.stack([np.unpackbits(np.frombuffer(bits[int(x)].as_buffer(), np.uint8)) for x in at])
    return rows.reshape(len(at), size * 8, -1).max(axis=2).astype(np.float32)


# ---------------------------------------------------------------------------------------------------------------------
# verification

#: Fewest and most bits of a bitmap of keys: 8 MB to 128 MB, whatever the input; eight bits for each key in between.
LEAST_BITS, MOST_BITS = 1 << 26, 1 << 30


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """A bitmap of the keys (one bigint column), made by the tasks and joined in one. With more than a billion keys it fills up, and keeps less out;
    it never decides anything."""
    n = keys.count()
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * n).bit_length()))

    @lean
    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for column in batch.columns:
                at = column.to_numpy(zero_copy_only=False).view(np.uint64) & np.uint64(size - 1)
                np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"bits": pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())})

    @lean
    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            for x in batch.column(0):
                bits |= np.frombuffer(zlib.decompress(x.as_py()), np.uint8)
        yield pa.RecordBatch.from_pydict({"bits": pa.array([zlib.compress(bits.tobytes(), 1)], pa.binary())})

    row = keys.coalesce(32).mapInArrow(own, "bits binary").coalesce(1).mapInArrow(both, "bits binary").first()
    return np.frombuffer(zlib.decompress(bytes(row["bits"])), np.uint8)


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys.view(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def apart(rows: DataFrame, hashed: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows in two parts: those whose hash may be one of the keys (one bigint column), and those whose hash surely isn't: what a join with the keys
    would do nothing to needs no shuffle, however long its texts are. Only hashes go to Python."""
    bits = rows.sparkSession.sparkContext.broadcast(bitmap_of(keys))

    @F.arrow_udf("boolean")
    def may(hashes: pa.Array) -> pa.Array:
        return pa.array(in_bitmap(bits.value, hashes.to_numpy(zero_copy_only=False)))

    return rows.filter(may(hashed)), rows.filter(~may(hashed))


#: Pairs that a piece of work should hold, and members of one star that go to one piece at least.
_PAIRS, _RAYS = 2048, 8192


def compared(pairs: DataFrame, held: DataFrame, alike: Callable[[Callable[[int], tuple], np.ndarray, np.ndarray], np.ndarray], columns: list[str]) -> DataFrame:
    """The pairs (a, b), a written table, that ``alike`` accepts; held is (key, *columns), a row per class.

    Pairs are dealt into pieces, and what is held of a class goes to each piece that needs it once, however many pairs it has there: a star's
    centre, whatever number of rays it has, is not carried along with each. A star is dealt over several pieces.
    """
    n = pairs.count()
    pieces, parts = max(16, n // _PAIRS), max(16, n // _RAYS)
    dealt = pairs.select("a", "b", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), F.lit(parts))), F.lit(pieces)).alias("piece"))
    need = dealt.select("piece", F.col("a").alias("key")).unionByName(dealt.select("piece", F.col("b").alias("key"))).distinct()
    many = need.groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    weighed = many.join(held.select("key", *columns), "key")
    sent = lookup(need, weighed, "key", "m", 2 * n).withColumnRenamed("piece", "to")

    @lean
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
        place = {k: i for i, k in enumerate(right.column("key").to_pylist())}
        values = [right.column(c).combine_chunks() for c in columns]

        @functools.cache
        def of(key: int) -> tuple:
            return tuple(v[place[key]] for v in values)

        keep = pa.array(alike(of, a, b))
        return pa.table({"a": left.column("a").filter(keep), "b": left.column("b").filter(keep)})

    return dealt.groupBy("piece").cogroup(sent.groupBy("to")).applyInArrow(run, "a bigint, b bigint")


def promising(pairs: DataFrame, outlines: DataFrame, part: int = PART, of: int = OF) -> DataFrame:
    """The pairs (a, b) whose bitmaps don't rule a link out: a token whose bit the other set lacks isn't shared.

    Bitmaps of different lengths are compared at the shorter one's (a bit there stands for a run of bits of the longer).
    """

    def alike(get: Callable[[int], tuple], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            (m, r), (n, s) = ((int(v[0].as_py()), np.unpackbits(np.frombuffer(v[1].as_buffer(), np.uint8))) for v in (get(x), get(y)))
            if of * min(m, n) < part * max(m, n):
                continue
            low = min(len(r), len(s))
            r, s = r.reshape(low, -1).any(axis=1), s.reshape(low, -1).any(axis=1)
            both = min(m - int((r & ~s).sum()), n - int((s & ~r).sum()))
            keep[i] = of * both >= part * (m + n - both)
        return keep

    return compared(pairs, outlines, alike, ["n", "bits"])


def sets_for(docs: DataFrame, text: str, classes: DataFrame, pairs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(key, tokens binary): the sets of the classes in pairs, one row each.

    A bitmap of text hashes keeps the texts of other documents out of what follows; the join is what decides.
    """
    wanted = durable(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct())
    hashes = classes.join(wanted, "key", "left_semi").select("hash")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(hashes))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, seen = bits.value, set()
        for batch in batches:
            for part in slices(batch.filter(pa.array(in_bitmap(have, batch.column(0).to_numpy()))), "text"):
                keys, data = [], []
                for h, s in zip(part.column(0).to_pylist(), sets_of(part.column(1), k), strict=True):
                    if h not in seen and len(s):
                        seen.add(h)
                        keys.append(class_key(s))
                        data.append(s.tobytes())
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(data, pa.binary())], names=["key", "tokens"])

    got = docs.select(F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text")).mapInArrow(run, "key bigint, tokens binary")
    out = durable(got.join(wanted, "key", "left_semi").dropDuplicates(["key"]))
    discard(wanted)
    return out


def verify(pairs: DataFrame, sets: DataFrame, part: int = PART, of: int = OF) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard of at least part/of; whole sets are compared."""

    def alike(get: Callable[[int], tuple], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
            s, t = (np.frombuffer(get(k)[0].as_buffer(), np.uint64) for k in (x, y))
            if len(s) > len(t):
                s, t = t, s
            at = np.minimum(np.searchsorted(t, s), len(t) - 1)
            both = int((t[at] == s).sum())
            keep[i] = of * both >= part * (len(s) + len(t) - both)
        return keep

    return compared(pairs, sets, alike, ["tokens"])


def class_links(docs: DataFrame, text: str, classes: DataFrame, outlines: DataFrame, total: int, k: int = SHINGLE, part: int = PART, of: int = OF) -> DataFrame:
    """(a, b): links between classes that close to the exact components."""
    frequent, _ = frequent_tokens(docs, text, total, k)
    raw = index(docs, text, frequent, total, k, part, of)
    group = groups(raw, classes, part, of)
    discard(raw)

    def linked(pairs: DataFrame, sure: bool = False) -> DataFrame:
        some = durable(pairs if sure else promising(pairs, outlines, part, of))
        sets = sets_for(docs, text, classes, some, k)
        found = durable(verify(some, sets, part, of))
        for table in (some, sets):
            discard(table)
        return found

    placed, links, tried = group.withColumn("comp", F.col("key")), None, []
    for turn in range(TURNS):
        tried.append(stars(placed, turn))
        found = linked(tried[-1])
        links = found if links is None else links.unionByName(found)
        comp, old = components(links), placed
        placed = durable(group.join(comp.select(F.col("node").alias("__k"), "comp"), F.col("key") == F.col("__k"), "left").select("sig", "key", "n", "band", F.coalesce("comp", "key").alias("comp")))
        if turn:
            discard(old)
    rest = across(placed, outlines, part, of)
    for pairs in tried:
        rest = rest.join(pairs, ["a", "b"], "left_anti")
    return links.unionByName(linked(rest, True))


def resolved(docs: DataFrame, key: str, text: str, k: int, part: int, of: int) -> DataFrame:
    """(id, hash, key, n, component_id, component_hash) for every document: of its group, the smallest id (null if all are) and among the
    documents with this id the smallest text hash. Documents without tokens are groups of their own."""
    keyed = durable(keyed_docs(docs, key, text, k))
    total = keyed.agg(F.sum("n")).first()[0] or 0
    classes = durable(keyed.filter("key is not null").groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "hash")).alias("least"), F.max("n").alias("n"), F.min("hash").alias("hash"), F.count(F.lit(1)).alias("copies")))
    outlines = durable(keyed.select("hash", "n", "bits").dropDuplicates(["hash"]).join(classes.select("hash", "key"), "hash").select("key", "n", "bits"))
    comp = components(class_links(docs, text, classes, outlines, total, k, part, of))
    placed = classes.join(comp.select(F.col("node").alias("key"), "comp"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
    least = placed.groupBy("comp").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("m"), F.sum("copies").alias("docs"))
    # alone: the id is its own component and needs no lookup
    named = placed.drop("least").join(least.filter("docs > 1"), "comp").select("key", F.col("least.id").alias("component_id"), F.col("least.hash").alias("component_hash"), "copies")
    named = durable(named)
    rows = lookup(keyed.select("id", "hash", "key", "n"), named, "key", "copies", keyed.count())
    return rows.select("id", "hash", "key", "n", F.coalesce("component_id", "id").alias("component_id"), F.coalesce("component_hash", "hash").alias("component_hash"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = SHINGLE, part: int = PART, of: int = OF) -> DataFrame:
    """(key, n_shingles, component_id) for every document: the smallest id reachable by links, itself included."""
    return resolved(docs, key, text, k, part, of).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, that with the smallest id (null after all others) and of those the smallest text hash; of rows that agree
    in id and text, one. Groups are told apart by their texts, so ids that are null or shared lose none. Texts without tokens and without an
    id all stay. Columns stay as they are."""
    rows, (k, t) = plainly(docs, key, text)
    found = durable(resolved(rows, k, t, SHINGLE, PART, OF))
    gone = found.filter(~F.col("id").eqNullSafe(F.col("component_id")) | (F.col("hash") != F.col("component_hash"))).select(F.col("id").alias("__id"), F.col("hash").alias("__h")).distinct()
    of = (F.xxhash64(t) == F.col("__h")) & F.col(k).eqNullSafe(F.col("__id"))
    gone = durable(gone)
    some, rest = apart(rows, F.xxhash64(t), gone.select("__h"))
    kept = some.join(gone, of, "left_anti").unionByName(rest)
    twice = found.filter("(id is not null or key is not null) and id <=> component_id and hash = component_hash").groupBy("id", "hash").count().filter("count > 1").select(F.col("id").alias("__id"), F.col("hash").alias("__h"))
    twice = durable(twice)
    if twice.limit(1).count():
        again = kept.join(twice, of).dropDuplicates(["__id", "__h"])
        kept = kept.join(twice, of, "left_anti").unionByName(again.drop("__id", "__h"))
    return kept.toDF(*docs.columns)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
