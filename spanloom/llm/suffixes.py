"""Passages of ``width`` words or more that occur before, in another document or the same, found at content-selected suffixes.

Of all suffixes of all texts only those at minimiser positions are retained: in every window of ``width`` words the 8-word gram with
the smallest hash. Equal windows select the same gram, so a repeated passage always meets at a retained suffix, and a gram that was
selected only once in the corpus (nearly all are) needs no further look.

Where a selected gram occurs again, its suffixes are sorted by the words that follow and compared with their neighbours: what two suffixes of that order have in
common to the right is the least that neighbours between them have. A window whose gram stands ``o`` words behind its beginning repeats another one if the two suffixes agree in the
``width - o`` words to the right, so if they are in one run of neighbours that do, and in the ``o`` words to the left; within a run the matches are extended left word by
word. The partner may be any suffix of the run (near copies differ to the left of what neighbours share), so a run is compared as a whole and not only the next in order.
Every window but the first in order of (id, position) is a repeat; touching repeats join to passages.

So exactly the windows of ``width`` words that occurred before are found (words are compared by 64-bit hashes, left contexts by a hash of them). Suffixes with the same words
around them are merged in each task first, and dealt by the hash of their gram. A gram that more than HOT selected places share would be a task of its own: its windows are dealt
apart, each by the hash of its words, and compared by that; which of the two a gram goes by changes no result.

Defined results: a null text has no words; texts under ``width`` words never repeat; a document whose words are those of one with a
smaller id is a repeat as a whole; rows that agree in id and text are one document; ids are integers (other types are refused); a null id comes after
all others; white space between words doesn't matter, case does; extra columns don't matter; a table without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.core import Words, durable, lean, lookup, mix, plainly, rolling, slices, whole
from spanloom.llm.neardup import _bits, apart, bitmap_of, in_bitmap

WIDTH, GRAM = 50, 8
#: Selected places of a gram up to which its suffixes are sorted in one task (600 bytes each).
HOT = 4096
_LAST = np.iinfo(np.int64).max
_FLUSH = 1 << 20


def _where_least(x: np.ndarray, width: int) -> np.ndarray:
    """Where each window of a sequence has its minimum, for the first time."""
    at, span = np.arange(len(x)), 1
    first = lambda a, b: np.where(x[a] <= x[b], a, b)
    while 2 * span <= width:
        at, span = first(at[:-span], at[span:]), 2 * span
    return first(at[: len(at) - (width - span)], at[width - span :]) if width > span else at


def _window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all windows of a hash sequence, by doubling; the last two parts overlap."""
    span = 1
    with np.errstate(over="ignore"):
        while 2 * span <= width:
            h, span = mix(h[:-span] * np.uint64(0x9E3779B97F4A7C15) + h[span:]), 2 * span
        if width > span:
            h = mix(h[: len(h) - (width - span)] * np.uint64(0xC2B2AE3D27D4EB4F) + h[width - span :])
    return h


class Windows:
    """The windows of a batch of texts: start word, owner, selected gram and its place, and hash on demand."""

    def __init__(self, texts: pa.Array, width: int = WIDTH, gram: int = GRAM):
        self.words, self.width = Words(texts), width
        first, h = self.words.first, self.words.hash
        owner = np.repeat(np.arange(len(self.words)), np.diff(first))
        if len(h) < width:
            self.start = self.owner = self.place = np.zeros(0, np.int64)
            self.pick = np.zeros(0, np.uint64)
            self.twice = np.zeros(0, bool)
            return
        self.start = np.flatnonzero(owner[: len(h) - width + 1] == owner[width - 1 :])
        self.owner = owner[self.start]
        grams = rolling(h, gram)
        self.place = _where_least(grams, width - gram + 1)[self.start]
        self.pick = grams[self.place]
        # grams that a text has more than once: they may repeat within it
        inside = np.flatnonzero(owner[: len(grams)] == owner[gram - 1 :])
        with np.errstate(over="ignore"):
            salt = mix(owner.astype(np.uint64) + np.uint64(0x51ED270B))
        keyed = np.sort(grams[inside] ^ salt[inside])
        again = np.unique(keyed[1:][keyed[1:] == keyed[:-1]])
        mine = self.pick ^ salt[self.start]
        at = np.minimum(np.searchsorted(again, mine), max(0, len(again) - 1))
        self.twice = again[at] == mine if len(again) else np.zeros(len(mine), bool)

    def hashes(self, which: np.ndarray) -> np.ndarray:
        return _window_hashes(self.words.hash, self.width)[self.start[which]]


def base_table(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(id, hash, words, n, picks array<struct<v, m>>): text hash, word-sequence hash, number of words, selected grams with 1 or, if
    the text has the gram more than once, 2."""
    src = docs.select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))
    pick = pa.struct([("v", pa.int64()), ("m", pa.int32())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                w = Windows(part.column(2), width)
                first, h = w.words.first, w.words.hash
                new = np.ones(len(w.start), bool)
                new[1:] = (w.pick[1:] != w.pick[:-1]) | (w.owner[1:] != w.owner[:-1]) | (w.twice[1:] != w.twice[:-1])
                at = np.flatnonzero(new)
                picks = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(w.owner[at], np.arange(part.num_rows + 1)).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(w.pick[at].view(np.int64)), pa.array(1 + w.twice[at].astype(np.int32), pa.int32())], fields=list(pick)),
                )
                words = [int(np.array([whole(h[a:b])]).view(np.int64)[0]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(words, pa.int64()), pa.array(np.diff(first).astype(np.int64)), picks], names=["id", "hash", "words", "n", "picks"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, hash bigint, words bigint, n bigint, picks array<struct<v:bigint,m:int>>")


_ENTRY = np.dtype([("hash", "<u8"), ("id", "<i8"), ("words", "<i8"), ("at", "<i4")])
#: A suffix: a hash of all words around it, its gram, whose it is, where it begins, the least and the largest offset of it in a window, and where its words stand.
_SUFFIX = np.dtype([("hash", "<u8"), ("gram", "<u8"), ("id", "<i8"), ("words", "<i8"), ("at", "<i4"), ("near", "<i4"), ("far", "<i4"), ("ctx", "<i8")])


def _suffixes(w: Windows, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, words around them) of the windows ``which``: one for each selected place, with all words of the windows that selected it."""
    if not len(which):
        return np.zeros(0, _SUFFIX), np.zeros(0, np.uint64)
    place, start = w.place[which], w.start[which]
    new = np.concatenate([[True], place[1:] != place[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(which)) - 1
    hashes = _window_hashes(w.words.hash, w.width)
    e = np.zeros(len(first), _SUFFIX)
    e["gram"], e["far"], e["near"] = w.pick[which[first]], (place - start)[first], (place - start)[last]
    with np.errstate(over="ignore"):  # the first and the last window overlap, so they have all the words between them
        e["hash"] = mix(hashes[start[first]] * np.uint64(0x9E3779B97F4A7C15) + hashes[start[last]] + (e["far"] * 64 + e["near"]).astype(np.uint64))
    owner = w.owner[which[first]]
    e["at"], e["id"] = place[first] - w.words.first[owner], owner  # the caller names the owner
    size = start[last] + w.width - start[first]
    e["ctx"] = np.concatenate([[0], np.cumsum(size)[:-1]])
    return e, w.words.hash[np.repeat(start[first] - e["ctx"], size) + np.arange(size.sum())]


def _each_window(e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of suffixes as entries, with what ``first`` says of each suffix."""
    n = e["far"] - e["near"] + 1
    out = np.zeros(int(n.sum()), _ENTRY)
    which = np.repeat(np.arange(len(e)), n)
    out["id"], out["words"] = e["id"][which], e["words"][which]
    out["at"] = (e["at"] - e["far"])[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    return out, first[which]


def _neighbours(e: np.ndarray, ctx: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows that occurred before, the id of the first that had each) of suffixes that differ in gram or words around."""
    right, left = np.zeros((len(e), width), np.uint64), np.zeros((len(e), width - GRAM), np.uint64)
    for c in range(width):
        some = np.flatnonzero(c < width - e["near"])
        right[some, c] = ctx[(e["ctx"] + e["far"])[some] + c]
    for c in range(width - GRAM):
        some = np.flatnonzero(c < e["far"])
        left[some, c] = ctx[(e["ctx"] + e["far"])[some] - 1 - c]
    key = np.concatenate([e["gram"][:, None], right], axis=1).astype(">u8")
    order = np.argsort(np.ascontiguousarray(key).view(f"S{8 * (width + 1)}").ravel(), kind="stable")
    e, right, left = e[order], right[order], left[order]
    # what neighbours have in common
    common = np.zeros(len(e) + 1, np.int64)
    unlike = right[1:] != right[:-1]
    common[1:-1] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), width)
    common[1:-1][e["gram"][1:] != e["gram"][:-1]] = 0
    nearest = np.maximum(common[:-1], common[1:])
    rank = np.empty(len(e), np.int64)
    rank[np.lexsort((e["at"], e["words"], e["id"]))] = np.arange(len(e))
    told = np.zeros(len(e), np.uint64)  # of the words to the left, one more at each step
    found, firsts = [np.zeros(0, _ENTRY)], [np.zeros(0, np.int64)]
    for o in range(width - GRAM + 1):
        if o:
            with np.errstate(over="ignore"):
                told = mix(told * np.uint64(0xC2B2AE3D27D4EB4F) + left[:, o - 1])
        some = np.flatnonzero((e["near"] <= o) & (o <= e["far"]) & (nearest >= width - o))
        if len(some) < 2:
            continue
        run = np.cumsum(common[:-1] < width - o)[some]
        by = np.lexsort((rank[some], told[some], run))
        some, run = some[by], run[by]
        same = np.zeros(len(some), bool)
        same[1:] = (run[1:] == run[:-1]) & (told[some[1:]] == told[some[:-1]])
        lead = some[np.maximum.accumulate(np.where(same, 0, np.arange(len(some))))]
        again = some[same]
        out = np.zeros(len(again), _ENTRY)
        out["id"], out["words"], out["at"] = e["id"][again], e["words"][again], e["at"][again] - o
        found.append(out)
        firsts.append(e["id"][lead[same]])
    return np.concatenate(found), np.concatenate(firsts)


def _ranges(e: np.ndarray, first: np.ndarray) -> pa.Table:
    """Repeated windows as (id, words, lo, hi, first): runs of starts lo..hi; first is the id that had the run's first window."""
    order = np.lexsort((e["at"], e["words"], e["id"]))
    e, first = e[order], first[order]
    new = np.ones(len(e), bool)
    new[1:] = (e["id"][1:] != e["id"][:-1]) | (e["words"][1:] != e["words"][:-1]) | (e["at"][1:] - e["at"][:-1] > 1)
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(e))[: len(lo)] - 1
    return pa.table({"id": pa.array(e["id"][lo]), "words": pa.array(e["words"][lo]), "lo": pa.array(e["at"][lo].astype(np.int64)), "hi": pa.array(e["at"][hi].astype(np.int64)), "first": pa.array(first[lo])})


def _split(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries sorted by content and compared with their neighbours: (firsts, repeats, for each repeat the id of its first)."""
    e = e[np.lexsort((e["at"], e["words"], e["id"], e["hash"]))]
    same = np.zeros(len(e), bool)
    same[1:] = e["hash"][1:] == e["hash"][:-1]
    lead = np.maximum.accumulate(np.where(same, 0, np.arange(len(e)))) if len(e) else np.zeros(0, np.int64)
    top = e[lead]
    own = (e["id"] == top["id"]) & (e["words"] == top["words"]) & (e["at"] == top["at"])  # the first itself, maybe from two tasks
    return e[~same], e[~own], top["id"][~own]


def _passages(docs: DataFrame, key: str, text: str, width: int, *by: str) -> DataFrame:
    """(id, *by, lo, hi, first) of the repeated passages: a row for each document that has one, told apart by id, words and ``by`` (hash: that of the text)."""
    kind = docs.select(F.col(key)).schema[0].dataType
    if not isinstance(kind, T.IntegralType):
        raise ValueError(f"ids must be integers, {key} is {kind.simpleString()}")
    base = durable(base_table(docs, key, text, width))
    classes = durable(base.groupBy("words").agg(F.min("id").alias("least"), F.min("hash").alias("hash"), F.count(F.lit(1)).alias("copies")))
    # selected grams, once for each distinct word sequence
    own = base.select("hash", "words", "picks").filter(F.size("picks") > 0).dropDuplicates(["hash"])
    own = own.join(classes.select(F.col("hash").alias("__h")), F.col("hash") == F.col("__h"), "left_semi")
    picked = durable(own.select("hash", F.explode("picks").alias("p")).groupBy("hash", F.col("p.v").alias("v")).agg(F.max("p.m").alias("m"), F.count(F.lit(1)).alias("c")))
    again = durable(picked.groupBy("v").agg(F.sum("m").alias("m"), F.sum("c").alias("c")).filter("m > 1").select(F.col("v").alias("__v"), (F.col("c") > HOT).alias("hot")))
    hits = durable(picked.join(again, F.col("v") == F.col("__v")).groupBy("hash").agg(F.collect_list(F.struct("v", "hot")).alias("picks")))
    wanted = hits.join(classes.select(F.col("hash").alias("__h"), "words", F.col("least").cast("bigint").alias("least")), F.col("hash") == F.col("__h")).drop("__h")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap_of(hits.select("hash")))

    @lean
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, seen = bits.value, set()
        for batch in batches:
            h = batch.column(0).to_numpy()
            hit = in_bitmap(have, h)
            for i in np.flatnonzero(hit):
                if int(h[i]) in seen:
                    hit[i] = False
                seen.add(int(h[i]))
            yield batch.filter(pa.array(hit))

    some = docs.select(F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text")).mapInArrow(texts, "hash bigint, text string")
    joined = some.join(wanted, "hash").select("text", "picks", "words", F.coalesce("least", F.lit(_LAST)).alias("least"))

    bits_ = _bits((base.agg(F.sum("n")).first()[0] or 0) // 4)

    @lean
    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0

        def dealt(kind: int, by: np.ndarray, e: np.ndarray, ctx: np.ndarray | None = None) -> list[tuple]:
            """A row (kind, bucket, entries, words around them) for each bucket of a hash."""
            bucket = (mix(by) >> np.uint64(64 - bits_)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, e = bucket[order], e[order]
            edge = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0, [True]])) if len(e) else np.zeros(0, np.int64)
            rows = []
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                part, around = e[a:b].copy(), b""
                if ctx is not None:
                    size = part["far"] + width - part["near"]
                    begin = np.cumsum(size) - size
                    around = ctx[np.repeat(part["ctx"] - begin, size) + np.arange(size.sum())].tobytes()
                    part["ctx"] = begin
                rows.append((kind, int(bucket[a]), part.tobytes(), around))
            return rows

        def flush() -> Iterator[pa.RecordBatch]:
            some, rest, first = _split(np.concatenate(windows))
            rows = dealt(0, some["hash"], some)
            shift = np.cumsum([0, *map(len, around)])
            for e, by in zip(sparse, shift.tolist(), strict=False):
                e["ctx"] += by
            some, more, lead = _split(np.concatenate(sparse))
            rows += dealt(1, some["gram"], some, np.concatenate(around))
            more, lead = _each_window(more, lead)
            rest, first = np.concatenate([rest, more]), np.concatenate([first, lead])
            if len(rest):
                rows.append((2, int(rest["words"][0] & 0xFFFF), rest.tobytes(), first.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.binary())], names=["kind", "bucket", "data", "more"])

        windows, sparse, around = [np.zeros(0, _ENTRY)], [np.zeros(0, _SUFFIX)], [np.zeros(0, np.uint64)]
        for batch in batches:
            for part in slices(batch, "text"):
                w = Windows(part.column(0), width)
                lists = part.column(1)
                size = np.diff(lists.offsets.to_numpy())
                with np.errstate(over="ignore"):
                    salt = mix(np.arange(part.num_rows, dtype=np.uint64) + np.uint64(0x2545F491))
                flat = lists.flatten()
                want, at = np.unique(flat.field("v").to_numpy().view(np.uint64) ^ np.repeat(salt, size), return_index=True)
                hot = flat.field("hot").to_numpy(zero_copy_only=False)[at]
                mine = w.pick ^ salt[w.owner]
                at = np.minimum(np.searchsorted(want, mine), max(0, len(want) - 1))
                hit = want[at] == mine if len(want) else np.zeros(len(mine), bool)
                ids, names = part.column(3).to_numpy(), part.column(2).to_numpy()
                which = np.flatnonzero(hit & hot[at]) if len(want) else np.zeros(0, np.int64)
                e = np.empty(len(which), _ENTRY)
                owner = w.owner[which]
                e["hash"], e["at"] = w.hashes(which), w.start[which] - w.words.first[owner]
                e["id"], e["words"] = ids[owner], names[owner]
                windows.append(e)
                n += len(e)
                e, words = _suffixes(w, np.flatnonzero(hit & ~hot[at]) if len(want) else which)
                owner = e["id"].copy()
                e["id"], e["words"] = ids[owner], names[owner]
                sparse.append(e)
                around.append(words)
                n += len(words)
                if n >= _FLUSH:
                    yield from flush()
                    windows, sparse, around, n = windows[:1], [np.zeros(0, _SUFFIX)], around[:1], 0
        if n:
            yield from flush()

    @lean
    def compare(table: pa.Table) -> pa.Table:
        kind, data, more = table.column("kind")[0].as_py(), table.column("data"), table.column("more")
        if kind == 1:
            parts = [np.frombuffer(x.as_buffer(), _SUFFIX).copy() for x in data]
            ctx = [np.frombuffer(x.as_buffer(), np.uint64) for x in more]
            for e, by in zip(parts, np.cumsum([0, *map(len, ctx)]).tolist(), strict=False):
                e["ctx"] += by
            some, rest, first = _split(np.concatenate(parts))
            rest, first = _each_window(rest, first)
            found, lead = _neighbours(some, np.concatenate(ctx), width)
            return _ranges(np.concatenate([rest, found]), np.concatenate([first, lead]))
        e = np.concatenate([np.frombuffer(x.as_buffer(), _ENTRY) for x in data])
        if kind == 2:
            return _ranges(e, np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in more]))
        _, rest, first = _split(e)
        return _ranges(rest, first)

    found = durable(joined.mapInArrow(stretches, "kind int, bucket bigint, data binary, more binary").groupBy("kind", "bucket").applyInArrow(compare, "id bigint, words bigint, lo bigint, hi bigint, first bigint"))
    # touching windows join: a passage begins where a window is not covered by those before
    order = W.partitionBy("words").orderBy("lo", "hi", "first")
    before = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1)) + width
    runs = found.withColumn("new", F.when(before >= F.col("lo"), 0).otherwise(1)).withColumn("k", F.sum("new").over(order))
    spans = durable(runs.groupBy(F.col("words").alias("__w"), "k").agg(F.min("lo").alias("lo"), (F.max("hi") + width).alias("hi"), F.min(F.struct("lo", "hi", "first"))["first"].alias("first")).drop("k"))
    rows = base.filter(F.col("n") >= width).select("id", "words", "n", *by).distinct()
    named = lookup(rows, classes.select("words", "least", "copies"), "words", "copies", classes.agg(F.sum("copies")).first()[0] or 0)
    firsts = named.filter(F.col("id").eqNullSafe(F.col("least"))).join(spans, F.col("words") == F.col("__w")).select("id", *by, "lo", "hi", "first")
    copies = named.filter(~F.col("id").eqNullSafe(F.col("least"))).select("id", *by, F.lit(0).cast("bigint").alias("lo"), F.col("n").alias("hi"), F.col("least").cast("bigint").alias("first"))
    return firsts.unionByName(copies)


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(key, start, end, n_words, first_id), a row per repeated passage: words start..end-1 of the text (counted from 0) occurred before; first_id is a
    document that has what the passage begins with."""
    out = _passages(docs, key, text, width)
    return out.select(F.col("id").alias(key), F.col("lo").alias("start"), F.col("hi").alias("end"), (F.col("hi") - F.col("lo")).alias("n_words"), F.nullif("first", F.lit(_LAST)).alias("first_id"))


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """docs without the repeated passages: they are cut out of the texts, with the white space in front of them, and documents of which no word is left go.
    Texts without repeats stay as they are. Cuts go by id and text, so documents whose ids are null or shared get none but their own."""
    names = docs.columns
    docs, (key, text) = plainly(docs, key, text)
    spans = _passages(docs, key, text, width, "hash").groupBy(F.col("id").alias("__id"), F.col("hash").alias("__h"))
    spans = durable(spans.agg(F.sort_array(F.collect_list(F.struct(F.col("lo").alias("start"), F.col("hi").alias("end")))).alias("__cuts")))
    cols = docs.columns
    some, rest = apart(docs, F.xxhash64(text), spans.select("__h"))
    rows = some.join(spans, (F.xxhash64(text) == F.col("__h")) & F.col(key).eqNullSafe(F.col("__id")), "left").drop("__id", "__h")
    schema = rows.schema
    at = cols.index(text)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                cuts = part.column(len(cols)).to_pylist()
                which = [i for i, c in enumerate(cuts) if c]
                if not which:
                    yield part
                    continue
                w = Words(part.column(at).take(pa.array(which)))
                texts, keep = part.column(at).to_pylist(), np.ones(part.num_rows, bool)
                for k, i in enumerate(which):
                    a, b = int(w.first[k]), int(w.first[k + 1])
                    raw, done, left = texts[i].encode(), 0, []
                    origin = int(w.at[k])
                    gone = 0
                    for c in cuts[i]:
                        lo, hi = a + c["start"], min(b, a + c["end"])
                        if lo >= hi:
                            continue
                        cut_from = int(w.end[lo - 1]) - origin if lo > a else 0
                        left.append(raw[done:cut_from])
                        done = max(done, int(w.end[hi - 1]) - origin)
                        gone += hi - lo
                    left.append(raw[done:])
                    rest = b"".join(left).decode()
                    texts[i] = rest
                    keep[i] = bool(rest.strip(" \t\n\v\f\r"))
                columns = list(part.columns)
                columns[at] = pa.array(texts, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(pa.array(keep))

    return rows.mapInArrow(run, schema).select(*cols).unionByName(rest).toDF(*names)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("first_id", "first_doc_id")
