"""Mixing sources to target weights by subset-sum budget fitting.

Targets: sources in order of code point (null last) weigh 5, 2, 1, 5, ... and share 150 % of all words; none gets more than twice
its own words, and what is over goes to the others by weight until none is above.

Fitting, per source: documents are counted by exact length. A target of at least the source's size takes everything once and
fits the rest; then every length gives its proportional share, rounded down with the remainder carried from long to short lengths but for a
budget that is left, and bounded-knapsack dynamic programming over the remaining counts finds the subset whose sum is nearest to that
budget from below. Which documents of a length are taken is decided by a seeded hash: the counts per (source, length, hash
bucket) say which buckets are taken whole, and only in the one bucket on the edge are documents ranked. So a length that a third of all
documents share is never sorted in one place.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its own; documents are told apart by a hash of
doc_id, text and source, and rows that agree in all three are ranked by an arbitrary but equal order, so the same number of them is taken on each run; a table without rows
gives none. Targets are one row per source, the size of the mix's own configuration, and are worked out on the driver; everything by
document stays distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.llm.core import Words, col, durable, lean, plainly, slices

SHARE, CAP, WEIGHTS, SEED = 1.5, 2.0, (5, 2, 1), 20240607
#: Documents that a hash bucket of a (source, length) holds at most, about, if all are of one length; and the fewest and most buckets.
IN_BUCKET, BUCKETS, MOST_BUCKETS = 4096, 256, 1 << 20


def _rank(key: str, text: str, source: str) -> Column:
    return F.xxhash64(F.lit(SEED), col(key), col(text), col(source).isNull(), col(source))


def sizes(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, rank): exact word counts and the seeded rank hash of every document."""
    src = docs.select(col(key).alias("key"), col(source).alias("source"), col(text).alias("text"), _rank(key, text, source).alias("rank"))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(Words(part.column(2)).first).astype(np.int64)), part.column(3)], names=["key", "source", "size", "rank"])

    return src.mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, source {src.schema['source'].dataType.simpleString()}, size bigint, rank bigint")


def targets(totals: dict, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> dict:
    """Source to target; totals: source to words."""
    order = sorted(totals, key=lambda s: (s is None, [ord(c) for c in s or ""]))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(totals.values()), list(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > cap * totals[s]]
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = cap * totals[s]
            left -= out[s]
            open_.remove(s)
    return out


def subset(counts: list[tuple[int, int]], budget: int) -> dict[int, int]:
    """Bounded knapsack: length to number taken, with the largest sum up to budget.

    Sets of reachable sums are the bits of an integer; of each sum only the step that reached it first is kept, so memory is four bytes per
    word of the budget, however many lengths there are.
    """
    full = (1 << (budget + 1)) - 1
    first, steps, reach = np.full(budget + 1, -1, np.int32), [], 1
    for length, n in counts:
        left = min(n, budget // length)
        k = 1
        while left > 0 and not reach >> budget & 1:  # 1, 2, 4, ... copies at once
            take = min(k, left)
            new = (reach << (length * take) & full) & ~reach
            if new:
                raw = np.frombuffer(new.to_bytes(budget // 8 + 1, "little"), np.uint8)
                some = np.flatnonzero(raw)
                bits = np.unpackbits(raw[some], bitorder="little").reshape(-1, 8)
                row, bit = np.nonzero(bits)
                first[some[row] * 8 + bit] = len(steps)
                reach |= new
            steps.append((length, take))
            left, k = left - take, 2 * k
    at, out = reach.bit_length() - 1, {}
    while at:  # the step before a sum's own has reached what it was added to
        length, take = steps[first[at]]
        out[length] = out.get(length, 0) + take
        at -= length * take
    return out


def fit(length: np.ndarray, count: np.ndarray, target: float, room: int = 4096) -> tuple[int, np.ndarray]:
    """(whole, extra): every document is taken ``whole`` times (0 or 1), ``extra`` of each length once more.

    ``room`` words are left to the dynamic programme (more where a single document is longer).
    """
    total = int((length * count).sum())
    whole = int(total > 0 and target >= total)
    budget = max(0, min(total, round(target - whole * total)))
    extra = np.zeros(len(length), np.int64)
    if not budget or not total:
        return whole, extra
    bulk = max(0, budget - room)
    carry = 0.0
    for i in np.argsort(-length, kind="stable"):
        want = carry + bulk * (float(length[i]) * float(count[i]) / total)
        extra[i] = min(int(count[i]), max(0, int(want // length[i])))
        carry = want - float(extra[i] * length[i])
    rest = budget - int((extra * length).sum())
    order = np.lexsort((length, -np.minimum(length, 1)))
    more = subset([(int(length[i]), int(count[i] - extra[i])) for i in order if count[i] > extra[i] and length[i] <= rest], rest)
    for i in range(len(length)):
        extra[i] += more.get(int(length[i]), 0)
    return whole, extra


def buckets_for(n: int) -> int:
    """Hash buckets of each (source, length) for n documents in all: a power of two."""
    return min(MOST_BUCKETS, max(BUCKETS, 1 << max(0, n // IN_BUCKET).bit_length()))


def plan(sized: DataFrame, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(by length, by bucket): (source, size, n, target, source_size, whole, extra), and how many documents each
    (source, size, bucket) holds and how many of them are taken once more."""
    fine = durable(sized.groupBy("source", "size", F.pmod(F.col("rank"), F.lit(buckets)).alias("bucket")).agg(F.count(F.lit(1)).alias("n")))
    coarse = fine.groupBy("source", "size").agg(F.sum("n").alias("n"))
    total = {r["source"]: int(r["w"]) for r in coarse.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("w")).collect()}
    goal = targets(total)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        source = g["source"].iloc[0]
        source = None if pd.isna(source) else source
        some = g[g["size"] > 0].sort_values("size", ignore_index=True)
        whole, extra = fit(some["size"].to_numpy(np.int64), some["n"].to_numpy(np.int64), goal[source])
        zero = g[g["size"] <= 0]
        both = pd.concat([some.assign(whole=whole, extra=extra), zero.assign(whole=0, extra=0)])
        return both.assign(target=float(goal[source]), source_size=total[source])[["source", "size", "target", "source_size", "whole", "extra"]]

    kind = coarse.schema["source"].dataType.simpleString()
    lengths = durable(coarse.groupBy("source").applyInPandas(run, f"source {kind}, size bigint, target double, source_size bigint, whole bigint, extra bigint"))
    before = F.sum("n").over(W.partitionBy("source", "size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    l2 = lengths.select(F.col("source").alias("s"), F.col("size").alias("z"), "target", "source_size", "whole", "extra")
    joined = fine.withColumn("before", F.coalesce(before, F.lit(0))).join(l2, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
    take = F.greatest(F.lit(0), F.least(F.col("n"), F.col("extra") - F.col("before")))
    return lengths, durable(joined.withColumn("take", take).drop("before", "extra"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, rank, size, source_size, target, taken) for every row of docs; taken is 0, size or twice the size."""
    sized = durable(sizes(docs, key, text, source))
    buckets = buckets_for(sized.count())
    got = plan(sized, buckets)[1].select(F.col("source").alias("s"), F.col("size").alias("z"), "bucket", "n", "target", "source_size", "whole", "take")
    rows = sized.withColumn("b", F.pmod(F.col("rank"), F.lit(buckets)))
    rows = rows.join(got, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("b") == F.col("bucket")))
    edge = (F.col("take") > 0) & (F.col("take") < F.col("n"))
    settled = rows.filter(~edge).withColumn("more", (F.col("take") > 0).cast("bigint"))
    ranked = rows.filter(edge).withColumn("more", (F.row_number().over(W.partitionBy("source", "size", "b").orderBy("rank", "key")) <= F.col("take")).cast("bigint"))
    out = settled.unionByName(ranked)
    return out.select(F.col("key").alias(key), "rank", "size", "source_size", "target", ((F.col("whole") + F.col("more")) * F.col("size")).alias("taken"))


def keep_mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of docs that the mix takes, those it takes twice two times, with their columns as they are."""
    rows, (k, t, s) = plainly(docs, key, text, source)
    times = mix(rows, k, t, s).groupBy(F.col(k).alias("__k"), F.col("rank").alias("__r")).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0)).cast("bigint").alias("__t"))
    times = durable(times.filter("__t > 0"))
    ranked = rows.withColumn("__rank", _rank(k, t, s))
    ranked = ranked.join(times, F.col(k).eqNullSafe(F.col("__k")) & (F.col("__rank") == F.col("__r")))
    # rows that agree in key, text and source share what is taken of them: the first __t % __n of them one more than the others
    same = ranked.filter("__n = 1").withColumn("__c", F.col("__t"))
    place = F.row_number().over(W.partitionBy("__k", "__r").orderBy("__r"))
    many = ranked.filter("__n > 1").withColumn("__p", place).withColumn("__c", F.floor(F.col("__t") / F.col("__n")) + (F.col("__p") <= F.col("__t") % F.col("__n")).cast("bigint")).drop("__p")
    kept = same.unionByName(many).filter("__c > 0")
    return kept.withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__c").cast("int")))).select(*rows.columns).toDF(*docs.columns)


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
