"""Choices that a seed and a row's key decide, alike in every engine that knows MD5; exact samples, numbers of rows and permutations without a sort of all rows in
one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spanloom.sources import work

#: The histogram of tickets has 2^BITS steps: rows on the edge of a sample are those of one step.
BITS = 16
_BELOW = (1 << 33) - 1


def ticket(seed: int | str, *keys) -> Column:
    """A whole number below 2^60: the first 15 digits of the MD5 of seed and keys with colons between; a null key is empty."""
    parts = [F.coalesce((k if isinstance(k, Column) else F.col(k)).cast("string"), F.lit("")) for k in keys]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("bigint")


def die(sides: Column | int, seed: int | str, *keys) -> Column:
    """A whole number from 0 to sides - 1."""
    return F.pmod(ticket(seed, *keys), sides if isinstance(sides, Column) else F.lit(sides))


def one_of(options: list[str] | Column, seed: int | str, *keys) -> Column:
    held = options if isinstance(options, Column) else F.array(*map(F.lit, options))
    return F.element_at(held, (die(F.size(held), seed, *keys) + 1).cast("int"))


def numbered(rows: DataFrame, *order: Column | str, name: str = "number") -> DataFrame:
    """rows with their number from 0 in this order, in two passes: rows are dealt into ranges, sorted there and written with their places; then the counts
    of the ranges (a row each) say where each begins. No task sees more than its range."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = work.written(placed)
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    begun = F.sum("__c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1))
    starts = F.broadcast(sizes.select("__p", F.coalesce(begun, F.lit(0)).alias("__b")))  # a row per range
    number = F.col("__b") + F.col("__at").bitwiseAND(F.lit(_BELOW))
    return placed.join(starts, part == F.col("__p")).withColumn(name, number).drop("__at", "__p", "__b", "__c")


def smallest(rows: DataFrame, quotas: DataFrame, strata: list[str], by: Column, *order: str, bits: int = BITS) -> DataFrame:
    """The rows of each stratum with the smallest tickets ``by``, exactly as many as quotas (strata, quota) says, or all where there are fewer.

    A histogram of the tickets in each stratum tells which step the quota ends in: rows of earlier steps are in, and only those of this one are ranked. Strata
    without a quota give nothing.
    """
    held = rows.withColumn("__t", by).withColumn("__s", F.shiftright("__t", 60 - bits))
    counts = held.groupBy(*strata, "__s").agg(F.count(F.lit(1)).alias("__n"))
    upto = F.sum("__n").over(W.partitionBy(*strata).orderBy("__s"))
    ends = counts.withColumn("__u", upto)
    asked = quotas.select(*[F.col(c).alias(f"__q_{c}") for c in strata], F.col("quota").alias("__quota"))

    def same(left: DataFrame, right: DataFrame, prefix: str) -> Column:
        on = F.lit(True)
        for c in strata:
            on = on & left[c].eqNullSafe(right[f"{prefix}{c}"])
        return on

    met = ends.join(asked, same(ends, asked, "__q_")) if strata else ends.join(F.broadcast(asked))
    # the first step that isn't wholly in, and how many of its rows are; beyond the last step where all are in
    full = F.col("__u") <= F.col("__quota")
    edge = F.coalesce(F.min(F.when(~full, F.col("__s"))), F.lit(1 << bits)).alias("__edge")
    room = (F.first("__quota") - F.coalesce(F.max(F.when(full, F.col("__u"))), F.lit(0))).alias("__room")
    limits = met.groupBy(*[f"__q_{c}" for c in strata]).agg(edge, room)
    near = held.join(limits, same(held, limits, "__q_")) if strata else held.join(F.broadcast(limits))
    place = F.row_number().over(W.partitionBy(*strata, "__s").orderBy("__t", *order))
    inside = near.filter(F.col("__s") < F.col("__edge"))
    ranked = near.filter((F.col("__s") == F.col("__edge")) & (F.col("__room") > 0)).withColumn("__r", place).filter(F.col("__r") <= F.col("__room"))
    return inside.select(*rows.columns).unionByName(ranked.select(*rows.columns))


def exactly(rows: DataFrame, n: int, by: Column, *order: str) -> DataFrame:
    """The n rows with the smallest tickets."""
    return smallest(rows, rows.sparkSession.range(1).select(F.lit(int(n)).cast("bigint").alias("quota")), [], by, *order)


def weighted_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: int, weight: Column | None = None) -> DataFrame:
    """n rows (all where there are fewer), no key twice: each stratum gives its weight's share of n, rounded down and at least one, as far as it has that many; if
    that is too few the rest comes from what was left, of whatever stratum; if it is too many (of more strata than n) some go again.

    ``weight`` is a whole number by stratum, of the stratum and its number of rows ``m`` (all weigh the same without). Of rows that share a key one counts, the
    smallest. Which rows of a stratum are drawn, which fill up and which go are decided by three tickets of the key.
    """
    once = rows.groupBy(key).agg(F.min(F.struct(*[c for c in rows.columns if c != key])).alias("__x")).select(key, "__x.*")
    once = work.written(once.select(*rows.columns))
    strata = once.groupBy(stratum).agg(F.count(F.lit(1)).alias("m")).withColumn("w", (F.lit(1) if weight is None else weight).cast("bigint"))
    every = strata.agg(F.sum("w").alias("all"))  # one row
    share = F.greatest(F.lit(1), F.call_function("div", F.lit(n).cast("bigint") * F.col("w"), F.col("all")))
    quotas = strata.join(F.broadcast(every)).select(stratum, share.cast("bigint").alias("quota"))
    first = work.written(smallest(once, quotas, [stratum], ticket(seed, key), key))
    got = first.count()
    if got > n:
        return exactly(first, n, ticket(seed + 2, key), key)
    rest = once.join(first.select(F.col(key).alias("__k")), F.col(key).eqNullSafe(F.col("__k")), "left_anti")
    return first.unionByName(exactly(rest, n - got, ticket(seed + 1, key), key)) if got < n else first


def sides(n: int) -> tuple[int, int]:
    """(a, b): whole numbers near the root of n with a * b >= n."""
    a = max(1, int(n**0.5))
    while a * a < n:
        a += 1
    return a, max(1, -(-n // a))


def permuted(number: Column, n: int, seed: int, rounds: int = 4) -> Column:
    """A permutation of 0 .. n - 1 that the seed decides, each number for itself: a number is a pair (of quotient and remainder by b), of which each round moves one
    half by a ticket of the other; results from n on, of which there are less than a, are taken round again until one is below n."""
    a, b = sides(n)

    def once(x: Column) -> Column:
        left, right = F.call_function("div", x, F.lit(b).cast("bigint")), F.pmod(x, F.lit(b).cast("bigint"))
        pair = F.struct(left.alias("l"), right.alias("r"))
        steps = F.array(*[F.lit(i) for i in range(rounds)])
        moved = F.aggregate(
            steps, pair,
            lambda p, i: F.struct(
                F.when(i % 2 == 0, F.pmod(p["l"] + ticket(seed, i, p["r"]), F.lit(a).cast("bigint"))).otherwise(p["l"]).alias("l"),
                F.when(i % 2 == 1, F.pmod(p["r"] + ticket(seed, i, p["l"]), F.lit(b).cast("bigint"))).otherwise(p["r"]).alias("r"),
            ),
        )
        return moved["l"] * b + moved["r"]

    # after 64 steps none is left but with a chance of b^-64; with b up to 64 all a that can follow one another are taken
    again = F.sequence(F.lit(1), F.lit(min(a, 64)))
    return F.aggregate(again, once(number.cast("bigint")), lambda x, i: F.when(x >= n, once(x)).otherwise(x))
