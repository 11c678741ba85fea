"""Blocks behind prose texts, paired in turn: the cursor over the prose moves on only when a pair holds.

A share of the blocks, chosen by tickets, is tried in order of their ids, each with the prose text at the cursor: the pair must be of a length within bounds, with the spans of both
at their places and apart. If it is, it becomes one text and the cursor goes to the next prose text (after the last to the first); otherwise the block stands
alone, and the same prose text waits for the next block. Only sizes and verdicts are needed for that, not texts.

Where no pair of a tried block is in doubt (it fits with the shortest and with the longest prose text, or with neither), the cursor is the number of
fitting blocks before, and pairs are an equi-join of numbers. Otherwise the cursor is carried from one run of RUN blocks to the next: a job each, that
reads these blocks' sizes and the next RUN prose texts', and hands back one number. So no task has more than two runs, and what a lost executor costs is a run.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators import choice
from spanloom.sources import work

LEAST, MOST, SHARE = 1500, 6000, 0.6
GAP = "\n\n"
RUN = 1 << 20
SPANS = "array<struct<start:bigint,end:bigint,text:string,type:string>>"


def in_order(spans: Column) -> Column:
    """Spans (text, type, start, end) as structs by start; null spans are none."""
    held = F.transform(spans, lambda s: F.struct(s["start"].cast("bigint").alias("start"), s["end"].cast("bigint").alias("end"), s["text"].alias("text"), s["type"].alias("type")))
    return F.array_sort(F.coalesce(held, F.array().cast(SPANS)))


def verbatim(text: Column, spans: Column) -> Column:
    """Whether every span's text stands at its place."""
    at = lambda s: F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    return F.coalesce(F.forall(spans, lambda s: F.coalesce((s["start"] >= 0) & (at(s) == s["text"]), F.lit(False))), F.lit(True))


def disjoint(spans: Column) -> Column:
    """Whether each span by start ends before the next begins."""
    return F.coalesce(F.forall(F.zip_with(spans, F.slice(spans, 2, F.greatest(F.size(spans), F.lit(1))), lambda a, b: b.isNull() | (a["end"] <= b["start"])), lambda ok: ok), F.lit(True))


def merged(first: Column, first_spans: Column, second: Column, second_spans: Column) -> tuple[Column, Column]:
    """(text, spans): two texts with a blank line between, with the spans of both."""
    by = F.length(first) + len(GAP)
    moved = F.transform(second_spans, lambda s: F.struct((s["start"] + by).cast("bigint").alias("start"), (s["end"] + by).cast("bigint").alias("end"), s["text"].alias("text"), s["type"].alias("type")))
    return F.concat(first, F.lit(GAP), second), F.concat(first_spans, moved)


def places(spans: Column) -> Column:
    """Spans in order without their texts."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type")))


def filled(text: Column, spans: Column) -> Column:
    """Places (start, end, type) with what stands there in the text."""
    at = lambda s: F.substr(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), at(s).alias("text"), s["type"].alias("type")))


def _paired(tried: DataFrame, pool: DataFrame, size: int, least: int, most: int, run: int) -> DataFrame:
    """(id, prose): which prose text (by number) each tried block gets, in order of the ids; tried: (id, n, ok), pool: (number, n, ok)."""
    e = pool.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.min("ok").alias("all"), F.max("ok").alias("any")).first()
    gap = len(GAP)
    total = F.col("n") + gap
    sure = F.col("ok") & F.lit(bool(e["all"])) & (total + e["low"] >= least) & (total + e["high"] <= most)
    never = ~F.col("ok") | F.lit(not e["any"]) | (total + e["high"] < least) | (total + e["low"] > most)
    if not tried.filter(~sure & ~never).limit(1).count():
        fits = choice.numbered(tried.filter(sure).select("id"), "id", name="cursor")
        return fits.select("id", F.pmod(F.col("cursor"), F.lit(size).cast("bigint")).alias("prose"))
    order = choice.numbered(tried, "id")
    n, cursor, parts = tried.count(), 0, []

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prose: list[tuple[int, int, bool]] = []
        at = 0
        for batch in batches:  # prose texts from the cursor on, then blocks
            of_pool, key, number, length, ok = (c.to_pylist() for c in batch.columns)
            got, who = [], []
            for p, k, i, m, good in zip(of_pool, key, number, length, ok, strict=True):
                if p:
                    prose.append((i, m, good))
                    continue
                j, pm, pgood = prose[at % len(prose)]
                if good and pgood and least <= pm + gap + m <= most:
                    got.append(k)
                    who.append(j)
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(got, batch.schema.field(1).type), pa.array(who, pa.int64())], names=["id", "prose"])

    kind = tried.schema["id"].dataType.simpleString()
    for begin in range(0, n, run):
        start = cursor % size
        turn = F.pmod(F.col("number") - start, F.lit(size).cast("bigint"))  # places from the cursor on
        here = pool.filter(turn < run).select(F.lit(True).alias("p"), F.lit(None).cast(kind).alias("id"), "number", "n", "ok", turn.alias("turn"))
        there = order.filter(F.col("number").between(begin, begin + run - 1)).select(F.lit(False).alias("p"), "id", "number", "n", "ok", F.col("number").alias("turn"))
        rows = here.unionByName(there).coalesce(1).sortWithinPartitions(F.col("p").desc(), "turn").select("p", "id", "number", "n", "ok")
        parts.append(work.written(rows.mapInArrow(walk, f"id {kind}, prose bigint")))
        cursor += parts[-1].count()
    paths = [f.rsplit("/", 1)[0] for part in parts for f in part.inputFiles()[:1]]
    return tried.sparkSession.read.schema(parts[0].schema).parquet(*paths)


def mixed(blocks: DataFrame, prose: DataFrame, seed: int, share: float = SHARE, least: int = LEAST, most: int = MOST, run: int = RUN) -> DataFrame:
    """(id, tried, prose_id, text, spans): blocks (id, text, spans), exactly floor(share * n) of them tried with a prose text (id, text, spans) before them.

    Blocks whose spans aren't verbatim are left out. ``prose_id`` is null for a block that stands alone, tried or not. Spans have text, type, start
    and end, null texts are empty. Ids must be unique in each table.
    """
    shaped = lambda t: t.select("id", F.coalesce("text", F.lit("")).alias("text"), in_order(F.col("spans")).alias("spans"))
    blocks, prose = shaped(blocks), shaped(prose)
    lean = lambda t: t.select("id", F.length("text").cast("bigint").alias("n"), verbatim(F.col("text"), F.col("spans")).alias("said"), disjoint(F.col("spans")).alias("apart"))
    sized, pool = work.written(lean(blocks)), lean(prose).select("id", "n", (F.col("said") & F.col("apart")).alias("ok"))
    pool = choice.numbered(pool, "id")
    size = pool.count()
    lot = choice.exactly(sized, int(sized.count() * share), choice.ticket(seed, "id"), "id").filter("said")
    tried = work.written(lot.select("id", "n", F.col("apart").alias("ok")))
    none = tried.select("id", F.lit(None).cast("bigint").alias("prose")).limit(0)
    pairs = _paired(tried, pool, size, least, most, run) if size else none
    chosen = tried.select(F.col("id").alias("__l"), F.lit(True).alias("__tried"))
    behind = pairs.select(F.col("id").alias("__i"), F.col("prose").alias("__n"))
    # spans of what is left stand at their places, so their texts are cut out again behind the shuffles
    # (under names that the result hasn't: inside of lambdas a name would be that of a column beside them)
    rows = work.spread(blocks.select("id", F.col("text").alias("__b"), places(F.col("spans")).alias("__e")), "id")
    rows = rows.join(sized.filter("said").select(F.col("id").alias("__k")), F.col("id") == F.col("__k")).join(chosen, F.col("id") == F.col("__l"), "left").join(behind, F.col("id") == F.col("__i"), "left")
    # blocks are dealt to the prose texts, which are many times as long and stand before many blocks each; few prose texts are dealt more than once, so that all tasks
    # have some. Dealt by a number of tasks: texts may compress well, and a shuffle that is coalesced to its bytes would then give tasks too much
    copies = max(1, -(-2 * int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")) // max(size, 1)))
    lot = F.xxhash64("id")
    rows = rows.withColumn("__c", F.when(F.col("__n").isNull(), lot).otherwise(F.pmod(lot, F.lit(copies).cast("bigint")))).withColumn("__n", F.coalesce("__n", F.lit(-1).cast("bigint")))
    given = prose.select(F.col("id").alias("prose_id"), F.col("text").alias("__t"), places(F.col("spans")).alias("__s"))
    given = given.join(pool.select("number", F.col("id").alias("__p")), F.col("prose_id") == F.col("__p")).withColumn("__d", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(copies - 1).cast("bigint"))))
    leads = work.spread(given.select("number", "__d", "prose_id", "__t", "__s"), "number", "__d")
    rows = work.spread(rows, "__n", "__c").join(leads, (F.col("__n") == F.col("number")) & (F.col("__c") == F.col("__d")), "left")
    alone = F.col("prose_id").isNull()
    own = filled(F.col("__b"), F.col("__e"))
    text, spans = merged(F.col("__t"), filled(F.col("__t"), F.col("__s")), F.col("__b"), own)
    return rows.select("id", F.coalesce("__tried", F.lit(False)).alias("tried"), "prose_id", F.when(alone, F.col("__b")).otherwise(text).alias("text"), F.when(alone, own).otherwise(spans).alias("spans"))
