"""Quality rules with a verdict by host.

Every text is measured on its own (numpy over whole Arrow batches); failures of each rule are then summed by host, the
host's failure rate is shrunk towards the corpus with a beta prior fitted to the hosts by moments, and hosts that stand out take their
documents with them.

The limit of a rule follows from its prior: ``spread`` of the prior's standard deviations over its mean, but never under ``low`` (a
host that mostly passes is kept, however alike the others are) nor over ``high`` (one that mostly fails goes, however unlike
they are). Where all hosts fail alike, none is rejected: a shrunken rate that differs by chance alone lies within half a deviation.

Defined results: a null text has no words; a document without a host is judged by its own rules only; the order of rows
doesn't matter, repeated rows count as often as they occur; a table without rows gives one without rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.llm.core import Words, col, durable, lean, lookup, mix, plainly, rolling, slices, span_hashes

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LEAD = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a character


@dataclass(frozen=True)
class Rules:
    """Limits of documents and hosts. The prior weighs as many documents as its fit says, from least_weight to most_weight (hosts without
    any spread beyond chance, or with less than a prior can show)."""

    least_words: int = 50
    repeat_percent: int = 50
    spread: float = 3.0
    low: float = 0.2
    high: float = 0.7
    least_weight: float = 1.0
    most_weight: float = 1000.0

    def limit(self, mean: float, weight: float) -> float:
        """The shrunken rate over which a host is rejected, for a prior of this mean and weight."""
        return min(self.high, max(self.low, mean + self.spread * (mean * (1 - mean) / (weight + 1)) ** 0.5))

    def weight(self, mean: float, between: float) -> float:
        """The weight of a prior with this mean, whose variance is ``between``."""
        return min(self.most_weight, max(self.least_weight, mean * (1 - mean) / between - 1)) if between > 0 else self.most_weight


def _before(x: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each element, whether an earlier one of the same owner has the same value."""
    with np.errstate(over="ignore"):
        keyed = x ^ mix(owner.astype(np.uint64) + np.uint64(0x51ED270B))
    order = np.argsort(keyed, kind="stable")
    same = np.zeros(len(x), bool)
    same[order[1:]] = keyed[order[1:]] == keyed[order[:-1]]
    return same


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text, over all of it."""
    w = Words(texts)
    n = len(w)
    n_words = np.diff(w.first)
    lead = np.concatenate([[0], np.cumsum(_LEAD[w.data], dtype=np.int64)])
    chars = np.concatenate([[0], np.cumsum(lead[w.end] - lead[w.start])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[w.data], dtype=np.int64)])
    # lines: [start, end) between line feeds and text edges; those without a word don't count
    feed = np.flatnonzero(w.data == 10)
    edges = np.union1d(np.concatenate([feed, feed + 1]), w.at)
    start, end = edges[:-1], edges[1:]
    is_line = (w.data[start] != 10) if len(start) else np.zeros(0, bool)
    start, end = start[is_line], end[is_line]
    full = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end = start[full], end[full]
    owner = np.searchsorted(w.at, start, "right") - 1
    dup = np.bincount(owner[_before(span_hashes(w.data, start, end), owner)], minlength=n)
    # 3-word windows within one text that occur there twice or more cover their words
    grams = rolling(w.hash, 3)
    owner = np.repeat(np.arange(n), n_words)
    whole = owner[: len(grams)] == owner[2:] if len(grams) else np.zeros(0, bool)
    at = np.flatnonzero(whole)
    with np.errstate(over="ignore"):
        keyed = grams[at] ^ mix(owner[at].astype(np.uint64) + np.uint64(0x51ED270B))
    order = np.argsort(keyed, kind="stable")
    again = np.zeros(len(at), bool)
    twin = keyed[order[1:]] == keyed[order[:-1]]
    again[order[1:]] |= twin
    again[order[:-1]] |= twin
    covered = np.zeros(len(w.hash) + 3, bool)
    for k in range(3):
        covered[at[again] + k] = True
    return {
        "n_words": n_words,
        "word_chars": np.diff(chars[w.first]),
        "n_symbols": np.diff(symbols[w.at]),
        "n_dup_lines": dup,
        "n_repeat_words": np.diff(np.concatenate([[0], np.cumsum(covered)])[w.first]),
    }


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the measures as further bigint columns, named __q_ and the measure."""
    names = ["__q_" + m for m in MEASURES]
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T.LongType()) for n in names]])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                got = measure(part.column(part.schema.get_field_index(text)))
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(got[m].astype(np.int64)) for m in MEASURES]], names=[*part.schema.names, *names])

    return df.mapInArrow(run, schema)


def failures(rules: Rules) -> dict[str, Column]:
    """Whether a document fails each base rule."""
    n, repeat = F.col("__q_n_words"), F.col("__q_n_repeat_words")
    return {"short": n < rules.least_words, "repeats": 100 * repeat > rules.repeat_percent * n}


def host_rates(measured: DataFrame, host: str, rules: Rules) -> DataFrame:
    """(host, n, rate_<rule>..., limit_<rule>...): per rule the share of failures, shrunk with a beta prior fitted by moments to all hosts,
    and the rate over which a host is rejected.

    The prior has the hosts' mean rate, and a weight such that it explains their variance beyond what binomial noise does.
    """
    fails = failures(rules)
    # a sum per host is partial before the shuffle: a host with a third of the rows is one row per task
    hosts = durable(measured.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c.cast("bigint")).alias(f"f_{r}") for r, c in fails.items()]))
    moments = [F.count(F.lit(1)).alias("k"), F.avg(1 / F.col("n")).alias("inv")]
    for r in fails:
        rate = F.col(f"f_{r}") / F.col("n")
        moments += [F.avg(rate).alias(f"m_{r}"), F.var_pop(rate).alias(f"v_{r}")]
    got = hosts.agg(*moments).first()
    rates, limits = [], []
    for r in fails:
        mean = got[f"m_{r}"] or 0.0
        weight = rules.weight(mean, (got[f"v_{r}"] or 0.0) - mean * (1 - mean) * (got["inv"] or 0.0))
        rates.append(((F.col(f"f_{r}") + mean * weight) / (F.col("n") + weight)).alias(f"rate_{r}"))
        limits.append(F.lit(rules.limit(mean, weight)).alias(f"limit_{r}"))
    return hosts.select("host", "n", *rates, *limits)


def judge(df: DataFrame, measured: DataFrame, host: str, rules: Rules) -> DataFrame:
    """df, which has the measures, with __q_base_failed and __q_kept. ``measured`` has the measures and the column host and
    gives the corpus's rates (a cheaper plan than df where that carries texts)."""
    rates = host_rates(measured, "host", rules)
    over = F.lit(False)
    for r in failures(rules):
        over = over | (F.col(f"rate_{r}") > F.col(f"limit_{r}"))
    bad = durable(rates.select("host", "n", over.alias("bad")))
    total = bad.agg(F.sum("n")).first()[0] or 0
    own = "__q_host"
    judged = lookup(df.withColumn(own, col(host).cast("string")), bad.filter("bad").select(F.col("host").alias(own), "n", F.col("bad").alias("__q_bad")), own, "n", total)
    failed = F.lit(False)
    for c in failures(rules).values():
        failed = failed | c
    return judged.withColumn("__q_base_failed", failed).withColumn("__q_kept", ~F.col("__q_base_failed") & F.col("__q_bad").isNull())


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """(key, the five measures, base_failed, kept) for every document."""
    src = docs.select(col(key).alias("key"), col(host).cast("string").alias("host"), col(text).alias("text"))
    measured = durable(with_measures(src).drop("text"))
    out = judge(measured, measured, "host", rules)
    return out.select(F.col("key").alias(key), *[F.col("__q_" + m).alias(m) for m in MEASURES], F.col("__q_base_failed").alias("base_failed"), F.col("__q_kept").alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The rows of docs that pass, with their columns as they are; measured twice, so that no text is stored or shuffled
    but where the list of rejected hosts is too long to broadcast."""
    rows, (t, h) = plainly(docs, text, host)
    measured = with_measures(rows.select(F.col(h).cast("string").alias("host"), t), t).drop(t)
    out = judge(with_measures(rows, t), measured, h, rules)
    return out.filter("__q_kept").select(*rows.columns).toDF(*docs.columns)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
