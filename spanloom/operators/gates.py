"""Gates: the first rule that a labelled document breaks, and what was rejected why."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.words import LEAD, Words

# Fixed values.
TYPES = ("TRIEU_CHUNG", "CHAN_DOAN", "THUOC", "TEN_XET_NGHIEM", "KET_QUA_XET_NGHIEM", "TRIỆU_CHỨNG", "CHẨN_ĐOÁN", "THUỐC", "TÊN_XÉT_NGHIỆM", "KẾT_QUẢ_XÉT_NGHIỆM")
SHARE_FROM, SHARE_TO, CHARS_FROM, CHARS_TO, DRIFT = 0.08, 0.18, 1500, 4000, 0.15


def _covered(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    w = Words(pa.array(texts, pa.string()), wide=True)
    before = np.concatenate([[0], np.cumsum(LEAD[w.data], dtype=np.int64)])
    out = []
    for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
        first, last = (before[x[w.first[i] : w.first[i + 1]]] - before[w.at[i]] for x in (w.start, w.end))
        a, b = (np.array([] if x is None else x, np.int64) for x in (a, b))
        order = np.argsort(a, kind="stable")
        at = np.searchsorted(a[order], last) - 1
        reach = np.maximum.accumulate(b[order]) if len(b) else b
        out.append((len(first), int((reach[at[at >= 0]] > first[at >= 0]).sum())))
    return pd.DataFrame(out, columns=["words", "covered"])


def word_share(text: Column, entities: Column) -> Column:
    """The share of a text's words of which an entity (start, end) covers a character; null without words."""
    got = F.pandas_udf(_covered, "words bigint, covered bigint")(text, F.transform(entities, lambda x: x["start"]), F.transform(entities, lambda x: x["end"]))
    return F.when(got["words"] > 0, got["covered"] / got["words"])


def first_failure(docs: DataFrame, negatives: list[str] = (), baits: list[str] = (), target: dict[str, float] | None = None) -> DataFrame:
    """docs (text, entities array<struct<text, type, start, end>>) with ``reason``: C1 verbatim, C2 share of words, C3 overlap, C5 type, C6
    negatives labelled, C7 length, C8 bait missing, C9 shares of types; null if all gates are passed. C4 belongs to anchoring."""
    e, n = F.col("entities"), F.size("entities")
    share = F.col("__share")
    ordered = F.array_sort(F.transform(e, lambda x: F.struct(x["start"], x["end"])))
    after = F.when(n > 1, F.slice(ordered, F.lit(2), n - 1)).otherwise(F.slice(ordered, 1, 0))
    lapped = F.exists(F.zip_with(ordered, after, lambda x, y: F.coalesce(x["end"] > y["start"], F.lit(False))), lambda x: x)
    low = F.array(*[F.lit(x.lower()) for x in negatives]) if negatives else F.array().cast("array<string>")
    rules: list[tuple[str, Column]] = [
        ("C1", F.exists(e, lambda x: F.substr(F.col("text"), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")) != x["text"])),
        ("C2", share.isNull() | ~share.between(SHARE_FROM, SHARE_TO)),
        ("C3", lapped),
        ("C5", F.exists(e, lambda x: ~x["type"].isin(*TYPES))),
        ("C6", F.exists(e, lambda x: F.array_contains(low, F.lower(x["text"])))),
        ("C7", ~F.length("text").between(CHARS_FROM, CHARS_TO)),
    ]
    rules += [("C8", ~F.col("text").contains(b)) for b in baits]
    shares = F.transform(e, lambda x: x["type"])
    for kind, goal in (target or {}).items():
        rest = F.size(F.array_remove(shares, kind))
        rules.append(("C9", (n > 0) & (F.abs((n - rest) / F.greatest(n, F.lit(1)) - goal) > DRIFT)))
    measured = docs.withColumn("__share", word_share(F.col("text"), e))
    return measured.withColumn("reason", F.coalesce(*[F.when(c, name) for name, c in rules])).drop("__share")


def rejected(gated: DataFrame) -> DataFrame:
    """(reason, n, share)."""
    total = gated.agg(F.count(F.lit(1)).alias("all"))
    counts = gated.groupBy(F.coalesce("reason", F.lit("pass")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(total)).select("reason", "n", (F.col("n") / F.col("all")).alias("share"))
