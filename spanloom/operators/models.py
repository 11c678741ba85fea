"""Models as callables: prompts to replies, token vectors to embeddings. A model is made by a factory, once in each task, and asked in batches; none is included."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH = 64


def _asked(rows: DataFrame, column: str, factory: Callable[[], Callable], batch: int, out: str, kind: str, to_arrow: Callable[[list], pa.Array]) -> DataFrame:
    """rows with ``out``: what the model gives for a column's values, null for nulls."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    at = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for b in batches:
            values = b.column(at).to_pylist()
            known, got = [i for i, v in enumerate(values) if v is not None], [None] * len(values)
            for i in range(0, len(known), batch):
                model = model or factory()
                some = known[i : i + batch]
                said = list(model([values[k] for k in some]))
                if len(said) != len(some):
                    raise ValueError(f"the model gave {len(said)} answers to {len(some)} questions")
                for k, x in zip(some, said, strict=True):
                    got[k] = x
            yield pa.RecordBatch.from_arrays([*b.columns, to_arrow(got)], names=[*b.schema.names, out])

    return rows.mapInArrow(run, f"{fields}, `{out}` {kind}")


def replied(rows: DataFrame, factory: Callable[[], Callable[[list[str]], list[str]]], prompt: str = "prompt", reply: str = "reply", batch: int = BATCH) -> DataFrame:
    """rows with the model's reply to each prompt. Prompts that are equal are asked as often as they occur; a task that runs again asks again."""
    return _asked(rows, prompt, factory, batch, reply, "string", lambda got: pa.array(got, pa.string()))


def embedded(rows: DataFrame, factory: Callable[[], Callable[[list[str]], list[np.ndarray]]], text: str = "text", vector: str = "vector", batch: int = BATCH) -> DataFrame:
    """rows with an embedding of each text: the model gives a row for each token, whose mean is scaled to length 1; zeros and texts without tokens give null."""

    def pooled(got: list) -> pa.Array:
        out = []
        for tokens in got:
            mean = None if tokens is None or not len(tokens) else np.asarray(tokens, np.float64).mean(axis=0)
            n = 0.0 if mean is None else float(np.linalg.norm(mean))
            out.append((mean / n).tolist() if n > 0 else None)
        return pa.array(out, pa.list_(pa.float64()))

    return _asked(rows, text, factory, batch, vector, "array<double>", pooled)


def unasked(rows: DataFrame, replies: DataFrame, key: str) -> DataFrame:
    """Rows that have no reply yet, so that a run that was stopped goes on where it was."""
    done = replies.filter(F.col("reply").isNotNull()).select(F.col(key).alias("__k")).distinct()
    return rows.join(done, F.col(key).eqNullSafe(F.col("__k")), "left_anti")
