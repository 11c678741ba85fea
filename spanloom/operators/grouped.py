"""Work on whole documents' rows in order, without a list per document: rows are dealt by document, sorted within tasks, and read as Arrow batches."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame


def _changes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Rows whose keys differ from those of the row before."""
    out = np.zeros(max(0, table.num_rows - 1), bool)
    for k in keys:
        codes = table.column(k).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = (codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes).indices.to_numpy(zero_copy_only=False)
        out |= codes[1:] != codes[:-1]
    return np.flatnonzero(out) + 1


def pick_in_groups(rows: DataFrame, keys: list[str], order: list[Column | str], used: list[str], pick: Callable[..., list[int]]) -> DataFrame:
    """The rows that ``pick`` chooses of each group: it gets lists of the columns ``used`` in ``order`` and gives the places of the chosen ones.

    A task holds the rows of one group and of a batch at a time, as Arrow tables.
    """
    kind = rows.schema
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # the group that may go on, in parts

        def settle(table: pa.Table, bounds: list[int]) -> Iterator[pa.RecordBatch]:
            lists = [table.column(c).to_pylist() for c in used]
            some = [a + i for a, b in zip(bounds, bounds[1:], strict=False) for i in pick(*[x[a:b] for x in lists])]
            if some:
                yield from table.take(pa.array(some, pa.int64())).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            first = pa.concat_tables([held[-1].slice(held[-1].num_rows - 1), table.slice(0, 1)]) if held else None
            if first is not None and len(_changes(first, keys)):
                whole = pa.concat_tables(held)
                yield from settle(whole, [0, whole.num_rows])
                held = []
            cuts = _changes(table, keys).tolist()
            if not cuts:
                held.append(table)
                continue
            done = pa.concat_tables([*held, table.slice(0, cuts[-1])])
            shift = done.num_rows - cuts[-1]
            yield from settle(done, [0, *[c + shift for c in cuts]])
            held = [table.slice(cuts[-1])]
        if held:
            whole = pa.concat_tables(held)
            yield from settle(whole, [0, whole.num_rows])

    return dealt.mapInArrow(run, kind)


def best_chain(starts: list[int], ends: list[int], scores: list) -> list[int]:
    """Of spans by end, the places of those with the largest sum that don't overlap: the best of the first i spans is that of the first i - 1, or, if that is
    strictly better, the i-th with the best of those that end by its start, which binary search finds. Read back from the last."""
    best, before = [0], []
    for i, (s, w) in enumerate(zip(starts, scores, strict=True)):
        p = bisect_right(ends, s, 0, i)
        with_it = None if w is None else w + best[p]
        taken = with_it is not None and with_it > best[i]
        before.append(p if taken else -1)
        best.append(with_it if taken else best[i])
    out, i = [], len(starts)
    while i:
        if before[i - 1] < 0:
            i -= 1
        else:
            out.append(i - 1)
            i = before[i - 1]
    return out[::-1]


class Taken:
    """Disjoint spans that were taken, by start: whether another one overlaps any is told by binary search."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int]] = []

    def take(self, start: int, end: int) -> bool:
        """Takes the span unless it overlaps one; touching isn't overlapping."""
        # of those that start before its end the last reaches furthest, as they are disjoint
        i = bisect_left(self.spans, (end,))
        if i and self.spans[i - 1][1] > start:
            return False
        self.spans.insert(bisect_left(self.spans, (start, end)), (start, end))
        return True


def greedy(starts: list[int], ends: list[int]) -> list[int]:
    """The places of spans that overlap none before them in the list that was taken."""
    taken = Taken()
    return [i for i, (s, e) in enumerate(zip(starts, ends, strict=True)) if taken.take(s, e)]
