"""Documents to units: bullets, and sentences or clauses of prose, each with its heading and zone."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import WHITE

# Fixed values.
BULLET = re.compile(rf"([ \t]*[-•*][{WHITE}]+)(.+?)[{WHITE}]*\Z")
HEADING = re.compile(r"(?:[0-9]+\.[ \t\n\x0b\f\r]*)?[A-ZÀ-ỸĐ][^\n]{3,58}\Z")
NUMBERED = re.compile(r"[0-9]+\.[ \t\n\x0b\f\r]*")
ZONE = re.compile(rf"^[{WHITE}]*[2-9]\.[{WHITE}]{{1,4}}[A-ZÀ-ỸĐ][^\n]{{3,60}}[{WHITE}]*$", re.M)
SENTENCE = re.compile(rf"[.;!?]+(?:[{WHITE}]+|\Z)")
CLAUSE = re.compile(rf",[{WHITE}]+")
WORD = re.compile(rf"[^{WHITE}]+")
LONG_SENTENCE, SHORT_PIECE, LONG_HEADING = 40, 2, 60


def heading_text(line: str) -> str | None:
    """The heading that a line is, without its number and colon; None if it is none."""
    core = line.strip(WHITE)
    if not core or len(core) > LONG_HEADING or core[-1] in ".!?" or not HEADING.match(core):
        return None
    core = core.rstrip(":")
    number = NUMBERED.match(core)
    return core[number.end() :] if number else core


def _cut(text: str, marks: re.Pattern) -> Iterator[tuple[int, int]]:
    """Begin and end of the pieces that end behind marks."""
    at = 0
    for m in marks.finditer(text):
        yield at, m.end()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def _prose(line: str) -> Iterator[tuple[str, int]]:
    for a, b in _cut(line, SENTENCE):
        long = len(WORD.findall(line[a:b])) > LONG_SENTENCE
        for c, d in _cut(line[a:b], CLAUSE) if long else ((0, b - a),):
            left = line[a + c : a + d].lstrip(WHITE)
            yield left.rstrip(WHITE), a + d - len(left)


def _line(line: str) -> tuple[str | None, bool, list[tuple[str, int]]]:
    """(heading, is it a bullet, pieces) of a line; a heading has no pieces."""
    bullet = BULLET.match(line)
    if bullet:
        made = [(bullet[2], bullet.end(1))]
    else:
        heading = heading_text(line)
        if heading is not None:
            return heading, False, []
        made = list(_prose(line))
    return None, bullet is not None, [p for p in made if len(p[0]) >= SHORT_PIECE]


def _units(text: str, seen: dict) -> Iterator[tuple[int, str, int, int, str | None, str, bool]]:
    """(unit, text, start, end, heading, zone, is_bullet) of a text; ``seen`` holds what the lines of a batch come to."""
    mark = ZONE.search(text)
    cut = mark.start() if mark else None
    at, n, heading = 0, 0, None
    for line in text.split("\n"):
        got = seen.get(line)
        if got is None:
            got = seen[line] = _line(line)
        head, bullet, pieces = got
        if head is not None:
            heading = head
        for piece, start in pieces:
            begin = at + start
            yield n, piece, begin, begin + len(piece), heading, "clinical" if cut is not None and begin >= cut else "advice", bullet
            n += 1
        at += len(line) + 1


def segment(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, unit, text, start, end, heading, zone, is_bullet). One pass over each document, batch by batch: headings are carried forward
    over its lines, so there is no shuffle."""
    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kinds = {"unit": pa.int64(), "text": pa.string(), "start": pa.int64(), "end": pa.int64(), "heading": pa.string(), "zone": pa.string(), "is_bullet": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict = {}
            found = [(i, *u) for i, t in enumerate(batch.column(1).to_pylist()) if t for u in _units(t, seen)]
            if found:
                owner, *columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), *[pa.array(c, kind) for c, kind in zip(columns, kinds.values(), strict=True)]], names=["k", *kinds])

    schema = f"k {src.schema['k'].dataType.simpleString()}, unit bigint, text string, start bigint, end bigint, heading string, zone string, is_bullet boolean"
    return src.mapInArrow(run, schema).withColumnRenamed("k", key)
