"""Byte-level BPE with the tiktoken library and a local rank file.

Long texts are split beforehand where no match of the pattern can cross: in front of a white-space run that follows a
non-space character (every alternative of the pattern has white space only at its front, and the look-ahead of ``\\s+(?!\\S)``
sees the same characters, as a run always stays with what follows it). Runs of RUN white-space characters or more never reach the
regular expression, whose look-ahead would exhaust the stack: all of a run but its last character (all of it at the end of the text) is
one match of ``\\s+(?!\\S)``, and is merged as one piece. Patterns that don't end in ``|\\s+(?!\\S)|\\s+``, or
have white space elsewhere but as an optional leading blank, are not split. Ids are decoded to raw bytes, token by token,
so that a character cut by a token boundary comes back whole.

The rank file is read where the operator is called and its bytes are broadcast, so executors need no file.

Defined results: a null or empty text has no ids and decodes to nothing, however long it is otherwise all of it is encoded;
special-token strings in a text are plain text; rows are kept one for one, repeated ones too; other columns of the input don't
matter and may have any name; a table without rows gives none.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.core import col, lean

#: The Unicode property White_Space, which ``\\s`` stands for in the library's patterns.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SAFE = re.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
#: White-space runs of so many characters are encoded apart.
RUN = 4096
_loaded: dict[tuple, tuple] = {}


def encoding(ranks: str | bytes, pattern: str) -> tuple[tiktoken.Encoding, dict[int, bytes], bool]:
    """The encoding of a rank file or its bytes (base64 token, space, rank on each line), its bytes by id, and whether texts may be split
    for this pattern; made once per process."""
    # by hash and length: bytes keep their hash, while equal ones of two broadcasts would be compared in full for every text
    key = (hash(ranks), len(ranks), pattern)
    if key not in _loaded:
        raw = ranks if isinstance(ranks, bytes) else read_ranks(ranks)
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, raw.splitlines()))}
        _loaded[key] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={}), {v: k for k, v in table.items()}, splits(pattern)
    return _loaded[key]


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def splits(pattern: str) -> bool:
    """Whether white space can only begin a match of the pattern, as one blank or as a run by the last two alternatives."""
    tail = r"|\s+(?!\S)|\s+"
    head = pattern.removesuffix(tail)
    if head == pattern:
        return False
    for part in head.split("|"):
        rest = re.sub(r"\[\^\\s[^\]]*\]", "", part.removeprefix(" ?"))
        if " " in rest or "\\s" in rest or "\\S" in rest or "(?" in rest or "." in rest:
            return False
    return True


def pieces(text: str, most: int = 1 << 16) -> Iterator[str]:
    """Cuts a long text at safe boundaries into pieces of about ``most`` characters."""
    i = 0
    while len(text) - i > most:
        m = _SAFE.search(text, i + most)
        if not m:
            break
        yield text[i : m.start()]
        i = m.start()
    yield text[i:]


def encode_text(text: str | None, ranks: str | bytes, pattern: str, run: int = RUN) -> list[int]:
    enc, _, safe = encoding(ranks, pattern)
    text = text or ""
    if not safe:
        return enc.encode_ordinary(text)
    out: list[int] = []
    i = 0
    for m in re.finditer(f"[{_SPACE}]{{{run},}}", text) if len(text) >= run else ():
        for piece in pieces(text[i : m.start()]):
            out += enc.encode_ordinary(piece)
        i = m.end() - (m.end() < len(text))
        if i > m.start():
            out += enc._encode_single_piece(text[m.start() : i])
    for piece in pieces(text[i:]):
        out += enc.encode_ordinary(piece)
    return out


def decode_ids(ids: list[int], ranks: str | bytes, pattern: str) -> bytes:
    return b"".join(map(encoding(ranks, pattern)[1].__getitem__, ids))


def encode(df: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) for every row."""
    held = _held(df, ranks)
    return _rows(df, key, text, "ids array<int>", lambda t: (encode_text(t, held.value, pattern),))


def decode(df: DataFrame, ranks: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, bytes binary) for every row of ids; null ids are none."""
    held = _held(df, ranks)
    return _rows(df, key, ids, "bytes binary", lambda x: (decode_ids(x or [], held.value, pattern),))


def _held(df: DataFrame, ranks: str) -> Broadcast:
    """The rank file's bytes on all executors: a vocabulary, some megabytes whatever the table."""
    return df.sparkSession.sparkContext.broadcast(read_ranks(ranks))


def round_trip(df: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): encodes, decodes what was encoded, and digests both in one pass.

    The ids' digest is over their decimal forms joined by one space, the other over the decoded bytes.
    """

    held = _held(df, ranks)

    def row(t: str | None) -> tuple:
        ids = encode_text(t, held.value, pattern)
        names = _names(encoding(held.value, pattern)[0].max_token_value)
        return len(ids), hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(decode_ids(ids, held.value, pattern)).hexdigest()

    return _rows(df, key, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", row)


_decimal: list[str] = []


def _names(n: int) -> list[str]:
    if len(_decimal) < n + 1:
        _decimal[:] = map(str, range(n + 1))
    return _decimal


def _rows(df: DataFrame, key: str, value: str, out: str, f: Callable, at_once: int = 256) -> DataFrame:
    src = df.select(col(key).alias("k"), col(value).alias("v"))
    types = src.schema["k"].dataType.simpleString()
    names = [x.split()[0] for x in out.split(", ")]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, at_once):
                part = batch.slice(i, at_once)
                cols = list(zip(*[f(v.as_py()) for v in part.column(1)], strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, _ARROW.get(t.split()[1])) for c, t in zip(cols, out.split(", "), strict=True)]], names=[key, *names])

    return src.mapInArrow(run, f"`{key}` {types}, {out}")


_ARROW = {"array<int>": pa.list_(pa.int32()), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
