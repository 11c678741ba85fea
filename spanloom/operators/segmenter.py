"""Word segmentation by a dictionary: the best path over the lattice of words that a text's syllables may form.

Syllables are runs of letters, digits and marks, and every other sign by itself. A word of the dictionary is a run of syllables with a weight (a whole number, as
log probabilities in thousandths); a syllable that is no word has a weight of its own. The path with the largest sum is found from the text's end to its
beginning; of equal ones the one whose first word is longer, then the second, and so on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import labels

#: A dictionary of more words or characters isn't sent to all tasks.
MOST_WORDS, MOST_CHARS = 1_000_000, 32_000_000
UNKNOWN = -20_000
_SYLLABLE = re.compile(r"(?:[^\W_][̀-ͯ]*)+|[^\w\s]|_")


def best_words(syllables: list[str], weight: dict[str, int], most: int, unknown: int) -> list[int]:
    """How many syllables each word of the best path has."""
    n = len(syllables)
    best, took = [0] * (n + 1), [1] * n
    for i in range(n - 1, -1, -1):
        name, top = "", None
        for k in range(1, min(most, n - i) + 1):
            name = syllables[i] if k == 1 else f"{name} {syllables[i + k - 1]}"
            w = weight.get(name, unknown if k == 1 else None)
            if w is not None and (top is None or w + best[i + k] >= top):
                top, took[i] = w + best[i + k], k
        best[i] = top
    out, i = [], 0
    while i < n:
        out.append(took[i])
        i += took[i]
    return out


def segmented(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text", word: str = "word", weight: str = "weight", unknown: int = UNKNOWN) -> DataFrame:
    """(key, words array<struct<word, start, end>>, whole): each text's words at their places, syllables joined by ``_``; ``whole`` is false where they don't cover it.

    Words are compared in lower case, composed; of words of one form the largest weight counts. A null text is empty.
    """
    forms = dictionary.select(T.key_form(T.nfc(F.col(word))).alias("w"), F.col(weight).cast("bigint").alias("n")).filter("w <> '' and n is not null").groupBy("w").agg(F.max("n").alias("n"))
    size = forms.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum(F.length("w")), F.lit(0)).alias("chars")).first()
    if size["k"] > MOST_WORDS or size["chars"] > MOST_CHARS:
        raise ValueError(f"a dictionary of {size['k']} words doesn't go to all tasks")
    held = {r["w"]: r["n"] for r in forms.collect()}
    most = max((w.count(" ") + 1 for w in held), default=1)
    sent = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import unicodedata

        for batch in batches:
            out = []
            for raw in batch.column(1).to_pylist():
                said = _SYLLABLE.findall(raw or "")
                sizes = best_words([unicodedata.normalize("NFC", s).lower() for s in said], sent.value, most, unknown)
                words, i = [], 0
                for k in sizes:
                    words.append("_".join(said[i : i + k]))
                    i += k
                out.append(words)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.string()))], names=["k", "t", "said"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, t string, said array<string>")
    at = labels.aligned_words(F.col("t"), F.col("said"))
    return rows.select(F.col("k").alias(key), at.alias("a")).select(key, "a.words", "a.whole")
