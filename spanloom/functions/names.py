"""Dictionary names in texts of whole Arrow batches: n-grams are looked up by the hashes of their words' forms, so that only those that are names become rows.

A dictionary goes to all tasks as two sorted 64-bit hashes a name (names are told apart by both), within MOST_NAMES names and MOST_CHARS characters; longer ones are for
an equi-join. An n-gram's form is that of its words with a blank between, those with an empty form (marks alone) left out; so is its hash.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.functions.words import LEAD, Words

MOST_NAMES, MOST_CHARS = 4_000_000, 128_000_000
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_KEPT = 1 << 20


def key_word(word: str) -> str:
    """``text.key_form`` of a word."""
    return word.lower()


_BARE = str.maketrans(T._MARKED, T._BARE)


def plain_word(word: str) -> str:
    """``text.plain_form`` of a word."""
    if word.isascii():
        return word.lower()
    return "".join(c for c in word.translate(_BARE) if unicodedata.category(c) != "Mn").lower()


def _hashes(form: str) -> tuple[int, int]:
    raw = hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:], "little")


class Lexicon:
    """Names in their compared form."""

    def __init__(self, names: list[str]):
        mask, pairs = (1 << 64) - 1, set()
        for name in names:
            a = b = 0
            for word in name.split(" "):
                if word:
                    x, y = _hashes(word)
                    a, b = (a * int(_ODD[0]) + x) & mask, (b * int(_ODD[1]) + y) & mask
            if a or b:
                pairs.add((a, b))
        held = np.array(sorted(pairs), np.uint64).reshape(-1, 2)
        self.a, self.b = np.ascontiguousarray(held[:, 0]), np.ascontiguousarray(held[:, 1])

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.a):
            return np.zeros(len(a), bool)
        lo = np.searchsorted(self.a, a)
        out = np.zeros(len(a), bool)
        near = np.flatnonzero(self.a[np.minimum(lo, len(self.a) - 1)] == a)
        for i in near.tolist():  # names whose first hashes agree stand together
            k = int(lo[i])
            while k < len(self.a) and self.a[k] == a[i]:
                if self.b[k] == b[i]:
                    out[i] = True
                    break
                k += 1
        return out


def lexicon_of(names: DataFrame, name: str, form: Callable) -> Lexicon | None:
    """The names of a table, or None if there are too many for all tasks to hold."""
    forms = names.select(form(F.col(name)).alias("n")).filter("n <> ''").distinct()
    size = forms.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum(F.length("n")), F.lit(0)).alias("chars")).first()
    if size["k"] > MOST_NAMES or size["chars"] > MOST_CHARS:
        return None
    return Lexicon([r["n"] for r in forms.collect()])


class Texts:
    """A batch of texts with the forms of their words; ``form`` is that of a word. Words are numbered over the batch."""

    def __init__(self, texts: pa.Array, form: Callable[[str], str], kept: dict):
        self.w = w = Words(texts, wide=True)
        self.owner = np.repeat(np.arange(len(w)), np.diff(w.first))
        _, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
        a, b, empty = np.zeros(len(first), np.uint64), np.zeros(len(first), np.uint64), np.zeros(len(first), bool)
        for k, i in enumerate(first.tolist()):
            raw = w.data[w.start[i] : w.end[i]].tobytes()
            got = kept.get(raw)
            if got is None:
                word = form(raw.decode("utf-8", "surrogatepass"))
                got = (*_hashes(word), not word)
                if len(kept) >= _KEPT:
                    kept.clear()
                kept[raw] = got
            a[k], b[k], empty[k] = got
        self.a, self.b, self.empty = a[back], b[back], empty[back]
        self.before = np.concatenate([[0], np.cumsum(LEAD[w.data], dtype=np.int64)])
        self.base = self.before[w.at[:-1]]

    def word(self, i: int) -> str:
        return self.text(i, i)

    def text(self, i: int, j: int) -> str:
        """From word i to word j."""
        return self.w.data[self.w.start[i] : self.w.end[j]].tobytes().decode("utf-8", "surrogatepass")

    def behind(self, i: int, words: int = 3) -> str:
        """What follows word i in its text, up to the end of so many words."""
        last = min(i + words, int(self.w.first[self.owner[i] + 1]) - 1)
        end = int(self.w.end[last]) if last > i else int(self.w.end[i])
        return self.w.data[self.w.end[i] : end].tobytes().decode("utf-8", "surrogatepass")

    def start(self, i: int) -> int:
        return int(self.before[self.w.start[i]] - self.base[self.owner[i]])

    def end(self, i: int) -> int:
        return int(self.before[self.w.end[i]] - self.base[self.owner[i]])

    def grams(self, names: Lexicon, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, number of words) of the n-grams that are names."""
        m = len(self.owner)
        if not m:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        last = self.w.first[self.owner + 1]
        a, b, at, size = np.zeros(m, np.uint64), np.zeros(m, np.uint64), [], []
        with np.errstate(over="ignore"):
            for n in range(1, most + 1):
                j = np.arange(n - 1, m + n - 1)
                inside = j < last
                j = np.minimum(j, m - 1)
                more = inside & ~self.empty[j]
                a, b = np.where(more, a * _ODD[0] + self.a[j], a), np.where(more, b * _ODD[1] + self.b[j], b)
                some = np.flatnonzero(inside & ((a != 0) | (b != 0)))
                hit = some[names.holds(a[some], b[some])]
                at.append(hit)
                size.append(np.full(len(hit), n, np.int64))
        return np.concatenate(at), np.concatenate(size)

    def form(self, i: int, n: int, form: Callable[[str], str]) -> str:
        return " ".join(x for x in (form(self.word(k)) for k in range(i, i + n)) if x)


def longest(at: list[int], size: list[int]) -> list[int]:
    """The places of the n-grams that are taken: longest first, then from the left, no word twice. Words taken are marked, so each n-gram costs its own words."""
    used: set[int] = set()
    out = []
    for k in sorted(range(len(at)), key=lambda k: (-size[k], at[k])):
        mine = range(at[k], at[k] + size[k])
        if used.isdisjoint(mine):
            used.update(mine)
            out.append(k)
    return out
