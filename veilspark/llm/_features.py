"""Counts over the words of texts, for the classifiers: all texts of a chunk at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import mix, prefix_hashes, range_hashes

#: Labelled rows that a classifier is fitted on, at most: those of the smallest hashes.
TRAIN = 20_000
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Words:
    """The white-space words of a chunk: data[start:end] with A-Z lower-cased; those of text i are first[i]:first[i + 1]."""

    raw: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    edges: np.ndarray

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sums of a value of each byte, over each text."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.edges[1:] - 1] - total[self.edges[:-1]]

    def per_word(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of each word, over each text."""
        total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
        return total[self.first[1:]] - total[self.first[:-1]]


def split(chunk: list[bytes], letters_only: bool = False) -> Words:
    """Words of a chunk of texts; with ``letters_only`` they are runs of letters (and bytes of characters beyond ASCII)."""
    raw = np.frombuffer(b" ".join([*chunk, b""]), np.uint8)
    inside = _LETTER[raw] if letters_only else ~_SPACE[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    edges = np.cumsum([0, *(len(t) + 1 for t in chunk)])
    return Words(raw, _LOWER[raw], start, end, np.searchsorted(start, edges), edges)


def word_hashes(words: Words, sizes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """Hashes of the words, and of their first bytes for each of ``sizes`` (0 where a word is not longer)."""
    prefix = prefix_hashes(words.data)
    length = words.end - words.start
    out = [mix(range_hashes(prefix, words.start, words.end)).view(np.int64)]
    for n in sizes:
        h = mix(range_hashes(prefix, words.start, words.start + np.minimum(length, n)) + np.uint64(n)).view(np.int64)
        out.append(np.where(length > n, h, 0))
    return out


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a row is kept from learning: crc32 of its id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, label) of at most ``TRAIN`` labelled rows that are not held out; the ids are a broadcast of that bound."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    known = known.where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN)
    return docs.join(F.broadcast(known), "doc_id")
