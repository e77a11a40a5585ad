"""Fill-in-middle: lines of a text are cut into prefix, middle and suffix, which change places so that a model learns to fill gaps.

The lines come from a Split pre-tokenizer whose regex matches are isolated: it needs no training and gives the code-point offsets of each match. The ends of the
matches, with 0 before them, are the places where a text may be cut; their number tells how many lines there are. A keyed hash of a document's id picks two
of the places and the form, so reruns and other partitionings give the same. Every marker stands once in an output, since texts that hold one stay as
they are; that makes the text readable back from the output alone (``restored``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import CHUNK_BYTES, rows_of, texts, tidy

LINES = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM = "7", 100, 50


@lru_cache(maxsize=1)
def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(LINES), behavior="isolated")


def offsets(text: str) -> list[int]:
    """0 and the ends of all lines of ``text``, in code points.

    The splitter keeps some dozens of bytes for each character, so a long text goes to it in steps of whole lines; a line that is longer than a step is one match as it is.
    """
    found, lo = [0], 0
    while lo < len(text):
        hi = lo + CHUNK_BYTES
        if hi >= len(text):
            hi = len(text)
        else:
            hi = text.rfind("\n", lo, hi) + 1 or text.find("\n", hi) + 1 or len(text)
        if hi - lo > CHUNK_BYTES:
            found.append(hi)
        else:
            found += [lo + end for _, (_, end) in _splitter().pre_tokenize_str(text[lo:hi])]
        lo = hi
    return found


def choices(doc_id: int | None, seed: str = SEED) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document."""
    digits = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digits[8 * i : 8 * i + 8], 16) for i in range(4))


def cut(doc_id: int | None, text: str, seed: str = SEED, rate: int = RATE, spm: int = SPM) -> tuple[int, str, int | None, int | None, str]:
    """(lines, form, characters of the prefix, of the middle, output) of one text."""
    h = choices(doc_id, seed)
    ends = offsets(text)
    n = len(ends) - 1
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = (ends[i] for i in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def transform(docs: DataFrame, seed: str = SEED, rate: int = RATE, spm: int = SPM, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n (lines), form (psm, spm or plain), prefix_chars, middle_chars (null where plain), output.

    ``rate`` of 100 texts change their form, ``spm`` of 100 of these with the suffix first. Null and empty texts have no lines and stay plain, and so do texts that hold a marker. A null id
    is hashed as an empty one; rows of one id are cut alike. Bytes that are no UTF-8 are read as U+FFFD. Other columns are ignored.
    """
    kinds = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, chunk in rows_of(batches):
            made = zip(*(cut(i, t.decode("utf-8", "replace"), seed, rate, spm) for i, t in zip(ids, chunk)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, k) for x, k in zip(made, kinds.values()))], names=["doc_id", *kinds])

    return texts(docs, text, doc_id).mapInArrow(tidy(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
