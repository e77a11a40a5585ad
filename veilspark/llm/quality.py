"""Document quality by a generalised additive model with pairwise interactions.

Each numeric feature of a text is cut into bins. Boosting goes over the features in turn, each time fitting a tree of few leaves over
that feature's bins to the gradients left so far; the trees of a feature add up to one lookup table. Then the pairs whose
joint bins explain most of what is left get tables of their own in the same way. A score is the sum of looked-up
values, so it can be read feature by feature.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import rows_of, texts, tidy
from ._features import held_out, split, training_rows, word_hashes

BINS, ROUNDS, RATE, LEAVES = 32, 120, 0.2, 4
PAIRS, PAIR_BINS, PAIR_ROUNDS = 6, 8, 40
FEATURES = ("words", "word_length", "distinct", "repeated", "commonest", "letters", "upper", "digits", "marks", "symbols", "doubled", "line_words", "short_words", "long_words")


def features(chunk: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text; a text without words has zeros."""
    words = split(chunk)
    n = np.diff(words.first)
    least = np.maximum(n, 1)
    size = np.maximum(np.diff(words.edges) - 1, 1)
    raw = words.raw
    (hashes,) = word_hashes(words)
    length = words.end - words.start
    text = np.repeat(np.arange(len(chunk)), n)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    distinct, commonest = np.zeros(len(chunk)), np.zeros(len(chunk))
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
        if b > a:
            own = np.sort(hashes[a:b])
            cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            distinct[i], commonest[i] = len(cut) - 1, np.diff(cut).max()
    high = raw >= 128
    upper = (raw >= 65) & (raw <= 90)
    letter = upper | ((raw >= 97) & (raw <= 122)) | high
    digit = (raw >= 48) & (raw <= 57)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    plain = (raw == 44) | (raw == 46)  # comma, full stop
    symbol = ~(letter | digit | space | plain)
    doubled = np.zeros(len(raw), bool)
    doubled[1:] = symbol[1:] & (raw[1:] == raw[:-1])
    lines = words.per_text(raw == 10) + 1
    out = np.stack(
        [
            np.log1p(n), words.per_word(length) / least, distinct / least, words.per_word(again) / least, commonest / least,
            words.per_text(letter) / size, words.per_text(upper) / size, words.per_text(digit) / size, words.per_text(plain) / size, words.per_text(symbol) / size,
            words.per_text(doubled) / size, np.log1p(n / lines), words.per_word(length <= 2) / least, words.per_word(length >= 14) / least,
        ],
        axis=1,
    )
    return np.where((n > 0)[:, None], out, 0.0)


@dataclass
class Additive:
    """Lookup tables over binned features and pairs of them."""

    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1) if len(self.edges) else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[b[:, f]]
        for f, g, table in self.pairs:
            total += table[self.coarse[f][b[:, f]], self.coarse[g][b[:, g]]]
        return 1 / (1 + np.exp(-total))


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Newton steps of a tree with at most ``leaves`` leaves over ordered bins with gradient and curvature sums."""
    parts = [(0, len(g))]
    sg, sh = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for part, (a, b) in enumerate(parts):
            at = np.arange(a + 1, b)
            if len(at):
                gain = _leaf(sg[at] - sg[a], sh[at] - sh[a]) + _leaf(sg[b] - sg[at], sh[b] - sh[at]) - _leaf(sg[b] - sg[a], sh[b] - sh[a])
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), part, a + 1 + k)
        if best[1] is None:
            break
        a, b = parts.pop(best[1])
        parts += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (sg[b] - sg[a]) / (sh[b] - sh[a] + 1.0)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, steps) of the best tree of a cut in each of two features."""
    sg, sh = (np.pad(x.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0))) for x in (g, h))
    total = _leaf(sg[-1, -1], sh[-1, -1])
    r, c = sg.shape[0] - 1, sg.shape[1] - 1
    best, steps = 0.0, np.zeros_like(g)
    for i, j in itertools.product(range(1, r), range(1, c)):
        corners = [(slice(a, b), slice(x, y), *(s[b, y] - s[a, y] - s[b, x] + s[a, x] for s in (sg, sh))) for a, b in ((0, i), (i, r)) for x, y in ((0, j), (j, c))]
        gain = sum(_leaf(cg, ch) for *_, cg, ch in corners) - total
        if gain > best:
            best = gain
            for rows, columns, cg, ch in corners:
                steps[rows, columns] = cg / (ch + 1.0)
    return best, steps


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """The model of rows ``x`` with labels 0 and 1; without rows every score is one half."""
    model = Additive()
    if not len(x):
        return model
    model.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    rate = (y.sum() + 1) / (len(y) + 2)
    model.base = float(np.log(rate / (1 - rate)))
    b = model.bins(x)
    sizes = [len(e) + 1 for e in model.edges]
    model.tables = [np.zeros(s) for s in sizes]
    model.coarse = [np.minimum(np.arange(s) * PAIR_BINS // s, PAIR_BINS - 1) for s in sizes]
    total = np.full(len(y), model.base)

    def left() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, s in enumerate(sizes):
            g, h = left()
            step = RATE * _tree(np.bincount(b[:, f], g, s), np.bincount(b[:, f], h, s), LEAVES)
            model.tables[f] += step
            total += step[b[:, f]]
    joint = {(f, g): model.coarse[f][b[:, f]] * PAIR_BINS + model.coarse[g][b[:, g]] for f, g in itertools.combinations(range(len(sizes)), 2)}

    def grid(pair: tuple[int, int]) -> tuple[float, np.ndarray]:
        g, h = left()
        return _quadrants(*(np.bincount(joint[pair], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h)))

    chosen = sorted(((grid(p)[0], p) for p in joint), reverse=True)[:PAIRS]
    tables = {p: np.zeros((PAIR_BINS, PAIR_BINS)) for _, p in chosen}
    for _ in range(PAIR_ROUNDS):
        for p, table in tables.items():
            step = RATE * grid(p)[1]
            table += step
            total += step.reshape(-1)[joint[p]]
    model.pairs = [(f, g, t) for (f, g), t in tables.items()]
    return model


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = iter(batch.column("label").to_pylist())
        with np.errstate(over="ignore"):
            for ids, chunk in rows_of([batch.select(["doc_id", "text"])]):
                x = features(chunk)
                columns = [pa.array([next(labels) for _ in ids], pa.int32())] + [pa.array(x[:, i]) for i in range(x.shape[1])]
                yield pa.RecordBatch.from_arrays(columns, names=["label", *FEATURES])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Additive:
    """Fits the model on the bounded sample of labelled rows that are not held out."""
    rows = training_rows(texts(docs), labels, label).select("doc_id", "text", "label")
    table = rows.mapInArrow(tidy(_measured), "label int, " + ", ".join(f"{f} double" for f in FEATURES)).toArrow()
    x = np.stack([table.column(f).to_numpy() for f in FEATURES], axis=1)
    y = table.column("label").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the same model whatever order the rows come in
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Additive, threshold: float = 0.5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 at ``threshold`` or more).

    Null texts are empty texts, which have a score too. Ids and rows may repeat; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for ids, chunk in rows_of(batches):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(model.score(features(chunk)))], names=["doc_id", "score"])

    scored = texts(docs, text, doc_id).mapInArrow(tidy(run), "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Additive, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all their columns."""
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                data = pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows), pa.int64()), batch.column(at).cast(pa.binary()).fill_null(b"")], names=["row", "text"])
                good = [model.score(features(chunk)) >= threshold for _, chunk in rows_of([data])]
                yield batch.filter(pa.array(np.concatenate([*good, np.zeros(0, bool)]), pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
