"""Toxicity by weak supervision: many voters, a generative model of them, and a linear classifier on what that model believes.

1. Lexicons are words and word beginnings that labelled training rows (not the held-out ones) tie to toxic texts beyond chance.
2. Lexicon voters say toxic when their part of the lexicons is met; pattern voters judge how many and how dense all hits are,
   whether any entry of a fixed list is met, or that nothing at all was. Voters may abstain.
3. A generative label model estimates by expectation maximisation how each voter votes given the hidden label, and how voters'
   errors correlate; a voter counts the less the more its votes repeat those of others.
4. A logistic classifier on the votes and hit counts is fitted to the posterior labels; it scores all texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import rows_of, texts
from ._features import Words, held_out, split, training_rows, word_hashes

#: Lengths in bytes of the word beginnings that may be lexicon entries.
BEGINNINGS = (4, 5, 6)
#: Voters that share the entries of one kind.
SHARES = 2
RIDGE = 1e-3
#: Correlation of two voters' errors from which they share their say.
COPIED = 0.5

# Words of abuse.
ABUSE = "idiot stupid moron loser trash scum worthless pathetic disgusting clown dumb fool imbecile jerk creep freak vermin filthy bastard bitch crap damn hell shit fuck asshole retard slut whore".split()


def _kinds() -> int:
    return 1 + len(BEGINNINGS)


def _seen(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, entry, texts with it, toxic texts with it), summed per chunk; kind -1 counts the texts."""
    for batch in batches:
        labels = iter(batch.column("label").to_pylist())
        with np.errstate(over="ignore"):
            for ids, chunk in rows_of([batch.select(["doc_id", "text"])]):
                y = np.array([next(labels) for _ in ids])
                words = split(chunk, letters_only=True)
                text = np.repeat(np.arange(len(chunk)), np.diff(words.first))
                out = [(np.array([-1]), np.array([0]), np.array([len(y)]), np.array([y.sum()]))]
                for kind, h in enumerate(word_hashes(words, BEGINNINGS)):
                    order = np.lexsort((text, h))
                    a, t = h[order], text[order]
                    once = np.concatenate([[True], (a[1:] != a[:-1]) | (t[1:] != t[:-1])])[: len(a)] & (a != 0)
                    a, toxic = a[once], y[t[once]]
                    if len(a):
                        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                        out.append((np.full(len(first), kind), a[first], np.diff(np.append(first, len(a))), np.add.reduceat(toxic, first)))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out)], names=["kind", "entry", "n", "toxic"])


def mine(rows: DataFrame) -> tuple[list[np.ndarray], float]:
    """(the sorted entries of each kind, the share of toxic texts) of training rows."""
    seen = rows.mapInArrow(_seen, "kind long, entry long, n long, toxic long").groupBy("kind", "entry").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    total = seen.where("kind = -1").collect()
    if not total or not 0 < total[0].toxic < total[0].n:
        return [np.zeros(0, np.int64)] * _kinds(), 0.1
    base = total[0].toxic / total[0].n
    # entries met only in toxic texts (but for one in fifty) so often that chance would not make one such entry
    candidates = seen.where("kind >= 0 and n > 1").count()
    enough = np.log(10 * max(candidates, 1)) / -np.log(base)
    sure = seen.where((F.col("kind") >= 0) & (F.col("toxic") >= float(max(3.0, enough))) & (F.col("n") - F.col("toxic") <= F.col("n") / 50))
    found = sure.select("kind", "entry").collect()  # all stand in three training texts or more, whose number has a bound
    return [np.sort(np.array([r.entry for r in found if r.kind == k], np.int64)) for k in range(_kinds())], float(base)


def _hashed(words: list[str]) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.unique(word_hashes(split([" ".join(words).encode()], letters_only=True))[0])


def _member(values: np.ndarray, entries: np.ndarray) -> np.ndarray:
    if not len(entries):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(entries, values), len(entries) - 1)
    return entries[at] == values


def counts(chunk: list[bytes], lexicons: list[np.ndarray]) -> np.ndarray:
    """For each text: its words, hits of each share of each lexicon, of any lexicon, and of the fixed list."""
    words: Words = split(chunk, letters_only=True)
    hashes = word_hashes(words, BEGINNINGS)
    columns, any_hit = [np.diff(words.first).astype(float)], np.zeros(len(words.start), bool)
    for h, entries in zip(hashes, lexicons):
        hit = _member(h, entries)
        any_hit |= hit
        columns += [words.per_word(hit & (h % SHARES == s)) for s in range(SHARES)]
    fixed = _member(hashes[0], _FIXED)
    columns += [words.per_word(any_hit), words.per_word(fixed)]
    return np.stack(columns, axis=1)


_FIXED = _hashed(ABUSE)


def votes(found: np.ndarray) -> np.ndarray:
    """Votes of the voters on texts with these counts: 1 toxic, -1 not, 0 abstains."""
    words, hits, fixed = np.maximum(found[:, 0], 1), found[:, -2], found[:, -1]
    shares = found[:, 1:-2]
    columns = [np.where(shares[:, i] > 0, 1, 0) for i in range(shares.shape[1])]
    columns += [
        np.where(fixed > 0, 1, 0),
        np.where(hits + fixed >= 2, 1, np.where(hits + fixed == 0, -1, 0)),
        np.where((hits + fixed) / words >= 0.01, 1, np.where(hits + fixed == 0, -1, 0)),
        np.where((shares > 0).sum(axis=1) + (fixed > 0) >= 2, 1, np.where((shares > 0).sum(axis=1) + (fixed > 0) == 0, -1, 0)),
        np.where((hits == 0) & (fixed == 0), -1, 1),
    ]
    return np.stack(columns, axis=1)


@dataclass
class LabelModel:
    """How voters vote given the hidden label, and how much of each voter's say is its own."""

    prior: float = 0.1
    table: np.ndarray = field(default_factory=lambda: np.zeros((0, 3, 2)))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        odds = np.full(len(cast), np.log(self.prior / (1 - self.prior)))
        for j in range(cast.shape[1]):
            odds += self.weight[j] * np.log(self.table[j, :, 1] / self.table[j, :, 0])[cast[:, j] + 1]
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit_label_model(cast: np.ndarray, prior: float, rounds: int = 30) -> LabelModel:
    """Expectation maximisation from the majority of the votes, where copies of a voter share one say; the prior stays as it is known."""
    n, m = cast.shape
    centred = cast - cast.mean(axis=0)
    spread = np.sqrt((centred * centred).mean(axis=0)) + 1e-9
    alike = np.abs((centred / spread).T @ (centred / spread)) / max(n, 1)
    say = 1 / np.maximum((alike * (alike > 0.9)).sum(axis=1), 1)
    q = np.where(cast @ say > 0, 0.9, 0.1 * prior)
    model = LabelModel(min(max(prior, 1e-3), 1 - 1e-3))
    for _ in range(rounds):
        both = np.stack([1 - q, q], axis=1)
        model.table = np.stack([np.stack([both[cast[:, j] == v].sum(axis=0) + 0.5 for v in (-1, 0, 1)]) for j in range(m)])
        model.table /= model.table.sum(axis=1, keepdims=True)
        # what is left of the votes once the label is known
        mean = (model.table * np.array([-1, 0, 1])[None, :, None]).sum(axis=1)
        rest = cast - (mean[:, 0][None] * both[:, :1] + mean[:, 1][None] * both[:, 1:])
        scale = np.sqrt((rest * rest).mean(axis=0)) + 1e-9
        correlation = np.abs((rest / scale).T @ (rest / scale)) / max(n, 1)
        # weaker ties are what doubt about the label leaves, not copying
        model.weight = 1 / np.maximum((correlation * (correlation > COPIED)).sum(axis=1), 1)
        q = model.posterior(cast)
    return model


def _inputs(found: np.ndarray) -> np.ndarray:
    cast = votes(found)
    return np.concatenate([np.ones((len(found), 1)), cast > 0, cast < 0, np.log1p(found[:, 1:])], axis=1)


def fit_linear(x: np.ndarray, target: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Weights of a logistic model of soft targets, by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    ridge = RIDGE * len(x) * np.eye(x.shape[1]) + 1e-6 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge, x.T @ (target - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Classifier:
    lexicons: list[np.ndarray]
    weights: np.ndarray

    def score(self, chunk: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_inputs(counts(chunk, self.lexicons)) @ self.weights, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Classifier:
    """Mines lexicons, fits the label model on the voters and the classifier on its posteriors, all on the bounded training rows."""
    rows = training_rows(texts(docs), labels, label).select("doc_id", "text", "label")
    lexicons, base = mine(rows)
    width = 3 + _kinds() * SHARES

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for _, chunk in rows_of(batch.select(["doc_id", "text"]) for batch in batches):
                found = counts(chunk, lexicons)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, i]) for i in range(width)], names=[f"c{i}" for i in range(width)])

    table = rows.mapInArrow(counted, ", ".join(f"c{i} double" for i in range(width))).toArrow()
    found = np.stack([c.to_numpy() for c in table.columns], axis=1) if table.num_rows else np.zeros((0, width))
    found = found[np.lexsort(found.T)]
    # one text without and one with hits stand in for a class that no row shows
    found = np.concatenate([found, np.zeros((1, width)), np.full((1, width), 5.0)])
    model = fit_label_model(votes(found), base)
    return Classifier(lexicons, fit_linear(_inputs(found), model.posterior(votes(found))))


def score(docs: DataFrame, model: Classifier, threshold: float = 0.7, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score (0 to 1), predicted (1 at ``threshold`` or more).

    Null texts are empty texts, which have a score too. Ids and rows may repeat; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for ids, chunk in rows_of(batches):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(model.score(chunk))], names=["doc_id", "score"])

    scored = texts(docs, text, doc_id).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
