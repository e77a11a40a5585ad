"""Near-duplicate documents by bottom-k sketches of one hash function.

Words are the runs of ``[^\\x20\\x09-\\x0D]`` of the text with A-Z lower-cased; a document's set holds its distinct
``shingle``-word shingles (a shorter text is one shingle). Of the 64-bit hashes of a set the ``k`` smallest are its sketch.

1. Rows with equal sets form a class; its smallest id stands for it.
2. Retained values met in two sketches or more make inverted lists. Sketches of sets as similar as asked share at least
   ``needed`` values (but for one pair in ``1 / MISS``), so lists of each sketch's rarest ``size - needed + 1`` values meet
   every such pair; values that only one sketch has take up places first, and common passages seldom have a list.
3. Lists of at most ``SHORT`` members are paired out. Longer ones are gathered by their most typical member, the hub (values of one
   passage mostly have the same), with which each member is paired.
4. Estimates on the union sketch filter the pairs; full sets, made again from the texts, confirm the rest.
5. Members of one hub that the confirmed links leave in different components meet in blocks, where the full sets are
   compared and each member is tied to the first one that it reaches. Nothing is capped or dropped.
6. Components of all links, with the classes, give the result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, components, lists, mix, prefix_hashes, range_hashes, rows_of, texts, tidy

SKETCH = 96
#: Chance that a pair at the threshold has no value in common in the inverted lists.
MISS = 1e-9
SHORT = 8
#: Members of one hub that meet in one task, on each side, and values of their sets; a single larger set is a block of its own size.
BLOCK, ITEMS = 2048, 1 << 21
#: Block pairs with a value from which it is counted by matrix product.
DENSE = 20_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def needed(k: int, similarity: float, miss: float = MISS) -> int:
    """Values of the union's bottom k that both sets have, at least, but with chance ``miss``."""
    total = 0.0
    for i in range(k + 1):
        total += math.comb(k, i) * similarity**i * (1 - similarity) ** (k - i)
        if total > miss:
            return max(1, i)
    return k


def shingle_sets(chunk: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = np.frombuffer(b" ".join([*chunk, b""]), np.uint8)
    data = _LOWER[data]
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    words = mix(range_hashes(prefix_hashes(data), start, end) + mix((end - start).astype(np.uint64)))
    ends = np.cumsum([len(t) + 1 for t in chunk])
    last = np.searchsorted(start, ends)
    rows = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        rows = mix(rows) + words[j : j + len(rows)] if len(rows) else rows
    rows = mix(rows).view(np.int64)
    first = 0
    for n in last.tolist():
        if n - first >= width:
            yield np.unique(rows[first : n - width + 1])
        elif n > first:
            one = np.uint64(n - first)
            for j in range(first, n):
                one = mix(np.array([one]))[0] + words[j]
            yield mix(np.array([one])).view(np.int64)
        else:
            yield np.zeros(0, np.int64)
        first = n


def _sketches(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for ids, chunk in rows_of(batches):
                sets = list(shingle_sets(chunk, width))
                kept = [s[:k] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        lists(np.cumsum([0, *map(len, kept)]), np.concatenate([*kept, np.zeros(0, np.int64)])),
                    ],
                    names=["doc_id", "n_shingles", "sig", "sketch"],
                )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for ids, chunk in rows_of(batches):
                sets = list(shingle_sets(chunk, width))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists(np.cumsum([0, *map(len, sets)]), np.concatenate([*sets, np.zeros(0, np.int64)]))], names=["rep", "items"])

    return run


def _pairs_that(passes):
    """Batches of (a, b, items_a, items_b) to the (a, b) whose two sorted sets pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for name in ("items_a", "items_b"):
                column = batch.column(name)
                sides.append((column.offsets.to_numpy(), column.values.to_numpy()))
            (oa, va), (ob, vb) = sides
            keep = [passes(va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]]) for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return int(np.count_nonzero(both[1:] == both[:-1]))


def _estimated(k: int, percent: int, least: int):
    def passes(x: np.ndarray, y: np.ndarray) -> bool:
        if len(x) < k and len(y) < k:  # both sketches are the whole sets
            same = _common(x, y)
            return 100 * same >= percent * (len(x) + len(y) - same)
        union = np.union1d(x, y)[:k]
        return _common(np.intersect1d(x, y), union) >= least

    return passes


def _confirmed(percent: int):
    def passes(x: np.ndarray, y: np.ndarray) -> bool:
        same = _common(x, y)
        return 100 * same >= percent * (len(x) + len(y) - same)

    return passes


def _shared(asks: list[np.ndarray], told: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of one list with those of the other."""
    values = np.concatenate([*asks, *told])
    owner = np.repeat(np.arange(len(asks) + len(told)), [*map(len, asks), *map(len, told)])
    order = np.argsort(values, kind="stable")
    owner = owner[order]
    cuts = np.flatnonzero(np.diff(values[order])) + 1
    first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(owner)]])
    counts = np.zeros((len(asks), len(told)), np.float32)
    dense = []
    for a, b in zip(first[last - first > 1].tolist(), last[last - first > 1].tolist()):
        part = owner[a:b]  # ascending, as the sort is stable
        m = int(np.searchsorted(part, len(asks)))
        if m * (len(part) - m) > DENSE:
            dense.append((part[:m], part[m:] - len(asks)))
        elif 0 < m < len(part):
            counts[np.ix_(part[:m], part[m:] - len(asks))] += 1
    for lo in range(0, len(dense), 256):
        some = dense[lo : lo + 256]
        x, y = np.zeros((len(asks), len(some)), np.float32), np.zeros((len(some), len(told)), np.float32)
        for i, (p, q) in enumerate(some):
            x[p, i] = 1
            y[i, q] = 1
        counts += x @ y
    return counts


def _blocks(percent: int):
    """Ties the members of two blocks of a hub to the first member that they reach by links between the blocks."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        rep, comp, side = (table.column(c).to_numpy() for c in ("rep", "comp", "side"))
        items = table.column("items").chunk(0)
        offsets, values = items.offsets.to_numpy(), items.values.to_numpy()
        sets = [values[offsets[i] : offsets[i + 1]] for i in range(len(rep))]
        q, t = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        same = _shared([sets[i] for i in q], [sets[i] for i in t])
        sizes = np.array([len(x) for x in sets], np.float32)
        i, j = np.nonzero((100 * same >= percent * (sizes[q][:, None] + sizes[t][None] - same)) & (comp[q][:, None] != comp[t][None]))
        label = np.array(rep)
        i, j = q[i], t[j]
        while len(i):
            least = np.minimum(label[i], label[j])
            before = label.copy()
            np.minimum.at(label, i, least)
            np.minimum.at(label, j, least)
            if (label == before).all():
                break
        tied = label != rep
        return pa.table({"a": label[tied], "b": rep[tied]})

    return run


def near_duplicates(docs: DataFrame, similarity: float = 0.75, shingle: int = 5, k: int = SKETCH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Links join sets of Jaccard similarity ``similarity`` (in whole hundredths) or more; ``component_id`` is the smallest id reachable by links.
    Null or blank texts have no shingles and link with nothing. Rows whose id is null take no part: their component is
    null and they are kept. Rows that repeat an id are judged each by its own text. Other columns are ignored. An empty table gives an empty result.
    """
    percent, least = round(100 * similarity), needed(k, similarity)
    scratch = Scratch(docs.sparkSession)
    source = texts(docs, text, doc_id)
    made = scratch.save(source.mapInArrow(tidy(_sketches(shingle, k)), "doc_id long, n_shingles long, sig binary, sketch array<long>"), "made")
    classes = scratch.save(made.where("n_shingles > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")), "classes")
    reps = scratch.save(made.join(classes.select("sig", "rep", "n"), "sig").where("doc_id = rep").dropDuplicates(["sig"]).select("rep", "n", "sketch"), "reps")

    retained = reps.select("rep", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    met = retained.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = scratch.save(retained.join(met, "value"), "shared")
    # what a set needs in common with any partner: all of it is retained on both sides while n <= 3/4 k
    need = F.when(F.col("n") * 100 <= k * percent, F.ceil(F.col("n") * percent / 100)).otherwise(F.lit(least))
    ranked = shared.groupBy("rep").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("df", "value"))).alias("found"))
    places = F.col("size") - need + 1 - (F.col("size") - F.size("found"))
    listed = scratch.save(
        ranked.withColumn("alone", F.col("size") - F.size("found")).where(places > 0).select("rep", "n", "alone", F.explode(F.slice("found", 1, places.cast("int"))).alias("x")).select("rep", "n", "alone", "x.value"), "listed"
    )
    # lists as they are after the cut
    length = listed.groupBy("value").agg(F.count("*").alias("members"), F.min(F.struct("alone", "rep", "n")).alias("hub")).where("members > 1")
    length = scratch.save(length, "length")
    fits = (F.least("n", "m") * 100 >= percent * F.greatest("n", "m")) & (F.col("rep") != F.col("other"))
    short = listed.join(length.where(F.col("members") <= SHORT).select("value"), "value").groupBy("value").agg(F.collect_list(F.struct("rep", "n")).alias("all"))
    paired = short.select(F.explode("all").alias("x"), "all").select("x.rep", "x.n", F.explode("all").alias("y")).select("rep", "n", F.col("y.rep").alias("other"), F.col("y.n").alias("m")).where("rep < other")
    hubs = listed.join(length.where(F.col("members") > SHORT).select("value", F.col("hub.rep").alias("other"), F.col("hub.n").alias("m")), "value")
    hubs = scratch.save(hubs.select("rep", "n", "other", "m").distinct(), "hubs")
    pairs = scratch.save(paired.union(hubs).where(fits).select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct(), "pairs")
    likely = scratch.save(_both(pairs, reps.select("rep", F.col("sketch").alias("items")), _estimated(k, percent, least)), "likely")
    ids = likely.select(F.col("a").alias("doc_id")).union(likely.select("b")).union(hubs.select("rep")).distinct()
    sets = scratch.save(source.join(ids.hint("merge"), "doc_id", "left_semi").mapInArrow(tidy(_sets(shingle)), "rep long, items array<long>"), "sets")
    links = scratch.save(_both(likely, sets, _confirmed(percent)), "links")
    labels = components(links, scratch, "cc0")
    known = hubs.select("rep", "other", "n").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("other").alias("hub"), "rep", "n", F.coalesce("component", "rep").alias("comp"))
    known = scratch.save(known, "known")
    mixed = known.groupBy("hub").agg(F.count("*").alias("members"), F.sum("n").alias("values"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    mixed = mixed.select("hub", F.ceil(F.greatest(F.col("members") / BLOCK, F.col("values") / ITEMS)).cast("int").alias("blocks"))
    at = known.drop("n").join(mixed, "hub").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).join(sets, "rep")
    each = F.sequence(F.lit(0), F.col("blocks") - 1)
    asks = at.select("hub", "rep", "comp", "items", F.lit(0).alias("side"), F.col("block").alias("i"), F.explode(each).alias("j")).where("i <= j")
    told = at.select("hub", "rep", "comp", "items", F.lit(1).alias("side"), F.explode(each).alias("i"), F.col("block").alias("j")).where("i <= j")
    tied = scratch.save(asks.union(told).groupBy("hub", "i", "j").applyInArrow(_blocks(percent), "a long, b long").distinct(), "tied")
    if not tied.isEmpty():
        labels = components(links.union(tied), scratch, "cc1")
    scratch.drop("shared", "listed", "length", "hubs", "pairs", "likely", "sets", "known", "reps")
    group = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("sig", F.coalesce("component", "rep").alias("found"))
    out = made.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("sig")).alias("sig")).join(group, "sig", "left")
    component = F.coalesce("found", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _both(pairs: DataFrame, items: DataFrame, passes) -> DataFrame:
    """The pairs whose two sets pass."""
    sides = [items.select(F.col("rep").alias(x), F.col("items").alias(f"items_{x}")) for x in "ab"]
    met = pairs.join(sides[1], "b").join(sides[0], "a").select("a", "b", "items_a", "items_b")
    return met.mapInArrow(tidy(_pairs_that(passes)), "a long, b long").distinct()
