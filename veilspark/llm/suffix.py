"""Repeated passages across a corpus: byte strings of a given length that start in more than one place.

A string of ``length`` bytes is filed under the smallest hash of its ``length // 4``-byte grams (leftmost first), so equal strings are
filed under the same anchor, at the same distance from it. Consecutive starts under one anchor make a run, whose bytes
(the starts and the last string) are its segment.

1. Of a text's own equal runs the first one goes on, so lines and signs that repeat within a text cost one row.
2. Runs stand in blocks, which end where an anchor's hash says so. Equal blocks repeat each other entirely; one of each class goes on, so
   whole copied passages cost few rows.
3. Anchors met once hold nothing repeated. This needs no text beyond the first reading.
4. Runs of one anchor with equal segments repeat each other entirely. Again one of each class goes on.
5. Anchors with classes that differ get their segments' bytes; there the previous and the next smaller position of each start in
   suffix order give its longest previous factor, and the previous and next larger ones the longest later one. Anchors with more than
   ``HOT`` classes, whose bytes no one task may hold, have their runs cut again: into pieces of equal distances from the anchor, then the
   pieces that share what all their strings share into single starts. Equal pieces and equal strings are found by grouping.
6. The covered bytes go: of every copy, or of all but the first in order of (doc_id, position).

Texts are told apart by digest, so rows with equal texts cost one analysis. Matches never cross texts.

``passages_and_repeats`` tells two lengths at once: what strings of the longer one cover lies within what those of the shorter one cover, so only
that part of the texts is read for it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, mix, prefix_hashes, range_hashes, rows_of, texts, tidy

LENGTH = 400
#: Bytes of a passage of about fifty words: more than by chance two texts have in common.
PASSAGE = 250
#: Bytes of one text that are hashed at once; longer texts go in overlapping pieces.
PIECE = 1 << 18
#: Bytes of segments that one suffix array covers, but for the rest of the anchor that passes it.
BATCH = 1 << 20
#: Classes of one anchor that a suffix array takes; a segment has less than twice ``length`` bytes.
HOT = 1024
#: A block ends after an anchor whose hash has none of these bits.
BLOCK_BITS = 7
_INDEX = np.uint64((1 << 24) - 1)


def _hash(data: bytes | memoryview) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchor_runs(data: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(text number, anchor hash, first start, last start, anchor) of the runs of the texts data[begin:end], at least ``length`` long each."""
    gram = max(1, length // 4)
    prefix = prefix_hashes(data)
    at = np.arange(len(data) - gram + 1)
    hashes = mix(range_hashes(prefix, at, at + gram))
    least = _window_min((hashes & ~_INDEX) | at.astype(np.uint64), length - gram + 1)
    valid = np.zeros(len(least) + 1, np.int32)
    np.add.at(valid, begin, 1)
    np.add.at(valid, end - length + 1, -1)
    fine = np.cumsum(valid[:-1]) > 0
    anchor = (least & _INDEX).astype(np.int64)
    fresh = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    fresh[begin] = True
    first = np.flatnonzero(fine & fresh)
    stop = np.flatnonzero(fine & np.concatenate([(fresh | ~fine)[1:], [True]]))
    return np.searchsorted(begin, first, side="right") - 1, hashes[anchor[first]].view(np.int64), first, stop, anchor[first]


def _own(h: np.ndarray, seg: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(runs that go on, which of these come again, starts of the runs that are no first ones, joined) of one text."""
    order = np.lexsort((first, seg, h))
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = (h[order][1:] == h[order][:-1]) & (seg[order][1:] == seg[order][:-1])
    again, more = np.zeros(len(h), bool), np.zeros(len(h), bool)
    again[order], more[order] = same[:-1], same[1:]
    keep = np.flatnonzero(~again)
    a, b = first[again], last[again] + 1  # in text order already
    return keep, more[keep], [(x, y - 1) for x, y in _merged(list(zip(a.tolist(), b.tolist())))]


def _blocks(h: np.ndarray, seg: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(first run, digest of the segments' digests) of the blocks of the texts whose runs are offsets[i]:offsets[i + 1]."""
    cut = np.zeros(len(h) + 1, bool)
    cut[1:] = h & BLOCK_BITS == 0
    cut[offsets] = True
    cut[len(h)] = False
    starts = np.flatnonzero(cut)
    data = seg.tobytes()
    return starts, [_hash(data[8 * a : 8 * b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(h)])]


def _runs(length: int):
    def of(chunk: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(text number, offset in it, hashes, firsts, lasts) piece by piece."""
        long = [i for i, t in enumerate(chunk) if len(t) >= length]
        pieces = [(i, o, chunk[i][o : o + PIECE + length - 1]) for i in long for o in range(0, len(chunk[i]) - length + 1, PIECE)]
        group: list = []
        for piece in [*pieces, None]:
            if group and (piece is None or sum(len(x[2]) for x in group) + len(piece[2]) > PIECE):
                ends = np.cumsum([len(x[2]) for x in group])
                text = np.frombuffer(b"".join(x[2] for x in group), np.uint8)
                number, h, first, last, _ = anchor_runs(text, ends - [len(x[2]) for x in group], ends, length)
                cuts = np.searchsorted(number, np.arange(len(group) + 1))
                for k, (i, o, t) in enumerate(group):
                    lo, hi = cuts[k], cuts[k + 1]
                    base = ends[k] - len(t) - o
                    yield i, h[lo:hi], first[lo:hi] - base, last[lo:hi] - base
                group = []
            if piece is not None:
                group.append(piece)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = iter(batch.column("digest").to_pylist())
            for ids, chunk in rows_of([batch.select(["doc_id", "text"])]):
                found: list[list] = [[] for _ in chunk]
                with np.errstate(over="ignore"):
                    for i, *run_of in of(chunk):
                        found[i].append(run_of)
                hs, ss, es = ([np.concatenate([x[j] for x in f] or [np.zeros(0, np.int64)]) for f in found] for j in range(3))
                seg = [_hash(memoryview(t)[s : e + length]) for t, a, b in zip(chunk, ss, es) for s, e in zip(a.tolist(), b.tolist())]
                seg_of = np.split(np.array(seg, np.int64), np.cumsum([len(x) for x in hs])[:-1]) if hs else []
                told = [_own(*x) for x in zip(hs, seg_of, ss, es)]
                hs, seg_of, ss, es = ([x[keep] for x, (keep, _, _) in zip(y, told)] for y in (hs, seg_of, ss, es))
                offsets = np.cumsum([0, *map(len, hs)])
                h, seg, first, last = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (hs, seg_of, ss, es))
                twice = np.concatenate([x for _, x, _ in told]) if told else np.zeros(0, bool)
                starts, keys = _blocks(h, seg, offsets)
                runs = pa.StructArray.from_arrays([pa.array(h), pa.array(seg, pa.int64()), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)), pa.array(twice)], names=["h", "seg", "s", "e", "twice"])
                inner = pa.ListArray.from_arrays(pa.array(np.append(starts, len(h)), pa.int32()), runs)
                blocks = pa.StructArray.from_arrays([pa.array(keys, pa.int64()), inner], names=["b", "runs"])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array([next(digests) for _ in ids], pa.binary()),
                        pa.array([len(t) for t in chunk], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, offsets), pa.int32()), blocks),
                        pa.array([[{"s": a, "e": b} for a, b in own] for _, _, own in told], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
                    ],
                    names=["doc_id", "digest", "n_bytes", "blocks", "own"],
                )

    return run


def _segments(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, rid, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "rid", "text", "runs"))):
                rows += [(x["h"], doc_id, rid, x["s"], x["hot"], text[x["s"] : x["e"] + length]) for x in runs]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()))], names=["h", "doc_id", "rid", "s", "hot", "bytes"])

    return run


def _pieces(length: int):
    """Segments of hot anchors to pieces: the starts whose distances from the anchor share their quotient ``a``.

    ``core`` is what all strings of such distances share, ``seg`` the piece's bytes, ``ones`` each of its strings. Pieces that differ in ``core`` have
    no string in common.
    """
    step = isqrt(length - max(1, length // 4) + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                rows, texts_of = [], part.column("bytes").to_pylist()
                ends = np.cumsum([len(t) for t in texts_of])
                begin = ends - [len(t) for t in texts_of]
                with np.errstate(over="ignore"):
                    number, _, _, _, anchor = anchor_runs(np.frombuffer(b"".join(texts_of), np.uint8), begin, ends, length)
                anchors = (anchor - begin[number])[np.searchsorted(number, np.arange(len(part)))].tolist()
                for h, doc_id, rid, s, t, p in zip(*(part.column(c).to_pylist() for c in ("h", "doc_id", "rid", "s")), texts_of, anchors):
                    view, last = memoryview(t), len(t) - length
                    for a in range((p - last) // step, p // step + 1):
                        x, y = p - (a + 1) * step + 1, p - a * step  # of all strings of such distances the first and the last start
                        lo, hi = max(x, 0), min(y, last)
                        rows.append((h, doc_id, rid, s + lo, s + hi, a, _hash(view[y : x + length]), _hash(view[lo : hi + length]), [_hash(view[i : i + length]) for i in range(lo, hi + 1)]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["h", "doc_id", "rid", "s", "e", "a", "core", "seg", "ones"])

    return run


def _hot(segments: DataFrame, scratch: Scratch, length: int, keep_first: bool) -> DataFrame:
    """(rid, s, e) of the repeated starts of hot anchors; rows may repeat a place."""
    pieces = segments.select("h", "doc_id", "rid", "s", "bytes").mapInArrow(tidy(_pieces(length)), "h long, doc_id long, rid long, s int, e int, a int, core long, seg long, ones array<long>")
    pieces = scratch.save(pieces, "pieces")

    def equal(rows: DataFrame, classes: DataFrame, keys: list[str]) -> DataFrame:
        met = rows.join(classes.where("first <> last").select(*keys, F.col("first.rid").alias("rid1"), F.col("first.s").alias("s1")), keys)
        return (met.where("not (rid = rid1 and s = s1)") if keep_first else met).select("rid", "s", "e")

    place = F.struct("doc_id", "rid", "s", "e")
    ends = [F.min(place).alias("first"), F.max(place).alias("last")]
    classes = scratch.save(pieces.groupBy("h", "a", "core", "seg").agg(*ends), "piece-classes")
    several = classes.groupBy("h", "a", "core").agg(F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
    firsts = classes.join(several, ["h", "a", "core"]).select("first.rid", "first.s")
    ones = pieces.join(firsts, ["rid", "s"]).select("h", "doc_id", "rid", F.posexplode("ones").alias("i", "seg"), "s")
    ones = scratch.save(ones.select("h", "doc_id", "rid", "seg", (F.col("s") + F.col("i")).alias("s")).withColumn("e", F.col("s")), "ones")
    return equal(pieces, classes, ["h", "a", "core", "seg"]).union(equal(ones, ones.groupBy("h", "seg").agg(*ends), ["h", "seg"]))


def _nearest_smaller(p: np.ndarray) -> np.ndarray:
    """Where the nearest smaller value before each one stands, -1 if none does."""
    at = np.arange(-1, len(p) - 1)
    todo = np.arange(len(p))
    while True:
        todo = todo[at[todo] >= 0]
        todo = todo[p[at[todo]] > p[todo]]
        if not len(todo):
            return at
        at[todo] = at[at[todo]]  # what lies between a value and its candidate is larger than both


def _levels(data: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """(depth, rank of the substring of that depth at each place) for the powers of two up to ``length``; words of up to four bytes are their own ranks."""
    out, depth = [(1, data)], 1
    while 2 * depth <= length:
        rank = out[-1][1]
        both = (rank[:-depth].astype(np.uint64) << np.uint64(min(8 * depth, 32))) | rank[depth:]
        depth *= 2
        out.append((depth, (both if depth <= 4 else np.unique(both, return_inverse=True)[1]).astype(np.uint32)))
    return out


def _shared(levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Bytes that the suffixes at ``a`` and at ``b`` have in common, ``length`` at most; none where ``b`` is negative."""
    same = np.zeros(len(a), np.int64)
    for depth, rank in reversed(levels):
        same += np.where(rank[a + same] == rank[np.maximum(b, 0) + same], depth, 0)
    return np.where(b < 0, 0, np.minimum(same, length))


def previous_factors(segments: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment number, offset, longest previous factor, longest later factor) of all starts with ``length`` bytes in their segment.

    A factor is a string that starts at another such place, earlier or later in text order; its length counts to ``length``, and overlaps are allowed.
    Starts are sorted to that depth with ties in text order, so of all earlier starts the one that shares most with a start
    is the previous or the next smaller position in suffix order.
    """
    sizes = np.array([len(x) for x in segments])
    levels = _levels(np.frombuffer(b"".join(segments) + bytes(2 * length), np.uint8), length)
    ends = np.cumsum(sizes)
    count = np.maximum(sizes - length + 1, 0)
    number = np.repeat(np.arange(len(sizes)), count)
    offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start = (ends - sizes)[number] + offset
    depth, rank = levels[-1]
    order = np.lexsort((rank[start + length - depth], rank[start]))  # stable; the two halves overlap
    p = order.astype(np.int64)
    last = len(p) - 1
    found = []
    for q in (p, last - p):  # smaller positions, then larger ones
        before = _nearest_smaller(q)
        after = last - _nearest_smaller(q[::-1])[::-1]
        longest = np.zeros(len(p), np.int64)
        for at in (before, np.where(after > last, -1, after)):
            other = np.where(at < 0, -1, start[p[np.maximum(at, 0)]])
            longest = np.maximum(longest, _shared(levels, start[p], other, length))
        out = np.empty_like(longest)
        out[p] = longest
        found.append(out)
    return number, offset, *found


def _intervals(number, offset, hit) -> Iterator[tuple[int, int, int]]:
    """(segment, first, last) of the runs of starts that ``hit``."""
    if not len(hit):
        return
    same = np.concatenate([[False], (number[1:] == number[:-1]) & hit[:-1]])
    first = np.flatnonzero(hit & ~same)
    last = np.flatnonzero(hit & ~np.concatenate([same[1:] & hit[1:], [False]]))
    yield from zip(number[first].tolist(), offset[first].tolist(), offset[last].tolist())


def _matched(length: int, keep_first: bool):
    """Sorted segments, anchor by anchor, to the repeated starts."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        number, offset, earlier, later = previous_factors([r[5] for r in rows], length)
        hit = (earlier if keep_first else np.maximum(earlier, later)) >= length
        out = [(rows[i][2], rows[i][3] + a, rows[i][3] + b) for i, a, b in _intervals(number, offset, hit)]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.int32()))], names=["rid", "s", "e"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, key = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "doc_id", "rid", "s", "hot", "bytes"))):
                if row[:4] == key:
                    continue  # the same place of a text that stands in rows of the same id
                if rows and size > BATCH and row[0] != key[0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(row)
                size, key = size + len(row[5]), row[:4]
        if rows:
            yield solve(rows)

    return run


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _removed(text: bytes, starts: list | None, everything: bool, length: int, whole_characters: bool) -> tuple[list[tuple[int, int]], bytes]:
    """(spans, what stays); with ``whole_characters`` no UTF-8 character is split."""
    spans = [(0, len(text))] if everything else _merged([(x["s"], x["e"] + length) for x in starts or ()])
    if whole_characters:
        inside = lambda p: 0 < p < len(text) and text[p] & 0xC0 == 0x80
        fitted = []
        for a, b in spans:
            while inside(a):
                a += 1
            while inside(b):
                b -= 1
            if a < b:
                fitted.append((a, b))
        spans = fitted
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return spans, b"".join([*kept, text[at:]])


_SPANS = "array<struct<start: long, end: long>>"
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _cut(length: int, whole_characters: bool):
    """Texts with their spans removed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [_removed(*x, length, whole_characters) for x in zip(*(batch.column(c).to_pylist() for c in ("text", "starts", "everything")))]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for s, _ in done], _ARROW_SPANS)
            more = {"passages": batch.column("passages")} if "passages" in batch.schema.names else {}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "digest": batch.column("digest"), "spans": spans, "kept": pa.array([k for _, k in done], pa.binary()), **more})

    return run


def _digest(text) -> F.Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def repeated(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, Scratch]:
    """(digest of a text, first_id, everything, starts) of the texts with something to remove, and the tables behind it."""
    scratch = Scratch(docs.sparkSession)
    source = texts(docs, text, doc_id).withColumn("digest", _digest("text"))
    made = source.mapInArrow(tidy(_runs(length)), "doc_id long, digest binary, n_bytes long, blocks array<struct<b: long, runs: array<struct<h: long, seg: long, s: int, e: int, twice: boolean>>>>, own array<struct<s: int, e: int>>")
    made = scratch.save(made.withColumn("rid", F.monotonically_increasing_id()), "made")
    whole = made.where(F.col("n_bytes") >= length).groupBy("digest").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "rid")).alias("first"))
    whole = scratch.save(whole.select("digest", "copies", F.col("first.doc_id").alias("first_id"), F.col("first.rid").alias("rid")), "whole")
    own = made.where(F.size("own") > 0).join(whole.select("rid"), "rid", "left_semi").select("rid", F.explode("own").alias("x")).select("rid", "x.s", "x.e")
    blocks = made.join(whole.select("rid"), "rid", "left_semi").select("rid", "doc_id", F.posexplode("blocks").alias("i", "x")).select("rid", "doc_id", "i", "x.b", F.xxhash64("x.runs.h", "x.runs.seg").alias("b2"), "x.runs")
    # blocks are equal by 128 bits: their own digest, and one of their runs' digests
    kinds = blocks.groupBy("b", "b2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "rid", "i")).alias("first")).where("n > 1")
    known = blocks.join(kinds.select("b", "b2", F.col("first.rid").alias("rid1"), F.col("first.i").alias("i1")), ["b", "b2"], "left")
    copy = F.col("rid1").isNotNull() & ~((F.col("rid") == F.col("rid1")) & (F.col("i") == F.col("i1")))
    known = scratch.save(known.select("rid", "doc_id", "runs", copy.alias("copy"), F.col("rid1").isNotNull().alias("again")), "known")
    copied = known.where("copy" if keep_first else "again").select("rid", F.element_at("runs", 1)["s"].alias("s"), F.element_at("runs", -1)["e"].alias("e"))
    runs = known.where("not copy").select("rid", "doc_id", F.explode("runs").alias("x")).select("rid", "doc_id", "x.h", "x.seg", "x.s", "x.e", "x.twice")
    if not keep_first:
        own = own.union(runs.where("twice").select("rid", "s", "e"))
    runs = runs.drop("twice")
    often = runs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    dup = scratch.save(runs.join(often, "h"), "dup")
    classes = dup.groupBy("h", "seg").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "rid", "s", "e")).alias("first"))
    classes = scratch.save(classes, "classes")
    again = classes.where("n > 1").select("h", "seg", F.col("first.rid").alias("rid1"), F.col("first.s").alias("s1"))
    equal = dup.join(again, ["h", "seg"])
    if keep_first:
        equal = equal.where("not (rid = rid1 and s = s1)")
    several = classes.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h", (F.col("kinds") > HOT).alias("hot"))
    several = scratch.save(several, "several")  # read anew, so that the join below may split a hot anchor
    edges = classes.join(several, "h").select("h", "hot", "first.*")
    wanted = edges.groupBy("rid").agg(F.collect_list(F.struct("h", "s", "e", "hot")).alias("runs"))
    wanted = scratch.save(wanted.join(whole.select("rid", "digest", "first_id"), "rid"), "wanted")
    cut = source.join(wanted, "digest").where(F.col("doc_id").eqNullSafe(F.col("first_id"))).select("doc_id", "rid", "text", "runs")
    cut = cut.mapInArrow(tidy(_segments(length)), "h long, doc_id long, rid long, s int, hot boolean, bytes binary")
    cut = scratch.save(cut, "cut")
    order = cut.where("not hot").repartition("h").sortWithinPartitions("h", "doc_id", "rid", "s")
    matched = order.mapInArrow(tidy(_matched(length, keep_first)), "rid long, s int, e int")
    if not cut.where("hot").isEmpty():
        matched = matched.union(_hot(cut.where("hot"), scratch, length, keep_first))
    starts = equal.select("rid", "s", "e").union(copied).union(own).union(matched).groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("starts"))
    found = whole.join(starts, "rid", "left").where("copies > 1 or starts is not null")
    found = scratch.save(found.select("digest", "first_id", (F.col("copies") > 1).alias("everything"), "starts"), "found")
    scratch.drop("dup", "classes", "several", "wanted", "whole", "known", "cut", "pieces", "piece-classes", "ones")
    return found, scratch


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep_first: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, digest, spans (bytes removed, in order), kept (the bytes that stay).

    Removed are all bytes that a string of ``length`` bytes covers which also starts elsewhere in the input; with ``keep_first`` only if it
    starts earlier, by doc_id (null first), then position, and no character is split. Nulls are empty texts; shorter texts stay whole. Rows that repeat a
    text are copies of each other, but with ``keep_first`` rows that repeat both id and text are judged as one. Other columns are ignored.
    """
    found, _ = repeated(docs, length, keep_first, text, doc_id)
    return _without(docs, found, length, keep_first, text, doc_id)


def _without(docs: DataFrame, found: DataFrame, length: int, keep_first: bool, text: str, doc_id: str) -> DataFrame:
    """``docs`` without what was ``found`` by digest."""
    source = texts(docs, text, doc_id).withColumn("digest", _digest("text"))
    joined = source.join(found, "digest", "left")
    everything = F.coalesce("everything", F.lit(False))
    if keep_first:
        everything = everything & ~F.col("doc_id").eqNullSafe(F.col("first_id"))
    touched = joined.select("doc_id", "digest", "text", everything.alias("everything"), "starts", *(["passages"] if "passages" in found.columns else []))
    cut = touched.mapInArrow(tidy(_cut(length, keep_first)), f"doc_id long, digest binary, spans {_SPANS}, kept binary{f', passages {_SPANS}' if 'passages' in found.columns else ''}")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return cut.select("doc_id", (F.length("kept") + removed).alias("n_bytes"), *cut.columns[1:])


def _regions(length: int, shorter: int):
    """Texts to (digest, passages, regions): the spans that strings of ``shorter`` bytes cover, and those of them that hold ``length`` bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, text, starts, everything in zip(*(batch.column(c).to_pylist() for c in ("digest", "text", "starts", "everything"))):
                spans = [(0, len(text))] if everything else _merged([(x["s"], x["e"] + shorter) for x in starts or ()])
                regions = [{"offset": a, "bytes": text[a:b]} for a, b in spans if b - a >= length]
                rows.append((digest, [{"start": a, "end": b} for a, b in spans], regions))
            kinds = (pa.binary(), _ARROW_SPANS, pa.list_(pa.struct([("offset", pa.int32()), ("bytes", pa.binary())])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["digest", "passages", "regions"])

    return run


def passages_and_repeats(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``remove_repeats`` for ``length``, with ``passages``: the spans that strings of ``passage`` bytes cover which also start elsewhere.

    ``passage`` is at most ``length``. Nulls are empty texts; ids and rows may repeat; other columns are ignored; texts shorter than ``passage`` have none.
    """
    shorter, scratch = repeated(docs, passage, False, text, doc_id)
    source = texts(docs, text, doc_id).withColumn("digest", _digest("text"))
    met = source.join(shorter, "digest").where(F.col("doc_id").eqNullSafe(F.col("first_id"))).select("digest", "text", "starts", "everything")
    met = met.mapInArrow(tidy(_regions(length, passage)), f"digest binary, passages {_SPANS}, regions array<struct<offset: int, bytes: binary>>")
    met = scratch.save(met.withColumn("n", F.monotonically_increasing_id()), "regions")
    one = met.groupBy("digest").agg(F.min("n").alias("n"))  # rows of one id may repeat a text
    met = met.join(one.select("n"), "n", "left_semi")
    regions = scratch.save(met.select("digest", F.explode("regions").alias("x")).select("digest", "x.offset", F.col("x.bytes").alias("text"), F.monotonically_increasing_id().alias("doc_id")), "region-texts")
    longer, own = repeated(regions, length)
    places = regions.select("digest", "offset", F.length("text").alias("size"), _digest("text").alias("region"))
    hits = places.join(longer.select(F.col("digest").alias("region"), "everything", "starts"), "region")
    whole = F.array(F.struct(F.lit(0).alias("s"), (F.col("size") - length).alias("e")))
    hits = hits.select("digest", "offset", F.explode(F.when(F.col("everything"), whole).otherwise(F.col("starts"))).alias("x"))
    hits = hits.groupBy("digest").agg(F.collect_list(F.struct((F.col("x.s") + F.col("offset")).alias("s"), (F.col("x.e") + F.col("offset")).alias("e"))).alias("starts"))
    # a text that stands in several rows is repeated as a whole, if it is long enough
    found = met.select("digest", "passages").join(shorter.select("digest", "everything", "first_id"), "digest").join(hits, "digest", "left")
    copies = F.col("everything") & (F.try_element_at("passages", F.lit(-1))["end"] >= length)
    found = scratch.save(found.select("digest", "first_id", copies.alias("everything"), "starts", "passages"), "found-both")
    scratch.drop("regions", "region-texts", "found")
    own.drop()
    return _without(docs, found, length, False, text, doc_id)


def deduplicate(docs: DataFrame, length: int = LENGTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without what stands earlier in it: as ``remove_repeats`` with ``keep_first``, but with all columns; null texts stay null."""
    found, _ = repeated(docs, length, True, text, doc_id)
    names = docs.columns
    own = [f"c{i}" for i in range(len(names))]
    source = docs.toDF(*own).withColumn("digest", _digest(F.coalesce(F.col(own[names.index(text)]).cast("binary"), F.lit(b""))))
    joined = source.join(found, "digest", "left")
    earlier = ~F.col(own[names.index(doc_id)]).cast("long").eqNullSafe(F.col("first_id"))
    touched = joined.select(*own, (F.coalesce("everything", F.lit(False)) & earlier).alias("everything"), "starts")
    at = names.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in (own[at], "starts", "everything")))
            new = [t if t is None or not (e or s) else _removed(t.encode(), s, e, length, True)[1].decode() for t, s, e in rows]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else batch.column(i) for i in range(len(own))], names=own)

    return touched.mapInArrow(tidy(run), docs.toDF(*own).schema).toDF(*names)
