"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors have a cosine of at least t just where their squared distance is at most 2 - 2 t. A fixed rotation spreads the energy; the rotated vectors are
split into ``blocks`` subspaces, and each gets the share of the squared distance that its dimensions are of all. A linked pair
keeps within the share in one block at least, so a range join of every block finds all of them.

The range join of a block deals the vectors to the cells of pivots. A vector within the radius of a cell's boundary with its own cell visits
that cell (in one direction, as pairs have no order), so partners within the radius always meet. Cells that many vectors
are in are cut into chunks that all meet. A pair counts in the first block that it keeps within the share of, and there
its cosine is checked in double precision. Tasks return counts and the smallest id reached, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, components

#: Dimensions of a block, about.
WIDTH = 16
#: Vectors on which pivots are placed; any pivots give right results.
SAMPLE = 2048
#: Vectors that a cell should have, and pivots at most.
CELL, PIVOTS = 8192, 256
#: Vectors of a cell that one task compares with others, and others at most.
CHUNK, OTHERS = 4096, 16384
TILE = 1024
_SLACK = 1e-6


def cuts(dim: int) -> list[tuple[int, int]]:
    """The blocks' ranges of dimensions."""
    m = max(1, dim // WIDTH)
    edges = [dim * i // m for i in range(m + 1)]
    return list(zip(edges, edges[1:]))


def rotation(dim: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, _ = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q


def pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` centres of the sample's clusters, a few rounds of Lloyd's algorithm from evenly taken rows."""
    made = sample[np.linspace(0, len(sample) - 1, count).astype(int)].copy()
    for _ in range(4):
        own = ((sample[:, None] - made[None]) ** 2).sum(axis=2).argmin(axis=1)
        for k in range(count):
            if (own == k).any():
                made[k] = sample[own == k].mean(axis=0)
    return made


def _matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells(x: np.ndarray, places: np.ndarray, radius: float) -> Iterator[tuple[int, int, bool]]:
    """(row, cell, is its own) for each row's own cell and the later ones that it visits."""
    d = ((x * x).sum(axis=1)[:, None] - 2 * x @ places.T) + (places * places).sum(axis=1)[None]
    own = d.argmin(axis=1)
    for i, c in enumerate(own.tolist()):
        yield i, c, True
    if len(places) == 1:
        return
    apart = np.sqrt(((places[own][:, None] - places[None]) ** 2).sum(axis=2))
    beyond = (d - d[np.arange(len(x)), own][:, None]) <= 2 * apart * (radius + _SLACK) + _SLACK
    beyond &= np.arange(len(places))[None] > own[:, None]
    for i, c in zip(*(a.tolist() for a in np.nonzero(beyond))):
        yield i, c, False


def _deal(dim: int, placed: list[np.ndarray], radii: list[float], with_vector: bool):
    names = ["block", "cell", "member", "rid", "vec_id", "v"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim)
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                y = _unit(_matrix(batch.column("v"))) @ turn
                for b, (a, z) in enumerate(cuts(dim)):
                    found = list(cells(y[:, a:z], placed[b], radii[b]))
                    row = pa.array([f[0] for f in found], pa.int32())
                    out = [pa.array([b] * len(found), pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.bool_())]
                    if with_vector:
                        out += [batch.column(c).take(row) for c in names[3:]]
                    yield pa.RecordBatch.from_arrays(out, names=names[: len(out)])

    return run


def _join(dim: int, shares: list[float], threshold: float):
    def run(table: pa.Table) -> pa.Table:
        turn, ranges = rotation(dim), cuts(dim)
        rid, vec_id = table.column("rid").to_numpy(), table.column("vec_id").to_numpy()
        block = int(table.column("block")[0].as_py())
        unit = _unit(_matrix(table.column("v")))
        parts = [unit @ turn[:, a:z] for a, z in ranges[: block + 1]]
        norms = [(p * p).sum(axis=1) for p in parts]
        asks = np.flatnonzero(table.column("asks").to_numpy(zero_copy_only=False))
        told = np.flatnonzero(table.column("told").to_numpy(zero_copy_only=False))
        member = table.column("member").to_numpy(zero_copy_only=False)
        count, label = np.zeros(len(rid), np.int64), vec_id.copy()
        links = []

        def near(b: int, q: np.ndarray, t: np.ndarray) -> np.ndarray:
            return norms[b][q][:, None] + norms[b][t][None] - 2 * parts[b][q] @ parts[b][t].T <= shares[b]

        for lo in range(0, len(asks), TILE):
            for at in range(0, len(told), TILE):
                q, t = asks[lo : lo + TILE], told[at : at + TILE]
                ok = near(block, q, t)
                rows, columns = np.flatnonzero(ok.any(axis=1)), np.flatnonzero(ok.any(axis=0))
                if not len(rows):
                    continue
                q, t, ok = q[rows], t[columns], ok[np.ix_(rows, columns)]
                ok &= (unit[q] @ unit[t].T >= threshold) & (rid[q][:, None] != rid[t][None])
                for b in range(block):
                    if ok.any():
                        ok &= ~near(b, q, t)
                if not ok.any():
                    continue
                count[q] += ok.sum(axis=1)
                visits = ~member[q]
                count[t] += ok[visits].sum(axis=0)
                links.append(_tied(*np.nonzero(ok), q, t))
        if links:
            a, b = np.concatenate([x[0] for x in links]), np.concatenate([x[1] for x in links])
            while True:
                before = label.copy()
                least = np.minimum(label[a], label[b])
                np.minimum.at(label, a, least)
                np.minimum.at(label, b, least)
                if (before == label).all():
                    break
        some = (count > 0) | (label != vec_id)
        return pa.table({"rid": rid[some], "vec_id": vec_id[some], "n": count[some], "low": label[some]})

    return run


def _tied(i: np.ndarray, j: np.ndarray, q: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ties of each vector of a tile to the first one that its links (i, j) reach."""
    size = len(q)
    label = np.arange(size + len(t))
    while True:
        before = label.copy()
        least = np.minimum(label[i], label[j + size])
        np.minimum.at(label, i, least)
        np.minimum.at(label, j + size, least)
        if (before == label).all():
            break
    nodes = np.unique(np.concatenate([i, j + size]))
    where = lambda x: np.where(x < size, q[np.minimum(x, size - 1)], t[np.maximum(x - size, 0)])
    keep = nodes[label[nodes] != nodes]
    return where(keep), where(label[keep])


def near_vectors(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Links join rows whose vectors have a cosine of ``threshold`` or more, in double precision. Vectors that are null, empty, zero or hold null
    or non-finite components link with nothing, nor do vectors of different lengths, nor rows whose id is null (their component is null and they
    are kept). Rows that repeat an id are vectors of one node. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    made = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).withColumn("rid", F.monotonically_increasing_id())
    made = scratch.save(made.select("rid", "vec_id", "v", F.coalesce(fine & F.col("vec_id").isNotNull(), F.lit(False)).alias("fine")), "made")
    able = made.where("fine")
    tied = []
    for dim, rows in sorted((r[0], r[1]) for r in able.groupBy(F.size("v")).count().collect()):
        own = able.where(F.size("v") == dim).select("rid", "vec_id", "v")
        sample = own.orderBy(F.xxhash64("rid")).select("v").limit(SAMPLE).toArrow().column("v")
        turned = _unit(_matrix(sample)) @ rotation(dim)
        count = min(PIVOTS, max(1, rows // CELL), len(turned))
        shares = [(2 - 2 * threshold) * (z - a) / dim + 1e-12 for a, z in cuts(dim)]
        placed, radii = [pivots(turned[:, a:z], count) for a, z in cuts(dim)], [float(np.sqrt(s)) for s in shares]
        sizes = own.mapInArrow(_deal(dim, placed, radii, False), "block int, cell int, member boolean").groupBy("block", "cell")
        sizes = sizes.agg(F.ceil(F.sum(F.col("member").cast("long")) / CHUNK).cast("int").alias("nt"), F.ceil(F.count("*") / OTHERS).cast("int").alias("nq")).where("nt > 0")
        dealt = own.mapInArrow(_deal(dim, placed, radii, True), f"block int, cell int, member boolean, rid long, vec_id long, v {vectors.schema[vector].dataType.simpleString()}")
        # at most as many rows as blocks times pivots
        at = dealt.join(F.broadcast(sizes), ["block", "cell"])
        at = at.withColumn("i", F.pmod(F.xxhash64("rid"), F.col("nt")).cast("int")).withColumn("j", F.pmod(F.xxhash64("rid", F.lit(1)), F.col("nq")).cast("int"))
        asked = F.transform(F.sequence(F.lit(0), F.col("nt") - 1), lambda i: F.struct(i.alias("i"), F.col("j").alias("j")))
        told = F.transform(F.sequence(F.lit(0), F.col("nq") - 1), lambda j: F.struct(F.col("i").alias("i"), j.alias("j")))
        at = at.withColumn("meet", F.explode(F.array_distinct(F.concat(asked, F.when(F.col("member"), told).otherwise(F.array())))))
        at = at.select("block", "cell", F.col("meet.i").alias("ti"), F.col("meet.j").alias("qj"), "member", (F.col("meet.j") == F.col("j")).alias("asks"), (F.col("member") & (F.col("meet.i") == F.col("i"))).alias("told"), "rid", "vec_id", "v")
        joined = at.groupBy("block", "cell", "ti", "qj").applyInArrow(_join(dim, shares, threshold), "rid long, vec_id long, n long, low long")
        tied.append(scratch.save(joined, f"tied-{dim}"))
    if not tied:
        return made.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = tied[0]
    for more in tied[1:]:
        found = found.union(more)
    counts = found.groupBy("rid").agg(F.sum("n").alias("n_links"))
    labels = components(found.select(F.col("vec_id").alias("a"), F.col("low").alias("b")), scratch, "cc").select(F.col("id").alias("vec_id"), "component")
    out = made.select("rid", "vec_id").join(counts, "rid", "left").join(labels, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
