"""Shared plumbing of the training-data operators: scratch tables, Arrow helpers, text hashing, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step of an operator works on; a longer single text is one step.
CHUNK_BYTES = 1 << 20


class Scratch:
    """Tables in the folder that all executors share (``spark.checkpoint.dir``); they cut the lineage.

    Where that setting is absent on a local master (tests) the folder is a temporary one; on a cluster that is an error, as executors would
    write to disks that others do not see.
    """

    def __init__(self, spark: SparkSession) -> None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = root or "file://" + tempfile.mkdtemp(prefix="scratch-")
        self.spark, self.root = spark, f"{root.rstrip('/')}/scratch-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)  # what results may still read goes with the session

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns the written table."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Removes tables that nothing reads any more."""
        for name in names or ("",):
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, text as UTF-8 bytes; a null text is empty), whatever other columns there are."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))


def give_back() -> None:
    """Returns freed memory of this Python worker to the system: idle workers stay beside an executor's other tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over a partition's batches, with memory given back at its end."""

    def tidied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def rows_of(batches: Iterable[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Chunks of (ids, texts) with about ``limit`` bytes of text each; texts stay whole."""
    for batch in batches:
        ids, column = batch.column(0).to_pylist(), batch.column(1)
        lo, size = 0, 0
        lengths = pc.binary_length(column).to_pylist()
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield ids[lo:i], column.slice(lo, i - lo).to_pylist()
                lo, size = i, 0
            size += n
        if lo < len(ids):
            yield ids[lo:], column.slice(lo).to_pylist()


def lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    """An Arrow list column from its offsets and values."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
BASE = 0x5851F42D4C957F2D
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = x + _STEP
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


BYTE_CODES = mix(np.arange(256, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, at least."""
    if not len(_powers) or len(_powers["up"]) < n:
        n = max(n, CHUNK_BYTES + CHUNK_BYTES // 4)
        with np.errstate(over="ignore"):
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes of ``data``, length + 1 of them."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * up[: len(data)], out=out[1:])
    return out


def range_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] that do not depend on where the range lies."""
    _, down = powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) of every node of ``edges`` (a, b): the component is its smallest node.

    Each round hooks every node to its smallest neighbour, follows those pointers to their roots by doubling, and
    contracts the graph to the roots. Only nodes smaller than all their neighbours stay, so at least half of
    the nodes go each round. All state is in tables; nothing is gathered on the driver but counts.
    """
    edges = scratch.save(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges-0")
    labels: DataFrame | None = None
    left, k, old = edges.count(), 0, [f"{name}-edges-0"]
    while left:
        k += 1
        both = edges.union(edges.select("b", "a"))
        parents = scratch.save(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("parent")), f"{name}-parents-{k}-0")
        old.append(f"{name}-parents-{k}-0")
        for j in range(1, 64):
            up = parents.select(F.col("id").alias("parent"), F.col("parent").alias("grand"))
            jumped = scratch.save(parents.join(up, "parent").select("id", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")), f"{name}-parents-{k}-{j}")
            old.append(f"{name}-parents-{k}-{j}")
            parents = jumped.select("id", "parent")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = parents.select("id", F.col("parent").alias("component"))
        else:
            step = parents.select(F.col("id").alias("component"), "parent")
            labels = labels.join(step, "component", "left").select("id", F.coalesce("parent", "component").alias("component"))
        labels = scratch.save(labels, f"{name}-labels-{k}")
        ends = [parents.select(F.col("id").alias(x), F.col("parent").alias(f"root_{x}")) for x in "ab"]
        edges = scratch.save(edges.join(ends[0], "a").join(ends[1], "b").where("root_a <> root_b").select(F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")).distinct(), f"{name}-edges-{k}")
        left = edges.count()
        scratch.drop(*old, *([f"{name}-labels-{k - 1}"] if k > 1 else []))
        old = [f"{name}-edges-{k}"]
    scratch.drop(*old)
    return scratch.spark.createDataFrame([], "id long, component long") if labels is None else labels


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once for each row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Rows that a range of ``ranked`` holds, about.
RANGE_ROWS = 1_000_000


def ranked(rows: DataFrame, groups: list[str], order: list[str], scratch: Scratch, name: str, about: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``rank`` (from 0 inside their group, by ``order``) and ``of`` (rows of the group), and the columns of ``about`` (one row for each group).

    No group has to fit in one task: rows are sorted by ranges of (groups, order), and a row's rank is its place in its range and the number of its
    group's rows in the ranges before. What is gathered for each group is one row for each range that holds some of it. Rows that are equal in
    all of these are told apart by a number, so that a repeated row does not fill a range. The groups are compared null-safely; nulls come first.
    """
    rows = scratch.save(rows.withColumn("salt", F.monotonically_increasing_id()), name)
    parts = max(int(scratch.spark.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows.count() // RANGE_ROWS))
    keys = [*groups, *order, "salt"]
    placed = scratch.save(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), f"{name}-placed")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy("part", *groups).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    whole = Window.partitionBy(*(groups or [F.lit(0)]))
    before = F.coalesce(F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select(F.col("part").alias("run_part"), *(F.col(g).alias(f"run_{g}") for g in groups), (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("of"))
    more = []
    if about is not None:
        more = [c for c in about.columns if c not in groups]
        about = about.select(*(F.col(g).alias(f"about_{g}") for g in groups), *more)
        runs = runs.join(about, [F.col(f"run_{g}").eqNullSafe(F.col(f"about_{g}")) for g in groups])
    met = placed.join(runs, [F.col("part") == F.col("run_part"), *(F.col(g).eqNullSafe(F.col(f"run_{g}")) for g in groups)])
    return met.select(*(c for c in rows.columns if c != "salt"), (F.col("at") + F.col("shift")).alias("rank"), "of", *more)
