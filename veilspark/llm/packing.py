"""Packing documents of like length: bucket boundaries that minimise padding, and token-budget batches inside each bucket.

1. Lengths in tokens (words) are counted once: the histogram holds every length that occurs, exactly. Distinct lengths are few beside the
   documents: ``n`` of them need texts of ``n * n / 2`` words in all, at least.
2. Dynamic programming over that histogram places the boundaries: a document in a bucket is padded to the longest length in it, so a bucket costs its
   documents times that length. The best last boundary never moves back as lengths grow, so each layer is filled by divide and
   conquer, in memory of a few numbers for each length.
3. A batch of a bucket with boundary L holds ``budget // L`` documents (one at least). Batches are filled in order of (length, id) from ranks that are summed
   from partition counts, so no bucket has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch

BUCKETS, BUDGET = 16, 16384


def n_tokens(text: F.Column) -> F.Column:
    """White-space words of a text; none for null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Ascending bucket boundaries with the least padded total, the last one the longest length; at most ``buckets`` of them.

    ``lengths`` ascend. The cost of lengths i to j in a bucket is the number of their documents times lengths[j].
    """
    n = len(lengths)
    if not n:
        return []
    lengths = np.asarray(lengths, np.float64)
    total = np.concatenate([[0.0], np.cumsum(counts, dtype=np.float64)])
    cost = np.concatenate([[0.0], total[1:] * lengths])  # of the first j lengths in one bucket
    back = [np.zeros(n + 1, np.int32)]
    for _ in range(1, min(buckets, n)):
        now, before = cost.copy(), np.zeros(n + 1, np.int32)
        work = [(1, n, 0, n - 1)]
        while work:  # ends lo to hi, whose best bucket starts after one of the first a to b lengths
            lo, hi, a, b = work.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            starts = slice(a, min(b, j - 1) + 1)
            tried = cost[starts] + (total[j] - total[starts]) * lengths[j - 1]
            i = a + int(tried.argmin())
            if tried[i - a] <= now[j]:
                now[j], before[j] = tried[i - a], i
            work += [(lo, j - 1, a, i), (j + 1, hi, i, b)]
        back.append(before)
        cost = now
    out, j, k = [], n, len(back) - 1
    while j > 0:
        out.append(int(lengths[j - 1]))
        j, k = int(back[k][j]), k - 1
    return out[::-1]


def bucket_batches(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, bucket (from 0), bucket_tokens (its boundary), batch (from 0 in its bucket), slot, padding.

    Null and blank texts have no tokens; where the longest text of a bucket has none, any number fits. Texts longer than the budget are batches of
    their own. Batches fill in order of (n_tokens, doc_id, text); rows that repeat all of these are alike. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), n_tokens(F.col(text)).alias("n_tokens"), F.xxhash64(F.col(text)).alias("tie"))
    sized = scratch.save(sized, "sized")
    # a row for each length that occurs; two arrays of numbers on the driver
    counted = sized.groupBy("n_tokens").count().orderBy("n_tokens").toArrow()
    edges = boundaries(counted.column("n_tokens").to_numpy(), counted.column("count").to_numpy(), buckets)
    at = F.lit(0)
    for edge in edges[:-1]:
        at = at + (F.col("n_tokens") > edge).cast("int")
    sized = sized.withColumn("bucket", at.cast("int"))
    limits = F.array(*(F.lit(e).cast("long") for e in edges or [0]))

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    ordered = sized.repartitionByRange(parts, "bucket", "n_tokens", "doc_id", "tie").sortWithinPartitions("bucket", "n_tokens", "doc_id", "tie")
    ordered = scratch.save(ordered.mapInArrow(_numbered, "doc_id long, n_tokens long, bucket int, part int, local long"), "ordered")
    totals = ordered.groupBy("part", "bucket").agg(F.count("*").alias("n"))
    # rows: partitions that hold a bucket, at most partitions plus buckets
    known = sorted((r.part, r.bucket, r.n) for r in totals.collect())
    offsets, seen = [], {}
    for part, bucket, n in known:
        offsets.append((part, bucket, seen.get(bucket, 0)))
        seen[bucket] = seen.get(bucket, 0) + n
    offsets = spark.createDataFrame(offsets, "part int, bucket int, before long")
    ranked = ordered.join(F.broadcast(offsets), ["part", "bucket"]).withColumn("rank", F.col("before") + F.col("local")).withColumn("bucket_tokens", F.element_at(limits, F.col("bucket") + 1))
    fits = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(F.col("bucket_tokens"), F.lit(1))))
    return ranked.select(
        "doc_id", "n_tokens", "bucket", "bucket_tokens", F.floor(F.col("rank") / fits).alias("batch"), F.pmod(F.col("rank"), fits).alias("slot"), (F.col("bucket_tokens") - F.col("n_tokens")).alias("padding")
    )


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's place among those of its bucket in this partition."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    last, seen = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        bucket = batch.column("bucket").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        local = np.arange(len(bucket)) - np.repeat(first, np.diff(np.append(first, len(bucket))))
        if bucket[0] == last:
            local[bucket == last] += seen
        seen = int(local[-1]) + 1
        last = bucket[-1]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_tokens"), batch.column("bucket"), pa.array(np.full(len(bucket), part), pa.int32()), pa.array(local)], names=["doc_id", "n_tokens", "bucket", "part", "local"]
        )
