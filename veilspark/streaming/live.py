"""The engine over streams: the same detectors and draws on micro-batches.

Stand-ins are keyed hashes, so a value takes the same stand-in in every batch without state. Only counts over time need state, which a watermark bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import detect, pseudonymise


def detected(stream: DataFrame, text: str = "text", bank: Sequence[detect.Pattern] = detect.BANK) -> DataFrame:
    """A stream with its ``spans``; stateless."""
    return detect.detect(stream, bank, text=text)


def windowed(stream: DataFrame, time: str, late: str = "10 minutes", width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Spans of each entity for each window of event time, of a stream that has ``spans``; rows later than ``late`` are left out."""
    each = stream.withWatermark(time, late).select(F.col(time).alias("at"), F.explode("spans").alias("s"))
    return each.groupBy(F.window("at", width, slide or width), F.col("s.entity").alias("entity")).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key: rows at most ``gap`` apart."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), F.col(key)).agg(F.count("*").alias("n"))


def pseudonymised(stream: DataFrame, path: str, seed: str, checkpoint: str, text: str = "text", key: str = "doc_id") -> DataStreamWriter:
    """A writer that pseudonymises each micro-batch into a folder of its own; a batch that is run again overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        pseudonymise.pseudonymise(batch, seed, text, key, apart=False).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
