"""All queries of the engine over the driver's tables, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import pseudonymise
from . import applied, detection, formats, masking, portable, reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = detection.QUERIES | masking.QUERIES | formats.QUERIES | reports.QUERIES | applied.QUERIES
ORACLE_SQL: dict[str, str] = detection.ORACLE_SQL | masking.ORACLE_SQL | formats.ORACLE_SQL | reports.ORACLE_SQL | applied.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents pseudonymised: doc_id, output, marks, counts, n_spans."""
    return pseudonymise.pseudonymise(portable.table(spark, sf_dir, "documents"), portable.SEED)
