"""Planted rows of rules and of the registry against what their SQL twins state, and what odd rows give."""

from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from veilspark.functions import identifiers
from veilspark.operators import names, records

from .planted import cases, rules  # noqa: F401

NAMES = sorted(cases.QUERIES)


@pytest.fixture(scope="module")
def results(spark):
    """All planted queries; several at a time, as each is a small job."""
    with ThreadPoolExecutor(6) as pool:
        return dict(zip(NAMES, pool.map(lambda n: (lambda df: (df.columns, df.collect()))(cases.QUERIES[n](spark, "")), NAMES)))


@pytest.mark.parametrize("name", NAMES)
def test_planted_rows(results, name):
    columns, rows = results[name]
    want = duckdb.sql(cases.ORACLE_SQL[name])
    assert columns == want.columns
    as_text = lambda rows: sorted(repr(tuple(None if x is None else str(x) for x in r)) for r in rows)
    assert as_text(rows) == as_text(want.fetchall())


def test_kinds_have_names_of_their_own():
    kinds = [k.kind for k in identifiers.REGISTRY]
    assert len(kinds) == len(set(kinds))


def test_odd_rows(spark):
    odd = spark.createDataFrame([("s", 1, None), ("s", 2, ""), (None, 3, "x" * 100_000)], "scope string, leaf_id int, text string")
    assert [len(r.ids or []) for r in records.record_ids(odd).orderBy("leaf_id").collect()] == [0, 0, 0]
    assert [len(r.names or []) for r in names.capitals(odd).orderBy("leaf_id").collect()] == [0, 0, 0]
    nobody = spark.createDataFrame([], "scope string, entity string, value string")
    assert records.spelled_ids(odd, nobody).count() == 0
    assert names.given_alone(spark.createDataFrame([("s", None, None)], "scope string, name string, evidence boolean")).first().verdict == "doubt"
