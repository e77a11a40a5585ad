"""Queries over the tables hold the forms that their operators are for."""

import duckdb
import pytest

from veilspark.plans import applied

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "name, table, forms",
    [
        ("keys_words", "part", ["[a-z][A-Z]", "^XMLHttp", "^straße-.*[.]nr[.]2$", "^$"]),
        ("reader_dates", "orders", [r"^[0-9]+[.] ", "^le ", " de ", "^31 February"]),
    ],
)
def test_forms_of_whole_tables(spark, name, table, forms):
    df = applied.QUERIES[name](spark, SF)
    for form in forms:
        assert df.where(df.v.rlike(form)).count() > 0, form
    duckdb.sql(f"create or replace view {table} as select * from '{SF}/{table}.parquet'")
    want = duckdb.sql(applied.ORACLE_SQL[name])
    assert df.columns == want.columns
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want.fetchall()))
