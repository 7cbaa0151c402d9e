"""Each query of the corpus operators that has SQL, against DuckDB."""

import duckdb
import pytest

from quarry.llm import queries

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = queries.queries()[name](spark, sf)
    rel = con.sql(queries.oracle_sql()[name])
    assert {k: TYPES[v] for k, v in df.dtypes} == {k: str(v) for k, v in zip(rel.columns, rel.types, strict=True)}
    got = sorted(str(sorted(r.asDict().items())) for r in df.collect())
    assert got == sorted(str(sorted(zip(rel.columns, r, strict=True))) for r in rel.fetchall())


def test_held_out_is_never_null(spark):
    rows = spark.createDataFrame([(None,), (1,), (7,)], "doc_id long").select(queries.held_out(5, 0), queries.held_out(4, 2).alias("b")).collect()
    assert not any(x is None for r in rows for x in r) and not any(rows[0])
