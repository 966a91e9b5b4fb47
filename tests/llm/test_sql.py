"""The corpus queries that have SQL, against it."""

import duckdb
import pytest

from wavemill.llm.queries import ORACLE_SQL, QUERIES

TYPES = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    result = con.execute(ORACLE_SQL[name])
    columns = {c[0]: TYPES[str(c[1])] for c in result.description}
    want = sorted(map(str, result.fetchall()))
    df = QUERIES[name](spark, data)
    assert dict(df.dtypes) == columns
    assert want and sorted(str(tuple(r)) for r in df.select(*columns).collect()) == want
