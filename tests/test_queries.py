"""Every signal query against its SQL on the small tables, and its schema."""

import math
import os

import duckdb
import pytest

from wavemill.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
TYPES = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("events", "embeddings", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, db, name):
    df = QUERIES[name](spark, DATA)
    result = db.execute(ORACLE_SQL[name])
    columns = {c[0]: TYPES[str(c[1])] for c in result.description}
    assert dict(df.dtypes) == columns
    want = sorted(map(str, result.fetchall()))
    assert want and sorted(str(tuple(r)) for r in df.select(*columns).collect()) == want


def test_entry_imports_without_corpus_operators(spark):
    import __spark_entry__

    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["user_id", "epoch_index", "kind", "class", "confidence_permille"]


def log2_q16(v):
    msb = v.bit_length() - 1
    m, out = (v << (32 - msb) if msb <= 32 else v >> (msb - 32)), msb << 16
    for bit in range(15, -1, -1):
        m = (m * m) >> 32
        if m >= 1 << 33:
            m, out = m >> 1, out + (1 << bit)
    return out


def test_isqrt_log2_of_every_lineitem(spark, db):
    want = {int(v) for (v,) in db.execute("SELECT CAST(floor(l_extendedprice * 100) AS HUGEINT) * (1 + l_orderkey) * (1 + l_partkey) FROM lineitem").fetchall()}
    got = QUERIES["isqrt_log2"](spark, DATA).collect()
    assert len(got) == len(want)
    assert {(int(r.v), r.root, r.log2_q16) for r in got} == {(v, math.isqrt(v), log2_q16(v)) for v in want}


def test_isqrt_log2_of_products_beyond_64_bits(spark, tmp_path):
    rows = [(1e8, 3_000_000_000, 200_000_000), (90000.0, 2_000_000, 600_000), (0.01, 0, 0)]
    spark.createDataFrame(rows, "l_extendedprice double, l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(int(r.v), r.root, r.log2_q16) for r in QUERIES["isqrt_log2"](spark, str(tmp_path)).collect()}
    want = {min(round(p * 100) * (1 + o) * (1 + k), 2**63 - 1) for p, o, k in rows}
    assert got == {(v, math.isqrt(v), log2_q16(v)) for v in want}


def test_calibration_of_all_channels(spark, db):
    tdiv = lambda a, b: a // b if a >= 0 else -(-a // b)  # as // in the SQL
    covs, by_label = {}, {}
    for vec_id, label, e in db.execute("SELECT vec_id, label, embedding FROM embeddings ORDER BY vec_id").fetchall():
        s = [math.floor(float(v) * 1000000) for v in e]
        d = [[v - tdiv(sum(s[c::8]), 8) for v in s[c::8]] for c in range(8)]
        covs[vec_id] = [tdiv(sum(a * b for a, b in zip(d[i], d[j])), 8) for i in range(8) for j in range(8)]
        by_label.setdefault(label, []).append(covs[vec_id])
    numbers = lambda t: [int(v) for v in t.split(",")]
    assert {r.vec_id: numbers(r.cov) for r in QUERIES["covariance"](spark, DATA).collect()} == covs
    assert {r.label: (numbers(r["mean"]), r.n) for r in QUERIES["session_mean"](spark, DATA).collect()} == {k: ([tdiv(sum(x), len(v)) for x in zip(*v)], len(v)) for k, v in by_label.items()}
    want = {}
    for k, v in by_label.items():
        want[k] = v[0]
        for c in v[1:]:
            want[k] = [a + ((3277 * (b - a)) >> 15) for a, b in zip(want[k], c)]
    assert {r.label: numbers(r.reference) for r in QUERIES["drift_update"](spark, DATA).collect()} == want
    whiteners = QUERIES["online_aligner_whiteners"](spark, DATA).collect()
    assert whiteners and all(len(numbers(r.whitener)) == 64 for r in whiteners)
