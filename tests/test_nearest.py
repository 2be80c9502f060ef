import math
from decimal import ROUND_HALF_UP, Decimal

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from pantry.operators import nearest as N
from pantry.operators import retrieval as R


def test_rounded_as_decimals():
    values = [0.0000005, -0.0000005, 1.0000005, 0.1234565, 0.12345649999999, -4e-17, 0.0, 2.5, 123456.7890125, 1e-9, 987654321.1234565]
    want = [float(Decimal(repr(v)).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for v in values]
    assert R.rounded(np.array(values), 6).tolist() == want
    assert np.isnan(R.rounded(np.array([math.nan]), 6)).all()


def test_cosine_has_no_join_and_equals_sql(spark, tmp_path):
    r = np.random.default_rng(5)
    vectors = r.normal(size=(2500, 8)).astype(np.float32)
    vectors[100:400] = vectors[100]  # ties that only ids settle
    vectors[700] = vectors[900] = 0
    rows = [v.tolist() for v in vectors]
    rows[1300] = rows[1301] = None
    ids = [*range(2498), None, 200]  # a repeated id and none
    pq.write_table(pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    found = entry.queries()["q_cosine"](spark, str(tmp_path))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    key = lambda row: tuple(repr(x + 0.0 if isinstance(x, float) else x) for x in row)
    assert sorted(key(x) for x in found.collect()) == sorted(key(x) for x in con.sql(entry.oracle_sql()["q_cosine"]).fetchall())


def test_cells_of_any_size_agree(spark, monkeypatch):
    r = np.random.default_rng(6)
    data = [(i, [float(x) for x in r.integers(-2, 3, 4)]) for i in range(300)]
    data += [(400, [1.0]), (401, [1.0, None]), (402, [])]
    v = spark.createDataFrame(data, "doc long, v array<float>")
    q = v.where("doc % 20 = 0").withColumnRenamed("doc", "query")
    answers = []
    for size in (1 << 22, 64):
        monkeypatch.setattr(N, "CELL", size)
        monkeypatch.setattr(N, "HELD", size)
        answers.append(sorted(tuple(map(str, x)) for x in R.ranked(N.nearest(q, v, 7), 7, ascending=True).collect()))
    assert answers[0] == answers[1] and len(answers[0]) == 16 * 7
