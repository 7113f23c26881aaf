import numpy as np
import pytest
from pyspark.sql import functions as F

from capturemill.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int"


def brute(rows, k):
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, vector in good:
        if q % 20 == 0:
            near = sorted((-float((vector * v).sum()), i) for i, v in good if i != q and len(v) == len(vector))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [1024, 7])
def test_equals_brute_force(spark, block_rows):
    draw = np.random.default_rng(4)
    rows = [(i, draw.normal(size=16).astype(np.float32).tolist()) for i in range(300)]
    rows += [(i, rows[i % 7][1]) for i in range(300, 360)]  # ties
    rows += [(400, None), (420, []), (440, [0.0] * 16), (460, [1.0] * 15 + [None]), (480, [float("nan")] * 16), (500, [float("inf")] + [1.0] * 15),
             (520, [1e30] * 16), (540, [1.0, 2.0]), (541, [2.0, -1.0]), (560, [-1e-30] * 16), (None, [1.0] * 16), (-20, [0.5] * 16)]
    frame = spark.createDataFrame([(i, v, 1, 0.5, 2) for i, v in rows], SCHEMA).repartition(4)
    got = ann.search(frame, F.col("vec_id") % 20 == 0, k=20, block_rows=block_rows).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute(rows, 20)


def test_bound_holds():
    draw = np.random.default_rng(1)
    for scale in (1e-20, 1.0, 1e20):
        a, b = draw.normal(size=(50, 33)) * scale, draw.normal(size=(60, 33))
        qa, qb = ann.quantised(a), ann.quantised(b)
        near = (qa[0].astype(np.float64) @ qb[0].T) * qa[1][:, None] * qb[1]
        slack = qa[3][:, None] * (qb[2] + qb[3]) + qa[2][:, None] * qb[3]
        assert (np.abs(near - a @ b.T) <= slack * (1 + 1e-9)).all()


def test_few_and_none(spark):
    one = spark.createDataFrame([(0, [1.0, 2.0], 1, 0.0, 1), (3, [2.0, 1.0], 1, 0.0, 1)], SCHEMA)
    assert [tuple(r) for r in ann.search(one, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 3, 4.0)]
    assert ann.search(one.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_thousands_of_input_partitions(spark):
    """Blocks are numbered by task; the numbers of tasks from 2,048 on have to fit."""
    draw = np.random.default_rng(5)
    rows = [(i, draw.normal(size=3).astype(np.float32).tolist()) for i in range(4200)]
    frame = spark.createDataFrame([(i, v, 1, 0.5, 2) for i, v in rows if i % 100 == 0 or i > 4100], SCHEMA)
    numbered = spark.sparkContext.parallelize([], 2000).union(spark.sparkContext.parallelize(frame.collect(), 100))
    wide = spark.createDataFrame(numbered, frame.schema)
    assert wide.rdd.getNumPartitions() == 2100
    got = ann.search(wide, F.col("vec_id") % 20 == 0).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == brute([(r["vec_id"], r["embedding"]) for r in frame.collect()], 20)


def test_rows_of_late_tasks_are_told_apart():
    block = ann.QueryBlock(5000 << 32, np.arange(3), np.eye(3), 2)
    block.meet(np.arange(3, 6), np.eye(3), ann.quantised(np.eye(3)))
    out = block.rows()
    assert set(zip(out["block"].tolist(), out["row"].tolist(), strict=True)) == {(5000 << 32, r) for r in range(3)}
