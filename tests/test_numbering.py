"""Running folds against plain loops, with keys that cross buckets."""

import random

from pyspark.sql import functions as F

from capturemill.operators.numbering import BUCKET_BITS, LEVELS, dense_first_seen_index, numbered, running_folds


def test_running_folds_cross_buckets(spark):
    rng = random.Random(3)
    rows = []
    for g in range(3):
        keys = rng.sample(range(0, 1 << (2 * BUCKET_BITS + 2)), 300) + rng.sample(range(500), 100)
        keys = sorted({k - 1000 for k in keys})
        rows += [(g, k, rng.choice([None, rng.randint(-5, 9)])) for k in keys]
    df = spark.createDataFrame(rows, "g bigint, k bigint, v bigint").repartition(5)
    for exclusive in (False, True):
        out = running_folds(df, ["g"], "k", {
            "total": ("sum", F.col("v")), "top": ("max", F.col("v")),
            "latest": ("max", F.when(F.col("v").isNotNull(), F.struct("k", "v"))),
        }, exclusive)
        got = {(r["g"], r["k"]): (r["total"], r["top"], r["latest"] and r["latest"]["v"]) for r in out.collect()}
        assert len(got) == len(rows)
        for g in range(3):
            seen = []
            for _, k, v in sorted(r for r in rows if r[0] == g):
                before = list(seen)
                if v is not None:
                    seen.append(v)
                use = before if exclusive else seen
                want = (sum(use), max(use), use[-1]) if use else (None, None, None)
                assert got[g, k] == want


def test_numbers_and_first_seen(spark):
    rows = [(m, p, p * 7 % 5) for m in (1, 2) for p in range(0, 200_000, 997)]
    df = spark.createDataFrame(rows, "mesh_id bigint, pos bigint, key bigint").repartition(6)
    got = sorted((r["mesh_id"], r["pos"], r["n"]) for r in numbered(df, ["mesh_id"], "pos", "n").collect())
    want = sorted((m, p, p // 997 + 1) for m, p, _ in rows)
    assert got == want
    index = dense_first_seen_index(df, ["mesh_id"], ["key"], "pos").collect()
    for m in (1, 2):
        order = list(dict.fromkeys(k for mm, _, k in rows if mm == m))
        assert {r["key"]: r["index"] for r in index if r["mesh_id"] == m} == {k: i for i, k in enumerate(order)}


def test_results_do_not_depend_on_partitions(spark):
    df = spark.range(5000).selectExpr("id % 7 AS g", "id * 31 AS k", "id % 11 AS v")
    out = [sorted(map(tuple, running_folds(df.repartition(n), ["g"], "k", {"s": ("sum", F.col("v"))}).collect()))
           for n in (1, 8)]
    assert out[0] == out[1]


def test_broadcast_only_when_counted_small(spark):
    from capturemill.session import counted_side

    df = spark.range(100)
    for limit, hinted in ((100, True), (99, False)):
        side, rows = counted_side(df, max_rows=limit)
        plan = spark.range(10).join(side, "id")._jdf.queryExecution().logical().toString()
        assert rows == 100 and ("UnresolvedHint" in plan or "ResolvedHint" in plan) == hinted


def test_keys_spread_over_all_bits(spark):
    """No window sees more rows than a level has buckets, wherever the keys lie."""
    rng = random.Random(9)
    keys = sorted({rng.randrange(-(1 << 63), 1 << 63) for _ in range(3000)} | {-(1 << 63), (1 << 63) - 1, 0, -1})
    df = spark.createDataFrame([(1, k) for k in rng.sample(keys, len(keys))], "g bigint, k bigint").repartition(5)
    got = {r["k"]: r["n"] for r in numbered(df, ["g"], "k", "n").collect()}
    assert got == {k: n for n, k in enumerate(keys, 1)}
    plan = numbered(df, ["g"], "k", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == LEVELS
    for n in range(LEVELS):
        bucket = F.shiftright("k", n * BUCKET_BITS)
        above = F.shiftright("k", min((n + 1) * BUCKET_BITS, 63)) if n + 1 < LEVELS else F.lit(0)
        most = df.select(bucket.alias("b"), above.alias("a")).distinct().groupBy("a").count().agg(F.max("count")).first()[0]
        assert most <= 1 << BUCKET_BITS
