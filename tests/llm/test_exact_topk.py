import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from colsense.llm import exact_topk as T


def brute(rows, k=5):
    whole = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[n] = (i, [math.floor(256 * x) for x in v])
    out = []
    for qi, qv in whole.values():
        if qi % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(qv, v)), i) for i, v in whole.values() if i != qi and len(v) == len(qv))
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumn("score", F.lit("clash"))
    return sorted(map(tuple, T.search(df, df.filter("vec_id % 50 = 0"), **more).collect()))


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    same = [0.25] * 8
    rows += [(1000 + i, same) for i in range(200)]  # ties
    rows += [(None, same), (2000, None), (2001, []), (2050, []), (2002, [None] * 8), (2003, [float("nan")] * 8), (2100, [float("inf")] * 8), (2150, [1.0] * 3), (2151, [2.0] * 3), (1010, same), (0, same)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, block_rows=3) == brute(rows)


def test_few_and_none(spark):
    rows = [(50, [1.0, 2.0]), (51, [0.5, -0.5]), (52, [-3.0, 1e-9])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:1]) == []
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert T.search(df, df).count() == 0


def test_large_components(spark):
    rows = [(i, [float(i) * 1e4, 3e5, -1e5]) for i in range(0, 200)]
    assert run(spark, rows) == brute(rows)
    with pytest.raises(ValueError):
        run(spark, [*rows, (250, [1e15, 1.0, 1.0])])


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_table(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, T.query(spark, sf).collect())) == sorted(con.sql(T.ORACLE).fetchall())


def test_one_id_in_a_third_of_the_rows(spark):
    rng = random.Random(9)
    rows = [(50, [rng.uniform(-1, 1) for _ in range(4)]) for _ in range(100)] + [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(200) if i != 50]
    assert run(spark, rows, block_rows=16) == brute(rows)


def test_plan_has_no_part_for_each_block(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(50 * i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(100)], "vec_id long, embedding array<double>")
    plans = [T.search(df, df, block_rows=n)._jdf.queryExecution().optimizedPlan().toString().count("\n") for n in (100, 5)]
    assert plans[0] == plans[1]
