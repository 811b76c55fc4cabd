import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from harrow.operators import skew


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    keys = ["hot"] * 700 + [f"k{i % 90}" for i in range(1200)] + [None] * 30
    rng.shuffle(keys)
    return [(i, k, rng.randint(0, 3), rng.randint(3, 6), rng.choice([1, 5, None, 3])) for i, k in enumerate(keys)]


def test_placement_is_balanced(spark, rows):
    df = spark.createDataFrame([(i, k) for i, k, *_ in rows if k], "id long, key string")
    plan = skew.plan_placement(df, "key", 200)
    assert plan.num_tasks == 10 and len(plan.heavy["hot"]) == 4 and plan.total == 1900
    sizes = skew.place(df, "key", F.col("id"), plan).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 1900 and max(r["count"] for r in sizes) < 2 * 200
    assert plan == skew.plan_placement(df, "key", 200)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_balanced_join(spark, rows, how):
    left = spark.createDataFrame([(i, k, "l") for i, k, *_ in rows], "id long, key string, note string")
    right = spark.createDataFrame([("hot", 1, "r"), ("hot", 2, "r"), ("k1", 3, "r"), ("none", 4, "r"), (None, 5, "r")], "key string, value int, note string")
    found = skew.balanced_join(left, right, "key", "id", 150, how)
    assert found.columns == ["id", "key", "note", "value", "side_note"]
    wanted = left.alias("l").join(right.alias("r"), F.expr("l.key = r.key"), how).select("id", "l.key", "l.note", "value", F.col("r.note").alias("side_note"))
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, wanted.collect()))
    assert skew.balanced_join(left.limit(0), right, "key", "id", 10, how).count() == 0


def test_join_on_numbers(spark):
    left = spark.createDataFrame([(i, i % 3 if i > 50 else 7) for i in range(200)], "id long, key int")
    right = spark.createDataFrame([(7, "x"), (1, "y")], "key int, v string")
    assert skew.balanced_join(left, right, "key", "id", 20).count() == 51 + sum(i % 3 == 1 for i in range(51, 200))


def test_product_results(spark, rows, make_reviews):
    given = [(i, k, n, d, s, "t") for i, k, n, d, s in rows]
    reviews = make_reviews(given + [(*g, 5) for g in given[:400]])
    found, plan = skew.product_results(reviews, 2, 150)
    found = {r.product_id: r for r in found.collect()}
    assert len(plan.heavy) == 1
    by = {}
    for i, k, n, d, s, _ in given:
        if k:
            by.setdefault(k.upper(), []).append((i, n, d, s or 1))
    assert {k: r.num_reviews for k, r in found.items()} == {k: len(v) for k, v in by.items()}
    for k, v in by.items():
        w = [(n / d if d else 0.5, s) for _, n, d, s in v]
        total = sum(x for x, _ in w)
        assert abs(found[k]["rank"] - (sum(x * s for x, s in w) / total if total else 0)) < 1e-9
        assert [b.doc_id for b in found[k].best] == [i for i, *_ in sorted(v, key=lambda x: (-x[1], -x[3], x[0]))[:2]]
    above = {r.product_id for r in skew.products_above(reviews, 0.01).collect()}
    assert above == {k for k, v in by.items() if len(v) > 0.01 * len(given)}


def test_no_products(make_reviews):
    assert skew.products_above(make_reviews([]), 0.01).count() == 0
    assert skew.products_above(make_reviews([(1, None, None, None, None, None), (None, "a", 1, 1, 1, "x")]), 0.01).count() == 0
