"""Top-k beyond doubles, with rows that occur very often, against plain integers."""

import random

import pytest

from capsift.llm import topk


def by_rule(rows, k=5):
    out = set()
    good = [(i, [int(x * 256 // 1) for x in v]) for i, v in rows]
    for i in sorted({i for i, _ in good if i % 50 == 0}):
        for q in {tuple(v) for j, v in good if j == i}:
            scored = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in good if j != i and len(v) == len(q))
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])}
    return out


def found(spark, rows, schema="vec_id long, embedding array<double>"):
    vectors = topk.quantized(spark.createDataFrame(rows, schema).repartition(3), "vec_id", "embedding")
    return {tuple(r) for r in topk.search(vectors.filter("vec_id % 50 = 0"), vectors).collect()}


@pytest.mark.parametrize("size,dims", [(4e6, 3), (1.5e4, 700), (1.0, 8)])
def test_scores_are_exact_integers(spark, size, dims):
    rng = random.Random(dims)
    rows = [(i, [rng.uniform(size / 2, size) * rng.choice([1, 1, -1]) for _ in range(dims)]) for i in range(120)]
    assert found(spark, rows) == by_rule(rows)


def test_scores_beyond_64_bits_raise(spark):
    with pytest.raises(ValueError):
        found(spark, [(i, [1e9, 2e9]) for i in range(3)])


def test_a_row_that_occurs_very_often(spark):
    rng = random.Random(8)
    rows = [(i, [rng.random() for _ in range(4)]) for i in range(100)]
    often = (7, [9.0, 9.0, 9.0, 9.0])
    df = spark.createDataFrame(rows + [often], "vec_id long, embedding array<double>")
    many = df.unionByName(spark.range(100_000).selectExpr("7L as vec_id", "array(9D, 9D, 9D, 9D) as embedding")).withColumn("copies", df["vec_id"])
    vectors = topk.quantized(many, "vec_id", "embedding")
    got = {tuple(r) for r in topk.search(vectors.filter("vec_id % 50 = 0"), vectors).collect()}
    assert got == by_rule(rows + [often] * 6)
