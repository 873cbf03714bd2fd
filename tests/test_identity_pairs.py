"""Work on all pairs of embeddings that must not hold or shuffle all pairs."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect import catalog
from recollect.operators import identity


def ordered_whole(queries, rows, per_key, seed):
    """The sample from all pairs in order."""
    q, r = queries.select(F.col("key").alias("l"), F.col("label").alias("la")), rows.select(F.col("key").alias("r"), F.col("label").alias("lb"))
    pool = q.join(r, (F.col("l") != F.col("r")) & (F.col("la") != F.col("lb"))).select("l", "r")
    rank = F.row_number().over(W.partitionBy("l").orderBy(F.xxhash64(F.lit(seed), "l", "r")))
    return sorted(map(tuple, pool.withColumn("rank", rank).filter(F.col("rank") <= per_key).select("l", "r").collect()))


@pytest.mark.parametrize("expected", [32, 1])
def test_sampled_negatives_are_those_of_all_pairs(spark, monkeypatch, expected):
    rnd, ordered = np.random.default_rng(3), []
    labels = [None if i % 97 == 5 else "rare" if i in (700, 901) else str(rnd.integers(0, 4)) if i < 2000 else "most" for i in range(6000)]
    rows = spark.createDataFrame([*enumerate(labels), (None, "1"), (100, "most")], "key bigint, label string").repartition(3)
    queries = rows.filter("key % 20 = 0")
    monkeypatch.setattr(identity, "EXPECTED", expected)  # 1: many queries find too few and are looked up again
    kept = identity.sampled
    monkeypatch.setattr(identity, "sampled", lambda pool, *a: (ordered.append(pool.count()), kept(pool, *a))[1])
    got = sorted(map(tuple, identity.sampled_negatives(queries, rows, 2, 7).collect()))
    assert got == ordered_whole(queries, rows, 2, 7) and len(got) > 550
    assert ordered[0] < 2 * 2 * expected * queries.count() and len(ordered) == (1 if expected > 1 else 2)


def test_sampled_negatives_where_there_are_few(spark):
    rows = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, None)], "key bigint, label int")
    assert sorted(map(tuple, identity.sampled_negatives(rows, rows).collect())) == [(0, 2), (1, 2), (2, 0), (2, 1)]
    assert identity.sampled_negatives(rows, rows.limit(0)).count() == 0 and identity.sampled_negatives(rows.limit(0), rows).count() == 0
    assert identity.sampled_negatives(rows.filter("label = 1"), rows.filter("label = 1")).count() == 0


SCHEMA = "vec_id bigint, embedding array<float>, label int"


def clusters(n, noise, seed=4):
    """Vectors near one of four directions, which is the label: at little noise some threshold is safe."""
    rnd = np.random.default_rng(seed)
    centres, label = np.eye(8)[:4], rnd.integers(0, 4, n)
    return [(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(centres[label] + noise * rnd.standard_normal((n, 8)), label, strict=True))]


def judged(spark, tmp_path, rows, **sizes):
    """The query's and its SQL's result for rows; with sizes, the operator's."""
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{path}/*.parquet'")
    df = spark.read.parquet(path).select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), "label")
    out = identity.best_threshold_of_all(df, **sizes) if sizes else catalog.QUERIES["identity_best_threshold"](spark, str(tmp_path))
    assert_same(out, c, catalog.ORACLE_SQL["identity_best_threshold"])
    return tuple(out.first())


def test_best_threshold_sees_pairs_of_other_numbers(spark, tmp_path):
    """Vectors 1 and 2 are alike under two labels, which no pair with a number divisible by 100 shows."""
    rows = [(0, [1.0, 0.0, 0.0], 1), (1, [0.0, 1.0, 0.0], 1), (2, [0.0, 1.0, 0.0], 2), (3, [1.0, 0.1, 0.0], 1)]
    assert judged(spark, tmp_path, rows) == (None, 0, 0, 0.0)


@pytest.mark.parametrize("noise", [0.02, 0.12, 0.2])
def test_best_threshold_of_all_blocks(spark, tmp_path, noise):
    rows = clusters(330, noise)
    threshold, merges, false, recall = judged(spark, tmp_path, rows, block_rows=50)
    assert false == 0 and merges > 0 and threshold > 0 and (recall == 1.0) == (noise < 0.1)


def test_best_threshold_of_odd_vectors(spark, tmp_path):
    rows = clusters(120, 0.05)
    rows += [(200, None, 1), (201, [0.0] * 8, 1), (202, [None] + [1.0] * 7, 2), (203, [0.5] * 8, None), (None, [1.0] * 8, 1), (5, rows[5][1], rows[5][2]), (204, [0.4] * 8, None)]
    first = judged(spark, tmp_path / "a", rows, block_rows=40)
    assert first[1] > 0 and first[3] < 1  # pairs without a cosine count as pairs of one slot
    endless = [(300, [float("inf")] * 8, 9), (301, [float("nan")] * 8, 9)]
    assert judged(spark, tmp_path / "b", rows + endless, block_rows=40) == (None, 0, 0, 0.0)


def test_best_threshold_without_false_merges_or_pairs(spark, tmp_path):
    assert judged(spark, tmp_path / "a", [(i, v, 1) for i, v, _ in clusters(60, 0.3)], block_rows=20) == (-1.0, 60 * 59 // 2, 0, 1.0)
    assert judged(spark, tmp_path / "b", [(i, v, i) for i, v, _ in clusters(60, 0.3)]) == (None, 0, 0, 0.0)
    assert judged(spark, tmp_path / "c", [(i, v, None) for i, v, _ in clusters(60, 0.3)]) == (None, 0, 0, 0.0)
    assert judged(spark, tmp_path / "d", []) == (None, 0, 0, 0.0)
    endless = [(0, [float("nan"), 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.0, 0.0], 2)]
    assert judged(spark, tmp_path / "e", endless)[1:] == (1, 0, 1.0)
