"""Vector index, entity resolution and fusion against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.operators import fusion, identity, vectors


def clustered(n=1500, groups=150, size=24, spread=0.35, seed=3):
    rnd = np.random.default_rng(seed)
    centres = rnd.standard_normal((groups, size))
    x = centres[rnd.integers(0, groups, n)] + spread * rnd.standard_normal((n, size))
    x[7] = 0.0
    x[9] = x[8]
    return x


@pytest.fixture(scope="module")
def rows(spark):
    x = clustered()
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)], "key bigint, vector array<double>").repartition(5).cache(), x


def cosines(x, y):
    a, b = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, y))
    return np.round(a @ b.T, 6)


def test_blocks_give_every_pair(spark, rows):
    df, x = rows
    few = df.filter("key < 40")
    sims = cosines(x[:40], x)
    want = {(i, j) for i, j in zip(*np.nonzero(sims >= 0.8), strict=True) if i != j}
    got = identity.searched(few, df, 0.8, block_rows=64).collect()
    assert {(r.l, r.r) for r in got} == want and len(got) == len(want)
    assert all(abs(r.sim - sims[r.l, r.r]) < 2e-6 for r in got)
    assert identity.searched(few, df, None, block_rows=700).count() == 40 * 1499


def test_best_of_blocks(spark, rows):
    df, x = rows
    alone = F.lit(0).alias("cell")
    got = vectors.matched(df.filter("key < 20").select(alone, "key", "vector"), df.select(alone, "key", "vector"), None, 5, chunk=300).collect()
    sims = cosines(x[:20], x)
    for i in range(20):
        want = sorted(((-sims[i, j], j) for j in range(len(x)) if j != i))[:5]
        assert sorted((-r.sim, r.r) for r in got if r.l == i) == [(s, j) for s, j in want]


def test_index_recall(spark, rows):
    df, x = rows
    cells = vectors.fitted(df, 0.82, per_cell=50)
    assert len(cells.centres) == 30 and cells.probes < 15
    want = {(r.l, r.r) for r in identity.searched(df, df, 0.82).collect()}
    found = [(r.l, r.r) for r in vectors.near(df, df, 0.82, None, cells).collect()]
    assert len(found) == len(set(found)) and set(found) <= want
    assert len(found) >= 0.95 * len(want) > 5000


def test_index_of_nothing(spark, rows):
    df, _ = rows
    assert vectors.near(df.limit(0), df, 0.8).count() == 0
    assert vectors.near(df, df.limit(0), 0.8).count() == 0


def test_resolution_is_that_of_one_mention_after_another(spark):
    x = clustered(400, 60, 16, 0.3, 8)
    nodes, mentions = np.arange(0, 400, 4), [i for i in range(400) if i % 4]
    sims, want, makers = cosines(x, x), {}, []
    for m in mentions:
        near = [n for n in nodes if sims[m, n] >= 0.82]
        if near:
            # a known node stands behind a key below zero, so the greatest number comes first on a tie
            want[m] = (min(near, key=lambda n: (-sims[m, n], -n)), False)
            continue
        made = [n for n in makers if sims[m, n] >= 0.82]
        want[m] = (min(made, key=lambda n: (-sims[m, n], n)), False) if made else (m, True)
        if not made:
            makers.append(m)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key bigint, vector array<double>")
    got = vectors.resolved(df.filter("key % 4 <> 0"), df.filter("key % 4 = 0"), 0.82)
    assert {r.key: (r.node, r.is_new) for r in got.collect()} == want
    assert sum(new for _, new in want.values()) > 10 and sum(not new for m, (n, new) in want.items() if n % 4) > 10


def test_resolution_without_nodes_or_mentions(spark):
    schema = "key bigint, vector array<double>"
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0])], schema)
    none = spark.createDataFrame([], schema)
    assert sorted((r.key, r.node, r.is_new) for r in vectors.resolved(some, none).collect()) == [(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True)]
    assert vectors.resolved(none, some).count() == 0


def test_ranks_are_fused(spark):
    schema = "query_id string, id bigint, score double, place int"
    a = spark.createDataFrame([("q", 1, 9.0, 1), ("q", 2, 8.0, 2), ("p", 5, 1.0, 1)], schema)
    b = spark.createDataFrame([("q", 2, 0.9, 1), ("q", 3, 0.8, 2)], schema)
    got = [(r.query_id, r.id, r.sources, r.place) for r in fusion.fused({"x": a, "y": b}).orderBy("query_id", "place").collect()]
    assert got == [("p", 5, "x", 1), ("q", 2, "x+y", 1), ("q", 1, "x", 2), ("q", 3, "y", 3)]
    assert fusion.fused({"x": a, "y": b}, k=1).count() == 2


def test_marginal_relevance(spark):
    rnd = np.random.default_rng(4)
    x = np.repeat(rnd.standard_normal((20, 8)), 2, axis=0) + 0.05 * rnd.standard_normal((40, 8))
    score = np.round(rnd.random(40), 3)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    picked = []
    for _ in range(10):
        gain = {i: round(0.7 * score[i] / score.max() - (0.3 * max(unit[i] @ unit[j] for j in picked) if picked else 0), 9) for i in range(40) if i not in picked}
        picked.append(min(gain, key=lambda i: (-gain[i], i)))
    cands = spark.createDataFrame([("q", i, float(s)) for i, s in enumerate(score)] + [("r", 99, 0.5)], "query_id string, id bigint, score double")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key bigint, vector array<double>")
    got = fusion.diverse(cands, rows, 10).orderBy("query_id", "place").collect()
    assert [r.id for r in got] == [*picked, 99]
    assert fusion.diverse(cands.limit(0), rows).count() == 0


def test_traversal_counts_a_node_at_its_first_hop(spark):
    edges = spark.createDataFrame([(1, 2, 0.0, None, None), (2, 3, 0.0, None, None), (3, 1, 0.0, 5.0, 9.0), (4, 4, 0.0, None, None)], "source bigint, target bigint, valid_from double, valid_to double, invalidated_at double")
    seeds = spark.createDataFrame([("now", 1, None), ("then", 1, 3.0), ("lost", 4, None)], "query_id string, id bigint, at double")
    got = sorted((r.query_id, r.id, r.hop, r.support) for r in fusion.frontier(seeds, edges).collect())
    assert got == [("now", 2, 1, 1), ("now", 3, 2, 1), ("then", 2, 1, 1), ("then", 3, 1, 1)]


def test_nearest_of_many_with_copies(spark):
    x = clustered(2600, 130, 24, 0.35, 6)
    x[1200:2400] = x[:1200]  # copies, so that equal ones stand on either side of the k-th place
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key bigint, vector array<double>")
    asked = spark.createDataFrame([(f"q{i}", i, x[i].tolist()) for i in range(0, 1200, 40)] + [("none", 5000, None)], "query_id string, key bigint, vector array<double>")
    got = {}
    for r in fusion.by_vector(asked, df, 25).collect():
        got.setdefault(r.query_id, {})[r.place] = (r.id, r.score)
    sims = cosines(x, x)
    for i in range(0, 1200, 40):
        want = sorted(range(len(x)), key=lambda j: (-sims[i, j], j))[:25]
        assert [got[f"q{i}"][p][0] for p in range(1, 26)] == want
    assert "none" not in got


def test_bm25_by_blocks_equals_joined_postings(spark, monkeypatch):
    rnd = np.random.default_rng(9)
    words = np.array([f"w{i}" for i in range(60)])
    docs = spark.createDataFrame([(i, " ".join(words[np.minimum(59, rnd.geometric(0.08, rnd.integers(0, 30)))]) if i % 90 else None) for i in range(2500)], "id bigint, text string").repartition(5)
    asked = spark.createDataFrame([(f"q{j}", " ".join(words[rnd.integers(0, 60, 1 + j % 7)]) + " w3 W3") for j in range(9)] + [("empty", "")], "query_id string, query string")
    by_blocks = sorted(map(tuple, fusion.bm25(asked, docs, 20).collect()))
    monkeypatch.setattr(fusion, "BROADCAST_TERMS", 3)
    assert by_blocks == sorted(map(tuple, fusion.bm25(asked, docs, 20).collect()))
    assert {r[0] for r in by_blocks} == {f"q{j}" for j in range(9)} and len(by_blocks) == 180
    assert fusion.bm25(asked.limit(0), docs).count() == 0 and fusion.bm25(asked, docs.limit(0)).count() == 0


def test_blocks_are_compared_in_strips(spark, rows):
    df, x = rows
    got = identity.searched(df, df, 0.8, block_rows=5000).collect()
    assert vectors.STRIP < len(x)  # so a block of all rows takes several
    sims = cosines(x, x)
    assert {(r.l, r.r) for r in got} == {(i, j) for i, j in zip(*np.nonzero(sims >= 0.8), strict=True) if i != j}
