"""Selections under a budget, and what of them grows with the corpus."""

import random

from pyspark.sql import functions as F

from recollect.operators import assembly, retrieval
from recollect.schemas import FACT, SUMMARY, TURN
from recollect.sources.scratch import written


def test_few_rows_are_folded_whatever_their_number(spark):
    rnd = random.Random(5)
    rows = [(q, i, rnd.choice([0, 1, 2, 3, 7, 11, 40]) if i % 50 else 0, 90 + 10 * q) for q in range(3) for i in range(2000)]
    df = spark.createDataFrame([(str(q), i, c, b) for q, i, c, b in rows], "query_id string, i long, cost long, available long").repartition(7)
    got = retrieval.skip_fit(df, [F.col("i").desc()]).collect()
    want = set()
    for q in range(3):
        left = 90 + 10 * q
        for _, i, c, _ in sorted((r for r in rows if r[0] == q), key=lambda r: -r[1]):
            if c <= left:
                left -= c
                want.add((str(q), i))
    assert {(r.query_id, r.i) for r in got} == want and len(got) == len(want)
    priced = [r for r in got if r.cost]
    assert max(r.place for r in priced) < 1000  # 110 * (1 + 1/2 + 1/3 + ..) and the rows that cost nothing


def test_texts_order_equal_scores_and_come_back(spark):
    said = [("n", s, "entity", t, 4, "active", None, None) for s, t in [(1, "zebra stripes here"), (2, "apple stripes here"), (3, "mango stripes here")]]
    facts = spark.createDataFrame(said, "namespace string, seq long, kind string, text string, source_turn_id long, status string, slot_key string, slot_value string")
    facts = facts.select(*[(F.col(f.name) if f.name in facts.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in FACT])
    cost = facts.select(retrieval.entry_cost().alias("c")).first()[0]
    asked = spark.createDataFrame([("q", "n", "stripes", 0)], "query_id string, namespace string, query string, budget_tokens long")
    asked = asked.withColumn("budget_tokens", F.lit(768 + 1 + 2 * cost).cast("long"))
    for select in (retrieval.lexical_selection, retrieval.packed_selection):
        got = select(asked, facts, spark.createDataFrame([], SUMMARY), spark.createDataFrame([], TURN))
        assert {"text", "status", "slot_key", "slot_value", "query", "budget_tokens", "score", "n_shared", "available", "place"} <= set(got.columns)
        assert sorted((r.text, r.place) for r in got.collect()) == [("apple stripes here", 1), ("mango stripes here", 2)]


def test_only_texts_that_order_candidates_are_written(spark, monkeypatch):
    kept = {}

    def spy(df, name):
        kept[name] = written(df, name)
        return kept[name]

    monkeypatch.setattr(retrieval, "written", spy)
    said = [("n", s, "entity", t, turn, "active", None, None) for s, t, turn in [(1, "zebra stripes here", 4), (2, "apple stripes here", 4), (3, "mango stripes here", 5), (4, "other words there", None)]]
    facts = spark.createDataFrame(said, "namespace string, seq long, kind string, text string, source_turn_id long, status string, slot_key string, slot_value string")
    facts = facts.select(*[(F.col(f.name) if f.name in facts.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in FACT])
    asked = spark.createDataFrame([("q", "n", "stripes", 2000)], "query_id string, namespace string, query string, budget_tokens long")
    got = retrieval.lexical_selection(asked, facts, spark.createDataFrame([], SUMMARY), spark.createDataFrame([], TURN)).collect()
    assert sorted((r.place, r.text, r.item_seq) for r in got) == [(1, "mango stripes here", 3), (2, "apple stripes here", 2), (3, "zebra stripes here", 1), (4, "other words there", 4)]
    assert "text" not in kept["candidates"].columns
    assert sorted(r.told.text for r in kept["candidates"].collect() if r.told) == ["apple stripes here", "zebra stripes here"]


def test_prompts_look_once_and_only_at_their_namespaces(spark, monkeypatch):
    seen = []
    own = assembly.quarantined
    monkeypatch.setattr(assembly, "quarantined", lambda facts, *rest: seen.append({r.namespace for r in facts.select("namespace").distinct().collect()}) or own(facts, *rest))
    said = [(n, s, "entity", f"size {v}", s, "active", "team.size", v) for n in ("a", "b") for s, v in [(1, "5"), (2, "7")]]
    facts = spark.createDataFrame(said, "namespace string, seq long, kind string, text string, source_turn_id long, status string, slot_key string, slot_value string")
    facts = facts.select(*[(F.col(f.name) if f.name in facts.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in FACT])
    names = spark.createDataFrame([("a", "S", "T"), ("c", "S", "T")], "namespace string, system string, task string")
    got = {r.namespace: r.prompt for r in assembly.assembled(names, facts, spark.createDataFrame([], SUMMARY), spark.createDataFrame([], TURN)).collect()}
    assert set(got) == {"a", "c"} and "size 7" in got["a"] and "size 5" not in got["a"] and "FACTS" not in got["c"]
    assert seen == [{"a"}]
