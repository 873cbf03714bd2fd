"""Slot families where many items have one key."""

import time

from recollect.operators import families
from recollect.sources.scratch import written


def test_many_items_of_few_keys(spark):
    keys = [("apex goal.target level", "100"), ("apex goal.level target", "90"), ("apex goal.level target", "some words"), ("apex plan.note", "x")]
    rows = [("q", i, *keys[i % 4]) for i in range(12_000)] + [("p", 0, *keys[0]), ("p", 1, *keys[2])]
    items = spark.createDataFrame(rows, "query_id string, place long, slot_key string, slot_value string")
    asked = spark.createDataFrame([("q", "what is my apex goal"), ("p", "what is my apex goal")], "query_id string, query string")
    start = time.time()
    got = families.slot_families(items, "query_id", asked).collect()
    assert time.time() - start < 60  # 72 million pairs of items, 4 kinds
    want = {("q", i): 0 for i in range(12_000) if i % 4 < 2} | {("q", i): 2 for i in range(12_000) if i % 4 == 2} | {("q", i): 3 for i in range(12_000) if i % 4 == 3}
    assert {(r.query_id, r.place): r.family for r in got} == want
    assert all(r.anchors for r in got)


def test_a_pair_of_keys_is_judged_once_for_all_namespaces(spark, monkeypatch):
    kept = {}

    def spy(df, name):
        kept[name] = written(df, name)
        return kept[name]

    monkeypatch.setattr(families, "written", spy)
    keys = ["click.daily count", "click.count daily", "view.daily count", "view.count daily"]
    rows = [(f"n{n}", i, key) for n in range(40) for i, key in enumerate(keys if n % 2 else reversed(keys))]
    got = {(r.namespace, r.slot_key): r.role_group for r in families.grouped_by_role(spark.createDataFrame(rows, "namespace string, seq long, slot_key string")).collect()}
    assert got == {(f"n{n}", k): f"{k.split('.')[0]}.count daily" for n in range(40) for k in keys}
    assert kept["judged"].count() == 4  # two pairs, in either order
