"""Damaged model output, general facts, and slot families."""

import random

import pytest
from pyspark.sql import functions as F

from recollect.functions import parsing as P
from recollect.operators import families

TURNS = [(1, "Put the parser on the new host"), (5, "otter-17 is the target"), (3, "The list says so"), (7, "The alert threshold is 0.83")]


def test_fenced():
    facts, flags, _ = P.extract('```json\n[{"kind": "decision", "text": "Deploy it", "source_turn_id": 1}]\n```', TURNS)
    assert [f["text"] for f in facts] == ["Deploy it"] and flags["fence_stripped"] and not flags["retried"]


def test_truncated_keeps_the_complete_prefix():
    facts, flags, _ = P.extract('[{"kind": "entity", "text": "node is it", "source_turn_id": 5}, {"kind": "number"', TURNS)
    assert [f["text"] for f in facts] == ["node is it"] and flags["truncated"] and flags["success"]


def test_siblings():
    facts, flags, _ = P.extract('{"text": "a", "source_turn_id": 3}\n\n{"text": "b", "source_turn_id": 5}', TURNS)
    assert {f["text"] for f in facts} == {"a", "b"} and not flags["retried"]


def test_loop_is_salvaged_to_one():
    one = '{"kind": "number", "text": "The pressure threshold is 0.83", "source_turn_id": 7}'
    facts, flags, _ = P.extract("[" + ", ".join([one] * 6) + "]", TURNS)
    assert len(facts) == 1 and flags["loop_detected"] and flags["loop_salvaged"] and flags["success"]


def test_garbage_items_are_dropped():
    facts, flags, _ = P.extract('[{"text": "Use DuckDB", "source_turn_id": 1}, {"not_a_fact": true}, {"kind": "number"}]', TURNS)
    assert [f["text"] for f in facts] == ["Use DuckDB"] and flags["success"]


def test_unrecoverable_fails_cleanly_and_retry_helps():
    facts, flags, error = P.extract("no JSON here", TURNS)
    assert facts == [] and not flags["success"] and flags["retried"] and error
    facts, flags, error = P.extract("no JSON here", TURNS, lambda raw, error, truncated: '[{"text": "x", "source_turn_id": 1}]')
    assert len(facts) == 1 and flags["retry_success"] and error is None


@pytest.mark.parametrize(
    ("item", "text"),
    [
        ({"source_turn_id": 1, "subject": "upper quartile", "attribute": 'value":"134'}, "upper quartile value: 134"),
        ({"source_turn_id": 1, "subject": "s", "attribute": "a", "value": "I may be bald", "them!": False, "false}": False}, "s a: I may be bald"),
        ({"source_turn_id": 1, "subject": "time", "attribute": "challenge", "value=": "a suitable time"}, "time challenge: a suitable time"),
        ({"source_turn_id": 1, "subject": "city", "attribute": "population", "value": None}, "city population"),
        ({"source_turn_id": "443,subject", "team": 'attribute":"size', "value": "5"}, "team size: 5"),
        ({"source_turn_id": "Turn 3", "text": "x"}, "x"),
    ],
)
def test_item_repairs(item, text):
    assert P.fact_item(item, TURNS)["text"] == text


@pytest.mark.parametrize("item", [{"is_correction": False}, {"them!": False}, {"kind": "entity", "source_turn_id": 7, "value": None}, "text"])
def test_empty_items_are_refused(item):
    with pytest.raises(ValueError):
        P.fact_items([item], TURNS)


def test_missing_turn_is_found_by_words():
    assert P.fact_item({"text": "alert threshold 0.83"}, TURNS)["source_turn_id"] == 7


@pytest.mark.parametrize(
    ("text", "triple"),
    [
        ("The rate limit is 500 requests per minute.", ("vendor_api", "rate_limit", "500 requests per minute")),
        ("Please use duckdb instead of sqlite for telemetry.", ("telemetry", "engine", "duckdb")),
        ("The office floor is seven now.", ("office", "floor", "seven")),
        ("Migrate to graviton for the batch workers", ("the batch", "workers", "graviton")),
        ("Concurrency is set to 8 now", ("task_queue", "concurrency", "8")),
        ("nothing here", (None, None, None)),
    ],
)
def test_general_facts(text, triple):
    got = P.general_fact(text)
    assert got[1:] == triple[1:] and (got[0] == triple[0])


def test_episode_card():
    assert P.episode_card('{"facts": [{"text": "x", "source_turn_id": 1}], "summary": " s "}', TURNS)[1] == "s"
    with pytest.raises(ValueError):
        P.episode_card('{"facts": []}', TURNS)


def test_token_loop():
    words = "alpha beta gamma delta epsilon zeta eta theta"
    assert P.token_loop(f"x {words} {words} y") and not P.token_loop(f"{words} and {words}") and not P.token_loop(", " * 40)


def grouped(spark, keys, rule):
    items = spark.createDataFrame([("q", i, k, v) for i, (k, v) in enumerate(keys)], "query_id string, place long, slot_key string, slot_value string")
    found = {}
    for r in rule(items).collect():
        found.setdefault(r.family, []).append(r.place)
    return sorted(sorted(g) for g in found.values())


def test_same_role_keeps_opposites_and_instances_apart(spark):
    apart = [("trip.start time", "trip.end time"), ("goal.min level", "goal.max level"), ("kitchen.fridge temperature", "kitchen.freezer temperature"), ("workout.sets", "workout.reps"), ("alice.age", "bob.age")]
    one = [("apex goal.target level", "apex goal.level target"), ("team.size", "team size.size")]
    rows = spark.createDataFrame(apart + one, "a string, b string").select("a", families.same_role(F.col("a"), F.col("b")).alias("same")).collect()
    assert [r.same for r in rows] == [False] * len(apart) + [True] * len(one)


def test_middle_spelling_joins_no_two_roles(spark):
    groups = grouped(spark, [(k, None) for k in ("trip.start time", "trip.time", "trip.end time")], lambda i: families.role_groups(i, "query_id"))
    assert groups and all(not {0, 2} <= {*g} for g in groups)


def test_family_needs_anchor_in_query(spark):
    keys = [("apex goal.target level", "100"), ("apex goal.level target", "150"), ("other.thing", "1"), (None, "2"), ("", "3")]
    asked = lambda q: spark.createDataFrame([("q", q)], "query_id string, query string")
    assert grouped(spark, keys, lambda i: families.slot_families(i, "query_id", asked("what is my apex goal"))) == [[0, 1]]
    assert grouped(spark, keys, lambda i: families.slot_families(i, "query_id", asked("what is my plan"))) == []


def plain_guarded(n, near):
    """Guarded union over all pairs, by sets of sets."""
    groups = [{i} for i in range(n)]
    for late in range(n):
        for early in range(late):
            a, b = (next(g for g in groups if x in g) for x in (early, late))
            if (early, late) in near and a is not b and all((min(x, y), max(x, y)) in near for x in a for y in b):
                groups.remove(b)
                a |= b
    return {x: min(g) for g in groups for x in g}


def plain_seeded(n, near):
    left, out = list(range(n)), {}
    while left:
        group = []
        for i in left:
            if all((g, i) in near for g in group):
                group.append(i)
        out |= dict.fromkeys(group, group[0])
        left = [i for i in left if i not in group]
    return out


def test_groups_equal_plain_versions():
    rnd = random.Random(5)
    for _ in range(300):
        n = rnd.randint(2, 9)
        near = {(i, j) for j in range(n) for i in range(j) if rnd.random() < 0.6}
        friends = {p: {p, *(x for pair in near if p in pair for x in pair)} for pair in near for p in pair}
        pairs = [(i, j, "w") for i, j in near]
        for rule, plain in ((families.by_guarded_union, plain_guarded), (families.by_first_welcome, plain_seeded)):
            want = plain(n, near)
            assert rule(pairs, friends) == {p: want[p] for p in friends}


SCORED = "query_id string, query string, kind string, item_seq long, status string, slot_key string, slot_value string, turn_id long, score double, text string, cost long"


def test_newest_value_stands_for_its_family(spark):
    q = "what is my apex goal"
    rows = [
        ("q", q, "entry", 1, "active", "apex goal.target level", "100", 3, 0.9, "goal 100", 5), ("q", q, "entry", 2, "active", "apex goal.level target", "150", 8, 0.4, "goal 150", 5), ("q", q, "entry", 3, "stale", "apex goal.level target", "90", 1, 0.3, "goal 90", 5),
        ("q", q, "entry", 4, "active", None, None, 2, 0.1, "note", 5), ("q", q, "summary", 1, None, None, None, 4, 0.5, "the apex goal was 100", 5), ("q", q, "summary", 2, None, None, None, 4, 0.5, "it was 1000", 5),
    ]
    df = spark.createDataFrame(rows, SCORED)
    got = {(r.kind, r.item_seq): (r.score, r.text, r.cost) for r in families.prefer_newest(df, "cross_key").collect()}
    assert sorted(got) == [("entry", 2), ("entry", 3), ("entry", 4), ("summary", 2)]
    assert got["entry", 2] == (0.9, families.NEWEST + "goal 150", 5 + len(families.NEWEST) // 4) and got["entry", 4] == (0.1, "note", 5)
    by_role = {(r.kind, r.item_seq): r.score for r in families.prefer_newest(df, "role").collect()}
    assert by_role == {("entry", 2): 0.9, ("entry", 3): 0.3, ("entry", 4): 0.1, ("summary", 1): 0.5, ("summary", 2): 0.5}
    told = {(r.kind, r.item_seq): r.text for r in families.sequence_texts(df).collect()}
    assert len(told) == 6 and told["entry", 2].endswith("then 150 at turn 8. goal 150") and told["entry", 1] == "goal 100"


def test_lost_quotes_and_stray_signs():
    assert P.salvaged_keys({"source_turn_id": "7, text", "it rained": 'slot_key":"weather', "kind": "entity"}) == {"source_turn_id": 7, "text": "it rained", "slot_key": "weather", "kind": "entity"}
    assert P.salvaged_keys({' "text": ': "x", "unknown": 1, "=value": "2"}) == {"text": "x", "value": "2"}
    assert P.salvaged_keys({"source_turn_id": "7", "a": 1}) == {"source_turn_id": "7"}
