"""Order statistics, versioned tables, fits in rounds, told sequences and operational checks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from recollect.functions import text as X
from recollect.operators import assembly, evaluate, families
from recollect.plans import operations
from recollect.queries import retrieval
from recollect.schemas import FACT, SUMMARY, TURN, conforming
from recollect.sources import versions


@pytest.mark.parametrize(("most", "bins"), [(100_000, 1024), (20, 4)])
def test_order_statistics_are_exact_for_skew_ties_and_null_groups(spark, most, bins):
    rnd = random.Random(3)
    data = [("a", rnd.gauss(0, 1)) for _ in range(500)] + [("a", 5.0)] * 400 + [("b", 1e9), ("b", 1.0)] + [(None, float(i)) for i in range(77)] + [("c", None)] + [("d", 2.0)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    got = {(r.g, r.name): r.value for r in evaluate.order_statistics(df, "v", ["g"], evaluate.P95 | evaluate.MIDDLE, most, bins).collect()}
    want = {}
    for g in ("a", "b", None, "d"):
        x = sorted(v for k, v in data if k == g and v is not None)
        want |= {(g, "p95"): x[math.ceil(len(x) * 95 / 100) - 1], (g, "below"): x[(len(x) + 1) // 2 - 1], (g, "above"): x[len(x) // 2]}
    assert got == want
    assert evaluate.order_statistics(df.limit(0), "v", ["g"], evaluate.P95).count() == 0


def test_versions_are_seen_whole_and_come_back(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    a, b = spark.range(5), spark.range(5, 12)
    assert versions.versions(spark, at) == {} and versions.commit(a, at) == 1 and versions.commit(b, at, expected=1) == 2
    with pytest.raises(versions.Conflict):
        versions.commit(a, at, expected=1)
    with pytest.raises(Exception, match="broken"):
        versions.commit(a.select(F.when(F.col("id") > 3, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col("id")).alias("id")), at)
    assert operations.same_rows(versions.read(spark, at), b) and operations.same_rows(versions.read(spark, at, 1), a)
    assert versions.rollback(spark, at, 1) == 3 and operations.same_rows(versions.read(spark, at), a)
    (tmp_path / "t/log/0000000004").write_bytes(b"")  # a commit that ended after it had taken its number
    assert versions.commit(b, at) == 5 and max(versions.versions(spark, at)) == 5
    assert not operations.same_rows(a, a.unionByName(a.limit(1)))


def test_every_request_gets_the_largest_fit_of_its_rounds(spark):
    rnd, budget, margin = random.Random(1), 300, 7
    costs = {f"q{i}": [rnd.randint(1, 60) for _ in range(30)] for i in range(12)}
    rows = spark.createDataFrame([(q, n, c) for q, cs in costs.items() for n, c in enumerate(cs)], "query_id string, n int, cost int")
    queries = spark.createDataFrame([(q,) for q in costs], "query_id string")

    def select(asked):  # a prefix by cost
        met = asked.join(rows, "query_id").withColumn("up_to", F.expr("sum(cost) over (partition by query_id order by n)"))
        return met.filter("up_to <= budget_tokens").select("query_id", "n", "cost")

    def render(chosen):  # a line costs more than its fact
        return chosen.groupBy("query_id").agg(F.sum(F.col("cost") + 9).alias("tokens"))

    want = {}
    for q, cs in costs.items():
        left = budget
        for k in range(12):
            kept, used = [], 0
            for n, c in enumerate(cs):
                if used + c > left:
                    break
                kept, used = [*kept, n], used + c
            over = used + 9 * len(kept) - budget
            if over <= 0 or k == 11:
                break
            left -= over + margin
        want[q] = (left, kept)
    got = {}
    for r in assembly.fit_to_budget(select, render, queries, budget, 12, margin).orderBy("query_id", "n").collect():
        got.setdefault(r.query_id, (r.fitted_budget, []))[1].append(r.n)
    assert got == want and len({w for w, _ in want.values()}) > 3


def test_only_questions_of_change_are_told_sequences(spark):
    scored, asked = retrieval._requests(spark, "/root/testdata/sf0.001")
    told = families.sequence_texts(scored).filter(F.col("text").rlike("^(Before and now|From first to latest): ")).join(asked.select("query_id", X.question_mode(F.col("query")).alias("mode")), "query_id")
    got = {(r.mode, r.text.split(":")[0]) for r in told.collect()}
    assert got == {("previous", "Before and now"), ("change", "From first to latest")}
    assert {r.mode for r in asked.select(X.question_mode(F.col("query")).alias("mode")).collect()} == {"current", "previous", "change"}


def test_older_summaries_are_quarantined_by_slot(spark):
    row = spark.createDataFrame([("The port is 5432. Rate is 30 requests per minute now.",)], "t string").select(X.stated_values(F.col("t")).alias("s")).first().s
    assert {(p.slot_key, p.slot_value) for p in row} == {("infra.port", "5432"), ("vendor_api.rate_limit", "30 requests per minute")}
    fact = {"namespace": "n", "seq": 1, "kind": "number", "text": "port 99", "source_turn_id": 5, "status": "active", "slot_key": "infra.port", "slot_value": "99"}
    told = [{"namespace": ns, "seq": i, "covers_turn_ids": turns, "text": text} for i, (ns, turns, text) in enumerate([("n", [1, 4], "Port is 77. Port 99."), ("n", [5], "port is 66"), ("n", [2], "host is 99x"), ("m", [1], "port is 55"), ("n", [], "port is 44")])]
    got = assembly.quarantined(conforming(spark.createDataFrame([fact]), FACT), conforming(spark.createDataFrame(told), SUMMARY), spark.createDataFrame([], TURN)).collect()
    assert [tuple(r) for r in got] == [("n", "infra.port", "77")]


def test_operational_checks_pass_and_find_faults(spark, monkeypatch):
    turns = spark.createDataFrame([(ns, i, "user", f"{ns} {i} " + "x" * 300, 80) for ns in "ab" for i in range(1, 8)], "namespace string, turn_id bigint, role string, content string, tokens bigint")
    got = {r.name: (r.outcome, r.n_rows) for r in operations.checked(spark, turns).collect()}
    assert {v[0] for k, v in got.items() if k != "hardware"} == {"pass"} and all(v[1] > 0 for k, v in got.items() if k != "hardware")
    monkeypatch.setattr(operations.versions, "rollback", lambda spark, table, number: number + 2)
    assert not operations.rolled_back(spark, turns)[0]
