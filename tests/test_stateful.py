"""Streams with keyed state: views aligned without arrival numbers, and the live window with its buffer."""

import random
import time

import pytest

from recollect.providers import stub_extract
from recollect.streaming import stateful

VIEW = "namespace string, sent bigint, messages array<struct<role:string,content:string>>"
TURN = "namespace string, turn_id bigint, role string, content string, tokens bigint"


def plain_known(incoming, stored):
    for i in range(len(incoming), 0, -1) if stored else ():
        n = min(i, len(stored))
        if incoming[i - n : i] == stored[-n:]:
            return i
    return 0


def test_alignment_equals_the_plain_search():
    rnd = random.Random(5)
    for _ in range(4000):
        a, b = ([rnd.choice(b"abc"[: rnd.randint(1, 3)]).to_bytes() for _ in range(rnd.randint(0, 9))] for _ in range(2))
        assert stateful.known(a, b) == plain_known(a, b), (a, b)
    assert stateful.mark("a", "bc") != stateful.mark("ab", "c") and stateful.mark(None, "x") != stateful.mark("", "x")


def run_all(spark, path, schema, make):
    """One run over what is in path, from its checkpoint, and all rows so far."""
    with stateful.rocksdb(spark):
        out = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in"))
        out.writeStream.format("parquet").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{path}/out").collect()


def test_overlapping_views_give_each_turn_once_also_after_a_restart(spark, tmp_path):
    said = {ns: [("user" if i % 2 == 0 else "assistant", f"{ns}{i if i != 9 else 3}") for i in range(12)] for ns in "ab"}
    said["a"][5] = ("user", None)
    path = f"file://{tmp_path}"
    views = [[("a", 1, said["a"][:2]), ("a", 2, said["a"][:4]), ("b", 1, said["b"][:3])], [("a", 3, said["a"][2:7]), ("b", 2, said["b"][:3])], [("a", 4, said["a"][4:12]), ("b", 3, said["b"][:12])]]
    for part in views:  # every run is a restart
        spark.createDataFrame(part, VIEW).coalesce(1).write.mode("append").parquet(f"{path}/in")
        got = run_all(spark, path, spark.createDataFrame([], VIEW).schema, stateful.aligned)
    for ns in "ab":
        own = sorted((r.turn_id, r.role, r.content) for r in got if r.namespace == ns)
        assert own == [(i + 1, *m) for i, m in enumerate(said[ns])]


def plain_window(turns, high, low):
    live, out = [], []
    for turn, tokens in turns:
        live.append((turn, tokens))
        if sum(t for _, t in live) > high:
            gone = []
            while sum(t for _, t in live) > low and len(live) > 1:
                gone.append(live.pop(0))
            if gone:
                out.append((gone[0][0], gone[-1][0], len(gone), sum(t for _, t in gone)))
    return out


refusing = stub_extract("bad")


def test_window_evicts_to_the_low_mark_counts_what_it_drops_and_survives_restarts(spark, tmp_path):
    rnd, path = random.Random(2), f"file://{tmp_path}"
    turns = {ns: [(i, rnd.randint(0, 60)) for i in range(1, 41)] for ns in ("good", "bad")}
    turns["good"][20] = (21, 500)
    for lo in (0, 15, 30):
        rows = [(ns, i, "user", f"{ns} {i}", t) for ns in turns for i, t in turns[ns][lo : lo + 15]]
        spark.createDataFrame(rows, TURN).coalesce(1).write.mode("append").parquet(f"{path}/in")
        got = run_all(spark, path, spark.createDataFrame([], TURN).schema, lambda s: stateful.live_window(s, refusing, 120, 70))
    for ns in turns:
        want = plain_window(turns[ns], 120, 70)
        own = sorted((r for r in got if r.namespace == ns), key=lambda r: (r.first_turn, r.event))
        assert [(r.first_turn, r.last_turn, r.n_turns, r.tokens) for r in own if r.event == "evicted"] == want and len(want) > 5
        done = [r for r in own if r.event != "evicted"]
        assert [(r.first_turn, r.last_turn, r.n_turns, r.tokens) for r in done] == want
        assert {r.event for r in done} == {"extracted" if ns == "good" else "dropped"}
        assert done[-1].dropped_turns == (0 if ns == "good" else sum(w[2] for w in want))
    assert [r.text for r in sorted(got, key=lambda r: r.first_turn) if r.event == "extracted"][0] == "USER: good 1"


def test_a_full_buffer_loses_its_oldest_turns_and_timers_empty_it(spark, tmp_path):
    path = f"file://{tmp_path}"
    rows = [("n", i, "user", f"t{i}", 10) for i in range(1, 31)]
    spark.createDataFrame(rows, TURN).coalesce(1).write.parquet(f"{path}/in")
    schema = spark.createDataFrame([], TURN).schema
    with stateful.rocksdb(spark):
        out = stateful.live_window(spark.readStream.schema(schema).parquet(f"{path}/in"), refusing, 50, 30, buffer_turns=5, deferred_ms=1)
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{path}/log").trigger(processingTime="200 milliseconds").start(f"{path}/out")
        got, until = [], time.time() + 90
        while not any(r.event == "extracted" for r in got) and time.time() < until:
            time.sleep(0.5)
            assert q.exception() is None
            got = spark.read.schema(out.schema).parquet(f"{path}/out").collect() if list(tmp_path.glob("out/*.parquet")) else []
        q.stop()
    evicted = sum(r.n_turns for r in got if r.event == "evicted")
    lost = [r for r in got if r.event == "overflowed"]
    (done,) = [r for r in got if r.event == "extracted"]
    assert evicted == 27 and sum(r.n_turns for r in lost) == 22 and max(r.dropped_turns for r in lost) == 22
    assert (done.first_turn, done.last_turn, done.dropped_turns) == (23, 27, 22)


@pytest.mark.parametrize("n", [0, 1])
def test_a_window_of_nearly_nothing(spark, tmp_path, n):
    path = f"file://{tmp_path}"
    spark.createDataFrame([("n", 1, "user", "x", 999)][:n], TURN).coalesce(1).write.parquet(f"{path}/in")
    got = run_all(spark, path, spark.createDataFrame([], TURN).schema, lambda s: stateful.live_window(s, refusing, 10, 5))
    assert got == []
