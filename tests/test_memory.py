"""Graph, retrieval, assembly, sources and streams on small rows."""

from pyspark.sql import functions as F

from recollect.functions import text as X
from recollect.operators import assembly, compaction, evaluate, graph, identity, ledger, retrieval, wiki
from recollect.schemas import EDGE, FACT, NODE, STATE, SUMMARY, TURN, conforming
from recollect.sources import dataset, state


def rows(spark, schema, data):
    return conforming(spark.createDataFrame(data), schema)


def fact(n, text, turn, key=None, value=None, status="active"):
    return {"namespace": "n", "seq": n, "kind": "entity", "text": text, "source_turn_id": turn, "status": status, "slot_key": key or "", "slot_value": value or ""}


def test_graph_closes_keeps_and_answers_both_timelines(spark):
    e = rows(spark, EDGE, [{"seq": i, "subject_id": "s", "relation": "lives in", "object_literal": o, "valid_from": float(v), "ingested_at": float(g)} for i, o, v, g in [(1, "Rome", 10, 100), (2, "Rome", 11, 101), (3, "Oslo", 20, 200)]])
    out = graph.superseded(e)
    assert {(r.seq, r.valid_to, r.invalidated_at) for r in out.collect()} == {(1, 20.0, 200.0), (3, None, None)}
    names = lambda d: [r.object_literal for r in d.collect()]
    assert names(graph.true_at(out, 15.0)) == ["Rome"] and names(graph.true_at(out, 20.0)) == ["Oslo"]
    assert names(graph.believed_at(out, 150.0)) == ["Rome"] and names(graph.current(out)) == ["Oslo"]
    nodes = rows(spark, NODE, [{"id": "s", "seq": 1, "label": "Ada"}])
    assert graph.edge_lines(graph.current(out), nodes).first().line == "Ada lives in Oslo (since 1970-01)"


def corpus(spark):
    facts = [fact(1, "The zebra budget is 900 euros", 2)] + [fact(10 + i, f"Unrelated remark number {i} about weather", 100 + i) for i in range(30)]
    f = rows(spark, FACT, facts)
    s = rows(spark, SUMMARY, [{"namespace": "n", "seq": i, "covers_turn_ids": [200 + i], "text": f"Weather talk {i}", "created_at": 0.0} for i in range(20)])
    t = rows(spark, TURN, [{"namespace": "n", "turn_id": 300, "role": "user", "content": "What is the zebra budget?", "tokens": 6}])
    q = spark.createDataFrame([("q", "n", "What is the zebra budget?", 1000)], "query_id string, namespace string, query string, budget_tokens bigint")
    return q, f, s, t


def test_sparse_finds_the_one_relevant_fact(spark):
    got = retrieval.sparse_selection(*corpus(spark)).collect()
    assert [(r.kind, r.item_seq) for r in got] == [("entry", 1)]


def test_lexical_fills_the_budget_and_stays_in_it(spark):
    q, f, s, t = corpus(spark)
    got = retrieval.lexical_selection(q, f, s, t).collect()
    left = retrieval.available_budget(q, t).first().available
    assert 1 in [r.item_seq for r in got if r.kind == "entry"] and sum(r.cost for r in got) <= left


def test_skip_fit_takes_later_items_that_fit(spark):
    df = spark.createDataFrame([("q", i, c, 10) for i, c in enumerate([6, 7, 4, 1])], "query_id string, n int, cost bigint, available bigint")
    assert sorted(r.n for r in retrieval.skip_fit(df, [F.col("n")]).collect()) == [0, 2]


def test_truncation_stops_at_the_first_that_does_not_fit(spark):
    t = rows(spark, TURN, [{"namespace": "n", "turn_id": i, "role": "u", "content": "x" * n} for i, n in [(1, 1), (2, 400), (3, 5)]])
    assert [r.turn_id for r in retrieval.truncate_fit(t, 50).collect()] == [3]


def test_quarantine_and_filtered_summaries(spark):
    f = rows(spark, FACT, [fact(1, "The port is 8000.", 1, "infra.port", "8000", "stale"), fact(2, "The port is 9000.", 5, "infra.port", "9000")])
    s = rows(spark, SUMMARY, [{"namespace": "n", "seq": 1, "covers_turn_ids": [1, 2], "text": "Set port to 8000. They met.", "created_at": 0.0, "session_ids": ["a"], "start_ts": "d1", "end_ts": "d1"}])
    t = rows(spark, TURN, [{"namespace": "n", "turn_id": 9, "role": "user", "content": "hello"}])
    assert {(r.slot_key, r.slot_value) for r in assembly.quarantined(f, s, t).collect()} == {("infra.port", "8000")}
    names = spark.createDataFrame([("n", "sys", "task")], "namespace string, system string, task string")
    prompt = assembly.assembled(names, f, s, t).first()
    assert prompt.prompt == "=== SYSTEM ===\nsys\n\n=== TASK ===\ntask\n\n=== EPISODIC SUMMARIES ===\n- [Sessions a; Timestamp d1] They met.\n\n=== FACTS LEDGER ===\nFacts Ledger:\n- [entity] The port is 9000. (Turn 5)\n\n=== VERBATIM TRANSCRIPT ===\nUSER: hello"
    assert not prompt.overflow and assembly.assembled(names, f, s, t, max_tokens=3).first().overflow


def test_recent_turn_hides_an_outdated_fact(spark):
    f = rows(spark, FACT, [fact(1, "The port is 8000.", 1, "infra.port", "8000")])
    t = rows(spark, TURN, [{"namespace": "n", "turn_id": 4, "role": "user", "content": "Set port to 9000"}])
    assert assembly.shown_facts(f, rows(spark, SUMMARY, [{"namespace": "n", "seq": 1, "text": ""}]).limit(0), t).count() == 0


def test_compaction_loop_stops_at_the_trigger(spark):
    t = rows(spark, TURN, [{"namespace": "n", "turn_id": i, "role": "u", "content": "x", "tokens": 100} for i in range(1, 11)])
    out = {r.turn_id: r.compaction for r in compaction.compacted(t, 500, 3, 2).collect()}
    assert [out[i] for i in range(1, 11)] == [1, 1, 1, 2, 2, 2, None, None, None, None]


def test_new_messages(spark):
    def new(stored, incoming):
        turns = spark.createDataFrame([("n", i, "user", c) for i, c in enumerate(stored)], "namespace string, turn_id long, role string, content string")
        view = spark.createDataFrame([("n", i, "user", c) for i, c in enumerate(incoming)], "namespace string, arrival long, role string, content string")
        return "".join(r.content for r in sorted(compaction.new_messages(view, turns).collect(), key=lambda r: r.arrival))

    for stored, incoming, want in [("ab", "abc", "c"), ("ab", "bc", "c"), ("", "a", "a"), ("a", "c", "c"), ("ab", "ab", ""), ("aa", "aaa", ""), ("abc", "zbcd", "zbcd"), ("bc", "abcd", "d")]:
        assert new(stored, incoming) == want, (stored, incoming)


def test_wiki(spark):
    files = spark.createDataFrame([("w/good.md", "---\ntitle: a\ncreated: 1\nupdated: 2\n---\n[[good]]"), ("w/Bad.md", "x")], "path string, content string")
    assert {(r.path, r.rule) for r in wiki.violations(files).collect()} == {("w/Bad.md", "naming"), ("w/Bad.md", "frontmatter")}


def test_state_documents_read_back(spark, tmp_path):
    facts = rows(spark, FACT, [fact(0, "x", 1, "k", "v")])
    turns = rows(spark, TURN, [{"namespace": "n", "turn_id": 2, "role": "user", "content": "hi", "tokens": 1}])
    doc = state.documents_of(turns, rows(spark, SUMMARY, [{"namespace": "n", "seq": 0, "covers_turn_ids": [1], "text": "s", "created_at": 1.5}]), facts)
    (tmp_path / "n_state.json").write_text(doc.drop("namespace").toJSON().first())
    back = state.read_documents(spark, str(tmp_path))
    assert state.facts_of(back).first().text == "x" and state.turns_of(back).first().content == "hi" and state.summaries_of(back).first().namespace == "n"
    assert len(STATE) == 4
    (tmp_path / "n_state.json").write_text('{"schema_version": 99}')
    try:
        state.turns_of(state.read_documents(spark, str(tmp_path))).collect()
        raise AssertionError("a newer version was read")
    except Exception as e:  # noqa: BLE001
        assert "newer schema version" in str(e)


def test_episode_export_skips_known_pages(spark, tmp_path):
    s = rows(spark, SUMMARY, [{"namespace": "n", "seq": 0, "covers_turn_ids": [3, 1], "text": "s", "created_at": 1.5}, {"namespace": "n", "seq": 1, "covers_turn_ids": [], "text": "none", "created_at": 1.5}])
    path = f"file://{tmp_path}/pages"
    state.export_episodes(s, path)
    state.export_episodes(s, path)
    got = spark.read.parquet(path).collect()
    assert [r.name for r in got] == ["episode_1_3.md"] and got[0].content.endswith("---\n\ns\n")


def test_dataset_checks_alignment(spark):
    ok = spark.createDataFrame([("q", "knowledge-update", "?", "a", ["s0", "s1", "s2"], [[("user", "x")], [("user", "y")], [("user", "z")]], None, ["s1"])], dataset.ENTRY)
    assert dataset.knowledge_updates(ok).first().gold_recency == 0.5
    assert [r.session_id for r in dataset.turns(dataset.knowledge_updates(ok)).filter("is_gold").collect()] == ["s1"]
    bad = spark.createDataFrame([("q", "knowledge-update", "?", "a", ["s0", "s1"], [[("user", "x")]], None, [])], dataset.ENTRY)
    try:
        dataset.sessions(dataset.knowledge_updates(bad)).collect()
        raise AssertionError("misaligned sessions were read")
    except Exception as e:  # noqa: BLE001
        assert "do not align" in str(e)


def test_values_are_held_at_word_borders(spark):
    df = spark.createDataFrame([("port 80 is", "80", True), ("port 8080", "80", False), ("a_80", "80", False), ("C++ it is", "C++", True)], "t string, v string, want boolean")
    assert all(r.want == r.got for r in df.withColumn("got", X.holds_value(F.col("t"), F.col("v"))).collect())


def test_cosine_of_zero_is_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<float>, b array<float>")
    assert [r.c for r in df.select(identity.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.0, 1.0]


def test_promotion_needs_three_more_wins(spark):
    def arm(good):
        return spark.createDataFrame([(str(i), 100, "c", i in good, 10, 5.0, False, False) for i in range(6)], "question_id string, budget_tokens int, category string, judged_correct boolean, memory_tokens int, read_latency_ms double, context_overflow boolean, provenance_lost boolean")

    assert evaluate.promotion(arm({0}), arm({0, 1, 2, 3})).first().promote
    assert not evaluate.promotion(arm({0}), arm({1, 2, 3})).first().promote


def test_source_references_leave_out_missing_fields(spark):
    f = rows(spark, FACT, [fact(1, "x", 1)])
    none = rows(spark, SUMMARY, [{"namespace": "n", "seq": 1, "text": ""}]).limit(0)
    got = retrieval.source_references(f, none, rows(spark, TURN, [{"namespace": "n", "turn_id": 1, "role": "u", "content": "x"}])).collect()
    assert {r.kind: r.metadata for r in got} == {"fact": {"status": "active"}, "turn": {}}


def test_unknown_slots_do_not_suppress(spark):
    f = rows(spark, FACT, [fact(1, "x", 1), fact(2, "y", 2, "k", "v")])
    hidden = spark.createDataFrame([("n", "k")], "namespace string, slot_key string")
    assert [r.seq for r in ledger.without_slots(f, hidden).collect()] == [1]
