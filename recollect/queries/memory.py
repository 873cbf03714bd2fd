"""Queries of tiers, compaction, sources and streams, over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions import constants as C
from recollect.operators import assembly, compaction, evaluate, ledger, repair
from recollect.queries.views import LEDGER, TURNS
from recollect.registry import query
from recollect.schemas import SUMMARY, conforming, facts_of_events, table, turns_of_conversations
from recollect.sources import dataset, state
from recollect.sources.scratch import scratch_path

NS = "namespace"


@query(f"with {TURNS} select namespace, sum(tokens)::bigint as tokens from turns group by namespace having sum(tokens) > 500")
def compaction_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF9: conversations with more tokens than the trigger."""
    return compaction.due(turns_of_conversations(spark, sf_dir), 500)


@query(f"with {TURNS} select namespace, turn_id from (select *, count(*) over (partition by namespace) as n, row_number() over (partition by namespace order by turn_id) as place from turns) where place <= least(3, n - 2)")
def compaction_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest span."""
    return compaction.span(turns_of_conversations(spark, sf_dir), 3, 2).select(NS, "turn_id")


@query(f"with {TURNS} select namespace, turn_id from (select *, row_number() over (partition by namespace order by turn_id desc) as back from turns) where back <= 2")
def compaction_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest turns, which stay."""
    return compaction.protected(turns_of_conversations(spark, sf_dir), 2).select(NS, "turn_id")


@query(f"with {TURNS} select namespace, sha256(string_agg('Turn ' || turn_id || ' [Session ' || session_id || '] - ' || upper(role) || ': ' || content, chr(10) order by turn_id)) as text_sha256 from turns group by namespace")
def compaction_conversation_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as numbered lines."""
    return compaction.conversation_text(turns_of_conversations(spark, sf_dir)).select(NS, F.sha2("text", 256).alias("text_sha256"))


@query(f"with {TURNS} select namespace, list(turn_id order by turn_id) as covers_turn_ids, list(distinct session_id order by session_id) as session_ids from (select *, count(*) over (partition by namespace) as n, row_number() over (partition by namespace order by turn_id) as place from turns) where place <= least(6, n - 2) group by namespace")
def compaction_summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U4: a span's ids and sessions as a summary has them."""
    spans = compaction.span(turns_of_conversations(spark, sf_dir), 6, 2)
    return compaction.span_summary(spans, lambda text: F.substring(text, 1, 100)).select(NS, "covers_turn_ids", "session_ids")


@query(f"with {TURNS}, old as (select namespace, max(turn_id) as last_turn from turns where turn_id <= 4 group by namespace), m as (select namespace, turn_id as arrival from turns where turn_id > 4) select m.namespace, arrival, coalesce(last_turn, 0) + row_number() over (partition by m.namespace order by arrival) as turn_id from m left join old using (namespace)")
def ingest_turn_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of new turns."""
    turns = turns_of_conversations(spark, sf_dir)
    new = turns.filter("turn_id > 4").select(NS, F.col("turn_id").alias("arrival"))
    none = spark.createDataFrame([], SUMMARY)
    return compaction.next_turn_ids(new, turns.filter("turn_id <= 4"), none)


@query(f"with {TURNS} select namespace, turn_id, role from turns where turn_id > 3")
def ingest_new_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is new in a client's view from the second turn on, when three turns are stored."""
    turns = turns_of_conversations(spark, sf_dir)
    view = turns.filter("turn_id > 1").select(NS, F.col("turn_id").alias("arrival"), "role", "content")
    return compaction.new_messages(view, turns.filter("turn_id <= 3")).select(NS, F.col("arrival").alias("turn_id"), "role")


@query(f"with {TURNS} select namespace, turn_id from turns t where not exists (select 1 from turns d where d.namespace = t.namespace and d.turn_id = t.turn_id and d.turn_id % 3 = 0)")
def compaction_concurrent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns without those that were compacted meanwhile."""
    turns = turns_of_conversations(spark, sf_dir)
    return compaction.without_done(turns, turns.filter("turn_id % 3 = 0")).select(NS, "turn_id")


@query()
def compaction_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3, ST5: in which compaction each turn leaves."""
    return compaction.compacted(turns_of_conversations(spark, sf_dir), 300, 2, 2)


@query(f"with {TURNS} select namespace, turn_id, role, tokens from turns")
def state_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1, SNK1: states written as JSON documents and read back."""
    turns = turns_of_conversations(spark, sf_dir)
    facts = facts_of_events(spark, sf_dir).limit(0)
    path = scratch_path(spark, "states")
    state.write_documents(state.documents_of(turns, spark.createDataFrame([], SUMMARY), facts), path)
    back = state.read_written(spark, path)
    return state.turns_of(back).select(NS, "turn_id", "role", "tokens")


@query(f"with {TURNS} select namespace, 'episode_' || min(turn_id) || '_' || max(turn_id) || '.md' as name from turns group by namespace")
def state_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2: pages that summaries are exported as."""
    spans = compaction.span_summary(turns_of_conversations(spark, sf_dir), lambda text: text)
    rows = conforming(spans.withColumn("seq", F.lit(0)).withColumn("created_at", F.lit(0.0)), SUMMARY)
    return state.episodes(rows).select(NS, "name")


@query(f"with {LEDGER} select namespace, seq, json_object('slot_key', slot_key, 'slot_value', slot_value)::varchar as json from newest")
def state_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK3: rows as JSON."""
    own = ledger.newest_per_slot(ledger.closed_form(facts_of_events(spark, sf_dir)))
    return own.select(NS, "seq", F.to_json(F.struct("slot_key", "slot_value")).alias("json"))


@query("select page_id, sha256(html) as sha256 from pages")
def state_content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK5."""
    return table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("sha256"))


_MANIFEST = "m as (select doc_id::varchar as question_id, text as question, source as answer, lang || '_state.json' as state_file, n_chars from documents)"


@query(f"with {_MANIFEST} select question_id, sha256(question) as question, answer, state_file from m where question_id in (select doc_id::varchar from labels) and state_file in ('en_state.json', 'de_state.json')")
def state_selected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4, J4: records by id and existing file."""
    d = table(spark, sf_dir, "documents")
    manifest = d.select(F.col("doc_id").cast("string").alias("question_id"), F.sha2("text", 256).alias("question"), F.col("source").alias("answer"), F.concat("lang", F.lit("_state.json")).alias("state_file"))
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("question_id"))
    files = spark.createDataFrame([("en_state.json",), ("de_state.json",)], "state_file string")
    return state.selected_records(manifest, ids, files)


@query("select question_id, gold_recency from (select doc_id::varchar as question_id, quality::double as gold_recency from labels where doc_id not in (select doc_id from labels where toxic = 1) union all select doc_id::varchar, 2.0 from labels where toxic = 1)")
def state_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK4: records replaced by key."""
    own = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("question_id"), F.col("quality").cast("double").alias("gold_recency"), "toxic")
    return state.upserted(own.select("question_id", "gold_recency"), own.filter("toxic = 1").select("question_id", F.lit(2.0).alias("gold_recency")))


@query("select doc_id % 50 as k, max(doc_id) as doc_id from documents group by all")
def state_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC5: of records with equal keys the last."""
    own = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("k"), "doc_id")
    return state.indexed(own, "k", "doc_id")


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as dataset entries: two turns a session, the second session is gold."""
    t = table(spark, sf_dir, "conversations").withColumn("s", F.floor(F.col("turn") / 2).cast("int"))
    sessions = t.groupBy("conv_id", "s").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("turns"))
    lists = sessions.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("s", "turns"))).alias("o"))
    names = F.transform("o", lambda x: F.concat(F.lit("s"), x["s"].cast("string")))
    kind = F.when(F.col("conv_id") % 3 == 0, "knowledge-update").when(F.col("conv_id") % 3 == 1, "temporal-reasoning").otherwise("multi-session")
    return lists.select(F.col("conv_id").cast("string").alias("question_id"), kind.alias("question_type"), F.lit("what").alias("question"), F.lit("that").alias("answer"), names.alias("haystack_session_ids"), F.transform("o", lambda x: x["turns"]).alias("haystack_sessions"), F.lit(None).cast("array<string>").alias("haystack_dates"), F.array(F.lit("s1")).alias("answer_session_ids"))


_ENTRIES = "s as (select conv_id, turn // 2 as s, count(*) as n from conversations group by all), i as (select conv_id, max(s) + 1 as n_sessions, count(*) filter (where s = 1) as has_gold from s group by conv_id), e as (select conv_id::varchar as question_id, case when conv_id % 3 = 0 then 'knowledge-update' when conv_id % 3 = 1 then 'temporal-reasoning' else 'multi-session' end as question_type, n_sessions, case when has_gold = 0 or n_sessions <= 1 then 1.0 else 1.0 / (n_sessions - 1) end::double as gold_recency from i)"


@query(f"with {_ENTRIES} select question_id, question_type, gold_recency from e where question_type in ('knowledge-update', 'multi-session') and gold_recency <= 0.5")
def dataset_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2, A41, PF10: items of two categories with old evidence."""
    return dataset.items(_entries(spark, sf_dir), ["knowledge-update", "multi-session"], max_gold_recency=0.5).select("question_id", "question_type", "gold_recency")


@query(f"with {_ENTRIES} select question_id, gold_recency from e where question_type = 'knowledge-update'")
def dataset_knowledge_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC3."""
    return dataset.knowledge_updates(_entries(spark, sf_dir)).select("question_id", "gold_recency")


@query("select conv_id::varchar as question_id, 's' || (turn // 2) as session_id, (turn // 2)::int as place, (turn % 2)::int as turn, upper(role) || ': ' || text as line, turn // 2 = 1 as is_gold from conversations")
def dataset_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF1: sessions flattened in order."""
    kinds = ["knowledge-update", "temporal-reasoning", "multi-session"]
    return dataset.turns(dataset.items(_entries(spark, sf_dir), kinds)).select("question_id", "session_id", "place", "turn", F.concat(F.upper("role"), F.lit(": "), "content").alias("line"), "is_gold")


@query("select conv_id::varchar as question_id, sha256(string_agg(upper(role) || ': ' || text, chr(10) order by turn)) as text_sha256 from conversations where turn // 2 = 1 group by conv_id")
def dataset_gold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of gold sessions."""
    kinds = ["knowledge-update", "temporal-reasoning", "multi-session"]
    return dataset.gold_text(dataset.items(_entries(spark, sf_dir), kinds)).select("question_id", F.sha2("text", 256).alias("text_sha256"))


@query(f"with {_ENTRIES} select question_id, question_type as category, place from (select *, row_number() over (partition by question_type order by gold_recency, question_id) as place from e) where place <= 3")
def dataset_balanced_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three items of each category."""
    kinds = ["knowledge-update", "temporal-reasoning", "multi-session"]
    found = dataset.items(_entries(spark, sf_dir), kinds).withColumnRenamed("question_type", "category")
    return evaluate.balanced_manifest(found, 3).select("question_id", "category", "place")


@query("select conv_id::varchar as question_id, [list(turn + 1 order by turn)] as groups from conversations where turn // 2 = 1 group by conv_id")
def dataset_gold_turn_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of gold turns by session."""
    kinds = ["knowledge-update", "temporal-reasoning", "multi-session"]
    return evaluate.gold_turn_groups(dataset.sessions(dataset.items(_entries(spark, sf_dir), kinds)))


@query("with g as (select conv_id::varchar as question_id, list(turn + 1) as gold from conversations where turn // 2 = 1 group by conv_id), o as (select conv_id::varchar as question_id, list(turn + 1) as seen from conversations where turn % 3 = 0 group by conv_id) select question_id, list_has_any(gold, seen) as covered from g join o using (question_id)")
def dataset_source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether observed turns meet every gold group."""
    seen = table(spark, sf_dir, "conversations").filter("turn % 3 = 0").groupBy(F.col("conv_id").cast("string").alias("question_id")).agg(F.collect_list(F.col("turn") + 1).alias("seen"))
    return dataset_gold_turn_groups(spark, sf_dir).join(seen, "question_id").select("question_id", evaluate.covers_sources(F.col("groups"), F.col("seen")).alias("covered"))


@query(f"with {TURNS} select namespace, list(struct_pack(role := role, n := length(content)) order by turn_id)::varchar as said from turns group by namespace")
def assembly_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request's messages; here those after the system message."""
    turns = turns_of_conversations(spark, sf_dir)
    prompts = turns.select(NS).distinct().withColumn("prompt", F.lit("=== SYSTEM ===\nx"))
    out = assembly.messages(prompts, turns)
    said = F.transform(F.slice("messages", F.lit(2), F.size("messages")), lambda m: F.concat(F.lit("{'role': "), m["role"], F.lit(", 'n': "), F.length(m["content"]).cast("string"), F.lit("}")))
    return out.select(NS, F.concat(F.lit("["), F.array_join(said, ", "), F.lit("]")).alias("said"))


@query(f"with {TURNS}, r as (select namespace, string_agg(upper(role) || ': ' || content, chr(10) order by turn_id) as body from turns group by namespace) select namespace, 'VERBATIM TRANSCRIPT' as section, greatest(1, length('=== VERBATIM TRANSCRIPT ===' || chr(10) || body) // 4)::bigint as tokens from r union all select namespace, 'SYSTEM', greatest(1, length('=== SYSTEM ===' || chr(10) || 'x' || chr(10) || chr(10)) // 4) from r union all select namespace, 'TASK', greatest(1, length('=== TASK ===' || chr(10) || 'y' || chr(10) || chr(10)) // 4) from r")
def assembly_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a prompt by section."""
    turns = turns_of_conversations(spark, sf_dir)
    names = turns.select(NS).distinct().select(NS, F.lit("x").alias("system"), F.lit("y").alias("task"))
    empty = facts_of_events(spark, sf_dir).limit(0)
    prompts = assembly.assembled(names, empty, spark.createDataFrame([], SUMMARY), turns)
    return assembly.section_tokens(prompts).select(NS, "section", "tokens")


@query(f"with {TURNS}, i as (select namespace, 2 + turn_id % 2 as tier, turn_id, tokens as cost from turns), r as (select *, sum(cost) over (partition by namespace) as total, coalesce(sum(cost) over (partition by namespace order by tier desc, turn_id rows between unbounded preceding and 1 preceding), 0) as before from i) select namespace, tier, turn_id from r where total - before <= 200")
def assembly_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest items dropped until the rest fits."""
    items = turns_of_conversations(spark, sf_dir).select(NS, (2 + F.col("turn_id") % 2).alias("tier"), "turn_id", F.col("turn_id").alias("item_seq"), F.col("tokens").alias("cost"))
    return assembly.trimmed(items, 200).select(NS, "tier", "turn_id")


RAW = [
    (1, '```json\n[{"kind": "decision", "text": "Deploy it", "source_turn_id": 1}]\n```'),
    (2, '[{"kind": "entity", "text": "node nine is it", "source_turn_id": 5}, {"kind": "number"'),
    (3, '{"text": "a b", "source_turn_id": 3}\n\n{"text": "c d", "source_turn_id": 5}'),
    (4, "[" + ", ".join(['{"kind": "number", "text": "The threshold is 0.83", "source_turn_id": 7}'] * 6) + "]"),
    (5, "no JSON at all"),
    (6, '[{"subject": "team", "attribute": "size", "value": 5, "source_turn_id": "Turn 3"}]'),
]


def _responses(spark: SparkSession) -> DataFrame:
    rows = [("r", n, raw, [(i, f"turn {i}") for i in range(1, 8)]) for n, raw in RAW]
    return spark.createDataFrame(rows, "namespace string, call_id bigint, raw string, turns array<struct<turn_id: bigint, content: string>>")


@query()
def repair_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of damaged responses."""
    return repair.extracted(_responses(spark)).select("call_id", F.size("facts").alias("n_facts"), F.element_at("flags", F.lit("success")).alias("success"), F.element_at("flags", F.lit("loop_detected")).alias("loop_detected"), "error")


@query()
def repair_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags counted."""
    return repair.extraction_telemetry(repair.extracted(_responses(spark)))


@query()
def repair_general_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID4: sentences of conversations as subject, attribute and value."""
    one = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return one.withColumn("fact", repair.general_fact("text")).select("item_id", "fact.*")


@query(
    """with j as (select conv_id, string_agg(text || ' which states the value text again', ' ' order by turn) as text from conversations group by conv_id),
w as (select conv_id::varchar as namespace, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') as words from j), g as (select namespace, array_to_string(words[i:i + 3], ' ') as gram from (select namespace, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as i from w where len(words) > 12))
select namespace, gram, count(*) as times from g where length(gram) > 20 and regexp_matches(gram, 'subject|value|text') group by all having count(*) >= 3"""
)
def repair_repeated_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four words with a key word that come three times or more, in whole conversations whose turns end alike."""
    turn = F.struct("turn", F.concat("text", F.lit(" which states the value text again")).alias("said"))
    whole = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias(NS)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda t: t["said"]), " ").alias("text"))
    return repair.repeated_ngrams(whole)


@query()
def repair_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-call responses of facts and a summary."""
    rows = [("a", '{"facts": [{"text": "x"}], "summary": " fine "}'), ("b", '{"facts": []}'), ("c", "```json\n{\"facts\": [], \"summary\": \"s\"}\n```"), ("d", "nothing")]
    return repair.card(spark.createDataFrame(rows, "namespace string, raw string"))


@query("select conv_id::varchar as namespace, min(turn) as place, role from conversations group by conv_id, role")
def repair_kept_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal slots the first."""
    items = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias(NS), F.col("turn").alias("place"), F.lit("speaker").alias("subject"), F.col("role").alias("attribute"), F.lit("").alias("raw"))
    return repair.kept_first(items).select(NS, "place", F.col("attribute").alias("role"))


def _stream(spark: SparkSession, df: DataFrame, run, mode: str = "append") -> DataFrame:
    """df written in files, streamed through run, and what it gave as a table."""
    at = scratch_path(spark, "stream")
    df.write.mode("overwrite").parquet(f"{at}/in")
    out = run(spark.readStream.schema(df.schema).parquet(f"{at}/in"))
    q = out.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start(f"{at}/out")
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


@query(f"with {TURNS} select namespace, turn_id, role, tokens from (select namespace, row_number() over (partition by namespace order by turn_id) as turn_id, role, tokens from turns)")
def stream_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, ST2: turns ingested once, from a stream with replayed messages."""
    from recollect.streaming import memory

    own = turns_of_conversations(spark, sf_dir).select(NS, F.col("turn_id").alias("arrival_seq"), "role", "content")
    return _stream(spark, own.unionByName(own.filter("arrival_seq % 2 = 0")), memory.ingested).select(NS, "turn_id", "role", "tokens")


@query()
def stream_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3, ST4: summaries of spans as a stream compacts its conversations."""
    from recollect.streaming import memory

    own = turns_of_conversations(spark, sf_dir).select(NS, "turn_id", "role", "content", "tokens")
    return _stream(spark, own, lambda s: memory.compacting(s, lambda text: text.split("\n")[0][:80], 300, 2, 2)).select(NS, "event", "turn_ids", "tokens")


@query(f"with {LEDGER} select namespace, slot_key, slot_value, source_turn_id from ledger where status = 'active'")
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 on a stream: current facts after all batches."""
    from recollect.streaming import memory

    own = facts_of_events(spark, sf_dir).select(NS, "seq", "text", "source_turn_id", "slot_key", "slot_value")
    changes = _stream(spark, own, lambda s: memory.superseding(s, C.REPLAY_MAX_STALE))
    last = changes.withColumn("r", F.row_number().over(W.partitionBy(NS, "source_turn_id").orderBy(F.col("event").desc())))
    return last.filter("r = 1 and event = 'active'").select(NS, "slot_key", "slot_value", "source_turn_id")

