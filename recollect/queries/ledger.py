"""Queries of the facts ledger, over events as slot observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions import constants as C
from recollect.functions import text as X
from recollect.operators import assembly, evaluate, families, identity, ledger
from recollect.providers import stub_embed
from recollect.queries.views import FACTS, LEDGER, TURNS
from recollect.registry import query
from recollect.schemas import SUMMARY, TURN, conforming, facts_of_events, turns_of_conversations
from recollect.sources.scratch import written

NS = "namespace"


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.closed_form(facts_of_events(spark, sf_dir))


@query(f"with {LEDGER} select namespace, seq, slot_key, slot_value, status, superseded_by_turn_id from ledger")
def ledger_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for each user, and which turn replaced the rest; irregular namespaces would go through the fold."""
    return ledger.supersede(facts_of_events(spark, sf_dir), C.REPLAY_MAX_STALE).select(NS, "seq", "slot_key", "slot_value", "status", "superseded_by_turn_id")


@query(f"with {LEDGER} select namespace, slot_key, count(*) as n_reextracted, count(distinct slot_value) as n_values from ledger where status = 'stale' and source_turn_id >= superseded_by_turn_id group by all")
def ledger_reextraction_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of values that were replaced before."""
    again = _ledger(spark, sf_dir).filter("status = 'stale' and source_turn_id >= superseded_by_turn_id")
    return again.groupBy(NS, "slot_key").agg(F.count("*").alias("n_reextracted"), F.countDistinct("slot_value").alias("n_values"))


@query(f"with {LEDGER} select namespace, status, count(*) as n, min(source_turn_id) as first_turn, max(source_turn_id) as last_turn from ledger group by all")
def ledger_status_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF3: active and stale facts."""
    own = _ledger(spark, sf_dir)
    both = own.filter("status = 'active'").unionByName(ledger.stale_entries(own))
    return both.groupBy(NS, "status").agg(F.count("*").alias("n"), F.min("source_turn_id").alias("first_turn"), F.max("source_turn_id").alias("last_turn"))


@query(f"with {LEDGER} select namespace, slot_key, slot_value, source_turn_id from newest")
def ledger_newest_per_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest active fact of each slot."""
    return ledger.newest_per_slot(_ledger(spark, sf_dir)).select(NS, "slot_key", "slot_value", "source_turn_id")


@query(f"with {LEDGER} select namespace, sum(n - 1)::bigint as suppressed from (select namespace, slot_key, count(*) as n from ledger where status = 'active' group by all) group by namespace")
def ledger_suppressed_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active facts that the newest of their slot hides."""
    return ledger.suppressed_duplicates(_ledger(spark, sf_dir)).select(NS, F.col("suppressed").cast("long").alias("suppressed"))


@query(f"with {LEDGER} select namespace, 'Facts Ledger:' || chr(10) || string_agg('- [entity] ' || text || ' (Turn ' || source_turn_id || ')', chr(10) order by seq) as rendered from newest group by namespace")
def ledger_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current ledger as text."""
    return ledger.rendered(ledger.newest_per_slot(_ledger(spark, sf_dir)))


@query(f"with {LEDGER} select namespace, slot_key, count(*) as n from ledger where slot_key not in ('user.click', 'user.error') group by all")
def ledger_without_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF4: facts of slots that are not to be shown left out."""
    own = _ledger(spark, sf_dir)
    hidden = own.select(NS).distinct().withColumn("slot_key", F.explode(F.array(F.lit("user.click"), F.lit("user.error"))))
    return ledger.without_slots(own, hidden).groupBy(NS, "slot_key").agg(F.count("*").alias("n"))


_RECENT = "recent as (select namespace, slot_key, source_turn_id as turn_id, slot_value from (select *, max(source_turn_id) over (partition by namespace) as last_turn from facts) where source_turn_id > last_turn - 5)"


@query(f"with {LEDGER}, {_RECENT} select namespace, seq, slot_key, slot_value from newest n where not exists (select 1 from recent r where r.namespace = n.namespace and r.slot_key = n.slot_key and r.turn_id > n.source_turn_id and r.slot_value <> n.slot_value)")
def ledger_without_outdated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF5: facts that a recent turn does not contradict."""
    own = facts_of_events(spark, sf_dir)
    last = F.max("source_turn_id").over(W.partitionBy(NS))
    recent = own.withColumn("last_turn", last).filter("source_turn_id > last_turn - 5").select(NS, "slot_key", F.col("source_turn_id").alias("turn_id"), "slot_value")
    return ledger.without_outdated(ledger.newest_per_slot(ledger.closed_form(own)), recent).select(NS, "seq", "slot_key", "slot_value")


_QUARANTINE = "quarantine as (select distinct l.namespace, l.slot_key, l.slot_value from ledger l join newest n using (namespace, slot_key) where n.source_turn_id > l.source_turn_id and n.slot_value <> l.slot_value)"


@query(f"with {LEDGER}, {_QUARANTINE} select * from quarantine")
def ledger_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a newer observation contradicts."""
    return assembly.quarantined(_ledger(spark, sf_dir), spark.createDataFrame([], SUMMARY), spark.createDataFrame([], TURN))


_PORTS = f"""{FACTS}, ports as (select namespace, seq, source_turn_id, slot_key, right(slot_value, 1) as port from facts where slot_key = 'user.click'),
latest as (select namespace, source_turn_id as newest_turn, port as newest_value from ports qualify row_number() over (partition by namespace order by source_turn_id desc, seq) = 1),
said as (select p.namespace, last_turn, regexp_extract(sentence, '(?i)\\bport\\s+(?:to\\s+|is\\s+)?(\\d+)\\b', 1) as slot_value from
  (select namespace, source_turn_id as last_turn, unnest(['The port is ' || port || '.', 'Nothing else changed.', 'PORT ' || (port::int + 1) || '!']) as sentence from ports where seq % 3 = 0) p)"""


@query(f"with {_PORTS} select distinct namespace, 'infra.port' as slot_key, slot_value from said join latest using (namespace) where slot_value <> '' and last_turn < newest_turn and slot_value <> newest_value")
def ledger_stale_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that sentences of older summaries give for a slot whose newest value is another."""
    own = facts_of_events(spark, sf_dir).filter("slot_key = 'user.click'").withColumn("slot_value", F.substring("slot_value", -1, 1)).withColumn("slot_key", F.lit("infra.port"))
    newest = own.withColumn("r", F.row_number().over(W.partitionBy(NS).orderBy(F.desc("source_turn_id"), "seq"))).filter("r = 1").drop("r")
    text = F.concat(F.lit("The port is "), F.col("slot_value"), F.lit(". Nothing else changed. PORT "), (F.col("slot_value").cast("int") + 1).cast("string"), F.lit("!"))
    summaries = own.filter("seq % 3 = 0").select(NS, "seq", F.array("source_turn_id").alias("covers_turn_ids"), text.alias("text"))
    return assembly.quarantined(newest, conforming(summaries, SUMMARY), spark.createDataFrame([], TURN))


@query(f"with {LEDGER}, {_QUARANTINE} select namespace, count(*) as n from ledger l where not exists (select 1 from quarantine q where q.namespace = l.namespace and q.slot_key = l.slot_key and q.slot_value = l.slot_value) group by namespace")
def ledger_without_quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF6: facts without quarantined values."""
    return ledger.without_quarantined(_ledger(spark, sf_dir), ledger_quarantine(spark, sf_dir)).groupBy(NS).agg(F.count("*").alias("n"))


@query(
    f"""with {FACTS}, k as (select *, 'k' || (seq % 7) || '.' || case seq % 3 when 0 then 'team size' when 1 then 'teams sizes' else 'size of the team' end as key from facts),
c as (select *, 'k' || (seq % 7) || ' size team' as canonical from k),
w as (select *, last_value(seq) over p as win_seq, last_value(source_turn_id) over p as win_turn from c window p as (partition by namespace, canonical order by source_turn_id, seq rows between unbounded preceding and unbounded following))
select namespace, seq, case when win_seq = seq then 'active' else 'stale' end as status, case when win_seq <> seq then win_turn end as superseded_by_turn_id from w"""
)
def ledger_recanonicalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys worded differently as one slot; the latest stays."""
    own = facts_of_events(spark, sf_dir)
    worded = F.when(F.col("seq") % 3 == 0, "team size").when(F.col("seq") % 3 == 1, "teams sizes").otherwise("size of the team")
    return ledger.recanonicalised(own.withColumn("slot_key", F.concat(F.lit("k"), (F.col("seq") % 7).cast("string"), F.lit("."), worded))).select(NS, "seq", "status", "superseded_by_turn_id")


@query(f"with {LEDGER} select namespace, seq, status from (select *, row_number() over (partition by namespace, status order by source_turn_id desc, seq desc) as r from ledger) where status <> 'stale' or r <= 10")
def ledger_evicted_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot with the newest ten stale facts."""
    return ledger.evicted(_ledger(spark, sf_dir)).select(NS, "seq", "status")


@query(f"with {FACTS}, {TURNS} select f.namespace, f.seq, t.session_id from facts f left join turns t on t.namespace = f.namespace and t.turn_id = f.source_turn_id")
def ledger_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session of each fact's source turn."""
    return ledger.with_provenance(facts_of_events(spark, sf_dir), turns_of_conversations(spark, sf_dir)).select(NS, "seq", "session_id")


@query(f"with {LEDGER} select * from (select namespace, lower(slot_value) as value, list_sort(list(distinct slot_key)) as slot_keys from newest group by namespace, lower(slot_value)) where len(slot_keys) > 1")
def audit_fragmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that stand under several keys."""
    return evaluate.fragmentation(ledger.newest_per_slot(_ledger(spark, sf_dir)))


_AUDIT = """
totals as (select namespace, count(*) as ledger_total from ledger group by namespace), actives as (select namespace, count(*) as ledger_active from newest group by namespace),
frags as (select namespace, count(*) as fragmented_values from (select namespace, lower(slot_value) as v, count(distinct slot_key) as n from newest group by all) where n > 1 group by namespace),
audit as (select namespace, ledger_total, coalesce(ledger_active, 0) as ledger_active, coalesce(fragmented_values, 0) as fragmented_values, ledger_total - coalesce(ledger_active, 0) as superseded,
  round((ledger_total - coalesce(ledger_active, 0)) / ledger_total, 4) as supersession_rate from totals left join actives using (namespace) left join frags using (namespace))
"""


@query(f"with {LEDGER}, {_AUDIT} select * from audit")
def audit_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger in numbers."""
    own = _ledger(spark, sf_dir)
    return evaluate.ledger_audit(own, ledger.newest_per_slot(own))


@query(
    f"""with {LEDGER} select namespace, canonical_key, list_sort(list(distinct slot_key)) as slot_keys, list_sort(list(distinct lower(slot_value))) as values, count(*) as n
from (select *, 'user' as canonical_key from newest) group by namespace, canonical_key having count(*) >= 2 and count(distinct lower(slot_value)) >= 2"""
)
def audit_merge_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would merge by subject alone."""
    return evaluate.merge_risks(ledger.newest_per_slot(_ledger(spark, sf_dir)), "subject").drop("turns")


_DELTA = """
canon as (select *, row_number() over (partition by namespace, ck order by source_turn_id desc, seq desc) as r from (select *, split_part(slot_key, '.', 1) as ck from newest)),
split_ as (select namespace, count(*) as n from (select namespace, lower(slot_value) from canon where r = 1 group by namespace, lower(slot_value) having count(distinct ck) > 1) group by namespace),
after_ as (select c.namespace, count(*) filter (c.r = 1)::bigint as ledger_active, coalesce(max(s.n), 0)::bigint as fragmented_values from canon c left join split_ s using (namespace) group by c.namespace),
d as (select a.namespace, a.ledger_active as active_before, b.ledger_active as active_after, a.ledger_active - b.ledger_active as active_reduction, round((a.ledger_active - b.ledger_active) / a.ledger_active, 4) as active_reduction_rate,
  a.fragmented_values - b.fragmented_values as fragmented_reduction, case when a.fragmented_values = 0 then 0.0 else round((a.fragmented_values - b.fragmented_values) / a.fragmented_values, 4) end::double as fragmented_reduction_rate from audit a join after_ b using (namespace))
"""


def _deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _ledger(spark, sf_dir)
    newest = ledger.newest_per_slot(own)
    merged = ledger.recanonicalised(newest, "subject")
    return evaluate.deltas(evaluate.ledger_audit(own, newest), evaluate.ledger_audit(merged, ledger.newest_per_slot(merged)))


@query(f"with {LEDGER}, {_AUDIT}, {_DELTA} select * from d")
def audit_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Before and after grouping by subject."""
    return _deltas(spark, sf_dir)


@query(f"with {LEDGER}, {_AUDIT}, {_DELTA} select sum(active_before)::bigint as active_before, sum(active_after)::bigint as active_after, round((sum(active_before) - sum(active_after)) / sum(active_before), 4) as active_reduction_rate, count(*) as n_states from d")
def audit_delta_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals over all namespaces."""
    return evaluate.delta_totals(_deltas(spark, sf_dir))


@query(f"with {LEDGER} select namespace, source_turn_id, slot_key, slot_value, status from ledger where regexp_matches(slot_key, '(click|error)')")
def ledger_concept_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF15: the history of slots that a pattern names."""
    return _ledger(spark, sf_dir).filter(F.col("slot_key").rlike("(click|error)")).select(NS, "source_turn_id", "slot_key", "slot_value", "status")


@query(
    f"""with {LEDGER} select namespace, count(*) as n_lines, list_sort(list(distinct slot_key)) as slot_keys, bool_or(status = 'stale') as any_stale from ledger
where regexp_matches('- [entity' || case when status = 'active' then '' else ' stale' end || '] ' || text || ' (Turn ' || source_turn_id || ')', 'purchase|stale') group by namespace"""
)
def ledger_keyword_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF16: rendered facts that a pattern finds, their keys, and whether one is stale."""
    hits = _ledger(spark, sf_dir).filter(ledger.line().rlike("purchase|stale"))
    return hits.groupBy(NS).agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_set("slot_key")).alias("slot_keys"), F.bool_or(F.col("status") == "stale").alias("any_stale"))


@query(
    f"""with {LEDGER}, needles as (select distinct namespace, 'event ' || min(event_id) over (partition by namespace) as needle from e union all select distinct namespace, 'nowhere' from e union all select distinct namespace, 'Episode of user ' || namespace from e)
select n.namespace, n.needle, case when exists (select 1 from ledger l where l.namespace = n.namespace and contains(lower(l.text), lower(n.needle))) then 'slot' when n.needle like 'Episode%' and n.namespace::bigint % 2 = 0 then 'summary' else 'absent' end as tier from needles n"""
)
def ledger_needle_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which tier a needle is found: in a fact, in a summary only, or nowhere."""
    own = _ledger(spark, sf_dir)
    first = own.groupBy(NS).agg(F.min(F.regexp_extract("text", r"event (\d+)", 1).cast("long")).alias("e")).select(NS, F.concat(F.lit("event "), F.col("e").cast("string")).alias("needle"))
    users = own.select(NS).distinct()
    needles = first.unionByName(users.withColumn("needle", F.lit("nowhere"))).unionByName(users.withColumn("needle", F.concat(F.lit("Episode of user "), NS)))
    summaries = users.filter(F.col(NS).cast("long") % 2 == 0).select(NS, F.concat(F.lit("An episode of user "), NS, F.lit(", told again.")).alias("text"))
    return evaluate.needle_tiers(needles, own, summaries)


@query()
def ledger_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with a cap of three stale facts, which only the fold gives."""
    return ledger.supersede(facts_of_events(spark, sf_dir), 3).select(NS, "seq", "slot_key", "slot_value", "status", "superseded_by_turn_id")


@query()
def ledger_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of odd turns merged into the ledger of even ones."""
    own = facts_of_events(spark, sf_dir)
    return ledger.merge(ledger.closed_form(own.filter("seq % 2 = 0")), own.filter("seq % 2 = 1"), C.REPLAY_MAX_STALE).select(NS, "seq", "slot_key", "slot_value", "status", "superseded_by_turn_id")


@query()
def ledger_replay_with_matcher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A replay in which similar full facts are one slot, by a deterministic stub embedding."""
    own = facts_of_events(spark, sf_dir)
    texts = [f"user {kind}: v{v}" for kind in ("click", "view", "purchase", "error", "signup", "login", "logout") for v in range(5)]
    vectors = dict(zip(texts, map(__import__("numpy").array, stub_embed()(texts)), strict=True))

    def same(a, b):
        text = lambda f: f"{(f.slot_key or '').replace('.', ' ')}: {f.slot_value}"
        return text(a) in vectors and text(b) in vectors and identity.matcher(vectors, 0.8)(a, b)

    return ledger.folded(own, C.REPLAY_MAX_STALE, same, reset=True).select(NS, "seq", "slot_key", "slot_value", "status")


@query()
def ledger_mapped_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one turn that has a fact's content words; facts are first sentences of the turns themselves."""
    turns = turns_of_conversations(spark, sf_dir)
    first = turns.withColumn("text", F.try_element_at(X.sentences(F.col("content")), F.lit(1))).filter("text is not null")
    return ledger.mapped_turns(first.select(NS, F.col("turn_id").alias("seq"), "text"), turns).select(NS, "seq", "mapped_turn")


@query()
def assembly_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of all users from their ledger, with tokens and overflow."""
    own = _ledger(spark, sf_dir)
    turns = turns_of_conversations(spark, sf_dir)
    from recollect.schemas import summaries_of_documents

    names = own.select(NS).distinct().select(NS, F.lit("You remember.").alias("system"), F.lit("Answer.").alias("task"))
    return assembly.assembled(names, own, summaries_of_documents(spark, sf_dir), turns).select(NS, "tokens", "overflow", F.sha2("prompt", 256).alias("prompt_sha256"))


_TWO_KEYS = f"""{FACTS}, two as (select namespace, seq, source_turn_id, split_part(slot_key, '.', 2) as event, split_part(slot_key, '.', 2) || case when seq % 2 = 0 then '.daily count' else '.count daily' end as slot_key, slot_value from facts),
before_ as (select * from (select *, row_number() over (partition by namespace, slot_key order by source_turn_id desc, seq desc) as r from two) where r = 1),
after_ as (select * from (select *, row_number() over (partition by namespace, event order by source_turn_id desc, seq desc) as r from two) where r = 1),
latest as (select namespace, arg_max(slot_value, source_turn_id) as needle from two group by namespace),
counted as (select (select count(*) from (select namespace, slot_value from before_ group by all having count(distinct slot_key) > 1)) as b, (select count(*) from (select namespace, slot_value from after_ group by all having count(distinct event) > 1)) as a,
  (select bool_and(exists (select 1 from after_ f where f.namespace = l.namespace and contains(f.slot_value, l.needle))) from latest l) as gold)"""


@query(f"with {_TWO_KEYS}, r as (select *, case when b > 0 then round((b - a) / b, 4) else 0.0 end as rate from counted) select b as fragmented_before, a as fragmented_after, gold as gold_preserved, true as sentinels_right, rate as reduction_rate, rate >= 0.3 as target_met, rate >= 0.3 and gold as go from r")
def audit_role_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a rekey by roles, here of keys that come in two wordings, is worth it and safe."""
    event = F.regexp_extract("slot_key", r"\.(.*)$", 1)
    two = facts_of_events(spark, sf_dir).withColumn("slot_key", F.concat(event, F.when(F.col("seq") % 2 == 0, ".daily count").otherwise(".count daily")))
    # All that is asked for are the newest facts of keys, of groups of keys and of users, so keys stand for facts from here on.
    at = F.struct("source_turn_id", "seq", "slot_value")
    keys = written(two.groupBy(NS, "slot_key").agg(F.min("seq").alias("first"), F.max(at).alias("at")), "keys")
    groups = families.grouped_by_role(keys.select(NS, F.col("first").alias("seq"), "slot_key"))
    named = written(keys.join(groups, [NS, "slot_key"]), "named")
    before = named.select(NS, "slot_key", "at.slot_value")
    after = named.groupBy(NS, F.col("role_group").alias("slot_key")).agg(F.max("at").alias("at")).select(NS, "slot_key", "at.slot_value")
    needles = keys.groupBy(NS).agg(F.max("at").alias("at")).select(NS, F.col("at.slot_value").alias("needle"))
    pairs = [("walk.start hour", "walk.end hour", False), ("budget.min sum", "budget.max sum", False), ("ann.height", "ben.height", False), ("team.size", "team size.size", True), ("goal.target level", "goal.level target", True)]
    sentinels = spark.createDataFrame(pairs, "a string, b string, expected boolean").select("expected", families.same_role(F.col("a"), F.col("b")).alias("found"))
    return evaluate.role_decision(before, after, needles, sentinels, 0.3)
