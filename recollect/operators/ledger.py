"""The facts ledger: supersession, merge, views and rendering.

``supersede`` answers without a fold where a closed form holds: within a namespace facts arrive in the order of turns,
no text comes twice and no more facts go stale than are kept. Then a value is stale as soon as another value of its
slot first appears after it first appeared, and that turn superseded it; facts without a value lose to any live one. Namespaces where this does not hold are found
by aggregates and go through the fold, one namespace a group.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions import constants as C
from recollect.functions import text as X
from recollect.operators.fold import Fact, Ledger
from recollect.schemas import FACT

NS = "namespace"


def has_slot() -> Column:
    return ~X.blank(F.col("slot_key")) & ~X.blank(F.col("slot_value"))


def derive_slots(facts: DataFrame) -> DataFrame:
    """Slot value, then slot key, where a fact lacks them: the model's value, a known slot's value; a known key in place of any, else one made of subject and attribute. Idempotent."""
    known = F.coalesce(X.slot_key(F.col("text")), X.slot_override(F.col("text")))
    value = F.coalesce(F.nullif("slot_value", F.lit("")), F.nullif("value", F.lit("")))
    own = F.when(~X.blank(F.col("subject")) & ~X.blank(F.col("attribute")), X.derived_key(F.col("subject"), F.col("attribute")))
    return facts.withColumns({"kind": X.kind_or_entity(F.col("kind")), "slot_value": F.coalesce(value, X.slot_value(known, F.col("text"))), "slot_key": F.coalesce(known, F.nullif("slot_key", F.lit("")), own)})


def closed_form(facts: DataFrame) -> DataFrame:
    """Status and superseding turn by the closed form; its preconditions are not checked here.

    A fact with a slot but no value loses to the first later one of its slot whose value has not gone stale by then."""
    at = F.struct("source_turn_id", "seq")
    first = facts.filter(has_slot()).groupBy(NS, "slot_key", "slot_value").agg(F.min(at).alias("first"))
    after = first.withColumn("next", F.lead("first").over(W.partitionBy(NS, "slot_key").orderBy("first"))).drop("first")
    keyed = facts.filter(~X.blank(F.col("slot_key"))).drop("status", "superseded_by_turn_id").join(after, [NS, "slot_key", "slot_value"], "left")
    live = has_slot() & (F.col("next").isNull() | (at < F.col("next")))
    later = W.partitionBy(NS, "slot_key").orderBy("source_turn_id", "seq").rowsBetween(1, W.unboundedFollowing)
    loses_to = F.when(has_slot(), F.col("next.source_turn_id")).otherwise(F.first(F.when(live, F.col("source_turn_id")), ignorenulls=True).over(later))
    judged = keyed.withColumn("superseded_by_turn_id", loses_to).withColumn("status", F.when(F.col("superseded_by_turn_id").isNull(), "active").otherwise("stale"))
    free = facts.filter(X.blank(F.col("slot_key"))).withColumn("status", F.lit("active")).withColumn("superseded_by_turn_id", F.lit(None).cast("bigint"))
    return judged.select(*facts.columns).unionByName(free)


def irregular_namespaces(facts: DataFrame, max_stale: int = C.MAX_STALE) -> DataFrame:
    """Namespaces the closed form does not hold for: text that comes twice, turns out of order, rows already stale, or more stale facts than are kept."""
    order = W.partitionBy(NS).orderBy("seq")
    step = facts.select(NS, (F.col("source_turn_id") < F.lag("source_turn_id").over(order)).alias("back")).filter("back").select(NS)
    twice = facts.groupBy(NS, X.normalised(F.col("text")).alias("norm")).count().filter("count > 1").select(NS)
    old = facts.filter("status <> 'active'").select(NS)
    many = closed_form(facts).filter("status = 'stale'").groupBy(NS).count().filter(F.col("count") > max_stale).select(NS)
    return step.union(twice).union(old).union(many).distinct()


_NAMES = [f.name for f in FACT]
_ARROW = {f.name: {"bigint": pa.int64(), "boolean": pa.bool_()}.get(f.dataType.simpleString(), pa.string()) for f in FACT}


def _facts(group: pa.Table, order: list[str]) -> list[Fact]:
    """A group's rows as facts in the given order, column by column."""
    names = [c for c in _NAMES if c != NS]
    rows = group.select(names).sort_by([(c, "ascending") for c in order])
    return [Fact(**dict(zip(names, values, strict=True))) for values in zip(*(rows.column(c).to_pylist() for c in names), strict=True)]


def _table(namespace: str, facts: list[Fact]) -> pa.Table:
    columns = {c: [namespace] * len(facts) if c == NS else [getattr(f, c) for f in facts] for c in _NAMES}
    return pa.table({c: pa.array(columns[c], _ARROW[c]) for c in _NAMES})


def folded(facts: DataFrame, max_stale: int = C.MAX_STALE, same_slot: Callable[[Fact, Fact], bool] | None = None, reset: bool = False) -> DataFrame:
    """The fold, by namespace in the order of seq. reset: all facts start active in the order of turns (a replay)."""
    order = ["source_turn_id", "seq"] if reset else ["seq"]

    def run(group: pa.Table) -> pa.Table:
        ledger = Ledger(max_stale, same_slot)
        for fact in _facts(group, order):
            if reset:
                fact.status, fact.superseded_by_turn_id = "active", None
            ledger.add(fact)
        return _table(group.column(NS)[0].as_py(), ledger.rows())

    return facts.select(*_NAMES).groupBy(NS).applyInArrow(run, FACT)


def supersede(facts: DataFrame, max_stale: int = C.MAX_STALE, force_fold: bool = False) -> DataFrame:
    """The ledger that facts, added in the order of seq, leave."""
    if force_fold:
        return folded(facts, max_stale)
    odd = irregular_namespaces(facts, max_stale)
    regular = closed_form(facts.join(odd, NS, "left_anti"))
    return regular.unionByName(folded(facts.join(odd, NS, "left_semi"), max_stale))


def merge(left: DataFrame, right: DataFrame, max_stale: int = C.MAX_STALE) -> DataFrame:
    """right's facts merged into the ledger left, by namespace, in the order of seq."""
    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        ledger = Ledger(max_stale)
        for fact in _facts(a, ["seq"]):
            number = ledger.arrivals
            ledger.arrivals += 1
            ledger.facts[number], ledger.by_text[fact.norm] = fact, number
            ledger.by_slot.setdefault(fact.slot_key or "", []).append(number)
            if fact.status == "stale":
                ledger.stale.add(number)
        top = max((f.seq for f in ledger.facts.values()), default=0)
        more = _facts(b, ["seq"])
        for fact in more:
            fact.seq += top
        ledger.merge(more)
        return _table((a if len(a) else b).column(NS)[0].as_py(), ledger.rows())

    return left.select(*_NAMES).groupBy(NS).cogroup(right.select(*_NAMES).toDF(*_NAMES).groupBy(NS)).applyInArrow(run, FACT)


def evicted(facts: DataFrame, max_stale: int = C.MAX_STALE) -> DataFrame:
    """A snapshot without the oldest stale facts beyond the cap."""
    rank = F.row_number().over(W.partitionBy(NS, "status").orderBy(F.col("source_turn_id").desc(), F.col("seq").desc()))
    return facts.withColumn("rank", rank).filter((F.col("status") != "stale") | (F.col("rank") <= max_stale)).drop("rank")


def newest_per_slot(facts: DataFrame) -> DataFrame:
    """Of each slot the active fact with the latest turn, the first one on a tie; active facts without a slot too."""
    active = facts.filter("status = 'active'")
    slot = F.nullif("slot_key", F.lit(""))
    rank = F.row_number().over(W.partitionBy(NS, slot).orderBy(F.col("source_turn_id").desc(), "seq"))
    return active.withColumn("rank", rank).filter((F.col("rank") == 1) | slot.isNull()).drop("rank")


active_entries = newest_per_slot


def stale_entries(facts: DataFrame) -> DataFrame:
    return facts.filter("status = 'stale'")


def suppressed_duplicates(facts: DataFrame) -> DataFrame:
    """By namespace, how many active facts the newest of their slot hides."""
    return facts.filter("status = 'active'").groupBy(NS, "slot_key").agg(F.count("*").alias("n")).filter("slot_key <> ''").groupBy(NS).agg(F.sum(F.col("n") - 1).alias("suppressed"))


def without_slots(facts: DataFrame, slots: DataFrame) -> DataFrame:
    """facts whose slot is not in slots (namespace, slot_key); those without a slot stay."""
    return facts.join(slots.select(NS, "slot_key").distinct(), [NS, "slot_key"], "left_anti")


def without_outdated(facts: DataFrame, recent: DataFrame) -> DataFrame:
    """facts for whose slot no later turn of recent (namespace, slot_key, turn_id, slot_value) has another value."""
    a, b = facts.alias("a"), recent.alias("b")
    newer = (F.col(f"a.{NS}") == F.col(f"b.{NS}")) & (F.col("a.slot_key") == F.col("b.slot_key")) & (F.col("b.turn_id") > F.col("a.source_turn_id")) & (F.col("b.slot_value") != F.col("a.slot_value")) & (F.col("a.slot_value") != "")
    return a.join(b, newer, "left_anti")


def without_quarantined(facts: DataFrame, quarantine: DataFrame) -> DataFrame:
    """facts whose value is not in quarantine (namespace, slot_key, slot_value)."""
    return facts.join(quarantine.select(NS, "slot_key", "slot_value").distinct(), [NS, "slot_key", "slot_value"], "left_anti").select(*facts.columns)


def recanonicalised(facts: DataFrame, granularity: str = "full") -> DataFrame:
    """Active facts grouped by canonical key: the latest stays, all others go stale and point to it."""
    key = F.when((F.col("status") == "active") & ~X.blank(F.col("slot_key")), F.nullif(X.canonical_key(F.col("slot_key"), granularity), F.lit("")))
    group = W.partitionBy(NS, "canonical").orderBy("source_turn_id", "seq").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    last = F.last(F.struct("seq", "source_turn_id")).over(group)
    marked = facts.withColumn("canonical", key).withColumn("winner", F.when(F.col("canonical").isNotNull(), last))
    loses = F.col("winner").isNotNull() & (F.col("winner.seq") != F.col("seq"))
    return marked.withColumns({"superseded_by_turn_id": F.when(loses, F.col("winner.source_turn_id")).otherwise(F.col("superseded_by_turn_id")), "status": F.when(loses, "stale").otherwise(F.col("status"))}).select(*facts.columns)


def with_provenance(facts: DataFrame, turns: DataFrame) -> DataFrame:
    """facts with session and time of their source turn; without such a turn they have none."""
    t = turns.select(NS, F.col("turn_id").alias("source_turn_id"), F.col("session_id").alias("turn_session"), F.col("ts").alias("turn_ts"))
    return facts.join(t, [NS, "source_turn_id"], "left").withColumns({"session_id": F.col("turn_session"), "ts": F.col("turn_ts")}).select(*facts.columns)


def line() -> Column:
    return X.fact_line(F.col("kind"), F.col("status"), F.col("text"), F.col("source_turn_id"), F.col("session_id"), F.col("ts"))


def rendered(facts: DataFrame) -> DataFrame:
    """(namespace, rendered): the given facts as lines in the order of seq, under a header."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda s: s["line"])
    return facts.withColumn("line", line()).groupBy(NS).agg(F.concat(F.lit("Facts Ledger:\n"), F.array_join(lines, "\n")).alias("rendered"))


def extracted_facts(turns: DataFrame) -> DataFrame:
    """Facts that sentences state by known keywords and patterns: turn to facts, without a model."""
    one = turns.select(NS, "turn_id", "session_id", "ts", F.posexplode(X.sentences(F.col("content"))).alias("place", "sentence")).withColumn("text", F.trim("sentence")).withColumn("slot_key", X.slot_key(F.col("text"))).withColumn("slot_value", X.slot_value(F.col("slot_key"), F.col("text"))).filter(has_slot())
    from recollect.schemas import conforming

    seq = F.row_number().over(W.partitionBy(NS).orderBy("turn_id", "place"))
    return conforming(one.select(NS, seq.cast("long").alias("seq"), X.slot_kind(F.col("slot_key")).alias("kind"), "text", F.col("turn_id").alias("source_turn_id"), F.lit("active").alias("status"), "slot_key", "slot_value", F.lit(False).alias("is_correction"), "session_id", "ts"), FACT)


def mapped_turns(facts: DataFrame, turns: DataFrame) -> DataFrame:
    """facts with mapped_turn: the one turn of the namespace that has the fact's text or all its content words, else null.

    Facts meet the turns of their own namespace only."""
    words = F.filter(F.split(F.regexp_replace(X.normalised(F.col("text")), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda w: (w != "") & ~w.isin(C.FACT_STOPWORDS))
    f = facts.select(NS, "seq", X.normalised(F.col("text")).alias("fact"), words.alias("fact_words")).filter(F.size("fact_words") > 0)
    turn_words = F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower("content"), r"[^\p{L}\p{N}_\s]", " "), r"\s+"), lambda w: w != ""))
    t = turns.select(NS, "turn_id", F.lower("content").alias("content"), turn_words.alias("turn_words"))
    squashed = lambda c: F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_\s]", " "), " ", "")
    matches = f.join(t, NS).filter(F.contains("content", "fact") | F.contains(squashed(F.col("fact")), squashed(F.col("content"))) | (F.size(F.array_except("fact_words", "turn_words")) == 0))
    one = matches.groupBy(NS, "seq").agg(F.collect_set("turn_id").alias("found")).filter(F.size("found") == 1).select(NS, "seq", F.element_at("found", 1).alias("mapped_turn"))
    return facts.join(one, [NS, "seq"], "left")
