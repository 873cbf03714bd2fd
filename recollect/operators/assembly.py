"""From memory tiers to a prompt: recent observations, quarantine of outdated values, filtered summaries, rendering.

Every step is a DataFrame over namespaces. Newest values per slot are one row per slot, joined by namespace; sentences
meet only the slots of their own namespace.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions import constants as C
from recollect.functions import text as X
from recollect.operators import ledger
from recollect.sources.scratch import small_side, written

NS = "namespace"
BROADCAST_NAMES = 500_000


def recent_slot_values(turns: DataFrame) -> DataFrame:
    """(namespace, slot_key, turn_id, slot_value): what verbatim turns say of known slots."""
    seen = turns.withColumn("slot_key", X.slot_key(F.col("content"))).withColumn("slot_value", X.slot_value(F.col("slot_key"), F.col("content")))
    return seen.filter(ledger.has_slot()).select(NS, "slot_key", "turn_id", "slot_value")


def newest_values(facts: DataFrame, turns: DataFrame, recent: DataFrame | None = None) -> DataFrame:
    """(namespace, slot_key, newest_turn, newest_value): of active facts and recent turns; on a tie facts come first, in their order. recent: recent_slot_values(turns), where it is at hand."""
    a = ledger.active_entries(facts).filter(ledger.has_slot()).select(NS, "slot_key", F.col("source_turn_id").alias("turn_id"), "slot_value", F.lit(0).alias("tier"), F.col("seq").alias("tie"))
    b = (recent_slot_values(turns) if recent is None else recent).select(NS, "slot_key", "turn_id", "slot_value", F.lit(1).alias("tier"), F.col("turn_id").alias("tie"))
    rank = F.row_number().over(W.partitionBy(NS, "slot_key").orderBy(F.col("turn_id").desc(), "tier", "tie"))
    return a.unionByName(b).withColumn("rank", rank).filter("rank = 1").select(NS, "slot_key", F.col("turn_id").alias("newest_turn"), F.col("slot_value").alias("newest_value"))


def quarantined(facts: DataFrame, summaries: DataFrame, turns: DataFrame, recent: DataFrame | None = None) -> DataFrame:
    """(namespace, slot_key, slot_value): values that a newer observation of their slot contradicts, in facts and in sentences of older summaries."""
    newest = newest_values(facts, turns, recent)
    of_facts = facts.filter(ledger.has_slot()).join(newest, [NS, "slot_key"]).filter((F.col("newest_turn") > F.col("source_turn_id")) & (F.col("slot_value") != F.col("newest_value"))).select(NS, "slot_key", "slot_value")
    # A sentence is read once for all slots it gives values for, so it meets only those of its namespace, on their keys.
    told = summaries.filter(F.size("covers_turn_ids") > 0).select(NS, F.array_max("covers_turn_ids").alias("last_turn"), F.explode(X.sentences(F.col("text"))).alias("sentence"))
    stated = told.select(NS, "last_turn", F.explode(X.stated_values(F.col("sentence"))).alias("said")).groupBy(NS, "said").agg(F.min("last_turn").alias("last_turn"))
    of_summaries = stated.select(NS, "said.slot_key", "said.slot_value", "last_turn").join(newest, [NS, "slot_key"]).filter((F.col("last_turn") < F.col("newest_turn")) & (F.col("slot_value") != F.col("newest_value"))).select(NS, "slot_key", "slot_value")
    return of_facts.unionByName(of_summaries).distinct()


def filtered_summaries(summaries: DataFrame, quarantine: DataFrame) -> DataFrame:
    """summaries with shown: the text without sentences that hold a quarantined value of any slot of the namespace."""
    values = quarantine.groupBy(NS).agg(F.array_sort(F.collect_set("slot_value")).alias("bad"))
    return summaries.join(values, NS, "left").withColumn("shown", X.without_values(F.col("text"), F.coalesce("bad", F.array().cast("array<string>")))).drop("bad")


def shown_facts(facts: DataFrame, summaries: DataFrame, turns: DataFrame, history: bool = False, recent: DataFrame | None = None, quarantine: DataFrame | None = None) -> DataFrame:
    """The facts a prompt shows: the current ones, or all with history, not outdated by a recent turn, and not quarantined unless history is asked for.

    recent and quarantine: what recent_slot_values and quarantined give for the rest, where they are at hand."""
    own = facts if history else ledger.active_entries(facts)
    recent = recent_slot_values(turns) if recent is None else recent
    own = ledger.without_outdated(own, recent)
    return own if history else ledger.without_quarantined(own, quarantined(facts, summaries, turns, recent) if quarantine is None else quarantine)


def _section(lines: DataFrame, order: list[str], title: str, name: str) -> DataFrame:
    """(namespace, name): lines (namespace, line, order...) under a title."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, "line"))), lambda s: s["line"]), "\n")
    return lines.groupBy(NS).agg(F.concat(F.lit(f"=== {title} ===\n"), body).alias(name))


def assembled(namespaces: DataFrame, facts: DataFrame, summaries: DataFrame, turns: DataFrame, recall: DataFrame | None = None, history: bool = False, max_tokens: int = C.MAX_CONTEXT_TOKENS) -> DataFrame:
    """namespaces (namespace, system, task) with prompt, tokens and overflow. Sections without content are left out.

    Order: system, task, summaries (by first covered turn), facts, recall (namespace, recall), verbatim turns."""
    # Memories of namespaces without a prompt are not looked at; what several sections need is worked out once.
    named = small_side(written(namespaces.select(NS).distinct(), "names"), BROADCAST_NAMES)
    facts, summaries, turns = (x.join(named, NS, "left_semi") for x in (facts, summaries, turns))
    facts, recent = written(facts, "facts"), written(recent_slot_values(turns), "recent")
    quarantine = None if history else written(quarantined(facts, summaries, turns, recent), "quarantine")
    told = (summaries.withColumn("shown", F.col("text")) if history else filtered_summaries(summaries, quarantine)).filter(F.trim("shown") != "")
    told = told.withColumn("first_turn", F.coalesce(F.array_min("covers_turn_ids"), F.lit(0))).withColumn("line", X.summary_line(F.col("shown"), F.col("session_ids"), F.col("start_ts"), F.col("end_ts")))
    known = shown_facts(facts, summaries, turns, history, recent, quarantine).withColumn("line", ledger.line())
    said = turns.withColumn("line", X.turn_line(F.col("role"), F.col("content")))
    out = namespaces.withColumn("p0", F.concat(F.lit("=== SYSTEM ===\n"), "system")).withColumn("p1", F.concat(F.lit("=== TASK ===\n"), "task"))
    out = out.join(_section(told, ["first_turn", "seq"], "EPISODIC SUMMARIES", "p2"), NS, "left")
    out = out.join(_section(known, ["seq"], "FACTS LEDGER", "p3").withColumn("p3", F.regexp_replace("p3", "^=== FACTS LEDGER ===\n", "=== FACTS LEDGER ===\nFacts Ledger:\n")), NS, "left")
    if recall is not None:
        out = out.join(recall.filter("recall <> ''").select(NS, F.concat(F.lit("=== SEMANTIC RECALL ===\n"), "recall").alias("p4")), NS, "left")
    else:
        out = out.withColumn("p4", F.lit(None).cast("string"))
    out = out.join(_section(said, ["turn_id"], "VERBATIM TRANSCRIPT", "p5"), NS, "left")
    prompt = F.concat_ws("\n\n", *[f"p{i}" for i in range(6)])
    return out.withColumn("prompt", prompt).withColumn("tokens", X.token_count(prompt)).withColumn("overflow", F.col("tokens") > max_tokens).drop(*[f"p{i}" for i in range(6)])


def messages(assembled_prompts: DataFrame, turns: DataFrame) -> DataFrame:
    """(namespace, messages array of (role, content)): one system message without the transcript, then the turns."""
    system = F.regexp_replace("prompt", r"(?s)\n\n=== VERBATIM TRANSCRIPT ===\n.*$", "")
    said = turns.groupBy(NS).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn_id", "role", "content"))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("said"))
    head = F.array(F.struct(F.lit("system").alias("role"), system.alias("content")))
    return assembled_prompts.join(said, NS, "left").select(NS, F.concat(head, F.coalesce("said", F.array().cast("array<struct<role:string,content:string>>"))).alias("messages"))


def section_tokens(prompts: DataFrame) -> DataFrame:
    """prompts (namespace, prompt) as one row per section: title and tokens of the slice up to the next title."""
    parts = prompts.select(NS, F.posexplode(F.split("prompt", r"(?=(?m)^=== [A-Z ]+ ===$)")).alias("place", "slice"))
    titled = parts.withColumn("section", F.regexp_extract("slice", r"^=== ([A-Z ]+) ===", 1)).filter("section <> ''")
    return titled.select(NS, "place", "section", X.token_count(F.col("slice")).alias("tokens"))


def fit_to_budget(select: Callable[[DataFrame], DataFrame], render: Callable[[DataFrame], DataFrame], queries: DataFrame, budget: int, rounds: int = 12, margin: int = 64) -> DataFrame:
    """What select gives for queries (query_id, ..), each with a budget_tokens so small that what render makes of it, as
    (query_id, tokens), fits the budget; fitted_budget is that number.

    Budgets shrink by the overshoot and a margin. A round is a written table of the requests that do not fit yet, so requests
    that fit early cost nothing later and no plan grows; what does not fit after all rounds keeps its last selection."""
    left, fitted = written(queries.withColumn("budget_tokens", F.lit(budget).cast("long")), "asked"), None
    for last in [False] * (rounds - 1) + [True]:
        chosen = written(select(left), "chosen")
        over = render(chosen).select("query_id", (F.col("tokens") - budget).alias("over")).filter("over > 0")
        over = written(over, "over")
        done = left.select("query_id", F.col("budget_tokens").alias("fitted_budget"))
        rows = chosen.join(done if last else done.join(over, "query_id", "left_anti"), "query_id")
        fitted = rows if fitted is None else fitted.unionByName(rows)
        if last or not over.limit(1).count():
            return fitted
        left = written(left.join(over, "query_id").withColumn("budget_tokens", F.col("budget_tokens") - F.col("over") - margin).drop("over"), "asked")
    return fitted


def trimmed(items: DataFrame, budget: int) -> DataFrame:
    """items (namespace, tier, turn_id, item_seq, cost) without the oldest free facts, then the oldest summaries, until the rest fits; tier 0 and 1 are never dropped."""
    total = F.sum("cost").over(W.partitionBy(NS))
    drop_order = W.partitionBy(NS).orderBy(F.col("tier").desc(), "turn_id", "item_seq").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("cost").over(drop_order), F.lit(0))
    return items.withColumn("total", total).withColumn("dropped_before", before).filter((F.col("tier") < 2) | (F.col("total") - F.col("dropped_before") <= budget)).drop("total", "dropped_before")
