"""Composed plans: answering requests from memory, compacting it, and evaluating arms against each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions import constants as C
from recollect.functions import text as X
from recollect.operators import assembly, compaction, evaluate, families, ledger, retrieval
from recollect.providers import Selector

NS = "namespace"

SELECTORS: dict[str, Selector] = {
    "recency": retrieval.recency_selection,
    "lexical": retrieval.lexical_selection,
    "packed": retrieval.packed_selection,
    "sparse": retrieval.sparse_selection,
}


def recall(queries: DataFrame, facts: DataFrame, summaries: DataFrame, turns: DataFrame, selector: str = "sparse") -> DataFrame:
    """(query_id, mode, evidence, n_candidates, tokens): the selected evidence of each request as lines, oldest first."""
    chosen = SELECTORS[selector](queries, facts, summaries, turns)
    order = F.struct("turn_id", "kind", "text")
    lines = F.transform(F.array_sort(F.collect_list(order)), lambda s: F.concat(F.lit("- "), s["text"]))
    got = chosen.groupBy("query_id").agg(F.array_join(lines, "\n").alias("evidence"), F.count("*").alias("n_candidates"), F.sum("cost").alias("tokens"))
    asked = queries.select("query_id", X.question_mode(F.col("query")).alias("mode"))
    return asked.join(got, "query_id", "left").select("query_id", "mode", F.coalesce("evidence", F.lit("")).alias("evidence"), F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def role_scoped_recall(queries: DataFrame, facts: DataFrame, summaries: DataFrame, turns: DataFrame) -> DataFrame:
    """sparse selection with the newest value in place of its role group."""
    rows = retrieval.scored(queries, retrieval.candidates(facts, summaries))
    newest = families.prefer_newest(rows, "role").filter(F.col("score") > C.RELEVANCE_FLOOR)
    budget = retrieval.available_budget(queries, turns).select("query_id", "available")
    return retrieval.skip_fit(newest.join(budget, "query_id"), [F.col("score").desc(), F.col("turn_id").desc(), F.col("kind"), F.col("text"), F.col("item_seq")])


def compact(turns: DataFrame, trigger: int = C.TRIGGER_TOKENS, size: int = C.SPAN_TURNS, keep: int = C.KEEP_TURNS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(remaining turns, compacted spans, facts their sentences state) of all namespaces."""
    marked = turns.join(compaction.compacted(turns, trigger, size, keep), [NS, "turn_id"])
    gone = marked.filter("compaction is not null")
    return marked.filter("compaction is null").drop("compaction"), gone, ledger.supersede(ledger.with_provenance(ledger.extracted_facts(gone.drop("compaction")), turns))


def prompts(requests: DataFrame, facts: DataFrame, summaries: DataFrame, turns: DataFrame, max_tokens: int = C.MAX_CONTEXT_TOKENS) -> DataFrame:
    return assembly.assembled(requests, facts, summaries, turns, max_tokens=max_tokens)


def arm_matrix(items: DataFrame, runs: DataFrame, arms: list[str], budgets: list[int]) -> DataFrame:
    """Problems of a run matrix against what was to be run."""
    return evaluate.coverage(evaluate.expected_matrix(items, arms, budgets), runs, ["question_id", "arm", "budget_tokens"])
