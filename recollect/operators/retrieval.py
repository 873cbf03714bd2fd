"""Retrieval: candidates, lexical scores, and selection under a token budget.

All functions work on many requests at once: ``queries`` is (query_id, namespace, query, budget_tokens), and a request
sees the candidates of its namespace. Scores join on tokens, so a request meets only candidates that share a word;
selection is one ordered array per request, folded once, of rows that the budget could hold. Texts stay out of the rows
that are scored and ordered: a number stands for their order, and chosen rows get them back by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions import constants as C
from recollect.functions import text as X
from recollect.operators import ledger
from recollect.sources.scratch import small_side, written

NS = "namespace"
BROADCAST_TOKENS = 500_000


def entry_cost() -> Column:
    return X.token_count(ledger.line())


def summary_turn() -> Column:
    """The latest turn a summary covers, or 0."""
    return F.coalesce(F.array_max("covers_turn_ids"), F.lit(0)).cast("long")


def summary_cost() -> Column:
    return X.token_count(X.summary_line(F.col("text"), F.col("session_ids"), F.col("start_ts"), F.col("end_ts")))


def deduplicated(facts: DataFrame) -> DataFrame:
    """Of facts with equal slot and equal squeezed text the newest, the first on a tie."""
    same = W.partitionBy(NS, F.coalesce("slot_key", F.lit("")), X.squeezed(F.col("text"))).orderBy(F.col("source_turn_id").desc(), "seq")
    return facts.withColumn("rank", F.row_number().over(same)).filter("rank = 1").drop("rank")


def candidates(facts: DataFrame, summaries: DataFrame, deduplicate: bool = True) -> DataFrame:
    """Facts and summaries as candidates, twice: history = false with active facts, history = true with all."""
    own = deduplicated if deduplicate else (lambda f: f)
    tokens = X.retrieval_tokens(F.col("text")).alias("tokens")
    entries = own(ledger.active_entries(facts)).withColumn("history", F.lit(False)).unionByName(own(facts).withColumn("history", F.lit(True)))
    a = entries.select(NS, "history", F.lit("entry").alias("kind"), F.col("seq").alias("item_seq"), "text", entry_cost().alias("cost"), F.col("source_turn_id").alias("turn_id"), "status", "slot_key", "slot_value", tokens)
    none = F.lit(None).cast("string")
    # Tokens are made before a summary is doubled, so that its text is read once.
    once = summaries.select(NS, F.lit("summary").alias("kind"), F.col("seq").alias("item_seq"), "text", summary_cost().alias("cost"), summary_turn().alias("turn_id"), none.alias("status"), none.alias("slot_key"), none.alias("slot_value"), tokens)
    return a.unionByName(once.withColumn("history", F.explode(F.array(F.lit(False), F.lit(True)))))


def document_frequency(cands: DataFrame) -> DataFrame:
    """(namespace, history, token, df): candidates that have a token."""
    return cands.select(NS, "history", F.explode("tokens").alias("token")).groupBy(NS, "history", "token").agg(F.count("*").alias("df"))


def asking(queries: DataFrame, history: str = "auto") -> DataFrame:
    """queries with history: auto (by the question), always or never."""
    return queries.withColumn("history", {"auto": X.wants_history(F.col("query")), "always": F.lit(True), "never": F.lit(False)}[history])


def scored(queries: DataFrame, cands: DataFrame, history: str = "auto", matching_only: bool = False, within: str | None = None) -> DataFrame:
    """Candidates with the score they have for each request: the sum of ln(1 + (N + 1) / (df + 1)) over shared tokens, plus a thousandth of the turn's share of the last turn.

    history: auto (by the question), always or never. matching_only leaves out candidates that share no token. within names a
    column of queries; candidates that cost more count in N and df, but have no row for that request."""
    asked = asking(queries, history)
    kept = cands.drop("tokens")
    sizes = cands.groupBy(NS, "history").agg(F.count("*").alias("n"), F.max("turn_id").alias("last_turn"))
    tokens = asked.select("query_id", NS, "history", F.explode(X.retrieval_tokens(F.col("query"))).alias("token"))
    # Texts are cut into tokens once, for candidates that some request sees, and only tokens that a request has go further.
    wanted = small_side(tokens.select(NS, "history", "token").distinct(), BROADCAST_TOKENS)
    having = written(cands.select(NS, "history", "kind", "item_seq", F.explode("tokens").alias("token")).join(wanted, [NS, "history", "token"], "left_semi"), "postings")
    df = having.groupBy(NS, "history", "token").agg(F.count("*").alias("df"))
    weighted = tokens.join(df, [NS, "history", "token"]).join(sizes, [NS, "history"]).withColumn("weight", F.log(1.0 + (F.col("n") + 1) / (F.col("df") + 1)))
    lexical = weighted.join(having, [NS, "history", "token"]).groupBy("query_id", NS, "history", "kind", "item_seq").agg(F.sum("weight").alias("lexical"), F.count("*").alias("n_shared"))
    keys = ["query_id", NS, "history", "kind", "item_seq"]
    if matching_only:
        rows = lexical.join(kept, [NS, "history", "kind", "item_seq"]).join(asked.select("query_id", "query", "budget_tokens"), "query_id")
    else:
        met = asked.join(kept, [NS, "history"])
        rows = (met.filter(F.col("cost") <= F.col(within)) if within else met).join(lexical, keys, "left")
    recency = F.coalesce(F.col("turn_id") / F.nullif("last_turn", F.lit(0)), F.lit(0.0)) * C.RECENCY_WEIGHT
    return rows.join(sizes, [NS, "history"]).withColumn("score", F.round(F.coalesce("lexical", F.lit(0.0)) + recency, 9)).withColumn("n_shared", F.coalesce("n_shared", F.lit(0))).drop("lexical", "n", "last_turn")


def available_budget(queries: DataFrame, turns: DataFrame) -> DataFrame:
    """queries with available: the budget without the question, the reserve and the verbatim turns, at least 0."""
    joined = turns.groupBy(NS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_id", X.turn_line(F.col("role"), F.col("content")).alias("line")))), lambda s: s["line"]), "\n").alias("all_turns"))
    left = F.col("budget_tokens") - X.token_count(F.col("query")) - C.RESERVE_TOKENS - X.token_count(F.col("all_turns"))
    return queries.join(joined, NS, "left").withColumn("available", F.greatest(F.lit(0), left).cast("long")).drop("all_turns")


def skip_fit(rows: DataFrame, order: list[Column], budget: str = "available", by: str = "query_id") -> DataFrame:
    """rows that are taken when each, in the given order, is taken if its cost still fits; place is its number in that order
    among those that could be taken.

    Of rows with one cost those taken come first, and no more of them than the budget holds: once one does not fit, no later
    one of that cost does. So the array that is folded has a length given by the budget, however many rows there are."""
    alike = F.row_number().over(W.partitionBy(by, "cost").orderBy(*order))
    could = rows.withColumn("place", alike).filter((F.col("cost") * F.col("place") <= F.col(budget)) & (F.col("cost") <= F.col(budget))).drop("place")
    ranked = could.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy(*order)))
    ordered = F.array_sort(F.collect_list(F.struct("place", "cost")))

    def step(s, x):
        fits = x["cost"] <= s["left"]
        return F.struct(F.when(fits, s["left"] - x["cost"]).otherwise(s["left"]).alias("left"), F.when(fits, F.concat(s["kept"], F.array(x["place"]))).otherwise(s["kept"]).alias("kept"))

    grouped = ranked.groupBy(by).agg(ordered.alias("ordered"), F.first(F.col(budget).cast("long")).alias("left"))
    start = F.struct(F.col("left").alias("left"), F.array().cast("array<int>").alias("kept"))
    kept = grouped.select(by, F.explode(F.aggregate("ordered", start, step)["kept"]).alias("place"))
    return ranked.join(kept, [by, "place"])


def truncate_fit(turns: DataFrame, budget: int) -> DataFrame:
    """The newest turns whose costs add up to no more than budget; the first that does not fit ends it."""
    newest = W.partitionBy(NS).orderBy(F.col("turn_id").desc()).rowsBetween(W.unboundedPreceding, 0)
    return turns.withColumn("running", F.sum(X.token_count(X.turn_line(F.col("role"), F.col("content")))).over(newest)).filter(F.col("running") <= budget)


def _with_budget(rows: DataFrame, queries: DataFrame, turns: DataFrame) -> DataFrame:
    return rows.join(available_budget(queries, turns).select("query_id", "available"), "query_id")


def _by_score() -> list[Column]:
    return [F.col("score").desc(), F.col("turn_id").desc(), F.col("kind"), F.col("text"), F.col("item_seq")]


_TEXTS = ["text", "status", "slot_key", "slot_value"]
_PLACE = [NS, "history", "kind", "turn_id"]


def _at(right: DataFrame, names: list[str]) -> tuple[DataFrame, Column]:
    """right with its names put apart, and the condition that they equal those of a left side, nulls too."""
    met = F.lit(True)
    for c in names:
        met = met & F.col(c).eqNullSafe(F.col(f"own_{c}"))
    return right.withColumnsRenamed({c: f"own_{c}" for c in names}), met


def _named(seen: DataFrame) -> DataFrame:
    """Candidates as a written table without texts: tie, with turn and kind, names a candidate of a namespace and is the order
    of texts there. Where a turn has one candidate of a kind it is 0; only the others keep their texts (told) and are ordered
    by them, so that no sort moves all texts."""
    several = written(seen.groupBy(*_PLACE).agg(F.count("*").alias("n")).filter("n > 1").select(*_PLACE, F.lit(True).alias("crowded")), "crowded")
    right, met = _at(small_side(several, BROADCAST_TOKENS), _PLACE)
    marked = seen.join(right, met, "left").withColumn("told", F.when(F.col("crowded"), F.struct(*_TEXTS)))
    rows = written(marked.select(*_PLACE, "item_seq", "cost", "tokens", "told"), "candidates")
    order = F.row_number().over(W.partitionBy(*_PLACE).orderBy("told.text", "item_seq", "told"))
    return rows.filter("told is null").withColumn("tie", F.lit(0)).unionByName(rows.filter("told is not null").withColumn("tie", order))


def _fitted(queries: DataFrame, cands: DataFrame, turns: DataFrame, history: str, order: list[Column]) -> DataFrame:
    """All candidates scored and skip-fit in the given order, then by _by_score(). What is scored has numbers only, and of it
    only what a request's budget could hold is ordered; texts are joined to the rows that are taken."""
    asked = asking(queries, history)
    seen = cands.join(small_side(asked.select(NS, "history").distinct(), BROADCAST_TOKENS), [NS, "history"], "left_semi")
    own = _named(seen)
    budgets = written(available_budget(queries, turns).select("query_id", NS, "query", "available"), "budgets")
    rows = scored(budgets, own.drop("told"), history, within="available").drop("query")
    taken = skip_fit(rows, [*order, F.col("score").desc(), F.col("turn_id").desc(), F.col("kind"), F.col("tie")])
    texts, here = _at(seen.select(*_PLACE, *_TEXTS), _PLACE)
    told, there = _at(own.filter("tie > 0").select(*_PLACE, "tie", "told.*"), [*_PLACE, "tie"])
    found = taken.filter("tie = 0").join(texts, here).drop("own_tie").unionByName(taken.filter("tie > 0").join(told, there).drop("own_tie"))
    return found.drop("tie", *[f"own_{c}" for c in _PLACE]).join(queries.select("query_id", "query", "budget_tokens"), "query_id")


def lexical_selection(queries: DataFrame, facts: DataFrame, summaries: DataFrame, turns: DataFrame, history: str = "never") -> DataFrame:
    """All candidates by score, skip-fit."""
    return _fitted(queries, candidates(facts, summaries, deduplicate=False), turns, history, [])


def packed_selection(queries: DataFrame, facts: DataFrame, summaries: DataFrame, turns: DataFrame, history: str = "auto") -> DataFrame:
    """Deduplicated candidates by score per token, skip-fit."""
    density = F.col("score") / F.greatest(F.lit(1), F.col("cost"))
    return _fitted(queries, candidates(facts, summaries), turns, history, [F.round(density, 9).desc()])


def sparse_selection(queries: DataFrame, facts: DataFrame, summaries: DataFrame, turns: DataFrame, top_k: int = C.TOP_K, floor: float = C.RELEVANCE_FLOOR, history: str = "auto") -> DataFrame:
    """Deduplicated candidates above the floor, the best top_k of them, skip-fit; position gives their order in time.

    A floor above the recency term admits candidates with a shared token only, so no others are scored."""
    rows = scored(queries, candidates(facts, summaries), history, matching_only=floor >= C.RECENCY_WEIGHT).filter(F.col("score") > floor)
    best = rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*_by_score()))).filter(F.col("rank") <= top_k).drop("rank")
    chosen = skip_fit(_with_budget(best, queries, turns), _by_score())
    return chosen.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("turn_id", "kind", "text", "item_seq")))


def recency_selection(queries: DataFrame, facts: DataFrame, summaries: DataFrame, turns: DataFrame) -> DataFrame:
    """Without a score: the newest turns, the newest fact of each slot, the newest summaries, then active facts without a slot; skip-fit throughout."""
    t = turns.select(NS, F.lit(0).alias("tier"), F.lit("turn").alias("kind"), F.col("turn_id").alias("item_seq"), "turn_id", F.lit("").alias("tie1"), F.lit("").alias("tie2"), X.token_count(X.turn_line(F.col("role"), F.col("content"))).alias("cost"), F.col("content").alias("text"))
    newest = ledger.newest_per_slot(facts)
    slot = ~X.blank(F.col("slot_key"))
    f = newest.select(NS, F.when(slot, 1).otherwise(3).alias("tier"), F.lit("entry").alias("kind"), F.col("seq").alias("item_seq"), F.col("source_turn_id").alias("turn_id"), F.when(slot, F.col("slot_key")).otherwise("").alias("tie1"), F.when(slot, F.col("text")).otherwise("").alias("tie2"), entry_cost().alias("cost"), "text")
    s = summaries.select(NS, F.lit(2).alias("tier"), F.lit("summary").alias("kind"), F.col("seq").alias("item_seq"), summary_turn().alias("turn_id"), F.lit("").alias("tie1"), F.lit("").alias("tie2"), summary_cost().alias("cost"), "text")
    asked = queries.withColumn("available", (F.col("budget_tokens") - X.token_count(F.col("query")) - C.RESERVE_TOKENS).cast("long"))
    rows = asked.join(t.unionByName(f).unionByName(s), NS)
    return skip_fit(rows, ["tier", F.col("turn_id").desc(), "tie1", "tie2", "item_seq"])


def packed_texts(texts: DataFrame, budget: int, by: str = NS) -> DataFrame:
    """texts (by, seq, text) that fit as ``- text`` lines, skip-fit in the order of seq."""
    rows = texts.withColumn("cost", X.token_count(F.concat(F.lit("- "), F.col("text")))).withColumn("available", F.lit(budget).cast("long"))
    return skip_fit(rows, [F.col("seq")], by=by)


def source_references(facts: DataFrame, summaries: DataFrame, turns: DataFrame) -> DataFrame:
    """(namespace, source_id, kind, turn_ids, metadata) of all that memory holds."""
    meta = lambda **c: F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in c]), F.array(*c.values())), lambda k, v: v.isNotNull() & (v != ""))
    a = facts.select(NS, F.concat(F.lit("fact:"), F.col("seq").cast("string")).alias("source_id"), F.lit("fact").alias("kind"), F.array("source_turn_id").alias("turn_ids"), meta(session_id=F.col("session_id"), timestamp=F.col("ts"), status=F.col("status")).alias("metadata"))
    b = summaries.select(NS, F.concat(F.lit("summary:"), F.col("seq").cast("string")).alias("source_id"), F.lit("summary").alias("kind"), F.col("covers_turn_ids").alias("turn_ids"), meta(session_ids=F.array_join("session_ids", ","), start_timestamp=F.col("start_ts"), end_timestamp=F.col("end_ts")).alias("metadata"))
    c = turns.select(NS, F.concat(F.lit("turn:"), F.col("turn_id").cast("string")).alias("source_id"), F.lit("turn").alias("kind"), F.array("turn_id").alias("turn_ids"), meta(session_id=F.col("session_id"), timestamp=F.col("ts")).alias("metadata"))
    return a.unionByName(b).unionByName(c)
