"""Evaluation analytics: accuracies, paired comparisons, gates, percentiles, audits.

Inputs are run tables; every function is an aggregate, a join on keys, or a small window. Rounding is half-up to the
stated places; ratios with an empty denominator have the stated default.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions import constants as C
from recollect.functions import text as X
from recollect.sources.scratch import small_side, written

NS = "namespace"


def share(condition: Column) -> Column:
    """Of the rows where the condition is not null, the share where it holds; 0 without any."""
    return F.coalesce(F.avg(condition.cast("double")), F.lit(0.0))


def arm_summary(runs: DataFrame) -> DataFrame:
    """runs (arm, judged_correct, evidence_retained): accuracy over judged rows and retention over all."""
    return runs.groupBy("arm").agg(share(F.col("judged_correct")).alias("accuracy"), share(F.coalesce("evidence_retained", F.lit(False))).alias("retention"), F.count("*").alias("n"))


def telemetry_sums(runs: DataFrame) -> DataFrame:
    """(arm, extraction): maps summed key by key; arms without telemetry are not in it."""
    parts = runs.select("arm", F.explode("extraction").alias("key", "value")).groupBy("arm", "key").agg(F.sum("value").alias("value"))
    return parts.groupBy("arm").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("extraction"))


def validity(runs: DataFrame, ceiling: float = C.VALIDITY_CEILING) -> DataFrame:
    """(retention, valid): a battery is invalid if plain truncation kept the evidence of too many questions."""
    kept = F.avg(F.when(F.col("arm") == "truncation", F.coalesce("evidence_retained", F.lit(False)).cast("double")))
    return runs.agg(kept.alias("retention")).withColumn("valid", F.coalesce(F.col("retention") < ceiling, F.lit(True)))


def judge_unsure(reason: Column) -> Column:
    """The judge itself was unsure: by a word, or by "cannot determine" without the model as its subject in the 40 characters before."""
    low = F.lower(F.coalesce(reason, F.lit("")))
    before = F.regexp_extract(low, rf"(?s)^(.*?){C.CANNOT_DETERMINE}", 1)
    of_judge = low.rlike(C.CANNOT_DETERMINE) & ~F.regexp_extract(before, r"(?s)(.{0,40})$", 1).rlike(C.MODEL_SUBJECT)
    return low.rlike("|".join(C.AMBIGUOUS_WORDS)) | of_judge


def miss_category(reason: Column, failures: Column, evidence: Column, valid: Column) -> Column:
    low = F.lower(F.coalesce(reason, F.lit("")))
    return (
        F.when(~valid, "budget_invalid").when(F.contains(low, F.lit(C.OVERFLOW_MARKER)), "context_overflow").when(F.coalesce(failures, F.lit(0)) > 0, "extraction_drop")
        .when(judge_unsure(reason), "judge_ambiguity").when(low.rlike("|".join(C.STALE_MARKERS)), "stale_ghost").when(F.coalesce(evidence, F.lit(False)), "answerer_failure").otherwise("summary_loss")
    )


def miss_histogram(misses: DataFrame) -> DataFrame:
    """misses (seq, category) counted by all categories, zeros included; dominant is the largest, the first seen of equals."""
    spark = misses.sparkSession
    names = spark.createDataFrame([(i, c) for i, c in enumerate(C.MISS_CATEGORIES)], "place int, category string")
    counted = misses.groupBy("category").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    rows = F.broadcast(names).join(counted, "category", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = F.row_number().over(W.orderBy(F.col("n").desc(), F.col("first_seq").asc_nulls_last()))
    return rows.withColumn("dominant", (best == 1) & (F.col("n") > 0)).select("category", "n", "dominant")


#: Our own wording of what a dominant category calls for.
RECOMMENDATIONS = {
    "extraction_drop": "Make writing and JSON repair sturdier first.",
    "summary_loss": "Memory loses facts: start on the graph architecture.",
    "stale_ghost": "Memory keeps old values: start on the graph architecture.",
    "answerer_failure": "The fact was in context; memory is not the bottleneck.",
    "context_overflow": "Repair budget and assembly before judging memory.",
    "judge_ambiguity": "Repair the prompt of the judge before judging memory.",
    "budget_invalid": "Run again with a smaller budget.",
}


def recommendation(category: Column) -> Column:
    return F.coalesce(F.element_at(X.mapping(RECOMMENDATIONS), category), F.lit("No misses to classify."))


def majority(answers: DataFrame, by: list[str]) -> DataFrame:
    """answers (by, correct): whether more than half are correct, and their share."""
    return answers.groupBy(*by).agg(F.count("*").alias("reps"), F.sum(F.col("correct").cast("int")).alias("n_correct")).withColumn("majority_correct", 2 * F.col("n_correct") > F.col("reps")).withColumn("rate", F.col("n_correct") / F.col("reps"))


def gate_summary(items: DataFrame, by: list[str]) -> DataFrame:
    """items (by, majority_correct, rate): passes, pass rate, mean and population spread of the rates, three places."""
    return items.groupBy(*by).agg(F.count("*").alias("n_items"), F.sum(F.col("majority_correct").cast("int")).alias("majority_pass"), F.round(F.avg(F.col("majority_correct").cast("double")), 3).alias("pass_rate"), F.round(F.avg("rate"), 3).alias("mean_rep_rate"), F.round(F.stddev_pop("rate"), 3).alias("rep_rate_spread"))


def sample_stats(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean, sample deviation (0 for one row), least and greatest, three places."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.coalesce(F.avg(value), F.lit(0.0)), 3).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 3).alias("stddev"), F.round(F.coalesce(F.min(value), F.lit(0.0)), 3).alias("least"), F.round(F.coalesce(F.max(value), F.lit(0.0)), 3).alias("greatest"))


def loss_against_baseline(rows: DataFrame, by: list[str], condition: str, baseline: str, value: str) -> DataFrame:
    """Per cent that each condition loses against the baseline's mean of the same group; nothing where that is 0."""
    base = rows.filter(F.col(condition) == baseline).groupBy(*by).agg(F.avg(value).alias("base"))
    other = rows.filter(F.col(condition) != baseline).groupBy(*by, condition).agg(F.avg(value).alias("mean"))
    return other.join(base, by).withColumn("loss_pct", F.round(F.try_divide((F.col("base") - F.col("mean")) * 100, F.col("base")), 3))


def throughput(samples: DataFrame, rates: dict[str, float]) -> DataFrame:
    """samples (absorbed_tokens, wall_s, summary_tokens, compacted) against arrival rates: drain, wall times, compression, headroom; one row per rate."""
    middle = order_statistics(samples, "wall_s", [], MIDDLE).agg(F.round(F.avg("value"), 3).alias("wall_median"))
    ok = lambda c: F.sum(F.when(F.col("compacted"), F.col(c)).otherwise(0))
    agg = samples.agg(
        F.count("*").alias("n_calls"), F.sum(F.col("compacted").cast("int")).alias("n_compacted"), F.try_divide(F.sum("absorbed_tokens"), F.sum("wall_s")).alias("drain"), F.round(F.avg("wall_s"), 3).alias("wall_mean"),
        F.round(F.max("wall_s"), 3).alias("wall_max"), ok("absorbed_tokens").alias("absorbed"), ok("summary_tokens").alias("produced"),
    )
    table = samples.sparkSession.createDataFrame(list(rates.items()), "rate_name string, rate double")
    out = agg.crossJoin(middle).crossJoin(F.broadcast(table))
    return out.withColumns({"n_fallback": F.col("n_calls") - F.col("n_compacted"), "compression": F.round(F.coalesce(F.try_divide("absorbed", "produced"), F.lit(0.0)), 2), "keeps_up": F.col("drain") >= F.col("rate"), "headroom": F.round(F.try_divide("drain", "rate"), 2)}).withColumn("drain", F.round("drain", 2))


def p95(value: str) -> Column:
    """The nearest rank from above: a value that occurs."""
    return F.expr(f"percentile_disc(0.95) within group (order by {value})")


def order_statistics(rows: DataFrame, value: str, by: list[str], ranks: dict[str, Callable[[Column], Column]], most: int = 100_000, bins: int = 1024) -> DataFrame:
    """(by, name, value): for each group and name the value at the rank, from 1, that the name's function makes of the
    group's number of values. Exact; nulls do not count, and values that are no numbers are not allowed.

    Counts by bin narrow each rank's range, a thousandfold a round, until a bin holds no more than most rows or one value;
    inside it different values are counted and summed up. All are partial counts, so no group meets in a task."""
    group = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0))
    own = written(rows.select(group.alias("of"), F.col(value).cast("double").alias("v")).filter("v is not null"), "values")
    sizes = own.groupBy("of").agg(F.count("*").alias("inside"), F.min("v").alias("low"), F.max("v").alias("high"))
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("inside")).cast("long").alias("rank")) for name, rank in ranks.items()]))
    targets = written(sizes.withColumn("t", asked).select(F.col("of").alias("group"), "t.name", "t.rank", "low", "high", "inside"), "targets")
    inside = lambda which: own.join(small_side(which, 50_000), F.col("of").eqNullSafe(F.col("group"))).filter(F.col("v").between(F.col("low"), F.col("high")))

    def at_rank(counts: DataFrame, place: str) -> DataFrame:
        up_to = F.sum("n").over(W.partitionBy("group", "name").orderBy(place))
        return counts.withColumn("up_to", up_to).filter((F.col("up_to") >= F.col("rank")) & (F.col("up_to") - F.col("n") < F.col("rank")))

    while (wide := targets.filter((F.col("inside") > most) & (F.col("low") < F.col("high")))).limit(1).count():
        place = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * bins))
        counts = inside(wide).groupBy("group", "name", "rank", place.alias("place")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        narrower = at_rank(counts, "place").select("group", "name", (F.col("rank") - (F.col("up_to") - F.col("n"))).alias("rank"), F.col("lo").alias("low"), F.col("hi").alias("high"), F.col("n").alias("inside"))
        targets = written(targets.filter((F.col("inside") <= most) | (F.col("low") == F.col("high"))).unionByName(narrower), "targets")
    counts = inside(targets).groupBy("group", "name", "rank", "v").agg(F.count("*").alias("n"))
    return at_rank(counts, "v").select(*[F.col("group")[c].alias(c) for c in by], "name", F.col("v").alias("value"))


#: Ranks among n values: the nearest rank from above at 95 per cent, and the two whose mean is the median.
P95 = {"p95": lambda n: F.ceil(n * 95 / 100)}
MIDDLE = {"below": lambda n: F.floor((n + 1) / 2), "above": lambda n: F.floor(n / 2) + 1}


def category_accuracy(runs: DataFrame) -> DataFrame:
    """By arm and category, over judged rows, four places."""
    return runs.filter("judged_correct is not null").groupBy("arm", "category").agg(F.round(F.avg(F.col("judged_correct").cast("double")), 4).alias("accuracy"), F.count("*").alias("n"))


def paired(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both sides by key, the base's columns with prefix base_, the other's with other_."""
    a = base.select(*keys, *[F.col(c).alias(f"base_{c}") for c in base.columns if c not in keys])
    b = other.select(*keys, *[F.col(c).alias(f"other_{c}") for c in other.columns if c not in keys])
    return a.join(b, keys)


def uncovered(base: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that one side alone has."""
    a, b = base.select(*keys).distinct(), other.select(*keys).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("base")).unionByName(b.exceptAll(a).withColumn("side", F.lit("other")))


def sign_counts(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Wins, regressions and their difference over pairs that both sides have judged."""
    delta = F.col("other_judged_correct").cast("int") - F.col("base_judged_correct").cast("int")
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return pairs.groupBy(*(by or [])).agg(count(delta > 0).alias("wins"), count(delta < 0).alias("regressions"), count(delta).alias("delta"))


def promotion(base: DataFrame, other: DataFrame, limit_ms: float = C.P95_LIMIT_MS) -> DataFrame:
    """Six checks and promote, for runs (question_id, budget_tokens, category, judged_correct, memory_tokens, read_latency_ms, context_overflow, provenance_lost) of two arms."""
    pairs = paired(base, other, ["question_id", "budget_tokens"]).withColumn("category", F.col("base_category"))
    signs = sign_counts(pairs)
    worst = sign_counts(pairs, ["category"]).agg(F.coalesce(F.min("delta"), F.lit(0)).alias("worst"))
    facts = other.agg(
        F.coalesce(F.every(F.col("memory_tokens") <= F.col("budget_tokens")), F.lit(True)).alias("within_token_budgets"), p95("read_latency_ms").alias("p95"),
        (~F.coalesce(F.some("context_overflow"), F.lit(False))).alias("no_context_overflow"), (~F.coalesce(F.some("provenance_lost"), F.lit(False))).alias("no_provenance_loss"),
    )
    rows = signs.crossJoin(worst).crossJoin(facts).withColumns({"three_more_wins": F.col("wins") - F.col("regressions") >= 3, "category_regression_at_most_one": F.col("worst") >= -1, "p95_within_limit": F.coalesce(F.col("p95") <= limit_ms, F.lit(False))})
    checks = ["three_more_wins", "category_regression_at_most_one", "within_token_budgets", "p95_within_limit", "no_context_overflow", "no_provenance_loss"]
    promote = F.col(checks[0])
    for c in checks[1:]:
        promote = promote & F.col(c)
    return rows.select("wins", "regressions", "p95", *checks, promote.alias("promote"))


def coverage(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, problem): missing, duplicate or unexpected rows of a matrix."""
    missing = expected.join(observed, keys, "left_anti").select(*keys, F.lit("missing").alias("problem"))
    unexpected = observed.join(expected, keys, "left_anti").select(*keys, F.lit("unexpected").alias("problem"))
    duplicate = observed.join(expected, keys, "left_semi").groupBy(*keys).count().filter("count > 1").select(*keys, F.lit("duplicate").alias("problem"))
    return missing.unionByName(unexpected).unionByName(duplicate)


def expected_matrix(items: DataFrame, arms: list[str], budgets: list[int]) -> DataFrame:
    """items (question_id) by arms by budgets: an explode, not a join."""
    return items.select("question_id", F.explode(F.array(*[F.lit(a) for a in arms])).alias("arm")).select("question_id", "arm", F.explode(F.array(*[F.lit(b) for b in budgets])).alias("budget_tokens"))


def more_than_half(values: Column, pattern: str) -> Column:
    """More than half of the texts match."""
    return F.coalesce(2 * F.size(F.filter(values, lambda v: F.coalesce(v, F.lit("")).rlike(f"(?i){pattern}"))) > F.size(values), F.lit(False))


def abstains(answers: Column) -> Column:
    return more_than_half(answers, "(?:" + "|".join(C.ABSTENTIONS) + ")")


def stale_failure(correct: Column, reasons: Column) -> Column:
    return F.coalesce(~correct, F.lit(False)) & more_than_half(reasons, C.STALE_REASON)


def confirmation(runs: DataFrame, items: DataFrame, safe: str, candidate: str, budgets: list[int], scored_budget: int, limits: dict[str, int], provenance_categories: list[str], frozen: dict[str, bool] | None = None, limit_ms: float = C.P95_LIMIT_MS, repetitions: int = 1) -> DataFrame:
    """Nineteen named checks and a status for runs of two arms over frozen items.

    runs: question_id, arm, budget_tokens, category, judged_correct, model_answers, judge_reasons, read_recall, write_recall,
    candidate_count, read_latency_ms, memory_tokens, context_overflow, provenance_lost, error, source_references (metadata
    maps). items: question_id, category. limits: minimum_wins, item_regressions, category_regressions, abstentions,
    stale_failures, source_losses, empty_retrievals. frozen: results of the two checks on files outside the tables."""
    keys = ["question_id", "arm", "budget_tokens"]
    expected = expected_matrix(items, [safe, candidate], budgets)
    gaps = coverage(expected, runs, keys).agg((F.count("*") == 0).alias("exact_full_matrix"))
    own = runs.join(expected, keys, "left_semi").join(items.select("question_id", F.col("category").alias("expected_category")), "question_id")
    meta = lambda r, *ks: F.greatest(*[F.coalesce(F.element_at(r, F.lit(k)) != "", F.lit(False)) for k in ks])
    whole = F.forall(F.coalesce("source_references", F.array().cast("array<map<string,string>>")), lambda r: meta(r, "session_id", "session_ids") & meta(r, "timestamp", "start_timestamp"))
    temporal = F.col("category").isin(provenance_categories)
    facts = own.agg(
        F.every(F.col("category") == F.col("expected_category")).alias("categories_match_manifest"),
        F.every(F.when(F.col("budget_tokens") == scored_budget, F.col("judged_correct").isNotNull() & (F.size("model_answers") == repetitions) & (F.size("judge_reasons") == repetitions)).otherwise(True)).alias("primary_scores_complete"),
        F.every(F.col("write_recall").isNotNull()).alias("write_recall_measured"), F.every(F.coalesce(F.col("error"), F.lit("")) == "").alias("no_run_errors"),
        F.every((F.col("memory_tokens") <= F.col("budget_tokens")) & ~F.col("context_overflow")).alias("within_context_budgets"),
        F.every(~F.col("provenance_lost") & (F.col("candidate_count") == F.size("source_references"))).alias("no_provenance_loss"),
        (F.coalesce(F.every(whole | ~temporal), F.lit(False)) & (F.coalesce(F.sum(F.when(temporal, F.size("source_references"))), F.lit(0)) > 0)).alias("temporal_provenance_complete"),
    )
    slow = order_statistics(own.filter(F.col("arm") == candidate), "read_latency_ms", ["budget_tokens"], P95).withColumnRenamed("value", "p95").agg((F.coalesce(F.every(F.col("p95") <= limit_ms), F.lit(False)) & (F.count("*") == len(budgets))).alias("candidate_latency_within_limit"))
    pairs = paired(own.filter(F.col("arm") == safe).drop("arm"), own.filter(F.col("arm") == candidate).drop("arm"), ["question_id", "budget_tokens"])
    main = F.col("budget_tokens") == scored_budget
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    counts = pairs.agg(
        n(main & ~F.coalesce("base_judged_correct", F.lit(True)) & yes("other_judged_correct")).alias("wins"), n(main & yes("base_judged_correct") & ~F.coalesce("other_judged_correct", F.lit(True))).alias("regressions"),
        n(main & abstains(F.col("other_model_answers")) & ~abstains(F.col("base_model_answers"))).alias("abstentions"),
        n(main & stale_failure(F.col("other_judged_correct"), F.col("other_judge_reasons")) & ~stale_failure(F.col("base_judged_correct"), F.col("base_judge_reasons"))).alias("stale_failures"),
        n(yes("base_read_recall") & ~yes("other_read_recall")).alias("source_losses"), n(yes("base_write_recall") & ~yes("other_write_recall")).alias("write_losses"),
        n((F.col("base_candidate_count") > 0) & (F.col("other_candidate_count") == 0)).alias("empty_retrievals"),
    )
    deltas = sign_counts(pairs.filter(main).withColumn("category", F.col("base_category")), ["category"]).agg(F.coalesce(F.min("delta"), F.lit(0)).alias("worst_delta"))
    rows = gaps.crossJoin(facts).crossJoin(slow).crossJoin(counts).crossJoin(deltas)
    exact = F.col("exact_full_matrix")
    settled = {k: F.lit(v) for k, v in (frozen or {"manifest_matches_frozen_suite": True, "run_metadata_matches_frozen_protocol": True}).items()}
    # With gaps in the matrix nothing is compared: counts are 0 and what needs full rows fails.
    seen = lambda c: F.when(exact, F.col(c)).otherwise(0)
    checks = settled | {
        "exact_full_matrix": exact, "categories_match_manifest": F.coalesce("categories_match_manifest", F.lit(True)), "primary_scores_complete": exact & F.coalesce("primary_scores_complete", F.lit(False)),
        "minimum_primary_wins": seen("wins") >= limits["minimum_wins"], "no_item_regressions": seen("regressions") <= limits["item_regressions"],
        "no_category_regression": exact & F.coalesce("primary_scores_complete", F.lit(False)) & (F.col("worst_delta") >= -limits["category_regressions"]),
        "no_new_abstentions": seen("abstentions") <= limits["abstentions"], "no_new_stale_failures": seen("stale_failures") <= limits["stale_failures"], "no_gold_source_loss": seen("source_losses") <= limits["source_losses"],
        "no_write_recall_loss": seen("write_losses") == 0, "write_recall_measured": exact & F.coalesce("write_recall_measured", F.lit(False)), "no_empty_retrieval_regression": seen("empty_retrievals") <= limits["empty_retrievals"],
        "no_run_errors": exact & F.coalesce("no_run_errors", F.lit(False)), "within_context_budgets": exact & F.coalesce("within_context_budgets", F.lit(False)), "no_provenance_loss": exact & F.coalesce("no_provenance_loss", F.lit(False)),
        "temporal_provenance_complete": exact & F.coalesce("temporal_provenance_complete", F.lit(False)), "candidate_latency_within_limit": exact & F.col("candidate_latency_within_limit"),
    }
    every = F.lit(True)
    for c in checks.values():
        every = every & c
    status = F.when(every, "promote-experimental-candidate").when(~exact | ~F.coalesce("primary_scores_complete", F.lit(False)), "not-evaluable").otherwise("keep-safe-sparse")
    return rows.select(*[c.alias(k) for k, c in checks.items()], status.alias("status"))


def field_coverage(rows: DataFrame, fields: list[str], by: list[str]) -> DataFrame:
    """Total, complete and missing rows, and the complete share (1 without rows): a field is missing if null, empty or an empty array."""
    whole = F.lit(True)
    for name in fields:
        kind = rows.schema[name].dataType.typeName()
        whole = whole & F.coalesce(F.size(name) > 0 if kind == "array" else F.col(name).cast("string") != "", F.lit(False))
    return rows.groupBy(*by).agg(F.count("*").alias("total"), F.sum(whole.cast("long")).alias("complete")).withColumn("missing", F.col("total") - F.col("complete")).withColumn("coverage", F.coalesce(F.try_divide("complete", "total"), F.lit(1.0)))


def capture_report(records: DataFrame) -> DataFrame:
    """records (question_id, category, state_file, in_progress, exists, loadable, embedded_id, incomplete_tiers, missing_capture, extraction_failures, needs_provenance) with errors, warnings and status."""
    note = lambda test, text: F.when(F.coalesce(test, F.lit(False)), text)
    need = F.col("needs_provenance")
    tiers, fields = F.array_join("incomplete_tiers", ", "), F.array_join("missing_capture", ", ")
    bad_tiers, bad_fields = F.size("incomplete_tiers") > 0, F.size("missing_capture") > 0
    errors = F.array(
        note(~F.col("state_file").endswith(F.concat("question_id", F.lit("_state.json"))), "state filename does not match the question id"), note(~F.col("loadable"), "state JSON is not loadable"),
        note(F.col("embedded_id") != F.col("question_id"), "embedded question id does not match"), note(need & bad_tiers, F.concat(F.lit("provenance incomplete for: "), tiers)), note(need & bad_fields, F.concat(F.lit("capture metadata missing: "), fields)),
    )
    warnings = F.array(
        note(need & ~bad_fields & (F.col("extraction_failures") > 0), F.concat(F.col("extraction_failures").cast("string"), F.lit(" extraction failure(s)"))),
        note(~need & bad_tiers, F.concat(F.lit("provenance incomplete for: "), tiers)), note(~need & bad_fields, F.concat(F.lit("capture metadata missing: "), fields)),
    )
    live = ~F.col("in_progress") & F.col("exists")
    kept = lambda a: F.when(live, F.filter(a, lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    out = records.withColumn("errors", kept(errors)).withColumn("warnings", kept(warnings))
    return out.withColumn("status", F.when(F.col("in_progress"), "in_progress").when(~F.col("exists"), "missing").when(F.size("errors") > 0, "invalid").otherwise("valid"))


def fragmentation(active: DataFrame) -> DataFrame:
    """(namespace, value, slot_keys): values of active facts that stand under several keys."""
    keyed = active.filter(~X.blank(F.col("slot_key")) & ~X.blank(F.col("slot_value")))
    return keyed.groupBy(NS, X.squeezed(F.col("slot_value")).alias("value")).agg(F.array_sort(F.collect_set("slot_key")).alias("slot_keys")).filter(F.size("slot_keys") > 1)


def ledger_audit(facts: DataFrame, active: DataFrame) -> DataFrame:
    """By namespace: facts, active ones (as rendered), superseded ones, their rate (four places), fragmented values."""
    a = facts.groupBy(NS).agg(F.count("*").alias("ledger_total"))
    b = active.groupBy(NS).agg(F.count("*").alias("ledger_active"))
    c = fragmentation(active).groupBy(NS).agg(F.count("*").alias("fragmented_values"))
    zero = lambda n: F.coalesce(F.col(n), F.lit(0)).alias(n)
    rows = a.join(b, NS, "left").join(c, NS, "left").select(NS, "ledger_total", zero("ledger_active"), zero("fragmented_values"))
    return rows.withColumn("superseded", F.col("ledger_total") - F.col("ledger_active")).withColumn("supersession_rate", F.round(F.col("superseded") / F.col("ledger_total"), 4))


def merge_risks(active: DataFrame, granularity: str = "full") -> DataFrame:
    """Canonical keys under which two facts or more with two values or more would merge."""
    keyed = active.filter(~X.blank(F.col("slot_key")) & ~X.blank(F.col("slot_value")))
    groups = keyed.groupBy(NS, X.canonical_key(F.col("slot_key"), granularity).alias("canonical_key")).agg(F.array_sort(F.collect_set("slot_key")).alias("slot_keys"), F.array_sort(F.collect_set(X.squeezed(F.col("slot_value")))).alias("values"), F.array_sort(F.collect_list("source_turn_id")).alias("turns"), F.count("*").alias("n"))
    return groups.filter((F.col("n") >= 2) & (F.size("values") >= 2))


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """ledger_audit rows of two states by namespace: reductions and their rates, four places."""
    pairs = paired(before, after, [NS])
    cut = lambda c: F.col(f"base_{c}") - F.col(f"other_{c}")
    rate = lambda c: F.round(F.coalesce(F.try_divide(cut(c), F.col(f"base_{c}")), F.lit(0.0)), 4)
    return pairs.select(NS, F.col("base_ledger_active").alias("active_before"), F.col("other_ledger_active").alias("active_after"), cut("ledger_active").alias("active_reduction"), rate("ledger_active").alias("active_reduction_rate"), cut("fragmented_values").alias("fragmented_reduction"), rate("fragmented_values").alias("fragmented_reduction_rate"))


def delta_totals(rows: DataFrame) -> DataFrame:
    s = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(s("active_before").alias("active_before"), s("active_after").alias("active_after"), F.round(F.coalesce(F.try_divide(s("active_before") - s("active_after"), s("active_before")), F.lit(0.0)), 4).alias("active_reduction_rate"), F.count("*").alias("n_states"))


def needle_tiers(needles: DataFrame, facts: DataFrame, summaries: DataFrame, test=None) -> DataFrame:
    """needles (namespace, needle) with tier: slot or free (of a fact), summary, or absent. test(needle, text, key, value) defaults to a plain substring without regard to case."""
    plain = lambda n, t, k, v: F.contains(F.lower(t), F.lower(n))
    hit = test or plain
    f = needles.join(facts.select(NS, "seq", "text", "slot_key", "slot_value"), NS).filter(hit(F.col("needle"), F.col("text"), F.col("slot_key"), F.col("slot_value"))).groupBy(NS, "needle").agg(F.min_by(F.when(X.blank(F.col("slot_key")), "free").otherwise("slot"), "seq").alias("fact_tier"))
    none = F.lit(None).cast("string")
    s = needles.join(summaries.select(NS, "text"), NS).filter(hit(F.col("needle"), F.col("text"), none, none)).select(NS, "needle").distinct().withColumn("in_summary", F.lit(True))
    return needles.join(f, [NS, "needle"], "left").join(s, [NS, "needle"], "left").withColumn("tier", F.coalesce("fact_tier", F.when(F.col("in_summary"), "summary"), F.lit("absent"))).drop("fact_tier", "in_summary")


def failure_mode(fits: Column, hits: Column, answered: Column, answer_ok: Column) -> Column:
    return F.when(~fits, "size").when(~hits, "retrieval-recall").when(~answered, "needs-answer").when(answer_ok, "pass").otherwise("temporal-structure")


def covers_sources(groups: Column, observed: Column) -> Column:
    """Every group of gold turns meets the observed ones; null without groups."""
    return F.when(F.size(groups) > 0, F.forall(groups, lambda g: F.arrays_overlap(g, observed)))


def gold_recency(sessions: Column, answers: Column) -> Column:
    """Place of the latest gold session between 0 (oldest) and 1 (newest); 1 where there is none or one session only."""
    places = F.filter(F.transform(answers, lambda a: F.array_position(sessions, a)), lambda p: p > 0)
    return F.when((F.size(places) == 0) | (F.size(sessions) <= 1), F.lit(1.0)).otherwise((F.array_max(places) - 1) / (F.size(sessions) - 1))


def gold_turn_groups(sessions: DataFrame) -> DataFrame:
    """sessions (question_id, place, session_id, n_turns, is_gold) as (question_id, groups): one-based turn ids of each gold session."""
    before = F.coalesce(F.sum("n_turns").over(W.partitionBy("question_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ids = F.when(F.col("n_turns") > 0, F.sequence(F.col("before") + 1, F.col("before") + F.col("n_turns"))).otherwise(F.array().cast("array<bigint>"))
    gold = sessions.withColumn("before", before).filter("is_gold").withColumn("ids", ids)
    return gold.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "ids"))), lambda s: s["ids"]).alias("groups"))


def balanced_manifest(items: DataFrame, per_category: int) -> DataFrame:
    """Of each category per_category items: evidence from several sessions first, then the oldest, then by id; an error if a category has fewer."""
    order = W.partitionBy("category").orderBy(F.size("answer_session_ids") < 2, "gold_recency", "question_id")
    n = F.count("*").over(W.partitionBy("category"))
    enough = F.when(n >= per_category, F.row_number().over(order)).otherwise(F.raise_error(F.concat(F.lit("too few items of "), F.col("category"))).cast("int"))
    return items.withColumn("place", enough).filter(F.col("place") <= per_category)


def equal_signatures(left: DataFrame, right: DataFrame) -> DataFrame:
    """(equal): whether two fact tables hold the same rows, repeats included."""
    a = left.exceptAll(right).limit(1).agg(F.count("*").alias("a"))
    b = right.exceptAll(left).limit(1).agg(F.count("*").alias("b"))
    return a.crossJoin(b).select(((F.col("a") == 0) & (F.col("b") == 0)).alias("equal"))


def dev_promotion(sparse: DataFrame, candidate: DataFrame, registered: list[str], least_pass: int) -> DataFrame:
    """(evaluated, ship, candidate_pass, regressions) of exactly the registered items."""
    names = lambda d: F.array_sort(F.collect_set("qid"))  # noqa: E731, ARG005
    s, c = sparse.agg(names(sparse).alias("s")), candidate.agg(names(candidate).alias("c"))
    wanted = F.array(*[F.lit(x) for x in sorted(registered)])
    pairs = sparse.select("qid", F.col("majority_correct").alias("a")).join(candidate.select("qid", F.col("majority_correct").alias("b")), "qid").agg(F.sum(F.col("b").cast("int")).alias("candidate_pass"), F.array_sort(F.collect_list(F.when(F.col("a") & ~F.col("b"), F.col("qid")))).alias("regressions"))
    out = s.crossJoin(c).crossJoin(pairs).withColumn("evaluated", (F.col("s") == wanted) & (F.col("c") == wanted))
    return out.select("evaluated", (F.col("evaluated") & (F.col("candidate_pass") >= least_pass) & (F.size("regressions") == 0)).alias("ship"), "candidate_pass", "regressions")


def gate_rollup(checks: DataFrame) -> DataFrame:
    """checks (name, outcome pass, fail or not_applicable): passed if all that apply pass."""
    return checks.agg(F.coalesce(F.every(F.when(F.col("outcome") != "not_applicable", F.col("outcome") == "pass")), F.lit(True)).alias("passed"), F.sum((F.col("outcome") == "not_applicable").cast("long")).alias("n_not_applicable"))


def accounting_violations(runs: DataFrame) -> DataFrame:
    """Runs over budget without the overflow flag, or with candidates but no sources and no provenance flag."""
    a = (F.col("memory_tokens") > F.col("budget_tokens")) & ~F.col("context_overflow")
    b = (F.col("candidate_count") > 0) & (F.size("source_references") == 0) & ~F.col("provenance_lost")
    return runs.withColumn("violation", F.when(a, "over budget without overflow flag").when(b, "sources missing without provenance flag")).filter("violation is not null")


def results_table(stats: DataFrame, label: str = "condition") -> DataFrame:
    """sample_stats rows as lines of a Markdown table: mean and deviation."""
    return stats.select(label, F.format_string("| %s | %.3f ± %.3f | %d |", F.col(label), "mean", "stddev", F.col("n").cast("int")).alias("line"))


# --- Evidence ----------------------------------------------------------------------------------------------------


def opening(text: Column, words: int) -> Column:
    """The first words of a text, in lower case, joined by spaces."""
    return F.lower(F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, words), " "))


def opening_survives(text: Column, context: Column, words: int) -> Column:
    """A text without words has no opening to survive."""
    return (opening(text, words) != "") & F.contains(F.lower(context), opening(text, words))


def evidence_retained(gold_sessions: Column, kept_sessions: Column, golds: Column, context: Column) -> dict[str, Column]:
    """Whether evidence is left: after truncation, if a gold session was kept; after compaction, if the first six words of
    a gold turn stand in the context."""
    return {"session_retained": F.coalesce(F.arrays_overlap(gold_sessions, kept_sessions), F.lit(False)), "snippet_retained": F.exists(golds, lambda t: opening_survives(t, context, 6))}


def gold_survival(golds: Column, answer: Column, context: Column) -> dict[str, Column]:
    """Checks that do not depend on each other: gold turns, those whose first eight words stand in the context, whether
    the answer does, and how often its numbers and capitalised words do."""
    low = F.lower(context)
    salient = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit("[A-Z][a-zA-Z]+|[0-9]+"), F.lit(0)), lambda w: w.rlike("^[0-9]") | (F.length(w) > 1))))
    times = lambda w: ((F.length(low) - F.length(F.replace(low, F.lower(w), F.lit("")))) / F.length(w)).cast("long")
    return {
        "n_golds": F.size(golds), "n_survived": F.size(F.filter(golds, lambda t: opening_survives(t, context, 8))), "answer_present": F.coalesce((answer != "") & F.contains(low, F.lower(answer)), F.lit(False)),
        "salient_hits": F.transform(salient, lambda w: F.concat(w, F.lit("="), times(w).cast("string"))),
    }


def held_out_present(answer: Column, text: Column) -> Column:
    """The whole answer stands in the text, or half of its first six words of three characters or more, one at least."""
    said, low = F.lower(F.trim(answer)), F.lower(text)
    tokens = F.slice(F.filter(F.regexp_extract_all(said, F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 2), 1, 6)
    hits = F.size(F.filter(tokens, lambda t: X.holds_value(low, t)))
    return F.contains(low, said) | ((F.size(tokens) > 0) & (hits >= F.greatest(F.lit(1), F.floor(F.size(tokens) / 2))))


def role_decision(before: DataFrame, after: DataFrame, needles: DataFrame, sentinels: DataFrame, target: float = 0.5) -> DataFrame:
    """One row: values that stand under several keys in active facts before and after a rekey by roles, the share that is
    gone, whether it meets the target, all needles (namespace, needle) active before stay so, all sentinels
    (expected, found) are as expected, and the decision."""
    n = lambda facts, name: fragmentation(facts).agg(F.count("*").alias(name))
    holds = lambda facts, name: evidence(facts).withColumn(name, F.lit(True))

    def evidence(facts):
        return needles.join(facts.select(NS, "slot_value"), NS).filter(F.contains(F.lower("slot_value"), F.lower("needle"))).select(NS, "needle").distinct()

    kept = needles.join(holds(before, "was"), [NS, "needle"], "left").join(holds(after, "stays"), [NS, "needle"], "left").agg(F.bool_and(F.col("was").isNull() | F.col("stays").isNotNull()).alias("gold_preserved"))
    right = sentinels.agg(F.bool_and(F.col("expected") == F.col("found")).alias("sentinels_right"))
    rate = F.when(F.col("fragmented_before") > 0, F.round((F.col("fragmented_before") - F.col("fragmented_after")) / F.col("fragmented_before"), 4)).otherwise(0.0)
    rows = n(before, "fragmented_before").crossJoin(n(after, "fragmented_after")).crossJoin(kept).crossJoin(right)
    return rows.withColumn("reduction_rate", rate).withColumn("target_met", F.col("reduction_rate") >= target).withColumn("go", F.col("target_met") & F.col("gold_preserved") & F.col("sentinels_right"))
