"""Queries of evaluation analytics: labels as judged runs, line items as measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions import constants as C
from recollect.operators import evaluate
from recollect.plans import operations
from recollect.queries.text import QUOTED
from recollect.registry import query
from recollect.schemas import table, turns_of_conversations


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as runs: a document is a question, its parity the arm, its language the category, quality the verdict (null for every seventh)."""
    l, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")  # noqa: E741
    even = F.col("doc_id") % 2 == 0
    return l.join(d, "doc_id").select(
        F.floor(F.col("doc_id") / 2).cast("string").alias("question_id"), F.when(even, "sparse").otherwise("truncation").alias("arm"), F.lit(28000).alias("budget_tokens"), F.col("lang").alias("category"),
        F.when(F.col("doc_id") % 7 != 0, F.col("quality") == 1).alias("judged_correct"), (F.col("toxic") == 0).alias("evidence_retained"), F.col("n_chars").alias("memory_tokens"), (F.col("n_chars") / 10).alias("read_latency_ms"),
        (F.col("n_chars") > 28000).alias("context_overflow"), (F.col("doc_id") % 97 == 0).alias("provenance_lost"), "doc_id",
    )


_RUNS = "runs as (select (doc_id // 2)::varchar as question_id, case when doc_id % 2 = 0 then 'sparse' else 'truncation' end as arm, lang as category, case when doc_id % 7 <> 0 then quality = 1 end as judged_correct, toxic = 0 as evidence_retained, n_chars as memory_tokens, n_chars / 10 as read_latency_ms, n_chars > 28000 as context_overflow, doc_id % 97 = 0 as provenance_lost, doc_id from labels join documents using (doc_id))"


@query(f"with {_RUNS} select arm, avg(judged_correct::int::double) as accuracy, avg(evidence_retained::int::double) as retention, count(*) as n from runs group by arm")
def evaluate_arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1, A2."""
    return evaluate.arm_summary(_runs(spark, sf_dir))


@query(f"with {_RUNS}, k as (select arm, category as key, sum(memory_tokens)::bigint as value from runs group by all) select arm, list(struct_pack(key := key, value := value) order by key)::varchar as extraction from k group by arm")
def evaluate_telemetry_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps summed by key."""
    runs = _runs(spark, sf_dir).withColumn("extraction", F.create_map("category", "memory_tokens"))
    text = F.transform(F.array_sort(F.map_entries("extraction")), lambda e: F.concat(F.lit("{'key': "), e["key"], F.lit(", 'value': "), e["value"].cast("string"), F.lit("}")))
    return evaluate.telemetry_sums(runs).select("arm", F.concat(F.lit("["), F.array_join(text, ", "), F.lit("]")).alias("extraction"))


@query(f"with {_RUNS} select avg(evidence_retained::int::double) filter (where arm = 'truncation') as retention, avg(evidence_retained::int::double) filter (where arm = 'truncation') < 0.5 as valid from runs")
def evaluate_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4."""
    return evaluate.validity(_runs(spark, sf_dir))


REASONS = """select * from (values (1, 'Context overflow at 40k', 0, false), (2, 'fine', 2, true), (3, 'The grading is ambiguous', 0, true), (4, 'I cannot determine whether this is right', 0, false), (5, 'The model cannot determine the value', 0, true),
(6, 'An outdated value was given', 0, true), (7, 'It missed the fact', 0, true), (8, 'It missed the fact', 0, false), (9, 'no longer true', 0, false), (10, 'It missed the fact', 0, false)) as t(n, reason, failures, evidence)"""
_LOW = "lower(reason)"
_UNSURE = f"(regexp_matches({_LOW}, '{'|'.join(C.AMBIGUOUS_WORDS)}') or (regexp_matches({_LOW}, '{C.CANNOT_DETERMINE.replace(chr(39), chr(39) * 2)}') and not regexp_matches(regexp_extract(regexp_extract({_LOW}, '(?s)^(.*?){C.CANNOT_DETERMINE.replace(chr(39), chr(39) * 2)}', 1), '(?s)(.{{0,40}})$', 1), '{C.MODEL_SUBJECT}')))"
_CATEGORY = f"case when contains({_LOW}, '{C.OVERFLOW_MARKER}') then 'context_overflow' when failures > 0 then 'extraction_drop' when {_UNSURE} then 'judge_ambiguity' when regexp_matches({_LOW}, '{'|'.join(C.STALE_MARKERS)}') then 'stale_ghost' when evidence then 'answerer_failure' else 'summary_loss' end"


def _misses(spark: SparkSession) -> DataFrame:
    return spark.sql(REASONS).select(F.col("n").alias("seq"), evaluate.miss_category(F.col("reason"), F.col("failures"), F.col("evidence"), F.lit(True)).alias("category"))


@query(f"select n as seq, {_CATEGORY} as category from ({REASONS})")
def evaluate_miss_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S25."""
    return _misses(spark)


@query(f"with m as (select n as seq, {_CATEGORY} as category from ({REASONS})), c as (select unnest([{QUOTED(C.MISS_CATEGORIES)}]) as category), k as (select c.category, count(m.seq) as n, min(m.seq) as first_seq from c left join m using (category) group by c.category) select category, n, row_number() over (order by n desc, first_seq nulls last) = 1 and n > 0 as dominant from k")
def evaluate_miss_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5."""
    return evaluate.miss_histogram(_misses(spark))


@query(f"select category, case category {' '.join(f'when {chr(39)}{k}{chr(39)} then {chr(39)}{v}{chr(39)}' for k, v in evaluate.RECOMMENDATIONS.items())} end as recommendation from (select unnest([{QUOTED(C.MISS_CATEGORIES)}]) as category)")
def evaluate_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S26."""
    names = spark.createDataFrame([(c,) for c in C.MISS_CATEGORIES], "category string")
    return names.select("category", evaluate.recommendation(F.col("category")).alias("recommendation"))


_ANSWERS = "answers as (select (doc_id // 3)::varchar as qid, lang as qtype, quality = 1 as correct from labels join documents using (doc_id)), items as (select qid, min(qtype) as qtype, count(*) as reps, sum(correct::int)::bigint as n_correct, 2 * sum(correct::int) > count(*) as majority_correct, sum(correct::int) / count(*) as rate from answers group by qid)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").select(F.floor(F.col("doc_id") / 3).cast("string").alias("qid"), "lang", (F.col("quality") == 1).alias("correct"))
    kinds = rows.groupBy("qid").agg(F.min("lang").alias("qtype"))
    return evaluate.majority(rows, ["qid"]).join(kinds, "qid")


@query(f"with {_ANSWERS} select qid, reps, n_correct, majority_correct, rate from items")
def evaluate_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13."""
    return _items(spark, sf_dir).select("qid", "reps", "n_correct", "majority_correct", "rate")


@query(f"with {_ANSWERS} select qtype, count(*) as n_items, sum(majority_correct::int)::bigint as majority_pass, round(avg(majority_correct::int::double), 3) as pass_rate, round(avg(rate), 3) as mean_rep_rate, round(stddev_pop(rate), 3) as rep_rate_spread from items group by qtype")
def evaluate_gate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passes and spread by question type."""
    return evaluate.gate_summary(_items(spark, sf_dir), ["qtype"])


@query("select l_returnflag, count(l_extendedprice) as n, round(avg(l_extendedprice), 3) as mean, round(coalesce(stddev_samp(l_extendedprice), 0), 3) as stddev, round(min(l_extendedprice), 3) as least, round(max(l_extendedprice), 3) as greatest from lineitem group by all")
def evaluate_sample_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16."""
    return evaluate.sample_stats(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])


@query("with m as (select l_returnflag, l_linenumber, avg(l_quantity) as v from lineitem group by all), b as (select l_returnflag, v as base from m where l_linenumber = 1) select l_returnflag, l_linenumber, v as mean, base, round((base - v) * 100 / base, 3) as loss_pct from m join b using (l_returnflag) where l_linenumber <> 1")
def evaluate_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cent lost against the baseline's mean."""
    return evaluate.loss_against_baseline(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linenumber", 1, "l_quantity").select("l_returnflag", "l_linenumber", "mean", "base", "loss_pct")


RATES = {"light": 10.0, "typical": 30.0, "busy": 60.0}
_SAMPLES = "s as (select l_quantity * 100 as absorbed_tokens, l_extendedprice / 1000 as wall_s, l_quantity * 10 as summary_tokens, l_linenumber <> 7 as compacted from lineitem)"


@query(
    f"""with {_SAMPLES}, a as (select count(*) as n_calls, sum(compacted::int)::bigint as n_compacted, sum(absorbed_tokens) / sum(wall_s) as drain, round(median(wall_s), 3) as wall_median, round(max(wall_s), 3) as wall_max, sum(absorbed_tokens) filter (where compacted) as absorbed, sum(summary_tokens) filter (where compacted) as produced from s),
r as (select unnest(['light', 'typical', 'busy']) as rate_name, unnest([10.0, 30.0, 60.0]::double[]) as rate)
select rate_name, n_calls, n_compacted, n_calls - n_compacted as n_fallback, round(drain, 2) as drain, wall_median, wall_max, round(absorbed / produced, 2) as compression, drain >= rate as keeps_up, round(drain / rate, 2) as headroom from a, r"""
)
def evaluate_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18."""
    own = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 100).alias("absorbed_tokens"), (F.col("l_extendedprice") / 1000).alias("wall_s"), (F.col("l_quantity") * 10).alias("summary_tokens"), (F.col("l_linenumber") != 7).alias("compacted"))
    return evaluate.throughput(own, RATES).select("rate_name", "n_calls", "n_compacted", "n_fallback", "drain", "wall_median", "wall_max", "compression", "keeps_up", "headroom")


@query("select l_shipmode, quantile_disc(l_extendedprice, 0.95) as p95 from (select *, l_returnflag || l_linestatus as l_shipmode from lineitem) group by all")
def evaluate_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentile."""
    rows = table(spark, sf_dir, "lineitem").withColumn("l_shipmode", F.concat("l_returnflag", "l_linestatus"))
    return evaluate.order_statistics(rows, "l_extendedprice", ["l_shipmode"], evaluate.P95).select("l_shipmode", F.col("value").alias("p95"))


@query(f"with {_RUNS} select arm, category, round(avg(judged_correct::int::double), 4) as accuracy, count(*) as n from runs where judged_correct is not null group by all")
def evaluate_category_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20."""
    return evaluate.category_accuracy(_runs(spark, sf_dir))


_PAIRS = f"{_RUNS}, p as (select a.question_id, a.category, b.judged_correct::int - a.judged_correct::int as delta from runs a join runs b on a.question_id = b.question_id and a.arm = 'truncation' and b.arm = 'sparse')"


def _paired(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    runs = _runs(spark, sf_dir)
    return runs.filter("arm = 'truncation'").drop("arm"), runs.filter("arm = 'sparse'").drop("arm")


@query(f"with {_PAIRS} select category, count(*) filter (where delta > 0) as wins, count(*) filter (where delta < 0) as regressions, coalesce(sum(delta), 0)::bigint as delta from p group by category")
def evaluate_sign_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wins and regressions by category."""
    pairs = evaluate.paired(*_paired(spark, sf_dir), ["question_id"]).withColumn("category", F.col("base_category"))
    return evaluate.sign_counts(pairs, ["category"])


@query(f"with {_RUNS} select question_id, case when bool_or(arm = 'sparse') then 'other' else 'base' end as side from runs group by question_id having count(distinct arm) = 1")
def evaluate_uncovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that one arm alone has."""
    return evaluate.uncovered(*_paired(spark, sf_dir), ["question_id"])


@query(
    f"""with {_PAIRS}, s as (select count(*) filter (where delta > 0) as wins, count(*) filter (where delta < 0) as regressions from p), w as (select min(d) as worst from (select coalesce(sum(delta), 0) as d from p group by category)),
o as (select bool_and(memory_tokens <= 28000) as within_token_budgets, quantile_disc(read_latency_ms, 0.95) as p95, not bool_or(context_overflow) as no_context_overflow, not bool_or(provenance_lost) as no_provenance_loss from runs where arm = 'sparse'),
c as (select *, wins - regressions >= 3 as three_more_wins, worst >= -1 as category_regression_at_most_one, p95 <= 1000 as p95_within_limit from s, w, o)
select wins, regressions, p95, three_more_wins, category_regression_at_most_one, within_token_budgets, p95_within_limit, no_context_overflow, no_provenance_loss, three_more_wins and category_regression_at_most_one and within_token_budgets and p95_within_limit and no_context_overflow and no_provenance_loss as promote from c"""
)
def evaluate_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A22."""
    return evaluate.promotion(*_paired(spark, sf_dir))


_MATRIX = "observed as (select question_id, arm, case when doc_id % 5 = 0 then 999 else 28000 end as budget_tokens from runs), expected as (select distinct question_id, a as arm, 28000 as budget_tokens from runs, (select unnest(['sparse', 'truncation']) as a))"


@query(
    f"""with {_RUNS}, {_MATRIX} select e.question_id, e.arm, e.budget_tokens, 'missing' as problem from expected e where not exists (select 1 from observed o where o.question_id = e.question_id and o.arm = e.arm and o.budget_tokens = e.budget_tokens)
union all select o.question_id, o.arm, o.budget_tokens, 'unexpected' from observed o where o.budget_tokens = 999"""
)
def evaluate_matrix_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run matrix lacks, repeats or has too much."""
    runs = _runs(spark, sf_dir)
    observed = runs.select("question_id", "arm", F.when(F.col("doc_id") % 5 == 0, 999).otherwise(28000).alias("budget_tokens"))
    return evaluate.coverage(evaluate.expected_matrix(runs.select("question_id").distinct(), ["sparse", "truncation"], [28000]), observed, ["question_id", "arm", "budget_tokens"])


@query(f"with {_RUNS} select question_id, arm, case when exists (select 1 from runs b where b.question_id = a.question_id and b.arm = 'sparse') then 'reused' else 'fresh' end as origin from runs a where arm = 'truncation'")
def evaluate_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that need not be asked for again."""
    base, other = _paired(spark, sf_dir)
    keys = other.select("question_id").distinct()
    old = base.join(keys, "question_id", "left_semi").withColumn("origin", F.lit("reused"))
    new = base.join(keys, "question_id", "left_anti").withColumn("origin", F.lit("fresh"))
    return old.unionByName(new).select("question_id", F.lit("truncation").alias("arm"), "origin")


@query("select lang, count(*) as total, count(*) filter (where source <> '' and n_chars > 1000) as complete, count(*) - count(*) filter (where source <> '' and n_chars > 1000) as missing, count(*) filter (where source <> '' and n_chars > 1000) / count(*) as coverage from documents group by lang")
def evaluate_field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A25, PF13: rows with all fields."""
    rows = table(spark, sf_dir, "documents").withColumn("long", F.when(F.col("n_chars") > 1000, "yes"))
    return evaluate.field_coverage(rows, ["source", "long"], ["lang"])


_RECORDS = "r as (select doc_id::varchar as question_id, case when doc_id % 11 = 0 then 'other.json' else doc_id || '_state.json' end as state_file, doc_id % 13 = 0 as in_progress, doc_id % 17 <> 0 as present, doc_id % 19 <> 0 as loadable, lang = 'en' as needs, n_chars < 500 as bad from documents)"


@query(
    f"""with {_RECORDS} select question_id, case when in_progress then 'in_progress' when not present then 'missing' when state_file = 'other.json' or not loadable or (needs and bad) then 'invalid' else 'valid' end as status,
case when in_progress or not present then 0 else (state_file = 'other.json')::int + (not loadable)::int + (needs and bad)::int end as n_errors, case when in_progress or not present then 0 else (not needs and bad)::int end as n_warnings from r"""
)
def evaluate_capture_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which captured states are valid, and what is wrong with the others."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    records = d.select(
        n.cast("string").alias("question_id"), F.when(n % 11 == 0, "other.json").otherwise(F.concat(n.cast("string"), F.lit("_state.json"))).alias("state_file"), (n % 13 == 0).alias("in_progress"), (n % 17 != 0).alias("exists"),
        (n % 19 != 0).alias("loadable"), F.lit(None).cast("string").alias("embedded_id"), F.when(F.col("n_chars") < 500, F.array(F.lit("facts"))).otherwise(F.array().cast("array<string>")).alias("incomplete_tiers"),
        F.array().cast("array<string>").alias("missing_capture"), F.lit(0).alias("extraction_failures"), (F.col("lang") == "en").alias("needs_provenance"),
    )
    return evaluate.capture_report(records).select("question_id", "status", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"))


_ABSTAIN = "(?i)(?:" + "|".join(C.ABSTENTIONS).replace("'", "''") + ")"
SAID = """select * from (values (1, 'I cannot determine it', 'an older value'), (2, 'It is five', 'right'), (3, 'Not enough context here', 'stale'), (4, 'I do not know', 'previous'), (5, 'Memory does not mention it', 'fine')) as t(n, answer, reason)"""


@query(f"select n, regexp_matches(answer, '{_ABSTAIN}') as abstains, regexp_matches(reason, '(?i){C.STALE_REASON}') as stale from ({SAID})")
def evaluate_abstentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S27."""
    return spark.sql(SAID).select("n", evaluate.abstains(F.array("answer")).alias("abstains"), evaluate.stale_failure(F.lit(False), F.array("reason")).alias("stale"))


_JUDGED = """judged as (select d.doc_id, d.source, n_chars <= 1500 as fits, contains(text, 'the') as hits, l.doc_id is not null as answered, coalesce(l.quality = 1, false) as ok, coalesce(l.toxic = 0, false) as clean from documents d left join labels l using (doc_id))"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items: whether they fit, hold a needle, have an answer (a label), and a right one (its quality)."""
    d, own = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    met = d.join(own, "doc_id", "left")
    flags = {"fits": F.col("n_chars") <= 1500, "hits": F.contains("text", F.lit("the")), "answered": F.col("quality").isNotNull(), "ok": F.coalesce(F.col("quality") == 1, F.lit(False)), "clean": F.coalesce(F.col("toxic") == 0, F.lit(False))}
    return met.select("doc_id", "source", *[c.alias(name) for name, c in flags.items()])


@query(f"with {_JUDGED} select doc_id, case when not fits then 'size' when not hits then 'retrieval-recall' when not answered then 'needs-answer' when ok then 'pass' else 'temporal-structure' end as mode from judged")
def evaluate_failure_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A32, PF11: the failure mode of each item."""
    return _judged(spark, sf_dir).select("doc_id", evaluate.failure_mode(F.col("fits"), F.col("hits"), F.col("answered"), F.col("ok")).alias("mode"))


@query("select (select count(*) from (select doc_id, quality from labels except all select doc_id, quality from labels where toxic = 0)) = 0 as equal")
def evaluate_equal_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two fact tables are the same."""
    own = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return evaluate.equal_signatures(own, table(spark, sf_dir, "labels").filter("toxic = 0").select("doc_id", "quality"))


@query(f"with {_RUNS} select question_id, arm, case when memory_tokens > 28000 and not false then 'over budget without overflow flag' end as violation from runs where memory_tokens > 28000")
def evaluate_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF14: runs that break the accounting rules."""
    runs = _runs(spark, sf_dir).withColumn("context_overflow", F.lit(False)).withColumn("candidate_count", F.lit(0)).withColumn("source_references", F.array().cast("array<string>"))
    return evaluate.accounting_violations(runs).select("question_id", "arm", "violation")


@query("select l_returnflag, '| ' || l_returnflag || ' | ' || printf('%.3f', round(avg(l_quantity), 3)) || ' ± ' || printf('%.3f', round(stddev_samp(l_quantity), 3)) || ' | ' || count(*) || ' |' as line from lineitem group by l_returnflag")
def evaluate_results_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown table of results."""
    stats = evaluate.sample_stats(table(spark, sf_dir, "lineitem"), "l_quantity", ["l_returnflag"])
    return evaluate.results_table(stats, "l_returnflag")


_REGISTERED = [f"src{i}" for i in range(20)]


@query(
    f"""with {_JUDGED}, m as (select source as qid, 2 * sum(ok::int) > count(*) as a, 2 * sum(clean::int) > count(*) as b from judged where answered group by source),
wanted as (select 'src' || unnest(range(20)) as qid) select (select list(qid order by qid) from m) = (select list(qid order by qid) from wanted) as evaluated,
(select list(qid order by qid) from m) = (select list(qid order by qid) from wanted) and sum(b::int) >= 5 and count(*) filter (where a and not b) = 0 as ship, sum(b::int)::bigint as candidate_pass, coalesce(list(qid order by qid) filter (where a and not b), []) as regressions from m"""
)
def evaluate_dev_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate against the registered items: sources by the majority of their labels, quality against absence of toxicity."""
    answers = _judged(spark, sf_dir).filter("answered").withColumnRenamed("source", "qid")
    sparse, candidate = (evaluate.majority(answers.withColumn("correct", F.col(c)), ["qid"]) for c in ("ok", "clean"))
    return evaluate.dev_promotion(sparse, candidate, _REGISTERED, 5)


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turns_of_conversations(spark, sf_dir).select("namespace", "turn_id", "role", "content", "tokens")
    return operations.checked(spark, turns)


_CHECKED = """t as (select conv_id, count(*) as n, sum(case when length(text) = 0 then 0 else greatest(1, length(text) // 4) end) as tokens from conversations group by conv_id),
done as (select 'restart' as name, sum(n) as n_rows from t union all select 'replay', sum(n) from t union all select 'failed_commit', sum(n) from t union all select 'rollback', sum(n) from t)"""


@query(f"with {_CHECKED} select name, case when n_rows > 0 then 'pass' end as outcome, n_rows::bigint as n_rows from done")
def operations_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Restart, replay, a commit that fails half way, and rollback, over all turns; the compaction that fails is in evaluate_gate_rollup."""
    return _operations(spark, sf_dir).filter("name not in ('failed_compaction', 'hardware')")


@query(f"with {_CHECKED} select bool_and(n_rows > 0) as passed, 1::bigint as n_not_applicable from done")
def evaluate_gate_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether all operational checks that apply pass, from their runs."""
    return evaluate.gate_rollup(_operations(spark, sf_dir))


CONFIRM_LIMITS = {"minimum_wins": 3, "item_regressions": 0, "category_regressions": 0, "abstentions": 0, "stale_failures": 0, "source_losses": 0, "empty_retrievals": 0}
_WINS = "case when id % 2 = 0 then arm = 'candidate' else true end"


@query(
    """select true as manifest_matches_frozen_suite, true as run_metadata_matches_frozen_protocol, true as exact_full_matrix, true as categories_match_manifest, true as primary_scores_complete, count(*) filter (where doc_id % 2 = 0) >= 3 as minimum_primary_wins, true as no_item_regressions,
true as no_category_regression, true as no_new_abstentions, true as no_new_stale_failures, true as no_gold_source_loss, true as no_write_recall_loss, true as write_recall_measured, true as no_empty_retrieval_regression, true as no_run_errors, true as within_context_budgets, true as no_provenance_loss,
true as temporal_provenance_complete, quantile_disc(n_chars / 10, 0.95) <= 1000 as candidate_latency_within_limit,
case when count(*) filter (where doc_id % 2 = 0) >= 3 and quantile_disc(n_chars / 10, 0.95) <= 1000 then 'promote-experimental-candidate' else 'keep-safe-sparse' end as status from documents"""
)
def evaluate_confirmation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nineteen checks of a frozen confirmation; every document is an item, and the candidate wins the even ones."""
    d = table(spark, sf_dir, "documents")
    items = d.select(F.col("doc_id").cast("string").alias("question_id"), F.col("lang").alias("category"))
    ref = F.array(F.create_map(F.lit("session_id"), F.lit("s"), F.lit("timestamp"), F.lit("t")))
    runs = d.select(
        F.col("doc_id").cast("string").alias("question_id"), F.explode(F.array(F.lit("safe"), F.lit("candidate"))).alias("arm"), F.lit(28000).alias("budget_tokens"), F.col("lang").alias("category"), "doc_id",
        F.array(F.lit("It is five")).alias("model_answers"), F.array(F.lit("right")).alias("judge_reasons"), F.lit(True).alias("read_recall"), F.lit(True).alias("write_recall"), F.lit(1).alias("candidate_count"), (F.col("n_chars") / 10).alias("read_latency_ms"),
        F.lit(100).alias("memory_tokens"), F.lit(False).alias("context_overflow"), F.lit(False).alias("provenance_lost"), F.lit(None).cast("string").alias("error"), ref.alias("source_references"),
    ).withColumn("judged_correct", (F.col("doc_id") % 2 != 0) | (F.col("arm") == "candidate"))
    return evaluate.confirmation(runs, items, "safe", "candidate", [28000], 28000, CONFIRM_LIMITS, ["en"])


_VIEWS = """turns as (select conv_id::varchar as namespace, turn + 1 as turn_id, role, text as content, 's' || (turn // 4) as session_id from conversations),
kept as (select namespace, list(distinct session_id) as kept, string_agg(content, chr(10) order by turn_id) as context from (select *, max(turn_id) over (partition by namespace) as last from turns) where turn_id > last - 4 group by namespace),
gold as (select namespace, list(content order by turn_id) as golds, substr(first(content order by turn_id), 1, 24) as answer from turns where session_id = 's0' group by namespace)"""
_OPENING = lambda t, n: f"lower(array_to_string(list_filter(string_split_regex({t}, '\\s+'), lambda w: w <> '')[1:{n}], ' '))"
_SURVIVES = lambda n: f"len(list_filter(golds, lambda t: length({_OPENING('t', n)}) > 0 and contains(lower(context), {_OPENING('t', n)})))"


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with the turns of their first session as gold, its beginning as the answer, and the last four turns as what is kept."""
    turns = turns_of_conversations(spark, sf_dir)
    last = turns.withColumn("last", F.max("turn_id").over(W.partitionBy("namespace"))).filter("turn_id > last - 4")
    said = lambda: F.transform(F.array_sort(F.collect_list(F.struct("turn_id", "content"))), lambda t: t["content"])
    kept = last.groupBy("namespace").agg(F.collect_set("session_id").alias("kept"), F.array_join(said(), "\n").alias("context"))
    gold = turns.filter("session_id = 's0'").groupBy("namespace").agg(said().alias("golds")).withColumn("answer", F.substring(F.element_at("golds", 1), 1, 24))
    return gold.join(kept, "namespace")


@query(f"with {_VIEWS} select namespace, list_contains(kept, 's0') as session_retained, {_SURVIVES(6)} > 0 as snippet_retained from gold join kept using (namespace)")
def evaluate_evidence_retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a conversation's first session when its last four turns are kept."""
    checks = evaluate.evidence_retained(F.array(F.lit("s0")), F.col("kept"), F.col("golds"), F.col("context"))
    return _evidence(spark, sf_dir).select("namespace", *[c.alias(name) for name, c in checks.items()])


@query(
    f"""with {_VIEWS}, s as (select *, list_sort(list_distinct(list_filter(regexp_extract_all(answer, '[A-Z][a-zA-Z]+|[0-9]+'), lambda w: regexp_matches(w, '^[0-9]') or length(w) > 1))) as salient from gold join kept using (namespace))
select namespace, len(golds)::int as n_golds, {_SURVIVES(8)}::int as n_survived, answer <> '' and contains(lower(context), lower(answer)) as answer_present,
  list_transform(salient, lambda w: w || '=' || ((length(context) - length(replace(lower(context), lower(w), ''))) // length(w))) as salient_hits from s"""
)
def evaluate_gold_survival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent checks of what survived."""
    checks = evaluate.gold_survival(F.col("golds"), F.col("answer"), F.col("context"))
    return _evidence(spark, sf_dir).select("namespace", *[c.alias(name) for name, c in checks.items()])


@query(
    f"""with {_VIEWS}, a as (select namespace, lower(trim(answer)) as said, lower(context) as low from gold join kept using (namespace)),
t as (select *, list_filter(regexp_extract_all(said, '[a-z0-9]+'), lambda x: length(x) > 2)[1:6] as tokens from a)
select namespace, contains(low, said) or (len(tokens) > 0 and len(list_filter(tokens, lambda x: list_contains(regexp_extract_all(low, '[\\p{{L}}\\p{{N}}_]+'), x))) >= greatest(1, len(tokens) // 2)) as present from t"""
)
def evaluate_held_out_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an answer is present, loosely."""
    return _evidence(spark, sf_dir).select("namespace", evaluate.held_out_present(F.col("answer"), F.col("context")).alias("present"))
