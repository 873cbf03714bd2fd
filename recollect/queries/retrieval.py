"""Queries of retrieval, over documents as summaries of their source and benchmark passages as requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import constants as C
from recollect.functions import text as X
from recollect.operators import families, ledger, retrieval
from recollect.plans import serve
from recollect.queries.text import question_mode, retrieval_tokens, temporal
from recollect.queries.views import FACTS, LEDGER, SUMMARIES, TURNS, count_tokens
from recollect.registry import query
from recollect.schemas import FACT, conforming, facts_of_events, queries_of_benchmark, summaries_of_documents, table, turns_of_conversations

NS = "namespace"


def _no_facts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FACT)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One turn for each source, so that requests have something to keep."""
    one = table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return one.select(F.col("source").alias(NS), F.lit(1).cast("long").alias("turn_id"), F.lit("user").alias("role"), F.concat(F.lit("documents: "), F.col("n").cast("string")).alias("content"), F.lit(None).cast("string").alias("session_id"), F.lit(None).cast("string").alias("ts"))


_CANDS = f"""{SUMMARIES}, c as (select namespace, seq, turn_id, text, {count_tokens("('- ' || text)")} as cost, {retrieval_tokens('text')} as tokens from summaries),
q as (select item_id::varchar as query_id, 'src' || (item_id % 20) as namespace, text as query, {retrieval_tokens('text')} as tokens from benchmark),
sizes as (select namespace, count(*) as n, max(turn_id) as last_turn from c group by namespace),
posted as (select namespace, seq, unnest(tokens) as token from c), df as (select namespace, token, count(*) as df from posted group by all)"""
_SCORES = f"""{_CANDS}, asked as (select query_id, namespace, unnest(tokens) as token from q),
lex as (select a.query_id, a.namespace, p.seq, sum(ln(1 + (s.n + 1) / (d.df + 1))) as lexical, count(*) as n_shared from asked a join posted p using (namespace, token) join df d using (namespace, token) join sizes s using (namespace) group by all),
scores as (select l.query_id, l.namespace, l.seq, c.turn_id, c.text, c.cost, round(l.lexical + c.turn_id / s.last_turn * 0.001, 9) as score, l.n_shared from lex l join c using (namespace, seq) join sizes s using (namespace))"""
_BUDGET = f"""t as (select source as namespace, 'USER: documents: ' || count(*) as joined from documents group by source),
b as (select query_id, q.namespace, greatest(0, 1500 - {count_tokens('query')} - 768 - {count_tokens('joined')})::bigint as available from q left join t on t.namespace = q.namespace)"""


@query(f"with {_CANDS} select namespace, token, df from df")
def retrieval_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    cands = retrieval.candidates(_no_facts(spark), summaries_of_documents(spark, sf_dir)).filter("not history")
    return retrieval.document_frequency(cands).select(NS, "token", "df")


@query(f"with {_SCORES} select query_id, seq, round(score, 6) as score, n_shared from scores")
def retrieval_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all candidates that share a word with a request."""
    cands = retrieval.candidates(_no_facts(spark), summaries_of_documents(spark, sf_dir))
    return retrieval.scored(queries_of_benchmark(spark, sf_dir), cands, matching_only=True).select("query_id", F.col("item_seq").alias("seq"), F.round("score", 6).alias("score"), "n_shared")


@query(f"with {_SCORES}, {_BUDGET} select query_id, available from b")
def retrieval_available_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8."""
    return retrieval.available_budget(queries_of_benchmark(spark, sf_dir), _turns(spark, sf_dir)).select("query_id", "available")


_FOLD = """ranked as (select *, row_number() over (partition by query_id order by {order}) as place from {rows}),
fold as (select query_id, list(struct_pack(place := place, cost := cost) order by place) as items, any_value(available) as available from ranked group by query_id),
taken as (select query_id, unnest(list_filter(list_transform(range(1, len(items) + 1), lambda i: case when flags[i] then items[i].place end), lambda x: x is not null)) as place from
  (select query_id, items, string_split(list_reduce(list_prepend(struct_pack(place := 0::bigint, cost := available, f := ''), list_transform(items, lambda x: struct_pack(place := x.place, cost := x.cost, f := ''))),
    lambda a, x: struct_pack(place := x.place, cost := case when x.cost <= a.cost then a.cost - x.cost else a.cost end, f := a.f || case when x.cost <= a.cost then '1' else '0' end)).f, '') as bits, [b = '1' for b in bits] as flags from fold))"""


@query(
    f"with {_SCORES}, {_BUDGET}, best as (select * from (select s.*, b.available, row_number() over (partition by s.query_id order by score desc, turn_id desc, text, seq) as r from scores s join b using (query_id) where score > 0.01) where r <= 24), "
    + _FOLD.format(order="score desc, turn_id desc, text, seq", rows="best")
    + " select query_id, seq, turn_id, row_number() over (partition by query_id order by turn_id, text, seq) as position from ranked join taken using (query_id, place)"
)
def retrieval_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4, K5, K12, PF7: the serving selection: floor, best 24, skip-fit, in the order of time."""
    chosen = retrieval.sparse_selection(queries_of_benchmark(spark, sf_dir), _no_facts(spark), summaries_of_documents(spark, sf_dir), _turns(spark, sf_dir))
    return chosen.select("query_id", F.col("item_seq").alias("seq"), "turn_id", "position")


_ALL = f"""{_SCORES}, {_BUDGET}, every as (select q.query_id, c.seq, c.turn_id, c.text, c.cost, round(coalesce(l.lexical, 0) + c.turn_id / z.last_turn * 0.001, 9) as score, b.available from q join c using (namespace) join sizes z using (namespace) join b using (query_id) left join lex l on l.query_id = q.query_id and l.seq = c.seq)"""


@query(f"with {_ALL}, " + _FOLD.format(order="score desc, turn_id desc, text, seq", rows="every") + " select query_id, seq from ranked join taken using (query_id, place)")
def retrieval_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K2: all candidates by score, skip-fit."""
    chosen = retrieval.lexical_selection(queries_of_benchmark(spark, sf_dir), _no_facts(spark), summaries_of_documents(spark, sf_dir), _turns(spark, sf_dir))
    return chosen.select("query_id", F.col("item_seq").alias("seq"))


@query(f"with {_ALL}, " + _FOLD.format(order="round(score / greatest(1, cost), 9) desc, score desc, turn_id desc, text, seq", rows="every") + " select query_id, seq from ranked join taken using (query_id, place)")
def retrieval_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: by score per token."""
    chosen = retrieval.packed_selection(queries_of_benchmark(spark, sf_dir), _no_facts(spark), summaries_of_documents(spark, sf_dir), _turns(spark, sf_dir))
    return chosen.select("query_id", F.col("item_seq").alias("seq"))


_LINE = "'- [entity] ' || text || ' (Turn ' || source_turn_id || ')'"


@query(
    f"with {LEDGER}, rows_ as (select namespace as query_id, 1 as tier, slot_key as tie1, text as tie2, seq, source_turn_id as turn_id, {count_tokens('(' + _LINE + ')')} as cost, 4000 - 768 - {count_tokens(chr(39) + 'what now' + chr(39))} as available from newest), "
    + _FOLD.format(order="tier, turn_id desc, tie1, tie2, seq", rows="rows_")
    + " select query_id, seq from ranked join taken using (query_id, place)"
)
def retrieval_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: without a score, the newest fact of each slot first."""
    own = ledger.closed_form(facts_of_events(spark, sf_dir))
    asked = own.select(NS).distinct().select(F.col(NS).alias("query_id"), NS, F.lit("what now").alias("query"), F.lit(4000).cast("long").alias("budget_tokens"))
    summaries = summaries_of_documents(spark, sf_dir)
    return retrieval.recency_selection(asked, own, summaries, _turns(spark, sf_dir)).select("query_id", F.col("item_seq").alias("seq"))


@query(f"with {TURNS}, r as (select namespace, turn_id, sum({count_tokens('(upper(role) || chr(58) || chr(32) || content)')}) over (partition by namespace order by turn_id desc) as running from turns) select namespace, turn_id, running::bigint as running from r where running <= 300")
def retrieval_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: the newest turns up to a budget."""
    return retrieval.truncate_fit(turns_of_conversations(spark, sf_dir), 300).select(NS, "turn_id", F.col("running").cast("long").alias("running"))


@query(
    f"with rows_ as (select source as query_id, doc_id as seq, {count_tokens(chr(40) + chr(39) + '- ' + chr(39) + ' || text' + chr(41))} as cost, 5000 as available from documents), "
    + _FOLD.format(order="seq", rows="rows_")
    + " select query_id as namespace, seq from ranked join taken using (query_id, place)"
)
def retrieval_packed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K7: texts in order, as far as each still fits."""
    texts = table(spark, sf_dir, "documents").select(F.col("source").alias(NS), F.col("doc_id").alias("seq"), "text")
    return retrieval.packed_texts(texts, 5000).select(NS, "seq")


@query(f"with {FACTS} select namespace, seq from (select *, row_number() over (partition by namespace, slot_key, 'event ' || event_type order by source_turn_id desc, seq) as r from (select f.*, e.event_type from facts f join e using (namespace, seq))) where r = 1")
def retrieval_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal texts the newest; here the event number is left out of the text."""
    own = facts_of_events(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"\d+", " "))
    return retrieval.deduplicated(own).select(NS, "seq")


@query(
    f"""with {LEDGER}, {TURNS}, {SUMMARIES} select 'fact' as kind, namespace, 'fact:' || seq as source_id, [source_turn_id] as turn_ids, 'status=' || status as metadata from ledger
union all select 'summary', namespace, 'summary:' || seq, [turn_id], '' from summaries union all select 'turn', namespace, 'turn:' || turn_id, [turn_id], 'session_id=' || session_id from turns"""
)
def retrieval_source_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provenance of facts, summaries and turns."""
    refs = retrieval.source_references(ledger.closed_form(facts_of_events(spark, sf_dir)), summaries_of_documents(spark, sf_dir), turns_of_conversations(spark, sf_dir))
    return refs.withColumn("metadata", F.array_join(F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))


@query(f"select item_id::varchar as query_id, {question_mode('text')} as mode, {temporal('text')} as temporal from benchmark")
def retrieval_request_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R7, R9 over all requests."""
    return queries_of_benchmark(spark, sf_dir).select("query_id", X.question_mode(F.col("query")).alias("mode"), X.is_temporal(F.col("query")).alias("temporal"))


@query()
def retrieval_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mode, evidence and tokens of each request."""
    return serve.recall(queries_of_benchmark(spark, sf_dir), _no_facts(spark), summaries_of_documents(spark, sf_dir), _turns(spark, sf_dir))


def _requests(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = ledger.closed_form(facts_of_events(spark, sf_dir))
    worded = own.withColumn("slot_key", F.when(F.col("seq") % 2 == 0, F.concat("slot_key", F.lit(".count"))).otherwise(F.concat("slot_key", F.lit(".number of")))).withColumn("slot_value", F.regexp_replace("slot_value", "v", "1"))
    modes = F.array(F.lit("user click count event"), F.lit("previous user click count event"), F.lit("how did the user click count event change"))
    asked = own.select(NS).distinct().select(F.col(NS).alias("query_id"), NS, F.element_at(modes, (F.pmod(F.col(NS).cast("int"), F.lit(3)) + 1)).alias("query"), F.lit(C.READ_FIT_TOKENS).cast("long").alias("budget_tokens"))
    return retrieval.scored(asked, retrieval.candidates(conforming(worded, FACT), summaries_of_documents(spark, sf_dir).limit(0))), asked


@query()
def retrieval_newest_by_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest value within a role group."""
    return families.prefer_newest(_requests(spark, sf_dir)[0], "role").select("query_id", F.col("item_seq").alias("seq"), F.round("score", 6).alias("score"))


@query()
def retrieval_newest_by_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4, ID8: the newest value within a slot family, across keys."""
    return families.prefer_newest(_requests(spark, sf_dir)[0], "cross_key").select("query_id", F.col("item_seq").alias("seq"), F.round("score", 6).alias("score"))


@query()
def retrieval_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier and latest values of a family told as a sequence, for requests that ask for the previous value or the change."""
    return families.sequence_texts(_requests(spark, sf_dir)[0]).select("query_id", F.col("item_seq").alias("seq"), "text")
