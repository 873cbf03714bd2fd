"""Queries of request logs, external memories and streams with keyed state, over conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.providers import stub_extract
from recollect.queries.memory import _stream
from recollect.queries.retrieval import _FOLD
from recollect.queries.views import TURNS, count_tokens
from recollect.registry import query
from recollect.schemas import turns_of_conversations
from recollect.sources import external, requests
from recollect.sources.scratch import scratch_path, written

NS = "namespace"
HIGH, LOW, REFUSED = 300, 150, "the"


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clients send: after every second turn and the last one, the last six messages."""
    turns = turns_of_conversations(spark, sf_dir)
    last = W.partitionBy(NS).orderBy("turn_id")
    said = F.collect_list(F.struct("role", "content")).over(last.rowsBetween(-5, 0))
    ends = F.lead("turn_id").over(last).isNull()
    return turns.select(NS, F.col("turn_id").alias("sent"), said.alias("messages"), ends.alias("ends")).filter("ends or sent % 2 = 0").drop("ends")


def _logged(spark: SparkSession, sf_dir: str) -> str:
    """Those views as a request log, with requests to other paths and lines that are none among them."""
    path = scratch_path(spark, "requests")
    body = F.struct(F.col(NS).alias("user"), "messages")
    lines = _views(spark, sf_dir).select(F.to_json(F.struct(F.lit(requests.ENDPOINT).alias("path"), "sent", body.alias("body"))).alias("value"), "sent")
    noise = lines.filter("sent % 4 = 0").select(F.explode(F.array(F.regexp_replace("value", requests.ENDPOINT, "/v1/models"), F.substring("value", 1, 40))).alias("value"))
    lines.select("value").unionByName(noise).write.text(path)
    return path


@query(f"with {TURNS} select namespace, turn_id as sent, least(6, turn_id) as n_messages, content as last_message from (select *, lead(turn_id) over (partition by namespace order by turn_id) as after from turns) where after is null or turn_id % 2 = 0")
def source_chat_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC8: a request log read as a batch."""
    rows = requests.registered(spark).read.format("chat_requests").load(_logged(spark, sf_dir))
    return rows.select(NS, "sent", F.size("messages").cast("long").alias("n_messages"), F.element_at("messages", -1)["content"].alias("last_message"))


@query(f"with {TURNS} select namespace, turn_id, role, tokens from turns")
def stream_requests_ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC8, W15, ST1: a request log as a stream; of its overlapping views each turn is ingested once."""
    from recollect.streaming import stateful

    path, at = _logged(spark, sf_dir), scratch_path(spark, "stream")
    with stateful.rocksdb(spark):
        views = requests.registered(spark).readStream.format("chat_requests").load(path)
        out = stateful.aligned(views)
        out.writeStream.format("parquet").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out").select(NS, "turn_id", "role", "tokens")


_WINDOW = f"""{TURNS}, lists as (select namespace, list_prepend(0::hugeint, list(up_to order by turn_id)) as ups, list(tokens order by turn_id) as toks, list(upper(role) || ': ' || content order by turn_id) as lines from
  (select *, sum(tokens) over (partition by namespace order by turn_id) as up_to from turns) group by namespace),
w(namespace, n, head, before) as (select namespace, 0::bigint, 0::bigint, 0::bigint from lists
  union all select w.namespace, n + 1, case when ups[n + 2] - ups[head + 1] > {HIGH} then greatest(head, least(n, len(list_filter(ups[1:n + 2], lambda u: ups[n + 2] - u > {LOW})))) else head end, head from w join lists using (namespace) where n < len(toks)),
gone as (select namespace, n, before + 1 as first_turn, head as last_turn, head - before as n_turns, (ups[head + 1] - ups[before + 1])::bigint as tokens, array_to_string(lines[before + 1:head], chr(10)) as said from w join lists using (namespace) where head > before),
done as (select *, case when contains(said, '{REFUSED}') then 'dropped' else 'extracted' end as event from gone),
counted as (select *, sum(case when event = 'dropped' then n_turns else 0 end) over (partition by namespace order by n)::bigint as lost from done)"""


@query(
    f"""with recursive {_WINDOW} select namespace, event, first_turn, last_turn, n_turns, tokens, case when event = 'extracted' then string_split(said, chr(10))[1] end as text, lost as dropped_turns from counted
union all select namespace, 'evicted', first_turn, last_turn, n_turns, tokens, null, lost - case when event = 'dropped' then n_turns else 0 end from counted"""
)
def stream_live_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST6, low-water eviction, overflow and drop counter: what happens to the live window of each conversation."""
    from recollect.streaming import stateful

    own = turns_of_conversations(spark, sf_dir).select(NS, "turn_id", "role", "content", "tokens")
    with stateful.rocksdb(spark):
        return _stream(spark, own, lambda s: stateful.live_window(s, stub_extract(REFUSED), HIGH, LOW))


_SESSIONS = f"{TURNS}, sess as (select namespace, session_id as source_id, string_agg(upper(role) || ': ' || content, chr(10) order by turn_id) as text from turns group by all)"


@query(
    f"""with {_SESSIONS}, q as (select namespace as query_id, namespace, content as query from turns where turn_id = 1),
words as (select namespace, source_id, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) as w from sess),
found as (select query_id, source_id, text, {count_tokens("('- ' || text)")} as cost, 500 as available, len(list_intersect(w, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')))) as shared from q join words using (namespace)),
rows_ as (select * from found where shared > 0), {_FOLD.format(order="shared desc, source_id", rows="rows_")},
kept as (select query_id, list(source_id order by place) as sources, string_agg('- ' || text, chr(10) order by place) as context from ranked join taken using (query_id, place) group by query_id)
select q.query_id, coalesce(sha256(context), '') as context_sha256, coalesce({count_tokens('context')}, 0)::bigint as context_tokens, coalesce(sources, []) as sources, (select count(*) from rows_ r where r.query_id = q.query_id)::integer as n_candidates,
  (select count(*) from sess s where s.namespace = q.namespace)::bigint as n_ready from q left join kept on kept.query_id = q.query_id"""
)
def source_external_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC12, K7: sessions retained by an external memory, polled until ready, recalled under a budget, and deleted at the end."""
    turns = turns_of_conversations(spark, sf_dir)
    client = external.FolderMemory(scratch_path(spark, "external").removeprefix("file://"))
    documents = written(external.retained(external.session_texts(turns), client), "retained")
    ready = written(external.readiness(documents, client).filter("status = 'done'").groupBy(NS).agg(F.count("*").alias("n_ready")), "ready")
    asked = turns.filter("turn_id = 1").select(F.col(NS).alias("query_id"), NS, F.col("content").alias("query"), F.lit(500).cast("long").alias("budget_tokens"))
    got = written(external.recalled(asked, client), "recalled")
    written(external.forgotten(asked, client), "forgotten")
    digest = F.when(F.col("context") == "", "").otherwise(F.sha2("context", 256))
    return got.join(ready, NS).select("query_id", digest.alias("context_sha256"), "context_tokens", "sources", "n_candidates", "n_ready")
