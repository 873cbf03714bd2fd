"""The driver's tables as DuckDB views of the data model, to match recollect.schemas."""

FACTS = """
e as (select user_id::varchar as namespace, row_number() over (partition by user_id order by ts, event_id) as seq, event_id, event_type, json_extract_string(props, '$.k')::bigint as k from events),
facts as (select namespace, seq, 'entity' as kind, 'event ' || event_id || ' ' || event_type as text, seq as source_turn_id, 'user.' || event_type as slot_key, 'v' || (k % 5) as slot_value from e)
"""

LEDGER = (
    FACTS
    + """,
firsts as (select namespace, slot_key, slot_value, min(source_turn_id) as first_turn from facts group by all),
nexts as (select *, lead(first_turn) over (partition by namespace, slot_key order by first_turn) as next_turn from firsts),
ledger as (select f.*, case when n.next_turn is null then 'active' else 'stale' end as status, n.next_turn as superseded_by_turn_id from facts f join nexts n using (namespace, slot_key, slot_value)),
newest as (select * exclude (r) from (select *, row_number() over (partition by namespace, slot_key order by source_turn_id desc, seq) as r from ledger where status = 'active') where r = 1)
"""
)

TURNS = """
turns as (select conv_id::varchar as namespace, (turn + 1)::bigint as turn_id, role, text as content, case when length(text) = 0 then 0 else greatest(1, length(text) // 4) end::bigint as tokens, 's' || (turn // 4) as session_id from conversations)
"""

SUMMARIES = """
summaries as (select source as namespace, doc_id as seq, row_number() over (partition by source order by doc_id) as turn_id, text from documents)
"""

EDGES = """
edges as (select o_orderkey as seq, o_custkey::varchar as subject_id, o_orderpriority as relation, o_orderstatus as object_literal, epoch(o_orderdate)::double as valid_from, o_orderkey::double as ingested_at from orders),
fresh as (select * from (select *, lag(object_literal) over w as before from edges window w as (partition by subject_id, relation order by seq)) where before is null or before <> object_literal),
closed as (select seq, subject_id, relation, object_literal, valid_from, lead(valid_from) over w as valid_to, ingested_at, lead(ingested_at) over w as invalidated_at from fresh window w as (partition by subject_id, relation order by seq))
"""


def count_tokens(text: str) -> str:
    return f"(case when coalesce(length({text}), 0) = 0 then 0 else greatest(1, length({text}) // 4) end)"
