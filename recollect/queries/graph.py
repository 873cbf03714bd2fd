"""Queries of the bitemporal edge store, over orders as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import graph
from recollect.queries.views import EDGES
from recollect.registry import query
from recollect.schemas import edges_of_orders, nodes_of_customers, table

COLUMNS = ["seq", "subject_id", "relation", "object_literal", "valid_from", "valid_to", "ingested_at", "invalidated_at"]
#: 1996-01-01 and 1997-07-01, as seconds.
T0, T1 = 820454400.0, 867715200.0


@query(f"with {EDGES} select * from closed")
def graph_supersession(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges as they stand after all were added."""
    return graph.superseded(edges_of_orders(spark, sf_dir)).select(COLUMNS)


@query(f"with {EDGES} select * from closed where valid_to is null and invalidated_at is null")
def graph_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds and is believed now."""
    return graph.current(graph.superseded(edges_of_orders(spark, sf_dir))).select(COLUMNS)


@query(f"with {EDGES} select seq, subject_id, relation, object_literal from closed where valid_from <= {T0} and (valid_to is null or {T0} < valid_to)")
def graph_true_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was true on a day."""
    return graph.true_at(graph.superseded(edges_of_orders(spark, sf_dir)), T0).select("seq", "subject_id", "relation", "object_literal")


@query(f"with {EDGES} select seq, subject_id, relation, object_literal from closed where ingested_at <= 5000 and (invalidated_at is null or 5000 < invalidated_at)")
def graph_believed_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was believed at a time."""
    return graph.believed_at(graph.superseded(edges_of_orders(spark, sf_dir)), 5000.0).select("seq", "subject_id", "relation", "object_literal")


@query(
    f"""with {EDGES}, probes as (select c_custkey::varchar as subject_id, unnest([{T0}, {T1}]::double[]) as t from customer)
select p.subject_id, p.t, count(*) as n_edges, min(c.seq) as first_seq from probes p join closed c on c.subject_id = p.subject_id and c.valid_from <= p.t and (c.valid_to is null or p.t < c.valid_to) group by all"""
)
def graph_as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J16 for many times at once."""
    probes = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("subject_id"), F.explode(F.array(F.lit(T0), F.lit(T1))).alias("t"))
    return graph.as_of(graph.superseded(edges_of_orders(spark, sf_dir)), probes).groupBy("subject_id", "t").agg(F.count("*").alias("n_edges"), F.min("seq").alias("first_seq"))


@query(f"with {EDGES} select seq, coalesce(c_name, subject_id) || ' ' || relation || ' ' || object_literal || ' (since ' || strftime(make_timestamp((valid_from * 1000000)::bigint), '%Y-%m') || ')' as line from closed left join customer on c_custkey::varchar = subject_id where valid_to is null and invalidated_at is null")
def graph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current edges as text, with labels."""
    return graph.edge_lines(graph.current(graph.superseded(edges_of_orders(spark, sf_dir))), nodes_of_customers(spark, sf_dir)).select("seq", "line")


@query(
    """with m as (select p_partkey as seq, p_partkey::varchar as id, p_brand as label, p_type as alias from part),
k as (select lower(trim(label)) as key, min(seq) as seq from m group by all), a as (select lower(trim(label)) as key, alias, min(seq) as s from m group by all), l as (select key, list(alias order by s) as aliases from a group by key)
select m.id, k.seq, m.label, l.aliases from k join m on m.seq = k.seq join l on l.key = k.key"""
)
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions as nodes by label, aliases in the order they came."""
    p = table(spark, sf_dir, "part")
    mentions = p.select(F.col("p_partkey").alias("seq"), F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("label"), F.array("p_type").alias("aliases"), F.lit(0.0).alias("created_at"))
    return graph.nodes_by_label(mentions).select("id", "seq", "label", "aliases")


@query("select seq from (select o_orderkey as seq, case when o_orderkey % 3 = 0 then o_orderstatus end as a, case when o_orderkey % 2 = 0 then o_orderstatus end as b from orders) where (a is null) = (b is null)")
def graph_malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with both objects or neither."""
    e = edges_of_orders(spark, sf_dir)
    odd = e.withColumn("object_id", F.when(F.col("seq") % 3 == 0, F.col("object_literal"))).withColumn("object_literal", F.when(F.col("seq") % 2 == 0, F.col("object_literal")))
    return graph.malformed(odd).select("seq")


@query(f"with {EDGES} select (select count(*) from closed) as superseded, (select count(*) from edges) as appended")
def graph_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges added with and without supersession."""
    e = edges_of_orders(spark, sf_dir)
    a = graph.superseded(e).agg(F.count("*").alias("superseded"))
    return a.crossJoin(graph.appended(e.limit(0), e).agg(F.count("*").alias("appended")))
