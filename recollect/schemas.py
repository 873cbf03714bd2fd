"""Schemas of the data model and views of the driver's tables in them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recollect.ddl import schema

SCHEMA_VERSION = 1

TURN = schema("namespace string, turn_id bigint, role string, content string, tokens bigint, session_id string, ts string")
SUMMARY = schema("namespace string, seq bigint, covers_turn_ids array<bigint>, text string, tokens bigint, created_at double, session_ids array<string>, start_ts string, end_ts string")
FACT = schema(
    "namespace string, seq bigint, kind string, text string, source_turn_id bigint, status string, slot_key string, slot_value string, subject string, attribute string, "
    "superseded_by_turn_id bigint, value string, is_correction boolean, session_id string, ts string, modality string"
)
NODE = schema("id string, seq bigint, label string, aliases array<string>, created_at double")
EDGE = schema(
    "seq bigint, id string, subject_id string, relation string, object_id string, object_literal string, valid_from double, valid_to double, ingested_at double, "
    "invalidated_at double, source_turn_id bigint, kind string"
)
#: One memory state as a JSON document.
STATE = schema(
    "schema_version int, turns array<struct<role: string, content: string, turn_id: bigint, tokens: bigint, session_id: string, timestamp: string>>, "
    "summaries array<struct<covers_turn_ids: array<bigint>, text: string, tokens: bigint, created_at: double, session_ids: array<string>, start_timestamp: string, end_timestamp: string>>, "
    "ledger struct<entries: array<struct<kind: string, text: string, source_turn_id: bigint, status: string, slot_key: string, slot_value: string, subject: string, attribute: string, "
    "superseded_by_turn_id: bigint, value: string, is_correction: boolean, session_id: string, timestamp: string, modality: string>>, max_stale_entries: int>"
)
QUERY = schema("query_id string, namespace string, query string, budget_tokens bigint")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conforming(df: DataFrame, wanted: T.StructType) -> DataFrame:
    """df with exactly the wanted columns: missing ones null, others cast."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def turns_of_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations")
    n = F.length("text")
    return t.select(
        F.col("conv_id").cast("string").alias("namespace"), (F.col("turn") + 1).alias("turn_id"), "role", F.col("text").alias("content"),
        F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long").alias("tokens"), F.concat(F.lit("s"), F.floor(F.col("turn") / 4).cast("string")).alias("session_id"), F.lit(None).cast("string").alias("ts"),
    )


def facts_of_events(spark: SparkSession, sf_dir: str, values: int = 5) -> DataFrame:
    """Events as slot observations: a user's facts in the order of time, with few values, so that old ones come again."""
    e = table(spark, sf_dir, "events")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    rows = e.select(F.col("user_id").cast("string").alias("namespace"), F.row_number().over(order).cast("long").alias("seq"), "event_id", "event_type", k.alias("k"))
    return conforming(
        rows.select(
            "namespace", "seq", F.lit("entity").alias("kind"), F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" "), F.col("event_type")).alias("text"), F.col("seq").alias("source_turn_id"),
            F.lit("active").alias("status"), F.concat(F.lit("user."), F.col("event_type")).alias("slot_key"), F.concat(F.lit("v"), F.pmod(F.col("k"), F.lit(values)).cast("string")).alias("slot_value"),
        ),
        FACT,
    ).withColumn("is_correction", F.lit(False))


def edges_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as edges: customer, priority, status; event time is the order date, transaction time the order key."""
    o = table(spark, sf_dir, "orders")
    return conforming(
        o.select(
            F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("subject_id"), F.col("o_orderpriority").alias("relation"),
            F.col("o_orderstatus").alias("object_literal"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("double").alias("valid_from"), F.col("o_orderkey").cast("double").alias("ingested_at"), F.lit("fact").alias("kind"),
        ),
        EDGE,
    )


def nodes_of_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return conforming(c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("label")), NODE)


def summaries_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as summaries: a source is a namespace, its rank by id the turn covered."""
    d = table(spark, sf_dir, "documents")
    n = F.row_number().over(W.partitionBy("source").orderBy("doc_id")).cast("long")
    return conforming(d.select(F.col("source").alias("namespace"), F.col("doc_id").alias("seq"), F.array(n).alias("covers_turn_ids"), F.col("text"), F.lit(0.0).alias("created_at")), SUMMARY)


def queries_of_benchmark(spark: SparkSession, sf_dir: str, namespaces: int = 20, budget: int = 1500) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").cast("string").alias("query_id"), F.concat(F.lit("src"), F.pmod(F.col("item_id"), F.lit(namespaces)).cast("string")).alias("namespace"), F.col("text").alias("query"), F.lit(budget).cast("long").alias("budget_tokens"))
