"""The bitemporal edge store: nodes by label, supersession of edges, points in time, serialisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions import text as X


def nodes_by_label(mentions: DataFrame) -> DataFrame:
    """mentions (seq, id, label, aliases, created_at) as nodes: the first of each label, without regard to case and outer spaces, with all aliases in the order they came."""
    key = F.lower(F.trim("label"))
    ordered = F.array_sort(F.collect_list(F.struct("seq", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))))
    first = F.min_by(F.struct("id", "label", "created_at"), "seq")
    grouped = mentions.groupBy(key.alias("key")).agg(first.alias("first"), F.min("seq").alias("seq"), F.array_distinct(F.flatten(F.transform(ordered, lambda s: s["aliases"]))).alias("aliases"))
    return grouped.select("first.id", "seq", "first.label", "aliases", "first.created_at")


def row_id(*columns: str) -> Column:
    """A deterministic id of a row's natural key."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def object_of() -> Column:
    """An edge's object; an id and an equal literal differ."""
    return F.when(F.col("object_id").isNotNull(), F.struct(F.lit("id").alias("tag"), F.col("object_id").alias("of"))).otherwise(F.struct(F.lit("lit").alias("tag"), F.coalesce("object_literal", F.lit("")).alias("of")))


def malformed(edges: DataFrame) -> DataFrame:
    """Edges with both objects or neither."""
    return edges.filter(F.col("object_id").isNull() == F.col("object_literal").isNull())


def superseded(edges: DataFrame) -> DataFrame:
    """Edges as adding them in the order of seq leaves them: an edge equal to the current one of its slot is dropped, another closes it, in event time with its own start, in transaction time with its own ingestion.

    Holds for edges that are all added with supersession and come open; closed ones are passed through."""
    slot = W.partitionBy("subject_id", "relation").orderBy("seq")
    is_open = F.col("valid_to").isNull() & F.col("invalidated_at").isNull()
    fresh = edges.filter(is_open).withColumn("object", object_of()).withColumn("before", F.lag("object").over(slot)).filter(F.col("before").isNull() | (F.col("before") != F.col("object")))
    closed = fresh.withColumns({"valid_to": F.lead("valid_from").over(slot), "invalidated_at": F.lead("ingested_at").over(slot)})
    return closed.select(*edges.columns).unionByName(edges.filter(~is_open))


def appended(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edges with more added as they are, without supersession."""
    return edges.unionByName(more)


def current(edges: DataFrame) -> DataFrame:
    return edges.filter("valid_to is null and invalidated_at is null")


def true_at(edges: DataFrame, t: Column | float) -> DataFrame:
    """Facts true at event time t, whatever was believed: valid_from <= t < valid_to."""
    at = t if isinstance(t, Column) else F.lit(t)
    return edges.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))


def believed_at(edges: DataFrame, t: Column | float) -> DataFrame:
    """What was believed at transaction time t."""
    at = t if isinstance(t, Column) else F.lit(t)
    return edges.filter((F.col("ingested_at") <= at) & (F.col("invalidated_at").isNull() | (at < F.col("invalidated_at"))))


def as_of(edges: DataFrame, probes: DataFrame, transaction: bool = False) -> DataFrame:
    """probes (subject_id, t, ...) with the edges that hold at their times: an equi-join on the subject with an interval condition."""
    start, end = ("ingested_at", "invalidated_at") if transaction else ("valid_from", "valid_to")
    return probes.join(edges, "subject_id").filter((F.col(start) <= F.col("t")) & (F.col(end).isNull() | (F.col("t") < F.col(end))))


def labelled(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with subject_label and object_label: a node's label, else the id itself; literals as they are."""
    n = nodes.select("id", "label")
    s, o = n.toDF("sid", "slabel"), n.toDF("oid", "olabel")
    joined = edges.join(s, F.col("subject_id") == F.col("sid"), "left").join(o, F.col("object_id") == F.col("oid"), "left")
    return joined.withColumns({"subject_label": F.coalesce("slabel", "subject_id"), "object_label": F.when(F.col("object_id").isNotNull(), F.coalesce("olabel", "object_id")).otherwise(F.coalesce("object_literal", F.lit("")))}).drop("sid", "slabel", "oid", "olabel")


def edge_lines(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with a column line: ``subject relation object (since YYYY-MM)``."""
    body = F.rtrim(F.concat_ws(" ", "subject_label", "relation", "object_label"))
    return labelled(edges, nodes).withColumn("line", F.concat(body, F.lit(" (since "), X.month(F.col("valid_from")), F.lit(")")))
