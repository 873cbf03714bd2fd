"""Compaction of old turns: when, which span, and the swap of turns for a summary and facts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions import constants as C
from recollect.functions import text as X

NS = "namespace"


def due(turns: DataFrame, trigger: int = C.TRIGGER_TOKENS) -> DataFrame:
    """Namespaces whose turns hold more tokens than the trigger."""
    return turns.groupBy(NS).agg(F.sum("tokens").alias("tokens")).filter(F.col("tokens") > trigger)


def span(turns: DataFrame, size: int = C.SPAN_TURNS, keep: int = C.KEEP_TURNS) -> DataFrame:
    """The oldest turns, size at most, outside the keep newest."""
    n = F.count("*").over(W.partitionBy(NS))
    place = F.row_number().over(W.partitionBy(NS).orderBy("turn_id"))
    return turns.withColumn("n", n).withColumn("place", place).filter(F.col("place") <= F.least(F.lit(size), F.col("n") - keep)).drop("n", "place")


def protected(turns: DataFrame, keep: int = C.KEEP_TURNS) -> DataFrame:
    return turns.withColumn("back", F.row_number().over(W.partitionBy(NS).orderBy(F.col("turn_id").desc()))).filter(F.col("back") <= keep).drop("back")


def conversation_text(turns: DataFrame) -> DataFrame:
    """(namespace, text): turns as numbered lines."""
    line = X.numbered_turn_line(F.col("turn_id"), F.col("role"), F.col("content"), F.col("session_id"), F.col("ts"))
    return turns.withColumn("line", line).groupBy(NS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_id", "line"))), lambda s: s["line"]), "\n").alias("text"))


def next_turn_ids(messages: DataFrame, turns: DataFrame, summaries: DataFrame) -> DataFrame:
    """messages (namespace, arrival, ...) with turn_id: after the last turn, else after the last one covered, else from 1."""
    last = turns.groupBy(NS).agg(F.max("turn_id").alias("last_turn"))
    covered = summaries.select(NS, F.array_max("covers_turn_ids").alias("m")).groupBy(NS).agg(F.max("m").alias("last_covered"))
    base = F.coalesce("last_turn", "last_covered", F.lit(0))
    return messages.join(last, NS, "left").join(covered, NS, "left").withColumn("turn_id", base + F.row_number().over(W.partitionBy(NS).orderBy("arrival"))).drop("last_turn", "last_covered")


def new_messages(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """Of messages (namespace, arrival, role, content), a client's whole view of a session, those that turns do not have:
    what follows the last place in them up to which they end like the stored turns. With no such place all are new.

    A session's roles and contents meet as two arrays."""
    said = lambda df, order, name: df.groupBy(NS).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "role", "content"))), lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias(name))
    both = said(messages, "arrival", "incoming").join(said(turns, "turn_id", "stored"), NS, "left")
    n, m = F.size("incoming"), F.size(F.coalesce("stored", F.array().cast("array<struct<role:string,content:string>>")))

    def ends_alike(i: Column) -> Column:
        length = F.least(i, m)
        return F.slice("incoming", i - length + 1, length) == F.slice("stored", m - length + 1, length)

    known = F.when(m > 0, F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), n), ends_alike)), F.lit(0))).otherwise(0)
    place = F.row_number().over(W.partitionBy(NS).orderBy("arrival"))
    return messages.withColumn("place", place).join(both.select(NS, known.alias("known")), NS).filter("place > known").drop("place", "known")


def without_done(latest: DataFrame, done: DataFrame) -> DataFrame:
    """Turns that came in while others were compacted: latest without done, by id."""
    return latest.join(done.select(NS, "turn_id"), [NS, "turn_id"], "left_anti")


def span_summary(turns: DataFrame, summarise: Callable[[Column], Column]) -> DataFrame:
    """One summary per namespace of a span: covered ids, sessions in the order they come, first and last time, and the text that summarise makes of the conversation."""
    ordered = F.array_sort(F.collect_list(F.struct("turn_id", "session_id", "ts")))
    sessions = F.array_distinct(F.filter(F.transform("o", lambda s: s["session_id"]), lambda s: s.isNotNull() & (s != "")))
    times = F.filter(F.transform("o", lambda s: s["ts"]), lambda s: s.isNotNull() & (s != ""))
    meta = turns.groupBy(NS).agg(ordered.alias("o")).select(NS, F.transform("o", lambda s: s["turn_id"]).alias("covers_turn_ids"), sessions.alias("session_ids"), F.try_element_at(times, F.lit(1)).alias("start_ts"), F.try_element_at(times, F.lit(-1)).alias("end_ts"))
    return conversation_text(turns).withColumn("text", summarise(F.col("text"))).join(meta, NS).withColumn("tokens", X.token_count(F.col("text")))


def compacted(turns: DataFrame, trigger: int = C.TRIGGER_TOKENS, size: int = C.SPAN_TURNS, keep: int = C.KEEP_TURNS) -> DataFrame:
    """(namespace, turn_id, compaction): the compaction, from 1, in which a turn leaves, or null: whole loops at once.

    A namespace compacts its oldest span again and again while its remaining tokens exceed the trigger; the state of the loop is a prefix, so a fold over the ordered turns gives it."""
    names = [NS, "turn_id", "compaction"]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("turn_id", kind="stable")
        tokens, out, at, k = rows["tokens"].tolist(), [None] * len(rows), 0, 0
        left = sum(tokens)
        while left > trigger and len(tokens) - at > keep:
            k += 1
            n = min(size, len(tokens) - at - keep)
            for i in range(at, at + n):
                out[i], left = k, left - tokens[i]
            at += n
        return pd.DataFrame({NS: rows[NS], "turn_id": rows["turn_id"], "compaction": pd.array(out, dtype="Int64")})[names]

    return turns.select(NS, "turn_id", "tokens").groupBy(NS).applyInPandas(run, "namespace string, turn_id bigint, compaction bigint")
