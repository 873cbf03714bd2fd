"""Operational checks, run on real streams and tables: restart, replay, failure in the middle, and rollback.

Each check does its work twice or breaks it on purpose and compares what is left, row by row, with what should be. A check
gives its name, ``pass`` or ``fail``, and how many rows were compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.sources import versions
from recollect.sources.scratch import scratch_path
from recollect.streaming import memory

CHECKS = "name string, outcome string, n_rows long"


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same rows, repeats counted."""
    return a.count() == b.count() and not a.exceptAll(b).limit(1).count()


def _drained(spark: SparkSession, at: str, schema, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One run over what has come into at/in, from its checkpoint, and all rows it ever gave."""
    out = run(spark.readStream.schema(schema).parquet(f"{at}/in"))
    out.writeStream.format("parquet").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def restart(spark: SparkSession, messages: DataFrame) -> tuple[bool, int]:
    """Ingestion that is stopped half way and started again gives the turns of one that was not."""
    whole, parted = scratch_path(spark, "whole"), scratch_path(spark, "parted")
    messages.write.parquet(f"{whole}/in")
    half = F.pmod(F.xxhash64("namespace"), F.lit(2)) * 2 + 2
    messages.filter(F.col("arrival_seq") <= half).write.parquet(f"{parted}/in")
    _drained(spark, parted, messages.schema, memory.ingested)
    messages.filter(F.col("arrival_seq") > half).write.mode("append").parquet(f"{parted}/in")
    want = _drained(spark, whole, messages.schema, memory.ingested)
    return same_rows(_drained(spark, parted, messages.schema, memory.ingested), want), want.count()


def replay(spark: SparkSession, messages: DataFrame) -> tuple[bool, int]:
    """Messages that come again give no turn again."""
    at = scratch_path(spark, "replay")
    messages.write.parquet(f"{at}/in")
    before = _drained(spark, at, messages.schema, memory.ingested).count()
    messages.write.mode("append").parquet(f"{at}/in")
    after = _drained(spark, at, messages.schema, memory.ingested)
    return after.count() == before == after.select("namespace", "turn_id").distinct().count(), before


def failed_commit(spark: SparkSession, rows: DataFrame) -> tuple[bool, int]:
    """A job that fails after it has written rows changes nothing that a reader sees, and the next commit works."""
    at = scratch_path(spark, "versions")
    first = versions.commit(rows, at)
    broken = rows.withColumn("turn_id", F.when(F.col("turn_id") >= 4, F.raise_error(F.lit("broken on purpose")).cast("long")).otherwise(F.col("turn_id")))
    try:
        versions.commit(broken, at)
        return False, 0
    except PySparkException:
        pass
    kept = versions.read(spark, at)
    sound = same_rows(kept, rows) and list(versions.versions(spark, at)) == [first]
    return sound and versions.commit(rows.filter("turn_id = 1"), at) == first + 1, kept.count()


def failed_compaction(spark: SparkSession, turns: DataFrame) -> tuple[bool, int]:
    """Spans whose summary fails stay in the state: when the provider answers again, they are compacted as if nothing had been."""
    calm, shaken = scratch_path(spark, "calm"), scratch_path(spark, "shaken")

    def refused(text: str) -> str:
        raise RuntimeError("no answer")

    def summary(text: str) -> str:
        return text[:40]

    early = turns.filter("turn_id <= 4")
    for at in (calm, shaken):
        early.write.parquet(f"{at}/in")
    stream = lambda how: lambda s: memory.compacting(s, how, 200, 2, 1)
    _drained(spark, shaken, turns.schema, stream(refused))
    for at in (calm, shaken):
        turns.filter("turn_id > 4").write.mode("append").parquet(f"{at}/in")
    made = lambda at: _drained(spark, at, turns.schema, stream(summary)).filter("event = 'summary'").select("namespace", F.explode("turn_ids").alias("turn_id"))
    again, want = made(shaken), made(calm)
    # A namespace without later turns has no second chance yet.
    seen = turns.filter("turn_id > 4").select("namespace").distinct()
    return same_rows(again.join(seen, "namespace", "left_semi"), want.join(seen, "namespace", "left_semi")), again.count()


def rolled_back(spark: SparkSession, rows: DataFrame) -> tuple[bool, int]:
    """An older version comes back as it was, the one in between stays readable, and a writer that did not see it is refused."""
    at = scratch_path(spark, "versions")
    first = versions.commit(rows, at)
    second = versions.commit(rows.withColumn("content", F.upper("content")), at)
    third = versions.rollback(spark, at, first)
    back = versions.read(spark, at)
    try:
        versions.commit(rows, at, expected=second)
        refused = False
    except versions.Conflict:
        refused = True
    return refused and third == second + 1 and same_rows(back, rows) and versions.read(spark, at, second).count() == rows.count(), back.count()


def checked(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """All checks on turns (namespace, turn_id, role, content, tokens)."""
    messages = turns.select("namespace", F.col("turn_id").alias("arrival_seq"), "role", "content")
    runs = {"restart": (restart, messages), "replay": (replay, messages), "failed_commit": (failed_commit, turns), "failed_compaction": (failed_compaction, turns), "rollback": (rolled_back, turns)}
    rows = []
    for name, (check, data) in runs.items():
        passed, n = check(spark, data)
        rows.append((name, "pass" if passed else "fail", n))
    return spark.createDataFrame([*rows, ("hardware", "not_applicable", 0)], CHECKS)
