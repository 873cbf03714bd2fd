"""The question-answering dataset: nested JSON to items, sessions and turns; Markdown vaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.ddl import schema
from recollect.operators.evaluate import gold_recency

ENTRY = schema(
    "question_id string, question_type string, question string, answer string, haystack_session_ids array<string>, haystack_sessions array<array<struct<role: string, content: string>>>, "
    "haystack_dates array<string>, answer_session_ids array<string>"
)
KNOWLEDGE_UPDATE = "knowledge-update"


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRY).option("multiLine", True).json(path)


def items(entries: DataFrame, categories: list[str], limit: int | None = None, max_gold_recency: float | None = None) -> DataFrame:
    """Entries of the categories with gold_recency; sessions, ids and dates must align, or reading raises an error. With a maximum, those up to it in order of recency."""
    dates = F.coalesce("haystack_dates", F.transform("haystack_session_ids", lambda _: F.lit(None).cast("string")))
    aligned = (F.size("haystack_session_ids") == F.size("haystack_sessions")) & (F.size("haystack_session_ids") == F.size("haystack_dates"))
    answers = F.coalesce("answer_session_ids", F.array().cast("array<string>"))
    own = entries.filter(F.col("question_type").isin(categories)).withColumn("haystack_dates", dates).withColumn("answer_session_ids", answers)
    checked = own.withColumn("haystack_session_ids", F.when(aligned, F.col("haystack_session_ids")).otherwise(F.raise_error(F.concat(F.lit("sessions do not align: "), "question_id")).cast("array<string>")))
    out = checked.withColumn("gold_recency", gold_recency(F.col("haystack_session_ids"), F.col("answer_session_ids")))
    if max_gold_recency is not None:
        out = out.filter(F.col("gold_recency") <= max_gold_recency).orderBy("gold_recency", "question_id")
    return out.limit(limit) if limit is not None else out


def knowledge_updates(entries: DataFrame, **options) -> DataFrame:
    return items(entries, [KNOWLEDGE_UPDATE], **options)


def sessions(found: DataFrame) -> DataFrame:
    """(question_id, place, session_id, ts, turns, n_turns, is_gold) in order."""
    zipped = F.arrays_zip(F.col("haystack_session_ids").alias("session_id"), F.col("haystack_dates").alias("ts"), F.col("haystack_sessions").alias("turns"))
    rows = found.select("question_id", "answer_session_ids", F.posexplode(zipped).alias("place", "s"))
    return rows.select("question_id", "place", "s.session_id", "s.ts", "s.turns", F.size("s.turns").cast("long").alias("n_turns"), F.array_contains("answer_session_ids", F.col("s.session_id")).alias("is_gold"))


def turns(found: DataFrame) -> DataFrame:
    """(question_id, session_id, ts, place, turn, role, content, is_gold): all sessions flattened in order."""
    return sessions(found).select("question_id", "session_id", "ts", "place", "is_gold", F.posexplode("turns").alias("turn", "t")).select("question_id", "session_id", "ts", "place", "turn", "t.role", "t.content", "is_gold")


def gold_text(found: DataFrame) -> DataFrame:
    """(question_id, text): turns of gold sessions, sessions in order of their dates."""
    rows = turns(found).filter("is_gold").withColumn("line", F.concat(F.upper("role"), F.lit(": "), "content"))
    return rows.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("ts", F.lit("")).alias("ts"), "place", "turn", "line"))), lambda s: s["line"]), "\n").alias("text"))


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of a vault's pages; a vault without its folder is a single row that says so (rule directory)."""
    folder = f"{path.rstrip('/')}/wiki"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([(folder, None)], "path string, content string")
    return spark.read.text(f"{folder}/*", wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
