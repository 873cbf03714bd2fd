"""The corpus pipeline: documents in, token files out. Each stage calls one operator of recollect.llm.

A stage gets the rows its predecessor kept, as a table, and returns a DataFrame with the columns of documents; the last
one returns a row per document of the token file. Between stages, rows are tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import decontaminate, mixing, simhash, tokens, toxicity
from recollect.llm.common import fresh, small_side, written

TOXIC_SCORE, BROADCAST_KEYS = 0.3, 500_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity score is below the operator's threshold. Without labels of both classes all rows stay; rows with
    equal texts stay or go together."""
    (name,) = fresh(docs, "toxicity")
    scored = toxicity.scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), score_col=name)
    return scored.filter(F.col(name) < TOXIC_SCORE).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of similar texts (5-word shingles, a Jaccard similarity of 0.8): the one with the smallest id,
    a null id last; of rows with that id in the group, the one with the smallest key of id and text. Rows with one id and
    unlike texts are judged by their texts. Of rows with equal id and text, one stays."""
    found = written(simhash.similar(docs), "similar")
    name, other = fresh(docs, "row_key_of", "row_key_met")
    keyed = docs.withColumn(name, simhash.row_key(docs))
    gone = small_side(found.filter(~F.col("first")).select(F.col("row_key").alias(other)), BROADCAST_KEYS)
    left = keyed.join(gone, F.col(name) == F.col(other), "left_anti")
    repeated = written(found.filter("first and copies > 1").select(F.col("row_key").alias(other)), "repeated")
    if not repeated.limit(1).count():
        return left.select(*docs.columns)
    again = small_side(repeated, BROADCAST_KEYS)
    once = left.join(again, F.col(name) == F.col(other), "left_semi").dropDuplicates([name])
    return left.join(again, F.col(name) == F.col(other), "left_anti").unionByName(once).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that no window of a benchmark item occurs in. Rows with equal ids stay or go by their own text; a null text
    has no window."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    name, other = fresh(docs, "text_hash", "hit_hash")
    keyed = docs.withColumn(name, F.xxhash64(docs["text"]))
    hit = written(decontaminate.matches(keyed, benchmark, id_col=name).filter(F.size("items") > 0).select(F.col("id").alias(other)).distinct(), "hits")
    return keyed.join(small_side(hit, BROADCAST_KEYS), F.col(name) == F.col(other), "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows, and parts and repeats of them, that the mix of sources takes; of a row without words nothing is taken."""
    return mixing.mixed_documents(docs)


def write_token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token file's documents: doc_id, start, n_tokens, ids_crc32. A null id comes first; rows with equal ids stand in
    the order of their texts."""
    import public_tokenizers

    return tokens.tokenised(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("tokens", write_token_file),
]

#: Models and tokenizers have no SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
