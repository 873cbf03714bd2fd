"""The opN_ queries: thin wrappers that apply each operator to its whole table and derive the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import decontaminate, embeddings, fingerprint, lexical, licenses, merkle, mixing, secrets, simhash, substrings, tokens, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their SimHash over 3-word shingles and the smallest doc_id reachable over links of at most two bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"), F.col("copies").alias("n_same"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the words that any 10-word window of a benchmark item covers, and the items found."""
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10, slop=32)
    n_hit = F.aggregate(F.arrays_zip("starts", "ends"), F.lit(0).cast("long"), lambda n, x: n + x["ends"] - x["starts"])
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near_items"),
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records of a content-addressed archive, read back."""
    back = warc.archived(table(spark, sf_dir, "pages"))
    return back.select(F.col("key").alias("page_id"), F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to")


def op3_tokens(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Documents as token ids in a Re-Pair compressed file, read back: place, length and checksum."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return tokens.tokenised(table(spark, sf_dir, "documents"), tokenizer).withColumnRenamed("id", "doc_id")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in documents: counts of the base kinds, their digest, and all spans."""
    found = secrets.secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), *[count(kind) for kind in secrets.BASE], "base_sha256", text.alias("spans"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of sources takes of each document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families that documents' paragraphs name, confirmed by templates."""
    return licenses.licenses(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digests of documents and of their edited texts."""
    found = fingerprint.fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", F.when(F.col("same_edited"), F.col("fingerprint")).otherwise(F.col("edited_digest")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("same_edited")).alias("near_edited"), fingerprint.likeness(F.col("same_next")).alias("near_next"),
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of documents, with the rows that nothing was learned from."""
    scored = toxicity.row_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    held = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return scored.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the words of 13-word windows that also start in a document with a smaller doc_id."""
    return substrings.deduplicated(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their Merkle leaves, subroots by source, the root and a proof, checked against some tampered texts."""
    docs = table(spark, sf_dir, "documents")
    found = merkle.manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], altered={"text": F.replace("text", F.lit("\n"), F.lit(""))}, when=F.crc32(F.col("doc_id").cast("string")) % 2 == 0)
    return found.withColumnRenamed("id", "doc_id")


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that match each benchmark item best."""
    return lexical.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op13_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with the number of vectors at a cosine of 0.9 or more, and the smallest id that such links reach."""
    found = embeddings.links(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_simhash": op2_simhash,
    "op3_tokens": op3_tokens,
    "op4_secrets": op4_secrets,
    "op5_mixing": op5_mixing,
    "op6_licenses": op6_licenses,
    "op7_fingerprint": op7_fingerprint,
    "op8_toxicity": op8_toxicity,
    "op9_substrings": op9_substrings,
    "op10_decontaminate": op10_decontaminate,
    "op11_merkle": op11_merkle,
    "op12_lexical": op12_lexical,
    "op13_embeddings": op13_embeddings,
}
ORACLE_SQL: dict[str, str] = {"op1_warc": warc.SQL, "op5_mixing": mixing.SQL, "op9_substrings": substrings.SQL, "op10_decontaminate": decontaminate.SQL, "op11_merkle": merkle.SQL, "op12_lexical": lexical.SQL, "op13_embeddings": embeddings.SQL}
