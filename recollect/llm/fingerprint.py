"""Document fingerprints: the canonical exact digest.

A text is brought to NFKC, case-folded, brought to NFKC again and its white space folded to single spaces; the digest
is XXH3-128 of the UTF-8. Rows with equal digests form a bucket, in which each canonical text is compared byte by byte
with that of the bucket's first row. Texts that differ from it in spite of equal digests get digests of their own
(suffix ``-`` and a number in the order of the texts), so equal fingerprints mean equal canonical texts. The digest is
exact: the likeness of two fingerprints is 1 if they are equal, else 0.

Only rows whose digest comes more than once are compared; their ids are broadcast if they are few, else joined by a
shuffle. What is aggregated by digest is written as a table before rows meet it, as adaptive execution splits a bucket with
many rows only where no aggregate stands before the join. A second digest tells texts apart whose first ones collide, so
fingerprints go by texts, whatever the ids.

Defined results: a null text counts as empty; a null id is the smallest id; rows with equal ids stand in the order of
their texts; with one row, the next document is the row itself; an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

import hashlib
import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import small_side, written
from recollect.llm.ordered import dealt

BROADCAST_IDS = 500_000


def canonical(text: str | None) -> bytes:
    text = text or ""
    if text.isascii():
        return b" ".join(text.lower().encode().replace(b"\x1c", b" ").replace(b"\x1d", b" ").replace(b"\x1e", b" ").replace(b"\x1f", b" ").split())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def check(canon: bytes) -> bytes:
    """16 bytes that tell apart texts with equal digests."""
    return hashlib.sha256(canon).digest()[:16]


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by as many characters of the following text, or all it has."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_each: int = 20_000) -> DataFrame:
    """Per row, in order of ids: id, n_chars, edited_sha256, digest, edited_digest, whether the canonical text equals the edited one's and the next row's, and check."""

    def one(key, text, following):
        changed = edited(text, following)
        own, other, after = canonical(text), canonical(changed), canonical(following)
        return key, len(text), hashlib.sha256(changed.encode()).hexdigest(), digest(own), digest(other), own == other, own == after, check(own)

    schema = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("digest", pa.string()), ("edited_digest", pa.string()), ("same_edited", pa.bool_()), ("same_next", pa.bool_()), ("check", pa.binary())])

    def run(batches):
        held = None
        for batch in batches:
            out = []
            for ahead, place, key, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                if held is not None and held[0] == place:
                    out.append(one(held[1], held[2], text.as_py() or ""))
                    held = None
                if not ahead:
                    held = (place, key, text.as_py() or "")
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return dealt(docs, id_col, text_col, rows_each, ahead=True).mapInArrow(run, "id long, n_chars long, edited_sha256 string, digest string, edited_digest string, same_edited boolean, same_next boolean, check binary")


def collisions(docs: DataFrame, marked: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, check, number): canonical texts that differ from their bucket's first one in spite of an equal digest, numbered
    in their order."""
    lowest = F.lit(-(1 << 63))
    buckets = written(marked.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.coalesce("id", lowest)).alias("first")).filter("n > 1").select("digest", "first"), "repeated")
    members = written(marked.join(buckets, "digest").select(F.coalesce("id", lowest).alias("member"), "first").distinct(), "members")

    def run(batches):
        for batch in batches:
            canon = [canonical(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([digest(c) for c in canon]), pa.array(canon, pa.binary()), pa.array([check(c) for c in canon], pa.binary()), batch.column(1)], ["digest", "canon", "check", "is_first"])

    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), lowest).alias("key"), F.col(text_col).cast("string").alias("text"))
    compared = texts.join(small_side(members, BROADCAST_IDS), F.col("key") == F.col("member")).select("text", (F.col("key") == F.col("first")).alias("is_first"))
    compared = written(compared.mapInArrow(run, "digest string, canon binary, check binary, is_first boolean"), "buckets")
    heads = written(compared.filter("is_first").groupBy("digest").agg(F.min("canon").alias("head")), "heads")
    # A table once more: what is counted by digest afterwards would else keep the join's partitions as they are.
    odd = written(compared.join(heads, "digest").filter("canon <> head").select("digest", "canon", "check"), "odd").distinct()
    return odd.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("canon", "check"))).alias("all")).select("digest", F.posexplode("all").alias("number", "text")).select("digest", "text.check", "number")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows_each: int = 20_000) -> DataFrame:
    """edits() with a column fingerprint, checked byte by byte inside buckets."""
    marked = written(edits(docs, id_col, text_col, rows_each), "digests")
    odd = written(collisions(docs, marked, id_col, text_col), "collisions")
    if not odd.limit(1).count():
        return marked.withColumn("fingerprint", F.col("digest"))
    own = F.when(F.col("number").isNull(), F.col("digest")).otherwise(F.concat("digest", F.lit("-"), F.col("number").cast("string")))
    return marked.join(small_side(odd, BROADCAST_IDS), ["digest", "check"], "left").withColumn("fingerprint", own).drop("number")


def likeness(same):
    """Of two exact digests: 1 if equal, else 0."""
    return F.when(same, F.lit(1.0)).otherwise(F.lit(0.0))
