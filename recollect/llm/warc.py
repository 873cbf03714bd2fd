"""WARC records in a content-addressed archive.

An archive is a folder of three tables. ``payloads`` has each different payload once, under its SHA-256, with its
SHA-1 and length; ``headers`` has every record's header block, byte by byte, with the SHA-256 of the payload it speaks
of; ``records`` of the original input are not stored. A payload of at least ``least_bytes`` that several records share
belongs to the one with the largest id, a response; the others are revisits, whose records carry headers only. Reading
back parses the header bytes and joins them with the payloads on the digest, after each payload's own digests and
length have been computed again from its bytes; a payload that fails this check raises an error.

Bytes move once: digests are made where the rows are read, decisions are made on digests alone, and only payloads of
responses are shuffled to be written. Holders are aggregated by digest and written as a table before records meet them, so
that adaptive execution can split a digest that a large part of all rows shares.

Defined results: a null payload counts as empty; a null id or address is written as an empty string and reads back as
null; equal rows are records of their own (of several rows with the largest id, each is a response); an empty
table makes an empty archive; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import scratch_path, shuffles_dropped, written

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hex_digits: Column) -> Column:
    """Base 32 of 40 hex digits, four times 40 bits."""
    out = []
    for part in range(4):
        n = F.conv(F.substring(hex_digits, 10 * part + 1, 10), 16, 10).cast("long")
        out += [F.substring(F.lit(ALPHABET), (F.shiftright(n, shift).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for shift in range(35, -1, -5)]
    return F.concat(*out)


def _headers(kind: Column, key: Column, uri: Column, n: Column, digest: Column, refers_to: Column, date: str) -> Column:
    """The exact bytes of a header block, its empty line included. A revisit's block is empty."""
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), kind),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.coalesce(uri, F.lit("")), r"[\r\n]+", " ")),
        F.when(kind == "revisit", F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(kind == "revisit", F.concat(F.lit("WARC-Refers-To: <urn:page:"), refers_to.cast("string"), F.lit(">"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(kind == "revisit", F.lit("0")).otherwise(n.cast("string"))),
    ]
    return F.encode(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n")), "UTF-8")


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes the archive of pages, one record per row."""
    payload = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("key"), F.col(uri_col).cast("string").alias("uri"), payload.alias("payload"))
    seen = written(rows.select("key", "uri", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1")), "digests")
    keeper = written(seen.groupBy("sha256").agg(F.max("key").alias("holder")), "holders")
    first = keeper.withColumnRenamed("sha256", "of")
    shared = (F.col("n") >= least_bytes) & F.col("holder").isNotNull() & ((F.col("key") != F.col("holder")) | F.col("key").isNull())
    judged = seen.join(first, seen.sha256 == first.of).withColumn("kind", F.when(shared, "revisit").otherwise("response"))
    head = _headers(F.col("kind"), F.col("key"), F.col("uri"), F.col("n"), base32(F.col("sha1")), F.col("holder"), date)
    with shuffles_dropped(pages.sparkSession):
        judged.select("key", head.alias("header"), "sha256").write.option("compression", "zstd").parquet(f"{path}/headers")
        # One row stands for each digest: its holder, or, where all ids are null, any row of that digest.
        owned = keeper.filter("holder is not null").select(F.col("holder").alias("own"), F.col("sha256").alias("of"))
        bytes_of = rows.withColumn("sha256", F.sha2("payload", 256))
        held = bytes_of.join(owned.hint("shuffle_hash"), (F.col("key") == F.col("own")) & (F.col("sha256") == F.col("of")))
        lost = bytes_of.filter("key is null").join(keeper.filter("holder is null").select(F.col("sha256").alias("of")), F.col("sha256") == F.col("of"))
        stored = held.select("sha256", "payload").unionByName(lost.select("sha256", "payload")).dropDuplicates(["sha256"]) if seen.filter("key is null").limit(1).count() or _repeated(seen) else held.select("sha256", "payload")
        stored.select("sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("n"), "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def _repeated(seen: DataFrame) -> bool:
    """Whether a key comes twice with the same payload, so that a digest could be stored twice."""
    return bool(seen.groupBy("key", "sha256").count().filter("count > 1").limit(1).count())


def _field(header: Column, name: str) -> Column:
    found = F.regexp_extract(header, rf"(?m)^{name}: ([^\r\n]*)\r?$", 1)
    return F.when(found != "", found)


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, n, sha1, payload): each stored payload, checked against its address, digest and length."""
    stored = spark.read.parquet(f"{path}/payloads")
    sound = (F.sha2("payload", 256) == F.col("sha256")) & (F.sha1("payload") == F.col("sha1")) & (F.octet_length("payload") == F.col("n"))
    checked = F.when(sound, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its address "), F.col("sha256"))).cast("long"))
    return stored.select("sha256", checked.alias("n"), "sha1", "payload")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: key, uri, kind, digest, refers_to, n, header bytes, payload (the full one, for revisits, too).

    A reader that drops payload moves no payload bytes through the join."""
    header = F.decode("header", "UTF-8")
    key = F.regexp_extract(header, r"(?m)^WARC-Record-ID: <urn:page:(-?\d+)>", 1)
    refers = F.regexp_extract(header, r"(?m)^WARC-Refers-To: <urn:page:(-?\d+)>", 1)
    heads = spark.read.parquet(f"{path}/headers").select(
        F.when(key != "", key).cast("long").alias("key"), _field(header, "WARC-Target-URI").alias("uri"), _field(header, "WARC-Type").alias("kind"),
        F.regexp_extract(header, r"(?m)^WARC-Payload-Digest: sha1:([A-Z2-7]+)", 1).alias("digest"), F.when(refers != "", refers).cast("long").alias("refers_to"), "header", F.col("sha256").alias("of"),
    )
    held = read_payloads(spark, path)
    joined = heads.join(held, heads.of == held.sha256)
    same = F.col("digest") == base32(F.col("sha1"))
    return joined.select("key", "uri", "kind", F.when(same, F.col("digest")).otherwise(F.raise_error(F.lit("header and payload digests differ"))).alias("digest"), "refers_to", "n", "header", "payload")


def record_bytes(records: DataFrame) -> DataFrame:
    """records with a column record: the exact bytes as they stand in a WARC file."""
    block = F.when(F.col("kind") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.withColumn("record", F.concat("header", block, F.lit(b"\r\n\r\n")))


def archived(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes the archive of pages into the shared folder and reads its records back."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, path, id_col, uri_col, payload_col, least_bytes)
    return read_archive(pages.sparkSession, path)


#: DuckDB SQL of the op1 query. Base 32 of the SHA-1, 40 bits at a time.
SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h)) as n, sha1(h) as x, max(page_id) over (partition by h) as holder from p),
b as (select *, [('0x' || substr(x, 1 + 10 * i, 10))::bigint for i in range(4)] as parts from d)
select page_id, n::bigint as payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((parts[1 + i // 8] >> (35 - 5 * (i % 8))) & 31) + 1)::int, 1) for i in range(32)], '') as payload_digest,
  case when page_id = holder then 'response' else 'revisit' end as record_type,
  case when page_id <> holder then holder end as refers_to from b
"""
