"""Substring dedup with fixed-block anchors.

A window is ``window`` consecutive words. Any window of a document holds one whole block of ``block`` =
(window + 1) // 2 words that begins at a multiple of ``block``. So:

1. Anchors. The aligned blocks of all documents are the index, all rolling blocks the probes. Both go to hash
   buckets in one exchange. A rolling block survives if its hash comes in two documents and is aligned in one.
2. Extension. Around the survivors, and only there, whole windows are hashed (96 bits) and meet in a second
   exchange that gives each window the smallest id it starts in. Windows with a larger id are repeats; runs of
   overlapping repeats are the maximal exact repeats that are removed.

Probes travel packed: a task sorts the blocks of about a million words at a time (a chunk), keeps one entry for equal
blocks of a chunk and sends each bucket one binary row. Equal blocks of several documents of a chunk are survivors at
once, so a passage that stands in a third of all documents costs one entry for each chunk, in either exchange, and
no pair of documents is ever formed. A row for each chunk and bucket would make rows grow with the square of the
corpus. Beyond DIRECT_BUCKETS, therefore, a chunk sends rows to about the square root of that many coarse buckets; there
the rows of a team of as many chunks are merged, equal entries again into one, and split into fine buckets; answers go
back the same way. Rows then grow with the power 1.5, each of a kilobyte or more at any size. Results are the same.
Answers name an entry's first place; where the text is at hand again, all equal
blocks of the document are found from it. Texts are shuffled twice, for survivors and for removal.

Defined results: a null text has no words; shorter documents have no window and keep all words; a null id is larger
than all others; rows with equal ids do not repeat each other; equal rows get equal results; a text of any length is
handled whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import written

WINDOW = 13
CHUNK_WORDS, BUCKET_WORDS = 1 << 20, 1 << 19
#: With more buckets than this, some fifty GB of text, entries go by way of coarse buckets.
DIRECT_BUCKETS = 1 << 14
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_ALIGNED, _SHARED = np.uint32(1 << 31), np.uint32(1 << 30)
_PLACE = np.uint32((1 << 30) - 1)
NULL_ID = (1 << 63) - 1


def word_hashes(text: bytes | None) -> tuple[list[bytes], np.ndarray]:
    words = (text or b"").split()
    return words, np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, length: int, odd: int = _ODD[0]) -> np.ndarray:
    """Hashes of all runs of length words, well mixed in all bits."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.zeros(n, np.uint64), np.uint64(odd)
    for i in range(length):
        out = out * factor + hashes[i : i + n]
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(33)
    out *= np.uint64(0xC4CEB9FE1A85EC53)
    return out ^ (out >> np.uint64(33))


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    """First index of each run of equal keys."""
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.zeros(0, np.int64)


def _bounds(first: np.ndarray, n: int) -> list[tuple[int, int]]:
    return list(zip(first.tolist(), np.append(first[1:], n)[: len(first)].tolist(), strict=True))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Of the upper 32 bits, in the order of h."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


@dataclass(frozen=True)
class Routes:
    """How entries find their buckets: coarse * fine of them. Where fine is 1, each chunk sends a row to every bucket. Else
    each sends a row to every coarse one, in which the rows of a team of chunks are merged and split into fine ones."""

    coarse: int
    fine: int = 1
    teams: int = 1

    @classmethod
    def of(cls, words: int, chunk_words: int, bucket_words: int, direct: int) -> Routes:
        buckets = words // bucket_words + 1
        if buckets <= direct:
            return cls(buckets)
        coarse = isqrt(buckets - 1) + 1
        return cls(coarse, -(-buckets // coarse), words // (chunk_words * coarse) + 1)

    def team(self, chunk: int) -> int:
        return int(self.teams_of(np.array([chunk]))[0])

    def teams_of(self, chunks: np.ndarray) -> np.ndarray:
        return ((chunks >> 32) * 1_000_003 + (chunks & 0xFFFFFFFF)) % self.teams

    def split(self, keys: np.ndarray, columns: list[np.ndarray]) -> list[tuple[int, bytes]]:
        """(bucket of the first exchange, its columns as bytes) of entries in the order of keys."""
        number = _bucket(keys, self.coarse * self.fine)
        if self.fine > 1:
            columns = [(number % np.uint64(self.fine)).astype("<u4"), *columns]
        return _packets((number // np.uint64(self.fine)).astype(np.int64), columns)


def _packets(sorted_numbers: np.ndarray, columns: list[np.ndarray]) -> list[tuple[int, bytes]]:
    return [(int(sorted_numbers[a]), b"".join(c[a:z].tobytes() for c in columns)) for a, z in _bounds(_groups(sorted_numbers), len(sorted_numbers))]


def _columns(blobs: list[bytes], kinds: tuple[str, ...]) -> tuple[list[np.ndarray], list[int]]:
    """The columns of several packets, and the number of entries of each packet."""
    widths = [np.dtype(k).itemsize for k in kinds]
    out, sizes = [[] for _ in kinds], [len(b) // sum(widths) for b in blobs]
    for blob, n in zip(blobs, sizes, strict=True):
        at = 0
        for column, kind, width in zip(out, kinds, widths, strict=True):
            column.append(np.frombuffer(blob, kind, n, at))
            at += n * width
    return [np.concatenate(c) for c in out], sizes


def _by_owner(places: np.ndarray, owner: np.ndarray) -> list[tuple[int, bytes]]:
    order = np.argsort(owner, kind="stable")
    return _packets(owner[order], [places[order].astype("<u4")])


ROWS = "bucket long, team long, chunk long, kind int, blob binary, ids array<long>, hashes array<long>, starts array<long>"
_SCHEMA = pa.schema([("bucket", pa.int64()), ("team", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary()), ("ids", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])
#: Entries on their way to a bucket; answers on their way to a chunk; a chunk's documents and the places it knows by itself.
ENTRIES, ANSWERS, TABLE = 0, 1, 2


class Chunk:
    """Some documents' runs of words, to be sent to buckets. keys: (key, place, doc, aligned) arrays by document."""

    def __init__(self, number: int):
        self.number, self.words, self.ids, self.hashes, self.starts, self.parts = number, 0, [], [], [], []

    def add(self, doc_id: int, text_hash: int, n_words: int, keys: np.ndarray, more: np.ndarray | None, places: np.ndarray) -> None:
        self.parts.append((keys, more, places + self.words, len(self.ids)))
        self.ids.append(doc_id)
        self.hashes.append(text_hash)
        self.starts.append(self.words)
        self.words += n_words

    def rows(self, routes: Routes, runs: Runs) -> list[dict]:
        if not self.ids:
            return []
        keys = np.concatenate([p[0] for p in self.parts])
        more = np.concatenate([p[1] for p in self.parts]) if self.parts[0][1] is not None else None
        places = np.concatenate([p[2] for p in self.parts]).astype(np.uint32)
        docs = np.repeat(np.array([p[3] for p in self.parts]), [len(p[0]) for p in self.parts])
        at_once, parts = runs.entries(self, keys, more, places, docs, routes)
        team = routes.team(self.number)
        out = [{"bucket": b, "team": team, "chunk": self.number, "kind": ENTRIES, "blob": blob} for b, blob in parts]
        return [*out, {"bucket": self.number % routes.coarse, "team": team, "chunk": self.number, "kind": TABLE, "blob": np.unique(at_once).astype("<u4").tobytes(), "ids": self.ids, "hashes": self.hashes, "starts": self.starts}]


class Runs:
    """What is sent of runs of words: entries makes a chunk's, merged unites those of a team, answers judges a bucket's.

    merged returns (number of the fine bucket, columns, owners) of what is left in the order of keys, and
    (places, owners) of what needs no further judgement; answers returns (places, owners)."""

    kinds: tuple[str, ...]


class Anchors(Runs):
    """Blocks, eight bytes an entry: 32 hash bits after the bucket's, the place of the first occurrence and two flags."""

    kinds = ("<u4", "<u4")

    @staticmethod
    def entries(chunk: Chunk, keys, more, places, docs, routes: Routes):
        order = np.argsort(keys, kind="stable")
        keys, places, docs = keys[order], places[order], docs[order]
        first = _groups(keys)
        if not len(first):
            return places, []
        aligned = np.maximum.reduceat(more[order].astype(np.uint8), first).astype(bool)
        shared = np.maximum.reduceat(docs, first) != np.minimum.reduceat(docs, first)
        at_once = places[np.repeat(shared, np.diff(np.append(first, len(keys))))]
        entry = places[first] | np.where(aligned, _ALIGNED, np.uint32(0)) | np.where(shared, _SHARED, np.uint32(0))
        head = keys[first]
        return at_once, routes.split(head, [(head & np.uint64(0xFFFFFFFF)).astype("<u4"), entry.astype("<u4")])

    @staticmethod
    def merged(fine: np.ndarray, columns, owner: np.ndarray):
        """Blocks of several chunks are survivors at once; one entry stands for them, marked as shared."""
        low, entry = columns
        order = np.lexsort((low, fine))
        fine, low, entry, owner = fine[order], low[order], entry[order], owner[order]
        first = _groups((fine.astype(np.uint64) << np.uint64(32)) | low.astype(np.uint64))
        sizes = np.diff(np.append(first, len(low)))
        known = np.repeat(sizes > 1, sizes) & (entry & _SHARED == 0)
        flags = np.bitwise_or.reduceat(entry, first) & ~_PLACE
        kept = (entry[first] & _PLACE) | flags | np.where(sizes > 1, _SHARED, np.uint32(0))
        return fine[first], [low[first], kept.astype("<u4")], owner[first], entry[known] & _PLACE, owner[known]

    @staticmethod
    def answers(columns, owner: np.ndarray):
        """Of the entries whose block stands in two documents and is aligned in one; shared ones are known already."""
        low, entry = columns
        order = np.argsort(low, kind="stable")
        low, entry, owner = low[order], entry[order], owner[order]
        first = _groups(low)
        sizes = np.diff(np.append(first, len(low)))
        flags = np.bitwise_or.reduceat(entry, first)
        alive = np.repeat((flags & _ALIGNED != 0) & ((sizes > 1) | (flags & _SHARED != 0)), sizes) & (entry & _SHARED == 0)
        return entry[alive] & _PLACE, owner[alive]


class Windows(Runs):
    """Windows, twenty-four bytes an entry: 64 and 32 hash bits, place, and the smallest id known; larger ids are repeats at once."""

    kinds = ("<u8", "<i8", "<u4", "<u4")

    @staticmethod
    def _least(keys, ids, more) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Order by key and id; in it, the first of each key, how many have it, and the smallest id of each entry's key."""
        order = np.lexsort((ids, more, keys))
        keys, more, ids = keys[order], more[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])))) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(first, len(keys)))
        return order, first, sizes, np.repeat(ids[first], sizes)

    @staticmethod
    def entries(chunk: Chunk, keys, more, places, docs, routes: Routes):
        ids = np.array(chunk.ids, np.int64)[docs]
        order, first, sizes, least = Windows._least(keys, ids, more)
        keys, more, places, ids = keys[order], more[order], places[order], ids[order]
        if not len(first):
            return places, []
        at_once = places[ids > least]
        # One entry for each row (document) that has the smallest id, as rows with equal ids answer for themselves.
        key_no = np.repeat(np.arange(len(first)), sizes)
        rows = np.searchsorted(np.array(chunk.starts), places, "right")
        mine = np.flatnonzero(ids == least)
        _, pick = np.unique(np.stack([key_no[mine], rows[mine]]), axis=1, return_index=True) if len(mine) != len(first) else (None, np.arange(len(mine)))
        mine = mine[np.sort(pick)]
        return at_once, routes.split(keys[mine], [keys[mine].astype("<u8"), ids[mine].astype("<i8"), more[mine].astype("<u4"), places[mine].astype("<u4")])

    @staticmethod
    def merged(fine: np.ndarray, columns, owner: np.ndarray):
        keys, ids, more, places = columns
        order, _, _, least = Windows._least(keys, ids, more)
        kept, larger = order[ids[order] == least], order[ids[order] > least]
        return fine[kept], [c[kept] for c in columns], owner[kept], places[larger], owner[larger]

    @staticmethod
    def answers(columns, owner: np.ndarray):
        """Of the entries whose window starts in a document with a smaller id."""
        keys, ids, more, places = columns
        order, _, _, least = Windows._least(keys, ids, more)
        repeated = order[ids[order] > least]
        return places[repeated], owner[repeated]


def _exchange(packed: DataFrame, runs: type[Runs], routes: Routes, name: str) -> DataFrame:
    """packed rows to their buckets, answers to their chunks, and from there (id, hash, places as binary), by document."""

    def of_kind(table: pa.Table, kind: int) -> pa.Table:
        return table.filter(pa.array([k == kind for k in table.column("kind").to_pylist()], pa.bool_()))

    def answered(places: np.ndarray, owner: np.ndarray) -> list[dict]:
        return [{"bucket": 0, "team": 0, "chunk": c, "kind": ANSWERS, "blob": b} for c, b in _by_owner(places, owner)]

    def merge(table: pa.Table) -> pa.Table:
        sent, out = of_kind(table, ENTRIES), [of_kind(table, TABLE)]
        if sent.num_rows:
            coarse, team = sent.column("bucket")[0].as_py(), sent.column("team")[0].as_py()
            columns, sizes = _columns(sent.column("blob").to_pylist(), ("<u4", *runs.kinds))
            fine, kept, owner, places, known = runs.merged(columns[0], columns[1:], np.repeat(sent.column("chunk").to_numpy(), sizes))
            order = np.argsort(fine, kind="stable")
            parts = _packets(fine[order].astype(np.int64), [owner[order].astype("<i8"), *[c[order] for c in kept]])
            made = [{"bucket": coarse * routes.fine + b, "team": team, "chunk": 0, "kind": ENTRIES, "blob": blob} for b, blob in parts]
            out.append(pa.Table.from_pylist([*made, *answered(places, known)], _SCHEMA))
        return pa.concat_tables(out)

    def judge(table: pa.Table) -> pa.Table:
        """A bucket's answers, by team; they go back through as many tasks as there are coarse buckets."""
        columns, _ = _columns(table.column("blob").to_pylist(), ("<i8", *runs.kinds))
        places, owner = runs.answers(columns[1:], columns[0])
        teams = routes.teams_of(owner)
        order = np.argsort(teams, kind="stable")
        back = table.column("bucket")[0].as_py() % routes.coarse
        parts = _packets(teams[order], [owner[order].astype("<i8"), places[order].astype("<u4")])
        return pa.Table.from_pylist([{"bucket": back, "team": t, "chunk": 0, "kind": ANSWERS, "blob": b} for t, b in parts], _SCHEMA)

    def spread(table: pa.Table) -> pa.Table:
        (owner, places), _ = _columns(table.column("blob").to_pylist(), ("<i8", "<u4"))
        return pa.Table.from_pylist(answered(places, owner), _SCHEMA)

    def reduce(table: pa.Table) -> pa.Table:
        sent, out = of_kind(table, ENTRIES), [of_kind(table, TABLE)]
        if sent.num_rows:
            columns, sizes = _columns(sent.column("blob").to_pylist(), runs.kinds)
            out.append(pa.Table.from_pylist(answered(*runs.answers(columns, np.repeat(sent.column("chunk").to_numpy(), sizes))), _SCHEMA))
        return pa.concat_tables(out)

    def gather(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        found = np.unique(np.concatenate([np.frombuffer(r["blob"], "<u4") for r in rows])).astype(np.int64)
        out = []
        if not len(found):
            rows = []
        for r in (r for r in rows if r["kind"] == TABLE):
            starts = np.array(r["starts"], np.int64)
            row = np.searchsorted(starts, found, "right") - 1
            for a, z in _bounds(_groups(row), len(row)):
                k = int(row[a])
                out.append({"id": r["ids"][k], "hash": r["hashes"][k], "places": (found[a:z] - starts[k]).astype("<u4").tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("id", pa.int64()), ("hash", pa.int64()), ("places", pa.binary())]))

    if routes.fine > 1:
        merged = written(packed.groupBy("bucket", "team").applyInArrow(merge, ROWS), f"{name}-merged")
        judged = written(merged.filter(F.col("kind") == ENTRIES).groupBy("bucket").applyInArrow(judge, ROWS), f"{name}-judged")
        reduced = merged.filter(F.col("kind") != ENTRIES).unionByName(judged.groupBy("bucket", "team").applyInArrow(spread, ROWS))
    else:
        reduced = written(packed.groupBy("bucket").applyInArrow(reduce, ROWS), name)
    found = reduced.select("chunk", "kind", "blob", "ids", "hashes", "starts")
    return found.groupBy("chunk").applyInArrow(gather, "id long, hash long, places binary").dropDuplicates(["id", "hash"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))


def _packed(rows: DataFrame, keys_of, runs: type[Runs], routes: Routes, chunk_words: int) -> DataFrame:
    """rows (id, hash, text, ...) in chunks, to buckets. keys_of: of a batch's row, (keys, more, places, number of words) or nothing."""

    def run(batches):
        task = TaskContext.get().partitionId() << 32
        chunk = Chunk(task)
        for batch in batches:
            columns = batch.schema.names
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i] for j, c in enumerate(columns)}
                got = keys_of(row)
                if got is None:
                    continue
                keys, more, places, n = got
                chunk.add(row["id"].as_py(), row["hash"].as_py(), n, keys, more, places)
                if chunk.words >= chunk_words:
                    yield pa.RecordBatch.from_pylist(chunk.rows(routes, runs), _SCHEMA)
                    chunk = Chunk(chunk.number + 1)
        if chunk.ids:
            yield pa.RecordBatch.from_pylist(chunk.rows(routes, runs), _SCHEMA)

    return rows.mapInArrow(run, ROWS)


def _covered(hashes: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """Places of all runs that equal one at the given places."""
    keys = rolling(hashes, length)
    return np.flatnonzero(np.isin(keys, keys[places]))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, chunk_words: int = CHUNK_WORDS, bucket_words: int = BUCKET_WORDS, direct: int = DIRECT_BUCKETS) -> DataFrame:
    """(id, hash, places): by document (a null id as NULL_ID) and text hash, the first places of windows that start in a document with a smaller id."""
    block = (window + 1) // 2
    texts = _texts(docs, id_col, text_col)
    words = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0] // 6
    routes = Routes.of(int(words), chunk_words, bucket_words, direct)

    def anchors(row):
        _, hashes = word_hashes((row["text"].as_py() or "").encode())
        if len(hashes) < window:
            return None
        keys = rolling(hashes, block)
        places = np.arange(len(keys))
        return keys, places % block == 0, places, len(hashes)

    survivors = _exchange(_packed(texts.select("id", "hash", "text"), anchors, Anchors, routes, chunk_words), Anchors, routes, "anchors")

    def windows(row):
        _, hashes = word_hashes((row["text"].as_py() or "").encode())
        hits = _covered(hashes, np.frombuffer(row["places"].as_py(), "<u4"), block)
        inside = np.zeros(len(hashes) - window + 2, np.int64)
        np.add.at(inside, np.maximum(hits - (window - block), 0), 1)
        np.add.at(inside, np.minimum(hits + 1, len(inside) - 1), -1)
        places = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        keys = rolling(hashes, window)
        more = rolling(hashes, window, _ODD[1])
        return keys[places], (more[places] >> np.uint64(32)).astype(np.uint32), places, len(hashes)

    near = texts.join(survivors.select(F.col("id").alias("i"), F.col("hash").alias("h"), "places"), (F.col("id") == F.col("i")) & (F.col("hash") == F.col("h")))
    return _exchange(_packed(near.select("id", "hash", "text", "places"), windows, Windows, routes, chunk_words), Windows, routes, "windows")


def removal(texts: DataFrame, found: DataFrame) -> DataFrame:
    return texts.join(found.select(F.col("id").alias("i"), F.col("hash").alias("h"), "places"), (F.col("id") == F.col("i")) & (F.col("hash") == F.col("h")), "left").drop("i", "h")


def kept_mask(hashes: np.ndarray, places: bytes | None, window: int) -> np.ndarray:
    keep = np.ones(len(hashes), bool)
    if places:
        hits = _covered(hashes, np.frombuffer(places, "<u4"), window)
        edge = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edge, hits, 1)
        np.add.at(edge, hits + window, -1)
        keep = np.cumsum(edge[:-1]) == 0
    return keep


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = False, **sizes) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256 and, with_text, kept (the words kept, joined by single spaces)."""
    found = written(repeats(docs, id_col, text_col, window, **sizes), "repeats")
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.string())] if with_text else [])])

    def run(batches):
        for batch in batches:
            out = []
            for key, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if (blob := places.as_py()) is None:
                    words = (text.as_py() or "").encode().split()
                    kept = b" ".join(words)
                    removed = 0
                else:
                    words, hashes = word_hashes((text.as_py() or "").encode())
                    keep = kept_mask(hashes, blob, window)
                    kept = b" ".join([w for w, k in zip(words, keep.tolist(), strict=True) if k])
                    removed = int((~keep).sum())
                out.append((key, len(words), removed, hashlib.sha256(kept).hexdigest(), *([kept.decode()] if with_text else [])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    texts = removal(_texts(docs, id_col, text_col), found)
    return texts.select("doc", "text", "places").mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else ""))


#: DuckDB SQL of the op9 query.
SQL = r"""
with w as (select row_number() over () as row_no, doc_id, coalesce(doc_id, 9223372036854775807) as key, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
p as (select row_no, key, words, unnest(range(1, len(words) - 11)) as i from w where len(words) >= 13),
g as (select row_no, key, i, array_to_string(words[i:i + 12], ' ') as run from p),
least as (select run, min(key) as first from g group by run),
gone as (select distinct row_no, unnest(range(i, i + 13)) as i from g join least using (run) where key > first),
lost as (select row_no, list(i) as places, count(*) as n from gone group by row_no)
select doc_id, len(words)::bigint as n_words, coalesce(n, 0)::bigint as n_removed,
  sha256(array_to_string(case when n is null then words else [words[i] for i in range(1, len(words) + 1) if not list_contains(places, i)] end, ' ')) as kept_sha256
from w left join lost using (row_no)
"""
