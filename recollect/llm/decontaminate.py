"""Benchmark decontamination with a distributed positional inverted index.

Documents are indexed in segments of about half a million words. A segment keeps, for every term it holds,
the sorted positions of that term; positions run on through the segment's documents with one free position
between two, so no phrase crosses a border. The index is a table, made without a shuffle and independent of
the test set. A query block (the test items' windows, bounded in words) visits all segments: a window whose
terms are not all present is skipped, others start from the rarest term's list, shift it by the term's
offset and intersect it with the next rarest until none is left. An item is near a document if some stretch of
the document, ``slop`` words longer than the item at most, holds every term of the item. The rarest term's list
gives the candidates, the others are verified, so segments do not change what is found.

Defined results: a null text has no words; an item without words matches nothing; an item shorter than a
window is one window; items with equal ids are one item; a null item id is written as an empty string;
repeated rows are judged alike; a text of any length is one document of one segment; empty tables give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import handing_back, written

#: ASCII other than digits and letters parts words; A-Z become a-z.
_FOLD = bytes((i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32) for i in range(256))
SEGMENT_WORDS = 1 << 19
BLOCK_WORDS = 1 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """One row per segment, with a number of its own: its documents (ids, whether the id is null, word counts), its terms joined by spaces,
    each term's number of postings and the positions, in terms' order."""

    def segment(ids, counts, words):
        base = np.cumsum(np.array(counts, np.int64) + 1) - (np.array(counts, np.int64) + 1)
        number: dict[bytes, int] = {}
        terms = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
        places = np.arange(len(words), dtype=np.int64) + np.repeat(np.arange(len(counts)), counts)
        order = np.argsort(terms, kind="stable")
        return {"ids": ids, "n_words": counts, "base": base.tolist(), "terms": b" ".join(number), "df": np.bincount(terms, minlength=len(number)).astype("<u4").tobytes(), "positions": places[order].astype("<u4").tobytes()}

    def run(batches):
        ids, counts, words = [], [], []
        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                own = words_of(text.as_py())
                ids.append(key.as_py())
                counts.append(len(own))
                words += own
                if len(words) >= segment_words:
                    yield pa.RecordBatch.from_pylist([segment(ids, counts, words)], schema)
                    ids, counts, words = [], [], []
        if ids:
            yield pa.RecordBatch.from_pylist([segment(ids, counts, words)], schema)

    schema = pa.schema([("ids", pa.list_(pa.int64())), ("n_words", pa.list_(pa.int64())), ("base", pa.list_(pa.int64())), ("terms", pa.binary()), ("df", pa.binary()), ("positions", pa.binary())])
    made = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(handing_back(run), "ids array<long>, n_words array<long>, base array<long>, terms binary, df binary, positions binary")
    return written(made.withColumn("segment", F.monotonically_increasing_id()), "index")


class QueryBlock:
    """The windows of a block of items: term numbers by window, padded with -1, and the items of each window."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window, self.number, rows, owners = window, {}, {}, []
        self.items: list[str] = sorted({name for name, _ in items})
        at = {name: i for i, name in enumerate(self.items)}
        self.bags: list[tuple[int, list[int], int]] = []
        for name, text in items:
            own = [self.number.setdefault(w, len(self.number)) for w in words_of(text)]
            if not own:
                continue
            self.bags.append((at[name], sorted(set(own)), len(own)))
            for i in range(max(1, len(own) - window + 1)):
                k = rows.setdefault(tuple(own[i : i + window]), len(rows))
                if k == len(owners):
                    owners.append(set())
                owners[k].add(at[name])
        self.owners = [sorted(x) for x in owners]
        self.rows = np.full((len(rows), window), -1, np.int64)
        for k, row in enumerate(rows):
            self.rows[k, : len(row)] = row


class Segment:
    """A segment's postings, as far as a query block asks for them."""

    def __init__(self, terms: bytes, df: bytes, positions: bytes, block: QueryBlock):
        counts = np.frombuffer(df, "<u4").astype(np.int64)
        ends = np.cumsum(counts)
        self.positions = np.frombuffer(positions, "<u4")
        self.lists: list[tuple[int, int]] = [(0, 0)] * len(block.number)
        self.df = np.zeros(len(block.number) + 1, np.int64)  # the last, for padding, stays 0
        for k, term in enumerate(terms.split(b" ") if len(counts) else []):
            if (q := block.number.get(term)) is not None:
                self.lists[q] = (int(ends[k] - counts[k]), int(ends[k]))
                self.df[q] = counts[k]

    def postings(self, q: int) -> np.ndarray:
        a, b = self.lists[q]
        return self.positions[a:b].astype(np.int64)


def _within(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.searchsorted(among, values)
    return (at < len(among)) & (among[np.minimum(at, len(among) - 1)] == values)


def phrase_matches(seg: Segment, block: QueryBlock) -> list[tuple[int, np.ndarray]]:
    """(window, start positions) for each window of the block that occurs."""
    found = []
    lacks = (seg.df[block.rows] == 0) & (block.rows >= 0)
    for k in np.flatnonzero(~lacks.any(axis=1)).tolist():
        row = block.rows[k]
        row = row[row >= 0]
        order = np.argsort(seg.df[row], kind="stable").tolist()
        starts = seg.postings(int(row[order[0]])) - order[0]
        for j in order[1:]:
            if not len(starts):
                break
            starts = starts[_within(starts + j, seg.postings(int(row[j])))]
        if len(starts):
            found.append((k, starts))
    return found


def _covered(places: list[np.ndarray], width: int) -> bool:
    """Whether a stretch of width words holds a place of each list."""
    at = np.concatenate(places)
    order = np.argsort(at, kind="stable")
    at, term = at[order].tolist(), np.repeat(np.arange(len(places)), [len(p) for p in places])[order].tolist()
    last, first, missing = [0] * len(places), 0, len(places)
    for x, t in zip(at, term, strict=True):
        missing -= last[t] == 0
        last[t] += 1
        while x - at[first] >= width:
            last[term[first]] -= 1
            missing += last[term[first]] == 0
            first += 1
        if not missing:
            return True
    return False


def proximity_matches(seg: Segment, block: QueryBlock, slop: int, base: np.ndarray) -> list[tuple[int, list[int]]]:
    """(item, documents of the segment) where all terms of the item lie in a stretch of its length and slop words."""
    found = []
    for item, bag, length in block.bags:
        df, width = seg.df[bag], length + slop
        if (df == 0).any():
            continue
        near = [bag[i] for i in np.argsort(df, kind="stable").tolist()]
        at = seg.postings(near[0])
        for q in near[1:]:
            if not len(at):
                break
            other = seg.postings(q)
            after = np.searchsorted(other, at - width + 1)
            at = at[(after < len(other)) & (other[np.minimum(after, len(other) - 1)] < at + width)]
        docs = []
        for doc in np.unique(np.searchsorted(base, at, "right") - 1).tolist():
            ends = (base[doc], base[doc + 1] if doc + 1 < len(base) else np.iinfo(np.int64).max)
            own = [p[slice(*np.searchsorted(p, ends))] for p in map(seg.postings, near)]
            if all(map(len, own)) and _covered(own, width):
                docs.append(doc)
        if docs:
            found.append((item, docs))
    return found


def query_index(index: DataFrame, items: list[tuple[str, bytes]], window: int = 10, slop: int = 0) -> DataFrame:
    """One row per document: segment and place in it, id, n_words, hit words as (starts, ends), matching items, near items."""
    shared = index.sparkSession.sparkContext.broadcast(QueryBlock(items, window))

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(list(judge(row, shared.value)), schema)

    def judge(row, block):
        seg = Segment(row["terms"], row["df"], row["positions"], block)
        base = np.array(row["base"], np.int64)
        items_of: dict[int, set[int]] = {}
        near_of: dict[int, set[int]] = {}
        spans = []
        for k, starts in phrase_matches(seg, block):
            length = int((block.rows[k] >= 0).sum())
            spans.append(np.stack([starts, starts + length]))
            for doc in np.unique(np.searchsorted(base, starts, "right") - 1).tolist():
                items_of.setdefault(doc, set()).update(block.owners[k])
        if slop:
            for item, docs in proximity_matches(seg, block, slop, base):
                for doc in docs:
                    near_of.setdefault(doc, set()).add(item)
        hits: dict[int, list[list[int]]] = {}
        if spans:
            a, b = np.concatenate(spans, axis=1)
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            first = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
            a, b = a[first], b[np.concatenate((first[1:] - 1, [len(b) - 1]))]
            for x, y, doc in zip(a.tolist(), b.tolist(), (np.searchsorted(base, a, "right") - 1).tolist(), strict=True):
                hits.setdefault(doc, []).append([x - int(base[doc]), y - int(base[doc])])
        for i, (key, n) in enumerate(zip(row["ids"], row["n_words"], strict=True)):
            own = hits.get(i, [])
            yield {"row": [row["segment"], i], "id": key, "n_words": n, "starts": [x for x, _ in own], "ends": [y for _, y in own], "items": sorted(block.items[j] for j in items_of.get(i, ())), "near": sorted(block.items[j] for j in near_of.get(i, ()))}

    schema = pa.schema([("row", pa.list_(pa.int64())), ("id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])
    return index.mapInArrow(handing_back(run), "row array<long>, id long, n_words long, starts array<long>, ends array<long>, items array<string>, near array<string>")


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: id, n_words, starts and ends of its hit stretches (disjoint, in words), items, near.

    The test set goes to the executors in blocks of about block_words words, one at a time: the driver reads a block,
    broadcasts it and writes what it finds. The stretches that a document gets from several blocks are united."""
    index = build_index(docs, id_col, text_col)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("name"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    blocks = max(1, -(-int(size) // (6 * block_words)))
    parts = []
    for k in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("name"), F.lit(blocks)) == k) if blocks > 1 else items
        part = query_index(index, [(r.name, r.text.encode()) for r in own.toLocalIterator()], window, slop)
        parts.append(part if blocks == 1 else written(part, "block"))
    if blocks == 1:
        return parts[0].drop("row")
    all_parts = parts[0]
    for more in parts[1:]:
        all_parts = all_parts.unionByName(more)
    grouped = all_parts.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
    none = F.array().cast("array<struct<starts:bigint,ends:bigint>>")

    def unite(done, one):
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["starts"].alias("starts"), F.greatest(last["ends"], one["ends"]).alias("ends"))))
        return F.when((F.size(done) > 0) & (one["starts"] <= F.try_element_at(done, F.lit(-1))["ends"]), joined).otherwise(F.concat(done, F.array(one)))

    united = grouped.withColumn("s", F.aggregate(F.array_sort("s"), none, unite))
    return united.select("id", "n_words", F.col("s.starts").alias("starts"), F.col("s.ends").alias("ends"), "items", "near")


def digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()


#: DuckDB SQL of the op10 query.
SQL = r"""
with w as (select row_number() over () as row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
b as (select row_number() over () as text_no, coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
runs as (select item, words, least(10, len(words)) as n, unnest(range(1, greatest(1, len(words) - 9) + 1)) as i from b where len(words) > 0),
asked as (select distinct item, n, array_to_string(words[i:i + n - 1], ' ') as run from runs),
lengths as (select distinct n from asked),
places as (select row_no, words, n, unnest(range(1, len(words) - n + 2)) as i from w, lengths where len(words) >= n),
found as (select row_no, p.i, p.n, item from places p join asked a on a.n = p.n and a.run = array_to_string(p.words[p.i:p.i + p.n - 1], ' ')),
hit as (select row_no, count(distinct j) as n_hit from (select row_no, unnest(range(i, i + n)) as j from (select distinct row_no, i, n from found)) group by row_no),
named as (select row_no, list_sort(list(distinct item)) as items from found group by row_no),
posted as (select row_no, words[i] as term, i from (select row_no, words, unnest(range(1, len(words) + 1)) as i from w)),
bags as (select text_no, item, len(words) + 32 as width, unnest(list_distinct(words)) as term, len(list_distinct(words)) as n_terms from b where len(words) > 0),
both_have as (select text_no, row_no from (select distinct row_no, term from posted) join bags using (term) group by text_no, row_no having count(*) = any_value(n_terms)),
spans as (select item, row_no, n_terms, count(distinct term) over (partition by text_no, row_no order by i range between width - 1 preceding and current row) as seen from both_have join bags using (text_no) join posted using (row_no, term)),
near as (select row_no, count(distinct item) as n_near from spans where seen = n_terms group by row_no)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(len(items), 0)::bigint as n_items, sha256(coalesce(array_to_string(items, ','), '')) as items_sha256,
  n_hit is not null as contaminated, coalesce(n_near, 0)::bigint as n_near_items from w left join hit using (row_no) left join named using (row_no) left join near using (row_no)
"""
