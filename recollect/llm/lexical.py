"""Ranked lexical search: a threshold-seeded join for the k best documents of each item.

A document's score is the sum of its impacts on the item's terms; impacts are whole numbers of at least 0, so any part of a
score bounds it from below, and the largest impacts of the terms that are left bound the rest from above. The search keeps
for each term its k largest impacts and their documents (``tops``). Then

1. an item's k-th score is at least its terms' largest stored k-th impact; scoring exactly the documents stored for its
   terms raises that threshold;
2. the item's terms are ordered by their largest impacts; documents that hold none of the first ones, up to where the sum of
   the following bounds falls below ``slack`` times the threshold, can't reach it: only the postings of the first ones are joined;
3. of the documents met, those go whose partial sum and the bound of the rest stay below the threshold;
4. what is left is scored exactly over all terms and ranked.

Nothing is cut that could be among the k best, ties included. The rankings by term and by item are limits that Spark applies
in each task before it shuffles, so a frequent term or a score that thousands of copies share sends k rows a task.
Texts are read once; the index holds numbers only. Where the items' terms are few, a task keeps postings of those alone.

Defined results: a null text has no terms; each row of the items is an item of its own, whatever its id; an item without
terms, or whose terms no document holds, gives no rows; repeated documents are documents of their own; equal scores
come by ascending id, a null id last; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.llm.common import handing_back, small_side, written
from recollect.llm.decontaminate import words_of

#: Terms that tasks get as a set, rows that are broadcast, rows of postings in one Arrow batch.
WANTED, BROADCAST_ROWS, FLUSH = 200_000, 500_000, 100_000


def postings(rows: DataFrame, id_col: str, text_col: str, wanted: frozenset[bytes] | None = None) -> DataFrame:
    """(row, id, n, term, tf): a row with a null term for each row that has terms, n being their number with repeats,
    and one for each different term, if it is wanted."""
    schema = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("term", pa.string()), ("tf", pa.int64())])

    def run(batches):
        heads, terms, tfs = [], [], []

        def full():
            head = np.array([h[:2] for h in heads], np.int64).reshape(-1, 2)
            each = np.array([h[3] for h in heads], np.int64)
            ids = pa.array([h[2] for h in heads], pa.int64())
            at = pa.array(np.repeat(np.arange(len(heads)), each))
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(head[:, 0], each)), ids.take(at), pa.array(np.repeat(head[:, 1], each)), pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], schema=schema)

        for batch in batches:
            for row, key, text in zip(batch.column(0), batch.column(1), batch.column(2).cast(pa.binary()), strict=True):
                words = words_of(text.as_py())
                if not words:
                    continue
                counts = Counter(words)
                kept = [(w, k) for w, k in counts.items() if wanted is None or w in wanted]
                heads.append((row.as_py(), len(words), key.as_py(), 1 + len(kept)))
                terms += [None, *(w.decode() for w, _ in kept)]
                tfs += [None, *(k for _, k in kept)]
                if len(terms) >= FLUSH:
                    yield full()
                    heads, terms, tfs = [], [], []
        if heads:
            yield full()

    source = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(handing_back(run), "row long, id long, n long, term string, tf long")


def best_of(rows: DataFrame, key: str, k: int, *order) -> DataFrame:
    """The first k rows of each key, with their rank; each task limits its own rows before the shuffle."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter(F.col("rank") <= k)


def scored(pairs: DataFrame, asked: DataFrame, impacts: DataFrame) -> DataFrame:
    """(item, row, score) of the given (item, row), over all terms."""
    met = impacts.join(small_side(pairs, BROADCAST_ROWS), "row")
    return met.join(small_side(asked.select("item", "term", "times"), BROADCAST_ROWS), ["item", "term"]).groupBy("item", "row").agg(F.sum(F.col("times") * F.col("impact")).alias("score"))


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", slack: float = 0.4) -> DataFrame:
    """(item_id, rank, id, score): the k best documents of each item."""
    asked_terms = written(postings(items, item_col, item_text_col).filter("term is not null").withColumnRenamed("row", "item"), "items")
    terms = written(asked_terms.select("term").distinct(), "terms")
    few = terms.limit(WANTED + 1).count() <= WANTED
    found = postings(docs, id_col, text_col, frozenset(r.term.encode() for r in terms.toLocalIterator()) if few else None)
    index = written(found if few else found.join(terms.withColumnRenamed("term", "of"), F.col("term") == F.col("of"), "left").filter("term is null or of is not null").drop("of"), "postings")
    n, length = index.filter("term is null").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    of_terms = index.filter("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    weights = of_terms.select("term", F.monotonically_increasing_id().alias("number"), F.floor(1000 * F.log(F.lit(2.0 * n + 2) / (2 * F.col("df") + 1))).cast("long").alias("weight"))
    weights = small_side(written(weights, "weights"), BROADCAST_ROWS)
    share = F.expr(f"(1000000000L * tf) div (1000L * tf + 8L * (25L + (75L * n * {n}L) div {max(length, 1)}L))")
    impacts = written(index.filter("term is not null").join(weights, "term").select("row", F.col("number").alias("term"), (F.col("weight") * share).alias("impact")).filter("impact > 0"), "impacts")

    tops = written(best_of(impacts, "term", k, F.desc("impact"), "row"), "tops")
    stored = tops.groupBy("term").agg(F.max("impact").alias("best"), F.max(F.when(F.col("rank") == k, F.col("impact"))).alias("kth"))
    asked = asked_terms.join(weights, "term").select("item", F.col("number").alias("term"), F.col("tf").alias("times"))
    asked = written(asked.join(stored, "term").withColumn("most", F.col("times") * F.col("best")), "asked")
    seeds = asked.groupBy("item").agg(F.coalesce(F.max(F.col("times") * F.col("kth")), F.lit(0)).alias("seed"))
    first = written(asked.select("item", "term").join(tops.select("term", "row"), "term").select("item", "row").distinct(), "seeded")
    raised = best_of(scored(first, asked, impacts), "item", k, F.desc("score"), "row").filter(F.col("rank") == k).select("item", F.col("score").alias("raised"))
    limits = seeds.join(raised, "item", "left").select("item", F.greatest("seed", F.coalesce("raised", F.lit(0))).alias("least"))

    onward = W.partitionBy("item").orderBy(F.desc("most"), "term").rowsBetween(0, W.unboundedFollowing)
    bounded = asked.withColumn("from_here", F.sum("most").over(onward)).join(limits, "item").withColumn("late", F.col("from_here") < F.col("least") * slack)
    bounded = written(bounded, "bounds")
    rest = small_side(bounded.groupBy("item").agg(F.max("least").alias("least"), F.coalesce(F.max(F.when(F.col("late"), F.col("from_here"))), F.lit(0)).alias("rest")), BROADCAST_ROWS)
    early = small_side(bounded.filter(~F.col("late")).select("item", "term", "times"), BROADCAST_ROWS)
    partial = impacts.join(early, "term").groupBy("item", "row").agg(F.sum(F.col("times") * F.col("impact")).alias("part"))
    candidates = written(partial.join(rest, "item").filter(F.col("part") + F.col("rest") >= F.col("least")).select("item", "row"), "candidates")

    # Ties at the k-th place stay until ids are known.
    kept = scored(candidates, asked, impacts).withColumn("place", F.rank().over(W.partitionBy("item").orderBy(F.desc("score")))).filter(F.col("place") <= k).drop("place")
    named = written(kept, "ranked").join(index.filter("term is null").select("row", "id"), "row")
    ranked = best_of(named, "item", k, F.desc("score"), F.col("id").asc_nulls_last(), "row")
    of_items = small_side(asked_terms.select("item", F.col("id").alias("item_id")).distinct(), BROADCAST_ROWS)
    return ranked.join(of_items, "item").select("item_id", "rank", "id", "score")


#: DuckDB SQL of the op12 query.
SQL = r"""
with d as (select row_number() over () as row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
b as (select row_number() over () as item_no, item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
totals as (select count(*)::bigint as n_docs, sum(len(words))::bigint as n_words from d where len(words) > 0),
p as (select row_no, doc_id, n, term, count(*)::bigint as tf from (select row_no, doc_id, len(words)::bigint as n, unnest(words) as term from d) group by all),
q as (select item_no, item_id, term, count(*)::bigint as times from (select item_no, item_id, unnest(words) as term from b) group by all),
weights as (select term, floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from p, totals group by term),
scores as (select item_no, item_id, row_no, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_words))))::bigint as score
  from q join weights using (term) join p using (term), totals group by all)
select item_id, (row_number() over (partition by item_no order by score desc, doc_id, row_no))::integer as rank, doc_id, score from scores where score > 0 qualify rank <= 10
"""
