"""Vectors: exact matching block by block, an index of cells for approximate search, and entity resolution on top of it.

All searches come down to ``matched``: two sides that share a cell are cut into blocks of bounded size, each block of the
one side meets each block of the other as a product of two matrices in its own task, and only pairs that count leave it.
An exhaustive search has one cell; ``near`` and ``nearest`` have the cells of an index. The driver sees a bounded
sample and the cells' centres, never the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.sources.scratch import small_side, written

CHUNK, SAMPLE, PER_CELL, MOST_CELLS, STRIP = 2000, 20_000, 1000, 4096, 128
BLOCK, MOST_PARTS = 8192, 48
PAIRS = "l long, r long, sim double"


def unit(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows scaled to length 1 in double precision; a zero vector stays zero. All vectors have one length."""
    one = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    if len(one.value_lengths().unique()) > 1:
        raise ValueError("vectors of different lengths")
    m = one.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(one), -1)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def matched(left: DataFrame, right: DataFrame, threshold: float | None = None, best: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(l, r, sim): keys of left and right (cell, key, vector) that differ and share a cell, with their cosine to six places:
    those at the threshold or above, all without one; with best, each left key's best ones, equal ones by key.

    Null vectors take no part; a zero vector's cosine is 0. A cell of any size is dealt out in blocks of some chunk rows."""
    left, right = (x.filter("vector is not null").select("cell", F.col("key").cast("long").alias("key"), F.col("vector").cast("array<double>").alias("vector")) for x in (left, right))
    parts = lambda rows, name: rows.groupBy(F.col("cell").alias("of")).agg(F.ceil(F.count("*") / chunk).cast("int").alias(name))
    counts = small_side(written(parts(left, "n_left").join(parts(right, "n_right"), "of"), "cells"), MOST_CELLS * 16)

    def side(rows: DataFrame, own: str, other: str, name: str, met: str, is_left: bool) -> DataFrame:
        placed = rows.join(counts, F.col("cell") == F.col("of"))
        return placed.select("cell", F.pmod(F.xxhash64("key"), F.col(own)).cast("int").alias(name), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(met), F.lit(is_left).alias("is_left"), "key", "vector")

    def compare(rows: pa.Table) -> pa.Table:
        is_left = rows.column("is_left").to_numpy(zero_copy_only=False)
        a, b = np.flatnonzero(is_left), np.flatnonzero(~is_left)
        keys = rows.column("key").to_numpy()
        if not len(a) or not len(b):
            return pa.table({"l": pa.array([], pa.int64()), "r": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        vectors = rows.column("vector")
        u, v, found = unit(vectors.take(a)), unit(vectors.take(b)), []
        for at in range(0, len(a), STRIP):  # so that only what leaves the block is as large as the block
            own = keys[a[at : at + STRIP]]
            sims = u[at : at + STRIP] @ v.T
            if threshold is None:
                x, y = np.nonzero(own[:, None] != keys[b])
            else:  # rounding moves a cosine by half of the sixth place at most, so only these need it
                x, y = np.nonzero(sims >= threshold - 1e-6)
            sim = np.round(sims[x, y], 6) + 0.0
            if threshold is not None:
                good = (sim >= threshold) & (own[x] != keys[b][y])
                x, y, sim = x[good], y[good], sim[good]
            if best is not None and len(x):
                order = np.lexsort((keys[b][y], -sim, x))
                x, y, sim = x[order], y[order], sim[order]
                first = np.concatenate(([True], x[1:] != x[:-1]))
                place = np.arange(len(x)) - np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))
                x, y, sim = x[place < best], y[place < best], sim[place < best]
            found.append(pa.table({"l": own[x], "r": keys[b][y], "sim": sim}))
        return pa.concat_tables(found)

    rows = side(left, "n_left", "n_right", "part", "other", True).unionByName(side(right, "n_right", "n_left", "other", "part", False))
    found = rows.groupBy("cell", "part", "other").applyInArrow(compare, PAIRS)
    return best_of(found, best) if best is not None else found


def all_pairs(rows: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """(i, a, j, b): every two blocks of rows (key, vector, ...) once, a block with itself too; a and b are arrays of rows. A
    key's rows are in one block. Blocks meet where they are read, so disk holds the rows, not their pairs."""
    n = rows.count() // block_rows + 1
    whole = rows.groupBy(F.pmod(F.xxhash64("key"), F.lit(n)).cast("int").alias("block")).agg(F.collect_list(F.struct(*rows.columns)).alias("items"))
    dealt = written(whole, "blocks").repartitionByRange(min(n, MOST_PARTS), "block")
    left, right = dealt.select(F.col("block").alias("i"), F.col("items").alias("a")), dealt.select(F.col("block").alias("j"), F.col("items").alias("b"))
    return left.hint("shuffle_replicate_nl").join(right, F.col("i") <= F.col("j"))


class Block:
    """Vectors of a block, scaled to length 1 in double precision, with their keys."""

    def __init__(self, items: pa.StructArray):
        vectors, self.keys = items.field("vector"), items.field("key").to_numpy(zero_copy_only=False)
        values = vectors.flatten()
        if len(vectors.value_lengths().unique()) > 1:
            raise ValueError("vectors of different lengths")
        m = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
        with np.errstate(invalid="ignore", over="ignore"):
            norm = np.sqrt((m * m).sum(axis=1))
        self.zero, self.unknown = norm == 0, values.is_null().to_numpy(zero_copy_only=False).reshape(m.shape).any(axis=1)
        self.endless = ~np.isfinite(norm)
        plain = ~(self.zero | self.endless)[:, None]
        self.unit = np.divide(m, norm[:, None], out=np.zeros_like(m), where=plain)
        self.odd = bool(self.endless.any())

    def strips(self, other: Block, same_block: bool) -> Iterator[tuple[slice, np.ndarray]]:
        """Cosines of some of these vectors at a time with all of the other block's; in a block with itself, only of pairs whose left
        key is the smaller one, others being -inf. As in SQL a zero vector's is 0, else one with a null component has none
        (-inf), and one with NaN or infinite components has NaN, above all numbers (inf)."""
        for start in range(0, len(self.keys), STRIP):
            at = slice(start, start + STRIP)
            sims = self.unit[at] @ other.unit.T
            if self.odd or other.odd:
                either = lambda name: getattr(self, name)[at, None] | getattr(other, name)  # noqa: B023, E731
                sims = np.where(either("zero"), 0.0, np.where(either("unknown"), -np.inf, np.where(either("endless"), np.inf, sims)))
            if same_block:
                sims[self.keys[at, None] >= other.keys] = -np.inf
            yield at, sims


def best_of(pairs: DataFrame, k: int) -> DataFrame:
    """The k best pairs of each left key, with equal cosines by key; each task limits its own rows before the shuffle."""
    place = F.row_number().over(W.partitionBy("l").orderBy(F.desc("sim"), "r"))
    return pairs.withColumn("place", place).filter(F.col("place") <= k).drop("place")


class Cells:
    """Centres of cells, and how many of them a query has to see."""

    def __init__(self, centres: np.ndarray, probes: int):
        self.centres, self.probes = centres, probes

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        sims = x @ self.centres.T
        return np.argpartition(-sims, n - 1, axis=1)[:, :n] if n < sims.shape[1] else np.broadcast_to(np.arange(sims.shape[1]), sims.shape)


def fitted(rows: DataFrame, threshold: float = 0.8, recall: float = 0.97, per_cell: int = PER_CELL, sample: int = SAMPLE, seed: int = 5) -> Cells:
    """Cells of rows (key, vector), of some per_cell vectors each: spherical k-means on a sample of bounded size, chosen by a
    hash of the key. Queries see so many cells that of pairs made at exactly the threshold the share recall is found."""
    own = rows.filter("vector is not null")
    n = own.count()
    share = int(min(1.0, sample / max(n, 1)) * (1 << 30))
    some = own.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < share).select(F.col("vector").cast("array<double>").alias("vector")).limit(2 * sample).toArrow().column(0)
    cells = max(1, min(MOST_CELLS, n // per_cell, len(some)))
    if cells == 1:
        return Cells(np.zeros((1, 1)), 1)
    rnd, x = np.random.default_rng(seed), unit(some)
    centres = x[rnd.choice(len(x), cells, replace=False)]
    for _ in range(10):
        at = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-300), centres)
    base = x[rnd.permutation(len(x))[:2000]]
    aside = rnd.standard_normal(base.shape)
    aside -= (aside * base).sum(axis=1, keepdims=True) * base
    other = threshold * base + np.sqrt(1 - threshold**2) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    sims = base @ centres.T
    place = (sims > np.take_along_axis(sims, (other @ centres.T).argmax(axis=1)[:, None], axis=1)).sum(axis=1)
    return Cells(centres, int(min(cells, np.quantile(place, recall) + 1)))


def filed(rows: DataFrame, cells: Cells, probes: int = 1) -> DataFrame:
    """rows (key, vector) as (cell, key, vector), once for each of the nearest cells."""
    own = rows.filter("vector is not null").select(F.col("key").cast("long").alias("key"), F.col("vector").cast("array<double>").alias("vector"))
    if len(cells.centres) == 1:
        return own.select(F.lit(0).alias("cell"), "key", "vector")
    shared = rows.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        for batch in batches:
            at = shared.value.nearest(unit(batch.column("vector")), probes) if batch.num_rows else np.zeros((0, probes), np.int64)
            again = pa.array(np.repeat(np.arange(batch.num_rows), at.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(at.ravel().astype(np.int32)), batch.column("key").take(again), batch.column("vector").take(again)], ["cell", "key", "vector"])

    return own.mapInArrow(run, "cell int, key long, vector array<double>")


def near(queries: DataFrame, rows: DataFrame, threshold: float, best: int | None = None, cells: Cells | None = None, chunk: int = CHUNK) -> DataFrame:
    """(l, r, sim) of queries and rows (key, vector) at the threshold or above, found by way of an index of rows. Up to
    2 * PER_CELL rows there is one cell and nothing is missed."""
    cells = cells or fitted(rows, threshold)
    return matched(written(filed(queries, cells, cells.probes), "asked"), written(filed(rows, cells), "index"), threshold, best, chunk)


def nearest(queries: DataFrame, rows: DataFrame, k: int, cells: Cells | None = None, chunk: int = CHUNK) -> DataFrame:
    """(l, r, sim): each query's k best rows, as far as the cells that a cosine of 0.8 needs hold them."""
    cells = cells or fitted(rows)
    return matched(written(filed(queries, cells, cells.probes), "asked"), written(filed(rows, cells), "index"), None, k, chunk)


def resolved(mentions: DataFrame, nodes: DataFrame, threshold: float = 0.82, cells: Cells | None = None) -> DataFrame:
    """(key, node, sim, is_new): the node that each mention (key, vector) names, as if mentions came one by one in the order
    of their keys: a node whose vector is at the threshold or above, the nearest, the smallest on a tie; else an earlier
    mention that made a node, by the same rule, where node is that mention's key; else the mention makes a node of its own.

    Which mentions make nodes is settled in rounds: the first undecided one among its undecided neighbours makes one, those
    near a made node don't. Every round is a written table of the links still open; a mention without a vector makes a node."""
    cells = cells or fitted(nodes.unionByName(mentions), threshold)
    known = near(mentions, nodes.withColumn("key", -F.col("key") - 1), threshold, 1, cells)  # below zero, so that no key is its own mention's
    known = written(known.select(F.col("l").alias("key"), (-F.col("r") - 1).alias("node"), "sim"), "known")
    rest = mentions.join(known.select("key"), "key", "left_anti")
    both = near(rest, rest, threshold, None, cells).select(F.greatest("l", "r").alias("l"), F.least("l", "r").alias("r"), "sim")
    links = written(both.distinct(), "links")  # l came later
    open_, others = links, None
    while open_.limit(1).count():
        # An open mention with no earlier open neighbour makes a node; open neighbours of makers do not.
        ends = open_.select(F.col("l").alias("key")).unionByName(open_.select(F.col("r").alias("key"))).distinct()
        first = written(ends.join(open_.select(F.col("l").alias("key")).distinct(), "key", "left_anti"), "makers")
        taken = written(open_.join(first.withColumnRenamed("key", "r"), "r", "left_semi").select(F.col("l").alias("key")).distinct(), "taken")
        gone = first.unionByName(taken)
        left = open_.join(gone.withColumnRenamed("key", "l"), "l", "left_anti").join(gone.withColumnRenamed("key", "r"), "r", "left_anti")
        # A mention that this leaves without a link has neighbours that made no nodes, so it makes one.
        others = taken if others is None else others.unionByName(taken)
        open_ = written(left, "links")
    if others is None:
        aliases = links.select(F.col("l").alias("key"), F.col("r").alias("node"), "sim")
    else:
        made = links.join(others.withColumnRenamed("key", "r"), "r", "left_anti").join(others.withColumnRenamed("key", "l"), "l", "left_semi")
        aliases = best_of(made, 1).select(F.col("l").alias("key"), F.col("r").alias("node"), "sim")
    named = mentions.select("key").join(known.unionByName(aliases), "key", "left")
    return named.select("key", F.coalesce("node", "key").alias("node"), F.coalesce("sim", F.lit(1.0)).alias("sim"), F.col("node").isNull().alias("is_new"))


def blended(a: Column, b: Column, share: Column) -> Column:
    """a with a share of b."""
    return F.zip_with(a, b, lambda x, y: x.cast("double") + share * y.cast("double"))
