"""Slot identity by similarity: cosine, blocked and banded joins, threshold sweeps and merge audits."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions import constants as C
from recollect.functions import text as X
from recollect.operators.fold import Fact
from recollect.operators.vectors import BLOCK, Block, all_pairs, matched
from recollect.sources.scratch import small_side, written

NS = "namespace"
ALL, EXPECTED, TASK_ROWS, MOST_QUERIES = 2**63 - 1, 32, 1 << 14, 500_000


def dot(a: Column, b: Column) -> Column:
    """Scalar product in double precision, in the order of the elements."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if a vector is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def composed(strategy: str, key: Column, value: Column, subject: Column) -> Column:
    """The text that is embedded for a fact: bare, natural, subject, full_fact or subject_value."""
    natural = F.trim(F.translate(key, "._", "  "))
    return {
        "bare": key,
        "natural": natural,
        "subject": F.concat(X.subject_of(subject, key), F.lit(" "), natural),
        "full_fact": X.full_fact(key, value),
        "subject_value": F.concat(X.subject_of(subject, key), F.lit(": "), F.trim(F.coalesce(value, F.lit("")))),
    }[strategy]


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], column: str = "text") -> DataFrame:
    """(text, vector): each different text embedded once, in batches."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame({column: batch[column], "vector": [np.asarray(v, np.float32).tolist() for v in embed(batch[column].tolist())]})

    return texts.select(column).distinct().mapInPandas(run, f"{column} string, vector array<float>")


def fact_pairs(facts: DataFrame) -> DataFrame:
    """Pairs of a namespace's facts with values whose keys share a token: left and right columns, left.seq < right.seq."""
    own = facts.filter(~X.blank(F.col("slot_value")) & ~X.blank(F.col("slot_key"))).withColumn("fact", X.full_fact(F.col("slot_key"), F.col("slot_value"))).withColumn("subject", X.subject_of(F.col("subject"), F.col("slot_key"))).select(NS, "seq", "slot_key", "slot_value", "subject", "fact")
    tokens = own.select(NS, "seq", F.explode(X.key_tokens(F.col("slot_key"))).alias("token"))
    ids = tokens.select(NS, "token", F.col("seq").alias("l")).join(tokens.select(NS, "token", F.col("seq").alias("r")), [NS, "token"]).filter("l < r").select(NS, "l", "r").distinct()
    side = lambda p: own.select(NS, *[F.col(c).alias(f"{p}_{c}") for c in own.columns[1:]])
    left, right = side("left").withColumnRenamed("left_seq", "l"), side("right").withColumnRenamed("right_seq", "r")
    return ids.join(left, [NS, "l"]).join(right, [NS, "r"])


def value_gate(a: Column, b: Column) -> Column:
    """Whether two values may be versions of one: equal but for case and outer spaces, or both quantities."""
    return (X.normalised(a) == X.normalised(b)) | (X.quantity_like(a) & X.quantity_like(b))


def similarity_join(pairs: DataFrame, vectors: DataFrame, threshold: float = C.COSINE_SAME, value_aware: bool = False, subject_overlap: bool = False) -> DataFrame:
    """pairs with sim, at threshold or above; vectors is (text, vector) of their facts."""
    v = lambda p: vectors.select(F.col("text").alias(f"{p}_fact"), F.col("vector").alias(f"{p}_vector"))
    out = pairs.filter(X.subjects_overlap(F.col("left_subject"), F.col("right_subject"))) if subject_overlap else pairs
    out = out.join(v("left"), "left_fact").join(v("right"), "right_fact").withColumn("sim", dot(F.col("left_vector"), F.col("right_vector"))).filter(F.col("sim") >= threshold)
    return out.filter(value_gate(F.col("left_slot_value"), F.col("right_slot_value"))) if value_aware else out


def searched(queries: DataFrame, rows: DataFrame, threshold: float | None = None, block_rows: int = 2048) -> DataFrame:
    """(l, r, sim): each query (key, vector) with all rows (key, vector) of other keys whose cosine, to six places, is at
    the threshold or above; without one, with all rows. A zero vector's cosine is 0; null vectors take no part.

    Blocks of queries meet blocks of rows as matrices of bounded size, each pair of blocks in a task of its own."""
    alone = F.lit(0).alias("cell")
    return matched(queries.select(alone, "key", "vector"), rows.select(alone, "key", "vector"), threshold, None, block_rows)


def banded_join(pairs: DataFrame, vectors: DataFrame, judge: Callable[[str, str], bool], band: tuple[float, float] = C.BAND, value_aware: bool = False) -> DataFrame:
    """similarity_join from band[1] up, and between band[0] and band[1] where judge says same; only those rows reach the judge."""
    near = similarity_join(pairs, vectors, band[0], value_aware)
    sure, unsure = near.filter(F.col("sim") >= band[1]), near.filter(F.col("sim") < band[1])

    @F.pandas_udf("boolean")
    def asked(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([bool(judge(x, y)) for x, y in zip(a, b, strict=True)])

    return sure.withColumn("judged", F.lit(False)).unionByName(unsure.filter(asked("left_fact", "right_fact")).withColumn("judged", F.lit(True)))


def says_same(answer: str) -> bool:
    """A judge's word: SAME, and nothing of DIFFER."""
    return "SAME" in answer.upper() and "DIFFER" not in answer.upper()


def matcher(vectors: dict[str, np.ndarray], threshold: float = C.COSINE_SAME, judge: Callable[[str, str], bool] | None = None, band: tuple[float, float] = C.BAND, calls: list | None = None) -> Callable[[Fact, Fact], bool]:
    """A same-slot test for the fold, by full-fact vectors; with a judge, only pairs in the band are put to it."""

    def text(f: Fact) -> str:
        key, value = (f.slot_key or "").replace(".", " ").replace("_", " ").strip(), (f.slot_value or "").strip()
        return f"{key}: {value}" if key and value else key or value

    def same(a: Fact, b: Fact) -> bool:
        if not a.slot_value or not b.slot_value:
            return False
        sim = float(np.dot(vectors[text(a)], vectors[text(b)]))
        if judge is None:
            return sim >= threshold
        if band[0] <= sim < band[1]:
            if calls is not None:
                calls.append(sim)
            return judge(text(a), text(b))
        return sim >= band[1]

    return same


def threshold_sweep(pairs: DataFrame) -> DataFrame:
    """pairs (sim, same_slot) at each different similarity and at -1: true and false merges from there up, and recall."""
    per = pairs.groupBy(F.round("sim", 6).alias("threshold")).agg(F.sum(F.col("same_slot").cast("long")).alias("t"), F.sum((~F.col("same_slot")).cast("long")).alias("f"))
    total = pairs.agg(F.coalesce(F.sum(F.col("same_slot").cast("long")), F.lit(0)).alias("positives"), F.sum((~F.col("same_slot")).cast("long")).alias("negatives"))
    up = W.orderBy(F.col("threshold").desc()).rowsBetween(W.unboundedPreceding, 0)
    rows = per.select("threshold", F.sum("t").over(up).alias("true_merges"), F.sum("f").over(up).alias("false_merges"))
    all_rows = rows.unionByName(total.select(F.lit(-1.0).alias("threshold"), F.col("positives").alias("true_merges"), F.col("negatives").alias("false_merges")))
    return all_rows.crossJoin(F.broadcast(total.select("positives"))).select("threshold", "true_merges", "false_merges", F.when(F.col("positives") > 0, F.round(F.col("true_merges") / F.col("positives"), 4)).otherwise(0.0).alias("same_slot_recall"))


def best_safe_threshold(sweep: DataFrame) -> DataFrame:
    """The threshold without false merges that has the most true ones, the lowest of several; a null one that merges nothing if none is safe."""
    safe = sweep.filter("false_merges = 0")
    nothing = sweep.sparkSession.range(1).select(*[F.lit({"threshold": None, "same_slot_recall": 0.0}.get(c, 0)).cast(kind).alias(c) for c, kind in sweep.dtypes])
    return safe.unionByName(nothing).orderBy(F.col("true_merges").desc(), F.col("threshold").asc_nulls_last()).limit(1)


def _pair_labels(a: pa.StructArray, b: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Labels as numbers that are equal where these are; -1 for null."""
    codes = pa.concat_arrays([a.field("label"), b.field("label")]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    return codes[: len(a)], codes[len(a) :]


def _places(sims: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Where sims are at least or above; only rows that hold such are searched."""
    rows = np.flatnonzero(sims.max(axis=1) >= least)
    x, y = np.divmod(np.flatnonzero(sims[rows] >= least), sims.shape[1])
    return rows[x], y


def _greatest(i: int, a: pa.StructArray, j: int, b: pa.StructArray) -> tuple[int, int, float, float]:
    """The greatest cosine of two blocks' pairs, and of those with two labels."""
    (la, lb), left, most, other = _pair_labels(a, b), Block(a), -np.inf, -np.inf
    for at, sims in left.strips(left if i == j else Block(b), i == j):
        most = max(most, sims.max())
        x, y = _places(sims, other)
        differ = (la[at][x] != lb[y]) & (la[at][x] >= 0) & (lb[y] >= 0)
        other = max(other, sims[x[differ], y[differ]].max(initial=-np.inf))
    return i, j, float(np.round(most, 6) + 0.0), float(np.round(other, 6) + 0.0)


def _above(floor: float, i: int, a: pa.StructArray, j: int, b: pa.StructArray) -> tuple[int, float]:
    """How many pairs of one label have a cosine above floor, and the least cosine above it."""
    (la, lb), left, same, least = _pair_labels(a, b), Block(a), 0, np.inf
    for at, sims in left.strips(left if i == j else Block(b), i == j):
        x, y = _places(sims, floor - 1e-6)  # rounding moves a cosine by half of the sixth place at most
        sim = np.round(sims[x, y], 6) + 0.0
        good = sim > floor
        x, y = x[good], y[good]
        same += int(((la[at][x] == lb[y]) & (la[at][x] >= 0)).sum())
        least = min(least, sim[good].min(initial=np.inf))
    return same, float(least)


def _of_blocks(pairs: DataFrame, work: Callable[..., tuple], schema: str) -> DataFrame:
    """The row of work(i, a, j, b) for each two blocks."""
    names = [column.split()[0] for column in schema.split(", ")]

    def run(batches):
        for batch in batches:
            i, a, j, b = (batch.column(c) for c in ("i", "a", "j", "b"))
            for k in range(batch.num_rows):
                row = work(i[k].as_py(), a[k].values, j[k].as_py(), b[k].values)
                yield pa.RecordBatch.from_pydict({name: [v] for name, v in zip(names, row, strict=True)})

    return pairs.select("i", "a", "j", "b").mapInArrow(run, schema)


def _pairs_of_keys(rows: DataFrame, *by: str) -> int:
    """How many pairs of rows agree in by."""
    return rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.sum(F.expr("n * (n - 1) div 2"))).first()[0] or 0


def best_threshold_of_all(rows: DataFrame, block_rows: int = BLOCK) -> DataFrame:
    """best_safe_threshold(threshold_sweep()) of all pairs of rows (key, vector, label), each two of different keys once.

    A safe threshold lies above every cosine of two labels, so the pairs are gone through for the greatest of these, and those
    blocks that hold more than that once again, for what lies above it: a row for each two blocks, never one for each pair."""
    spark, rows = rows.sparkSession, rows.filter("key is not null").select(F.col("key").cast("long").alias("key"), "vector", "label")
    judged = rows.filter("label is not null")
    positives = _pairs_of_keys(judged, "label") - _pairs_of_keys(judged, "key", "label")
    negatives = _pairs_of_keys(judged) - _pairs_of_keys(judged, "key") - positives
    blocks = all_pairs(rows.filter("vector is not null"), block_rows)
    greatest = written(_of_blocks(blocks, _greatest, "i long, j long, most double, other double"), "greatest")
    floor = greatest.agg(F.max("other")).first()[0]
    found = [(-1.0, positives, negatives)] if positives else []
    higher = greatest.filter(F.col("most") > F.lit(floor)).select("i", "j")
    if higher.limit(1).count():
        again = blocks.join(small_side(higher, MOST_QUERIES), ["i", "j"], "left_semi")
        same, least = _of_blocks(again, partial(_above, floor), "same long, least double").agg(F.sum("same"), F.min("least")).first()
        found += [(float("nan") if least == np.inf else least, same, 0)] if same else []
    sweep = spark.createDataFrame(found, "threshold double, true_merges long, false_merges long")
    return best_safe_threshold(sweep.withColumn("same_slot_recall", F.round(F.col("true_merges") / positives, 4)))


def margin(pairs: DataFrame) -> DataFrame:
    """Least similarity of the same, greatest of the others, their distance, and recall above the greatest."""
    top = pairs.agg(F.min(F.when(F.col("same_slot"), F.col("sim"))).alias("min_same"), F.max(F.when(~F.col("same_slot"), F.col("sim"))).alias("max_neg"))
    found = pairs.filter("same_slot").crossJoin(F.broadcast(top)).agg(F.count("*").alias("n_same"), F.sum((F.col("sim") > F.col("max_neg")).cast("long")).alias("above"))
    return top.crossJoin(found).select(F.round("min_same", 4).alias("min_same"), F.round("max_neg", 4).alias("max_neg"), F.round(F.col("min_same") - F.col("max_neg"), 4).alias("margin"), F.round(F.try_divide("above", "n_same"), 4).alias("recall_above"), "n_same")


def merge_taxonomy(merges: DataFrame) -> DataFrame:
    """merges (kept_value, merged_value, ...) with class: safe_dedup, numeric_update or textual_distinct."""
    a, b = F.col("kept_value"), F.col("merged_value")
    return merges.withColumn("class", F.when(X.normalised(F.coalesce(a, F.lit(""))) == X.normalised(F.coalesce(b, F.lit(""))), "safe_dedup").when(X.quantity_like(a) & X.quantity_like(b), "numeric_update").otherwise("textual_distinct"))


def sampled(pool: DataFrame, by: str, per_key: int, seed: int) -> DataFrame:
    """per_key rows of each key, by a seeded hash."""
    order = F.xxhash64(F.lit(seed), *[F.col(c) for c in pool.columns])
    return pool.withColumn("rank", F.row_number().over(W.partitionBy(by).orderBy(order, *pool.columns))).filter(F.col("rank") <= per_key).drop("rank")


def bounded(queries: DataFrame, rows: DataFrame, expected: int) -> DataFrame:
    """queries (key, label) with bound, which of a query's negatives some expected ones have a hash up to; ALL where there are no more."""
    per = rows.filter("label is not null").groupBy("label").agg(F.count("*").alias("own"))
    total = per.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("total"))
    others = F.col("total") - F.coalesce("own", F.lit(0))
    bound = F.when(others <= expected, F.lit(ALL)).otherwise((F.lit(2.0**64) * expected / others - F.lit(2.0**63)).cast("long"))
    with_own = queries.filter("label is not null").join(per, "label", "left").crossJoin(F.broadcast(total)).select("key", "label", bound.alias("bound"))
    return with_own.withColumn("bound", F.min("bound").over(W.partitionBy("key")))  # a key that comes again has one bound


def negatives(bounds: DataFrame, rows: DataFrame, seed: int) -> DataFrame:
    """(l, r): bounded() queries with the rows (key, label) of other keys and labels whose hash is up to the bound."""
    own = small_side(bounds.select(F.col("key").alias("l"), F.col("label").alias("la"), "bound"), MOST_QUERIES)
    met = (F.col("la") != F.col("lb")) & (F.col("l") != F.col("r")) & (F.xxhash64(F.lit(seed), "l", "r") <= F.col("bound"))
    return rows.select(F.col("key").alias("r"), F.col("label").alias("lb")).join(own, met).select("l", "r")


def sampled_negatives(queries: DataFrame, rows: DataFrame, per_key: int = 2, seed: int = 0) -> DataFrame:
    """(l, r): for each query (key, label) the per_key rows (key, label) of other keys and labels that a seeded hash puts
    first of all; fewer if there are no more. Null keys and labels take no part.

    Every pair's hash is worked out where the rows lie, and only pairs up to a query's bound are shuffled and ordered. The
    bound loses none: queries that it leaves with fewer than per_key are looked up again without one."""
    queries, rows = (x.select(F.col("key").cast("long").alias("key"), "label") for x in (queries, rows))
    rows = rows.repartition(rows.count() // TASK_ROWS + 1, "key")
    bounds = written(bounded(queries, rows, EXPECTED * per_key), "bounds")
    found = written(sampled(negatives(bounds, rows, seed), "l", per_key, seed), "negatives")
    full = found.groupBy(F.col("l").alias("key")).agg(F.count("*").alias("n")).filter(F.col("n") >= per_key)
    short = written(bounds.filter(F.col("bound") < ALL).join(full, "key", "left_anti").withColumn("bound", F.lit(ALL)), "short")
    if not short.limit(1).count():
        return found
    rest = found.join(short.select(F.col("key").alias("l")).distinct(), "l", "left_anti")
    return rest.unionByName(sampled(negatives(short, rows, seed), "l", per_key, seed))
