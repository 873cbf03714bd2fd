"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank with the original vectors.

*Codes.* A sample of the vectors (bounded, thinned of near copies, so that no hot group moves the thresholds) gives principal
directions. Iterative quantisation turns them so that signs lose least; each bit is cut at the sample's median, so
codes are balanced. Rotations from different seeded starts give further bits. Every vector is coded and indexed.

*Tables.* The bits are cut into tables of some log2(n) bits, so that a bucket holds a few unlike vectors whatever n is.
How many tables are needed is measured on pairs made at exactly the threshold, the hardest ones: until ``recall`` of them
share a bucket and pass the filter on the first 64 bits.

*Groups.* Equal vectors are one class. In a bucket of ``CROWD`` classes or more, those within half the threshold's angle of
its first one form a ball: all its members are linked to each other for certain. Only balls (mostly of one class) meet in
buckets. Two balls whose centres' angle and radii lie below the threshold's angle are linked as wholes, by one row; above,
not at all; only in between are members compared, in blocks, and each member gets a number. So near copies never become
pairs of rows, and a link needs no row of its own.

Pairs are linked if their cosine in double precision is at least the threshold, and only then; links are lost only where
no table brings two balls together. Joins that a hot key reaches stand on written tables, which adaptive execution splits.

Defined results: a vector that is null or empty, zero, or holds null or non-finite components has no links and is its own
component; vectors of different lengths have no links; repeated rows link with each other; a null id never gives a
component its name (a component of null ids has a null one, and keeps none of them); rows with equal ids are vectors of
their own; an empty table gives no rows; labels and other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import handing_back, small_side, written
from recollect.llm.simhash import components

SAMPLE, ROUNDS, CROWD, CHUNK = 8192, 3, 32, 2000
BROADCAST_ROWS, EDGE = 200_000, 1e-7


def vectors_of(column: pa.Array, kind: str) -> list[bytes | None]:
    """Each vector's bytes, None for one that links with nothing."""
    out = []
    for v in column:
        x = None if not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(kind)
        # Sums in double precision can overflow for huge components of doubles, so the scale is taken out first.
        out.append(x.tobytes() if x is not None and len(x) and np.isfinite(x).all() and np.abs(x).max() > 0 else None)
    return out


def unit(vectors: list[bytes], kind: str, width: int | None = None) -> np.ndarray:
    """Rows of length 1 in double precision; shorter ones are filled with zeros up to width."""
    rows = [np.frombuffer(v, kind).astype(np.float64) for v in vectors]
    out = np.zeros((len(rows), width or max(map(len, rows), default=1)))
    for i, x in enumerate(rows):
        x = x / np.abs(x).max()
        out[i, : len(x)] = x / np.linalg.norm(x)
    return out


class Codes:
    """Rotations learned from a sample, and the tables that are cut from their bits."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float, recall: float, seed: int = 11):
        rnd = np.random.default_rng(seed)
        near = np.zeros(len(sample), bool)
        for i in range(0, len(sample), 1024):
            block = sample[i : i + 1024] @ sample[: i + 1024].T
            near[i : i + 1024] = (np.tril(block, i - 1) >= threshold).any(axis=1)
        thin = sample[~near]
        self.mean = thin.mean(axis=0)
        values, directions = np.linalg.eigh(np.cov((thin - self.mean).T).reshape(sample.shape[1], -1))
        self.directions = directions[:, ::-1][:, : min(64, sample.shape[1])]
        self.turns: list[np.ndarray] = []
        self.cuts: list[np.ndarray] = []
        self.width = int(np.clip(np.ceil(np.log2(max(n, 2))) - 2, 6, 62))
        base = thin[rnd.permutation(len(thin))[:2000]]
        aside = rnd.standard_normal(base.shape)
        aside -= (aside * base).sum(axis=1, keepdims=True) * base
        aside /= np.maximum(np.linalg.norm(aside, axis=1, keepdims=True), 1e-300)
        other = threshold * base + np.sqrt(max(0.0, 1 - threshold**2)) * aside
        flat, stale = (thin - self.mean) @ self.directions, 0
        found = np.zeros(len(base), bool)
        self.most, self.tables = 64, 0
        while True:
            self._turn(flat, rnd)
            a, b = self.bits(base), self.bits(other)
            if len(self.turns) * self.directions.shape[1] < 64:
                continue
            apart = (a[:, :64] != b[:, :64]).sum(axis=1)
            self.most = int(np.quantile(apart, 0.999))
            passing = apart <= self.most
            before = found.mean()
            for k in range(self.tables, a.shape[1] // self.width):
                found |= (a[:, k * self.width : (k + 1) * self.width] == b[:, k * self.width : (k + 1) * self.width]).all(axis=1)
                self.tables = k + 1
                if found[passing].mean() >= recall:
                    return
            stale = 0 if found.mean() > before else stale + 1
            if stale > 8 and self.width == 1:
                return
            if stale > 8:  # few dimensions: further rotations say nothing new, shorter keys do
                self.width, self.tables, stale = self.width // 2, 0, 0

    def _turn(self, flat: np.ndarray, rnd: np.random.Generator) -> None:
        turn = np.linalg.qr(rnd.standard_normal((flat.shape[1], flat.shape[1])))[0]
        for _ in range(20):
            left, _, right = np.linalg.svd(np.sign(flat @ turn).T @ flat)
            turn = right.T @ left.T
        self.turns.append(turn)
        self.cuts.append(np.median(flat @ turn, axis=0))

    def bits(self, x: np.ndarray) -> np.ndarray:
        flat = (x - self.mean) @ self.directions
        return np.concatenate([flat @ t > c for t, c in zip(self.turns, self.cuts, strict=True)], axis=1)

    def keys(self, bits: np.ndarray) -> np.ndarray:
        """One 64-bit key for each row and table."""
        power = np.int64(1) << np.arange(self.width, dtype=np.int64)
        return bits[:, : self.tables * self.width].reshape(len(bits), self.tables, self.width) @ power

    @staticmethod
    def first(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits[:, :64], axis=1).view("<i8").ravel()


def classes_of(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, str]:
    """(row, id, node, vec): node stands for a vector's bytes and is null where it links with nothing; the bytes' type."""
    kind = "<f4" if "float" in dict(rows.dtypes)[vector_col] else "<f8"

    def run(batches):
        for batch in batches:
            vecs = vectors_of(batch.column(2), kind)
            nodes = [None if v is None else hashlib.md5(v).digest() for v in vecs]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(vecs, pa.binary())], ["row", "id", "node", "vec"])

    source = rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if kind == "<f4" else "array<double>").alias("v"))
    return written(source.mapInArrow(handing_back(run), "row long, id long, node binary, vec binary"), "vectors"), kind


def balls_of(coded: DataFrame, kind: str, threshold: float) -> DataFrame:
    """coded with ball, the node of the ball's centre, and angle to it, both null outside balls."""
    half = np.arccos(threshold) / 2 - EDGE
    state = coded.withColumn("ball", F.lit(None).cast("binary")).withColumn("angle", F.lit(None).cast("double"))
    names = state.columns

    def near(batches):
        for batch in batches:
            head = [i for i, h in enumerate(batch.column("head_vec").to_pylist()) if h is not None]
            ball, angle = batch.column("ball").to_pylist(), batch.column("angle").to_pylist()
            if head:
                own, other = batch.column("vec").take(head).to_pylist(), batch.column("head_vec").take(head).to_pylist()
                far = np.arccos(np.clip((unit(own, kind) * unit(other, kind)).sum(axis=1), -1, 1))
                for i, x, name, same in zip(head, far.tolist(), batch.column("head").take(head).to_pylist(), [a == b for a, b in zip(own, other, strict=True)], strict=True):
                    if same or x <= half:
                        ball[i], angle[i] = name, 0.0 if same else x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-2]), pa.array(ball, pa.binary()), pa.array(angle, pa.float64())], names)

    for table in range(ROUNDS):
        key = F.try_element_at("keys", F.lit(table + 1))
        crowds = state.filter("ball is null").groupBy(F.col("size").alias("of"), key.alias("key")).agg(F.count("*").alias("n"), F.min(F.struct("node", "vec")).alias("h")).filter(F.col("n") >= CROWD)
        crowds = written(crowds.select("of", "key", F.col("h.node").alias("head"), F.col("h.vec").alias("head_vec")), "crowds")
        if not crowds.limit(1).count():
            break
        met = state.join(small_side(crowds, BROADCAST_ROWS // 10), F.col("ball").isNull() & (F.col("size") == F.col("of")) & (key == F.col("key")), "left")
        schema = ", ".join(f"{c} {t}" for c, t in state.dtypes)
        state = written(met.select(*names, "head", "head_vec").mapInArrow(handing_back(near), schema), "balls")
    return state


def links(rows: DataFrame, threshold: float = 0.9, recall: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """(id, n_links, component): the vectors linked with each, and the smallest id that links reach from it."""
    marked, kind = classes_of(rows, id_col, vector_col)
    classes = written(marked.filter("node is not null").groupBy("node").agg(F.first("vec").alias("vec"), F.count("*").alias("copies"), F.min("id").alias("least")), "classes")
    n, widest = classes.agg(F.count("*"), F.max(F.octet_length("vec"))).first()
    alone = marked.filter("node is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    if not n:
        return alone
    share = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) < F.lit(int(min(1.0, sample / n) * (1 << 30)))
    seen = [r.vec for r in classes.filter(share).select("vec").limit(2 * sample).collect()] or [classes.first().vec]
    dims = widest // np.dtype(kind).itemsize
    codes = Codes(unit(seen, kind, dims), n, threshold, recall)
    item = np.dtype(kind).itemsize

    def code(batches):
        for batch in batches:
            vecs = batch.column("vec").to_pylist()
            bits = codes.bits(unit(vecs, kind, dims))
            keys = codes.keys(bits)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * codes.tables, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(v) // item for v in vecs], pa.int32()), lists, pa.array(Codes.first(bits))], ["node", "vec", "copies", "least", "size", "keys", "code"])

    coded = written(classes.select("node", "vec", "copies", "least").mapInArrow(handing_back(code), "node binary, vec binary, copies long, least long, size int, keys array<long>, code long"), "codes")
    state = balls_of(coded, kind, threshold).withColumn("own", F.coalesce("ball", "node"))
    balls = state.groupBy("own").agg(F.max(F.when(F.col("node") == F.col("own"), F.col("vec"))).alias("vec"), F.coalesce(F.max("angle"), F.lit(0.0)).alias("radius"), F.sum("copies").alias("weight"), F.count("*").alias("members"), F.min("least").alias("least"))
    balls = written(balls, "centres")

    # Balls meet in buckets. A ball of several classes stands once in a bucket, and its code says nothing of all of them.
    singles = state.filter("ball is null").select("size", "own", "code", F.posexplode("keys").alias("table", "key"))
    crowds = state.filter("ball is not null").select("size", "own", F.posexplode("keys").alias("table", "key")).distinct().withColumn("code", F.lit(None).cast("long"))
    filed = written(singles.unionByName(crowds), "filed")
    a, b = (filed.select("size", "table", "key", F.col("own").alias(x), F.col("code").alias(f"code_{x}")) for x in "ab")
    alike = F.coalesce(F.bit_count(F.col("code_a").bitwiseXOR(F.col("code_b"))) <= codes.most, F.lit(True))
    met = written(a.join(b, ["size", "table", "key"]).filter((F.col("a") < F.col("b")) & alike).select("a", "b").distinct(), "met")

    def judge(batches):
        for batch in batches:
            cosine = (unit(batch.column("vec_a").to_pylist(), kind) * unit(batch.column("vec_b").to_pylist(), kind)).sum(axis=1) if batch.num_rows else np.zeros(0)
            reach = batch.column("reach").to_numpy()
            angle, most = np.arccos(np.clip(cosine, -1, 1)), np.arccos(threshold)
            sure = np.where(reach == 0, cosine >= threshold, angle + reach <= most - EDGE)
            open_ = (reach > 0) & ~sure & (angle - reach <= most + EDGE)
            kept = np.flatnonzero(sure | open_)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(kept) for c in ("a", "b", "weight_a", "weight_b", "members_a", "members_b")), pa.array(sure[kept])], ["a", "b", "weight_a", "weight_b", "members_a", "members_b", "sure"])

    ball = lambda x: balls.select(F.col("own").alias(x), F.col("vec").alias(f"vec_{x}"), F.col("radius").alias(f"radius_{x}"), F.col("weight").alias(f"weight_{x}"), F.col("members").alias(f"members_{x}"))
    both = met.join(ball("a"), "a").join(ball("b"), "b").withColumn("reach", F.col("radius_a") + F.col("radius_b")).drop("radius_a", "radius_b")
    judged = written(both.mapInArrow(handing_back(judge), "a binary, b binary, weight_a long, weight_b long, members_a long, members_b long, sure boolean"), "judged")
    sure, unsure = judged.filter("sure"), judged.filter("not sure")
    whole = sure.select(F.col("a").alias("own"), F.col("weight_b").alias("w")).unionByName(sure.select(F.col("b").alias("own"), F.col("weight_a").alias("w"))).groupBy("own").agg(F.sum("w").alias("others"))

    singly = member_links(unsure, state, kind, threshold)
    edges = sure.select("a", "b").unionByName(singly.select("a", "b").distinct())
    roots = components(edges)
    named = written(balls.join(roots.withColumnRenamed("node", "of"), F.col("own") == F.col("of"), "left").select("own", "weight", "least", F.coalesce("root", "own").alias("root")), "named")
    heads = written(named.groupBy("root").agg(F.min("least").alias("component")), "heads")
    of_balls = named.join(heads, "root").join(whole.withColumnRenamed("own", "of"), F.col("own") == F.col("of"), "left").select("own", "component", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("by_ball"))
    more = singly.groupBy("node").agg(F.sum("w").alias("more")).withColumnRenamed("node", "of")
    of_nodes = state.select("node", "own").join(written(of_balls, "by-ball"), "own").join(more, F.col("node") == F.col("of"), "left")
    of_nodes = written(of_nodes.select("node", "component", (F.col("by_ball") + F.coalesce("more", F.lit(0))).alias("n_links")), "by-node")
    linked = marked.filter("node is not null").select("id", "node").join(of_nodes, "node").select("id", "n_links", "component")
    return linked.unionByName(alone)


def member_links(unsure: DataFrame, state: DataFrame, kind: str, threshold: float) -> DataFrame:
    """(a, b, node, w): for pairs of balls (a, b, members_a, members_b) that are neither linked as wholes nor apart, the
    vectors of the other ball that a member is linked with. Members meet in blocks of some CHUNK of either ball."""
    parts = lambda n: F.ceil(n / CHUNK).cast("int")
    members = state.select(F.col("own").alias("of"), "node", "vec", "copies")

    def side(x: str, y: str) -> DataFrame:
        met = unsure.join(members, F.col(x) == F.col("of"))
        own = F.pmod(F.xxhash64("node"), parts(F.col(f"members_{x}"))).cast("int")
        other = F.explode(F.sequence(F.lit(0), parts(F.col(f"members_{y}")) - 1))
        return met.select("a", "b", own.alias(f"part_{x}"), other.alias(f"part_{y}"), F.lit(x == "a").alias("left"), "node", "vec", "copies")

    def compare(rows: pa.Table) -> pa.Table:
        left = rows.column("left").to_numpy(zero_copy_only=False)
        one, two = np.flatnonzero(left), np.flatnonzero(~left)
        w = np.zeros(len(left), np.int64)
        if len(one) and len(two):
            vec, copies = rows.column("vec"), rows.column("copies").to_numpy()
            linked = unit(vec.take(one).to_pylist(), kind) @ unit(vec.take(two).to_pylist(), kind).T >= threshold
            w[one], w[two] = linked @ copies[two], copies[one] @ linked
        kept = np.flatnonzero(w)
        return pa.table({"a": rows.column("a").take(kept), "b": rows.column("b").take(kept), "node": rows.column("node").take(kept), "w": w[kept]})

    met = side("a", "b").unionByName(side("b", "a")).groupBy("a", "b", "part_a", "part_b").applyInArrow(compare, "a binary, b binary, node binary, w long")
    return written(met, "singly")


#: DuckDB SQL of the op13 query: every pair, and components by the smallest id reached.
SQL = r"""
with recursive v as (select row_number() over () as k, vec_id, embedding::double[] as x from embeddings),
u as (select k, vec_id, x, len(x) as n from v where x is not null and len(x) > 0 and len(list_filter(x, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(x, lambda c: c <> 0)) > 0),
linked as (select a.k as a, b.k as b from u a join u b on a.k <> b.k and a.n = b.n where list_cosine_similarity(a.x, b.x) >= 0.9),
reach(k, other) as (select k, k from u union select r.k, l.b from reach r join linked l on l.a = r.other),
named as (select r.k, min(v.vec_id) as component_id from reach r join v on v.k = r.other group by r.k)
select v.vec_id, coalesce((select count(*) from linked l where l.a = v.k), 0)::bigint as n_links, case when u.k is null then v.vec_id else component_id end as component_id,
  coalesce(v.vec_id = case when u.k is null then v.vec_id else component_id end, false) as kept
from v left join u on u.k = v.k left join named n on n.k = v.k
"""
