"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, exact Hamming check, components.

A fingerprint is cut into four 16-bit blocks. Two fingerprints that differ in at most two bits agree in
at least two blocks, so each is filed under its six pairs of blocks (32 bits each) and only fingerprints
that share a file are compared (``links``; a larger radius is refused). A file with more than ``bucket`` different fingerprints is not compared
pair by pair: each member announces itself and its one-bit neighbours inside the file's free bits, and two
members differ in at most two bits exactly if they share an announcement, of which no more than 33 members
can share one. No link is lost and none is quadratic in a group.

``similar`` finds texts whose 5-word shingles have a Jaccard similarity of 0.8 or more, which reach farther than any
exact pigeonhole search of 64 bits. Its fingerprints have 512 bits; pairs at that similarity differ in some 15 % of them.
The bits are dealt to blocks so many, and of such a width, that such a pair shares one with a probability of 0.9 and
unlike texts seldom do, whatever their number (``blocks_for``); pairs that share a block are verified by their Hamming
distance.

Defined results: a null text counts as empty; a text without words has fingerprint 0 and is linked like any
other; equal rows have equal fingerprints; rows with a null id keep their fingerprint and get the smallest
other id of their component, or null; an empty table gives no rows; only id and text columns are read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import dropped, handing_back, written
from recollect.llm.decontaminate import words_of
from recollect.llm.substrings import rolling

BLOCKS, BITS, RADIUS = 4, 16, 2
WIDE, SLACK, FULL = 512, 1.08, 64


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - shingle] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp long): one row per row of docs."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = np.array([fingerprint(x.as_py(), shingle, seed) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(handing_back(run), "id long, fp long")


def masks() -> list[int]:
    """For each pair of blocks, the bits it covers, as signed longs."""
    block = (1 << BITS) - 1
    return [int(np.uint64((block << (BITS * a)) | (block << (BITS * b))).astype(np.int64)) for a, b in combinations(range(BLOCKS), 2)]


def links(nodes: DataFrame, radius: int = RADIUS, bucket: int = 64) -> DataFrame:
    """(a, b): links between different fingerprints of nodes (fp, distinct) at no more than radius (up to 2) bits.
    Inside an oversized file the links are a spanning set: chains through shared neighbours, same components."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"four blocks find pairs at up to {RADIUS} bits, not {radius}")
    fp = F.col("fp")
    filed = nodes.select("fp", F.posexplode(F.array(*[fp.bitwiseAND(F.lit(m)) for m in masks()])).alias("file", "key"))
    # A table, as adaptive execution splits a large file's rows only where no aggregate stands before the join.
    sizes = written(filed.groupBy("file", "key").agg(F.count("*").alias("n")).filter("n > 1"), "files")
    shared = filed.join(sizes, ["file", "key"])
    small = shared.filter(F.col("n") <= bucket)
    left, right = small.select("file", "key", F.col("fp").alias("a")), small.select("file", "key", F.col("fp").alias("b"))
    pairs = left.join(right, ["file", "key"]).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).select("a", "b")
    own = [F.lit(0).cast("long"), *(F.lit(int(np.uint64(1 << i).astype(np.int64))) for i in range(64))]
    free = F.filter(F.array(*own), lambda bit: bit.bitwiseAND(F.element_at(F.array(*[F.lit(m) for m in masks()]), F.col("file") + 1)) == 0)
    said = shared.filter(F.col("n") > bucket).select("file", "fp", F.explode(free).alias("bit")).select("file", "fp", fp.bitwiseXOR(F.col("bit")).alias("said"))
    stars = said.groupBy("file", "said").agg(F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
    if radius < 2:
        met = stars.select(F.explode("all").alias("a"), F.col("all")).select("a", F.explode("all").alias("b"))
        chained = met.filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    else:
        chained = stars.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a < b")
    return pairs.unionByName(chained).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of edges (a, b) with the smallest node of its component.

    First each node goes to its smallest neighbour, and edges join what their ends went to, so many edges between
    near copies become few. Then alternating large and small stars; each round is a written table. A node with many
    neighbours gets its minimum by a partial aggregate, written as a table, so that adaptive execution can split the join
    in which its edges meet that minimum; it splits none that an aggregate stands before."""
    ordered = lambda a, b: [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]
    given = written(edges.select(*ordered("a", "b")).filter("u <> v").distinct(), "edges")
    nearest = written(given.unionByName(given.select(F.col("v").alias("u"), F.col("u").alias("v"))).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "nearest")
    moved = given.join(nearest.withColumnRenamed("m", "a"), "u").join(nearest.select(F.col("u").alias("v"), F.col("m").alias("b")), "v")
    now = written(moved.select(*ordered("a", "b")).unionByName(nearest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        after = written(small, "edges")
        for read in (now, least, large, low):
            dropped(now.sparkSession, read)
        now = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = RADIUS, bucket: int = 64) -> DataFrame:
    """(id, fp long, component long, copies long): component is the smallest id reachable over links, copies the rows with the same fingerprint."""
    marked = written(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    nodes = marked.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
    roots = components(links(nodes.select("fp"), radius, bucket))
    joined = written(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", "copies", F.coalesce("root", "fp").alias("root")), "named")
    groups = written(joined.groupBy("root").agg(F.min("least").alias("component")), "groups")
    named = joined.join(groups, "root").select("fp", "component", "copies")
    return marked.join(named, "fp").select("id", "fp", "component", "copies")


# --- Similar texts: wide fingerprints ----------------------------------------------------------------------------


def wide_fingerprint(text: bytes | None, shingle: int = 5) -> bytes:
    """The 512-bit SimHash of a text's shingles of lower-case words of letters and digits, repeats included; zero without words."""
    words = words_of(text)
    if not words:
        return bytes(WIDE // 8)
    hashes = rolling(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), min(shingle, len(words)))
    out = np.zeros(WIDE, np.int64)
    for k in range(WIDE // 64):
        for i in range(0, len(hashes), 1 << 14):
            x = hashes[i : i + (1 << 14)] + np.uint64((k * 0x9E3779B97F4A7C15) % (1 << 64))
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
            x ^= x >> np.uint64(31)
            out[64 * k : 64 * k + 64] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * out > len(hashes)).tobytes()


def share_of_bits(similarity: float) -> float:
    """The share of bits in which fingerprints of sets of one size with that Jaccard similarity differ, on the average."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def blocks_for(n: int, similarity: float = 0.8, recall: float = 0.9) -> np.ndarray:
    """Rows of bit numbers, one row for each block: a few unlike texts of n share a value of a block, and pairs at the
    similarity share one block at least with probability recall. First the bits in order, then in seeded orders."""
    width = max(16, int(np.ceil(np.log2(max(n, 2)))) - 2)
    count = int(np.ceil(np.log(1 - recall) / np.log(1 - (1 - share_of_bits(similarity)) ** width)))
    rnd, rows = np.random.default_rng(7), []
    while len(rows) < count:
        order = rnd.permutation(WIDE) if rows else np.arange(WIDE)
        rows += [order[i : i + width] for i in range(0, WIDE - width + 1, width)]
    return np.array(rows[:count])


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def close_pairs(group: np.ndarray, prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group (groups are runs) whose prints (rows of 64-bit words) differ in at most most bits: all of
    them in groups of up to FULL rows, in larger ones as many as hold the same rows together (``held_together``)."""
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.append(start, len(group)))
    end = np.repeat(start + size, size)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = np.flatnonzero(np.repeat(size <= FULL, size))
    for d in range(1, FULL):
        at = at[at + d < end[at]]
        if not len(at):
            break
        met = at[_close(prints[at], prints[at + d]) <= most]
        left.append(met)
        right.append(met + d)
    for k in np.flatnonzero(size > FULL).tolist():
        a, b = held_together(prints[start[k] : start[k] + size[k]], most)
        left.append(a + start[k])
        right.append(b + start[k])
    return np.concatenate(left), np.concatenate(right)


def held_together(prints: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows at no more than most bits that connect all rows which such pairs connect.

    The first row that is in no core yet leads one: the rows within half the bits of it, which are all close to each other.
    A leader is compared with all rows, so what is left is members of two cores. The distance is a metric: two cores whose
    leaders are farther apart than most and both radii have no close members; of the others, those that nothing connects
    yet have their members compared, block by block, up to the first pair that is close."""
    n = len(prints)
    core, left, right, leaders, radius = np.full(n, -1, np.int64), [], [], [], []
    up = np.arange(n)

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def link(a: int, b: int) -> None:
        left.append(a)
        right.append(b)
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)

    for lead in range(n):
        if core[lead] >= 0:
            continue
        far = _close(prints, prints[lead])
        own = (far <= most // 2) & (core < 0)
        core[own] = len(leaders)
        radius.append(int(far[own].max()))
        leaders.append(lead)
        for x in np.flatnonzero(far <= most).tolist():
            if top(x) != top(lead):
                link(lead, x)
    by_core = np.argsort(core, kind="stable")
    ends = np.searchsorted(core[by_core], np.arange(len(leaders) + 1))
    reach, leaders = np.array(radius), np.array(leaders)
    wide = np.flatnonzero(reach > 0)  # a core without radius is its leader, which has been compared with all
    for at, j in enumerate(wide.tolist()):
        before = wide[:at]
        for i in before[_close(prints[leaders[before]], prints[leaders[j]]) <= most + reach[before] + reach[j]].tolist():
            if top(int(leaders[i])) == top(int(leaders[j])):
                continue
            a, b = by_core[ends[i] : ends[i + 1]], by_core[ends[j] : ends[j + 1]]
            for x in a.tolist():
                met = np.flatnonzero(_close(prints[b], prints[x]) <= most)
                if len(met):
                    link(x, int(b[met[0]]))
                    break
    return np.array(left, np.int64), np.array(right, np.int64)


def spanning(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Of pairs of n rows, the numbers of as many as hold the same rows together."""
    up, kept = list(range(n)), []

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            kept.append(k)
    return np.array(kept, np.int64)


def similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.9) -> DataFrame:
    """(row_key, id, copies, first): one row per different (id, text); row_key is row_key(). copies are the rows that have
    both; first says whether it stands for its group of similar texts, as the one with the smallest id (null last)."""
    prints = docs.select(row_key(docs, id_col, text_col).alias("row_key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def mark(batches):
        for batch in batches:
            found = [wide_fingerprint(t.as_py(), shingle) for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary()), pa.array([xxhash.xxh3_128_digest(f) for f in found], pa.binary())], ["row_key", "id", "fp", "node"])

    marked = written(prints.mapInArrow(handing_back(mark), "row_key binary, id long, fp binary, node binary"), "wide-fingerprints")
    least = F.min(F.struct(F.col("id").isNull().alias("nameless"), F.col("id"), F.col("row_key"))).alias("least")
    nodes = written(marked.groupBy("node").agg(F.first("fp").alias("fp"), least), "nodes")
    blocks, most = blocks_for(nodes.count(), similarity, recall), int(np.floor(WIDE * share_of_bits(similarity) * SLACK))

    def deal(batches):
        power = np.uint64(1) << np.arange(blocks.shape[1], dtype=np.uint64)
        for batch in batches:
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(-1, WIDE // 8), axis=1).astype(np.uint64)
            for k, row in enumerate(blocks):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bits), k, np.int32)), pa.array((bits[:, row] @ power).view(np.int64)), batch.column("node"), batch.column("fp")], ["block", "value", "node", "fp"])

    def meet(batches):
        def pairs(rows: pa.Table):
            words = np.frombuffer(b"".join(rows.column("fp").to_pylist()), "<u8").reshape(-1, WIDE // 64)
            run = np.cumsum(np.concatenate(([0], (np.diff(rows.column("block").to_numpy()) != 0) | (np.diff(rows.column("value").to_numpy()) != 0))))
            a, b = close_pairs(run, words, most)
            enough = spanning(a, b, len(words))
            a, b = a[enough], b[enough]
            return pa.RecordBatch.from_arrays([rows.column("node").take(pa.array(a)).combine_chunks(), rows.column("node").take(pa.array(b)).combine_chunks()], ["a", "b"])

        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            block, value = held.column("block").to_numpy(), held.column("value").to_numpy()
            open_from = int(np.flatnonzero((block == block[-1]) & (value == value[-1]))[0]) if len(block) else 0
            if open_from:
                yield pairs(held.slice(0, open_from))
                held = held.slice(open_from)
        if held is not None and held.num_rows:
            yield pairs(held)

    filed = nodes.select("node", "fp").mapInArrow(handing_back(deal), "block int, value long, node binary, fp binary")
    roots = components(filed.repartition("block", "value").sortWithinPartitions("block", "value", "node").mapInArrow(handing_back(meet), "a binary, b binary"))
    # Tables on both sides, as adaptive execution splits a large root's rows only where no aggregate stands before the join.
    named = written(nodes.join(roots.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "least", F.coalesce("root", "node").alias("root")), "named")
    heads = written(named.groupBy("root").agg(F.min("least").alias("head")), "heads")
    stands = named.join(heads, "root").select(F.col("node").alias("of"), "head")
    rows = marked.groupBy("row_key", "id", "node").agg(F.count("*").alias("copies"))
    return rows.join(stands, F.col("node") == F.col("of")).select("row_key", "id", "copies", (F.col("row_key") == F.col("head.row_key")).alias("first"))


def row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """16 bytes that stand for a row's id and text; a null text counts as empty."""
    return F.unhex(F.md5(F.concat_ws(":", F.coalesce(docs[id_col].cast("string"), F.lit("null")), F.md5(F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary"))).cast("binary")))
