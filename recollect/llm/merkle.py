"""Merkle manifest of a dataset: leaves, subroots of groups, one root, and a proof for each row.

Rows of a group stand in the order of an id. Their places come from one range-partitioned sort: a row's place is its number
in its partition and the rows that earlier partitions hold of its group, so a group of any size is dealt over many tasks.
Places are cut into blocks of 3^6 leaves. A block's leaves are one ordered array; ``sequence``, ``transform`` and ``slice``
make the next level's array of it and ``aggregate`` goes on to the block's root, all in one expression, without Python.
Block roots are the leaves of the next round, until each group has one node (its height is known from its size). On the
way back a block gets the path above it by a join of one row per block, so what is shuffled is digests, never texts.
Siblings and folded roots are made inside the arrays; a row leaves its block only with its results.

Defined results: a null field is ``-`` in the leaf; a null group is the first one; in a group a null id stands before
all others, rows with equal ids stand in the order of their leaf digests, and rows equal in all fields in any order, as
their results differ by their places only; a lone row is its own subroot and, as the only group, the root, with the digest of
nothing as its proof; an empty table gives no rows. Texts are hashed whole. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.llm.common import small_side, written

FAN, DEEP = 3, 6
BROADCAST_TREES = 200_000
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A leaf's field: ``-`` for null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*fields), 256)


def placed(rows: DataFrame, tree: str, *order: str) -> DataFrame:
    """rows with pos, the place from 0 among the rows of one tree in the given order, and n, how many rows that tree has."""
    # The salt parts rows that are equal in all order columns, which would else be one range.
    salted = rows.withColumn("_salt", F.monotonically_increasing_id())
    keys = [F.col(tree).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order), F.col("_salt")]
    sorted_rows = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_seq", F.monotonically_increasing_id()).drop("_salt")
    staged = written(sorted_rows.withColumn("_part", F.shiftrightunsigned("_seq", 33)), "leaves")
    runs = staged.groupBy(F.col(tree).alias("_tree"), F.col("_part").alias("_run")).agg(F.min("_seq").alias("_first"), F.count("*").alias("_size"))
    before = W.partitionBy("_tree").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    starts = runs.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).withColumn("n", F.sum("_size").over(W.partitionBy("_tree"))).drop("_size")
    met = staged.join(small_side(written(starts, "runs"), BROADCAST_TREES), (F.col("_part") == F.col("_run")) & F.col(tree).eqNullSafe(F.col("_tree")))
    return met.withColumn("pos", F.col("_seq") - F.col("_first") + F.col("_before")).drop("_seq", "_part", "_run", "_tree", "_first", "_before")


def height(n: Column) -> Column:
    """Levels above n nodes, the smallest h with 3^h >= n."""
    return F.size(F.filter(F.array(*[F.lit(FAN**i) for i in range(40)]), lambda most: most < n))


def above(nodes: Column) -> Column:
    """The level above an array of digests."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda i: F.sha2(F.array_join(F.slice(nodes, i * FAN + 1, F.lit(FAN)), ""), 256))


def steps(levels: Column) -> Column:
    """0, 1, .. for each level of a block but the last, empty for a single level."""
    return F.filter(F.sequence(F.lit(0), F.lit(DEEP - 1)), lambda j: j < F.size(levels) - 1)


def path_in_block(levels: Column, place: Column) -> Column:
    """The siblings to the left and right of a leaf's ancestors, level by level."""

    def siblings(j: Column) -> Column:
        nodes = F.element_at(levels, j + 1)
        at = F.floor(place / F.pow(F.lit(float(FAN)), j)).cast("int")
        inside = F.pmod(at, F.lit(FAN))
        return F.struct(F.array_join(F.slice(nodes, at - inside + 1, inside), "").alias("left"), F.array_join(F.slice(nodes, at + 2, FAN - 1 - inside), "").alias("right"))

    return F.transform(steps(levels), siblings)


def folded(start: Column, path: Column) -> Column:
    """The root that a digest and the siblings on its path give."""
    return F.aggregate(path, start, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def blocks_of(nodes: DataFrame) -> DataFrame:
    """(tree, block, rows, levels, up, top): the blocks of nodes (tree, pos, h, digest, own), each with its rows in order,
    the levels of its nodes, the path above its root, and its tree's root. h is how many levels the tree still has."""
    width = FAN**DEEP
    own = F.struct("pos", "digest", "own")
    grouped = nodes.groupBy("tree", F.floor(F.col("pos") / width).alias("block")).agg(F.array_sort(F.collect_list(own)).alias("rows"), F.max("h").alias("h"))
    climbs = F.filter(F.sequence(F.lit(1), F.lit(DEEP)), lambda j: j <= F.col("h"))
    levels = F.aggregate(climbs, F.array(F.col("rows.digest")), lambda done, _: F.concat(done, F.array(above(F.element_at(done, -1)))))
    blocks = written(grouped.withColumn("levels", levels).withColumn("top", F.element_at(F.element_at("levels", -1), 1)), "blocks")
    nothing = F.array().cast(PATH)
    if blocks.filter(F.col("h") > DEEP).limit(1).count() == 0:
        return blocks.select("tree", "block", "rows", "levels", nothing.alias("up"), "top")
    upper = blocks.filter(F.col("h") > DEEP).select("tree", F.col("block").alias("pos"), (F.col("h") - DEEP).alias("h"), F.col("top").alias("digest"), F.lit(0).alias("own"))
    paths = blocks_of(upper).select(F.col("tree").alias("of"), F.explode(F.transform("rows", lambda r, i: F.struct(r["pos"].alias("pos"), F.concat(path_in_block(F.col("levels"), i), F.col("up")).alias("up")))).alias("p"), F.col("top").alias("above"))
    paths = paths.select("of", F.col("p.pos").alias("place"), F.col("p.up").alias("up"), "above")
    met = blocks.join(paths, F.col("tree").eqNullSafe(F.col("of")) & (F.col("block") == F.col("place")), "left")
    return met.select("tree", "block", "rows", "levels", F.coalesce("up", nothing).alias("up"), F.coalesce("above", "top").alias("top"))


def manifest(rows: DataFrame, fields: list[str], group_col: str = "source", id_col: str = "doc_id", altered: dict[str, Column] | None = None, when: Column | None = None) -> DataFrame:
    """Per row: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``fields`` make a leaf, in that order. Where ``when`` holds, the proof is checked against the leaf of a row with the
    columns of ``altered`` in place of its own; else against its own leaf."""
    own = digest(*(field(rows[c]) for c in fields))
    other = digest(*(field((altered or {}).get(c, rows[c])) for c in fields)) if altered else own
    tampered = F.when(F.coalesce(when, F.lit(False)), other) if altered and when is not None else F.lit(None).cast("string")
    tree = F.when(rows[group_col].isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), rows[group_col].cast("string")))
    leaves = rows.select(tree.alias("tree"), rows[id_col].alias("id"), own.alias("digest"), tampered.alias("tampered"))
    at = placed(leaves, "tree", "id", "digest")
    blocks = blocks_of(at.select("tree", "pos", height(F.col("n")).alias("h"), "digest", F.struct("id", "tampered").alias("own")))
    # The groups' roots are the leaves of one more tree.
    subroots = placed(blocks.filter("block = 0").select(F.lit("").alias("all"), "tree", F.col("top").alias("digest")), "all", "tree")
    crown = blocks_of(subroots.select(F.col("all").alias("tree"), "pos", height(F.col("n")).alias("h"), "digest", F.col("tree").alias("own")))
    trees = crown.select(F.explode(F.transform("rows", lambda r, i: F.struct(r["own"].alias("name"), F.concat(path_in_block(F.col("levels"), i), F.col("up")).alias("path")))).alias("t"), F.col("top").alias("root"))
    trees = small_side(written(trees.select(F.col("t.name").alias("name"), F.col("t.path").alias("path"), "root"), "groups"), BROADCAST_TREES // 10)
    met = blocks.join(trees, F.col("tree") == F.col("name"))
    with_path = F.transform("rows", lambda r, i: F.struct(r.alias("row"), F.concat(path_in_block(F.col("levels"), i), F.col("up"), F.col("path")).alias("path")))
    result = lambda x: F.struct(
        x["row"]["own"]["id"].alias("id"), x["row"]["digest"].alias("leaf"), F.sha2(F.array_join(F.transform(x["path"], lambda s: F.concat(s["left"], s["right"])), ""), 256).alias("proof_sha256"),
        folded(F.coalesce(x["row"]["own"]["tampered"], x["row"]["digest"]), x["path"]).alias("folded_root"),
    )
    out = met.select(F.col("top").alias("subroot"), "root", F.explode(F.transform(with_path, result)).alias("x"))
    return out.select("x.id", "x.leaf", "subroot", "root", "x.proof_sha256", "x.folded_root", (F.col("x.folded_root") == F.col("root")).alias("verified"))


#: DuckDB SQL of the op11 query. The checksum is taken bit by bit over the bytes of the number.
SQL = r"""
with recursive bits as (select distinct doc_id, list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))) as state from documents where doc_id is not null),
fields as (select d.doc_id, source, coalesce(strlen(d.doc_id::varchar) || ':' || d.doc_id::varchar, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(n_chars::varchar) || ':' || n_chars::varchar, '-') as head, text, coalesce(1 - (state & 1), 1) = 0 as tampered from documents d left join bits b on d.doc_id = b.doc_id),
hashed as (select *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf,
    sha256(head || coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-')) as other from fields),
leaves as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, dense_rank() over (order by source nulls first) - 1 as tree from hashed),
levels(tree, lvl, nodes) as (select tree, 0, list(leaf order by pos) from leaves group by tree
  union all select tree, lvl + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) from levels where len(nodes) > 1),
subroots as (select tree, nodes[1] as subroot from levels where len(nodes) = 1),
crown(lvl, nodes) as (select 0, list(subroot order by tree) from subroots
  union all select lvl + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1:3 * i + 3], ''))) from crown where len(nodes) > 1),
ats as (select l.tree, pos, lvl, nodes, (pos // (3 ** lvl)::bigint) as q from leaves l join levels v on l.tree = v.tree and len(nodes) > 1
  union all select l.tree, pos, 1000 + lvl, nodes, (l.tree // (3 ** lvl)::bigint) from leaves l, crown where len(nodes) > 1),
sides as (select tree, pos, row_number() over (partition by tree, pos order by lvl) as step, array_to_string(nodes[(q - q % 3 + 1):q], '') as l, array_to_string(nodes[(q + 2):(q - q % 3 + 3)], '') as r from ats),
proofs as (select tree, pos, string_agg(l || r, '' order by step) as proof, max(step) as last from sides group by tree, pos),
folds(tree, pos, step, h) as (select tree, pos, 0, case when tampered then other else leaf end from leaves
  union all select f.tree, f.pos, f.step + 1, sha256(l || h || r) from folds f join sides s on s.tree = f.tree and s.pos = f.pos and s.step = f.step + 1)
select doc_id, leaf, subroot, c.nodes[1] as root, sha256(coalesce(proof, '')) as proof_sha256, f.h as folded_root, f.h = c.nodes[1] as verified
from leaves l join subroots s on l.tree = s.tree left join proofs p on p.tree = l.tree and p.pos = l.pos join folds f on f.tree = l.tree and f.pos = l.pos and f.step = coalesce(p.last, 0), crown c where len(c.nodes) = 1
"""
