"""Mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks, all in DataFrame expressions.

1. A source's target is its weight's share of the mix, but at most ``limit`` times its own words; what lies above
   is shared again by weight until no target is above (solved in closed form: targets are min(cap, level * weight)).
2. Blocks go to sources by highest quotients target / (2k + 1). A block has 64 words at most, and so few that the
   smallest target above zero has ``least_blocks`` of them, so small sources come near their targets, too.
3. A source's documents are dealt to shards of about ``shard_rows`` keys by ranges of a seeded hash. A shard's quota is
   an integer: the source's quota times the words up to the shard's end, rounded, less the same up to its begin.
4. In a shard the documents stand in hash order as one stream of words, cut into blocks. Whole rounds of the stream
   come first; the rest of the shard's quota is a circular run of blocks from a seeded start. Only the run's ends cut
   documents.

No source meets in one task: rows with equal keys are pre-aggregated, a shard's rows are ordered by themselves, and
only sums of shards are ordered within a source.

Defined results: a null text has size 0; a null source is a source, the last one; a null id is an id; equal rows
share their words evenly in the order of the stream; an empty table gives no rows; other columns are not read by
mix(), and mixed_documents() keeps them as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.llm.common import fresh, small_side, written

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_SOURCES, BROADCAST_SHARDS = 20_000, 500_000
BLOCK_WORDS, LEAST_BLOCKS, SHARD_ROWS = 64, 32, 4_000


def sizes(docs: DataFrame, keys: list[Column], text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(k0.., source, size, copies): one row per different key, source and size."""
    named = [key.alias(f"k{i}") for i, key in enumerate(keys)]
    size = F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size")
    return docs.select(*named, F.col(source_col).cast("string").alias("source"), size).groupBy(*[f"k{i}" for i in range(len(keys))], "source", "size").agg(F.count("*").alias("copies"))


def seeded(value: Column, seed: int) -> Column:
    """60 bits of a hash that other SQL engines have, too."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit("null")))), 1, 15), 16, 10).cast("long")


def quotas(sized: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, block_words: int = BLOCK_WORDS, least_blocks: int = LEAST_BLOCKS) -> DataFrame:
    """Per source: place, source_size, n_keys, target, block (words of a block), quota (blocks).

    One row per source is ordered in one task; everything before is partial sums."""
    by_source = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("n_keys"))
    all_rows = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = by_source.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.lit(float(limit)) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(W.unboundedPreceding, -1)
    total = F.lit(float(share)) * F.sum("source_size").over(all_rows)
    level = (total - F.coalesce(F.sum("cap").over(order), F.lit(0.0))) / (F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(order), F.lit(0.0)))
    levelled = capped.withColumn("level", level).withColumn("fits", F.col("cap") / F.col("weight") >= F.col("level"))
    target = F.least(F.col("cap"), F.coalesce(F.max(F.when(F.col("fits"), F.col("level"))).over(all_rows), F.lit(float("inf"))) * F.col("weight"))
    aimed = levelled.withColumn("target", target).withColumn("all_words", F.sum("target").over(all_rows)).withColumn("n_sources", F.count("*").over(all_rows))
    smallest = F.coalesce(F.min(F.when(F.col("target") > 0, F.col("target"))).over(all_rows), F.lit(0.0))
    aimed = aimed.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(smallest / least_blocks))).cast("long"))
    ideal = F.floor(F.col("target") / F.col("block"))
    # A quota differs from the ideal by less than half the number of sources times its share, plus one.
    reach = F.ceil(F.col("n_sources") * F.col("target") / F.greatest(F.col("all_words"), F.lit(1.0))) + 2
    seats = aimed.withColumn("sure", F.greatest(F.lit(0), ideal - reach).cast("long")).withColumn("top", (ideal + reach).cast("long"))
    seats = seats.withColumn("left", F.round(F.col("all_words") / F.col("block")).cast("long") - F.sum("sure").over(all_rows))
    asked = seats.select("source", "place", "left", "target", F.explode(F.sequence("sure", "top")).alias("k")).withColumn("quotient", F.col("target") / (2 * F.col("k") + 1))
    won = asked.withColumn("rank", F.row_number().over(W.orderBy(F.col("quotient").desc(), "place", "k"))).filter((F.col("rank") <= F.col("left")) & (F.col("target") > 0)).groupBy("place").agg(F.count("*").alias("won"))
    most = (2 * F.col("source_size") / F.col("block")).cast("long")
    done = seats.join(won, "place", "left").withColumn("quota", F.least(F.col("sure") + F.coalesce("won", F.lit(0)), most))
    return done.select("source", "place", "source_size", "n_keys", "target", "block", "quota")


def in_shards(sized: DataFrame, quota: DataFrame, seed: int = 42, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """sized with its source's quota columns, h (seeded hash of the keys) and shard (a range of h)."""
    keys = [c for c in sized.columns if c[0] == "k"]
    named = sized.join(small_side(quota, BROADCAST_SOURCES), sized.source.eqNullSafe(quota.source)).drop(quota.source)
    hashed = named.withColumn("h", seeded(F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys]), seed))
    return hashed.withColumn("shard", F.floor(F.col("h") / F.lit(float(1 << 60)) * F.ceil(F.col("n_keys") / shard_rows)).cast("long"))


def shard_quotas(placed: DataFrame, seed: int = 42) -> DataFrame:
    """Per source (place) and shard: words, n_blocks (of one round), quota (blocks the mix takes), start (first block of
    the run). The quotas of a source's shards add up to its own, but for shards that a quota would fill more than twice."""
    sums = placed.groupBy("place", "shard").agg(F.sum(F.col("size") * F.col("copies")).alias("words"), *[F.first(c).alias(c) for c in ("source_size", "block", "quota")])
    up_to = F.sum("words").over(W.partitionBy("place").orderBy("shard"))
    # floor(2 quota words / size + 1/2) in whole numbers; a decimal holds the product.
    dealt = lambda words: F.floor((2 * F.col("quota").cast("decimal(19,0)") * words.cast("decimal(18,0)") + F.col("source_size")) / (2 * F.greatest(F.col("source_size"), F.lit(1)))).cast("long")
    own = sums.withColumn("own", dealt(up_to) - dealt(up_to - F.col("words"))).withColumn("n_blocks", F.ceil(F.col("words") / F.col("block")).cast("long"))
    start = F.pmod(seeded(F.concat_ws("/", F.col("place"), F.col("shard")), seed), F.greatest("n_blocks", F.lit(1)))
    return own.select("place", "shard", "words", "n_blocks", F.least(F.col("own"), 2 * F.col("n_blocks")).alias("quota"), start.alias("start"))


def taken(sized: DataFrame, quota: DataFrame, seed: int = 42, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """sized, one row per copy, with source_size, target, shard, rounds (whole takes), runs (word ranges of the document:
    the part of the run in it, in two pieces where the run wraps) and taken (words, repeats counted)."""
    keys = [c for c in sized.columns if c[0] == "k"]
    placed = in_shards(sized, quota, seed, shard_rows)
    shares = shard_quotas(placed, seed).select(F.col("place").alias("p"), F.col("shard").alias("s"), F.col("quota").alias("own"), "n_blocks", "start")
    words = F.col("size") * F.col("copies")
    ahead = F.coalesce(F.sum(words).over(W.partitionBy("place", "shard").orderBy("h", *keys, "size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    streams = placed.withColumn("ahead", ahead).join(small_side(written(shares, "shards"), BROADCAST_SHARDS), (F.col("place") == F.col("p")) & (F.col("shard") == F.col("s")))
    rows = streams.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("x", F.col("ahead") + F.col("copy") * F.col("size")).withColumn("y", F.col("x") + F.col("size"))
    rounds = F.floor(F.col("own") / F.greatest("n_blocks", F.lit(1))).cast("long")
    end = F.col("start") + F.pmod(F.col("own"), F.greatest("n_blocks", F.lit(1)))
    runs = F.array(F.struct((F.col("start") * F.col("block")).alias("a"), (F.least(end, F.col("n_blocks")) * F.col("block")).alias("b")), F.struct(F.lit(0).cast("long").alias("a"), (F.greatest(end - F.col("n_blocks"), F.lit(0)) * F.col("block")).alias("b")))
    inner = F.filter(F.transform(runs, lambda r: F.struct((F.greatest(r["a"], F.col("x")) - F.col("x")).alias("a"), (F.least(r["b"], F.col("y")) - F.col("x")).alias("b"))), lambda r: r["a"] < r["b"])
    got = rows.withColumn("rounds", rounds).withColumn("runs", inner)
    return got.withColumn("taken", F.col("rounds") * F.col("size") + F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["b"] - r["a"])).select(*keys, "source", "size", "source_size", "target", "shard", "rounds", "runs", "taken")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, block_words: int = BLOCK_WORDS, seed: int = 42, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(id, source, size, source_size, target, shard, taken, ...): what the mix takes of each row of docs."""
    sized = written(sizes(docs, [F.col(id_col)], text_col, source_col), "sizes")
    quota = written(quotas(sized, weights, share, limit, block_words), "quotas")
    return taken(sized, quota, seed, shard_rows).withColumnRenamed("k0", "id")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, limit: float = 2.0, block_words: int = BLOCK_WORDS, seed: int = 42, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """docs as the mix has them: a document's whole rounds with the text as it is, and the words of the run inside it,
    joined by spaces, where the run covers a part. Documents that the mix takes nothing of are not in it. Rows that differ in
    any column are documents of their own; only of rows equal in all columns one stands for all."""
    (name,) = fresh(docs, "row_key")
    whole_row = F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]))
    hashed, text = F.md5(whole_row.cast("binary")), F.col(f"row.`{text_col}`")
    keys = [F.col(id_col), hashed]
    sized = written(sizes(docs, keys, text_col, source_col), "sizes")
    quota = written(quotas(sized, weights, share, limit, block_words), "quotas")
    took = taken(sized, quota, seed, shard_rows).filter("taken > 0").groupBy("k0", "k1", F.col("source").alias("from")).agg(F.collect_list(F.struct("rounds", "runs", "size")).alias("takes"))
    once = docs.withColumn(name, hashed).dropDuplicates([id_col, name, source_col])
    row = once.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(name).alias("hash"))
    joined = row.join(took, F.col(f"row.`{id_col}`").eqNullSafe(F.col("k0")) & (F.col("hash") == F.col("k1")) & F.col(f"row.`{source_col}`").cast("string").eqNullSafe(F.col("from")))
    whole = F.transform(F.sequence(F.lit(1).cast("long"), F.col("take.rounds")), lambda _: text)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    part = F.transform(F.col("take.runs"), lambda r: F.when(r["b"] - r["a"] == F.col("take.size"), text).otherwise(F.array_join(F.slice(words, (r["a"] + 1).cast("int"), (r["b"] - r["a"]).cast("int")), " ")))
    none = F.array().cast("array<string>")
    texts = F.concat(F.when(F.col("take.rounds") > 0, whole).otherwise(none), F.coalesce(part, none))
    made = joined.withColumn("take", F.explode("takes")).withColumn("mix_text", F.explode(texts))
    return made.select(*[F.col("mix_text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


#: DuckDB SQL of mix() over documents with the default parameters.
SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
g as (select source, sum(size)::bigint as source_size from d group by source),
r as (select *, row_number() over (order by source asc nulls last) - 1 as place from g),
c as (select *, [3.0, 1.0, 2.0][place % 3 + 1]::double as weight, 2.0::double * source_size as cap from r),
l as (select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over w, 0)) / (sum(weight) over () - coalesce(sum(weight) over w, 0)) as level
      from c window w as (order by cap / weight, place rows between unbounded preceding and 1 preceding)),
t as (select *, least(cap, coalesce(max(case when cap / weight >= level then level end) over (), 'inf'::double) * weight) as target from l),
a as (select *, sum(target) over () as all_words, count(*) over () as n_sources,
      greatest(1, least(64, floor(coalesce(min(case when target > 0 then target end) over (), 0) / 32)))::bigint as block from t),
s as (select *, greatest(0, floor(target / block) - (ceil(n_sources * target / greatest(all_words, 1.0)) + 2))::bigint as sure,
      (floor(target / block) + ceil(n_sources * target / greatest(all_words, 1.0)) + 2)::bigint as top from a),
f as (select *, round(all_words / block)::bigint - sum(sure) over () as seats from s),
k as (select place, seats, target, unnest(range(sure, top + 1)) as k from f),
q as (select *, row_number() over (order by target / (2 * k + 1) desc, place, k) as rank from k),
won as (select place, count(*) as won from q where rank <= seats and target > 0 group by place),
m as (select f.*, least(sure + coalesce(won, 0), 2 * source_size // block)::bigint as quota from f left join won using (place)),
n as (select source, count(*) as n_keys from (select distinct doc_id, source, size from d) group by source),
p as (select d.doc_id, d.size, m.place, m.source_size, m.target, m.block, m.quota, ('0x' || substr(md5('42:' || coalesce(d.doc_id::varchar, 'null')), 1, 15))::bigint as h,
      ceil(n.n_keys / 4000) as shards from d join m on d.source is not distinct from m.source join n on d.source is not distinct from n.source),
b as (select *, floor(h / 1152921504606846976.0::double * shards)::bigint as shard from p),
u as (select place, shard, sum(size)::hugeint as words, any_value(source_size)::hugeint as n, any_value(block) as block, any_value(quota)::hugeint as quota from b group by place, shard),
v as (select *, sum(words) over (partition by place order by shard)::hugeint as up_to from u),
w as (select place, shard, ceil(words / block)::bigint as n_blocks, ((2 * quota * up_to + n) // (2 * greatest(n, 1)) - (2 * quota * (up_to - words) + n) // (2 * greatest(n, 1)))::bigint as own from v),
x as (select place, shard, n_blocks, least(own, 2 * n_blocks) as own, ('0x' || substr(md5('42:' || place || '/' || shard), 1, 15))::bigint % greatest(n_blocks, 1) as start from w),
y as (select *, own // greatest(n_blocks, 1) as rounds, own % greatest(n_blocks, 1) as rest from x),
o as (select b.doc_id, b.size, b.source_size, b.target, y.rounds, y.start * block as a, least(y.start + y.rest, y.n_blocks) * block as b, greatest(y.start + y.rest - y.n_blocks, 0) * block as b2,
      coalesce(sum(b.size) over (partition by b.place, b.shard order by h, b.doc_id, b.size rows between unbounded preceding and 1 preceding), 0) as x
      from b join y on b.place = y.place and b.shard = y.shard)
select doc_id, size, source_size::bigint as source_size, target,
  (rounds * size + greatest(0, least(b, x + size) - greatest(a, x)) + greatest(0, least(b2, x + size) - x))::bigint as taken from o
"""
