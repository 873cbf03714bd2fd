"""Queries of slot identity: over embeddings as identity pairs, and over inline keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import constants as C
from recollect.functions import text as X
from recollect.operators import families, identity, ledger
from recollect.providers import stub_embed, stub_judge
from recollect.queries.text import KEYS, NEEDLES, QUOTED, attribute_part, identity_tokens, quantity, slot_tokens, subject_part
from recollect.registry import query
from recollect.schemas import facts_of_events, table

_DOT = lambda a, b: f"list_reduce([x for x in list_transform(range(1, len({a}) + 1), lambda i: {a}[i]::double * {b}[i]::double)], lambda s, x: s + x, 0.0::double)"


def _searched(spark: SparkSession, sf_dir: str, threshold: float | None = None) -> DataFrame:
    """Every vector whose number is divisible by 100 with all others."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))
    return identity.searched(e.filter("key % 100 = 0"), e, threshold)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_searched() with whether both labels are the same, which counts as the same slot."""
    label = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    named = _searched(spark, sf_dir).join(label.select(F.col("vec_id").alias("l"), F.col("label").alias("la")), "l").join(label.select(F.col("vec_id").alias("r"), F.col("label").alias("lb")), "r")
    return named.select("l", "r", "sim", (F.col("la") == F.col("lb")).alias("same_slot"))


_PAIRS = f"""p as (select x.vec_id as l, y.vec_id as r, x.embedding as a, y.embedding as b, x.label = y.label as same_slot from embeddings x join embeddings y on x.vec_id % 100 = 0 and y.vec_id <> x.vec_id),
pairs as (select l, r, round(case when {_DOT('a', 'a')} = 0 or {_DOT('b', 'b')} = 0 then 0 else {_DOT('a', 'b')} / (sqrt({_DOT('a', 'a')}) * sqrt({_DOT('b', 'b')})) end, 6) as sim, same_slot from p)"""


@query(f"with {_PAIRS} select * from pairs")
def identity_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID15, over the query set and all vectors."""
    return _pairs(spark, sf_dir)


@query(f"with {_PAIRS} select l, r, sim from pairs where sim >= 0.15")
def identity_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set's pairs at the threshold or above."""
    return _searched(spark, sf_dir, 0.15)


@query(f"with {_PAIRS} select case when sim >= 0.2 then 'same' when sim < 0.1 then 'different' else 'judge' end as verdict, count(*) as n, min(sim) as least, max(sim) as greatest from pairs group by all")
def identity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pairs are clear and which go to the judge."""
    low, high = 0.1, 0.2
    verdict = F.when(F.col("sim") >= high, "same").when(F.col("sim") < low, "different").otherwise("judge")
    return _searched(spark, sf_dir).groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"), F.min("sim").alias("least"), F.max("sim").alias("greatest"))


_SWEEP = """c as (select sim as threshold, sum(same_slot::int)::bigint as t, sum((not same_slot)::int)::bigint as f from pairs group by sim), n as (select sum(same_slot::int)::bigint as positives, sum((not same_slot)::int)::bigint as negatives from pairs),
s as (select threshold, (sum(t) over w)::bigint as true_merges, (sum(f) over w)::bigint as false_merges from c window w as (order by threshold desc) union all select -1.0, positives, negatives from n),
sweep as (select threshold, true_merges, false_merges, round(true_merges / positives, 4) as same_slot_recall from s, n)"""


@query(f"with {_PAIRS}, {_SWEEP} select * from sweep")
def identity_threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges at each threshold."""
    return identity.threshold_sweep(_pairs(spark, sf_dir))


_ALL_PAIRS = f"""v as (select vec_id, embedding, label, {_DOT('embedding', 'embedding')} as square from embeddings),
p as (select x.vec_id as l, y.vec_id as r, x.embedding as a, y.embedding as b, x.square as sa, y.square as sb, x.label = y.label as same_slot from v x join v y on x.vec_id < y.vec_id),
pairs as (select l, r, round(case when sa = 0 or sb = 0 then 0 else {_DOT('a', 'b')} / (sqrt(sa) * sqrt(sb)) end, 6) as sim, same_slot from p)"""


@query(f"with {_ALL_PAIRS}, {_SWEEP} select * from (select * from sweep where false_merges = 0 union all select null, 0, 0, 0.0) order by true_merges desc, threshold nulls last limit 1")
def identity_best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best threshold without a false merge, judged on all pairs of all vectors, each pair once; null if there is none."""
    return identity.best_threshold_of_all(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), "label"))


@query(f"with {_PAIRS}, t as (select min(sim) filter (where same_slot) as a, max(sim) filter (where not same_slot) as b from pairs) select round(a, 4) as min_same, round(b, 4) as max_neg, round(a - b, 4) as margin, round((select count(*) from pairs where same_slot and sim > b) / (select count(*) from pairs where same_slot), 4) as recall_above, (select count(*) from pairs where same_slot) as n_same from t")
def identity_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A29."""
    return identity.margin(_pairs(spark, sf_dir))


def _opposite(a: str, b: str) -> str:
    has = lambda t, side: f"list_has_any({t}, [{QUOTED(side)}])"
    return "(" + " or ".join(f"({has(a, x)} and {has(b, y)}) or ({has(a, y)} and {has(b, x)})" for x, y in C.ROLE_OPPOSITES) + ")"


_MINUS = lambda x, y: f"len([w for w in {x} if not list_contains({y}, w)])"
_ROLE = f"""select n, len(ta) > 0 and len(tb) > 0 and not {_opposite('ta', 'tb')} and list_has_any(sa, sb)
  and ({_MINUS('ta', 'tb')} = 0 or {_MINUS('tb', 'ta')} = 0 or (len([w for w in ta if list_contains(tb, w) and not (list_contains(sa, w) and list_contains(sb, w))]) > 0 and not ({_MINUS('sa', 'tb')} > 0 and {_MINUS('sb', 'ta')} > 0))) as same_role
from (select n, {identity_tokens('(' + subject_part('a') + ')')} as sa, {identity_tokens('(' + subject_part('b') + ')')} as sb,
  list_distinct(list_concat({identity_tokens('(' + subject_part('a') + ')')}, {identity_tokens('(' + attribute_part('a') + ')')})) as ta, list_distinct(list_concat({identity_tokens('(' + subject_part('b') + ')')}, {identity_tokens('(' + attribute_part('b') + ')')})) as tb from t)"""


@query(f"with t as ({KEYS}) {_ROLE}")
def identity_same_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID9, J15."""
    return spark.sql(KEYS).select("n", families.same_role(F.col("a"), F.col("b")).alias("same_role"))


def _conflict(a: str, b: str) -> str:
    digits = lambda t: f"list_sort([w for w in {t} if regexp_full_match(w, '[0-9]+')])"
    of = lambda t, d: f"list_sort([w for w in {t} if w in ({QUOTED(d)})])"
    return "(" + " or ".join(f"(len({x}) > 0 and len({y}) > 0 and {x} <> {y})" for x, y in [(digits(a), digits(b)), *((of(a, d), of(b, d)) for d in C.SLOT_DIMENSIONS)]) + ")"


@query(f"with t as ({KEYS}), u as (select n, a, b, {slot_tokens('a')} as ta, {slot_tokens('b')} as tb from t), v as (select *, len([w for w in ta if list_contains(tb, w)]) as shared from u) select n, case when a = b then true else not {_conflict('ta', 'tb')} and shared >= 2 and 3 * shared >= 2 * least(len(ta), len(tb)) end as near from v")
def identity_near_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID7, J14."""
    return spark.sql(KEYS).select("n", families.near_duplicate_keys(F.col("a"), F.col("b")).alias("near"))


@query(f"with t as ({NEEDLES}) select x.n as l, y.n as r, trim(lower(x.v)) = trim(lower(y.v)) or ({quantity('x.v')} and {quantity('y.v')}) as gate, case when trim(lower(x.v)) = trim(lower(y.v)) then 'safe_dedup' when {quantity('x.v')} and {quantity('y.v')} then 'numeric_update' else 'textual_distinct' end as class from t x join t y on x.n < y.n")
def identity_value_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID14, A27, PF12: which values may be versions of one, and the class of each merge."""
    t = spark.sql(NEEDLES)
    pairs = t.select(F.col("n").alias("l"), F.col("v").alias("kept_value")).join(t.select(F.col("n").alias("r"), F.col("v").alias("merged_value")), F.col("l") < F.col("r"))
    return identity.merge_taxonomy(pairs).select("l", "r", identity.value_gate(F.col("kept_value"), F.col("merged_value")).alias("gate"), "class")


@query(f"with t as ({NEEDLES}) select n, k as bare, trim(translate(k, '._', '  ')) as natural, lower(trim(split_part(k, '.', 1))) || ' ' || trim(translate(k, '._', '  ')) as subject, trim(translate(k, '._', '  ')) || ': ' || v as full_fact, lower(trim(split_part(k, '.', 1))) || ': ' || v as subject_value from t")
def identity_compositions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID13, ID16: texts that are embedded."""
    none = F.lit(None).cast("string")
    return spark.sql(NEEDLES).select("n", *[identity.composed(s, F.col("k"), F.col("v"), none).alias(s) for s in ("bare", "natural", "subject", "full_fact", "subject_value")])


@query(f"with p as (select x.l as l, list_sort(list(x.token)) as tokens from (select n as l, unnest(list_distinct([w for w in regexp_extract_all(lower(a), '[a-z0-9]+') if length(w) > 1 and w not in ({QUOTED(C.KEY_STOPWORDS)})])) as token from ({KEYS})) x group by x.l) select * from p")
def identity_blocking_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that pairs are blocked by."""
    return spark.sql(KEYS).select(F.col("n").alias("l"), F.array_sort(X.key_tokens(F.col("a"))).alias("tokens")).filter(F.size("tokens") > 0)


@query()
def identity_role_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID10, W8: groups by guarded union, in which a middle spelling joins no two roles."""
    both = spark.sql(KEYS).select(F.col("n").cast("long").alias("seq"), F.explode(F.array("a", "b")).alias("slot_key"))
    return families.grouped_by_role(both.withColumn("namespace", F.lit("all"))).select("slot_key", "role_group")


def _embedded_pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    own = ledger.newest_per_slot(ledger.closed_form(facts_of_events(spark, sf_dir)))
    pairs = identity.fact_pairs(own)
    texts = own.select(X.full_fact(F.col("slot_key"), F.col("slot_value")).alias("text"))
    return pairs, identity.embedded(texts, stub_embed())


@query()
def identity_blocked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar facts of a user whose keys share a word, by a stub embedding."""
    pairs, vectors = _embedded_pairs(spark, sf_dir)
    return identity.similarity_join(pairs, vectors, 0.5).select("namespace", "l", "r", F.round("sim", 6).alias("sim"))


@query()
def identity_band_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs a judge sees, and what is merged if it always says no or always yes."""
    pairs, vectors = _embedded_pairs(spark, sf_dir)
    out = [identity.banded_join(pairs, vectors, stub_judge(v), (0.3, 0.6)).groupBy("judged").agg(F.count("*").alias("n")).withColumn("always", F.lit(v)) for v in (False, True)]
    return out[0].unionByName(out[1])


@query()
def identity_sampled_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two negatives for each vector whose number is divisible by 100, of all vectors with another label, by a seeded
    hash. No cosine is needed for it; null vectors are none's negative and have none."""
    e = table(spark, sf_dir, "embeddings").filter("embedding is not null").select(F.col("vec_id").alias("key"), "label")
    return identity.sampled_negatives(e.filter("key % 100 = 0"), e)
