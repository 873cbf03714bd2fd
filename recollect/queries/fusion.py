"""Queries of retrieval from three sources and of entity resolution: documents as nodes with texts, embeddings as their
vectors, orders as edges between them, benchmark passages as requests, every fourth of which asks for a point in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators import fusion, graph, vectors
from recollect.queries.graph import T0
from recollect.registry import query
from recollect.schemas import edges_of_orders, table

SEEDS, FLOOR = 3, 0.05


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages with the vector of their number, blended with the next one's."""
    v = _vectors(spark, sf_dir)
    own, after = v.toDF("a", "va"), v.toDF("b", "vb")
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), F.col("text").alias("query"), F.col("item_id").alias("key"), F.when(F.col("item_id") % 4 == 0, F.lit(T0)).alias("at"))
    met = items.join(own, F.col("key") == F.col("a"), "left").join(after, F.col("key") + 1 == F.col("b"), "left")
    return met.withColumn("vector", vectors.blended(F.col("va"), F.col("vb"), F.lit(0.5))).drop("a", "b", "va", "vb")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between documents, each replaced by the next of its subject and relation."""
    n = table(spark, sf_dir, "documents").count()
    of = lambda c: F.pmod(F.col(c).cast("long"), F.lit(n)).cast("string")
    placed = edges_of_orders(spark, sf_dir).withColumns({"subject_id": of("subject_id"), "object_id": of("seq"), "object_literal": F.lit(None).cast("string")})
    return graph.superseded(placed).select(F.col("subject_id").cast("long").alias("source"), F.col("object_id").cast("long").alias("target"), "valid_from", "valid_to", "invalidated_at")


def _seeds(requests: DataFrame, lexical: DataFrame) -> DataFrame:
    """The nodes that a request names: its best by words."""
    return lexical.filter(F.col("place") <= SEEDS).select("query_id", "id").join(requests.select("query_id", "at"), "query_id")


def _fused(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    requests, rows = _requests(spark, sf_dir), _vectors(spark, sf_dir)
    lexical = vectors.written(fusion.bm25(requests, _nodes(spark, sf_dir)), "lexical")
    by_graph = fusion.by_graph(_seeds(requests, lexical), _edges(spark, sf_dir))
    found = fusion.fused({"lexical": lexical, "vector": fusion.by_vector(requests, rows), "graph": by_graph})
    return vectors.written(found, "fused"), requests, rows


_LEXICAL = """d as (select doc_id as id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') as toks from documents),
st as (select count(*) as n, sum(len(toks)) as total from d),
req as (select item_id::varchar as query_id, item_id as key, text as query, case when item_id % 4 = 0 then %(t0)s end as at_, list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::double + 0.5::double * b.embedding[i]::double) as vec
  from benchmark left join embeddings a on a.vec_id = item_id left join embeddings b on b.vec_id = item_id + 1),
asked as (select query_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(query, '')), '[a-z0-9]+'))) as term from req),
posted as (select id, length, term, count(*) as tf from (select id, len(toks) as length, unnest(toks) as term from d) group by all),
df as (select term, count(*) as df from posted group by term),
lexs as (select query_id, id, round(sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / (total / n)))), 6) as score from asked join df using (term) join posted using (term), st group by all),
lex as (select *, row_number() over (partition by query_id order by score desc, id) as place from lexs qualify place <= 50)""".replace("%(t0)s", repr(T0))
_GRAPH = """orig as (select o_orderkey as seq, o_custkey % nd as s, o_orderkey % nd as t, o_orderpriority as rel, epoch(o_orderdate)::double as valid_from from orders, (select count(*) as nd from documents)),
fresh as (select * from (select *, lag(t) over (partition by s, rel order by seq) as before from orig) where before is null or before <> t),
closed as (select s, t, valid_from, lead(valid_from) over (partition by s, rel order by seq) as valid_to from fresh),
both_ways as (select s as f, t as o, valid_from, valid_to from closed where s <> t union all select t, s, valid_from, valid_to from closed where s <> t),
h0 as (select l.query_id, l.id, r.at_ from lex l join req r using (query_id) where place <= 3),
h1 as (select query_id, at_, o as id, count(*) as support from h0 join both_ways on f = id where case when at_ is null then valid_to is null else valid_from <= at_ and (valid_to is null or at_ < valid_to) end and not exists (select 1 from h0 z where z.query_id = h0.query_id and z.id = o) group by all),
h2 as (select query_id, at_, o as id, count(*) as support from h1 join both_ways on f = id where case when at_ is null then valid_to is null else valid_from <= at_ and (valid_to is null or at_ < valid_to) end
  and not exists (select 1 from h0 z where z.query_id = h1.query_id and z.id = o) and not exists (select 1 from h1 z where z.query_id = h1.query_id and z.id = o) group by all),
hops as (select query_id, id, 1 as hop, support from h1 union all select query_id, id, 2, support from h2),
gra as (select *, row_number() over (partition by query_id order by hop, support desc, id) as place from hops qualify place <= 50)"""
_FUSED = f"""{_LEXICAL}, {_GRAPH},
vecs as (select query_id, vec_id as id, round(list_cosine_similarity(vec, embedding::double[]), 6) as score from req, embeddings where vec is not null),
near as (select *, row_number() over (partition by query_id order by score desc, id) as place from vecs qualify place <= 50),
lists as (select query_id, id, place, 'lexical' as source from lex union all select query_id, id, place, 'vector' from near union all select query_id, id, place, 'graph' from gra),
sums as (select query_id, id, round(sum(1.0::double / (60 + place)), 9) as score, string_agg(source, '+' order by source) as sources from lists group by all),
fused as (select *, row_number() over (partition by query_id order by score desc, id) as place from sums qualify place <= 150)"""


@query(f"with {_LEXICAL} select query_id, id, score, place from lex")
def retrieval_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by words: BM25 with length normalisation, the best fifty of each request."""
    return fusion.bm25(_requests(spark, sf_dir), _nodes(spark, sf_dir))


@query(f"with {_LEXICAL}, {_GRAPH} select query_id, id, hop, support from hops")
def retrieval_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by traversal: all nodes within two steps of those named, over edges that hold now or at the request's time."""
    requests = _requests(spark, sf_dir)
    lexical = fusion.bm25(requests, _nodes(spark, sf_dir))
    return fusion.frontier(_seeds(requests, lexical), _edges(spark, sf_dir))


@query(f"with {_FUSED} select query_id, id, score, sources, place from fused")
def retrieval_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all three sources by reciprocal rank fusion."""
    return _fused(spark, sf_dir)[0]


@query(
    f"""with {_FUSED}, floored as (select f.query_id, f.id, f.score, f.sources, round(list_cosine_similarity(r.vec, e.embedding::double[]), 6) as sim from fused f join req r using (query_id) join embeddings e on e.vec_id = f.id)
select *, row_number() over (partition by query_id order by score desc, id) as place from floored where sim >= {FLOOR} qualify place <= 18"""
)
def retrieval_above_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of a request: fused candidates above a floor of similarity, up to the edge budget."""
    found, requests, rows = _fused(spark, sf_dir)
    return fusion.above_floor(found, requests, rows, FLOOR)


@query(
    f"""with recursive {_FUSED}, c as (select f.query_id, f.id, f.score / max(f.score) over (partition by f.query_id) as worth, e.embedding::double[] as v from fused f left join embeddings e on e.vec_id = f.id),
sims as (select x.query_id, x.id as a, y.id as b, coalesce(list_cosine_similarity(x.v, y.v), 0.0) as sim from c x join c y on x.query_id = y.query_id and x.id <> y.id),
pick(query_id, n, chosen, best) as (select query_id, 1, [-(max(struct_pack(gain := round(0.7 * worth, 9), low := -id))).low], max(struct_pack(gain := round(0.7 * worth, 9), low := -id)) from c group by query_id
  union all select query_id, n + 1, list_append(chosen, -best.low), best from
    (select query_id, n, chosen, max(struct_pack(gain := gain, low := -id)) as best from
      (select p.query_id, p.n, p.chosen, c.id, round(0.7 * any_value(c.worth) - 0.3 * max(s.sim), 9) as gain from pick p join c on c.query_id = p.query_id and not list_contains(p.chosen, c.id) join sims s on s.query_id = p.query_id and s.a = c.id and list_contains(p.chosen, s.b)
       where p.n < 18 group by p.query_id, p.n, p.chosen, c.id) group by query_id, n, chosen))
select query_id, -best.low as id, n as place, best.gain as gain from pick"""
)
def retrieval_diverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of a request: fused candidates by maximal marginal relevance, up to the edge budget."""
    found, _, rows = _fused(spark, sf_dir)
    return fusion.diverse(found, rows)


@query(
    """with recursive e as (select vec_id, embedding::double[] as v from embeddings), n as (select * from e where vec_id % 3 = 0),
m as (select 2 * a.vec_id + j as key, list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] + (0.2::double * ((a.vec_id + 3 * j) % 6)) * b.v[i]) as v from e a, (select unnest([0, 1]) as j) j join e b on b.vec_id = a.vec_id + 1 + j),
k as (select key, vec_id as node, sim from (select m.key, n.vec_id, round(list_cosine_similarity(m.v, n.v), 6) as sim, row_number() over (partition by m.key order by round(list_cosine_similarity(m.v, n.v), 6) desc, -n.vec_id - 1) as r from m join n on round(list_cosine_similarity(m.v, n.v), 6) >= 0.82) where r = 1),
rest as (select * from m where key not in (select key from k)),
pairs as (select x.key as l, y.key as r, round(list_cosine_similarity(x.v, y.v), 6) as sim from rest x join rest y on y.key < x.key and round(list_cosine_similarity(x.v, y.v), 6) >= 0.82),
todo as (select key, row_number() over (order by key) as nth, coalesce((select list(r) from pairs where l = key), []) as before from rest),
made(nth, makers) as (select 0::bigint, []::bigint[] union all select t.nth, case when list_has_any(makers, before) then makers else list_append(makers, key) end from made join todo t on t.nth = made.nth + 1),
final as (select makers from made order by nth desc limit 1),
al as (select l as key, r as node, sim from (select *, row_number() over (partition by l order by sim desc, r) as x from pairs, final where list_contains(makers, r) and not list_contains(makers, l)) where x = 1)
select m.key, coalesce(k.node, al.node, m.key) as node, coalesce(k.sim, al.sim, 1.0) as sim, k.key is null and al.key is null as is_new from m left join k on k.key = m.key left join al on al.key = m.key"""
)
def graph_resolved_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity resolution at 0.82: every vector is mentioned twice, blended with others to different degrees; every third vector
    is a known node, the rest become nodes as they are first mentioned."""
    rows = _vectors(spark, sf_dir)
    b = rows.toDF("other", "vb")
    twice = rows.withColumn("j", F.explode(F.array(F.lit(0), F.lit(1)))).join(b, F.col("key") + 1 + F.col("j") == F.col("other"))
    said = twice.select((2 * F.col("key") + F.col("j")).alias("mention"), "vector", "vb", (F.lit(0.2) * ((F.col("key") + 3 * F.col("j")) % 6)).alias("share"))
    mentions = vectors.written(said.select(F.col("mention").alias("key"), vectors.blended(F.col("vector"), F.col("vb"), F.col("share")).alias("vector")), "mentions")
    return vectors.resolved(mentions, rows.filter("key % 3 = 0"))
