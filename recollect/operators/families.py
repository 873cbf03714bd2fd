"""Slot families: near-duplicate and same-role keys, and the read-time preference for the newest value.

The pair tests are column predicates on blocked self-joins. What depends on order, who joins which group, runs over the
numbers of one request's or namespace's pairs; all else are joins and windows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions import constants as C
from recollect.functions import text as X
from recollect.sources.scratch import small_side, written

NS = "namespace"
BROADCAST_KINDS = 200_000


# --- Column predicates -------------------------------------------------------------------------------------------


def slots_conflict(a: Column, b: Column) -> Column:
    """Token sets with different numbers, or different words of one dimension."""
    digits = lambda t: F.array_sort(F.filter(t, lambda w: w.rlike("^[0-9]+$")))
    out = (F.size(digits(a)) > 0) & (F.size(digits(b)) > 0) & (digits(a) != digits(b))
    for dimension in C.SLOT_DIMENSIONS:
        own = lambda t, d=dimension: F.array_sort(F.array_intersect(t, X.words(d)))
        out = out | ((F.size(own(a)) > 0) & (F.size(own(b)) > 0) & (own(a) != own(b)))
    return out


def near_duplicate_keys(a: Column, b: Column) -> Column:
    """Equal keys, or no conflict, two shared words or more and two thirds of the smaller set."""
    ta, tb = X.slot_tokens(a), X.slot_tokens(b)
    shared = F.size(F.array_intersect(ta, tb))
    near = ~slots_conflict(ta, tb) & (shared >= 2) & (3 * shared >= 2 * F.least(F.size(ta), F.size(tb)))
    return F.when(X.blank(a) | X.blank(b), False).when(a == b, True).otherwise(near)


def common_role(a: Column, b: Column) -> Column:
    """Common roles (or none) and a common subject word."""
    ra, rb = X.slot_roles(X.slot_tokens(a)), X.slot_roles(X.slot_tokens(b))
    roles = ((F.size(ra) == 0) & (F.size(rb) == 0)) | F.arrays_overlap(ra, rb)
    return F.coalesce(roles & F.arrays_overlap(X.subject_anchors(a), X.subject_anchors(b)), F.lit(False))


def near_duplicate_entries(a: Column, va: Column, b: Column, vb: Column) -> Column:
    """Near-duplicate keys with common roles (or none), a common subject word, and values of one shape, numeric or scalar."""
    shape = X.value_shape(va)
    return F.coalesce(near_duplicate_keys(a, b) & ((a == b) | (common_role(a, b) & (shape == X.value_shape(vb)) & shape.isin("numeric", "scalar"))), F.lit(False))


def opposite_roles(a: Column, b: Column) -> Column:
    out = F.lit(False)
    for left, right in C.ROLE_OPPOSITES:
        on = lambda t, side: F.arrays_overlap(t, X.words(side))
        out = out | (on(a, left) & on(b, right)) | (on(a, right) & on(b, left))
    return out


def same_role(a: Column, b: Column) -> Column:
    """A shared subject word, no opposite roles, and one token set within the other or a shared word besides, unless both subjects keep names of their own."""
    sa, sb = X.identity_tokens(X.subject_part(a)), X.identity_tokens(X.subject_part(b))
    ta, tb = F.array_union(sa, X.identity_tokens(X.attribute_part(a))), F.array_union(sb, X.identity_tokens(X.attribute_part(b)))
    shared = F.array_intersect(sa, sb)
    within = (F.size(F.array_except(ta, tb)) == 0) | (F.size(F.array_except(tb, ta)) == 0)
    role = F.size(F.array_except(F.array_intersect(ta, tb), shared)) > 0
    named = (F.size(F.array_except(sa, tb)) > 0) & (F.size(F.array_except(sb, ta)) > 0)
    return F.coalesce((F.size(ta) > 0) & (F.size(tb) > 0) & ~opposite_roles(ta, tb) & (F.size(shared) > 0) & (within | (role & ~named)), F.lit(False))


# --- Blocked pair joins ------------------------------------------------------------------------------------------


def blocked_pairs(keys: DataFrame, tokens: Column, key: str = "slot_key") -> DataFrame:
    """(namespace, a, b): pairs of different keys of a namespace, a < b, that share one of the tokens."""
    one = keys.select(NS, key).distinct().select(NS, F.col(key), F.explode(tokens).alias("token"))
    a, b = one.select(NS, "token", F.col(key).alias("a")), one.select(NS, "token", F.col(key).alias("b"))
    return a.join(b, [NS, "token"]).filter("a < b").select(NS, "a", "b").distinct()


def same_role_pairs(keys: DataFrame) -> DataFrame:
    return blocked_pairs(keys, X.identity_tokens(X.subject_part(F.col("slot_key")))).filter(same_role(F.col("a"), F.col("b")))


def near_duplicate_pairs(keys: DataFrame) -> DataFrame:
    return blocked_pairs(keys, X.slot_tokens(F.col("slot_key"))).filter(near_duplicate_keys(F.col("a"), F.col("b")))


# --- Groups ------------------------------------------------------------------------------------------------------


def near_items(items: DataFrame, by: str, tokens: Column, near: Callable[[Column, Column], Column]) -> DataFrame:
    """(by, early, late, word): pairs of items (by, place, slot_key) of one by, early < late, that share one of the tokens
    (word, the first of them) and are near by their keys. Each pair of keys that meets is judged once, for all that have it."""
    one = items.select(by, "place", "slot_key", F.explode(tokens).alias("token"))
    side = lambda p: one.select(by, "token", F.col("place").alias(p), F.col("slot_key").alias(f"{p}_key"))
    met = side("early").join(side("late"), [by, "token"]).filter("early < late")
    named = written(met.groupBy(by, "early", "late", "early_key", "late_key").agg(F.min("token").alias("word")), "met")
    judged = written(named.select("early_key", "late_key").distinct().filter(near(F.col("early_key"), F.col("late_key"))), "judged")
    return named.join(small_side(judged, BROADCAST_KINDS), ["early_key", "late_key"]).select(by, "early", "late", "word")


class Crowd:
    """Places that are all near to each other, and the places that are near to all of them."""

    def __init__(self, place: int, friends: set[int]):
        self.places, self.welcome = [place], friends

    def take(self, other: Crowd) -> None:
        self.places += other.places
        self.welcome = self.welcome & other.welcome


def by_guarded_union(pairs: list[tuple[int, int, str]], friends: dict[int, set[int]]) -> dict[int, int]:
    """Crowds meet where a pair does, by the later place, then the word, then the earlier place, and join only if all are
    near to all."""
    home = {p: Crowd(p, friends[p]) for p in friends}
    for early, late, _ in sorted(pairs, key=lambda x: (x[1], x[2], x[0])):
        host, guest = home[early], home[late]
        if host is not guest and host.welcome.issuperset(guest.places):
            host.take(guest)
            home |= dict.fromkeys(guest.places, host)
    return {p: min(c.places) for p, c in home.items()}


def by_first_welcome(pairs: list[tuple[int, int, str]], friends: dict[int, set[int]]) -> dict[int, int]:
    """Places join, in order, the first crowd that they are welcome in, or begin one."""
    crowds: list[Crowd] = []
    for p in sorted(friends):
        host = next((c for c in crowds if p in c.welcome), None)
        crowds.append(Crowd(p, friends[p])) if host is None else host.take(Crowd(p, friends[p]))
    return {p: c.places[0] for c in crowds for p in c.places}


def grouped(pairs: DataFrame, by: str, rule: Callable[[list[tuple[int, int, str]], dict[int, set[int]]], dict[int, int]]) -> DataFrame:
    """(by, place, family): places of pairs in groups of two or more by the rule; family is the group's first place.

    Only the pairs of one request or namespace meet, as one row of numbers; what is near was decided by expressions before.
    Rows come in batches, so that many small groups cost no table each."""

    def run(batches):
        for batch in batches:
            names, places, families = [], [], []
            for name, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                friends: dict[int, set[int]] = {}
                for p in own:
                    for x in (p["early"], p["late"]):
                        friends.setdefault(x, {x}).update((p["early"], p["late"]))
                found = rule([(p["early"], p["late"], p["word"]) for p in own], friends)
                size = Counter(found.values())
                kept = [(x, f) for x, f in found.items() if size[f] > 1]
                names += [name] * len(kept)
                places += [x for x, _ in kept]
                families += [f for _, f in kept]
            yield pa.RecordBatch.from_arrays([pa.array(names, batch.schema.field(0).type), pa.array(places, pa.int64()), pa.array(families, pa.int64())], [by, "place", "family"])

    rows = pairs.groupBy(by).agg(F.collect_list(F.struct(F.col("early").cast("long").alias("early"), F.col("late").cast("long").alias("late"), "word")).alias("pairs"))
    return rows.mapInArrow(run, f"{by} {dict(pairs.dtypes)[by]}, place long, family long")


def role_groups(items: DataFrame, by: str) -> DataFrame:
    """(by, place, family) of items (by, place, slot_key, slot_value): groups of the same role, by guarded union."""
    return grouped(near_items(items, by, X.identity_tokens(X.subject_part(F.col("slot_key"))), same_role), by, by_guarded_union)


def near_kinds(kinds: DataFrame) -> DataFrame:
    """(early_key, early_shape, late_key, late_shape): kinds of items (slot_key, shape of the value) that are near, both ways."""
    keys = kinds.select("slot_key").distinct()
    one = keys.select("slot_key", F.explode(F.array_union(X.slot_tokens(F.col("slot_key")), F.array("slot_key"))).alias("token"))
    met = one.select("token", F.col("slot_key").alias("early_key")).join(one.select("token", F.col("slot_key").alias("late_key")), "token").groupBy("early_key", "late_key").agg(F.count("*").alias("shared"))
    a, b = F.col("early_key"), F.col("late_key")
    near = written(met.filter((a == b) | (F.col("shared") >= 2)).filter(near_duplicate_keys(a, b)).select("early_key", "late_key", common_role(a, b).alias("common")), "near-keys")
    shapes = lambda p: kinds.select(F.col("slot_key").alias(f"{p}_key"), F.col("shape").alias(f"{p}_shape"))
    alike = (a == b) | (F.col("common") & (F.col("early_shape") == F.col("late_shape")) & F.col("early_shape").isin("numeric", "scalar"))
    return written(near.join(shapes("early"), "early_key").join(shapes("late"), "late_key").filter(alike).select("early_key", "early_shape", "late_key", "late_shape"), "near-kinds")


def slot_families(items: DataFrame, by: str, asked: DataFrame) -> DataFrame:
    """(by, place, family, anchors) of items in order of place: near-duplicate entries whose common subject words (anchors)
    have one in the by's question; asked is (by, query)."""
    own = items.withColumn("shape", X.value_shape(F.coalesce("slot_value", F.lit("")))).filter(~X.blank(F.col("slot_key"))).select(by, "place", "slot_key", "shape")
    # Whether two items are near is decided by their keys and the shapes of their values, so items with the same of both, which
    # are near to each other and to the same others, go as one, by the first of them; pairs of keys are judged once for all.
    kinds = own.groupBy(by, "slot_key", "shape").agg(F.min("place").alias("place"))
    near = near_kinds(own.select("slot_key", "shape").distinct())
    side = lambda p: kinds.select(by, F.col("place").alias(p), F.col("slot_key").alias(f"{p}_key"), F.col("shape").alias(f"{p}_shape"))
    first, second = side("early"), side("late")
    met = first.join(small_side(near, BROADCAST_KINDS), ["early_key", "early_shape"]).join(second, [by, "late_key", "late_shape"]).filter("early < late")
    dealt = grouped(met.select(by, "early", "late", F.lit("").alias("word")), by, by_first_welcome)
    homes = kinds.join(dealt, [by, "place"], "left").select(by, "slot_key", "shape", F.coalesce("family", "place").alias("family"))
    found = own.join(homes, [by, "slot_key", "shape"]).withColumn("n", F.count("*").over(W.partitionBy(by, "family"))).filter("n > 1").select(by, "place", "family", "slot_key")
    words = found.select(by, "family", "slot_key").distinct().select(by, "family", X.subject_anchors(F.col("slot_key")).alias("own")).groupBy(by, "family").agg(F.collect_list("own").alias("all"))
    anchored = words.select(by, "family", F.aggregate("all", F.element_at("all", 1), lambda kept, x: F.array_intersect(kept, x)).alias("anchors"))
    wanted = anchored.join(asked.select(by, X.slot_tokens(F.col("query")).alias("asked")), by).filter(F.arrays_overlap("anchors", "asked")).drop("asked")
    return found.drop("slot_key").join(wanted, [by, "family"])


# --- Read-time preference ----------------------------------------------------------------------------------------

NEWEST = "Most recent value, in place of earlier ones: "
_ITEM = ["query_id", "kind", "item_seq"]


def _squeezed(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def _mentions(text: Column, value: Column) -> Column:
    """A number as a word of its own, other values of three characters or more anywhere."""
    return F.when(value.rlike("^[0-9]+$"), X.holds_value(text, value)).otherwise((F.length(value) >= 3) & F.contains(text, value))


def _families(entries: DataFrame, scored: DataFrame, scope: str) -> DataFrame:
    """entries with family (and anchors) where they are in one."""
    order = [F.col("item_seq")] if scope == "role" else [F.col("score").desc(), F.col("turn_id").desc(), F.col("item_seq")]
    placed = written(entries.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(*order)).cast("long")), "placed")
    found = role_groups(placed, "query_id").withColumn("anchors", F.array().cast("array<string>")) if scope == "role" else slot_families(placed, "query_id", scored.select("query_id", "query").distinct())
    return placed.join(found, ["query_id", "place"])


def prefer_newest(scored: DataFrame, scope: str = "role") -> DataFrame:
    """scored candidates with, for each request, the newest active fact of a family in place of all of it.

    The newest (by turn, then text) gets the family's best score and a note before its text. scope role groups by same
    role; scope cross_key by slot family, and also drops summaries that mention a displaced value and a common subject
    word; it is known to merge what it should not and is off by default."""
    scored = written(scored, "scored")
    entries = scored.filter((F.col("kind") == "entry") & (F.col("status") == "active") & ~X.blank(F.col("slot_key")))
    family = W.partitionBy("query_id", "family")
    ranked = _families(entries, scored, scope).withColumn("rank", F.row_number().over(family.orderBy(F.col("turn_id").desc(), F.col("text").desc(), "item_seq"))).withColumn("best", F.max("score").over(family))
    marks = ranked.select(*_ITEM, (F.col("rank") == 1).alias("newest"), "best")
    out = scored.join(marks, _ITEM, "left").filter(F.coalesce("newest", F.lit(True)))
    if scope != "role":
        now = F.max(F.when(F.col("rank") == 1, _squeezed(F.col("slot_value")))).over(family)
        old = ranked.withColumn("now", now).withColumn("was", _squeezed(F.col("slot_value"))).filter("rank > 1 and was <> '' and was <> now").groupBy("query_id").agg(F.collect_set(F.struct("was", "anchors")).alias("displaced"))
        words, told = X.slot_tokens(F.col("text")), _squeezed(F.col("text"))
        tells = F.exists("displaced", lambda d: _mentions(told, d["was"]) & F.arrays_overlap(words, d["anchors"]))
        out = out.join(old, "query_id", "left").filter((F.col("kind") != "summary") | ~F.coalesce(tells, F.lit(False)))
    shown = F.col("newest").isNotNull()
    changed = {"score": F.coalesce("best", "score"), "text": F.when(shown, F.concat(F.lit(NEWEST), "text")).otherwise(F.col("text")), "cost": F.col("cost") + F.when(shown, len(NEWEST) // 4).otherwise(0)}
    return out.select(*[changed[c].cast(kind).alias(c) if c in changed else F.col(c) for c, kind in scored.dtypes])


def sequence_texts(scored: DataFrame) -> DataFrame:
    """scored candidates with, for each family of a request, the latest fact's text told as a sequence: from the first value for a change, from the one before for a previous value. Requests of other modes
    are left alone."""
    scored = written(scored, "scored")
    member = _families(scored.filter("kind = 'entry'"), scored, "cross_key")
    told = member.groupBy("query_id", "family").agg(F.array_sort(F.collect_list(F.struct("turn_id", "item_seq", "slot_value"))).alias("all"), F.first("query").alias("query"))
    mode = X.question_mode(F.col("query"))
    previous = mode == "previous"
    ends = told.filter(mode.isin("previous", "change")).select("query_id", F.element_at("all", F.when(previous, F.lit(-2)).otherwise(F.lit(1))).alias("from"), F.element_at("all", -1).alias("to"), previous.alias("previous"))
    name = F.when(F.col("previous"), "Before and now").otherwise("From first to latest")
    note = F.concat(name, F.lit(": "), "from.slot_value", F.lit(" at turn "), F.col("from.turn_id").cast("string"), F.lit(", then "), "to.slot_value", F.lit(" at turn "), F.col("to.turn_id").cast("string"), F.lit(". "))
    notes = ends.filter("from.slot_value <> to.slot_value").select("query_id", F.lit("entry").alias("kind"), F.col("to.item_seq").alias("item_seq"), note.alias("note"))
    changed = {"text": F.concat(F.coalesce("note", F.lit("")), "text"), "cost": F.col("cost") + F.coalesce(F.floor(F.length("note") / 4), F.lit(0))}
    return scored.join(notes, _ITEM, "left").select(*[changed[c].cast(kind).alias(c) if c in changed else F.col(c) for c, kind in scored.dtypes])


def grouped_by_role(keys: DataFrame) -> DataFrame:
    """(namespace, slot_key, role_group): keys (namespace, seq, slot_key) with the smallest key of their group, groups by guarded union in the order of seq."""
    first = keys.filter(~X.blank(F.col("slot_key"))).groupBy(NS, "slot_key").agg(F.min("seq").alias("seq"))
    placed = first.withColumn("place", F.row_number().over(W.partitionBy(NS).orderBy("seq", "slot_key")).cast("long")).withColumn("slot_value", F.lit(None).cast("string"))
    named = placed.join(role_groups(placed, NS), [NS, "place"], "left").withColumn("family", F.coalesce("family", "place"))
    return named.select(NS, "slot_key", F.min("slot_key").over(W.partitionBy(NS, "family")).alias("role_group"))
