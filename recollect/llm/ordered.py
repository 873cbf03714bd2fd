"""Rows in order of an id, dealt by ranges, each range with the first row of the next one: one shuffle, no global sort in a task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOWEST = -(1 << 63)
#: More rows make larger ranges, not more of them; a range is sorted with spilling and read as a stream.
MOST_RANGES = 1 << 14
BYTES_EACH = 1 << 26


def ranges(df: DataFrame, id_col: str, rows_each: int, text_col: str, bytes_each: int = BYTES_EACH) -> list[int]:
    """Lower bounds of id ranges of about rows_each rows, and fewer where texts are long, so that a range has about
    bytes_each of them; only ids and lengths are read, only the bounds come to the driver."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long")), F.lit(0))).first()
    parts = max(1, min(MOST_RANGES, max(-(-n // rows_each), -(-size // bytes_each))))
    if n == 0 or parts == 1:
        return []
    cuts = df.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], 10 * parts)).first()[0]
    return sorted(set(cuts))


def place_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are not above key: first among every step-th bound, then inside that step."""
    longs = lambda values: F.array(*[F.lit(v) for v in values]).cast("array<bigint>")
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    block = F.size(F.filter(longs([b[0] for b in blocks]), lambda b: b <= key))
    inside = F.size(F.filter(F.element_at(F.array(*[longs(b) for b in blocks]), F.greatest(block, F.lit(1))), lambda b: b <= key))
    return F.when(block == 0, 0).otherwise((block - 1) * step + inside)


def dealt(df: DataFrame, id_col: str, text_col: str, rows_each: int = 20_000, ahead: bool = False) -> DataFrame:
    """(range int, ahead int, id long, text string), partitioned by range, sorted by ahead, id (null first) and text.

    With ahead, each range also ends with a copy (ahead = 1) of the first rows of the next range that has rows,
    the last range with those of the first one."""
    bounds = ranges(df, id_col, rows_each, text_col)
    n = len(bounds) + 1
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST))
    place = place_of(F.col("key"), bounds)
    rows = df.select(key.alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("range", place)
    if ahead:
        firsts = df.select(key.alias("key")).withColumn("range", place).groupBy("range").agg(F.min("key")).collect()
        first = dict(sorted((r[0], r[1]) for r in firsts))
        order = list(first)
        before = dict(zip(order, order[-1:] + order[:-1], strict=True))
        own = F.struct(F.col("range").alias("range"), F.lit(0).alias("ahead"))
        at = lambda values: F.element_at(F.array(*[F.lit(values.get(i)) for i in range(n)]), F.col("range") + 1)
        copy = F.struct(at(before).cast("int").alias("range"), F.lit(1).alias("ahead"))
        places = F.when(F.col("key") == at(first), F.array(own, copy)).otherwise(F.array(own)) if first else F.array(own)
        rows = rows.withColumn("place", F.explode(places)).select("place.range", "place.ahead", "key", "id", "text")
    else:
        rows = rows.withColumn("ahead", F.lit(0))
    return rows.select("range", "ahead", "key", "id", "text").repartitionById(n, F.col("range")).sortWithinPartitions("range", "ahead", "key", "text").select("range", "ahead", "id", "text")
