"""Joins beyond equality: nearest in time, containment, fallback levels, paths, dominance; and checked joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import stored


def nearest_asof(left: DataFrame, right: DataFrame, on: list[str], left_id: str, right_id: str, time: str = "ts") -> DataFrame:
    """left with right_id and gap_sec of the nearest row of right in time, either way; ties go to the earlier time, then the
    smaller id. An unmatched row has a null id and an infinite gap.

    Both sides are one sorted stream by key: the last right row before and the first after each left row are two window
    values, so no pair is made but the two that can win.
    """
    l = left.select(*on, F.col(time).alias("_t"), F.col(left_id).alias("_l"), F.lit(None).cast(right.schema[right_id].dataType).alias("_r"))
    r = right.groupBy(*on, F.col(time).alias("_t")).agg(F.min(right_id).alias("_r")).select(*on, "_t", F.lit(None).cast(left.schema[left_id].dataType).alias("_l"), "_r")
    rows = l.unionByName(r).withColumn("_hit", F.when(F.col("_r").isNotNull(), F.struct(F.col("_t").alias("t"), F.col("_r").alias("r"))))
    order = Window.partitionBy(*on).orderBy("_t")
    before = F.last("_hit", True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("_hit", True).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    near = rows.withColumn("_b", before).withColumn("_a", after).where("_l IS NOT NULL")
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    gap = lambda side: F.abs(micros(F.col("_t")) - micros(F.col(side)["t"])) / 1e6
    take_after = F.col("_b").isNull() | (gap("_a") < gap("_b"))
    pick = F.when(take_after, F.col("_a")).otherwise(F.col("_b"))
    return near.select(F.col("_l").alias(left_id), *on, F.col("_t").alias(time), pick["r"].alias(right_id), F.coalesce(F.when(take_after, gap("_a")).otherwise(gap("_b")), F.lit(float("inf"))).alias("gap_sec"))


def tolerance_flags(df: DataFrame, gap: str, seconds: list[int]) -> DataFrame:
    return df.withColumns({f"join_ok_{s}s": F.coalesce(F.col(gap) <= s, F.lit(False)) for s in seconds})


def within_interval(points: DataFrame, spans: DataFrame, on: list[str], at: str, start: str, end: str) -> DataFrame:
    """Pairs of a point and a span of its key that holds it, ends included; nulls hold nothing."""
    return points.join(spans, on).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end)))


def range_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Pairs of a point and a span that holds it, without an equal key: spans are listed under each cell of `width` that
    they touch, so points meet spans of their cell alone. For whole numbers; take a width near the usual span's length."""
    cell = lambda c: F.floor(c / F.lit(width))
    cells = spans.where(F.col(start) <= F.col(end)).withColumn("_cell", F.explode(F.sequence(cell(F.col(start)), cell(F.col(end)))))
    return points.withColumn("_cell", cell(F.col(at))).join(cells, "_cell").where(F.col(at).between(F.col(start), F.col(end))).drop("_cell")


def checked_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """A join that fails where a side said to be unique on the keys isn't."""
    sides = {"one_to_one": (left, right), "one_to_many": (left,), "many_to_one": (right,)}[validate]
    for side in sides:
        if side.groupBy(*on).count().where("count > 1").limit(1).count():
            raise ValueError(f"keys {on} aren't unique as {validate} needs")
    return left.join(right, on, how)


def _first_by_hash(left: DataFrame, own: DataFrame, on: list[str], left_id: str, seed: str, differ: Column | None, expect: int = 32) -> DataFrame:
    """left_id, b: of the right rows that agree in `on`, the least (hash, id) of each left row.

    Every pair is hashed, but only hashes so small that a left row has about `expect` of them are rows that are dealt out;
    left rows without any such meet their group again without the bound.
    """
    from .facets import seeded

    sizes = own.groupBy(*on).agg(F.count("*").alias("_n"))
    least = F.when(F.col("_n") > expect, F.lpad(F.lower(F.hex(F.floor(F.lit(float(expect * 16**15)) / F.col("_n")).cast("long"))), 15, "0")).otherwise("g")
    wide = left.join(sizes, on).withColumn("_least", least).drop("_n")
    met = wide.join(own, on).where(F.col(left_id) != F.col("_right") if differ is None else differ)
    h = seeded(seed, left_id, "_right")
    first = lambda pairs: pairs.groupBy(left_id).agg(F.min(F.struct(h.alias("h"), F.col("_right").alias("r"))).alias("b"))
    some = stored(first(met.where(h < F.col("_least"))), "hashes")
    short = wide.where(F.col("_least") < "g").join(some.select(left_id), left_id, "left_anti").drop("_least")
    if not short.limit(1).count():
        return some
    return some.unionByName(first(short.join(own, on).where(F.col(left_id) != F.col("_right") if differ is None else differ)))


def fallback_match(left: DataFrame, right: DataFrame, left_id: str, right_id: str, levels: list[list[str]], seed: str, differ: Column | None = None) -> DataFrame:
    """left_id, right_id, level: for each left row a right row that agrees with it on the first level of columns that any
    right row does, the least by a hash of both ids.

    Each level is an equi-join of what earlier levels left over. An empty level meets the right rows in blocks, by a hash of
    the right id alone: the first block is small, and only left rows that find none there meet the next, four times as large.
    """
    from .facets import seeded

    rest, parts = left, []
    for n, on in enumerate(levels):
        own = right.select(F.col(right_id).alias("_right"), *[F.col(c) for c in on])
        ordered, start, size, total = own.orderBy(seeded(seed, "_right"), "_right"), 0, 16, 0 if on else own.count()
        while True:
            met = rest.select(F.col(left_id), *on).join(own, on) if on else rest.select(left_id).crossJoin(ordered.offset(start).limit(size))
            met = met.where(F.col(left_id) != F.col("_right") if differ is None else differ)
            best = met.groupBy(left_id).agg(F.min(F.struct(seeded(seed, left_id, "_right").alias("h"), F.col("_right").alias("r"))).alias("b"))
            if on:
                best = stored(_first_by_hash(rest.select(F.col(left_id), *on), own, on, left_id, seed, differ), "level")
            parts.append(best.select(left_id, F.col("b.r").alias(right_id), F.lit(n).alias("level")))
            rest = rest.join(parts[-1].select(left_id), left_id, "left_anti")
            start, size = start + size, 4 * size
            if on or start >= total or not rest.limit(1).count():
                break
    return reduce(DataFrame.unionByName, parts)


def two_hop(edges_a: DataFrame, edges_b: DataFrame) -> DataFrame:
    """head, mid, tail of paths over (head, mid) and (mid, tail)."""
    return edges_a.join(edges_b, "mid").select("head", "mid", "tail").distinct()


def pareto(df: DataFrame, by: list[str], up: list[str], down: list[str]) -> DataFrame:
    """Rows that no row of their group dominates: as good in all, better in one; ties stay.

    Rows with equal objectives are one, so that the join compares distinct points of a group alone.
    """
    goals = [*up, *down]
    points = df.select(*by, *goals).distinct()
    a, b = points.alias("a"), points.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in by]
    ge = [F.col(f"b.{c}") >= F.col(f"a.{c}") for c in up] + [F.col(f"b.{c}") <= F.col(f"a.{c}") for c in down]
    gt = [F.col(f"b.{c}") > F.col(f"a.{c}") for c in up] + [F.col(f"b.{c}") < F.col(f"a.{c}") for c in down]
    every = lambda xs: reduce(lambda x, y: x & y, xs)
    front = a.join(b, every([*same, *ge, reduce(lambda x, y: x | y, gt)]), "left_anti")
    return df.join(front.select(*[F.col(f"a.{c}") for c in [*by, *goals]]), [*by, *goals], "left_semi")
