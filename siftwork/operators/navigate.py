"""Neighbours in a circular order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import order

def _ends(by: str):
    return order.each_range(by).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def next_previous(ranked: DataFrame, by: str = "project_id") -> DataFrame:
    """ranked(by, rank, image_id) with next_id and previous_id, around the ends."""
    columns = ranked.columns
    rows = order.in_ranges(ranked, by, [F.asc("rank")])
    w = order.in_range(by, [F.asc("rank")])
    rows = rows.withColumns({"__next": F.lead("image_id").over(w), "__previous": F.lag("image_id").over(w)})
    ends = {"__first": F.min_by("image_id", "rank"), "__last": F.max_by("image_id", "rank")}
    carried = {
        "__after": F.coalesce(F.lead("__first").over(order.each_range(by)), F.first("__first").over(_ends(by))),
        "__before": F.coalesce(F.lag("__last").over(order.each_range(by)), F.last("__last").over(_ends(by))),
    }
    rows = order.with_neighbours(rows, by, ends, carried)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select(*columns, F.coalesce("__next", "__after", F.first("image_id").over(whole)).alias("next_id"), F.coalesce("__previous", "__before", F.last("image_id").over(whole)).alias("previous_id"))


def next_untagged(ranked: DataFrame, tagged: DataFrame, by: str = "project_id") -> DataFrame:
    """next_untagged: the next row without a tag, one lap at most and the row itself last; null if all are tagged."""
    columns = ranked.columns
    flags = ranked.join(tagged.select("image_id").distinct().withColumn("__tagged", F.lit(True)), "image_id", "left")
    rows = order.in_ranges(flags.withColumn("__free", F.when(F.col("__tagged").isNull(), F.col("image_id"))), by, [F.asc("rank")])
    # the last one of those after the row, from behind: frames that start at the partition's start are read once
    behind = order.in_range(by, [F.desc("rank")]).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__after", F.last("__free", ignorenulls=True).over(behind))
    head = {"__head": F.min_by("__free", F.when(F.col("__free").isNotNull(), F.col("rank")))}
    # none behind the row in its range: the first of the ranges behind, or else of the whole circle, which then isn't behind the row
    carried = {"__later": F.first("__head", ignorenulls=True).over(order.later(by)), "__first": F.first("__head", ignorenulls=True).over(_ends(by))}
    rows = order.with_neighbours(rows, by, head, carried)
    own = F.first("__free", ignorenulls=True).over(order.in_range(by, [F.asc("rank")]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select(*columns, F.coalesce("__after", "__later", "__first", own).alias("next_untagged"))


def neighbourhood(ranked: DataFrame, width: int, by: str = "project_id") -> DataFrame:
    """by, image_id, priority, neighbour: 0, +1, -1, +2, -2... around the circle, each neighbour once."""
    n = ranked.groupBy(by).agg(F.count("*").alias("n"))
    steps = F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(s).alias("step")) for i, s in enumerate([0] + [s for k in range(1, width + 1) for s in (k, -k)])])
    wanted = ranked.join(n, by).select(by, "image_id", "rank", "n", F.explode(steps).alias("x"))
    wanted = wanted.select(by, "image_id", F.col("x.priority").alias("priority"), (F.pmod(F.col("rank") - 1 + F.col("x.step"), F.col("n")) + 1).alias("rank"))
    wanted = wanted.groupBy(by, "image_id", "rank").agg(F.min("priority").alias("priority"))
    return wanted.join(ranked.select(by, "rank", F.col("image_id").alias("neighbour")), [by, "rank"]).select(by, "image_id", "priority", "neighbour")
