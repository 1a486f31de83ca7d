"""Ordinals and scans over a whole table, or over the rows of each key, without a window that holds a whole table or key.

A scan of one key's rows deals them out by range of (key, order). Each range works by itself, and a summary row for each range and key (its
number of rows, its first and last) says what the ranges before and behind hold. Only keys that lie in several ranges need that: at most two for each
range, so the summaries that go back are broadcast whatever the number of keys, and a key of all rows has as many tasks as ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwork.plans.lineage import cut


def global_ordinal(df: DataFrame, order: list[Column], name: str = "ordinal") -> DataFrame:
    """df with its rank (from 1) in the order, which must be total. Rows are dealt out by range; each range is numbered by itself
    and moved on by the number of rows in the ranges before it. Only those counts, one for each range, are gathered."""
    columns = df.columns
    dealt = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()), "ordinal")
    counts = dealt.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect()
    starts, total = [], 0
    for r in counts:
        starts.append((r["__range"], total))
        total += r["n"]
    offsets = F.broadcast(df.sparkSession.createDataFrame(starts, "__range int, __start long"))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.join(offsets, "__range").withColumn(name, F.col("__start") + rank).select(*columns, name)


def in_ranges(df: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """df dealt out by range of (by, order), written, with __range. The order must be total among the rows of a key."""
    return cut(df.repartitionByRange(F.col(by), *order).withColumn("__range", F.spark_partition_id()), "ranges")


def in_range(by: str, order: list[Column]):
    """The window over a key's rows within one range."""
    return Window.partitionBy("__range", by).orderBy(*order)


def with_neighbours(rows: DataFrame, by: str, summaries: dict[str, Column], *carried: dict[str, Column]) -> DataFrame:
    """rows (with __range) and, from the summaries of each range and key, what is carried to each range: expressions over the summaries' names,
    or what was carried before, and the windows earlier(), later() and each_range(). A key that lies in one range gets nulls."""
    each = rows.groupBy("__range", by).agg(*[v.alias(k) for k, v in summaries.items()])
    several = each.withColumn("__ranges", F.count("*").over(Window.partitionBy(by))).filter("__ranges > 1")  # a row for each range of a key
    for more in carried:
        several = several.withColumns(more)
    names = [k for more in carried for k in more]
    found = cut(several.select(F.col("__range").alias("__r"), F.col(by).alias("__k"), *names), "carried")  # two rows for each range at most
    return rows.join(F.broadcast(found), (F.col("__range") == F.col("__r")) & F.col(by).eqNullSafe(F.col("__k")), "left").drop("__r", "__k")


def each_range(by: str):
    return Window.partitionBy(by).orderBy("__range")


def earlier(by: str):
    """The ranges of a key before this one, in order."""
    return each_range(by).rowsBetween(Window.unboundedPreceding, -1)


def later(by: str):
    return each_range(by).rowsBetween(1, Window.unboundedFollowing)


def ordinal_in(df: DataFrame, by: str, order: list[Column], name: str = "rank") -> DataFrame:
    """df with each row's rank (from 1) among those of its key."""
    columns = df.columns
    rows = in_ranges(df, by, order).withColumn(name, F.row_number().over(in_range(by, order)))
    rows = with_neighbours(rows, by, {"__n": F.count("*")}, {"__before": F.sum("__n").over(earlier(by))})
    return rows.withColumn(name, (F.col(name) + F.coalesce("__before", F.lit(0))).cast("int")).select(*[x for x in columns if x != name], name)
