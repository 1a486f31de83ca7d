"""Choosing a delivered set: sizes, orders, diversity and cleaning of a selector's answer."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.plans.lineage import cut

from .order import ordinal_in


def preselection_size(multiple: float, count: int, candidates: int) -> int:
    """min(ceil(max(1.5, multiple) * count), candidates); 0 if count or candidates is none."""
    if count <= 0 or candidates <= 0:
        return 0
    return min(math.ceil(max(1.5, multiple) * count), candidates)


def clean_selection(picks: list, pool: int, count: int) -> list[int]:
    """The selector's 1-based picks: those outside the pool and repeats go, order stays; fewer than count means none."""
    kept = list(dict.fromkeys(p for p in picks if isinstance(p, int) and not isinstance(p, bool) and 1 <= p <= pool))
    return kept[:count] if len(kept) >= count else []


def clean_selection_rows(picks: DataFrame, count: int) -> DataFrame:
    """The same over rows (key, ordinal, pick, pool): key, rank, pick."""
    ok = picks.filter("pick between 1 and pool").groupBy("key", "pick").agg(F.min("ordinal").alias("ordinal"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("ordinal"))
    total = F.count("*").over(Window.partitionBy("key"))
    return ok.withColumn("rank", rank).withColumn("__n", total).filter((F.col("rank") <= count) & (F.col("__n") >= count)).select("key", "rank", "pick")


def delivery_rank(items: DataFrame, by: str = "project_id", id_col: str = "image_id") -> DataFrame:
    """rank by captured_at descending, nulls last, then id."""
    return ordinal_in(items, by, [F.desc_nulls_last("captured_at"), F.asc(id_col)])


def browse_rank(items: DataFrame, by: str = "project_id") -> DataFrame:
    """rank by captured_at descending, nulls last, then file_path."""
    return ordinal_in(items, by, [F.desc_nulls_last("captured_at"), F.asc("file_path"), F.asc("image_id")])


#: Rounds of the farthest-point choice between two lineage cuts.
CUT_EVERY = 4


def diverse_top(candidates: DataFrame, count: int, by: str = "project_id", id_col: str = "winner") -> DataFrame:
    """by, ordinal, id: `count` candidates of each project, the latest first, then whichever is farthest in time from all chosen; ties
    go to the smaller id. Those without a time come only when no timed one is left, by id. A round is one aggregation over all
    projects with what is chosen so far, `count` values for a project at most, joined to its candidates; no project is one group."""
    count = max(count, 0)
    slim = cut(candidates.select(by, F.col(id_col).cast("long").alias("id"), F.col("captured_at").cast("long").alias("t")), "diverse")
    timed = slim.filter("t is not null")
    last = F.max_by(F.struct("id", "t"), F.struct("t", -F.col("id")))
    chosen = timed.groupBy(by).agg(F.array(last).alias("chosen"))
    for k in range(1, count):
        far = timed.join(chosen, by).filter("not exists(chosen, x -> x.id = id)").withColumn("d", F.expr("array_min(transform(chosen, x -> abs(x.t - t)))"))
        nxt = far.groupBy(by).agg(F.max_by(F.struct("id", "t"), F.struct("d", -F.col("id"))).alias("next"))
        chosen = chosen.join(nxt, by, "left").select(by, F.expr("if(next is null, chosen, concat(chosen, array(next)))").alias("chosen"))
        if k % CUT_EVERY == 0:
            chosen = cut(chosen, "diverse")
    picked = chosen.select(by, F.posexplode("chosen").alias("k", "x")).select(by, (F.col("k") + 1).cast("long").alias("ordinal"), F.col("x.id").alias(id_col))
    held = chosen.select(by, F.size("chosen").alias("n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("id"))
    untimed = slim.filter("t is null").withColumn("k", rank).filter(F.col("k") <= count).join(held, by, "left")
    rest = untimed.select(by, (F.coalesce("n", F.lit(0)) + F.col("k")).cast("long").alias("ordinal"), F.col("id").alias(id_col))
    return picked.unionByName(rest).filter(F.col("ordinal") <= count)


def delivered(chosen: DataFrame, candidates: DataFrame, by: str = "project_id", id_col: str = "winner") -> DataFrame:
    """A chosen set in delivery order: by, rank, id."""
    timed = chosen.join(candidates.select(by, id_col, "captured_at"), [by, id_col])
    return delivery_rank(timed, by, id_col).select(by, "rank", id_col)


def list_positions(ranked: DataFrame, by: str = "project_id") -> DataFrame:
    """ranked(by, rank) with n, the length of its list; counted before it is joined."""
    return ranked.join(ranked.groupBy(by).agg(F.count("*").alias("n")), by)


def head_without(ranked: DataFrame, excluded: DataFrame, count: int, by: str = "project_id") -> DataFrame:
    """ranked(by, rank, image_id) without the excluded ids, numbered anew, `count` of each list. Only the first rows of a list can be among
    them: those of a rank up to count and the list's excluded ones."""
    gone = excluded.select("image_id").distinct()
    room = ranked.join(gone, "image_id", "left_semi").groupBy(by).agg(F.count("*").alias("__gone"))
    first = ranked.join(room, by, "left").filter(F.col("rank") <= count + F.coalesce("__gone", F.lit(0))).drop("__gone")
    left = first.join(gone, "image_id", "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy("rank"))).filter(F.col("rank") <= count)


def already_delivered(selection: DataFrame, sent: DataFrame, by: str = "project_id") -> DataFrame:
    """by, delivered (whether all of the selection was sent before), missing (how many weren't)."""
    missing = selection.join(sent.select("image_id").distinct(), "image_id", "left_anti").groupBy(by).agg(F.count("*").alias("missing"))
    out = selection.select(by).distinct().join(missing, by, "left")
    return out.select(by, F.col("missing").isNull().alias("delivered"), F.coalesce("missing", F.lit(0)).alias("missing"))
