"""Tournaments as rounds of a table: the matches of one large group, or of a final, run in parallel, and a broken run goes on where it stopped.

Members take seats 0, 1, 2... in their group. A node of level l and place p stands over the seats s with s >> l = p, which pairs neighbours round by
round and lets an odd last one through; a match is a node with both sides taken. A round plays `step` levels: each task takes subtrees of 2 ** step seats, never
a group. When a winner leaves, its path holds one match for each level; these depend on each other and are played again in one task.

Rounds are written to a folder. A run that names the folder of an earlier one reads what that finished and pays for no comparison of a finished round twice; the
folder belongs to one input, comparator and step.

Defined cases: a group of one wins without a comparison; nulls in `by` are a key of their own; equal ids sit in any order; an empty table gives an
empty result. A failed comparison fails its group, which takes no part in later rounds; comparisons are those made, so a failed group can have more of them
than it takes one after another, as its round runs at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwork.plans.lineage import finished_or_written, new_folder

from .order import ordinal_in
from .tournament import CompareRows, judged

#: Levels that a round plays: 2 ** 3 - 1 comparisons in one task's turn at most.
STEP = 3
NODE = ["key", "level", "place"]
#: Subtrees or paths whose matches go out together.
AT_ONCE = 256


def _seated(groups: DataFrame, by: list[str]) -> DataFrame:
    """key struct, place, row struct: members in order of their seat, or else of their id."""
    order = "seat" if "seat" in groups.columns else "image_id"
    rows = groups.select(F.struct(*by).alias("key"), F.struct(*groups.columns).alias("row"))
    return ordinal_in(rows, "key", [F.asc(f"row.{order}")], "place").select("key", (F.col("place") - 1).cast("long").alias("place"), "row")


def _schema(seated: DataFrame) -> T.StructType:
    """A row is a match, or (through) what a subtree sends on."""
    side = T.StructType([T.StructField("seat", T.LongType()), T.StructField("row", seated.schema["row"].dataType)])
    names = {"key": seated.schema["key"].dataType, "through": T.BooleanType(), "level": T.IntegerType(), "place": T.LongType(), "left": side, "right": side, "best": side, "made": T.BooleanType(), "ok": T.BooleanType()}
    return T.StructType([T.StructField(k, v) for k, v in names.items()])


def _mapped(rows: DataFrame, schema: T.StructType, play: Callable[[dict], Iterator[dict]]) -> DataFrame:
    """Rows (key, several) through `play`; types of what goes out are those of what comes in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = batch.schema.field("several").type.value_type.field("left").type
            out = pa.schema([("key", batch.schema.field("key").type), ("through", pa.bool_()), ("level", pa.int32()), ("place", pa.int64()), ("left", side), ("right", side), ("best", side), ("made", pa.bool_()), ("ok", pa.bool_())])
            for i in range(0, batch.num_rows, AT_ONCE):
                found = [x for row in batch.slice(i, AT_ONCE).to_pylist() for x in play(row)]
                yield pa.RecordBatch.from_pylist(found, schema=out)

    return rows.mapInArrow(run, schema)


def _met(compare: CompareRows, left: dict | None, right: dict | None) -> tuple[dict | None, bool, bool]:
    """The better side, whether they were compared, and whether that succeeded; an empty side loses without a comparison."""
    if left is None or right is None:
        return (right if left is None else left), False, True
    better = judged(compare, [left["row"], right["row"]])(0, 1)
    return (None if better is None else left if better else right), True, better is not None


def _round(alive: DataFrame, schema: T.StructType, compare: CompareRows, level: int, step: int) -> DataFrame:
    """Matches of `step` levels above `level`, and what goes on. alive: key, place, left (who stands there)."""

    def play(row: dict) -> Iterator[dict]:
        at = {x["place"]: x["left"] for x in row["several"]}
        for up in range(level + 1, level + step + 1):
            above: dict[int, dict] = {}
            for place in sorted(at):
                if place >> 1 in above:
                    continue  # the right side of a match already played
                if place ^ 1 not in at:
                    above[place >> 1] = at[place]
                    continue
                left, right = at[place], at[place ^ 1]
                best, made, ok = _met(compare, left, right)
                yield {"key": row["key"], "through": False, "level": up, "place": place >> 1, "left": left, "right": right, "best": best, "made": made, "ok": ok}
                if not ok:
                    return
                above[place >> 1] = best
            at = above
        ((place, best),) = at.items()
        yield {"key": row["key"], "through": True, "level": level + step, "place": place, "best": best, "ok": True}

    subtrees = alive.groupBy("key", F.shiftright("place", step).alias("subtree")).agg(F.collect_list(F.struct("place", "left")).alias("several"))
    return _mapped(subtrees.select("key", "several"), schema, play)


def _replayed(paths: DataFrame, schema: T.StructType, compare: CompareRows) -> DataFrame:
    """The matches of a winner's path without it. paths: key, several (level, place, left, right, best: the winner that leaves)."""

    def play(row: dict) -> Iterator[dict]:
        now = None
        for x in sorted(row["several"], key=lambda x: x["level"]):
            on_right = x["best"]["seat"] >> (x["level"] - 1) & 1
            left, right = (x["left"], now) if on_right else (now, x["right"])
            now, made, ok = _met(compare, left, right)
            yield {"key": row["key"], "through": False, "level": x["level"], "place": x["place"], "left": left, "right": right, "best": now, "made": made, "ok": ok}
            if not ok:
                return
        yield {"key": row["key"], "through": True, "level": None, "place": 0, "best": now, "ok": True}

    return _mapped(paths, schema, play)


def _without_failed(rows: DataFrame, played: DataFrame) -> DataFrame:
    return rows.join(played.filter("not ok").select("key").distinct(), "key", "left_anti")


def _tournament(groups: DataFrame, compare: CompareRows, k: int, by: list[str], folder: str | None, step: int, cancelled: Callable[[], bool]) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """The seats, every match played, and (key, rank, best); None if it was cancelled between two rounds."""
    if step < 1:
        raise ValueError("a round plays one level at least")
    spark, folder = groups.sparkSession, folder or new_folder(groups.sparkSession, "bracket")
    seated = finished_or_written(spark, f"{folder}/seats", lambda: _seated(groups, by))
    schema = _schema(seated)
    last = seated.agg(F.max("place").alias("n")).first().n
    alive = seated.select("key", "place", F.struct(F.col("place").alias("seat"), "row").alias("left"))
    rounds, level = [], 0
    while True:  # a round at least, so that a single member goes through it too
        if cancelled():
            return None
        path = f"{folder}/round-{level + step}"
        played = finished_or_written(spark, path, lambda: _round(alive, schema, compare, level, step))
        rounds.append(path)
        level += step
        if (last or 0) >> level == 0:
            break
        alive = _without_failed(played.filter("through").select("key", "place", F.col("best").alias("left")), played)
    seeded = spark.read.schema(schema).parquet(*rounds)
    matches = seeded.filter("not through")
    first = _without_failed(played.filter("through"), seeded).select("key", F.lit(1).alias("rank"), "best")
    taken, ranks, replays = first, [], T.StructType([*schema, T.StructField("rank", T.IntegerType())])
    for rank in range(2, k + 1):
        if cancelled():
            return None
        now = matches.select(*NODE, "left", "right", "best")
        if ranks:  # a match counts as it was played last
            again = spark.read.schema(replays).parquet(*ranks).filter("not through").groupBy(*NODE).agg(F.max_by(F.struct("left", "right", "best"), "rank").alias("x"))
            now = now.join(again, NODE, "left_anti").unionByName(again.select(*NODE, "x.*"))
        leaves = taken.filter(F.col("rank") == rank - 1).select("key", F.col("best.seat").alias("seat"))
        on_path = now.withColumn("seat", F.col("best.seat")).join(leaves, ["key", "seat"])
        paths = on_path.groupBy("key").agg(F.collect_list(F.struct("level", "place", "left", "right", "best")).alias("several"))
        path = f"{folder}/rank-{rank}"
        played = finished_or_written(spark, path, lambda: _replayed(paths, schema, compare).withColumn("rank", F.lit(rank)))
        ranks.append(path)
        every = spark.read.schema(replays).parquet(*ranks)
        taken = first.unionByName(every.filter("through and best is not null").select("key", "rank", "best"))
        if played.filter("through and best is not null").isEmpty():
            break
    if ranks:
        matches = matches.unionByName(every.filter("not through").drop("rank"))
    return seated, matches, _without_failed(taken, matches)


def _counted(seated: DataFrame, played: DataFrame) -> DataFrame:
    """key, comparisons, failed and the first member's row of each group."""
    made = played.groupBy("key").agg(F.sum(F.col("made").cast("long")).alias("comparisons"), F.bool_or(~F.col("ok")).alias("failed"))
    first = seated.filter("place = 0").select("key", "row")
    return first.join(made, "key", "left").select("key", "row", F.coalesce("comparisons", F.lit(0)).alias("comparisons"), F.coalesce("failed", F.lit(False)).alias("failed"))


def eliminated(groups: DataFrame, compare: CompareRows, by: list[str], folder: str | None = None, step: int = STEP, cancelled: Callable[[], bool] = lambda: False) -> DataFrame | None:
    """by, winner, comparisons, failed: as tournament.eliminated, without a task that holds a group. None if it was cancelled."""
    done = _tournament(groups, compare, 1, by, folder, step, cancelled)
    if done is None:
        return None
    seated, played, taken = done
    ended = _counted(seated, played).join(taken.select("key", "best"), "key", "left")
    winner = F.when(F.col("failed"), F.col("row.fallback")).otherwise(F.col("best.row.image_id"))
    return ended.select("key.*", winner.cast("long").alias("winner"), "comparisons", "failed")


def top_k(groups: DataFrame, compare: CompareRows, k: int, by: list[str], folder: str | None = None, step: int = STEP, cancelled: Callable[[], bool] = lambda: False) -> DataFrame | None:
    """by, rank, image_id, comparisons: as tournament.top_k_in_groups, without a task that holds a group. None if it was cancelled."""
    done = _tournament(groups if k > 0 else groups.limit(0), compare, k, by, folder if k > 0 else None, step, cancelled)
    if done is None:
        return None
    seated, played, taken = done
    ended = _counted(seated, played).join(taken.select("key", "rank", "best"), "key", "left")
    return ended.select("key.*", F.col("rank").cast("long").alias("rank"), F.col("best.row.image_id").cast("long").alias("image_id"), "comparisons")
