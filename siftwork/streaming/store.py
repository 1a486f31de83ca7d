"""Runs, waiting photos and evaluation tasks as tables: what a chat service keeps between micro-batches.

Every change maps an old table to a new one, so a batch that is run again gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.operators import models, projects

TERMINAL = ("done", "failed", "cancelled")


def save(runs: DataFrame, new: DataFrame) -> DataFrame:
    """runs(run_id, status, updated_at, ...) with the new rows in place of the old ones of their ids; of several new ones the latest."""
    latest = new.withColumn("__k", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("updated_at")))).filter("__k = 1").drop("__k")
    return runs.join(latest.select("run_id"), "run_id", "left_anti").unionByName(latest)


def active(runs: DataFrame) -> DataFrame:
    return runs.filter(~F.col("status").isin(*TERMINAL))


def mark_cancelling(marks: DataFrame, ids: DataFrame) -> DataFrame:
    """Tombstones(run_id): a run that is to be cancelled stays marked until it has been."""
    return marks.select("run_id").unionByName(ids.select("run_id")).distinct()


def clear_cancelling(marks: DataFrame, ids: DataFrame) -> DataFrame:
    return marks.join(ids.select("run_id"), "run_id", "left_anti")


def delete(runs: DataFrame, marks: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    return runs.join(ids.select("run_id"), "run_id", "left_anti"), clear_cancelling(marks, ids)


def allowed(messages: DataFrame, chats: list[int]) -> DataFrame:
    """Messages of the conversations that are served."""
    return messages.filter(F.col("chat_id").isin(chats))


def arrivals(photos: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """photos(chat_id, name, ...) of chats without a run under way, and those that wait for the next batch."""
    busy = active(runs).filter(F.col("status") != "collecting").select("chat_id").distinct()
    return photos.join(busy, "chat_id", "left_anti"), photos.join(busy, "chat_id", "left_semi")


def drained(pending: DataFrame, run_ids: DataFrame) -> DataFrame:
    """Waiting photos given to their chat's next run, run_ids(chat_id, run_id): run_id, ordinal by name, name; of one name the last
    that came."""
    last = pending.groupBy("chat_id", "name").agg(F.max("at").alias("at"))
    order = F.row_number().over(Window.partitionBy("run_id").orderBy("name"))
    return last.join(run_ids, "chat_id").withColumn("ordinal", order).select("run_id", "ordinal", "name")


def batch_view(photos: DataFrame, image_tags: DataFrame, duplicate_tag: int, runs: DataFrame) -> DataFrame:
    """A row for each run, rebuilt from what is stored: status, photos, tagged as duplicates, remaining, and whether a gate waits."""
    n = photos.groupBy("run_id").agg(F.count("*").alias("photos"))
    gone = photos.join(image_tags.filter(F.col("tag_id") == duplicate_tag).select("image_id").distinct(), "image_id", "left_semi").groupBy("run_id").agg(F.count("*").alias("tagged"))
    none = F.lit(0).cast("long")
    out = runs.join(n, "run_id", "left").join(gone, "run_id", "left").withColumns({"photos": F.coalesce("photos", none), "tagged": F.coalesce("tagged", none)})
    return out.select("run_id", "status", "photos", "tagged", (F.col("photos") - F.col("tagged")).alias("remaining"), (F.col("status") == "waiting").alias("at_gate"))


def counters(tasks: DataFrame) -> DataFrame:
    """queued, processing and failed evaluation tasks(state), one row."""
    return tasks.agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("queued", "processing", "failed")])


def evaluation_sink(ask: models.Ask, provider: str, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], failed: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink of evaluation requests(image_id): each is asked for once, good answers replace the stored ones, failures are handed
    on with their reason. read and write hold the table of evaluations."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        answers = models.evaluate(batch.select("image_id").distinct(), ask).persist()
        try:
            good = answers.filter("error is null")
            result = F.to_json(F.struct("assessment", "unusable", "content"))
            new = good.select("image_id", result.alias("result_json"), F.lit(None).cast("string").alias("extra_guidance"), F.lit(provider).alias("provider"))
            write(projects.upsert_evaluations(read(), new))
            failed(answers.filter("error is not null").select("image_id", "error"))
        finally:
            answers.unpersist()

    return sink
