"""Message streams: stale events, idle sessions, throttled progress, idempotent delivery.

Each stateful rule is one pure function over a key's rows in order and its state. The same function runs in batch
(applyInPandas over a whole key) and on a stream (applyInPandasWithState, a micro-batch at a time), so that both agree.
Clocks are columns, never the machine's, so that runs are reproducible.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: rows of a key in order, state or None -> rows to emit, new state
Step = Callable[[pd.DataFrame, tuple | None], tuple[pd.DataFrame, tuple]]


#: State of a key without rows for so long is dropped; a key that comes back begins anew.
FORGET_MS = 7 * 86_400_000


def stateful(events: DataFrame, key: str, step: Step, schema: str, state: str, order: list[str], forget: int | None = FORGET_MS) -> DataFrame:
    """Runs the step for each key, on a stream with state (dropped after `forget` milliseconds without rows, or kept) and in batch with all
    rows at once."""
    if not events.isStreaming:
        return events.groupBy(key).applyInPandas(lambda pdf: step(pdf.sort_values(order, kind="stable"), None)[0], schema)

    def run(_key, frames, held):
        if held.hasTimedOut:
            held.remove()
            return
        pdf = pd.concat(list(frames)).sort_values(order, kind="stable")
        out, new = step(pdf, held.get if held.exists else None)
        held.update(new)
        if forget is not None:
            held.setTimeoutDuration(forget)
        yield out

    from pyspark.sql.streaming.state import GroupStateTimeout

    timeout = GroupStateTimeout.NoTimeout if forget is None else GroupStateTimeout.ProcessingTimeTimeout
    return events.groupBy(key).applyInPandasWithState(run, schema, state, "append", timeout)


def drop_stale(events: DataFrame, key: str = "chat_id", keep_kinds: tuple[str, ...] = ("cancelled",)) -> DataFrame:
    """Events(key, seq, generation, kind) without those of a generation before the latest seen; the kinds named pass in any case."""
    if not events.isStreaming:  # a running maximum, which needs no state
        seen = F.max("generation").over(Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
        return events.withColumn("__latest", seen).filter((F.col("generation") >= F.col("__latest")) | F.col("kind").isin(*keep_kinds)).select(key, "seq", "generation", "kind")

    def step(pdf: pd.DataFrame, state: tuple | None):
        latest = state[0] if state else None
        keep = []
        for g, kind in zip(pdf["generation"], pdf["kind"]):
            if latest is None or g > latest:
                latest = int(g)
            keep.append(g >= latest or kind in keep_kinds)
        return pdf[keep][[key, "seq", "generation", "kind"]], (latest,)

    return stateful(events, key, step, f"{key} bigint, seq bigint, generation bigint, kind string", "generation bigint", ["seq"])


def throttle_progress(events: DataFrame, key: str = "run_id", every: int = 60) -> DataFrame:
    """Progress(key, at, phase, done, total), at least `every` seconds apart; the last tick of a phase always passes, and a change of phase
    opens a new slot."""

    def step(pdf: pd.DataFrame, state: tuple | None):
        last, phase = state if state else (None, None)
        keep = []
        for at, p, done, total in zip(pdf["at"], pdf["phase"], pdf["done"], pdf["total"]):
            ok = p != phase or last is None or at - last >= every or done >= total
            if ok:
                last, phase = int(at), p
            keep.append(ok)
        return pdf[keep][[key, "at", "phase", "done", "total"]], (last, phase)

    return stateful(events, key, step, f"{key} bigint, at bigint, phase string, done bigint, total bigint", "last bigint, phase string", ["at", "done"])


def idle_sessions(messages: DataFrame, key: str = "chat_id", time: str = "ts", idle: str = "300 seconds", late: str = "0 seconds") -> DataFrame:
    """One row for each period of activity, which ends after so long without a message: key, started, idle_at, n."""
    m = messages.withWatermark(time, late) if messages.isStreaming else messages
    s = m.groupBy(key, F.session_window(time, idle).alias("w")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("idle_at"), "n")


def drop_in_flight(requests: DataFrame, key: str = "image_id", time: str = "ts", window: str = "10 minutes") -> DataFrame:
    """The first request for an id; others within the window of one that was taken are dropped, on a stream. In batch the table is one
    window: requests without an end in between, of which the first stays."""
    if requests.isStreaming:
        return requests.withWatermark(time, window).dropDuplicatesWithinWatermark([key])
    first = requests.groupBy(key).agg(F.min(time).alias(time))
    return requests.join(first, [key, time], "left_semi").dropDuplicates([key])


def split_bad(messages: DataFrame, parsed: F.Column, name: str = "parsed") -> tuple[DataFrame, DataFrame]:
    """Good rows and dead letters: one bad message doesn't stop the others."""
    out = messages.withColumn(name, parsed)
    return out.filter(F.col(name).isNotNull()), out.filter(F.col(name).isNull()).drop(name)


def deliver_once(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: rows whose keys were delivered before are skipped, a batch that is run again writes what it wrote."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(keys)
        try:
            sent = spark.read.parquet(path).filter(F.col("batch") != batch_id)
            new = new.join(sent.select(*keys), keys, "left_anti")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch_id}")

    return sink


def expired(runs: DataFrame, now: int, days: int = 7) -> DataFrame:
    """Ended runs(run_id, status, updated_at in seconds) beyond their time to live."""
    return runs.filter(F.col("status").isin("done", "failed", "cancelled") & (F.col("updated_at") < now - days * 86400))


def resume(runs: DataFrame) -> DataFrame:
    """Of several active runs of a chat the one with the latest activity resumes, the others are cancelled: chat_id, run_id, action."""
    active = runs.filter(~F.col("status").isin("done", "failed", "cancelled"))
    latest = active.groupBy("chat_id").agg(F.max_by("run_id", F.struct("updated_at", "run_id")).alias("keep"))
    return active.join(latest, "chat_id").select("chat_id", "run_id", F.when(F.col("run_id") == F.col("keep"), "resume").otherwise("cancel").alias("action"))


def with_retries(send: Callable[[], None], attempts: int = 3, first: float = 2.0, sleep: Callable[[float], None] | None = None) -> int:
    """Calls send until it succeeds, waiting twice as long each time; the attempts made. The last failure is raised."""
    import time

    wait = sleep or time.sleep
    for n in range(1, attempts + 1):
        try:
            send()
            return n
        except Exception:
            if n == attempts:
                raise
            wait(first * 2 ** (n - 1))
    return attempts
