"""The queue of evaluation requests: one worker for each queue, first come, first served.

Events(queue_id, seq, image_id, kind, error) are requests and completions ("request", "finish"), numbered within a queue; an image belongs to one
queue. A request is taken unless its image is in flight; a completion is taken, and releases the image, if it is. Events that aren't taken, of other
kinds too, change nothing. A failed completion (error not null) releases as well. The ledger tells for each event: taken; ticket, the requests taken so
far; generation, the completions taken so far; failed, those of them with an error; and pending, what is in flight behind it.

In batch the ledger is two scans by ranges (`operators/order.py`), so that a queue or an image of all rows is no task of its own. On a stream it is a state for
each queue, as large as what is in flight; a queue's events must come in the order of seq.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.operators import order
from siftwork.streaming.sessions import stateful

KINDS = ("request", "finish")
COUNTS = ("ticket", "generation", "failed")
LEDGER = "queue_id bigint, seq bigint, image_id bigint, kind string, error string, taken boolean, ticket bigint, generation bigint, failed bigint, pending bigint"


def decided(events: DataFrame) -> DataFrame:
    """events with taken. An image is in flight if the last request or completion before is a request, taken or not."""
    known = F.when(F.col("kind").isin(*KINDS), F.col("kind"))
    by, at = "image_id", [F.col("seq")]
    rows = order.in_ranges(events, by, at)
    before = F.last(known, True).over(order.in_range(by, at).rowsBetween(order.Window.unboundedPreceding, -1))
    rows = rows.withColumn("__before", before)
    rows = order.with_neighbours(rows, by, {"__last": F.max_by(known, F.when(known.isNotNull(), F.col("seq")))}, {"__carried": F.last("__last", True).over(order.earlier(by))})
    last = F.coalesce("__before", "__carried", F.lit("finish"))
    taken = F.coalesce(F.col("kind").isin(*KINDS) & (F.col("kind") != last), F.lit(False))
    return rows.withColumn("taken", taken).select("queue_id", "seq", "image_id", "kind", "error", "taken")


def ledger(events: DataFrame) -> DataFrame:
    """LEDGER of the events, the same in batch and on a stream."""
    if events.isStreaming:
        state = "in_flight array<bigint>, ticket bigint, generation bigint, failed bigint"
        return stateful(events.select("queue_id", "seq", "image_id", "kind", "error"), "queue_id", _step, LEDGER, state, ["seq"], forget=None)
    by, at = "queue_id", [F.col("seq")]
    rows = order.in_ranges(decided(events), by, at)
    finish = F.col("taken") & (F.col("kind") == "finish")
    ones = {"ticket": F.col("taken") & (F.col("kind") == "request"), "generation": finish, "failed": finish & F.col("error").isNotNull()}
    ones = {name: F.when(one, F.lit(1)).otherwise(F.lit(0)).cast("long") for name, one in ones.items()}
    running = order.in_range(by, at).rowsBetween(order.Window.unboundedPreceding, order.Window.currentRow)
    rows = rows.withColumns({f"__{name}": one for name, one in ones.items()}).withColumns({name: F.sum(f"__{name}").over(running) for name in COUNTS})
    sums = {f"__sum_{name}": F.sum(f"__{name}") for name in COUNTS}
    rows = order.with_neighbours(rows, by, sums, {f"__start_{name}": F.sum(f"__sum_{name}").over(order.earlier(by)) for name in COUNTS})
    rows = rows.withColumns({name: F.col(name) + F.coalesce(f"__start_{name}", F.lit(0)) for name in COUNTS})
    return rows.withColumn("pending", F.col("ticket") - F.col("generation")).select(*[part.split()[0] for part in LEDGER.split(", ")])


def _step(pdf: pd.DataFrame, state: tuple | None):
    """The same rule over a queue's events in order, for `stateful`."""
    held, ticket, generation, failed = state if state else ([], 0, 0, 0)
    in_flight, out = dict.fromkeys(held), []
    for image, kind, error in zip(pdf["image_id"], pdf["kind"], pdf["error"]):
        image = None if pd.isna(image) else int(image)
        taken = kind == "request" and image not in in_flight or kind == "finish" and image in in_flight
        if taken and kind == "request":
            in_flight[image] = None
            ticket += 1
        elif taken:
            del in_flight[image]
            generation += 1
            failed += error is not None
        out.append((taken, ticket, generation, failed, len(in_flight)))
    pdf = pdf.assign(**dict(zip(("taken", *COUNTS, "pending"), zip(*out)))) if out else pdf.assign(taken=False, ticket=0, generation=0, failed=0, pending=0)
    return pdf, (list(in_flight), ticket, generation, failed)


def status(book: DataFrame) -> DataFrame:
    """A row for each queue of a ledger: queued, processing (the worker holds one of what is in flight), failed, generation."""
    last = book.groupBy("queue_id").agg(F.max_by(F.struct("pending", "failed", "generation"), "seq").alias("x"))
    return last.select("queue_id", F.greatest(F.col("x.pending") - 1, F.lit(0)).alias("queued"), (F.col("x.pending") > 0).alias("processing"), "x.failed", "x.generation")


def waiting(book: DataFrame) -> DataFrame:
    """What is in flight at the end of a ledger: queue_id, position (from 1; the first is with the worker), image_id."""
    last = book.filter("taken").groupBy("queue_id", "image_id").agg(F.max_by(F.struct("kind", "ticket"), "seq").alias("x"))
    left = last.filter("x.kind = 'request'").select("queue_id", "image_id", F.col("x.ticket").alias("ticket"))
    return order.ordinal_in(left, "queue_id", [F.col("ticket")], "position").select("queue_id", "position", "image_id")


def news(book: DataFrame, seen: DataFrame) -> DataFrame:
    """Queues with results that a reader hasn't seen: queue_id, generation, and of the failures since then the latest with its image and
    the number of all so far (null if none). seen(queue_id, generation): what was read last; a queue that isn't there has seen nothing."""
    marks = seen.groupBy(F.col("queue_id").alias("__q")).agg(F.max("generation").alias("__seen"))
    done = book.filter("taken and kind = 'finish'").join(marks, F.col("queue_id").eqNullSafe(F.col("__q")), "left")
    done = done.filter(F.col("generation") > F.coalesce("__seen", F.lit(0)))
    bad = F.when(F.col("error").isNotNull(), F.col("seq"))
    latest = done.groupBy("queue_id").agg(F.max("generation").alias("generation"), F.max_by(F.struct("image_id", "error", "failed"), bad).alias("x"))
    return latest.select("queue_id", "generation", F.col("x.image_id").alias("failed_image"), F.col("x.error").alias("error"), F.col("x.failed").alias("failed"))
