import random

from siftwork.streaming import queue

SCHEMA = "queue_id long, seq long, image_id long, kind string, error string"


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def some_events(n=400):
    rng = random.Random(5)
    out = []
    for seq in range(n):
        q = 0 if rng.random() < 0.6 else rng.randrange(1, 4)  # a hot queue, and in it a hot image
        image = q * 100 + (0 if rng.random() < 0.4 else rng.randrange(6))
        kind = rng.choice(["request", "request", "finish", "finish", "looked", None])
        out.append((q, seq, image, kind, rng.choice([None, "no network", "no image"]) if kind == "finish" else None))
    return out


def simulated(events):
    """A deque and a set for each queue, one event after another."""
    fifo, failed, generation, tickets, out = {}, {}, {}, {}, []
    for q, seq, image, kind, error in sorted(events, key=lambda e: (e[0], e[1])):
        line = fifo.setdefault(q, [])
        taken = False
        if kind == "request" and image not in line:
            line.append(image)
            tickets[q] = tickets.get(q, 0) + 1
            taken = True
        elif kind == "finish" and image in line:
            line.remove(image)
            generation[q] = generation.get(q, 0) + 1
            failed[q] = failed.get(q, 0) + (error is not None)
            taken = True
        out.append((q, seq, taken, tickets.get(q, 0), generation.get(q, 0), failed.get(q, 0), len(line)))
    return sorted(out, key=repr), fifo


COLUMNS = ("queue_id", "seq", "taken", "ticket", "generation", "failed", "pending")


def test_batch_and_stream_agree_with_a_simulation(spark, tmp_path):
    events = some_events()
    want, fifo = simulated(events)
    df = spark.createDataFrame(events, SCHEMA)
    book = queue.ledger(df).persist()
    assert rows(book, *COLUMNS) == want
    assert rows(queue.waiting(book), "queue_id", "position", "image_id") == sorted(((q, k, i) for q, line in fifo.items() for k, i in enumerate(line, 1)), key=repr)
    got = {r.queue_id: r for r in queue.status(book).collect()}
    assert {q: (r.queued, r.processing) for q, r in got.items()} == {q: (max(len(line) - 1, 0), bool(line)) for q, line in fifo.items()}

    src = tmp_path / "in"
    for low, high in ((0, 150), (150, 151), (151, 400)):
        df.filter(f"seq >= {low} and seq < {high}").coalesce(1).write.mode("append").parquet(str(src))
    def run(name):
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
        sink = queue.ledger(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
        sink.trigger(availableNow=True).start().awaitTermination(180)
        return spark.read.parquet(str(tmp_path / "out"))

    assert rows(run("a"), *COLUMNS) == want
    more = [(0, 400, 7, "request", None), (0, 401, 7, "request", None), (0, 402, 7, "finish", "late")]  # a restart goes on from the state
    spark.createDataFrame(more, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
    assert rows(run("b"), *COLUMNS) == simulated(events + more)[0]


def test_news(spark):
    events = [(1, 1, 5, "request", None), (1, 2, 6, "request", None), (1, 3, 5, "request", None), (1, 4, 5, "finish", "a"), (1, 5, 6, "finish", "b"), (1, 6, 5, "request", None), (1, 7, 5, "finish", None), (2, 1, 8, "finish", "stray")]
    book = queue.ledger(spark.createDataFrame(events, SCHEMA))
    seen = "queue_id long, generation long"
    show = ("queue_id", "generation", "failed_image", "error", "failed")
    assert rows(queue.news(book, spark.createDataFrame([], seen)), *show) == [(1, 3, 6, "b", 2)]
    assert rows(queue.news(book, spark.createDataFrame([(1, 2)], seen)), *show) == [(1, 3, None, None, None)]
    assert rows(queue.news(book, spark.createDataFrame([(1, 3)], seen)), *show) == []


def test_empty_and_nulls(spark):
    assert queue.ledger(spark.createDataFrame([], SCHEMA)).count() == 0
    events = [(None, 1, None, "request", None), (None, 2, None, "request", None), (None, 3, None, "finish", None)]
    assert rows(queue.ledger(spark.createDataFrame(events, SCHEMA)), "seq", "taken", "pending") == [(1, True, 1), (2, False, 1), (3, True, 0)]
