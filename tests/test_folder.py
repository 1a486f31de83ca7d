import json

import pytest

from siftwork.operators import models
from siftwork.streaming import folder


def test_watch_and_sinks(spark, tmp_path):
    box = tmp_path / "in"
    (box / "below").mkdir(parents=True)
    for name in ("b.jpg", "a.JPG", "c.txt", "below/d.jpg"):
        (box / name).write_bytes(b"123")
    names = [p.rsplit("/", 1)[-1] for p in folder.in_name_order(folder.watch(spark, str(box), stream=False))]
    assert names == ["a.JPG", "b.jpg"]
    q = folder.watch(spark, str(box)).writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").count() == 2
    folder.send_file(str(box / "b.jpg"), str(tmp_path / "out"))
    folder.send_text(str(tmp_path / "log"), "a\nb")
    folder.send_text(str(tmp_path / "log"), "c")
    assert (tmp_path / "out/b.jpg").exists() and (tmp_path / "log").read_text() == "a b\nc\n"


@pytest.mark.parametrize("winner, error", [("a", None), ("c", "parse_error"), (None, "parse_error")])
def test_compare(spark, winner, error):
    df = spark.createDataFrame([(1,)], "pair_id long")
    r = models.compare(df, lambda row: json.dumps({"winner": winner, "reason": "r"})).first()
    assert (r.winner, r.error) == (winner if error is None else None, error)


def test_style_and_failing_service(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "image_id long")

    def ask(row):
        if row["image_id"] == 3:
            raise OSError("down")
        return json.dumps({"style": "Film" if row["image_id"] == 1 else "Nope"})

    got = sorted(tuple(r) for r in models.suggest_style(df, ask, ["Film"]).collect())
    assert got == [(1, "Film", None), (2, None, "parse_error"), (3, None, "down")]
