import os
import random

import pytest
from pyspark.sql import functions as F

from siftwork.operators import scope
from siftwork.sources import export

IMAGES = [(1, "a/x.jpg"), (2, "b/x.jpg"), (3, "c/x_2.jpg"), (4, "d/x.dng"), (5, "e/_y.jpg"), (6, "f/gone.jpg"), (7, "g/x.jpg")]


def plain(df):
    return {r.image_id: (r.target, r.reason) for r in df.collect()}


def plan(spark):
    images = spark.createDataFrame([(i, p, "raw" if p.endswith("dng") else "jpeg", None) for i, p in IMAGES], "id long, file_path string, kind string, recipe_id long")
    entries = images.select(F.col("id").alias("ordinal"), F.col("id").alias("image_id"))
    return export.planned(entries, images, present=images.filter("id <> 6"))


def one_by_one(there, failing):
    """The names of a folder that is filled a file at a time."""
    there, out = set(there), {}
    for i, path in IMAGES:
        stem, ext = os.path.splitext(os.path.basename(path))
        ext = ".jpg" if ext == ".dng" else ext
        if i == 6:
            out[i] = (None, "source_missing")
        elif i in failing:
            out[i] = (None, "no room")
        else:
            name, k = stem + ext, 2
            while name in there:
                name, k = f"{stem}_{k}{ext}", k + 1
            there.add(name)
            out[i] = (name, None)
    return out, there


@pytest.mark.parametrize("there", [[], ["x.jpg"], ["x_2.jpg", "x_4.jpg", "_y.jpg"], ["x_3_2.jpg", "x"]])
def test_names_beside_what_is_there(spark, there):
    taken = spark.createDataFrame([(x,) for x in there], "target string")
    assert plain(export.settled(plan(spark), taken)) == one_by_one(there, [])[0]


def test_written_twice_with_failures(spark, tmp_path):
    folder = str(tmp_path / "out")

    def write(row, path):
        with open(path, "w") as f:
            f.write(f"{row['image_id']}")
        if row["image_id"] == 1 and not os.path.exists(f"{folder}/x.jpg"):
            raise OSError("no room")  # with the file half written

    want, there = one_by_one([], [1])
    got = export.write_folder(plan(spark), folder, write)
    assert plain(got) == want and want[2] == ("x.jpg", None)  # the failed row's name went to the next
    content = {n: open(f"{folder}/{n}").read() for n in there}
    assert content == {t: str(i) for i, (t, _) in want.items() if t}
    again, there = one_by_one(there, [])
    assert plain(export.write_folder(plan(spark), folder, write)) == again
    assert {n for n in os.listdir(folder) if n != ".staging"} == there
    assert all(open(f"{folder}/{n}").read() == x for n, x in content.items())  # nothing was overwritten
    assert {r.outcome: r.n for r in export.outcome(got).collect()} == {"exported": 5, "no room": 1, "source_missing": 1}


def test_folder_cannot_be_made(spark, tmp_path):
    (tmp_path / "file").write_text("")
    with pytest.raises(scope.ScopeError):
        export.write_folder(plan(spark), str(tmp_path / "file" / "out"), print)


@pytest.mark.parametrize("heavy", [10_000, 3])
def test_chains_of_names_with_and_without_heavy_ones(spark, monkeypatch, heavy):
    monkeypatch.setattr(export, "HEAVY", heavy)
    rng = random.Random(heavy)
    names = [f"IMG{''.join(f'_{rng.choice([1, 2, 3, 12])}' for _ in range(rng.randrange(4)))}{rng.choice(['.jpg', '.JPG', ''])}" for _ in range(300)]
    there = sorted({*rng.sample(names, 8), "IMG_2_2_2.jpg", "IMG_3_12.JPG"})
    rows = spark.createDataFrame([(i % 2, i, x) for i, x in enumerate(names)], "tag_id long, ordinal long, target string")
    taken = spark.createDataFrame([(1, x) for x in there], "tag_id long, target string")
    want, held = [], {0: set(), 1: set(there)}
    for i, x in enumerate(names):
        stem, ext = os.path.splitext(x)
        k = 2
        while x in held[i % 2]:
            x, k = f"{stem}_{k}{ext}", k + 1
        held[i % 2].add(x)
        want.append(x)
    got = export.resolve_collisions(rows, ["tag_id"], taken).collect()
    assert [r.target for r in sorted(got, key=lambda r: r.ordinal)] == want


def test_names_that_extend_no_other_are_dealt_out_once(spark):
    rows = spark.range(200).selectExpr("0 as tag_id", "id as ordinal", "concat('IMG_', id div 2, '.jpg') as target")
    done = export.resolve_collisions(rows, ["tag_id"])
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "MapInArrow" not in plan and plan.count("Repartition") == 1
    assert {r.target for r in done.collect()} == {f"IMG_{k}{x}.jpg" for k in range(100) for x in ("", "_2")}
