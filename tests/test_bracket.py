"""Tournaments in rounds of a table, against the grouped ones that play match after match."""

import random

import pytest
from pyspark.sql import functions as F

from siftwork.operators import bracket, tournament

rows = lambda df: sorted(map(tuple, df.collect()), key=repr)


def cyclic(a, b):
    """Neither transitive nor symmetric in its sides: the pairing decides."""
    return (a["image_id"] * 7 + b["image_id"] * 3) % 11 < 5


def groups(spark, sizes, seed=3):
    rng = random.Random(seed)
    data = [(g, i, rng.random() < 0.8, rng.choice([None, rng.randrange(99)])) for g, n in enumerate(sizes) for i in rng.sample(range(1000 * g, 1000 * g + 900), n)]
    df = spark.createDataFrame(data, "g long, image_id long, decodable boolean, captured_at long").repartition(3)
    return df.withColumn("fallback", F.min("image_id").over(bracket_window()))


def bracket_window():
    from pyspark.sql import Window

    return Window.partitionBy("g")


@pytest.mark.parametrize("step", [1, 3])
def test_rounds_equal_the_grouped_tournaments(spark, step):
    df = groups(spark, [1, 2, 3, 7, 13, 21])
    assert rows(bracket.eliminated(df, cyclic, ["g"], step=step)) == rows(tournament.eliminated(df, cyclic, ["g"]))
    for k in (1, 3):
        assert rows(bracket.top_k(df, cyclic, k, ["g"], step=step)) == rows(tournament.top_k_in_groups(df, cyclic, k, ["g"]))


def test_more_ranks_than_members_seats_and_null_keys(spark):
    data = [(None if g == 0 else g, 100 * g + i, (i * 5) % 7) for g in range(3) for i in range(7)]
    df = spark.createDataFrame(data, "g long, image_id long, seat long")
    got = rows(bracket.top_k(df, cyclic, 9, ["g"]))
    assert got == rows(tournament.top_k_in_groups(df.withColumn("g", F.coalesce("g", F.lit(0))), cyclic, 9, ["g"]).withColumn("g", F.when(F.col("g") > 0, F.col("g")))) and len(got) == 21
    assert rows(bracket.top_k(df, cyclic, 0, ["g"])) == rows(bracket.top_k(df.limit(0), cyclic, 3, ["g"])) == []
    assert rows(bracket.eliminated(df.limit(0).withColumn("fallback", F.col("image_id")), cyclic, ["g"])) == []


def test_clashing_names_and_nested_columns(spark):
    df = spark.createDataFrame([(1, i, [i, None], {"a": i}, "x") for i in range(5)], "key long, image_id long, place array<long>, left map<string,long>, rank string")
    assert [r.image_id for r in bracket.top_k(df, lambda a, b: a["place"][0] > b["place"][0], 2, ["key"]).orderBy("rank").collect()] == [4, 3]


def test_a_failure_ends_its_group_alone(spark):
    df = groups(spark, [1, 9, 20]).withColumn("decodable", F.lit(True))

    def broken(a, b):
        if a["g"] == 2:
            raise ValueError("no answer")
        return cyclic(a, b)

    want = {r.g: r for r in tournament.eliminated(df, broken, ["g"]).collect()}
    got = {r.g: r for r in bracket.eliminated(df, broken, ["g"]).collect()}
    assert got.keys() == want.keys() and all((got[g].winner, got[g].failed) == (want[g].winner, want[g].failed) for g in want) and got[2].failed
    assert got[2].comparisons <= 3  # one in each subtree of the first round
    late = lambda a, b: None if 2 in (a["g"], b["g"]) and 0.5 > abs(a["fallback"] - b["image_id"]) else cyclic(a, b)
    ranked = lambda df: rows(df.select("g", "rank", "image_id"))
    assert ranked(bracket.top_k(df, late, 5, ["g"])) == ranked(tournament.top_k_in_groups(df, late, 5, ["g"]))
    assert bracket.top_k(df, cyclic, 2, ["g"], cancelled=lambda: True) is None


def test_a_run_goes_on_where_it_stopped(spark, tmp_path):
    df, log = groups(spark, [20, 3]).withColumn("decodable", F.lit(True)), tmp_path / "log"

    def heard(a, b):
        with open(log, "a") as f:
            f.write("x\n")
        return cyclic(a, b)

    asked, folder = [], f"file://{tmp_path}/run"
    assert bracket.top_k(df, heard, 3, ["g"], folder, cancelled=lambda: asked.append(1) or len(asked) > 2) is None
    stopped = len(log.read_text().split())
    done = bracket.top_k(df, heard, 3, ["g"], folder)
    made = {r.g: r.comparisons for r in done.collect()}
    assert rows(done) == rows(tournament.top_k_in_groups(df, cyclic, 3, ["g"]))
    assert 0 < stopped < sum(made.values()) == len(log.read_text().split())  # none was paid for twice
    assert rows(bracket.top_k(df, lambda a, b: 1 / 0, 3, ["g"], folder)) == rows(done)  # all is read


def test_no_task_holds_a_group(spark):
    df = spark.range(3000).select(F.lit(1).alias("g"), F.col("id").alias("image_id"), F.lit(0).alias("fallback"))

    def few(a, b):
        return a["image_id"] > b["image_id"]

    assert rows(bracket.eliminated(df, few, ["g"])) == [(1, 2999, 2999, False)]
    seated = bracket._seated(df, ["g"]).withColumn("left", F.struct(F.col("place").alias("seat"), "row"))
    played = bracket._round(seated.select("key", "place", "left"), bracket._schema(seated.drop("left")), few, 0, 3)
    subtrees = played.filter("not through").groupBy(F.expr("place >> (3 - level)")).count()
    assert subtrees.agg(F.max("count")).first()[0] == 7 and subtrees.count() == 375
