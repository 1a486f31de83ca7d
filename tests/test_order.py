"""Scans by range against windows that hold a whole key."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from siftwork.operators import cluster, navigate, order, select


@pytest.fixture(scope="module")
def shots(spark):
    rng = random.Random(2)
    rows, t = [], {1: 0, 2: 0, None: 0}
    for i in range(3000):
        p = rng.choice([1, 1, 1, 1, 1, 2, None])
        t[p] += rng.choice([0, 1, 5, 10, 11, 40])
        rows.append((i, p, None if rng.random() < 0.02 else t[p], f"f{rng.randrange(2000)}.jpg", rng.getrandbits(63) if rng.random() < 0.1 else rng.choice([7, 15, 1023]) << rng.randrange(50)))
    rows += [(9000, 5, 3, "x.jpg", None)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows are one range
    yield spark.createDataFrame(rows, "image_id long, project_id long, captured_at long, file_path string, hash long").repartition(6)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def same(a, b):
    return sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(*a.columns).collect()), key=str)


def test_one_project_in_many_tasks(shots):
    ranged = order.in_ranges(shots.filter("project_id = 1"), "project_id", [F.asc("captured_at"), F.asc("image_id")])
    assert ranged.select("__range").distinct().count() > 2


def test_ranks(shots):
    w = Window.partitionBy("project_id").orderBy(F.desc_nulls_last("captured_at"), "image_id")
    assert same(select.delivery_rank(shots), shots.withColumn("rank", F.row_number().over(w)))
    w = Window.partitionBy("project_id").orderBy(F.desc_nulls_last("captured_at"), "file_path", "image_id")
    assert same(select.browse_rank(shots), shots.withColumn("rank", F.row_number().over(w)))
    assert select.browse_rank(shots.limit(0)).count() == 0


def test_time_blocks(shots):
    w = Window.partitionBy("project_id").orderBy("captured_at", "image_id")
    timed = shots.filter("captured_at is not null").withColumn("new", F.when(F.col("captured_at") - F.lag("captured_at").over(w) > 10, 1).otherwise(0))
    want = timed.withColumn("block", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    got = cluster.time_blocks(shots, 10)
    assert same(got, want) and got.agg(F.max("block")).first()[0] > 100


def test_neighbours_in_a_circle(shots):
    ranked = select.delivery_rank(shots).select("project_id", "rank", "image_id")
    by = {}
    for r in ranked.orderBy("rank").collect():
        by.setdefault(r.project_id, []).append(r.image_id)
    want = {i: (ids[(k + 1) % len(ids)], ids[k - 1]) for ids in by.values() for k, i in enumerate(ids)}
    assert {r.image_id: (r.next_id, r.previous_id) for r in navigate.next_previous(ranked).collect()} == want
    tagged = shots.filter("image_id % 7 <> 0 or project_id = 2").select("image_id")
    gone = {r.image_id for r in tagged.collect()}
    want = {i: next((x for x in ids[k + 1 :] + ids[: k + 1] if x not in gone), None) for ids in by.values() for k, i in enumerate(ids)}
    assert {r.image_id: r.next_untagged for r in navigate.next_untagged(ranked, tagged).collect()} == want


@pytest.mark.parametrize("threshold, small", [(0, 0), (3, 0), (5, 0), (10, 0), (18, 0), (10, 256)])
def test_multi_index_hashing_makes_each_pair_once(spark, monkeypatch, threshold, small):
    monkeypatch.setattr(cluster, "SMALL", small)
    rng = random.Random(threshold)
    base = [rng.getrandbits(64) for _ in range(12)]
    hashes = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(0, threshold + 4))) for b in base for _ in range(12)]
    signed = [h - (1 << 64) if h >> 63 else h for h in hashes]
    df = spark.createDataFrame([(i, 1, i % 2, h) for i, h in enumerate(signed)], "image_id long, project_id long, block long, hash long")
    got = [(r.a, r.b) for r in cluster.similar_pairs(df, threshold).filter("distance > 0").collect()]
    heads = {}
    for i, h in enumerate(hashes):
        heads.setdefault((i % 2, h), i)
    ids = sorted(heads.values())
    want = {(i, j) for i in ids for j in ids if i < j and i % 2 == j % 2 and (hashes[i] ^ hashes[j]).bit_count() <= threshold}
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("lot", [1000, 2])
def test_all_pairs_hold_every_copy(spark, monkeypatch, lot):
    monkeypatch.setattr(cluster, "LOT", lot)
    hashes = [5, 5, 4, 5, -1, 4, 4, -2, 5, 0, None, 5]
    df = spark.createDataFrame([(i, i % 2, 0, h) for i, h in enumerate(hashes)], "image_id long, project_id long, block long, hash long")
    got = [tuple(r) for r in cluster.all_pairs(df, 1).collect()]
    known = [(i, h) for i, h in enumerate(hashes) if h is not None]
    want = {(i, j, (g ^ h).bit_count()) for i, g in known for j, h in known if i < j and i % 2 == j % 2 and ((g ^ h) & (1 << 64) - 1).bit_count() <= 1}
    assert len(got) == len(set(got)) and set(got) == want


def test_bands_hold_enough_bits_for_small_thresholds():
    assert [(e, min(hi - lo for lo, hi in bands)) for e, bands in map(cluster.bands_for, (5, 10))] == [(1, 21), (2, 16)]
