import random

from siftwork.operators.components import connected_components


def brute(pairs):
    label = {}

    def find(x):
        label.setdefault(x, x)
        while label[x] != x:
            x = label[x]
        return x

    for u, v in pairs:
        if u is not None and v is not None and u != v:
            a, b = sorted((find(u), find(v)))
            label[b] = a
    return {x: find(x) for x in label}


def run(spark, pairs):
    return dict(connected_components(spark.createDataFrame(pairs, "u long, v long")).collect())


def test_shapes(spark):
    chain = [(i, i + 1) for i in range(60)]
    random.Random(1).shuffle(chain)
    star = [(100, i) for i in range(101, 160)] + [(i, 100) for i in range(80, 90)]
    loops = [(200, 200), (None, 3), (300, 301), (301, 300), (300, 301)]
    rng = random.Random(2)
    rand = [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(60)]
    pairs = chain + star + loops + rand
    assert run(spark, pairs) == brute(pairs)


def test_empty(spark):
    assert run(spark, [(1, 1)]) == {}
