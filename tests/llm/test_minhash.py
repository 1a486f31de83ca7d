import random
import re

import numpy as np

from siftwork.llm import common, minhash

from .helpers import HOSTILE, frame, with_null_id


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(sets)
    label = {i: i for i in ids}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= 75 * max(len(a), len(b)):
                n = len(a & b)
                if 100 * n >= 75 * (len(a) + len(b) - n):
                    x, y = sorted((find(i), find(j)))
                    label[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_tables(spark):
    sf = "/root/testdata/sf0.01"
    texts = dict(common.table(spark, sf, "documents").select("doc_id", "text").collect())
    assert result(minhash.query(spark, sf)) == brute(texts)


def test_chains_and_near_threshold(spark):
    rng = random.Random(8)
    texts = []
    for _ in range(6):
        w = [f"v{rng.randrange(10**6)}" for _ in range(120)]
        for _ in range(25):  # each copy drifts on from the one before
            texts.append(" ".join(w))
            w = list(w)
            at = rng.randrange(len(w))
            w[at : at + rng.randrange(3)] = [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 4))]
    rng.shuffle(texts)
    assert result(minhash.near_duplicates(frame(spark, texts))) == brute(dict(enumerate(texts)))


def test_hostile(spark):
    df = with_null_id(frame(spark))
    got = result(minhash.near_duplicates(df).filter("doc_id is not null"))
    assert got == brute(dict(enumerate(HOSTILE)))
    assert minhash.near_duplicates(df).filter("doc_id is null and kept and component_id is null").count() == 3
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    assert minhash.near_duplicates(frame(spark).unionAll(frame(spark))).count() == 2 * len(HOSTILE)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for n in (1, 2, 7, 100, 4000):
        row = minhash.sketch([np.unique(base[:n])])
        assert (row != minhash.EMPTY).all()
    a, b = np.unique(base[:3000]), np.unique(base[1000:])
    rows = minhash.sketch([a, b], 1024)
    assert abs((rows[0] == rows[1]).mean() - 0.5) < 0.06


def test_a_doc_id_of_several_texts_links_with_each(spark):
    rng = random.Random(4)
    a, b = ([f"v{rng.randrange(10**6)}" for _ in range(60)] for _ in range(2))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a + ["x"])), (3, " ".join(b + ["y"])), (0, " ".join(b)), (7, "alone " * 9)]
    df = spark.createDataFrame([(i, t, 1, "c", "d", "e") for i, t in rows], "doc_id long, text string, n long, k1 string, node string, key string").repartition(3)
    got = sorted((r.doc_id, r.component_id) for r in minhash.near_duplicates(df).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 0), (3, 0), (7, 7)]


def test_large_group_of_near_copies_of_all_degrees(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PAIRS_PER_ROW", 1)  # so that leaders take turns
    monkeypatch.setattr(minhash, "LEADER_ROWS", 50)
    rng = random.Random(9)
    bases = [[f"v{rng.randrange(10**6)}" for _ in range(150)] for _ in range(2)]
    texts = []
    for i in range(300):
        w = list(bases[i % 2])
        for at in rng.sample(range(len(w)), rng.randrange(12)):
            w[at] = f"v{rng.randrange(10**6)}"
        if i % 7 == 0:
            del w[:rng.randrange(8)]
        texts.append(" ".join(w))
    assert result(minhash.near_duplicates(frame(spark, texts))) == brute(dict(enumerate(texts)))


def near_threshold(n, words=400, changes=9, seed=21):
    """Texts made from one base with so many changes, nearly all pairs of them below the threshold."""
    rng = random.Random(seed)
    base = [f"v{rng.randrange(10**6)}" for _ in range(words)]
    texts = []
    for _ in range(n):
        w = list(base)
        for at in rng.sample(range(words), changes):
            w[at] = f"v{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    return texts


def contested_nodes(rng, n, keys):
    rows = []
    for i in range(n):
        mine = rng.sample(range(keys), rng.randrange(1, 4))
        rows.append({"node": i, "k1": -i, "n": rng.randrange(90, 110), "m": 80 + rng.randrange(20), "most": 110, "component": rng.randrange(n), "bits": [rng.getrandbits(63) & rng.getrandbits(63) & rng.getrandbits(63) & rng.getrandbits(63) for _ in range(minhash.SIGNATURE // 64)], "keys": sorted(mine)})
    return rows


def test_each_pair_is_compared_once_in_its_smallest_shared_key():
    rng = random.Random(3)
    rows = contested_nodes(rng, 120, 8)
    possible = {(a["node"], b["node"]) for i, a in enumerate(rows) for b in rows[i + 1 :] if set(a["keys"]) & set(b["keys"]) and a["component"] != b["component"] and 100 * min(a["n"], b["n"]) >= 75 * max(a["n"], b["n"]) and b["n"] <= a["most"] and a["n"] <= b["most"]}
    apart = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a["bits"], b["bits"]))
    want = {(i, j) for i, j in possible if 175 * apart(rows[i], rows[j]) <= 175 * (rows[i]["m"] + rows[j]["m"]) - 150 * (rows[i]["n"] + rows[j]["n"])}
    for blocks in (1, 3):
        total, got = 0, []
        for key in range(8):
            held = [[r for r in rows if key in r["keys"] and r["node"] % blocks == b] for b in range(blocks)]
            for lo in range(blocks):
                for hi in range(lo, blocks):
                    if held[lo] and held[hi]:
                        a = minhash.Nodes(held[lo])
                        b = a if lo == hi else minhash.Nodes(held[hi])
                        found, compared = minhash.may_link(a, b, key, lo == hi)
                        total += compared
                        got += [tuple(sorted((a.rows[i]["node"], b.rows[j]["node"]))) for i, j in found]
        assert total == len(possible)
        assert len(got) == len(set(got)) and set(got) == want


def test_group_just_below_the_threshold(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TILE", 60)  # the group's buckets are dealt out in tiles
    texts = near_threshold(150) + near_threshold(60, changes=6, seed=22)
    assert result(minhash.near_duplicates(frame(spark, texts, extra=False))) == brute(dict(enumerate(texts)))
