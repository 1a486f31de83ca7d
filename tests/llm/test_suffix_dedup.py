import hashlib
import random

import numpy as np

from siftwork.llm import common, suffix_dedup as s

from .helpers import HOSTILE, frame, with_null_id


def brute(texts):
    first, out = {}, {}
    for i in sorted(texts):
        b = (texts[i] or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - s.WINDOW + 1):
            if first.setdefault(b[k : k + s.WINDOW], i) < i:
                gone[k : k + s.WINDOW] = b"\1" * s.WINDOW
        spans = sum(g and not p for p, g in zip(b"\0" + gone, gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def run(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in s.remove_repeats(df).collect()}


def test_suffix_array_against_sorting():
    rng = random.Random(13)
    for _ in range(300):
        n = rng.randrange(0, 80)
        t = [rng.randrange(1, rng.choice([2, 3, 5, 200])) for _ in range(n)]
        if rng.random() < 0.3 and n:
            t = (t[: rng.randrange(1, n + 1)] * n)[:n]
        assert s.suffix_array(np.array(t, np.int64), 10**9).tolist() == sorted(range(n), key=lambda i: t[i:])


def test_bounded_suffix_array_keeps_equal_prefixes_together():
    rng = random.Random(14)
    base = bytes(rng.randrange(97, 100) for _ in range(400))
    t = b"".join(base[a : a + rng.randrange(60, 200)] for a in (rng.randrange(300) for _ in range(60)))
    sa = s.suffix_array(np.frombuffer(t, np.uint8).astype(np.int64) + 1, s.WINDOW + 4)
    assert sorted(sa.tolist()) == list(range(len(t)))
    prefixes = [t[i : i + s.WINDOW] for i in sa.tolist()]
    assert prefixes == sorted(prefixes)


def test_a_sketch_depends_on_its_window_alone():
    rng = random.Random(15)
    b = bytes(rng.randrange(256) for _ in range(3000))
    got = s.sketches(b)
    assert len(got) == len(b) - s.WINDOW + 1
    assert all(s.sketches(b[i : i + s.WINDOW])[0] == got[i] for i in range(0, len(got), 7))
    assert len(np.unique(got)) > len(got) / 40


def test_planted_passages(spark):
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passages = [letters(n) for n in (30, 44, 48, 49, 50, 51, 60, 300)]
    texts = []
    for i in range(90):
        t = letters(rng.randrange(200))
        for p in rng.sample(passages, rng.randrange(4)):
            at = rng.randrange(len(t) + 1)
            t = t[:at] + p + t[at:]
        texts.append(t)
    texts += ["ab" * 40, "ab" * 30, "ba" * 25, texts[3], texts[3], texts[5] + " tail", texts[7][:-1] + "x"]
    got = run(frame(spark, texts))
    assert got == brute(dict(enumerate(texts)))
    assert sum(x[1] > 0 for x in got.values()) > 20


def test_large_buckets_are_taken_window_by_window(spark, monkeypatch):
    monkeypatch.setattr(s, "BUCKET", 3)
    rng = random.Random(10)
    letters = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    short, longer = letters(40), letters(56)
    texts = [letters(60) + rng.choice([short, longer]) + letters(60) for _ in range(60)] + [letters(60)] * 3
    texts += [texts[0][5:90] + letters(9), letters(5) + texts[1][20:]]
    assert run(frame(spark, texts)) == brute(dict(enumerate(texts)))


def test_given_table(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    assert run(docs.repartition(7)) == brute(dict(docs.select("doc_id", "text").collect()))


def test_hostile(spark):
    df = frame(spark)
    want = brute(dict(enumerate(HOSTILE)))
    assert run(df) == want
    rows = s.remove_repeats(with_null_id(df.unionAll(df))).collect()
    assert len(rows) == 2 * len(HOSTILE) + 3
    assert all((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id] for r in rows if r.doc_id is not None)
    assert all(r.n_removed == 0 for r in rows if r.doc_id is None)
    assert s.remove_repeats(df.limit(0)).count() == 0
    two = spark.createDataFrame([(1, "x" * 80), (2, "y" * 70), (2, "x" * 60)], "doc_id long, text string")  # a doc_id of two texts
    assert sorted((r.doc_id, r.n_bytes, r.n_removed) for r in s.remove_repeats(two).collect()) == [(1, 80, 0), (2, 60, 60), (2, 70, 0)]
