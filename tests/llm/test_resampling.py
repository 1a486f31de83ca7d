import hashlib
import math
import re
import zlib

from siftwork.llm import common, resampling as r

from .helpers import HOSTILE, frame, with_null_id

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans(r.UPPER, r.LOWER)


def features(text, ngram=1, of=r.BUCKETS):
    w = WORD.findall((text or "").translate(LOW))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % of for n in range(1, ngram + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, ngram=1, of=r.BUCKETS, percent=r.DRAWN_PERCENT, min_words=r.MIN_WORDS):
    s, t = [0] * of, [0] * of
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in features(x, ngram, of)[1]:
                counts[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + of) / ((a + 1) * (sum(t) + of)))) for a, b in zip(s, t)]
    rows, able = [], []
    for i, x in docs:
        n, bs = features(x, ngram, of)
        w = sum(gain[b] for b in bs)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
            score = w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
            if n >= min_words:
                able.append((-score, i, -len(bs)))
        rows.append((i, len(bs), w, score))
    able.sort()
    rank = {}
    for k, key in enumerate(able[: len(able) * percent // 100]):
        rank.setdefault(key, []).append(k + 1)
    return sorted([(*row, rank.get((-row[3], row[0], -row[1]), [None]).pop(0) if row[3] is not None and rank.get((-row[3], row[0], -row[1])) else None) for row in rows], key=str)


def run(docs, target, **more):
    return sorted([tuple(x) for x in r.resample(docs, target, **more).collect()], key=str)


def test_given_table(spark):
    sf = "/root/testdata/sf0.001"
    docs, target = common.table(spark, sf, "documents"), common.table(spark, sf, "benchmark")
    got = run(docs, target)
    assert got == brute([tuple(x) for x in docs.select("doc_id", "text").collect()], [x.text for x in target.collect()])
    assert sum(x[4] is not None for x in got) > 10


def test_longer_runs_and_few_buckets(spark):
    sf = "/root/testdata/sf0.001"
    docs, target = common.table(spark, sf, "documents").limit(60), common.table(spark, sf, "benchmark")
    want = brute([tuple(x) for x in docs.select("doc_id", "text").collect()], [x.text for x in target.collect()], 3, 50, 50, 5)
    assert run(docs, target, ngram=3, of=50, percent=50, min_words=5) == want


def test_hostile(spark):
    target = spark.createDataFrame([(None, 1), ("one two three w5x5 same", 2), ("", 3)], "text string, weight int")
    df = frame(spark)
    twice = with_null_id(df).unionAll(df).cache()
    want = brute([tuple(x) for x in twice.select("doc_id", "text").collect()], [x.text for x in target.collect()], percent=60)
    assert run(twice, target, percent=60) == want
    assert any(x[0] is None for x in want)
    empty = target.limit(0)
    assert run(df, empty, percent=60) == brute(list(enumerate(HOSTILE)), [], percent=60)
    assert run(df.limit(0), target) == []
