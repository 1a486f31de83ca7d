import hashlib
import itertools
import random
import re

from siftwork.llm import common, substring_dedup as s

from .helpers import HOSTILE, frame, with_null_id


def brute(texts):
    first, out = {}, {}
    for i in sorted(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[i] or "")
        gone = [False] * len(w)
        for k in range(len(w) - s.WINDOW + 1):
            if first.setdefault(tuple(w[k : k + s.WINDOW]), i) < i:
                gone[k : k + s.WINDOW] = [True] * s.WINDOW
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


def run(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in s.remove_repeats(df).collect()}


def test_difference_cover():
    assert s.SEED + s.PERIOD - 1 == s.WINDOW
    for i, j in itertools.product(range(s.PERIOD), repeat=2):
        assert any((i + d) % s.PERIOD in s.COVER and (j + d) % s.PERIOD in s.COVER for d in range(s.PERIOD))


def test_planted_passages(spark):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(5000)}"
    passages = [[word() for _ in range(n)] for n in (12, 13, 14, 20, 60)]
    texts = []
    for i in range(80):
        w = [word() for _ in range(rng.randrange(120))]
        for p in rng.sample(passages, rng.randrange(4)):
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        texts.append(rng.choice([" ", "  ", "\n"]).join(w))
    texts += ["a b " * 40, "a b " * 30, texts[3], texts[3], texts[5] + " tail"]
    assert run(frame(spark, texts)) == brute(dict(enumerate(texts)))


def test_small_groups_agree(spark, monkeypatch):
    texts = dict(common.table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect())
    assert run(common.table(spark, "/root/testdata/sf0.001", "documents").repartition(7)) == brute(texts)


def test_hostile(spark):
    df = frame(spark)
    assert run(df) == brute(dict(enumerate(HOSTILE)))
    rows = s.remove_repeats(with_null_id(df.unionAll(df))).collect()
    want = brute(dict(enumerate(HOSTILE)))
    assert len(rows) == 2 * len(HOSTILE) + 3
    assert all((r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id] for r in rows if r.doc_id is not None)
    assert all(r.n_removed == 0 for r in rows if r.doc_id is None)
    assert s.remove_repeats(df.limit(0)).count() == 0


def test_parts_follow_the_text_whatever_the_input_is():
    assert common.parts_by(None, s.PART_BYTES, s.LEAST_PARTS) == common.parts_by(1 << 20, s.PART_BYTES, s.LEAST_PARTS) == s.LEAST_PARTS
    for size in (1 << 40, 100 << 40):  # a part never grows
        assert size / common.parts_by(size, s.PART_BYTES, s.LEAST_PARTS) <= s.PART_BYTES


def test_an_input_without_statistics(spark):
    texts = ["a b c d e f g h i j k l m n", "x a b c d e f g h i j k l m n y"]
    rdd = spark.sparkContext.parallelize(list(enumerate(texts)), 2)
    assert run(spark.createDataFrame(rdd, "doc_id long, text string")) == brute(dict(enumerate(texts)))
