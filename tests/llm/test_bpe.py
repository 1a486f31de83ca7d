import hashlib
import random
import time

from siftwork.llm import bpe, common

from .helpers import HOSTILE, frame, with_null_id


def test_tree_equals_flat():
    own = bpe.TreeCodec(common.tokenizer_path(bpe.VOCABULARY), leaf=3)
    rng = random.Random(5)
    texts = [t or "" for t in HOSTILE if len(t or "") < 6000]
    texts += ["".join(rng.choice(" \n\t'slleab1é!日  ") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["".join(rng.choice("ab日本語。、１2٣'s\u0301é-\u3000 \n") for _ in range(rng.randrange(200))) for _ in range(2000)]
    texts += ["日本語の。文" * 400, "x" * 3000, "1" * 700, "。" * 500, "\u3000" * 300 + "a", "a" + " " * 500 + "b", "'s" * 300, "don't" * 200]
    for t in texts:
        ids = own.encode(t)
        assert ids == own.flat.encode_ordinary(t), t
        assert own.decode(ids) == t.encode()


def test_query_on_tables(spark, sf):
    own = bpe.codec(common.tokenizer_path(bpe.VOCABULARY))
    texts = dict(common.table(spark, sf, "documents").select("doc_id", "text").collect())
    got = bpe.query(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = own.flat.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


def test_hostile(spark):
    df = with_null_id(frame(spark))
    encoded = bpe.encode(df)
    for r in bpe.decode(encoded).filter("doc_id is not null").collect():
        assert bytes(r.decoded) == (HOSTILE[r.doc_id] or "").encode()
    assert bpe.round_trip(df).count() == len(HOSTILE) + 3
    assert bpe.round_trip(df.limit(0)).count() == 0


def test_time_without_blanks():
    own = bpe.codec(common.tokenizer_path(bpe.VOCABULARY))
    text = "日本語のテキスト、とても長い。" * 14_000
    best = lambda f: min(_seconds(f) for _ in range(3))
    flat, tree = best(lambda: own.flat.encode_ordinary(text)), best(lambda: own.encode(text))
    assert own.encode(text) == own.flat.encode_ordinary(text)
    assert tree < 4 * flat + 0.05, (flat, tree)


def _seconds(f):
    start = time.perf_counter()
    f()
    return time.perf_counter() - start
