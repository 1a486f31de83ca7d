import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from siftwork.llm import common, packing

from .helpers import HOSTILE, frame, with_null_id


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(common.tokenizer_path(packing.VOCABULARY))


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def check(pieces, texts, tok):
    want = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(want)
    for i, ids in want.items():
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == crc(ids[at : at + p.length])
            at += p.length
        assert at == len(ids)
    padding = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 2048 and ps[0].sequence_tokens == at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_pieces(spark, tok, sf):
    df = common.table(spark, sf, "documents")
    check(packing.pack(df).collect(), dict(df.select("doc_id", "text").collect()), tok)


def test_hostile(spark, tok):
    check(packing.pack(frame(spark)).collect(), dict(enumerate(HOSTILE)), tok)
    assert packing.pack(frame(spark).limit(0)).count() == 0
    rows = packing.pack(with_null_id(frame(spark)), with_ids=True).collect()
    assert sum(r.doc_id is None for r in rows) >= 3
    assert all(len(r.ids) == 2 * r.length for r in rows)


def test_memory_limit(monkeypatch, tok):
    monkeypatch.setattr(packing, "MEMO", 3)
    enc = packing.WordEncoder(common.tokenizer_path(packing.VOCABULARY))
    texts = [t or "" for t in HOSTILE]
    for t in texts + texts:
        assert np.frombuffer(enc.encode([t])[0], enc.kind).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_words_in_any_mixture(tok):
    rng = random.Random(1)
    enc = packing.WordEncoder(common.tokenizer_path(packing.VOCABULARY))
    texts = ["".join(rng.choice("aZé1.'#_-<|> \n²İßǅ日\u0301%") for _ in range(rng.randrange(30))) for _ in range(10_000)]
    want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, enc.kind).tolist() for b in enc.encode(texts)] == want


def test_hilbert_is_a_curve():
    side = 8
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    keys = packing.hilbert(cells, 3)
    assert sorted(keys) == list(range(side**3))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_neighbours_share_sequences(spark):
    a, b = "alpha beta gamma delta " * 50, "uno dos tres cuatro cinco " * 50
    df = frame(spark, [a if i % 2 else b for i in range(40)])
    rows = packing.pack(df).collect()
    order = [r.doc_id % 2 for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)) if r.start == 0]
    assert sum(x != y for x, y in zip(order, order[1:])) <= 6


def test_curve_keeps_like_documents_together(spark, tok):
    """Documents over four vocabularies: neighbours along the curve share one far more often than chance, and the grid is used."""
    rng = random.Random(3)
    words = [["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)] for _ in range(4)]
    texts = [" ".join(rng.choice(words[i % 4]) for _ in range(80)) for i in range(400)]
    rows = [r for r in packing.pack(frame(spark, texts)).collect() if r.start == 0]
    order = [r.doc_id % 4 for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset))]
    assert sum(x == y for x, y in zip(order, order[1:])) > 0.8 * len(order)
    enc = packing.WordEncoder(common.tokenizer_path(packing.VOCABULARY))
    at = packing.projected([np.frombuffer(b, enc.kind) for b in enc.encode(texts)])
    cell = packing.cells(at, at.mean(0), at.std(0))
    assert (np.ptp(cell, axis=0) > 400).all()
