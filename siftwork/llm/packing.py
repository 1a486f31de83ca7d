"""Packing along a Hilbert curve.

Each document is tokenized and gets a hashed vector: its token ids counted in BUCKETS buckets, square-rooted and
normed. A fixed random projection takes it to DIMS dimensions; these are centred and scaled by their mean and deviation over all documents, as
counts are never negative and would else share one corner of the space. The cell on a grid of 2**BITS steps a side gives the Hilbert key. Documents are range-partitioned by (key, doc_id), so that a large group of equal documents is
spread over partitions too, and sorted by it; each partition is cut into sequences of LENGTH tokens in that order,
so neighbours on the curve share sequences. What is left at a partition's end is dealt to sequences whose sizes
are the powers of two that sum to it; those need no padding.

Tokenized documents are written to the shared folder first, so that range sampling does not tokenize again and
ids are computed once; a lost executor costs the re-reading of its files.

Words between blanks are encoded once for each worker and remembered (MEMO of them): the tokenizer drops white
space and never looks across it.

Defined cases: null or empty text is the end id alone; repeated rows are packed once each; null doc_id is kept as
null; extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

LENGTH, END_ID, VOCABULARY = 2048, 1, "word_bpe_49k.json"
BUCKETS, DIMS, BITS, SEED = 256, 3, 10, 20240501
MEMO = 1_000_000
AXES = [f"p{i}" for i in range(DIMS)]
TOKENS = pa.schema([("doc_id", pa.int64()), *((a, pa.float64()) for a in AXES), ("ids", pa.binary())])
TOKENS_DDL = "doc_id bigint, " + ", ".join(f"{a} double" for a in AXES) + ", ids binary"
PIECES = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_tokens", pa.int64()), ("sequence_length", pa.int64())]
PIECES_DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, sequence_tokens bigint, sequence_length bigint"
#: ASCII marks (but the apostrophe), of which the tokenizer makes words of their own after a word that still ends with a letter or
#: digit once it is lower-cased (İ becomes i and a combining dot).
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class WordEncoder:
    """Texts -> packed ids, with a bounded memory of words."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocabulary = self.tok.get_vocab(with_added_tokens=True)
        self.kind = "<u2" if max(vocabulary.values()) < 1 << 16 else "<u4"
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}

    def raw(self, words: list[str]) -> None:
        """Adds words to the memory, many in one call. Words of letters only end with the one id that ends a word, by
        which the ids of a joined text are told apart; if they can't be, and for all others, each word is encoded alone."""
        plain = [w for w in words if w.isalpha()]
        alone = [w for w in words if not w.isalpha()]
        lots = [plain[i : i + 1000] for i in range(0, len(plain), 1000)]
        for some, coded in zip(lots, self.tok.encode_batch_fast([" ".join(x) for x in lots], add_special_tokens=False) if lots else []):
            ids = np.array(coded.ids, np.int64)
            last = np.flatnonzero(self.ends[ids]) + 1 if len(ids) else np.empty(0, np.int64)
            if len(last) != len(some) or last[-1] != len(ids):
                alone += some
                continue
            blob, ends = ids.astype(self.kind).tobytes(), (last * np.dtype(self.kind).itemsize).tolist()
            self.words.update(zip(some, [blob[a:b] for a, b in zip([0, *ends], ends)]))
        for w, e in zip(alone, self.tok.encode_batch_fast(alone, add_special_tokens=False) if alone else []):
            self.words[w] = np.array(e.ids, self.kind).tobytes()

    def learn(self, words: set[str]) -> None:
        if len(self.words) > MEMO:
            self.words.clear()
        known, need, made = self.words, {}, []
        for w in words.difference(known):
            if w.isalpha():
                head, tail = w, ""
            else:
                head = w.rstrip(MARKS)
                tail = w[len(head) :]
                if not tail or "<|" in w or not head[-1:].lower().isalnum():
                    need[w] = None
                    continue
                need[tail] = None
            if head.isascii():
                head = head.lower()
            need[head] = None
            if tail or head != w:
                made.append((w, head, tail))
        known[""] = b""
        self.raw([w for w in need if w not in known])
        for w, head, tail in made:
            known[w] = known[head] + known[tail]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        self.learn(set(chain.from_iterable(split)))
        get = self.words.__getitem__
        return [b"".join(map(get, ws)) for ws in split]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index along the Hilbert curve of each row of cells (n, dims), each cell below 2**bits."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotations, from the coarsest level on
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[n - 1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def projected(docs: list[np.ndarray]) -> np.ndarray:
    """(n, DIMS) coordinates of each document's ids."""
    project = np.random.default_rng(SEED).standard_normal((BUCKETS, DIMS))
    counts = np.stack([np.bincount((d.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24), minlength=BUCKETS) for d in docs])
    v = np.sqrt(counts)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v @ project


def cells(at: np.ndarray, mean: np.ndarray, dev: np.ndarray) -> np.ndarray:
    """Grid cells of coordinates, three deviations to either side of the mean."""
    z = (at - mean) / np.maximum(dev, 1e-9)
    return np.clip((z + 3) / 6 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def keyed(tokens: DataFrame) -> DataFrame:
    """tokens with the Hilbert key of their coordinates, centred over the whole table."""
    figures = tokens.agg(*[f(a) for f in (F.avg, F.stddev_pop) for a in AXES]).first()
    mean, dev = np.array([x or 0.0 for x in figures]).reshape(2, DIMS)

    def key(*axes: pd.Series) -> pd.Series:
        return pd.Series(hilbert(cells(np.stack([a.to_numpy() for a in axes], 1), mean, dev)))

    return tokens.withColumn("key", F.pandas_udf(key, "bigint")(*AXES)).select("doc_id", "key", "ids")


def tokenized(path: str, end_id: int):
    def run(batches):
        enc = encoder(path)
        end = np.array([end_id], enc.kind).tobytes()
        for batch in batches:
            for part, texts in c.grouped(batch):
                blobs = [b + end for b in enc.encode([t.decode() if t else "" for t in texts])]
                at = projected([np.frombuffer(b, enc.kind) for b in blobs])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(at[:, i]) for i in range(DIMS)), pa.array(blobs, pa.binary())], schema=TOKENS)

    return run


def powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def packed(length: int, kind: str, with_ids: bool):
    schema = pa.schema(PIECES + ([("ids", pa.binary())] if with_ids else []))
    width = np.dtype(kind).itemsize

    def run(batches):
        task = TaskContext.get().partitionId() << 33
        sequence, held, fill, out = 0, [], 0, []

        def close(pieces, size):
            nonlocal sequence
            padded = size if size & (size - 1) == 0 else length
            at = 0
            for doc_id, start, blob, total in pieces:
                n = len(blob) // width
                row = (doc_id, start, n, zlib.crc32(np.frombuffer(blob, kind).astype("<u4").tobytes()), total, task + sequence, at, size, padded)
                out.append(row + (blob,) if with_ids else row)
                at += n
            sequence += 1

        for batch in batches:
            for doc_id, blob in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                total = len(blob) // width
                start = 0
                while start < total:
                    n = min(length - fill, total - start)
                    held.append((doc_id, start, blob[start * width : (start + n) * width], total))
                    start, fill = start + n, fill + n
                    if fill == length:
                        close(held, length)
                        held, fill = [], 0
            if out:
                yield c.rows_of(schema, list(zip(*out)))
                out = []
        for size in powers(fill):
            pieces, need = [], size
            while need:
                doc_id, start, blob, total = held.pop(0)
                n = min(need, len(blob) // width)
                pieces.append((doc_id, start, blob[: n * width], total))
                if n * width < len(blob):
                    held.insert(0, (doc_id, start + n, blob[n * width :], total))
                need -= n
            close(pieces, size)
        if out:
            yield c.rows_of(schema, list(zip(*out)))

    return run


def pack(docs: DataFrame, length: int = LENGTH, end_id: int = END_ID, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens (ids in the
    sequence), sequence_length (with padding) and, if asked for, ids (packed little-endian)."""
    path = vocabulary or c.tokenizer_path(VOCABULARY)
    kind = encoder(path).kind
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    tokens = c.cut(docs.mapInArrow(tokenized(path, end_id), TOKENS_DDL), "op1-tokens")
    ordered = keyed(tokens).repartitionByRange(c.parts_for(tokens), "key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
    return ordered.mapInArrow(packed(length, kind, with_ids), PIECES_DDL + (", ids binary" if with_ids else ""))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(c.table(spark, sf_dir, "documents"))
