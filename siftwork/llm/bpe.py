"""Byte-level BPE encoding and decoding by tree reduction.

The encodings of texts form a monoid under join: a text is halved until its pieces have LEAF characters at most,
the pieces are encoded, and neighbours are joined up the tree. A join encodes anew only a window around the
boundary, grown on either side in doubling steps until it reaches a fixed point, where tokens outside are final:
- after a letter that no letter follows, and after a digit that none follows: no match of the pattern (public_tokenizers.PATTERN) goes on from a
  letter or digit to anything else, so whatever match holds it ends there;
- before a blank after a character that isn't white space: a blank stands only first in a match or in a run of white space.
At a fixed point some match always ends; it would have ended there at the end of a text too, and matching goes on from
there without looking back. Encoding therefore distributes over the cut, and the result equals that of encoding the text at
once. A side without a fixed point is one run of letters, digits, marks or white space, a single match, and is taken whole.

Decoding concatenates bytes up the tree.

Defined cases: null text is empty (no tokens); null doc_id is kept; texts of any length and content; repeated rows are encoded one by
one and kept; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

VOCABULARY, LEAF, WINDOW = "byte_bpe_multi_50k.tiktoken", 1024, 64
#: A fixed point is where this matches: the place before its match, one character of context on either side.
FIXED = regex.compile(r"(?<=\p{L})(?=[^\p{L}])|(?<=\p{N})(?=[^\p{N}])|(?<=\S)(?= )")
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
DIGESTS_DDL = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


class TreeCodec:
    def __init__(self, path: str, leaf: int = LEAF):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        self.flat = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.leaf = leaf

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf:
            return self.flat.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._encode(text, lo, mid), self._encode(text, mid, hi))

    @staticmethod
    def _fixed_before(text: str, lo: int, mid: int) -> int:
        """The last fixed point between lo and mid; lo if there is none."""
        width, at = WINDOW, mid
        while at > lo:
            at, seen = max(lo, mid - width), at
            found = [m.start() for m in FIXED.finditer(text, max(lo, at - 1), min(mid, seen + 1)) if lo < m.start() < mid]
            if found:
                return found[-1]
            width *= 2
        return lo

    @staticmethod
    def _fixed_after(text: str, mid: int, hi: int) -> int:
        """The first fixed point after mid; hi if there is none."""
        width, at = WINDOW, mid
        while at < hi:
            seen, at = at, min(hi, mid + width)
            found = next((m.start() for m in FIXED.finditer(text, max(mid, seen - 1), at) if mid < m.start()), None)
            if found is not None:
                return found
            width *= 2
        return hi

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        a, b = self._fixed_before(text, lo, mid), self._fixed_after(text, mid, hi)
        encode = self.flat.encode_ordinary
        keep = len(left) - len(encode(text[a:mid]))
        skip = len(encode(text[mid:b]))
        return left[:keep] + encode(text[a:b]) + right[skip:]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return self.flat.decode_bytes(ids)
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


_CODECS: dict[tuple[str, int], TreeCodec] = {}


def codec(path: str, leaf: int = LEAF) -> TreeCodec:
    if (path, leaf) not in _CODECS:
        _CODECS[path, leaf] = TreeCodec(path, leaf)
    return _CODECS[path, leaf]


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and the ids of each text."""
    path = vocabulary or c.tokenizer_path(VOCABULARY)

    def run(batches):
        own = codec(path)
        for batch in batches:
            for part, texts in c.grouped(batch):
                yield c.rows_of(IDS, [part.column("doc_id").to_pylist(), [own.encode((t or b"").decode()) for t in texts]])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and the decoded bytes of each row's ids (null: none)."""
    path = vocabulary or c.tokenizer_path(VOCABULARY)
    schema = pa.schema([("doc_id", pa.int64()), ("decoded", pa.binary())])

    def run(batches):
        own = codec(path)
        for batch in batches:
            yield c.rows_of(schema, [batch.column("doc_id").to_pylist(), [own.decode(x or []) for x in batch.column("ids").to_pylist()]])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded binary")


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes, without sending ids out of the worker."""
    path = vocabulary or c.tokenizer_path(VOCABULARY)

    def run(batches):
        own = codec(path)
        for batch in batches:
            for part, texts in c.grouped(batch):
                out: list[list] = [part.column("doc_id").to_pylist(), [], [], []]
                for t in texts:
                    ids = own.encode((t or b"").decode())
                    out[1].append(len(ids))
                    out[2].append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                    out[3].append(hashlib.sha256(own.decode(ids)).hexdigest())
                yield c.rows_of(DIGESTS, out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DIGESTS_DDL)


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(c.table(spark, sf_dir, "documents"))
