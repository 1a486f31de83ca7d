"""Substring dedup with difference-cover anchors.

A window of WINDOW words is removed if its word sequence also starts in a document with a smaller id.
Instead of hashing every window of the corpus, only the SEED-word windows at positions whose residue modulo
PERIOD lies in COVER are hashed. COVER is a difference cover: for any two positions i and j there is a shift
d < PERIOD with both (i+d) and (j+d) mod PERIOD in COVER. Since WINDOW = SEED + PERIOD - 1, two equal windows
at i and j hold the same seed at i+d and j+d, and both places are hashed. Hence:

1. anchors that occur in two documents are found by an exchange of seed hashes;
2. a window is looked at only if it contains such a shared anchor: it is extended to its full WINDOW words,
   hashed to 96 bits and exchanged, giving the windows that also start in a smaller document.

Both exchanges collect SEND_HASHES hashes of a task and send, for each part that some of them belong to, one row with them packed: never more rows
than hashes. What repeats within such a group is decided there and never sent, so a passage in a third of all documents costs an entry
per group and not per document. A part holds the hashes of about PART_BYTES of text at any size of the corpus.

Defined cases: null text has no words; rows with null doc_id neither remove nor lose words; rows that share a
doc_id count as one document (an equal id isn't smaller); an empty table gives no rows; extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
SEED = WINDOW - PERIOD + 1
#: Hash parts follow the input's size alone: a document gets a row from each part that finds some of its hashes.
LEAST_PARTS, PART_BYTES = 64, 64 << 20
#: Hashes of a group that is sent at once; it holds SEND_DOCS documents at most, so that their numbers fit 16 bits.
SEND_HASHES, SEND_DOCS = 1 << 20, 60_000
MULTI = 0xFFFF  # an entry whose hash is shared within its group already
PARTS = pa.schema([("route", pa.int32()), ("direct", pa.bool_()), ("h", pa.binary()), ("g", pa.binary()), ("d", pa.binary()), ("ids", pa.binary())])
PARTS_DDL = "route int, direct boolean, h binary, g binary, d binary, ids binary"
FOUND = pa.schema([("doc_id", pa.int64()), ("found", pa.binary())])
FOUND_DDL = "doc_id bigint, found binary"
PLAN = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("text", pa.binary()), ("runs", pa.binary()), ("kept_sha256", pa.string())])
PLAN_DDL = "doc_id bigint, n_words bigint, text binary, runs binary, kept_sha256 string"
KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string())])
KEPT_DDL = "doc_id bigint, n_words bigint, n_removed bigint, kept string, removed array<struct<start: bigint, end: bigint>>, kept_sha256 string"


def at_cover(pos: np.ndarray) -> np.ndarray:
    return np.isin(pos % PERIOD, COVER)


def hashed(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts on end, and each text's number of words."""
    words = [t.split() if t else [] for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    return (np.concatenate([c.word_hashes(w) for w in words]) if len(words) else np.empty(0, np.uint64)), counts


def send(h: np.ndarray, g: np.ndarray | None, d: np.ndarray, ids: np.ndarray, parts: int, smallest: bool) -> list[tuple]:
    """Rows for the exchange. d: numbers of documents, ascending with their id. smallest: those that aren't the group's
    smallest holder of a hash are found (a window to remove); else all are, if there are two (a shared anchor)."""
    order = np.lexsort((d, h) if g is None else (d, g, h))
    h, d = h[order], d[order]
    g = None if g is None else g[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    if g is not None:
        new[1:] |= g[1:] != g[:-1]
    once = new.copy()
    once[1:] |= d[1:] != d[:-1]
    h, d, new = h[once], d[once], new[once]
    g = None if g is None else g[once]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, len(h)))
    rest = ~new if smallest else np.repeat(sizes > 1, sizes)
    rows = []
    if rest.any():
        rows.append((int(ids[d[rest][0]]) % parts, True, h[rest].tobytes(), None, d[rest].astype("<u2").tobytes(), ids.tobytes()))
    hs, ds = h[starts], d[starts].astype("<u2")
    gs = None if g is None else g[starts]
    if not smallest:
        ds[sizes > 1] = MULTI
    route = (hs % np.uint64(parts)).astype(np.int64)
    order = np.argsort(route, kind="stable")
    dealt = route[order]
    firsts = np.flatnonzero(np.append(True, dealt[1:] != dealt[:-1])) if len(dealt) else np.empty(0, np.int64)
    for a, b in zip(firsts.tolist(), np.append(firsts[1:], len(dealt)).tolist()):
        at = order[a:b]
        used, local = np.unique(ds[at], return_inverse=True)
        known = used != MULTI
        # document numbers are dealt anew for the ids that this row really names
        names = ids[used[known].astype(np.int64)]
        local = np.where(ds[at] == MULTI, MULTI, local).astype("<u2")
        rows.append((int(dealt[a]), False, hs[at].tobytes(), None if gs is None else gs[at].tobytes(), local.tobytes(), names.tobytes()))
    return rows


class Group:
    """Hashes and ids of documents until there are enough to send."""

    def __init__(self, parts: int, smallest: bool):
        self.parts, self.smallest = parts, smallest
        self.clear()

    def clear(self) -> None:
        self.h, self.g, self.d, self.size, self.docs = [], [], [], 0, 0

    def add(self, h: np.ndarray, g: np.ndarray | None, d: np.ndarray, docs: int) -> bool:
        """Takes hashes with their doc_ids; whether there are enough."""
        self.h.append(h)
        self.d.append(d)
        if g is not None:
            self.g.append(g)
        self.size, self.docs = self.size + len(h), self.docs + docs
        return self.size >= SEND_HASHES or self.docs > SEND_DOCS - c.GROUP_DOCS

    def rows(self):
        if self.size:
            ids, number = np.unique(np.concatenate(self.d), return_inverse=True)
            sent = send(np.concatenate(self.h), np.concatenate(self.g) if self.g else None, number, ids, self.parts, self.smallest)
            self.clear()
            for i in range(0, len(sent), 1000):  # batches of bounded length
                yield c.rows_of(PARTS, list(zip(*sent[i : i + 1000])))


def meet(smallest: bool):
    """The receiving end of send(): per document, the hashes found."""

    def reduce(t: pa.Table) -> pa.Table:
        hs, gs, docs, multi, out_h, out_d = [], [], [], [], [], []
        for direct, h, g, d, ids in zip(*(t.column(n).to_pylist() for n in ("direct", "h", "g", "d", "ids"))):
            h, d, ids = np.frombuffer(h, "<u8"), np.frombuffer(d, "<u2"), np.frombuffer(ids, "<i8")
            many = (d == MULTI) if not direct else np.zeros(len(d), bool)
            own = np.where(many, -1, ids[np.where(many, 0, d)]) if len(ids) else np.full(len(d), -1)
            if direct:
                out_h.append(h)
                out_d.append(own)
            else:
                hs.append(h)
                docs.append(own)
                multi.append(many)
                if g is not None:
                    gs.append(np.frombuffer(g, "<u4"))
        if hs:
            h, d, many = np.concatenate(hs), np.concatenate(docs), np.concatenate(multi)
            g = np.concatenate(gs) if gs else None
            order = np.lexsort((d, h) if g is None else (d, g, h))
            h, d, many = h[order], d[order], many[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            if g is not None:
                g = g[order]
                new[1:] |= g[1:] != g[:-1]
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(h)))
            if smallest:
                keep = d > np.repeat(d[starts], sizes)
            else:
                last = np.append(starts[1:], len(h)) - 1
                shared = np.logical_or.reduceat(many, starts) | (d[starts] != d[last])
                keep = np.repeat(shared, sizes) & ~many
            out_h.append(h[keep])
            out_d.append(d[keep])
        if not out_h:
            return FOUND.empty_table()
        h, d = np.concatenate(out_h), np.concatenate(out_d)
        order = np.argsort(d, kind="stable")
        h, d = h[order], d[order]
        starts = np.flatnonzero(np.append(True, d[1:] != d[:-1])) if len(d) else np.empty(0, np.int64)
        ends = np.append(starts[1:], len(d))
        return pa.table([pa.array(d[starts], pa.int64()), pa.array([h[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], schema=FOUND)

    return reduce


def exchanged(sent: DataFrame, smallest: bool) -> DataFrame:
    """doc_id and the list of packed hashes found for it."""
    met = sent.groupBy("route").applyInArrow(meet(smallest), FOUND_DDL)
    return met.groupBy("doc_id").agg(F.collect_list("found").alias("found"))


def send_anchors(parts: int):
    def run(batches):
        group = Group(parts, False)
        for batch in batches:
            for part, texts in c.grouped(batch):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                w, counts = hashed(texts)
                counts_of = np.repeat(np.arange(len(counts)), counts)
                pos = c.ranges(counts)
                h = c.ngram_hashes(w, SEED)
                at = np.flatnonzero(at_cover(pos[: len(h)]) & (pos[: len(h)] + SEED <= counts[counts_of[: len(h)]]))
                if group.add(h[at], None, ids[counts_of[at]], len(texts)):
                    yield from group.rows()
        yield from group.rows()

    return run


def plan_windows(batches):
    """Per document the runs of window starts that hold a shared anchor; what has none is finished here."""
    for batch in batches:
        for part, texts in c.grouped(batch):
            out: list[list] = [[] for _ in PLAN]
            for doc_id, text, found in zip(part.column("doc_id").to_pylist(), texts, part.column("found").to_pylist()):
                words = (text or b"").split()
                runs = b""
                if found and len(words) >= WINDOW:
                    h = c.ngram_hashes(c.word_hashes(words), SEED)
                    shared = np.frombuffer(b"".join(found), "<u8")
                    at = np.flatnonzero(at_cover(np.arange(len(h))))
                    at = at[np.isin(h[at], shared)]
                    n = len(words) - WINDOW + 1
                    delta = np.zeros(n + 1, np.int64)
                    np.add.at(delta, np.clip(at - (PERIOD - 1), 0, n), 1)
                    np.add.at(delta, np.clip(at + 1, 0, n), -1)
                    on = np.cumsum(delta)[:n] > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
                    runs = edge.astype("<i4").tobytes()
                done = None if runs else hashlib.sha256(b" ".join(words)).hexdigest()
                for col, x in zip(out, (doc_id, len(words), text if runs else None, runs or None, done)):
                    col.append(x)
            yield c.rows_of(PLAN, out)


def window_hashes(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return c.ngram_hashes(w, WINDOW), (c.ngram_hashes(w, WINDOW, seed=1) >> np.uint64(32)).astype("<u4")


def send_windows(parts: int):
    def run(batches):
        group = Group(parts, True)
        for batch in batches:
            for part, texts in c.grouped(batch):
                full = False
                for doc_id, text, runs in zip(part.column("doc_id").to_pylist(), texts, part.column("runs").to_pylist()):
                    words = text.split()
                    for a, b in np.frombuffer(runs, "<i4").reshape(-1, 2).tolist():
                        h, g = window_hashes(c.word_hashes(words[a : b + WINDOW - 1]))
                        full |= group.add(h, g, np.full(len(h), doc_id), 0)
                    group.docs += 1
                if full or group.docs > SEND_DOCS - c.GROUP_DOCS:
                    yield from group.rows()
        yield from group.rows()

    return run


def removed_words(words: list[bytes], runs: bytes, found: list[bytes] | None) -> np.ndarray:
    """Which words a found window covers."""
    delta = np.zeros(len(words) + 1, np.int64)
    if found:
        gone = np.frombuffer(b"".join(found), "<u8")
        for a, b in np.frombuffer(runs, "<i4").reshape(-1, 2).tolist():
            h = c.ngram_hashes(c.word_hashes(words[a : b + WINDOW - 1]), WINDOW)
            at = a + np.flatnonzero(np.isin(h, gone))
            np.add.at(delta, at, 1)
            np.add.at(delta, at + WINDOW, -1)
    return np.cumsum(delta)[: len(words)] > 0


def cut_words(batches):
    for batch in batches:
        for part, texts in c.grouped(batch):
            out: list[list] = [[] for _ in KEPT]
            for doc_id, n, text, runs, found, done in zip(part.column("doc_id").to_pylist(), part.column("n_words").to_pylist(), texts, *(part.column(x).to_pylist() for x in ("runs", "found", "kept_sha256"))):
                if done is not None:
                    row = (doc_id, n, 0, None, [], done)
                else:
                    words = text.split()
                    gone = removed_words(words, runs, found)
                    kept = b" ".join([x for x, g in zip(words, gone.tolist()) if not g])
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).reshape(-1, 2)
                    row = (doc_id, n, int(gone.sum()), kept, [{"start": int(a), "end": int(b)} for a, b in edge], hashlib.sha256(kept).hexdigest())
                for col, x in zip(out, row):
                    col.append(x)
            yield c.rows_of(KEPT, out)


def planned(docs: DataFrame, parts: int) -> DataFrame:
    known = docs.filter("doc_id is not null and text is not null")
    shared = exchanged(known.mapInArrow(send_anchors(parts), PARTS_DDL), smallest=False)
    return c.cut(docs.join(shared, "doc_id", "left").mapInArrow(plan_windows, PLAN_DDL), "op5-plan")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (null if nothing was removed or looked at: the words
    joined by a space), removed (word spans) and kept_sha256."""
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    parts = c.parts_by(docs.agg(F.sum(F.octet_length("text"))).first()[0], PART_BYTES, LEAST_PARTS)
    plan = planned(docs, parts)
    windows = plan.filter("runs is not null").select("doc_id", "text", "runs")
    gone = exchanged(windows.mapInArrow(send_windows(parts), PARTS_DDL), smallest=True)
    return plan.join(gone, "doc_id", "left").mapInArrow(cut_words, KEPT_DDL)


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(c.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
