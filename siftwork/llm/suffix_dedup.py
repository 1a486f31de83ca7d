"""Suffix-array dedup: bytes under a WINDOW-byte string that also starts in a document with a smaller doc_id are removed.

A suffix matters only by its first WINDOW bytes, and equal windows must meet. Every window has a sketch that depends on its bytes alone, the
least hash of the GRAM-byte strings in it, and windows of one sketch lie side by side in runs, so a run of k windows travels as one string
of k + WINDOW - 1 bytes. Hence:

1. sketches that stand in one document only are settled: their windows have no equal elsewhere. Hashes are exchanged packed;
2. the runs of the other sketches are written. Equal runs are one string, with the smallest doc_id that holds it, so that a passage in a third of
   all documents is one row from then on;
3. the strings of one sketch are a bucket. For buckets of several strings a suffix array is built by the difference cover algorithm: sampled
   suffixes (positions modulo 3 of 1 and 2) are sorted by their triples and named, the names are sorted recursively, the remaining suffixes are
   sorted by their first letter and the rank of the next, and both are merged. Names that cover WINDOW bytes and more end the recursion. Adjacent
   prefixes are then compared, and those that agree in WINDOW bytes form the classes whose smallest document keeps its bytes. The array is
   distributed by bucket: Spark deals the buckets, and a task holds SORT_BYTES of them at a time;
4. a bucket of more than BUCKET strings (a short frequent string between ever different neighbours) is taken window by window instead, the
   smallest document of each by hash aggregation: exact, and no task gets such a bucket;
5. spans go back to their documents.

Windows are compared by their bytes in step 3. Strings and windows of hot buckets are told apart by 128 bits of hash.

Defined cases: null text is empty; rows with null doc_id neither remove nor lose bytes; rows that share a doc_id count as one document (an equal
id isn't smaller); texts of fewer than WINDOW bytes stay; an empty table gives no rows; extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c
from .substring_dedup import PARTS_DDL, Group, exchanged

WINDOW, GRAM = 50, 20
SPAN = WINDOW - GRAM + 1  # strings of GRAM bytes in a window
LEAST_PARTS, PART_BYTES = 64, 64 << 20
BUCKET, SORT_BYTES, BLOCK, MEMO = 4096, 1 << 20, 1 << 18, 500_000
RUNS = pa.schema([("doc_id", pa.int64()), ("t", pa.int64()), ("sketch", pa.int64()), ("sid", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("bytes", pa.binary())])
RUNS_DDL = "doc_id bigint, t bigint, sketch bigint, sid bigint, start int, windows int, bytes binary"
SPANS = pa.struct([("at", pa.int32()), ("n", pa.int32())])
SORTED = pa.schema([("sketch", pa.int64()), ("sid", pa.int64()), ("spans", pa.list_(SPANS))])
SORTED_DDL = "sketch bigint, sid bigint, spans array<struct<at: int, n: int>>"
KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("removed", pa.list_(SPANS)), ("kept", pa.binary()), ("kept_sha256", pa.string())])
KEPT_DDL = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, removed array<struct<at: int, n: int>>, kept binary, kept_sha256 string"
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def words8(b: bytes) -> np.ndarray:
    """The eight bytes from each position on, as numbers."""
    out = np.empty(max(0, len(b) - 7), np.uint64)
    for o in range(min(8, len(out))):
        out[o::8] = np.frombuffer(b, "<u8", (len(b) - o) // 8, o)
    return out


def sketches(b: bytes) -> np.ndarray:
    """The sketch of the window at each position."""
    n = len(b) - WINDOW + 1
    out = np.empty(max(0, n), np.uint64)
    for lo in range(0, n, BLOCK):  # blocks that stay in the processor's cache
        hi = min(n, lo + BLOCK)
        w = words8(b[lo : hi + WINDOW - 1])
        m = hi - lo + SPAN - 1
        h = w[:m] * _A
        h ^= h >> np.uint64(29)
        h += w[8 : 8 + m]
        h *= _B
        h ^= h >> np.uint64(31)
        h += w[GRAM - 8 : GRAM - 8 + m]
        h *= _C
        h ^= h >> np.uint64(32)
        h *= _A
        h ^= h >> np.uint64(29)
        size = 1
        while 2 * size <= SPAN:
            h = np.minimum(h[:-size], h[size:])
            size *= 2
        out[lo:hi] = np.minimum(h[: hi - lo], h[SPAN - size : SPAN - size + hi - lo])
    return out


def runs_of(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of equal entries."""
    starts = np.flatnonzero(np.append(True, s[1:] != s[:-1])) if len(s) else np.empty(0, np.int64)
    return starts, np.append(starts[1:], len(s))


def send_sketches(parts: int):
    """Distinct sketches of each document, for the exchange that finds those of two documents."""

    def run(batches):
        group = Group(parts, False)
        for batch in batches:
            for part, texts in c.grouped(batch):
                full = False
                for doc_id, text in zip(part.column("doc_id").to_pylist(), texts):
                    s = sketches(text)
                    s = np.unique(s[runs_of(s)[0]])
                    full |= group.add(s, None, np.full(len(s), doc_id), 1)
                if full:
                    yield from group.rows()
        yield from group.rows()

    return run


def shared_runs(batches):
    """Runs of windows whose sketch another document has too; the bytes of a string go along once in a task, as far as MEMO strings are
    remembered."""
    sent: set[int] = set()
    for batch in batches:
        for part, texts in c.grouped(batch):
            out: list[list] = [[] for _ in RUNS]
            for doc_id, t, text, found in zip(part.column("doc_id").to_pylist(), part.column("t").to_pylist(), texts, part.column("found").to_pylist()):
                s = sketches(text)
                starts, ends = runs_of(s)
                shared = np.unique(np.frombuffer(b"".join(found), "<u8"))
                ok = np.isin(s[starts], shared)
                starts, ends = starts[ok], ends[ok]
                strings: list[bytes | None] = [text[a : b + WINDOW - 1] for a, b in zip(starts.tolist(), ends.tolist())]
                n, sids = len(strings), [_signed(xxhash.xxh3_64_intdigest(x)) for x in strings]
                for i, sid in enumerate(sids):
                    if sid in sent:
                        strings[i] = None
                    elif len(sent) < MEMO:
                        sent.add(sid)
                for col, x in zip(out, ([doc_id] * n, [t] * n, s[starts].view(np.int64).tolist(), sids, starts.tolist(), (ends - starts).tolist(), strings)):
                    col += x
            yield c.rows_of(RUNS, out)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def suffix_array(t: np.ndarray, enough: int, covered: int = 1) -> np.ndarray:
    """Positions of t (numbers from 1 on) in the order of their suffixes, by the difference cover modulo 3. Letters stand for `covered`
    bytes; suffixes that agree in `enough` bytes may come in any order."""
    n = len(t)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: t[i:].tolist()), np.int64)
    x = np.concatenate((t, np.zeros(3, t.dtype))).astype(np.uint64)
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)  # where class 0 ends the text, class 1 gets an empty suffix
    sample = np.concatenate((one, two))
    names, count = named(_key(x[sample], x[sample + 1], x[sample + 2]))
    if count < len(sample) and 3 * covered < enough:
        order = suffix_array(names, enough, 3 * covered)
    else:
        order = np.argsort(names)
    rank = np.zeros(n + 3, np.uint64)
    rank[sample[order]] = np.arange(1, len(order) + 1) if count == len(sample) or 3 * covered < enough else names[order]
    sampled = sample[order]
    sampled = sampled[sampled < n]
    zero = np.arange(0, n, 3)
    width = np.uint64(int(rank.max()) + 1)
    key = x[zero] * width + rank[zero + 1]
    by = np.argsort(key)
    zero, key = zero[by], key[by]
    ones, twos = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(np.maximum.accumulate(x[ones] * width + rank[ones + 1]), key)
    letters = np.uint64(int(x.max()) + 1)
    if float(letters) * float(letters) * float(width) < 2.0**64:
        pair = lambda at: (x[at] * letters + x[at + 1]) * width + rank[at + 2]
        before += np.searchsorted(np.maximum.accumulate(pair(twos)), pair(zero))
    else:  # too wide for one number: name what is compared
        both = np.concatenate((twos, zero))
        got, _ = named(_key(x[both], x[both + 1], rank[both + 2]))
        before += np.searchsorted(np.maximum.accumulate(got[: len(twos)]), got[len(twos) :])
    out = np.empty(n, np.int64)
    at = np.arange(len(zero)) + np.maximum.accumulate(before)
    rest = np.ones(n, bool)
    rest[at] = False
    out[at], out[rest] = zero, sampled
    return out


def _key(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    """Triples as one number where they fit."""
    wb, wd = int(b.max(initial=0)) + 1, int(d.max(initial=0)) + 1
    return ((a * np.uint64(wb) + b) * np.uint64(wd) + d,) if (int(a.max(initial=0)) + 1) * wb * wd < 1 << 64 else (a, b, d)


def named(key: tuple[np.ndarray, ...]) -> tuple[np.ndarray, int]:
    """Each entry's rank among the distinct ones, from 1, and how many there are."""
    order = np.argsort(key[0]) if len(key) == 1 else np.lexsort(key[::-1])
    new = np.zeros(len(order), bool)
    for k in key:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) + 1
    return out, int(new.sum()) + 1 if len(order) else 0


def repeated(strings: list[bytes], first: np.ndarray) -> list[np.ndarray]:
    """For each string the window starts whose bytes also stand in a string of a smaller first."""
    text = b"".join(strings)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    sa = suffix_array(np.frombuffer(text, np.uint8).astype(np.int64) + 1, WINDOW + 4)
    owner, at = np.repeat(np.arange(len(strings)), sizes), c.ranges(sizes)
    sa = sa[at[sa] + WINDOW <= sizes[owner[sa]]]  # starts of whole windows
    w = words8(text + bytes(8))
    same = np.ones(max(0, len(sa) - 1), bool)
    for o in [*range(0, WINDOW - 7, 8), WINDOW - 8]:
        same &= w[sa[1:] + o] == w[sa[:-1] + o]
    starts = np.flatnonzero(np.append(True, ~same))
    least = np.repeat(np.minimum.reduceat(first[owner[sa]], starts), np.diff(np.append(starts, len(sa))))
    gone = sa[least < first[owner[sa]]]
    gone.sort()
    of = owner[gone]
    edges = np.searchsorted(of, np.arange(len(strings) + 1))
    return [at[gone[a:b]] for a, b in zip(edges[:-1], edges[1:])]


def spans(starts: np.ndarray) -> list[dict]:
    """Consecutive window starts as spans (at, number)."""
    if not len(starts):
        return []
    first = np.flatnonzero(np.append(True, np.diff(starts) > 1))
    return [{"at": int(a), "n": int(n)} for a, n in zip(starts[first], np.diff(np.append(first, len(starts))))]


def sort_buckets(batches):
    """Strings in order of their sketch: suffix arrays of whole buckets, SORT_BYTES and one bucket at a time at most."""
    held: list[tuple] = []
    size, last = 0, None

    def done():
        found = repeated([x[2] for x in held], np.array([x[3] for x in held], np.int64))
        rows = [(x[0], x[1], spans(g)) for x, g in zip(held, found) if len(g)]
        return c.rows_of(SORTED, list(zip(*rows)) if rows else [[], [], []])

    for batch in batches:
        for row in zip(*(batch.column(x).to_pylist() for x in ("sketch", "sid", "bytes", "first"))):
            if row[0] != last and size >= SORT_BYTES:
                yield done()
                held, size = [], 0
            held.append(row)
            size, last = size + len(row[2]), row[0]
    if held:
        yield done()


def repeated_strings(strings: DataFrame) -> DataFrame:
    """sketch, sid and the spans of window starts that stand in a smaller document, of strings(sketch, sid, bytes, first, often), a written table."""
    buckets = c.cut(strings.groupBy("sketch").agg(F.count("*").alias("size")).filter("size > 1"), "op13-buckets")
    several = c.cut(c.join_counted(strings, buckets, ["sketch"], "size", ["size"], ["sid"]), "op13-several")
    parts = c.parts_for(strings, 16 << 20)
    dealt = several.filter(F.col("size") <= BUCKET).select("sketch", "sid", "bytes", "first").repartition(parts, "sketch").sortWithinPartitions("sketch")
    found = dealt.mapInArrow(sort_buckets, SORTED_DDL)
    last = F.octet_length("bytes") - WINDOW
    windows = several.filter(F.col("size") > BUCKET).select("sketch", "sid", "bytes", "first", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    window = F.substring("bytes", F.col("at") + 1, F.lit(WINDOW))
    windows = windows.select("sketch", "sid", "first", "at", F.xxhash64(window).alias("h1"), F.xxhash64(F.lit(1), window).alias("h2"))
    least = c.cut(windows.groupBy("h1", "h2").agg(F.min("first").alias("least"), F.count("*").alias("often")).filter("often > 1"), "op13-windows")
    hot = c.join_counted(windows, least, ["h1", "h2"], "often", ["least"], ["sid", "at"]).filter("least < first")
    hot = hot.groupBy("sketch", "sid").agg(F.collect_list(F.struct("at", F.lit(1).alias("n"))).alias("spans"))
    return found.unionByName(hot)


def cut_bytes(batches):
    for batch in batches:
        for part, texts in c.grouped(batch):
            out: list[list] = [[] for _ in KEPT]
            for doc_id, text, found in zip(part.column("doc_id").to_pylist(), texts, part.column("found").to_pylist()):
                text = text or b""
                delta = np.zeros(len(text) + 1, np.int32)
                if found:
                    at = np.array([(x["at"], x["n"]) for x in found], np.int64)
                    np.add.at(delta, at[:, 0], 1)
                    np.add.at(delta, at[:, 0] + at[:, 1] + WINDOW - 1, -1)
                gone = np.cumsum(delta)[:-1] > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))).reshape(-1, 2)
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if found else text
                removed = [{"at": int(a), "n": int(b - a)} for a, b in edge]
                for col, x in zip(out, (doc_id, len(text), int(gone.sum()), len(edge), removed, kept if found else None, hashlib.sha256(kept).hexdigest())):
                    col.append(x)
            yield c.rows_of(KEPT, out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, removed (byte spans), kept (null if nothing was removed) and kept_sha256."""
    docs = docs.select(F.col(c.quoted(id_col)).cast("long").alias("doc_id"), F.col(c.quoted(text_col)).cast("binary").alias("text"))
    parts = c.parts_by(docs.agg(F.sum(F.octet_length("text"))).first()[0], PART_BYTES, LEAST_PARTS)
    known = docs.filter(f"doc_id is not null and octet_length(text) >= {WINDOW}").withColumn("t", F.xxhash64("text"))
    shared = c.cut(exchanged(known.mapInArrow(send_sketches(parts), PARTS_DDL), smallest=False), "op13-shared")
    runs = c.cut(known.join(shared, "doc_id").mapInArrow(shared_runs, RUNS_DDL), "op13-runs")
    c.drop(shared)
    strings = runs.groupBy("sketch", "sid").agg(F.min("doc_id").alias("first"), F.count("*").alias("often"), F.first("bytes", ignorenulls=True).alias("bytes"))
    strings = c.cut(strings, "op13-strings")
    found = repeated_strings(strings)
    verdict = strings.select("sketch", "sid", "first", "often").join(found, ["sketch", "sid"], "left").filter("often > 1 or spans is not null")
    verdict = c.cut(verdict, "op13-verdicts")
    c.drop(strings)
    placed = runs.select("doc_id", "t", "sketch", "sid", "start", "windows")
    placed = c.join_counted(placed, verdict, ["sketch", "sid"], "often", ["first", "spans"], ["doc_id", "start"])
    moved = F.transform("spans", lambda x: F.struct((x["at"] + F.col("start")).alias("at"), x["n"].alias("n")))
    whole = F.array(F.struct(F.col("start").alias("at"), F.col("windows").alias("n")))
    placed = placed.select("doc_id", "t", F.when(F.col("doc_id") > F.col("first"), whole).otherwise(moved).alias("found")).filter("found is not null")
    gone = placed.groupBy("doc_id", "t").agg(F.flatten(F.collect_list("found")).alias("found"))
    gone = c.cut(gone.select(F.col("doc_id").alias("of"), "t", "found"), "op13-spans")
    c.drop(runs, verdict)
    joined = docs.join(gone, (F.col("doc_id") == F.col("of")) & (F.xxhash64("text") == F.col("t")), "left")
    return joined.select("doc_id", "text", "found").mapInArrow(cut_bytes, KEPT_DDL)


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(c.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
