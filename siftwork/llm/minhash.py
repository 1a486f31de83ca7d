"""Near-duplicate detection by fast similarity sketching, banding and exact verification.

Sketch: COORDS bins. In round r every shingle is hashed to a bin and a value; a bin empty before the round takes the
smallest value it gets. Rounds COORDS and on place all shingles in one given bin, so after 2 * COORDS rounds at most
every coordinate is filled, whatever the set's size; most sets need two or three rounds. Two sets agree in a
coordinate with probability equal to their Jaccard similarity, with the concentration of full k-minwise hashing.
BANDS bands of ROWS coordinates: a pair at similarity 0.75 shares no band with probability
(1 - 0.75**4)**32 < 6e-6; more similar pairs with less.

Sets that are equal are one node, named by their smallest doc_id. For the nodes of a band's bucket not all pairs are made: each is
verified on full sets against the bucket's smallest node, the leader. Nodes of a bucket that then lie in different components are
contested, and an exact count filter settles most of them without a pair: a link needs an intersection of 3/7 of both sizes'
sum, and the intersection with any node of another component is at most m, the number of the node's own shingles that stand in
another component at all. So a node of size n can only be linked with sizes from 0.75 n to 7/3 m - n, and it stays if its
bucket holds such a node of another component that can in turn be linked with n. Counts and size ranges are aggregates, linear in the buckets.
A copy that lies too far from the group's text has too few shared shingles and is settled, however large the group.

While the nodes left would make more than PAIRS_PER_ROW pairs each, up to TURNS further leaders take a turn, the one with the greatest
m / n (closest to the text that the others were made from), are verified against the nodes of other components, and
leave the bucket. What is left is compared in the bucket of the smallest key that a pair shares, so once, in tiles of TILE x TILE nodes that are dealt over all
tasks, under an exact bitmap filter: shared shingles are hashed to SIGNATURE bits, two
bitmaps differ in no more bits than the sets in elements, and a link leaves m_a + m_b - 6/7 (n_a + n_b) elements to differ in at most. Pairs that
pass are verified on full sets, so no link is lost.

Links make components (distributed star contraction). One document of each, that with the smallest id, is kept.

Defined cases: null or blank text has an empty set and no links; fewer than five words make one shingle; rows that
repeat a doc_id get a row each and are one document, linked with what any of its texts is linked with; rows with null doc_id link with
nothing, are kept and have a null component; an empty table gives no rows; extra columns of any name are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.operators.components import connected_components

from . import common as c

WORDS, COORDS, ROWS = 5, 128, 4
BANDS = COORDS // ROWS
NUM, DEN = 75, 100
TURNS, PAIRS_PER_ROW, SIGNATURE = 1, 8, 1024
#: Pairs of one leader are verified in lots of about LEADER_ROWS; sizes are held in classes that grow by the factor exp(SIZE_CLASS).
LEADER_ROWS, SIZE_CLASS = 1000, 0.03
SKETCH = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64()))])
SKETCH_DDL = "doc_id bigint, n bigint, k1 bigint, k2 bigint, bands array<bigint>"
SETS = pa.schema([("node", pa.int64()), ("k1", pa.int64()), ("shingles", pa.list_(pa.int64()))])
SETS_DDL = "node bigint, k1 bigint, shingles array<bigint>"
PAIRS = pa.schema([(x, pa.int64()) for x in ("a", "ka", "b", "kb", "lots")])
PAIRS_DDL = "a bigint, ka bigint, b bigint, kb bigint, lots bigint"
#: Nodes in a block of a contested bucket; rows of a block that are compared at once.
TILE, STRIP = 1024, 128
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = (text or b"").lower().split()
    h = c.word_hashes(words)
    return np.unique(c.ngram_hashes(h, WORDS)) if len(h) >= WORDS else c.ngram_hashes(h, len(h), seed=1 + len(h)) if len(h) else h


def sketch(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """A row of `coords` values for each set; a row of an empty set stays EMPTY."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.full(len(sets) * coords, EMPTY, np.uint64)
    x, owner = np.concatenate(sets) if len(sets) else np.empty(0, np.uint64), np.repeat(np.arange(len(sets)), sizes)
    shift = np.uint64(64 - coords.bit_length() + 1)
    for r in range(2 * coords):
        if not len(x):
            break
        h = c.mixed(x ^ c.mixed(np.array([r + 1], np.uint64)))
        at = owner * coords + ((h >> shift).astype(np.int64) if r < coords else r - coords)
        now = np.full(len(out), EMPTY, np.uint64)
        np.minimum.at(now, at, h << np.uint64(coords.bit_length() - 1) | np.uint64(1) if r < coords else h >> np.uint64(1))
        fresh = (out == EMPTY) & (now != EMPTY)
        out[fresh] = c.mixed(now[fresh] ^ np.uint64(r << 8)) >> np.uint64(1)
        full = (out.reshape(len(sets), coords) != EMPTY).all(1)
        left = ~full[owner]
        x, owner = x[left], owner[left]
    return out.reshape(len(sets), coords)


def band_keys(rows: np.ndarray) -> np.ndarray:
    """(n, BANDS) hashes of each band's coordinates and number."""
    parts = rows.reshape(len(rows), -1, ROWS)
    key = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(ROWS):
        key = c.mixed(key ^ parts[:, :, j]) + np.uint64(j)
    return key


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed numbers."""
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return tuple(v - (1 << 64) if v >> 63 else v for v in (d >> 64, d & (1 << 64) - 1))


def sketched(batches):
    for batch in batches:
        for part, texts in c.grouped(batch):
            sets = [shingle_set(t) for t in texts]
            keys = band_keys(sketch(sets)).astype(np.int64, copy=False).view(np.int64)
            k1, k2 = zip(*map(digest, sets))
            yield c.rows_of(SKETCH, [part.column("doc_id").to_pylist(), [len(s) for s in sets], k1, k2, [k.tolist() if len(s) else None for k, s in zip(keys, sets)]])


def full_sets(batches):
    for batch in batches:
        for part, texts in c.grouped(batch):
            sets = [shingle_set(t) for t in texts]
            yield c.rows_of(SETS, [part.column("doc_id").to_pylist(), [digest(s)[0] for s in sets], [s.view(np.int64) for s in sets]])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, ka, b, kb, lots) with their intersection and sizes on full sets. lots: into how many parts a's pairs are split."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("k1").alias(f"k{x}"), F.col("shingles").alias(f"s{x}"))
    lots = pairs.groupBy("a", "ka").agg(F.max("lots").alias("most"))
    of_a = side("a").join(lots, ["a", "ka"]).withColumn("lot", F.explode(F.expr("sequence(0L, most - 1)"))).drop("most")
    of_b = pairs.withColumn("lot", F.expr("pmod(xxhash64(b, kb), lots)")).join(side("b"), ["b", "kb"])
    both = of_b.join(of_a, ["a", "ka", "lot"])
    return both.select("a", "b", F.size(F.array_intersect("sa", "sb")).cast("long").alias("inter"), F.size("sa").cast("long").alias("na"), F.size("sb").cast("long").alias("nb")).withColumn("union", F.expr("na + nb - inter"))


def is_link() -> F.Column:
    return F.expr(f"{DEN} * inter >= {NUM} * union")


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """Components parts(id, component) joined by further links(u, v): the components themselves are the nodes."""
    of = lambda end: parts.select(F.col("id").alias(end), F.col("component").alias(f"c_{end}"))
    between = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("c_u", "u").alias("u"), F.coalesce("c_v", "v").alias("v"))
    joined = connected_components(between).select(F.col("id").alias("component"), F.col("component").alias("to"))
    sizes = c.cut(parts.groupBy("component").agg(F.count("*").alias("size")).join(joined, "component"), "op2-moves")
    moved = c.join_counted(parts, sizes, ["component"], "size", ["to"], ["id"], keep=True).select("id", F.coalesce("to", "component").alias("component"))
    alone = joined.join(parts.select(F.col("id").alias("component")), "component", "left_anti").select(F.col("component").alias("id"), F.col("to").alias("component"))
    return moved.unionByName(alone)


def links_of(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v) of the pairs(a, ka, b, kb, lots) that are links."""
    once = c.cut(pairs.groupBy("a", "ka", "b", "kb").agg(F.max("lots").alias("lots")), "op2-pairs")
    return c.cut(verified(once, sets).filter(is_link()).select(F.col("a").alias("u"), F.col("b").alias("v")), "op2-links")


def still_open(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows(key, node, k1, n) of the buckets whose nodes lie in several components, with the component."""
    seen = rows.join(parts.withColumnRenamed("id", "node"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = seen.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key")
    return c.cut(seen.join(split, "key").select("key", "node", "k1", "n", "component"), "op2-open")


def contested(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """rows(key, node, k1, n, component) that may have a link into another component of their bucket, with most (the largest size
    that their shared shingles allow), m and classes: the bucket's size classes of n or less that hold a possible partner."""
    own = rows.select("node", "k1", "n", "component").distinct()
    x = own.join(sets, ["node", "k1"]).select("node", "k1", "n", "component", F.explode("shingles").alias("s"))
    shared = x.groupBy("s").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("often")).filter("lo < hi")
    shared = c.join_counted(x, c.cut(shared, "op2-shared"), ["s"], "often", ["lo"], ["node", "k1", "s"])
    words = [F.expr(f"bit_or(if(pmod(s, {SIGNATURE}) div 64 = {w}, shiftleft(1L, cast(pmod(s, 64) as int)), 0L))") for w in range(SIGNATURE // 64)]
    m = shared.groupBy("node", "k1", "n").agg(F.count("*").alias("m"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    m = m.select("node", "k1", "n", "m", F.array(*[f"w{i}" for i in range(len(words))]).alias("bits"))
    reach = m.withColumn("most", F.expr(f"{NUM + DEN} * m div {NUM} - n")).filter(f"{DEN} * most >= {NUM} * n").drop("n")
    rows = c.cut(rows.join(reach, ["node", "k1"]).withColumn("class", F.expr(f"cast(ln(n) / {SIZE_CLASS} as int)")), "op2-reach")
    classes = rows.groupBy("key", "class").agg(F.min("n").alias("n0"), F.max("n").alias("n1"), F.max("most").alias("most1"), F.min("component").alias("c0"), F.max("component").alias("c1"), F.count("*").alias("n_rows"))
    held = classes.groupBy("key").agg(F.sum("n_rows").alias("size"), F.collect_list(F.struct("class", "n0", "n1", "most1", "c0", "c1", "n_rows")).alias("held"))  # an entry for each class of sizes
    fits = f"x.n0 <= most and {DEN} * x.n1 >= {NUM} * n and x.most1 >= n and {NUM} * x.n0 <= {DEN} * n and (x.c0 <> component or x.c1 <> component)"
    found = c.join_counted(rows, c.cut(held, "op2-classes"), ["key"], "size", ["held"])
    found = found.withColumn("held", F.expr(f"filter(held, x -> {fits})")).filter("size(held) > 0")
    smaller = F.expr("transform(filter(held, x -> x.n0 <= n), x -> x.class)")
    pairs = F.expr("aggregate(filter(held, x -> x.n0 <= n), 0L, (a, x) -> a + x.n_rows)")
    return c.cut(found.select("key", "node", "k1", "n", "component", "m", "most", "bits", "class", smaller.alias("classes"), pairs.alias("pairs")), "op2-contested")


class Nodes:
    """Contested nodes of one bucket, as arrays."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        number = lambda x: np.array([r[x] for r in rows], np.int64)
        self.node, self.n, self.m, self.most, self.component = (number(x) for x in ("node", "n", "m", "most", "component"))
        self.bits = np.array([r["bits"] for r in rows], np.int64).view(np.uint64).reshape(len(rows), SIGNATURE // 64)


def may_link(a: Nodes, b: Nodes, key: int, same: bool) -> tuple[list[tuple[int, int]], int]:
    """Pairs (i of a, j of b) of different components and mutually possible sizes whose bitmaps allow a link, and how many were compared. A
    pair that shares a smaller key is left to that key's bucket; same: a is b, and each pair is taken once."""
    smaller = [[[k for k in r["keys"] if k < key] for r in x.rows] for x in (a, b)]
    known = {k: i for i, k in enumerate({k for r in smaller[0] for k in r} & {k for r in smaller[1] for k in r})}
    held = []
    for rows in smaller:
        x = np.zeros((len(rows), max(1, len(known))), np.float32)
        for i, r in enumerate(rows):
            x[i, [known[k] for k in r if k in known]] = 1
        held.append(x)
    found, compared = [], 0
    for lo in range(0, len(a.rows), STRIP):
        at = slice(lo, lo + STRIP)
        col = lambda x: x[at, None]
        ok = (held[0][at] @ held[1].T) == 0
        ok &= (col(a.component) != b.component) & (DEN * np.minimum(col(a.n), b.n) >= NUM * np.maximum(col(a.n), b.n)) & (b.n <= col(a.most)) & (col(a.n) <= b.most)
        if same:
            ok &= np.arange(len(b.rows)) > np.arange(lo, lo + len(ok))[:, None]
        i, j = np.nonzero(ok)
        compared += len(i)
        i += lo
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            apart = np.bitwise_count(a.bits[x] ^ b.bits[y]).sum(1, dtype=np.int64)
            near = (NUM + DEN) * apart <= (NUM + DEN) * (a.m[x] + b.m[y]) - 2 * NUM * (a.n[x] + b.n[y])
            found += zip(x[near].tolist(), y[near].tolist())
    return found, compared


def tiles(batches):
    """Rows in order of (key, lo, hi): the pairs of each tile that may be links, the larger set first."""
    now, held = None, []

    def done() -> pa.RecordBatch | None:
        key, lo, hi = now
        a = Nodes([r for r in held if r["block"] == lo])
        b = a if lo == hi else Nodes([r for r in held if r["block"] == hi])
        out = []
        for i, j in may_link(a, b, key, lo == hi)[0] if a.rows and b.rows else ():
            x, y = sorted((a.rows[i], b.rows[j]), key=lambda r: (-r["n"], r["node"]))
            out.append((x["node"], x["k1"], y["node"], y["k1"], 1))
        return c.rows_of(PAIRS, list(zip(*out))) if out else None

    for batch in batches:
        for row in batch.to_pylist():
            at = (row["key"], row["lo"], row["hi"])
            if at != now:
                if len(held) > 1 and (made := done()):
                    yield made
                now, held = at, []
            held.append(row)
    if len(held) > 1 and (made := done()):
        yield made


def pairs_of(rows: DataFrame) -> DataFrame:
    """Pairs of contested nodes that may be links. Each pair is compared once, in the smallest key that both have; a bucket of more than TILE nodes is
    dealt out in tiles of two blocks, so no task compares a whole bucket. Only pairs that pass become rows."""
    first = [F.first(x).alias(x) for x in ("n", "m", "most", "component", "bits")]
    nodes = rows.groupBy("node", "k1").agg(*first, F.sort_array(F.collect_set("key")).alias("keys"))  # BANDS keys at most
    sizes = c.cut(rows.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "op2-sizes")
    placed = c.join_counted(nodes.withColumn("key", F.explode("keys")), sizes, ["key"], "size", ["size"], ["node", "k1"])
    blocks = F.expr(f"(size - 1) div {TILE} + 1")
    placed = placed.withColumn("blocks", blocks).withColumn("block", F.expr("pmod(xxhash64(node, k1), blocks)"))
    dealt = placed.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    dealt = dealt.select("key", "lo", "hi", "block", "node", "k1", "n", "m", "most", "component", "bits", "keys")
    return dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(tiles, PAIRS_DDL)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    rows = c.cut(docs.mapInArrow(sketched, SKETCH_DDL), "op2-sketches")
    held = rows.filter("n > 0 and doc_id is not null")
    nodes = c.cut(held.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")), "op2-nodes")
    own = c.join_counted(held, nodes, ["k1", "k2"], "copies", ["node"], ["doc_id"])
    entries = c.cut(own.filter("doc_id = node").dropDuplicates(["k1", "k2"]).select("node", "k1", "n", F.explode("bands").alias("key")), "op2-entries")
    least = F.min(F.struct("node", "k1"))
    buckets = c.cut(entries.groupBy("key").agg(least.alias("leader"), F.count("*").alias("size")).filter("size > 1"), "op2-leaders")
    hot = c.cut(c.join_counted(entries, buckets, ["key"], "size", ["leader", "size"]), "op2-buckets")
    c.drop(entries, buckets)
    used = hot.select(F.col("node").alias("doc_id")).distinct()
    sets = c.cut(docs.join(used, "doc_id", "left_semi").mapInArrow(full_sets, SETS_DDL).dropDuplicates(["node", "k1"]), "op2-sets")
    led = hot.filter("leader <> struct(node, k1)").select(F.col("leader.node").alias("a"), F.col("leader.k1").alias("ka"), F.col("node").alias("b"), F.col("k1").alias("kb"), F.expr(f"size div {LEADER_ROWS} + 1").alias("lots"))
    links = links_of(led, sets)
    # a doc_id of several texts stands for each of them
    texts = own.groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("v")).filter("u < v").select("doc_id", "u")
    parts = connected_components(links.unionByName(own.join(texts, "doc_id").select("u", F.col("node").alias("v"))))
    open_ = still_open(hot.filter("leader <> struct(node, k1)").select("key", "node", "k1", "n"), parts)
    for turn in range(TURNS + 1):
        if open_.isEmpty():
            break
        left = contested(open_, sets)
        c.drop(open_)
        made = left.agg(F.count("*").alias("n"), F.sum("pairs").alias("pairs")).first()
        if not made.n:
            break
        if turn == TURNS or made.pairs <= PAIRS_PER_ROW * made.n:
            more = links_of(pairs_of(left), sets)
        else:
            best = F.max_by(F.struct("node", "k1", "n", "component"), F.struct(F.expr("m / n"), F.expr("-node")))
            turned = c.cut(left.join(left.groupBy("key").agg(best.alias("l"), F.count("*").alias("size")), "key"), "op2-turn")
            asked = turned.filter(f"component <> l.component and {DEN} * least(n, l.n) >= {NUM} * greatest(n, l.n)")
            more = links_of(asked.select(F.col("l.node").alias("a"), F.col("l.k1").alias("ka"), F.col("node").alias("b"), F.col("k1").alias("kb"), F.expr(f"size div {LEADER_ROWS} + 1").alias("lots")), sets)
        if not more.isEmpty():
            parts = c.cut(merged(parts, more), "op2-parts")
        if turn == TURNS or made.pairs <= PAIRS_PER_ROW * made.n:
            break
        open_ = still_open(turned.filter("struct(node, k1) <> struct(l.node, l.k1)").select("key", "node", "k1", "n"), parts)
        c.drop(left, turned)
    c.drop(hot, sets, links)
    bare = rows.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("node"))
    done = own.select("doc_id", "n", "node").unionByName(bare).join(parts.withColumnRenamed("id", "node"), "node", "left")
    return done.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id")).withColumn("kept", F.expr("coalesce(doc_id = component_id, true)"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(c.table(spark, sf_dir, "documents"))
