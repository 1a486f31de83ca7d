"""Approximate nearest neighbours by adaptive dimension scan over inverted lists.

Index: k-means centres are fitted on a sample of about SAMPLE vectors (chosen by hash of vec_id, so the driver's memory is
bounded; a centre needs SAMPLE / MAX_LISTS vectors of it, hence MAX_LISTS) and every vector is put in its nearest centre's list. Lists
longer than BLOCK_ROWS are dealt out over blocks by hash, and a list's queries over groups of QUERY_ROWS, so a list that holds a third of all vectors
or is asked by all queries is many tasks of bounded size. No list or query set reaches the driver, only each list's size and spread.

Probing: which lists a query is sent to is tested, not fixed. With the query's distance d to a list's centre and the mean m and
deviation s of its members' squared distances r to it, a member's squared distance is about normal with mean d**2 + m and variance
4 d**2 m / D + s**2. The distance within which TOP of all vectors are to be expected follows, and of these the number in each list; lists
are taken in order of that number until SHARE of the total is covered. Clustered vectors are found in a few lists; vectors without any
clusters, as those of the test tables, need most of them (the share scanned is in the README).

Scan: vectors are rotated by one random orthogonal matrix, so the first d columns hold about d/D of any squared
distance. Columns are taken in blocks of STEP; after each, a candidate whose partial distance, scaled by D/d, exceeds
the current tenth best by the factor (1 + EPSILON / sqrt(d))**2 is given up: under the hypothesis that it is nearer, so large a
partial distance has negligible probability. What is left is measured exactly on the original vectors in double precision.

Defined cases: vectors that are null, zero, of another length than the most common one, or hold null or non-finite
components take no part, neither as query nor as candidate; rows that repeat a vec_id with the same vector are one; null vec_id takes no part; equal distances go to the smaller vec_id; no vectors, no
rows; extra columns are ignored. exact=True gives the true neighbours: all lists, and only candidates whose partial distance
alone is beyond the tenth best are given up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

TOP, EVERY = 10, 100
SAMPLE, MAX_LISTS, ROUNDS, SEED = 20_000, 1024, 8, 11
SHARE, LEAST_CANDIDATES = 0.97, 200
BLOCK_ROWS, QUERY_ROWS, STEP, EPSILON = 4096, 2048, 16, 3.0
PLACED = pa.schema([("vec_id", pa.int64()), ("list", pa.int32()), ("r", pa.float64()), ("vec", pa.binary())])
PLACED_DDL = "vec_id bigint, list int, r double, vec binary"
ASKED = pa.schema([("query_id", pa.int64()), ("query", pa.binary()), ("lists", pa.list_(pa.int32()))])
ASKED_DDL = "query_id bigint, query binary, lists array<int>"
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
FOUND_DDL = "query_id bigint, vec_id bigint, score double"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").cast("array<double>").alias("vec"))
    v = v.filter("vec_id is not null and vec is not null and size(vec) > 0")
    v = v.filter("forall(vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(vec, x -> x <> 0)")
    common = v.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return v.filter(F.size("vec") == (common.n if common else 0))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, dims)


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(1)[None]


def k_means(x: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(ROUNDS):
        near = distances(x, centres).argmin(1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit(v: DataFrame) -> tuple[np.ndarray, int]:
    """Centres, fitted on the sample, and the number of vectors."""
    total = v.count()
    share = min(1.0, SAMPLE / max(total, 1))
    rows = v.filter(F.expr(f"pmod(xxhash64(vec_id), 1048576) < {int(share * 1048576)}")).select("vec_id", "vec").toArrow() if share < 1 else v.select("vec_id", "vec").toArrow()
    if not rows.num_rows:
        return np.empty((0, 1)), total
    dims = len(rows["vec"][0])
    x = matrix(rows["vec"].combine_chunks(), dims)[np.argsort(rows["vec_id"].to_numpy(), kind="stable")]
    return k_means(x, max(1, min(MAX_LISTS, round(total**0.5), len(x)))), total


def placed(centres: np.ndarray):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("vec"), centres.shape[1])
                d = [distances(x[i : i + 2048], centres) for i in range(0, len(x), 2048)]
                near = np.concatenate([y.argmin(1) for y in d])
                r = np.concatenate([y.min(1) for y in d])
                yield c.rows_of(PLACED, [batch.column("vec_id"), near.astype(np.int32), np.maximum(r, 0), [r.tobytes() for r in x]])

    return run


def tail(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, about."""
    return 1 / (1 + np.exp(np.clip(-1.5976 * z - 0.07056 * z**3, -700, 700)))


def chosen(d: np.ndarray, n: np.ndarray, mean: np.ndarray, dev: np.ndarray, dims: int, top: int) -> list[np.ndarray]:
    """The lists to be asked for each row of d, squared distances to the centres. n, mean, dev: number, mean and deviation of each
    list's squared distances to its centre."""
    d = np.maximum(d, 0)
    centre, spread = d + mean, np.sqrt(4 * d * mean / dims + dev**2) + 1e-12
    lo, hi = (centre - 8 * spread).min(1), (centre + 8 * spread).max(1)
    for _ in range(60):
        mid = (lo + hi) / 2
        over = (n * tail((mid[:, None] - centre) / spread)).sum(1) > top
        lo, hi = np.where(over, lo, mid), np.where(over, mid, hi)
    held = n * tail((hi[:, None] - centre) / spread)
    order = np.argsort(-held, 1, kind="stable")
    of = np.cumsum(np.take_along_axis(held, order, 1), 1)
    own = np.cumsum(n[order], 1)
    need = np.maximum((of < SHARE * of[:, -1:]).sum(1), (own < LEAST_CANDIDATES).sum(1)) + 1
    return [o[:k].astype(np.int32) for o, k in zip(order, need)]


def asked_lists(centres: np.ndarray, n: np.ndarray, mean: np.ndarray, dev: np.ndarray, top: int, exact: bool):
    """query_id, query and the lists that it is sent to."""

    def run(batches):
        for batch in batches:
            vecs = batch.column("vec").to_pylist()
            for i in range(0, len(vecs), 256):
                some = vecs[i : i + 256]
                d = distances(np.frombuffer(b"".join(some), "<f8").reshape(len(some), -1), centres)
                lists = [np.arange(len(centres), dtype=np.int32)] * len(some) if exact else chosen(d, n, mean, dev, centres.shape[1], top)
                yield c.rows_of(ASKED, [batch.column("vec_id").slice(i, len(some)), some, lists])

    return run


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def nearest(ids: np.ndarray, x: np.ndarray, turned: np.ndarray, query_id: int, q: np.ndarray, q_turned: np.ndarray, top: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Ids and exact distances of the `top` nearest in one block, by the adaptive scan."""
    dims = x.shape[1]
    best_i, best_d = np.empty(0, np.int64), np.empty(0)
    first, rounding = 0, 1e-9 * float(q @ q)  # equal vectors may differ by rounding once they are turned
    for size in (8 * top, len(x)):  # a few exact distances give the bound for the rest
        at = np.arange(first, min(first + size, len(x)))
        first += len(at)
        if len(best_d) >= top:
            bound = best_d[top - 1] ** 2
            partial = np.zeros(len(at))
            for d in range(0, dims, STEP):
                diff = turned[at, d : d + STEP] - q_turned[d : d + STEP]
                partial += np.einsum("ij,ij->i", diff, diff)
                seen = min(d + STEP, dims)
                limit = bound * (1 + EPSILON / np.sqrt(seen)) ** 2 * (seen / dims) if seen < dims and not exact else bound * (1 + 1e-9)
                near = partial <= limit + rounding
                at, partial = at[near], partial[near]
        at = at[ids[at] != query_id]
        diff = x[at] - q
        best_i = np.concatenate([best_i, ids[at]])
        best_d = np.concatenate([best_d, np.sqrt((diff * diff).sum(1))])
        order = np.lexsort((best_i, best_d))[:top]
        best_i, best_d = best_i[order], best_d[order]
        if first >= len(x):
            break
    return best_i, best_d


def scan(top: int, exact: bool):
    def run(block: pa.Table, queries: pa.Table) -> pa.Table:
        if not block.num_rows or not queries.num_rows:
            return FOUND.empty_table()
        ids = block["vec_id"].to_numpy()
        x = np.frombuffer(b"".join(block["vec"].to_pylist()), "<f8").reshape(len(ids), -1)
        turn = rotation(x.shape[1])
        turned = x @ turn
        out_q, out_i, out_d = [], [], []
        for query_id, q in zip(queries["query_id"].to_pylist(), queries["query"].to_pylist()):
            q = np.frombuffer(q, "<f8")
            i, d = nearest(ids, x, turned, query_id, q, q @ turn, top, exact)
            out_q.append(np.full(len(i), query_id))
            out_i.append(i)
            out_d.append(d)
        return pa.table([pa.array(np.concatenate(a), f.type) for a, f in zip((out_q, out_i, out_d), FOUND)], schema=FOUND)

    return run


def search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", top: int = TOP, every: int = EVERY, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every row whose id is divisible by `every`."""
    v = usable(vectors, id_col, vec_col)
    centres, _ = fit(v)
    if not len(centres):
        return v.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    index = c.cut(v.mapInArrow(placed(centres), PLACED_DDL).dropDuplicates(["vec_id", "vec"]), "op10-index")
    n, mean, dev = np.zeros((3, len(centres)))
    for r in index.groupBy("list").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("dev")).collect():  # a row per list
        n[r["list"]], mean[r["list"]], dev[r["list"]] = r.n, r["mean"], r.dev
    asked = c.cut(index.filter(F.col("vec_id") % every == 0).select("vec_id", "vec").mapInArrow(asked_lists(centres, n, mean, dev, top, exact), ASKED_DDL), "op10-asked")
    asking = {r["list"]: r["count"] for r in asked.select(F.explode("lists").alias("list")).groupBy("list").count().collect()}  # a row per list
    parts = [(i, int(max(1, -(-n[i] // BLOCK_ROWS))), -(-k // QUERY_ROWS)) for i, k in asking.items()]
    per_list = F.broadcast(v.sparkSession.createDataFrame(parts, "list int, blocks int, groups int"))  # as many rows as lists
    dealt = index.join(per_list, "list").select("list", F.expr("cast(pmod(xxhash64(vec_id), blocks) as int)").alias("block"), F.explode(F.expr("sequence(0, groups - 1)")).alias("group"), "vec_id", "vec")
    sent = asked.withColumn("list", F.explode("lists")).join(per_list, "list").select("list", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), F.expr("cast(pmod(xxhash64(query_id), groups) as int)").alias("group"), "query_id", "query")
    found = dealt.groupBy("list", "block", "group").cogroup(sent.groupBy("list", "block", "group")).applyInArrow(scan(top, exact), FOUND_DDL)
    best = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(c.table(spark, sf_dir, "embeddings"))
