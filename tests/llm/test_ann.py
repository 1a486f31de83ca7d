import numpy as np

from siftwork.llm import ann, common


def brute(ids, x, every=100, top=10):
    out = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            d = np.sqrt(((x - q) ** 2).sum(1))
            order = [k for k in np.lexsort((ids, d)) if ids[k] != i][:top]
            out[i] = [(int(ids[k]), d[k]) for k in order]
    return out


def results(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    return {q: [v[k] for k in sorted(v)] for q, v in out.items() if sorted(v) == list(range(1, len(v) + 1))}


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def test_recall_on_tables(spark):
    sf = "/root/testdata/sf0.1"
    t = common.table(spark, sf, "embeddings").select("vec_id", "embedding").toPandas()
    want = brute(t.vec_id.to_numpy(), np.stack(t.embedding).astype(float))
    got = results(ann.query(spark, sf))
    assert set(got) == set(want) and all(len(w) == 10 for w in got.values())
    r = recall(got, want)
    print("recall", r)
    assert r >= 0.9
    dist = {q: dict(w) for q, w in want.items()}
    assert all(abs(s - dist[q][i]) < 1e-12 for q, w in got.items() for i, s in w if i in dist[q])


def frame(spark, x, ids=None):
    rows = [(int(i), [float(v) for v in r] if r is not None else None, 0, "clash") for i, r in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, list string")


def test_exact_with_many_copies(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((900, 24))
    x[300:600] = x[300]  # a third are copies
    want = brute(np.arange(900), x, every=50)
    got = results(ann.search(frame(spark, x), every=50, exact=True))
    assert {q: [i for i, _ in w] for q, w in got.items()} == {q: [i for i, _ in w] for q, w in want.items()}
    assert [i for i, _ in got[350]] == [i for i, _ in want[350]]  # ties go to smaller ids


def test_hostile(spark):
    x = [[1.0, 2.0], None, [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0], [1.0, 2.5], [3.0, 2.0]]
    df = frame(spark, x).union(frame(spark, [[1.0, 2.0], [9.0, 9.0]], [0, 100]))
    got = results(ann.search(df, every=2))
    assert got[0] == [(6, 0.5), (7, 2.0), (100, np.hypot(8, 7))]
    assert set(got) == {0, 6, 100}
    assert ann.search(df.limit(0)).count() == 0
    bad = frame(spark, [[0.0, 0.0], None])
    assert ann.search(bad).count() == 0


def probed(x, ids, every):
    """Share of the vectors in the lists that a query is sent to."""
    centres = ann.k_means(x, round(len(x) ** 0.5))
    d = ann.distances(x, centres)
    own, r = d.argmin(1), np.maximum(d.min(1), 0)
    n = np.bincount(own, minlength=len(centres)).astype(float)
    mean = np.array([r[own == i].mean() if n[i] else 0 for i in range(len(n))])
    dev = np.array([r[own == i].std() if n[i] else 0 for i in range(len(n))])
    return np.mean([n[o].sum() / len(x) for o in ann.chosen(d[ids % every == 0], n, mean, dev, x.shape[1], 10)])


def test_clustered_vectors_need_few_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_ROWS", 7)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 32))[rng.integers(0, 60, 3000)] + 0.2 * rng.standard_normal((3000, 32))
    ids = np.arange(3000)
    share = probed(x, ids, 20)
    assert share < 0.15, share
    got = results(ann.search(frame(spark, x), every=20))
    assert recall(got, brute(ids, x, every=20)) >= 0.9
