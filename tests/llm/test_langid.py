import zlib

import numpy as np

from siftwork.llm import common, langid

from .helpers import HOSTILE, frame, with_null_id


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r for r in common.table(spark, sf, "documents").select("doc_id", "lang", "text").collect()}
    got = langid.query(spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_training_lowers_the_loss():
    rng = np.random.default_rng(0)
    net = langid.ByteConvNet(["a", "b"])
    x, y = rng.integers(97, 110, (40, langid.WINDOW)).astype(np.uint8), rng.integers(0, 2, 40)
    loss = lambda: -np.log(net.predict(x)[np.arange(40), y] + 1e-9).mean()
    before = loss()
    net.fit(x, y)
    assert loss() < before / 2


def forward(net, window):
    """The network by its definition, one byte after another."""
    e, w, b, d, c = (net.p[k].astype(float) for k in "ewbdc")
    spans = [np.concatenate([e[window[i + k]] for k in range(langid.SPAN)]) for i in range(len(window) - langid.SPAN + 1)]
    act = []
    for f in range(w.shape[1]):
        width = langid.WIDTHS[f // langid.FILTERS] * langid.EMBED
        act.append(max(0.0, max(float(s[:width] @ w[:width, f]) for s in spans) + b[f]))
    z = np.exp(np.array(act) @ d + c)
    return z / z.sum()


def test_forward_pass_by_its_definition():
    rng = np.random.default_rng(3)
    net = langid.ByteConvNet(["a", "b", "c"])
    x = rng.integers(0, 256, (70, langid.WINDOW)).astype(np.uint8)
    net.fit(x[:40], rng.integers(0, 3, 40))
    got = net.predict(x)
    for i in (0, 1, 63, 64, 69):
        assert np.abs(got[i] - forward(net, x[i].tolist())).max() < 1e-4


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(1)
    net = langid.ByteConvNet(["a", "b", "c"])
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    x, y, weight = rng.integers(90, 120, (6, langid.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2]), np.array([1.0, 2.0, 0.5, 1.0, 2.0, 0.5])
    loss = lambda: -(weight * np.log(net.predict(x)[np.arange(6), y])).mean()
    grads, step = net.gradients(x, y, weight), 1e-6
    for k, g in grads.items():
        places = [p for p in np.ndindex(g.shape) if k != "w" or net.mask[p]]
        for p in (places[i] for i in rng.permutation(len(places))[:60]):
            held = net.p[k][p]
            net.p[k][p] = held + step
            up = loss()
            net.p[k][p] = held - step
            down = loss()
            net.p[k][p] = held
            assert abs((up - down) / (2 * step) - g[p]) < 1e-6 + 1e-4 * abs(g[p]), (k, p)


def test_windows_cover_the_text():
    for n in (1, 191, 192, 193, 1000):
        t = bytes(97 + i % 26 for i in range(n))
        w = langid.windows_of(t)
        assert w.shape[1] == langid.WINDOW and len(w) == max(1, -(-n // langid.WINDOW))
        assert n < langid.WINDOW or w[-1].tobytes() == t[-langid.WINDOW :]


def test_hostile(spark):
    df = with_null_id(frame(spark))
    got = langid.identify(df).collect()
    assert len(got) == len(HOSTILE) + 3
    for r in got:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(ch.isalpha() for ch in HOSTILE[r.doc_id] or "")) and (r.lang_pred != "und" or r.score == 0)
    twice = langid.identify(df.unionAll(df)).collect()
    assert len({(r.doc_id, r.lang_pred, r.score) for r in twice if r.doc_id is not None}) == len(HOSTILE)  # repeated rows fare alike
    nolabel = df.selectExpr("doc_id", "text", "cast(null as string) lang", "'x' held_out")
    assert {r.lang_pred for r in langid.identify(nolabel).collect()} == {"und"}
    assert langid.identify(df.limit(0)).count() == 0
