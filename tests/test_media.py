"""Pictures by an injected decoder."""

import numpy as np
import pytest

from siftwork.operators import media


def picture(path):
    if "bad" in path:
        raise OSError(path)
    if "none" in path:
        return None
    rng = np.random.default_rng(sum(map(ord, path)))
    return rng.integers(0, 256, (8 * 16, 9 * 10, 3)).astype(np.uint8)


def test_downscaled():
    p = np.arange(24, dtype=np.uint8).reshape(4, 6, 1)
    assert media.downscaled(p, 3, 2)[..., 0].tolist() == [[4, 6, 8], [16, 18, 20]]  # 3.5 and so on, halves up
    assert media.downscaled(p, 6, 4) is p and media.downscaled(p, 9, 9) is p
    assert media.downscaled(p, 4, 4).shape == (4, 4, 1)
    even = np.full((5, 7, 3), 99, np.uint8)
    assert (media.downscaled(even, 3, 2) == 99).all()
    for size in ((0, 1), (1, -1)):
        with pytest.raises(ValueError):
            media.downscaled(p, *size)


def test_fingerprints_and_previews(spark, tmp_path):
    paths = ["a.jpg", "bad.jpg", "none.jpg", None, "b.jpg"]
    df = spark.createDataFrame(list(enumerate(paths)), "image_id long, file_path string")
    got = {r.image_id: (r.hash, r.decodable) for r in media.fingerprints(df, picture).collect()}
    for i, p in ((0, "a.jpg"), (4, "b.jpg")):
        mean = picture(p).reshape(8, 16, 9, 10, 3).mean((1, 3))
        small = np.floor(mean + 0.5).astype(int)
        luma = (299 * small[..., 0] + 587 * small[..., 1] + 114 * small[..., 2]) // 1000
        want = sum(1 << (y * 8 + x) for y in range(8) for x in range(8) if luma[y, x] > luma[y, x + 1])
        assert (got[i][0] & (2**64 - 1), got[i][1]) == (want, True)
    assert all(got[i] == (None, False) for i in (1, 2, 3))
    shapes = {r.image_id: r.preview_cache_path for r in media.previews(df, picture, lambda path, px: f"{path}:{px.shape[1]}x{px.shape[0]}").collect()}
    assert shapes == {0: "a.jpg:45x64", 1: None, 2: None, 3: None, 4: "b.jpg:45x64"}
    assert media.fingerprints(df.limit(0), picture).count() == 0
    assert media.difference_bits(np.zeros((2, 2, 3), np.uint8)) == 0
