"""Pictures by an injected decoder: fingerprints, whether they can be decoded, half-size previews.

Rows run where they lie; a picture that can't be decoded is a null in its row and stops nothing. The decoder is the caller's: path to pixels
(height, width, 3 or 4 of uint8), or None.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Decode = Callable[[str], np.ndarray | None]
GRID_W, GRID_H = 9, 8


def _overlaps(n: int, m: int) -> np.ndarray:
    """(m, n): the share of each of n cells in each of m equal spans over them."""
    edges = np.arange(m + 1) * (n / m)
    lo, hi = np.maximum(edges[:-1, None], np.arange(n)), np.minimum(edges[1:, None], np.arange(1, n + 1))
    return np.maximum(hi - lo, 0) * (m / n)


def downscaled(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area averages, halves rounded up; a picture that is no larger is returned as it is."""
    if width <= 0 or height <= 0:
        raise ValueError(f"size {width} x {height}")
    h, w = pixels.shape[:2]
    if width >= w and height >= h:
        return pixels
    out = np.einsum("yh,hwc,xw->yxc", _overlaps(h, height), pixels.astype(float), _overlaps(w, width))
    return np.floor(out + 0.5).astype(np.uint8)


def difference_bits(pixels: np.ndarray) -> int:
    """The 64 bits of a picture as a signed number: bit i (row by row) is set where a cell of the 9 x 8 luma grid exceeds its right neighbour."""
    small = downscaled(pixels, GRID_W, GRID_H).astype(int)
    if small.shape[:2] != (GRID_H, GRID_W):  # smaller than the grid: each cell takes the pixel it lies on
        small = small[np.arange(GRID_H) * small.shape[0] // GRID_H][:, np.arange(GRID_W) * small.shape[1] // GRID_W]
    luma = (299 * small[..., 0] + 587 * small[..., 1] + 114 * small[..., 2]) // 1000
    bits = sum(1 << i for i in np.flatnonzero(luma[:, :-1] > luma[:, 1:]).tolist())
    return bits - (1 << 64) if bits >> 63 else bits


def _of_each(rows: DataFrame, path_col: str, out: dict[str, pa.DataType], ddl: str, one: Callable[[str], tuple | None]) -> DataFrame:
    schema = pa.schema([("image_id", pa.int64()), *out.items()])

    def run(batches):
        for batch in batches:
            done = []
            for i, path in zip(batch.column("image_id").to_pylist(), batch.column(path_col).to_pylist()):
                try:
                    got = one(path) if path is not None else None
                except Exception:  # the decoder's failure is the row's result
                    got = None
                done.append((i, *(got or [None] * len(out))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done) if done else [[] for _ in schema], schema)], schema=schema)

    return rows.select("image_id", path_col).mapInArrow(run, f"image_id bigint, {ddl}")


def fingerprints(images: DataFrame, decode: Decode, path_col: str = "file_path") -> DataFrame:
    """image_id, hash, decodable."""

    def one(path: str) -> tuple | None:
        pixels = decode(path)
        return None if pixels is None else (difference_bits(pixels), True)

    done = _of_each(images, path_col, {"hash": pa.int64(), "decodable": pa.bool_()}, "hash bigint, decodable boolean", one)
    return done.fillna(False, ["decodable"])


def previews(images: DataFrame, decode: Decode, store: Callable[[str, np.ndarray], str], path_col: str = "file_path") -> DataFrame:
    """image_id, preview_cache_path: half-size pictures written by `store`, which returns where; null where that failed. It runs after the
    images are in their table, which it doesn't hold up."""

    def one(path: str) -> tuple | None:
        pixels = decode(path)
        if pixels is None:
            return None
        return (store(path, downscaled(pixels, max(1, pixels.shape[1] // 2), max(1, pixels.shape[0] // 2))),)

    return _of_each(images, path_col, {"preview_cache_path": pa.string()}, "preview_cache_path string", one)
