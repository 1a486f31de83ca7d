"""The colour chain: adjustments and grain as float32 column expressions, lookup tables in numpy float32.

All arithmetic is single precision in the order written here, so SQL over FLOAT values gives the same bytes.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: weights of luminance, the grain hash, the presets' names, parameters and grain
WEIGHTS = (0.299, 0.587, 0.114)
GRAIN_X, GRAIN_Y, GRAIN_MIX, GRAIN_LIMIT = 374761393, 668265263, 1274126177, 0.12
PRESET_STEPS = 17
#: name: red and blue white balance, saturation, contrast and brightness in percent, amount of grain
PRESETS = {
    "Havana 1959": (15, -10, 35, 10, 5, 0.25),
    "Tokyo 1966": (12, -8, -25, -15, 8, 0.25),
    "Paris 1974": (10, -6, -15, -15, 5, 0.25),
    "Miami 1986": (0, 0, 40, 25, 0, 0.25),
    "New York 1994": (-8, 10, -30, 20, -5, 0.55),
    "Shanghai 2010": (-5, 5, 35, 18, 3, 0.10),
    "Munich 1951": (0, 0, -100, 45, -5, 0.55),
    "Rome 1960": (0, 0, -100, -10, 10, 0.25),
    "Berlin 1989": (0, 0, -100, 20, -8, 0.55),
}
ORIGIN = "Origin"  # the preset without a table and grain


@dataclass(frozen=True)
class Adjust:
    """A version's knobs in percent; all zero leaves a picture as it is."""

    highlights: float = 0.0
    shadows: float = 0.0
    blacks: float = 0.0
    whites: float = 0.0
    red: float = 0.0
    blue: float = 0.0
    contrast: float = 0.0
    saturation: float = 0.0

    def neutral(self) -> bool:
        return not any(astuple(self))


def single(x: float) -> Column:
    return F.lit(float(x)).cast("float")


def unit(x: Column) -> Column:
    return F.greatest(single(0), F.least(single(1), x))


def to_byte(x: Column) -> Column:
    return F.floor(x * single(255) + single(0.5)).cast("int")


def from_byte(x: Column) -> Column:
    return (x.cast("float") / single(255)).cast("float")


def luminance(r: Column, g: Column, b: Column) -> Column:
    return single(WEIGHTS[0]) * r + single(WEIGHTS[1]) * g + single(WEIGHTS[2]) * b


def adjusted(df: DataFrame, knobs: Adjust) -> DataFrame:
    """df with its bytes r, g, b adjusted. Tone first, weighted by the luminance of the source: highlights and shadows reach to the
    middle, whites and blacks over a fifth. Red and blue are multiplied by their white balance in the same step; contrast turns about
    the middle and saturation about the luminance. Each step is clamped."""
    if knobs.neutral():
        return df
    c = F.col
    ramp = lambda x, width: unit((x / single(width)).cast("float"))
    gain = lambda percent: single(1.0 + percent / 100.0)
    out = df.withColumns({f"__{n}": from_byte(c(n)) for n in "rgb"}).withColumn("__y", luminance(c("__r"), c("__g"), c("__b")))
    y = c("__y")
    shift = single(knobs.highlights / 100) * ramp(y - single(0.5), 0.5) + single(knobs.shadows / 100) * ramp(single(0.5) - y, 0.5) + single(knobs.whites / 100) * ramp(y - single(0.8), 0.2) + single(knobs.blacks / 100) * ramp(single(0.2) - y, 0.2)
    out = out.withColumn("__d", shift)
    out = out.withColumns({"__r": unit(c("__r") * gain(knobs.red) + c("__d")), "__g": unit(c("__g") + c("__d")), "__b": unit(c("__b") * gain(knobs.blue) + c("__d"))})
    out = out.withColumns({f"__{n}": unit((c(f"__{n}") - single(0.5)) * gain(knobs.contrast) + single(0.5)) for n in "rgb"})
    out = out.withColumn("__y", luminance(c("__r"), c("__g"), c("__b")))
    out = out.withColumns({n: to_byte(unit(c("__y") + (c(f"__{n}") - c("__y")) * gain(knobs.saturation))) for n in "rgb"})
    return out.drop("__r", "__g", "__b", "__y", "__d")


def low_half(h: Column, k: int) -> Column:
    """h * k modulo 2**32 for 0 <= h < 2**32, in steps that a long can hold."""
    word = F.lit(1 << 32)
    return (h * F.lit(k & 0xFFFF) + (h * F.lit(k >> 16)) % word * F.lit(1 << 16)) % word


def grain_noise(x: Column, y: Column) -> Column:
    """Noise in [-1, 1] that depends on the place alone."""
    h = (low_half(x.cast("long"), GRAIN_X) + low_half(y.cast("long"), GRAIN_Y)) % F.lit(1 << 32)
    h = low_half(h.bitwiseXOR(F.shiftright(h, 13)), GRAIN_MIX)
    h = h.bitwiseXOR(F.shiftright(h, 16)).bitwiseAND(F.lit(0xFFFF))
    return (h.cast("float") / single(65535)).cast("float") * single(2) - single(1)


def grained(df: DataFrame, amount: float) -> DataFrame:
    """df with grain on its bytes r, g, b at the place x, y; no grain at an amount of zero or less."""
    if amount <= 0:
        return df
    scale = float(np.float32(amount) * np.float32(GRAIN_LIMIT))
    out = df.withColumn("__n", grain_noise(F.col("x"), F.col("y")) * single(scale))
    return out.withColumns({n: to_byte(unit(from_byte(F.col(n)) + F.col("__n"))) for n in "rgb"}).drop("__n")


def identity_lut(n: int) -> np.ndarray:
    axis = np.arange(n, dtype=np.float32) / np.float32(n - 1)
    return np.stack(np.meshgrid(axis, axis, axis, indexing="ij"), -1)


def graded_lut(n: int, red: float = 0, blue: float = 0, saturation: float = 0, contrast: float = 0, brightness: float = 0) -> np.ndarray:
    """A cube (red, green, blue, channel) of graded colours: white balance, brightness, contrast, saturation, one clamp at the end."""
    x = identity_lut(n) * np.array([1 + red / 100, 1, 1 + blue / 100], np.float32) + np.float32(brightness / 100)
    x = (x - np.float32(0.5)) * np.float32(1 + contrast / 100) + np.float32(0.5)
    w = np.array(WEIGHTS, np.float32)
    y = (w[0] * x[..., 0] + w[1] * x[..., 1] + w[2] * x[..., 2])[..., None]
    return np.clip(y + (x - y) * np.float32(1 + saturation / 100), 0, 1).astype(np.float32)


def preset_lut(name: str) -> np.ndarray | None:
    return None if name == ORIGIN else graded_lut(PRESET_STEPS, *PRESETS[name][:5])


def presets(spark: SparkSession) -> DataFrame:
    """id, name, parameters and grain of the seeded presets, in their order."""
    rows = [(1, ORIGIN, None, None, None, None, None, 0.0)] + [(i, name, *map(float, p)) for i, (name, p) in enumerate(PRESETS.items(), 2)]
    return spark.createDataFrame(rows, "id bigint, name string, wb_shift_r double, wb_shift_b double, saturation double, contrast double, brightness double, grain_amount double")


def preset_grid(spark: SparkSession, steps: int = PRESET_STEPS) -> DataFrame:
    """id, r, g, b (steps of the cube) and red, green, blue (graded, single precision) of every preset that has a table."""
    table = presets(spark).filter("wb_shift_r is not null").withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(steps**3 - 1))))
    at = {"r": F.expr(f"cell div {steps * steps}"), "g": F.expr(f"cell div {steps} % {steps}"), "b": F.expr(f"cell % {steps}")}
    gain = lambda x: (F.lit(1.0) + F.col(x) / 100.0).cast("float")
    table = table.withColumns(at)
    full = {n: (F.col(n).cast("float") / single(steps - 1)).cast("float") for n in "rgb"}
    lift = (F.col("brightness") / 100.0).cast("float")
    out = table.withColumns({"__r": full["r"] * gain("wb_shift_r") + lift, "__g": full["g"] + lift, "__b": full["b"] * gain("wb_shift_b") + lift})
    out = out.withColumns({f"__{n}": (F.col(f"__{n}") - single(0.5)) * gain("contrast") + single(0.5) for n in "rgb"})
    out = out.withColumn("__y", luminance(F.col("__r"), F.col("__g"), F.col("__b")))
    graded = [unit(F.col("__y") + (F.col(f"__{n}") - F.col("__y")) * gain("saturation")).alias(name) for n, name in zip("rgb", ("red", "green", "blue"))]
    return out.select("id", *[F.col(n).cast("int").alias(n) for n in "rgb"], *graded)


def apply_lut(pixels: np.ndarray, lut: np.ndarray) -> np.ndarray:
    """Trilinear lookup of uint8 pixels (n, 3) in float32: along blue, then green, then red; rounded half up."""
    n = len(lut)
    at = pixels.astype(np.float32) / np.float32(255) * np.float32(n - 1)
    lo = at.astype(np.int64)
    hi = np.minimum(lo + 1, n - 1)
    f = (at - lo.astype(np.float32))[:, :, None]

    def mix(a: np.ndarray, b: np.ndarray, axis: int) -> np.ndarray:
        return a * (np.float32(1) - f[:, axis]) + b * f[:, axis]

    r, g, b = ((lo[:, i], hi[:, i]) for i in range(3))
    planes = [[mix(lut[i, j, b[0]], lut[i, j, b[1]], 2) for j in g] for i in r]
    out = mix(mix(*planes[0], 1), mix(*planes[1], 1), 0)
    return (np.clip(out, 0, 1) * np.float32(255) + np.float32(0.5)).astype(np.uint8)


def looked_up(df: DataFrame, lut: np.ndarray | None) -> DataFrame:
    """df with its bytes r, g, b taken through the table; without a table as it is."""
    if lut is None:
        return df

    def run(batches):
        for batch in batches:
            px = np.stack([batch.column(n).to_numpy(zero_copy_only=False) for n in "rgb"], 1).astype(np.uint8)
            out = apply_lut(px, lut).astype(np.int32) if len(px) else px.astype(np.int32)
            for i, n in enumerate("rgb"):
                batch = batch.set_column(batch.schema.get_field_index(n), n, pa.array(out[:, i], pa.int32()))
            yield batch

    df = df.withColumns({n: F.col(n).cast("int") for n in "rgb"})
    return df.mapInArrow(run, df.schema)


def rendered(df: DataFrame, lut: np.ndarray | None, knobs: Adjust, grain: float) -> DataFrame:
    """df(x, y, r, g, b, ...) as a recipe shows it: the preset's table, the version's knobs, the preset's grain; what is neutral is left out. A
    preview is the same with a draft's knobs."""
    return grained(adjusted(looked_up(df, lut), knobs), grain)
