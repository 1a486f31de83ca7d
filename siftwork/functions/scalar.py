"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("B", "KB", "MB", "GB")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.floor((299 * r + 587 * g + 114 * b) / 1000).cast("int")


def dhash(grid: Column) -> Column:
    """64 bits of a row-major 9 x 8 grid of luma: bit i is set where a cell exceeds its right neighbour."""
    at = lambda i: (F.floor(i / 8) * 9 + i % 8).cast("int")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    bits = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(F.get(grid, at(i)) > F.get(grid, at(i) + 1), F.call_function("shiftleft", one, i)).otherwise(none))
    return F.aggregate(bits, none, lambda a, b: a.bitwiseOR(b))


def ceil_log2(n: Column) -> Column:
    """Least k with 2**k >= n; exact, by counting bits."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n - 1)))


def human_size(n: Column) -> Column:
    """B below 1024, else one decimal, halves rounded up."""
    out = F.format_string("%d B", n)
    for i, unit in enumerate(UNITS[1:], 1):
        out = F.when(n >= 1024**i, F.format_string(f"%.1f {unit}", F.floor(n * 10 / 1024**i + 0.5) / 10)).otherwise(out)
    return out


def fit_within(w: Column, h: Column, box_w: int, box_h: int) -> Column:
    """Size within the box at the same aspect, never enlarged."""
    s = F.least(F.lit(1.0), F.lit(float(box_w)) / w, F.lit(float(box_h)) / h)
    return F.struct(F.greatest(F.lit(1), F.floor(w * s)).cast("int").alias("w"), F.greatest(F.lit(1), F.floor(h * s)).cast("int").alias("h"))


def strip_fence(text: Column) -> Column:
    """A model's answer without the code fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*\n?", ""), r"\n?```\s*$", ""))


def strict_json(text: Column, schema: str, required: list[str]) -> Column:
    """The parsed answer, or null if a required field is missing or of another type."""
    parsed = F.from_json(strip_fence(text), schema)
    ok = F.lit(True)
    for name in required:
        ok = ok & parsed.getField(name).isNotNull()
    return F.when(ok, parsed)


def integer_picks(picks: Column) -> Column:
    """Whole numbers of an array of JSON scalars given as text; others are dropped."""
    return F.transform(F.filter(picks, lambda x: x.rlike(r"^-?\d+$")), lambda x: x.cast("long"))


def delivery_signature(paths: Column, styles: Column) -> Column:
    """First 16 hex digits of SHA-256 over a selection's paths in order and the style of each (null: none): another order or style is
    another delivery."""
    styled = F.zip_with(paths, styles, lambda p, s: F.concat(p, F.lit("="), F.coalesce(s, F.lit(""))))
    return F.substring(F.sha2(F.concat(F.array_join(paths, "|"), F.lit("||"), F.array_join(styled, "|")).cast("binary"), 256), 1, 16)
