"""Shared helpers of the llm operators: table access, lineage cuts, word hashing, hash exchange."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.plans.lineage import cut, drop, shared_dir  # noqa: F401
from siftwork.sources.catalog import table  # noqa: F401

#: Texts are handled in groups of about this many bytes, so that memory does not follow the Arrow batch.
GROUP_BYTES = 2 << 20
#: Documents in one group at most; group-local document numbers fit 16 bits.
GROUP_DOCS = 4096
#: Words whose hash a Python worker keeps; further words are hashed each time.
WORD_MEMO = 150_000


def parts_for(df: DataFrame, bytes_per_part: int = 64 << 20, least: int | None = None) -> int:
    """Hash parts for an exchange: at least the session's shuffle partitions (or `least`), more if the input is larger."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    by_size = size // bytes_per_part if size < 1 << 60 else 0
    return max(1, least or int(spark.conf.get("spark.sql.shuffle.partitions")), min(by_size, 1 << 20))


def parts_by(size: int | None, bytes_per_part: int, least: int) -> int:
    """Hash parts for so many bytes, as measured by a scan."""
    return max(least, -(-(size or 0) // bytes_per_part))


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The column's texts as UTF-8 bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def grouped(batch: pa.RecordBatch, text: str = "text", most: int = GROUP_BYTES, docs: int = GROUP_DOCS):
    """Slices of the batch with about `most` text bytes and `docs` rows at most, each with its texts as bytes."""
    texts = utf8(batch.column(batch.schema.get_field_index(text)))
    start = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and (held + n > most or i - start >= docs):
            yield batch.slice(start, i - start), texts[start:i]
            start, held = i, 0
        held += n
    if start < len(texts):
        yield batch.slice(start), texts[start:]


class WordHash(dict):
    """Word bytes -> 64-bit hash, remembering a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_MEMO:
            self[word] = h
        return h


_MEMO = WordHash()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_MEMO.__getitem__, words), np.uint64, len(words))


_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise."""
    x = x ^ (x >> np.uint64(32))
    x = x * _K2
    x ^= x >> np.uint64(29)
    x *= _K1
    x ^= x >> np.uint64(32)
    return x


def ngram_hashes(h: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of every n consecutive entries, order-sensitive; empty if there are fewer."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.full(m, np.uint64(seed * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF), np.uint64)
    for j in range(n):
        out ^= h[j : j + m]
        out *= _K2
        out ^= out >> np.uint64(31)
    return mixed(out)


def ranges(counts: np.ndarray) -> np.ndarray:
    """0..counts[0]-1, 0..counts[1]-1, ... in one array."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)


def rows_of(schema: pa.Schema, columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def local_session(cores: str = "8") -> SparkSession:
    """The session used by tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A public tokenizer's vocabulary file; `folder` overrides the installed place."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: A key is heavy if it holds at least this part of all rows; so there are HEAVY of them at most, whatever the size.
HEAVY = 10_000


def join_counted(rows: DataFrame, per_key: DataFrame, keys: list[str], weight: str, values: list[str], spread: list[str] | None = None, keep: bool = False) -> DataFrame:
    """Inner join of rows with per_key (a written table: one row for each key, with `weight`, the number of its rows) without a hot task:
    heavy keys, HEAVY at most by the way they are chosen, are broadcast. With `spread`, rows are read once and those of heavy keys are dealt
    by these columns; the first of the keys is a long; with `keep` rows without a match stay. Without, rows are a written table that is read twice, and only the others
    cross the network."""
    total = per_key.agg(F.sum(weight)).first()[0] or 0
    is_heavy = F.col(weight) * HEAVY >= total
    if spread is None:
        few, rest = F.broadcast(per_key.filter(is_heavy).select(*keys, *values)), per_key.filter(~is_heavy).select(*keys, *values)
        others = rows.join(few.select(*keys), keys, "left_anti").join(rest.hint("merge"), keys)  # `rest` grows with the rows: no broadcast at any size
        return rows.join(few, keys).unionByName(others)
    found = F.struct(*values)
    heavy = F.broadcast(per_key.filter(is_heavy).select(*[F.col(k).alias(f"__h_{k}") for k in keys], found.alias("__heavy")))
    light = per_key.filter(~is_heavy).select(*[F.col(k).alias(f"__l_{k}") for k in keys], found.alias("__light"), F.lit(True).alias("__l_only"))
    at = lambda side: [F.col(k) == F.col(f"__{side}_{k}") for k in keys]
    rows = rows.join(heavy, at("h"), "left").drop(*[f"__h_{k}" for k in keys])
    rows = rows.withColumn("__only", F.col("__heavy").isNull()).withColumn("__at", F.when(F.col("__only"), F.col(keys[0])).otherwise(F.xxhash64(*spread)))
    on = [F.col("__at") == F.col(f"__l_{keys[0]}"), F.col("__only") == F.col("__l_only"), *at("l")[1:]]
    done = rows.join(light, on, "left").withColumn("__found", F.coalesce("__heavy", "__light"))
    done = done if keep else done.filter("__found is not null")
    own = [c for c in done.columns if not c.startswith("__")]
    return done.select(*own, *[F.col(f"__found.{v}").alias(v) for v in values])


def quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def no_clash(df: DataFrame, needed: list[str]) -> DataFrame:
    """Only the needed columns, so that extra columns of any name can't clash."""
    return df.select(*[F.col(f"`{c}`") for c in needed])
