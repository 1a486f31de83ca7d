"""The catalog: explicit schemas, media scans and the tables derived from the bundled test tables.

Derived tables follow one rule in Spark and in SQL (VIEWS), so that every query over them has an oracle.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 1
SCHEMAS = {
    "projects": "id bigint, name string, root_path string, created_at bigint, support_raw boolean, last_image_id bigint",
    "images": "id bigint, project_id bigint, file_path string, file_name string, file_size bigint, imported_at bigint, recipe_id bigint, kind string, preview_cache_path string, captured_at bigint",
    "tags": "id bigint, project_id bigint, name string, cap bigint, is_ordered boolean, is_system boolean",
    "image_tags": "image_id bigint, tag_id bigint, position bigint, tagged_at bigint",
    "recipes": "id bigint, parent_id bigint, name string, is_system boolean, base_lut_size int, base_lut array<float>, highlights double, shadows double, wb_shift_r double, wb_shift_b double, contrast double, saturation double, blacks double, whites double, grain_amount double, created_at bigint, deleted_at bigint",
    "image_evaluations": "image_id bigint, result_json string, extra_guidance string, provider string",
}


class SchemaTooNew(ValueError):
    """The stored schema version is later than this engine's."""


def conform(df: DataFrame, name: str, version: int = SCHEMA_VERSION) -> DataFrame:
    """The table with exactly its schema's columns: columns that an earlier version lacked are added as null."""
    if version > SCHEMA_VERSION:
        raise SchemaTooNew(f"{name}: version {version}")
    schema = T._parse_datatype_string(SCHEMAS[name])
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def ship(spark: SparkSession) -> None:
    """Python workers find this package where the driver does, if they see the same folder; a cluster gets it by --py-files."""
    env = spark.sparkContext.environment
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = env.get("PYTHONPATH", "").split(os.pathsep) + os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if home not in known:
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), home]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- media scan -------------------------------------------------------------

JPEG, RAW = ("jpg", "jpeg"), ("dng", "raf")  # fixed values: extensions in any case


def extension(path: F.Column) -> F.Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def media_kind(path: F.Column) -> F.Column:
    """'jpeg', 'raw' or null, by extension in any case."""
    ext = extension(path)
    return F.when(ext.isin(*JPEG), "jpeg").when(ext.isin(*RAW), "raw")


def stem_key(path: F.Column) -> F.Column:
    """Directory and file name without its extension, case-sensitive."""
    return F.regexp_replace(path, r"\.[^./]+$", "")


def file_name(path: F.Column) -> F.Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """file_path (relative) and file_size of all files under root, without reading them; an absent root has none."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").load(root)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "file_path string, file_size bigint")
    base = root.rstrip("/").removeprefix("file://") + "/"
    return found.select(F.element_at(F.split("path", F.lit(r"\Q" + base + r"\E"), 2), -1).alias("file_path"), F.col("length").alias("file_size"))


def scan_media(files: DataFrame, support_raw: bool) -> DataFrame:
    """files(file_path, file_size) -> file_path, file_name, file_size, kind, emitted. A JPEG whose directory and stem a raw file
    shares is displaced: on disk, but not emitted. Without raw support raw files play no part."""
    media = files.withColumn("kind", media_kind(F.col("file_path"))).filter("kind is not null")
    if not support_raw:
        media = media.filter("kind = 'jpeg'")
    stems = media.filter("kind = 'raw'").select(stem_key(F.col("file_path")).alias("stem")).distinct().withColumn("has_raw", F.lit(True))
    out = media.withColumn("stem", stem_key(F.col("file_path"))).join(stems, "stem", "left")
    return out.select("file_path", file_name(F.col("file_path")).alias("file_name"), "file_size", "kind", (~((F.col("kind") == "jpeg") & F.coalesce("has_raw", F.lit(False)))).alias("emitted"))


def preview_path(root: F.Column, path: F.Column, kind: F.Column, cache: F.Column) -> F.Column:
    return F.when((kind == "raw") & cache.isNotNull(), cache).otherwise(F.concat_ws("/", root, path))


def capture_seconds(text: F.Column) -> F.Column:
    """EXIF time `yyyy:MM:dd HH:mm:ss` to epoch seconds, in the session's zone (UTC); null if malformed."""
    return F.unix_seconds(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")))


def raw_capture_seconds(seconds: F.Column) -> F.Column:
    return F.when(seconds != 0, seconds)


# ---- settings ---------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """Defaults of the engine; each key of a JSON document overrides one, anything malformed falls back."""

    dedup_window: int = 10
    dedup_threshold: int = 5
    curate_window: int = 20
    curate_threshold: int = 10
    preselection_multiple: float = 2.0
    request_timeout: int = 180
    evaluate_rejected: bool = False
    export_rejected: bool = False
    export_duplicates: bool = False
    reject_by_evaluation: bool = False
    provider: str = "local"
    language: str = ""
    prefetch: int = 3

    @classmethod
    def load(cls, text: str | None) -> "Settings":
        import json

        try:
            given = json.loads(text or "{}")
        except ValueError:
            return cls()
        if not isinstance(given, dict):
            return cls()
        kinds = {"int": int, "float": (int, float), "bool": bool, "str": str}
        ok = {f.name: given[f.name] for f in fields(cls) if f.name in given and isinstance(given[f.name], kinds[f.type]) and (f.type == "bool" or not isinstance(given[f.name], bool))}
        return cls(**ok)


# ---- tables derived from the test tables --------------------------------------


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as images: project = user, captured_at in epoch microseconds, null for every 17th."""
    e = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ext = F.expr("case event_id % 5 when 0 then '.DNG' when 1 then '.jpeg' when 2 then '.txt' else '.JPG' end")
    return e.select(
        F.col("event_id").alias("image_id"),
        F.col("user_id").alias("project_id"),
        F.when(F.col("event_id") % 17 != 0, us).alias("captured_at"),
        F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string"), F.lit("/IMG_"), F.expr("event_id div 4").cast("string"), ext).alias("file_path"),
        "event_type",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
    )


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).distinct().agg(F.sort_array(F.collect_set("name")).alias("names"))  # a handful of event types
    ranked = names.select(F.posexplode("names").alias("k", "name")).select((F.col("k") + 1).cast("long").alias("tag_id"), "name")
    return ranked.select("tag_id", "name", (F.col("tag_id") % 2 == 1).alias("is_ordered"), (F.col("name") == "error").alias("is_system"))


def image_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tags(spark, sf_dir)
    e = items(spark, sf_dir)
    return e.join(t.select("tag_id", "name"), e.event_type == t.name).select("image_id", "project_id", "tag_id", (F.col("ts_us") % 1000003).alias("position"), F.expr("ts_us div 60000000").alias("tagged_at"))


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("image_id"), F.expr("quality = 0 or toxic = 1").alias("unusable")).distinct()


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as photos with a perceptual hash: bit i says whether component i exceeds the next one."""
    e = table(spark, sf_dir, "embeddings")
    n = 64
    bits = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(F.get("embedding", i) > F.get("embedding", (i + 1) % n), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    h = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return e.select(
        F.col("vec_id").alias("image_id"),
        (F.col("vec_id") % 3).alias("project_id"),
        F.when(F.col("vec_id") % 17 != 0, F.expr("vec_id * 4 + (vec_id div 400) * 100")).alias("captured_at"),
        F.when(F.col("vec_id") % 23 != 0, h).alias("hash"),
    )


#: The same tables for the oracle, as common table expressions.
VIEWS = {
    "items": """items AS (SELECT event_id AS image_id, user_id AS project_id, CASE WHEN event_id % 17 <> 0 THEN epoch_us(ts) END AS captured_at,
      'd' || CAST(event_id % 3 AS VARCHAR) || '/IMG_' || CAST(event_id // 4 AS VARCHAR) || CASE event_id % 5 WHEN 0 THEN '.DNG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.txt' ELSE '.JPG' END AS file_path,
      event_type, epoch_us(ts) AS ts_us FROM events)""",
    "tags": """tags AS (SELECT row_number() OVER (ORDER BY name) AS tag_id, name, row_number() OVER (ORDER BY name) % 2 = 1 AS is_ordered, name = 'error' AS is_system FROM (SELECT DISTINCT event_type AS name FROM events))""",
    "image_tags": """image_tags AS (SELECT i.image_id, i.project_id, t.tag_id, i.ts_us % 1000003 AS position, i.ts_us // 60000000 AS tagged_at FROM items i JOIN tags t ON t.name = i.event_type)""",
    "evaluations": """evaluations AS (SELECT DISTINCT doc_id AS image_id, quality = 0 OR toxic = 1 AS unusable FROM labels)""",
    "shots": """shots AS (SELECT vec_id AS image_id, vec_id % 3 AS project_id, CASE WHEN vec_id % 17 <> 0 THEN vec_id * 4 + (vec_id // 400) * 100 END AS captured_at,
      CASE WHEN vec_id % 23 <> 0 THEN list_transform(range(64), lambda i: embedding[i + 1] > embedding[(i + 1) % 64 + 1]) END AS bits FROM embeddings)""",
}


def with_views(names: str, sql: str, recursive: bool = False) -> str:
    """SQL over derived tables; names in order of need."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(VIEWS[n] for n in names.split()) + (",\n" if not sql.lstrip().upper().startswith("SELECT") else "\n") + sql
