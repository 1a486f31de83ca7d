"""Projects, rescans, evaluations and recipes as pure functions over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.sources.catalog import stem_key

from .order import global_ordinal


class ProjectError(ValueError):
    """kind: name_exists, no_images, no_images_raw_ignored, recipe_deleted, preset_protected, not_found."""

    def __init__(self, kind: str):
        super().__init__(kind)
        self.kind = kind


def create_project(projects: DataFrame, images: DataFrame, name: str, root: str, scan: DataFrame, now: int, support_raw: bool = False, raw_ignored: bool = False) -> tuple[DataFrame, DataFrame]:
    """The project and its images at once, or an error and nothing."""
    if not projects.filter(F.col("name") == name).isEmpty():
        raise ProjectError("name_exists")
    found = scan.filter("emitted")
    if found.isEmpty():
        raise ProjectError("no_images_raw_ignored" if raw_ignored else "no_images")
    pid = projects.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first().m + 1
    row = projects.sparkSession.range(1).select(*[F.lit(v).cast(dict(projects.dtypes)[k]).alias(k) for k, v in (("id", pid), ("name", name), ("root_path", root), ("created_at", now), ("support_raw", support_raw), ("last_image_id", None))])
    return projects.unionByName(row), images.unionByName(new_images(images, found, pid, now))


def new_images(images: DataFrame, found: DataFrame, project_id: int, now: int) -> DataFrame:
    start = images.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first().m
    found = global_ordinal(found, [F.asc("file_path")], "__k")
    values = {"id": F.lit(start) + F.col("__k"), "project_id": F.lit(project_id), "imported_at": F.lit(now)}
    return found.select(*[values.get(c, F.col(c) if c in found.columns else F.lit(None)).cast(t).alias(c) for c, t in images.dtypes])


def delete_project(projects: DataFrame, images: DataFrame, tags: DataFrame, image_tags: DataFrame, evaluations: DataFrame, project_id: int):
    """All five tables without the project and what belongs to it."""
    gone = images.filter(F.col("project_id") == project_id).select(F.col("id").alias("image_id"))
    return (
        projects.filter(F.col("id") != project_id),
        images.filter(F.col("project_id") != project_id),
        tags.filter(F.col("project_id") != project_id),
        image_tags.join(gone, "image_id", "left_anti"),
        evaluations.join(gone, "image_id", "left_anti"),
    )


def image_counts(projects: DataFrame, images: DataFrame) -> DataFrame:
    """Every project with its number of images, none included."""
    n = images.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("n_images"))
    return projects.join(n, "id", "left").withColumn("n_images", F.coalesce("n_images", F.lit(0)))


def rescan_actions(scan: DataFrame, catalog: DataFrame, raw_aware: bool, support_raw: bool, prune: bool = True) -> DataFrame:
    """scan(file_path, kind, captured_at, emitted) against catalog(id, file_path, kind, captured_at): file_path, id, action, name.

    match / backfill (a time that the catalog lacked) where the path is known; a raw file whose stem a catalog JPEG has becomes
    upgrade (the row keeps its id) if the project was raw-aware, else it is inserted under a name ending in _raw; other new
    files are inserted; catalog rows without a file are pruned, raw rows only if raw files were looked for."""
    s = scan.select("file_path", F.col("kind").alias("s_kind"), F.col("captured_at").alias("s_time"), F.col("emitted"))
    c = catalog.select("file_path", "id", F.col("kind").alias("c_kind"), F.col("captured_at").alias("c_time"))
    both = s.join(c, "file_path", "full_outer")
    jpegs = c.filter("c_kind = 'jpeg'").groupBy(stem_key(F.col("file_path")).alias("stem")).agg(F.min("id").alias("stem_id"))
    both = both.withColumn("stem", stem_key(F.col("file_path"))).join(jpegs, "stem", "left")
    new = F.col("id").isNull() & F.col("emitted")
    takes = new & (F.col("s_kind") == "raw") & F.col("stem_id").isNotNull()
    action = (
        F.when(F.col("id").isNotNull() & F.col("s_kind").isNotNull() & F.col("c_time").isNull() & F.col("s_time").isNotNull(), "backfill")
        .when(F.col("id").isNotNull() & F.col("s_kind").isNotNull(), "match")
        .when(takes & F.lit(raw_aware), "upgrade")
        .when(takes, "insert_raw")
        .when(new, "insert")
        .when(F.col("id").isNotNull() & F.lit(prune) & ((F.col("c_kind") != "raw") | F.lit(support_raw)), "prune")
        .otherwise("keep")
    )
    rows = both.withColumn("action", action)
    # a catalog row that is upgraded isn't pruned
    upgraded = rows.filter("action = 'upgrade'").groupBy(F.col("stem_id").alias("id")).agg(F.lit(True).alias("taken"))
    rows = rows.join(upgraded, "id", "left").withColumn("action", F.when((F.col("action") == "prune") & F.coalesce("taken", F.lit(False)), "keep").otherwise(F.col("action")))
    base = F.regexp_extract("file_path", r"([^/]*)$", 1)
    name = F.when(F.col("action") == "insert_raw", F.regexp_replace(base, r"(\.[^.]+)$", "_raw$1")).otherwise(base)
    rows = rows.filter("not (action = 'keep' and id is null)")
    return rows.select("file_path", F.when(F.col("action") == "upgrade", F.col("stem_id")).otherwise(F.col("id")).alias("id"), "action", name.alias("name"))


def rescan_totals(actions: DataFrame) -> DataFrame:
    """One row: added, upgraded, removed, total afterwards."""
    n = lambda *names: F.count_if(F.col("action").isin(*names))
    return actions.agg(n("insert", "insert_raw").alias("added"), n("upgrade").alias("upgraded"), n("prune").alias("removed"), (n("match", "backfill", "keep", "insert", "insert_raw")).alias("total"))


def apply_rescan(images: DataFrame, actions: DataFrame, scan: DataFrame, project_id: int, now: int) -> DataFrame:
    """images(id, project_id, file_path, file_name, kind, captured_at and others) of one project after the actions. A backfilled row gets its time; an
    upgraded one keeps id, tags and recipe and becomes the raw file, without the cached preview of the JPEG; new rows get ids behind the
    largest, in order of their path; pruned rows go (without_images() clears what hung on them). Columns that scan lacks are null in new rows."""
    seen = scan.select("file_path", *[F.col(x).alias(f"__{x}") for x in ("kind", "captured_at", "file_size") if x in scan.columns])
    todo = actions.select("file_path", F.col("id").alias("__id"), "action", F.col("name").alias("__name")).join(seen, "file_path", "left").withColumnRenamed("file_path", "__path")
    old = images.join(todo.filter("action in ('backfill', 'upgrade', 'prune')"), F.col("id") == F.col("__id"), "left").filter("action is null or action <> 'prune'")
    upgraded = F.coalesce(F.col("action") == "upgrade", F.lit(False))
    timed = F.coalesce(F.col("action") == "backfill", F.lit(False)) | upgraded
    raw = {"file_path": F.col("__path"), "file_name": F.col("__name"), "kind": F.col("__kind"), "preview_cache_path": F.lit(None), "file_size": F.col("__file_size") if "file_size" in scan.columns else F.lit(None)}
    changed = {x: F.when(upgraded, v.cast(images.schema[x].dataType)).otherwise(F.col(x)) for x, v in raw.items() if x in images.columns}
    changed["captured_at"] = F.when(timed, F.coalesce("__captured_at", "captured_at")).otherwise(F.col("captured_at"))
    kept = old.select(*[changed.get(x, F.col(x)).alias(x) for x in images.columns])
    top = images.agg(F.max("id")).first()[0] or 0
    new = global_ordinal(todo.filter("action in ('insert', 'insert_raw')"), [F.asc("__path")], "__n")
    own = {**raw, "id": F.col("__n") + top, "project_id": F.lit(project_id), "imported_at": F.lit(now), "captured_at": F.col("__captured_at")}
    return kept.unionByName(new.select(*[own.get(x, F.lit(None)).cast(images.schema[x].dataType).alias(x) for x in images.columns]))


def without_images(table: DataFrame, actions: DataFrame) -> DataFrame:
    """A table by image_id (tags, evaluations) without the rows of pruned images."""
    return table.join(actions.filter("action = 'prune'").select(F.col("id").alias("image_id")), "image_id", "left_anti").select(*table.columns)


# ---- evaluations ----------------------------------------------------------------

EVALUATION = "struct<assessment: string, unusable: boolean, content: string>"


def upsert_evaluations(evaluations: DataFrame, new: DataFrame) -> DataFrame:
    """The last write for an image stays."""
    return evaluations.join(new.select("image_id"), "image_id", "left_anti").unionByName(new)


def read_evaluations(evaluations: DataFrame) -> DataFrame:
    """image_id, evaluated (a row exists: the cache's meaning) and result (null unless the JSON is well-typed: the readers')."""
    parsed = F.from_json("result_json", EVALUATION)
    ok = parsed.getField("assessment").isNotNull() & parsed.getField("unusable").isNotNull()
    return evaluations.select("image_id", F.lit(True).alias("evaluated"), F.when(ok, parsed).alias("result"))


def to_evaluate(ids: DataFrame, evaluations: DataFrame) -> DataFrame:
    return ids.join(evaluations.select("image_id"), "image_id", "left_anti")


def rejects_from(evaluations: DataFrame) -> DataFrame:
    """Images that an evaluation calls unusable."""
    return read_evaluations(evaluations).filter("result.unusable").select("image_id")


# ---- recipes --------------------------------------------------------------------


def live_versions(recipes: DataFrame) -> DataFrame:
    """Versions that aren't deleted, with their number within the preset (the n of `name:n`)."""
    v = recipes.filter("parent_id is not null and deleted_at is null")
    return v.withColumn("n", F.row_number().over(Window.partitionBy("parent_id").orderBy("id")))


def resolve_address(recipes: DataFrame, address: str) -> DataFrame:
    """`name` is a preset, `name:n` its n-th live version."""
    name, colon, n = address.rpartition(":")
    if not (colon and n.isascii() and n.isdigit() and int(n) >= 1):
        return recipes.filter((F.col("name") == address) & F.col("parent_id").isNull())
    presets = recipes.filter((F.col("name") == name) & F.col("parent_id").isNull()).select(F.col("id").alias("parent_id"))
    return live_versions(recipes).filter(F.col("n") == int(n)).join(presets, "parent_id", "left_semi")


def _recipe(recipes: DataFrame, recipe_id: int):
    found = recipes.filter(F.col("id") == recipe_id).limit(1).collect()
    if not found:
        raise ProjectError("not_found")
    return found[0]


def rename_version(recipes: DataFrame, recipe_id: int, name: str) -> DataFrame:
    if _recipe(recipes, recipe_id).parent_id is None:
        raise ProjectError("preset_protected")
    return recipes.withColumn("name", F.when(F.col("id") == recipe_id, F.lit(name)).otherwise(F.col("name")))


PARAMS = ("highlights", "shadows", "wb_shift_r", "wb_shift_b", "contrast", "saturation", "blacks", "whites")  # fixed values


def create_version(recipes: DataFrame, preset_id: int, name: str | None, params: dict[str, float], now: int) -> tuple[DataFrame, int]:
    """recipes with a version of the preset, and its id, behind the largest; parameters that aren't given are 0. A version can't be derived from a
    version: that isn't found, like an id that doesn't exist."""
    if _recipe(recipes, preset_id).parent_id is not None:
        raise ProjectError("not_found")
    if set(params) - set(PARAMS):
        raise ValueError(f"parameters {sorted(set(params) - set(PARAMS))}")
    new_id = recipes.agg(F.max("id")).first()[0] + 1
    own = {"id": new_id, "parent_id": preset_id, "name": name, "is_system": False, "created_at": now, **{x: float(params.get(x, 0)) for x in PARAMS}}
    row = recipes.sparkSession.range(1).select(*[F.lit(own.get(f.name)).cast(f.dataType).alias(f.name) for f in recipes.schema.fields])
    return recipes.unionByName(row), new_id


def delete_version(recipes: DataFrame, recipe_id: int, now: int) -> DataFrame:
    if _recipe(recipes, recipe_id).parent_id is None:
        raise ProjectError("preset_protected")
    return recipes.withColumn("deleted_at", F.when(F.col("id") == recipe_id, F.lit(now)).otherwise(F.col("deleted_at")).cast("bigint"))


def set_recipe(images: DataFrame, recipes: DataFrame, ids: DataFrame, recipe_id: int | None) -> DataFrame:
    """All of ids(image_id) or none; a deleted version can't be newly applied."""
    if recipe_id is not None and _recipe(recipes, recipe_id).deleted_at is not None:
        raise ProjectError("recipe_deleted")
    wanted = ids.select(F.col("image_id").alias("id")).distinct()
    if not wanted.join(images, "id", "left_anti").isEmpty():
        raise ProjectError("not_found")
    hit = images.join(wanted.withColumn("__hit", F.lit(True)), "id", "left")
    return hit.withColumn("recipe_id", F.when(F.col("__hit"), F.lit(recipe_id).cast("bigint")).otherwise(F.col("recipe_id"))).select(*images.columns)


def count_with_recipe(ids: DataFrame, images: DataFrame) -> DataFrame:
    """How many of ids have a recipe; repeated ids count each time, unknown ones don't."""
    return ids.join(images.select(F.col("id").alias("image_id"), "recipe_id"), "image_id").agg(F.count("recipe_id").alias("n"))


def looks(recipes: DataFrame) -> DataFrame:
    """Each recipe with the preset that its look comes from."""
    base = recipes.select(F.col("id").alias("preset_id"), F.col("name").alias("preset_name"))
    return recipes.withColumn("preset_id", F.coalesce("parent_id", "id")).join(base, "preset_id", "left")
