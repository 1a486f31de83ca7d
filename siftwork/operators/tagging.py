"""Tag tables as pure functions: every change maps the old table to the new one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import global_ordinal
from .scope import DUPLICATE, REJECT, fold, folded


class TagError(ValueError):
    """kind: exists, not_found, cap_exceeded, other_project, system_tag. `entries`: for a cap, what the tag holds in order."""

    def __init__(self, kind: str, entries: list | None = None):
        super().__init__(kind)
        self.kind, self.entries = kind, entries or []


def create_tag(tags: DataFrame, project_id: int, name: str, cap: int | None = None, ordered: bool = False, system: bool = False) -> DataFrame:
    if not tags.filter((F.col("project_id") == project_id) & (fold(F.col("name")) == folded(name))).isEmpty():
        raise TagError("exists")
    new = tags.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("id")).select("id", *[F.lit(v).cast(t).alias(k) for k, v, t in (("project_id", project_id, "bigint"), ("name", name, "string"), ("cap", cap, "bigint"), ("is_ordered", ordered, "boolean"), ("is_system", system, "boolean"))])
    return tags.unionByName(new)


def ensure_system_tags(tags: DataFrame, project_id: int) -> DataFrame:
    for name in (REJECT, DUPLICATE):
        try:
            tags = create_tag(tags, project_id, name, system=True)
        except TagError:
            pass  # there already
    return tags


def _tag(tags: DataFrame, tag_id: int):
    found = tags.filter(F.col("id") == tag_id).limit(1).collect()
    if not found:
        raise TagError("not_found")
    return found[0]


def entries_in_order(image_tags: DataFrame, tag_id: int, ordered: bool) -> list[int]:
    key = "position" if ordered else "tagged_at"
    return [r.image_id for r in image_tags.filter(F.col("tag_id") == tag_id).orderBy(key, "image_id").select("image_id").collect()]


def add_entries(image_tags: DataFrame, tags: DataFrame, images: DataFrame, tag_id: int, ids: DataFrame, now: int) -> DataFrame:
    """All of ids(ordinal, image_id) or none: repeats count once, entries that are there stay as they are, and the cap is judged on
    the whole batch."""
    tag = _tag(tags, tag_id)
    wanted = ids.groupBy("image_id").agg(F.min("ordinal").alias("ordinal"))
    own = images.select(F.col("id").alias("image_id"), F.col("project_id").alias("__p"))
    placed = wanted.join(own, "image_id", "left")
    if not placed.filter(F.col("__p").isNull() | (F.col("__p") != tag.project_id)).isEmpty():
        raise TagError("other_project")
    held = image_tags.filter(F.col("tag_id") == tag_id)
    new = wanted.join(held.select("image_id"), "image_id", "left_anti")
    if tag.cap is not None:
        n_new = new.count()
        if n_new and held.count() + n_new > tag.cap:
            raise TagError("cap_exceeded", entries_in_order(image_tags, tag_id, tag.is_ordered))
    start = held.agg(F.coalesce(F.max("position"), F.lit(0)).alias("last")).first().last if tag.is_ordered else None
    new = global_ordinal(new, [F.asc("ordinal"), F.asc("image_id")], "__k") if tag.is_ordered else new
    position = F.lit(start).cast("bigint") + F.col("__k") if tag.is_ordered else F.lit(None).cast("bigint")
    rows = new.select("image_id", F.lit(tag_id).cast("bigint").alias("tag_id"), position.alias("position"), F.lit(now).cast("bigint").alias("tagged_at"))
    return image_tags.unionByName(rows)


def remove_entry(image_tags: DataFrame, tag_id: int, image_id: int) -> DataFrame:
    return image_tags.filter(~((F.col("tag_id") == tag_id) & (F.col("image_id") == image_id)))


def remove_entries(image_tags: DataFrame, tag_id: int, ids: DataFrame) -> DataFrame:
    gone = ids.select("image_id", F.lit(tag_id).cast("bigint").alias("tag_id")).distinct()
    return image_tags.join(gone, ["image_id", "tag_id"], "left_anti")


def clear_tag(image_tags: DataFrame, tag_id: int) -> DataFrame:
    return image_tags.filter(F.col("tag_id") != tag_id)


def replace_entry(image_tags: DataFrame, tag_id: int, old: int, new: int, now: int) -> DataFrame:
    """new takes old's place; an entry of new's own goes."""
    here = F.col("tag_id") == tag_id
    if image_tags.filter(here & (F.col("image_id") == old)).isEmpty():
        raise TagError("not_found")
    rest = image_tags.filter(~(here & (F.col("image_id") == new))) if old != new else image_tags
    swap = here & (F.col("image_id") == old)
    return rest.withColumn("tagged_at", F.when(swap, F.lit(now)).otherwise(F.col("tagged_at"))).withColumn("image_id", F.when(swap, F.lit(new)).otherwise(F.col("image_id")))


def delete_tag(tags: DataFrame, image_tags: DataFrame, tag_id: int) -> tuple[DataFrame, DataFrame]:
    if _tag(tags, tag_id).is_system:
        raise TagError("system_tag")
    return tags.filter(F.col("id") != tag_id), clear_tag(image_tags, tag_id)


def tag_duplicates(image_tags: DataFrame, scope_ids: DataFrame, losers: DataFrame, tag_id: int, now: int) -> DataFrame:
    """The duplicate tag anew: cleared over the whole scope, then given to the losers."""
    kept = image_tags.join(scope_ids.select("image_id", F.lit(tag_id).cast("bigint").alias("tag_id")), ["image_id", "tag_id"], "left_anti")
    have = kept.filter(F.col("tag_id") == tag_id).select("image_id")
    new = losers.select("image_id").distinct().join(have, "image_id", "left_anti")
    return kept.unionByName(new.select("image_id", F.lit(tag_id).cast("bigint").alias("tag_id"), F.lit(None).cast("bigint").alias("position"), F.lit(now).cast("bigint").alias("tagged_at")))


def tag_counts(tags: DataFrame, image_tags: DataFrame) -> DataFrame:
    """Every tag with its number of entries, none included; counted before it is joined."""
    n = image_tags.groupBy("tag_id").agg(F.count("*").alias("n_images"))
    return tags.join(n, "tag_id", "left").withColumn("n_images", F.coalesce("n_images", F.lit(0)))


def tags_of_images(tags: DataFrame, image_tags: DataFrame) -> DataFrame:
    """A row for each image and tag of it, with the tag's name and number of entries; tags are counted once, before they are joined."""
    return image_tags.select("image_id", "tag_id").join(tag_counts(tags, image_tags), "tag_id")


def next_positions(image_tags: DataFrame) -> DataFrame:
    return image_tags.groupBy("tag_id").agg((F.coalesce(F.max("position"), F.lit(0)) + 1).alias("next_position"))


def apply_tag(tags: DataFrame, image_tags: DataFrame, images: DataFrame, project_id: int, name: str, ids: DataFrame, now: int, on_cap: str = "fail") -> tuple[DataFrame, DataFrame, bool]:
    """Tags ids with the named tag, which is made if it is absent. on_cap 'skip' leaves all as it was; the last value says
    whether entries were added."""
    found = tags.filter((F.col("project_id") == project_id) & (fold(F.col("name")) == folded(name))).select("id").limit(1).collect()
    if not found:
        tags = create_tag(tags, project_id, name)
        found = tags.filter((F.col("project_id") == project_id) & (F.col("name") == name)).select("id").collect()
    try:
        return tags, add_entries(image_tags, tags, images, found[0].id, ids, now), True
    except TagError as e:
        if e.kind != "cap_exceeded" or on_cap != "skip":
            raise
        return tags, image_tags, False
