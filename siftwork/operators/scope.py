"""Scopes: which rows a batch command applies to, and what it excludes.

A scope is `*` (all), `#tag` or `#"tag with blanks"` (that tag's rows in tag order) or `.` (ids that the caller gives, verbatim).
Tag names compare with ASCII letters folded. Results carry an ordinal, which is their order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import global_ordinal

REJECT, DUPLICATE = "拒", "重复"  # canonical names of the engine's own tags
ALIASES = {"reject": REJECT, "duplicate": DUPLICATE, REJECT: REJECT, DUPLICATE: DUPLICATE}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: which engine tags each command leaves out
EXCLUDED = {"dedup": (REJECT,), "curate": (REJECT, DUPLICATE), "pick": (REJECT, DUPLICATE), "export": (REJECT, DUPLICATE), "evaluate": (REJECT,)}


class ScopeError(ValueError):
    """kind: invalid_syntax, tag_not_found, system_tag_not_allowed or no_explicit_set."""

    def __init__(self, kind: str, what: str = ""):
        super().__init__(f"{kind}: {what}" if what else kind)
        self.kind = kind


def fold(name: F.Column) -> F.Column:
    return F.translate(name, UPPER, LOWER)


def folded(name: str) -> str:
    return name.translate(str.maketrans(UPPER, LOWER))


@dataclass(frozen=True)
class Scope:
    kind: str  # all, tag or explicit
    tag: str | None = None


def parse(text: str) -> Scope:
    text = text.strip()
    if text == "*":
        return Scope("all")
    if text == ".":
        return Scope("explicit")
    m = re.fullmatch(r'#(?:"([^"]+)"|([^\s"]+))', text)
    if not m:
        raise ScopeError("invalid_syntax", text)
    name = m[1] or m[2]
    return Scope("tag", ALIASES.get(folded(name), name))


def in_tag_order(entries: DataFrame, ordered: bool | F.Column) -> DataFrame:
    """entries(tag_id, image_id, position, tagged_at) with an ordinal in their tag: by position if the tag is ordered, else by time; ties by
    id. Tags may be few and large: all entries are numbered by range, then each tag from its first."""
    is_ordered = F.lit(ordered) if isinstance(ordered, bool) else ordered
    keyed = entries.withColumn("__key", F.when(is_ordered, F.col("position")).otherwise(F.col("tagged_at")))
    numbered = global_ordinal(keyed, [F.asc("tag_id"), F.asc("__key"), F.asc("image_id")], "__g")
    first = numbered.groupBy("tag_id").agg(F.min("__g").alias("__first"))
    return numbered.join(first, "tag_id").withColumn("ordinal", F.col("__g") - F.col("__first") + 1).drop("__key", "__g", "__first")


def resolve(scope: Scope, images: DataFrame, tags: DataFrame, image_tags: DataFrame, allow_system: bool = True, explicit: DataFrame | None = None) -> tuple[DataFrame, int | None]:
    """(ordinal, image_id) and the scope's tag id. Whether an engine tag is allowed is judged by name, before it is looked up."""
    if scope.kind == "explicit":
        if explicit is None:
            raise ScopeError("no_explicit_set")
        return explicit.select("ordinal", "image_id"), None
    if scope.kind == "all":
        order = [F.desc_nulls_last("captured_at"), F.asc("file_path"), F.asc("image_id")]
        return global_ordinal(images.select("captured_at", "file_path", "image_id"), order).select("ordinal", "image_id"), None
    if not allow_system and scope.tag in (REJECT, DUPLICATE):
        raise ScopeError("system_tag_not_allowed", scope.tag)
    found = tags.filter(fold(F.col("name")) == folded(scope.tag)).select("tag_id", "is_ordered").limit(1).collect()
    if not found:
        raise ScopeError("tag_not_found", scope.tag)
    entries = image_tags.filter(F.col("tag_id") == found[0].tag_id).join(images.select("image_id"), "image_id", "left_semi")
    return in_tag_order(entries, found[0].is_ordered).select("ordinal", "image_id"), found[0].tag_id


def exclude(rows: DataFrame, tags: DataFrame, image_tags: DataFrame, names: list[str], scope_tag: int | None = None) -> DataFrame:
    """rows without those that carry any of the named tags. Unknown names exclude nothing, and the scope's own tag isn't held against
    its rows."""
    bad = tags.filter(fold(F.col("name")).isin([folded(n) for n in names]))
    if scope_tag is not None:
        bad = bad.filter(F.col("tag_id") != scope_tag)
    gone = image_tags.join(bad.select("tag_id"), "tag_id", "left_semi").select("image_id")
    return rows.join(gone, "image_id", "left_anti")


def console_filter(rows: DataFrame, word: str, evaluations: DataFrame, rejected: DataFrame, duplicates: DataFrame) -> DataFrame:
    """The keywords over the current view: unevaluated, fail, reject, dup, fine and clear."""
    ids = lambda df: df.select("image_id").distinct()
    if word == "clear":
        return rows
    if word == "unevaluated":
        return rows.join(ids(evaluations), "image_id", "left_anti")
    if word == "fail":
        return rows.join(ids(evaluations.filter("unusable")), "image_id", "left_semi")
    if word == "reject":
        return rows.join(ids(rejected), "image_id", "left_semi")
    if word == "dup":
        return rows.join(ids(duplicates), "image_id", "left_semi")
    if word == "fine":
        return rows.join(ids(rejected).unionByName(ids(duplicates)), "image_id", "left_anti")
    raise ScopeError("invalid_syntax", word)


def pass_through(candidates: DataFrame, excluded_ids: DataFrame) -> DataFrame:
    """Candidates(image_id, system_tags) without engine tags and not excluded by id."""
    clean = candidates.filter(~F.arrays_overlap(F.coalesce("system_tags", F.array().cast("array<string>")), F.array(F.lit("Reject"), F.lit("Duplicate"))))
    return clean.join(excluded_ids.select("image_id"), "image_id", "left_anti")


MENU = 8  # a fixed value


def menu(tags: DataFrame, by: str, length: int = MENU) -> DataFrame:
    """Each project's own tags in order of id, the first `length` of them, with how many are hidden."""
    own = tags.filter("not is_system")
    n = own.groupBy(by).agg(F.count("*").alias("__n"))
    first = own.withColumn("__k", F.row_number().over(Window.partitionBy(by).orderBy("tag_id"))).filter(F.col("__k") <= length)
    return first.join(n, by).withColumn("hidden", F.greatest(F.lit(0), F.col("__n") - length)).drop("__k", "__n")
