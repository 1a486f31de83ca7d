"""Export manifests: which item goes to which file, in order."""

from __future__ import annotations

import contextlib
import itertools
import os
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.operators import scope
from siftwork.operators.order import global_ordinal
from siftwork.plans.lineage import cut

from .catalog import file_name, media_kind, stem_key


def target_names(rows: DataFrame, ordered: bool, by: list[str]) -> DataFrame:
    """rows(by, ordinal, file_path) with target: raw files become .jpg; ordered targets get a number of max(2, digits of n) places."""
    name = file_name(F.col("file_path"))
    name = F.when(media_kind(F.col("file_path")) == "raw", F.concat(stem_key(name), F.lit(".jpg"))).otherwise(name)
    if ordered:
        rows = rows.join(rows.groupBy(*by).agg(F.count("*").alias("__n")), by)  # counted before it is joined
        width = F.greatest(F.lit(2), F.length(F.col("__n").cast("string")))
        number = F.col("ordinal").cast("string")
        name = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), width - F.length(number))), number, F.lit("_"), name)
    return rows.withColumn("target", name).drop("__n")


SUFFIX = "_([2-9]|[1-9][0-9]+)"  # as a collision makes it
#: A name is heavy if this part of all rows extends it; so there are HEAVY of them at most.
HEAVY = 10_000


def _extended(named: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(met, heavy) of named(by, __stem, __ext): the names that are there and that another one extends by one suffix, and the names, there or not,
    that so many rows extend that a join should not send these to one task."""
    parent = F.regexp_replace("__stem", f"{SUFFIX}$", "")
    own, up = F.struct(F.col("__stem").alias("__name"), F.lit(0).alias("__n")), F.struct(parent.alias("__name"), F.lit(1).alias("__n"))
    each = named.select(*by, "__ext", F.explode(F.when(F.col("__stem").rlike(f"{SUFFIX}$"), F.array(own, up)).otherwise(F.array(own))).alias("x")).select(*by, F.col("x.__name").alias("__stem"), "__ext", "x.__n")
    known = each.groupBy(*by, "__stem", "__ext").agg(F.sum("__n").alias("__n"), (F.min("__n") == 0).alias("__there")).filter("__n > 0")
    heavy = F.col("__n") * HEAVY >= named.count()
    known = cut(known.filter(F.col("__there") | heavy), "names-met")
    return known.filter("__there"), known.filter(heavy)


def _found(rows: DataFrame, table: DataFrame, heavy: DataFrame, by: list[str], value: str, spread: list[str]) -> DataFrame:
    """rows(by, __up, __ext) with the value of the table(by, __stem, __ext, value) for the name __up, or null. Rows of a heavy name are
    dealt over all tasks by `spread`."""
    keys = [*by, "__stem", "__ext"]
    to = lambda side: [F.col(k).alias(f"__{side}{i}") for i, k in enumerate(keys)]
    at = lambda side, up: [F.col(k if k != "__stem" else up).eqNullSafe(F.col(f"__{side}{i}")) if k != "__stem" else F.col(up) == F.col(f"__{side}{i}") for i, k in enumerate(keys)]
    few = heavy.select(*keys).join(table.select(*keys, value), keys, "left").select(*to("h"), F.col(value).alias("__few"), F.lit(True).alias("__heavy"))
    rest = table.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").select(*to("l"), F.col(value).alias("__rest"), F.lit(True).alias("__light"))
    dealt = rows.join(F.broadcast(few), at("h", "__up"), "left").withColumn("__own", F.col("__heavy").isNull() & F.col("__up").isNotNull())
    dealt = dealt.withColumn("__at", F.when(F.col("__own"), F.col("__up")).otherwise(F.xxhash64(*spread).cast("string")))
    done = dealt.join(rest, [*at("l", "__at"), F.col("__own") == F.col("__light")], "left")
    return done.select(*rows.columns, F.coalesce("__few", "__rest").alias(value))


def _roots(met: DataFrame, heavy: DataFrame, by: list[str]) -> DataFrame:
    """met with the root of each name: the first in its line of names without their last suffixes, as far as these are there."""
    tail = F.regexp_extract("__stem", f"((?:{SUFFIX})*)$", 1)
    depth = F.when(F.length(tail) > 0, F.size(F.split(tail, "_")) - 1).otherwise(0)
    there = met.select(*by, "__stem", "__ext", F.lit(True).alias("__seen"))
    up = met.select(*by, F.col("__stem").alias("__name"), "__ext", F.explode(F.sequence(F.lit(0), depth)).alias("__level"), depth.alias("__depth"))
    up = up.withColumn("__up", F.expr(f"regexp_replace(__name, concat('(?:{SUFFIX}){{', __level, '}}$'), '')"))
    seen = _found(up, there, heavy, by, "__seen", ["__name", "__level"])
    gap = seen.groupBy(*by, "__name", "__ext").agg(F.coalesce(F.min(F.when(F.col("__seen").isNull(), F.col("__level"))), F.max("__depth") + 1).alias("__gap"))
    root = F.expr(f"regexp_replace(__name, concat('(?:{SUFFIX}){{', __gap - 1, '}}$'), '')")
    return cut(gap.select(*by, F.col("__name").alias("__stem"), "__ext", root.alias("__root")), "names-roots")


def resolve_collisions(rows: DataFrame, by: list[str], taken: DataFrame | None = None) -> DataFrame:
    """rows(by, ordinal, target): one folder for each `by`, filled in order; taken(by, target): what lies in the folders before, and keeps its name. A name that is taken gets the first free of _2, _3... before
    its extension. Names can only meet if one is another of the folder with such a suffix: a family. Where a family has one name, its
    places in order give the suffixes; where it has several, it is gone through in order, which holds the names of one family in
    one folder. The rows are written first and dealt out twice: to find the root of the name that theirs extends, and by family; where no name extends
    another, by family alone."""
    columns = rows.columns
    if taken is not None:  # as if it were written first
        first = F.lit(-(2**31)).cast(rows.schema["ordinal"].dataType)
        rows = rows.unionByName(taken.select(*by, "target").distinct().withColumns({"ordinal": first, "__kept": F.lit(True)}), True)
    ext = F.regexp_extract("target", r"[^.](\.[^.]*)$", 1)
    named = cut(rows.withColumn("__ext", ext).withColumn("__stem", F.expr("left(target, char_length(target) - char_length(__ext))")), "names")
    met, heavy = _extended(named, by)
    family = [*by, "__root", "__ext"]
    plain = met.isEmpty()
    if plain:
        named = named.withColumn("__root", F.col("__stem"))
    else:
        up = named.withColumn("__up", F.when(F.col("__stem").rlike(f"{SUFFIX}$"), F.regexp_replace("__stem", f"{SUFFIX}$", "")))
        named = _found(up, _roots(met, heavy, by), heavy, by, "__root", ["target", "ordinal"]).drop("__up").withColumn("__root", F.coalesce("__root", "__stem"))
    whole = Window.partitionBy(*family)
    named = named.repartition(*family).withColumn("__k", F.row_number().over(whole.orderBy("ordinal")))
    one = F.lit(True) if plain else F.min("target").over(whole) == F.max("target").over(whole)
    named = named.withColumn("__one", one)
    named = named.withColumn("target", F.when(F.col("__one") & (F.col("__k") > 1), F.concat("__stem", F.lit("_"), F.col("__k").cast("string"), "__ext")).otherwise(F.col("target"))).drop("__k")

    def fill(batches):  # rows of families of one name pass
        this, held, following = None, set(), {}
        for some in batches:
            out = some["target"].to_pylist()
            for i, (one, stem, *key) in enumerate(zip(*[some[name].to_pylist() for name in ("__one", "__stem", *family)])):
                if one is not False:
                    continue
                if key != this:
                    this, held, following = key, set(), {}
                ext = key[-1]
                name, k = stem + ext, following.get(stem, 2)
                while name in held:
                    name, k = f"{stem}_{k}{ext}", k + 1
                if name != stem + ext:
                    following[stem] = k
                held.add(name)
                out[i] = name
            yield some.set_column(some.schema.get_field_index("target"), "target", pa.array(out, pa.string()))

    out = named if plain else named.sortWithinPartitions(*family, "ordinal").mapInArrow(fill, named.schema)
    out = out.select(*rows.columns)
    return out if taken is None else out.filter("__kept is null").select(*columns)


def left_out(entries: DataFrame, tags: DataFrame, image_tags: DataFrame, include_reject: bool = False, include_dup: bool = False, scope_tag: int | None = None) -> DataFrame:
    """entries without rejects and duplicates, unless they are asked for or are the scope itself."""
    names = [name for name, keep in ((scope.REJECT, include_reject), (scope.DUPLICATE, include_dup)) if not keep]
    return scope.exclude(entries, tags, image_tags, names, scope_tag) if names else entries


MANIFEST = ["image_id", "ordinal", "file_path", "target", "route", "reason"]


def planned(entries: DataFrame, images: DataFrame, ordered: bool = False, present: DataFrame | None = None) -> DataFrame:
    """MANIFEST of entries(ordinal, image_id) of one folder before names that meet are told apart: the ordinal counts from 1 without gaps, also what
    is skipped. Ids without an image are left out. present(file_path): files that are there; another's reason is source_missing."""
    known = entries.join(images.select(F.col("id").alias("image_id"), "file_path", "kind", "recipe_id"), "image_id")
    rows = global_ordinal(known.withColumnRenamed("ordinal", "__old"), [F.asc("__old"), F.asc("image_id")]).withColumn("__folder", F.lit(0))
    named = target_names(rows, ordered, ["__folder"])
    reason = F.lit(None).cast("string")
    if present is not None:
        named = named.join(present.select("file_path").distinct().withColumn("__there", F.lit(True)), "file_path", "left")
        reason = F.when(F.col("__there").isNull(), F.lit("source_missing"))
    named = named.withColumn("reason", reason)
    return named.withColumn("route", F.when(F.col("reason").isNull(), write_route(F.col("kind"), F.col("recipe_id")))).select(*MANIFEST)


def settled(rows: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """A planned manifest, with the reasons of what has failed, under its final names: one that is skipped or failed takes a number but no
    name. taken(target): what lies in the folder."""
    folder = F.lit(0).alias("__folder")
    there = None if taken is None else taken.select(folder, "target")
    written = resolve_collisions(rows.filter("reason is null").select(folder, *MANIFEST), ["__folder"], there).select(*MANIFEST)
    return written.unionByName(rows.filter("reason is not null").withColumn("target", F.lit(None).cast("string")).select(*MANIFEST))


def batch(entries: DataFrame, images: DataFrame, ordered: bool = False, present: DataFrame | None = None, taken: DataFrame | None = None) -> DataFrame:
    """The manifest of entries(ordinal, image_id) of one folder, if every write succeeds."""
    return settled(planned(entries, images, ordered, present), taken)


def export_tag(tag_id: int, tags: DataFrame, image_tags: DataFrame, images: DataFrame, include_reject: bool = False, include_dup: bool = False, present: DataFrame | None = None, taken: DataFrame | None = None) -> DataFrame:
    """The manifest of one tag, in its order; numbered if the tag is ordered. Exporting the reject or duplicate tag itself keeps its rows."""
    found = tags.filter(F.col("tag_id") == tag_id).select("is_ordered").limit(1).collect()
    if not found:
        raise scope.ScopeError("tag_not_found", str(tag_id))
    entries = scope.in_tag_order(image_tags.filter(F.col("tag_id") == tag_id), found[0].is_ordered).select("ordinal", "image_id")
    return batch(left_out(entries, tags, image_tags, include_reject, include_dup, tag_id), images, found[0].is_ordered, present, taken)


def export_images(ids: DataFrame, tags: DataFrame, image_tags: DataFrame, images: DataFrame, include_reject: bool = False, include_dup: bool = False, present: DataFrame | None = None, taken: DataFrame | None = None) -> DataFrame:
    """The manifest of ids(ordinal, image_id), under their own names in the order given."""
    return batch(left_out(ids.select("ordinal", "image_id"), tags, image_tags, include_reject, include_dup), images, False, present, taken)


def export_image(image_id: int, images: DataFrame, present: DataFrame | None = None, taken: DataFrame | None = None) -> DataFrame:
    """The manifest of one image; no exclusion. An image that isn't there is an error."""
    one = images.filter(F.col("id") == image_id).select(F.lit(1).cast("long").alias("ordinal"), F.col("id").alias("image_id"))
    if one.isEmpty():
        raise scope.ScopeError("image_not_found", str(image_id))
    return batch(one, images, False, present, taken)


def outcome(manifest: DataFrame) -> DataFrame:
    """One row: exported, and skipped by reason."""
    return manifest.groupBy(F.coalesce("reason", F.lit("exported")).alias("outcome")).agg(F.count("*").alias("n"))


def write_route(kind: F.Column, recipe_id: F.Column) -> F.Column:
    """How an item is written: decode a raw, bake a recipe, else copy its bytes."""
    return F.when(kind == "raw", F.lit("decode")).when(recipe_id.isNotNull(), F.lit("bake")).otherwise(F.lit("copy"))


def write_batch(rows: DataFrame, write: Callable[[dict], None]) -> DataFrame:
    """Runs the injected writer for each row: image_id, exported, reason. A row that fails is skipped with its reason; the batch goes
    on."""
    schema = pa.schema([("image_id", pa.int64()), ("exported", pa.bool_()), ("reason", pa.string())])

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    write(row)
                    out.append((row["image_id"], True, None))
                except Exception as e:  # the writer is the caller's; its failure is the row's result
                    out.append((row["image_id"], False, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out) if out else [[], [], []], schema)], schema=schema)

    return rows.mapInArrow(run, "image_id bigint, exported boolean, reason string")


def in_folder(spark: SparkSession, folder: str) -> DataFrame:
    """target: all names in a shared folder, hidden ones and folders too, none if it isn't there. A listing is one task, which holds a
    few thousand names at a time."""

    def run(batches):
        for _ in batches:
            with contextlib.suppress(FileNotFoundError), os.scandir(folder) as names:
                for some in itertools.batched((x.name for x in names), 4096):
                    yield pa.RecordBatch.from_pydict({"target": pa.array(some, pa.string())})

    return spark.range(1).coalesce(1).mapInArrow(run, "target string")


def write_folder(rows: DataFrame, folder: str, write: Callable[[dict, str], None], staging: str = ".staging") -> DataFrame:
    """Writes a planned manifest to a shared folder and returns it as it was settled.

    First each row is written by the injected writer to a name of its task attempt in a staging folder, and what came of it is a row of a table, so
    that an attempt that is lost leaves nothing but a file nobody names. Then names are given to what was written, in order, beside what lies in the
    folder: a failed row's name goes to the next. Last the files are moved; one that is moved again by a repeated task is left alone, and no
    file is overwritten: a name that another took meanwhile makes the reason target_exists. A folder that can't be made is an io_error."""
    waiting = os.path.join(folder, staging)
    try:
        os.makedirs(waiting, exist_ok=True)
    except OSError as e:
        raise scope.ScopeError("io_error", str(e)) from e
    added = pa.schema([("__staged", pa.string()), ("__failed", pa.string())])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*MANIFEST).schema)

    def stage(batches):
        for some in batches:
            staged, failed = [], []
            for row in some.to_pylist():
                path, reason = os.path.join(waiting, f"{row['image_id']}-{uuid.uuid4().hex}"), None
                try:
                    write(row, path)
                except Exception as e:  # the writer is the caller's; its failure is the row's result
                    reason = str(e) or type(e).__name__
                staged.append(path)
                failed.append(reason)
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(staged, pa.string()), pa.array(failed, pa.string())], schema=pa.schema([*some.schema, *added]))

    tried = cut(rows.filter("reason is null").select(*MANIFEST).mapInArrow(stage, f"{fields}, __staged string, __failed string"), "staged")
    outcomes = tried.withColumn("reason", F.col("__failed")).select(*MANIFEST).unionByName(rows.filter("reason is not null").select(*MANIFEST))
    taken = in_folder(rows.sparkSession, folder).filter(F.col("target") != staging)
    named = cut(settled(outcomes, taken).join(tried.filter("__failed is null").select("ordinal", "__staged"), "ordinal", "left").select(*MANIFEST, "__staged"), "named")

    def move(batches):
        for some in batches:
            reasons = []
            for row in some.to_pylist():
                reason = row["reason"]
                if reason is None:
                    path, target = row["__staged"], os.path.join(folder, row["target"])
                    try:
                        os.link(path, target)
                    except FileExistsError:
                        if not (os.path.exists(path) and os.path.samefile(path, target)):
                            reason = "target_exists"
                    except FileNotFoundError:  # moved by an earlier attempt of this task
                        reason = None if os.path.exists(target) else "staged_lost"
                    if reason is None:
                        with contextlib.suppress(FileNotFoundError):
                            os.remove(path)
                reasons.append(reason)
            some = some.select(MANIFEST)
            yield some.set_column(some.schema.get_field_index("reason"), "reason", pa.array(reasons, pa.string()))

    moved = cut(named.mapInArrow(move, fields), "moved")
    return moved.withColumn("target", F.when(F.col("reason").isNull(), F.col("target")))


def listing(images: DataFrame, evaluations: DataFrame, image_tags: DataFrame, tags: DataFrame) -> DataFrame:
    """Per image: evaluated, unusable (null if it isn't), its tags and engine tags by name."""
    named = image_tags.join(tags.select("tag_id", "name", "is_system"), "tag_id")
    lists = named.groupBy("image_id").agg(F.sort_array(F.collect_set(F.when(~F.col("is_system"), F.col("name")))).alias("tags"), F.sort_array(F.collect_set(F.when(F.col("is_system"), F.col("name")))).alias("system_tags"))
    none = F.array().cast("array<string>")
    out = images.join(evaluations.withColumn("evaluated", F.lit(True)), "image_id", "left").join(lists, "image_id", "left")
    return out.select("image_id", "file_path", F.coalesce("evaluated", F.lit(False)).alias("evaluated"), "unusable", F.coalesce("tags", none).alias("tags"), F.coalesce("system_tags", none).alias("system_tags"))
