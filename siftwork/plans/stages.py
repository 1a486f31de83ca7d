"""The stages of a run over a project's tables: ingest, dedup, curate, style, style_all, deliver.

Stages read and replace the tables of a Catalog. The selection that they hand on is a table too, since without a count all survivors are
delivered; only its head and counts reach the driver, and what is sent streams through it in order. Services are injected callables. start() makes a run from an intent's answer, which is all that a watch folder, a chat or a one-shot command differ in.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions import scalar
from siftwork.operators import commands, projects, replies, scope, select
from siftwork.operators.order import global_ordinal
from siftwork.sources import export

from .lineage import cut
from .runs import Run, Stage, validate_plan


@dataclass
class Catalog:
    """One project's tables. sent: signature, image_id of what was delivered."""

    project_id: int
    images: DataFrame  # image_id, project_id, file_path, kind, captured_at, hash, recipe_id
    tags: DataFrame
    image_tags: DataFrame
    recipes: DataFrame
    sent: DataFrame


@dataclass
class Services:
    send: Callable[[dict], None]  # a row of the manifest
    match: Callable[[str, list[str]], dict] | None = None  # description, preset names -> a model's answer
    compare: Callable | None = None
    evaluate: Callable | None = None
    choose: Callable | None = None
    gate: Callable | None = None
    cancelled: Callable[[], bool] = lambda: False


#: Sent pictures that are marked together.
MARKS = 50


class StageError(RuntimeError):
    pass


def _styled(cat: Catalog, ids: DataFrame, recipe_id: int) -> None:
    images = cat.images.withColumnRenamed("image_id", "id")
    cat.images = cut(projects.set_recipe(images, cat.recipes, ids, recipe_id).withColumnRenamed("id", "image_id"), "styled")


def _preset(cat: Catalog, name: str) -> int:
    found = projects.resolve_address(cat.recipes, name).select("id").first()
    if found is None:
        raise StageError(f"no preset {name!r}")
    return found.id


def stages(cat: Catalog, services: Services, now: int) -> dict[str, Stage]:
    """The stages by name; dedup and curate use a model only where their parameters say so."""

    def ingest(inputs: dict, params: dict) -> dict:
        return {"images": cat.images.count()}

    def dedup(inputs: dict, params: dict) -> dict:
        ai = {"compare": services.compare, "gate": services.gate} if params.get("ai_enabled") else {}
        out = commands.dedup(cat.project_id, cat.images.select("image_id"), cat.images, cat.tags, cat.image_tags, now, cancelled=services.cancelled, **ai)
        if out.outcome in ("declined", "cancelled"):
            raise StageError(out.outcome)
        cat.tags, cat.image_tags = out.tags, out.image_tags
        return {"tagged": out.tagged, "remaining": out.remaining}

    def curate(inputs: dict, params: dict) -> dict:
        """selection: ordinal, image_id, file_path. With a count: the command, asked for as many more as are to be left out. Without: all
        images that carry no engine tag pass through. What is left out goes after the selection, and the tag holds the rest anew, in order."""
        left_out = cat.images.filter(F.col("file_path").isin(params.get("exclude") or [])).select("image_id")
        caption = ""
        if params["count"] is None:
            own = cat.images.filter(F.col("project_id") == cat.project_id)
            shown = F.when(F.col("name") == scope.REJECT, "Reject").when(F.col("name") == scope.DUPLICATE, "Duplicate")  # as listings name them
            marks = cat.tags.filter("is_system").select(F.col("id").alias("tag_id"), shown.alias("name"))
            marked = cat.image_tags.join(marks, "tag_id").groupBy("image_id").agg(F.collect_set("name").alias("system_tags"))
            passed = scope.pass_through(own.select("image_id", "file_path").join(marked, "image_id", "left"), left_out)
            selection = cut(global_ordinal(passed.select("image_id", "file_path"), [F.asc("image_id")]).select("ordinal", "image_id", "file_path"), "selection")
            cat.tags, cat.image_tags = commands.retagged(cat.project_id, cat.images, cat.tags, cat.image_tags, selection, params["apply_tag"], now)
        else:
            ai = {"compare": services.compare, "evaluate": services.evaluate, "choose": services.choose, "gate": services.gate} if params.get("ai_enabled") else {}
            out = commands.curate(cat.project_id, cat.images.select("image_id"), cat.images, cat.tags, cat.image_tags, params["count"], params["apply_tag"], now, exclude=left_out, cancelled=services.cancelled, **ai)
            if out.outcome != "done":
                raise StageError(out.outcome)
            cat.tags, cat.image_tags, caption = out.tags, out.image_tags, out.caption
            selection = cut(out.selected.select("ordinal", "image_id", "file_path"), "selection")
        return {"selection": selection, "requested": params["count"], "returned": selection.count(), "caption": caption}

    def style(inputs: dict, params: dict) -> dict:
        """Matches the description to a preset and applies it to the first of the selection; without a description pictures stay as they are."""
        if not params.get("description"):
            return {"recipe": None, "applied": 0}
        names = [r.name for r in cat.recipes.filter("parent_id is null").orderBy("id").select("name").collect()]
        name = replies.style_of(services.match(params["description"], names), names)
        first = inputs["curate"]["selection"].filter("ordinal = 1")
        _styled(cat, first, _preset(cat, name))
        return {"recipe": name, "applied": first.count()}

    def style_all(inputs: dict, params: dict) -> dict:
        """The style of the first on all others that are still there; the stage fails only if none of them is."""
        recipe = inputs["style"]["recipe"]
        if not recipe:
            return {"recipe": None, "failed": 0}
        others = inputs["curate"]["selection"].filter("ordinal > 1")
        there = cut(others.join(cat.images.select("image_id"), "image_id", "left_semi"), "others")
        failed = others.count() - there.count()
        if failed and there.isEmpty():
            raise StageError(f"no style could be applied to {failed} pictures")
        _styled(cat, there, _preset(cat, recipe))
        return {"recipe": recipe, "failed": failed}

    def deliver(inputs: dict, params: dict) -> dict:
        """Sends what wasn't sent under this selection, order and styles, and marks each at once, so that a run after a failure goes on."""
        selection, recipe = inputs["curate"]["selection"], inputs["style_all"]["recipe"]
        styled = F.lit(recipe).cast("string")
        rows = F.sort_array(F.collect_list(F.struct("ordinal", "file_path", styled.alias("style"))))
        key = selection.agg(rows.alias("rows")).select(F.col("rows.file_path").alias("paths"), F.col("rows.style").alias("styles"))  # a signature is over all of a selection
        signature = key.select(scalar.delivery_signature(F.col("paths"), F.col("styles")).alias("s")).first().s
        manifest = export.batch(selection.select("ordinal", "image_id"), cat.images.withColumnRenamed("image_id", "id"))
        before = cat.sent.filter(F.col("signature") == signature).select("image_id")
        todo = cut(manifest.join(before, "image_id", "left_anti").filter("reason is null"), "deliver").orderBy("ordinal")
        sent, held = 0, []
        spark = cat.images.sparkSession

        def mark() -> None:
            if held:
                cat.sent = cut(cat.sent.unionByName(spark.createDataFrame(held, "signature string, image_id bigint")), "sent")
                held.clear()

        try:
            for row in todo.toLocalIterator():
                services.send(row.asDict())
                held.append((signature, row.image_id))
                sent += 1
                if len(held) >= MARKS:
                    mark()
        finally:
            mark()
        mine = selection.select("image_id").withColumn("project_id", F.lit(0))
        done = select.already_delivered(mine, cat.sent.filter(F.col("signature") == signature)).first()
        return {"signature": signature, "sent": sent, "delivered": done is None or done.delivered}

    needs = {"dedup": ("ingest",), "curate": ("ingest",), "style": ("curate",), "style_all": ("curate", "style"), "deliver": ("curate", "style_all")}
    return {f.__name__: Stage(f.__name__, f, needs.get(f.__name__, ())) for f in (ingest, dedup, curate, style, style_all, deliver)}


def start(answer: dict, cat: Catalog, services: Services, now: int, description: str | None = None, gates: bool = True) -> Run:
    """A run of an intent, up to its first gate. gates=False: nobody answers, as in a watch folder, so gates are open."""
    plan = replies.plan_of(answer)
    validate_plan(plan)
    for s in plan:
        if s.name == "style":
            s.params["description"] = description
        if not gates and s.params.get("count", 0) is not None:
            s.gate = "off"
    run = Run(plan, stages(cat, services, now))
    run.advance()
    return run
