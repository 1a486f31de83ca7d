"""The engine's commands as functions from tables to tables: dedup, curate and pick over a scope, each with its exclusion, gates and tags.

A command that is declined, cancelled or has too little to do writes nothing: the tables come back as they were.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.plans.lineage import cut

from . import bracket, scope, tagging, tournament
from . import curate as cur
from .order import global_ordinal


@dataclass
class Outcome:
    tags: DataFrame
    image_tags: DataFrame
    outcome: str = "done"  # done, declined, cancelled, insufficient or empty
    groups: int = 0
    tagged: int = 0
    skipped: int = 0
    fallbacks: int = 0
    remaining: int = 0  # candidates less those tagged
    selected: DataFrame | None = None  # ordinal, image_id, file_path
    caption: str = ""
    cost: dict[str, int] = field(default_factory=dict)
    comparisons: int = 0


def candidates(command: str, ids: DataFrame, tags: DataFrame, image_tags: DataFrame, scope_tag: int | None = None) -> DataFrame:
    """The scope's ids without the tags that the command leaves out."""
    return scope.exclude(ids, tags.withColumnRenamed("id", "tag_id"), image_tags, list(scope.EXCLUDED[command]), scope_tag)


def _engine_tag(tags: DataFrame, project_id: int, name: str) -> tuple[DataFrame, int]:
    tags = tagging.ensure_system_tags(tags, project_id)
    return tags, tags.filter((F.col("project_id") == project_id) & (F.col("name") == name)).first().id


def dedup(project_id: int, ids: DataFrame, images: DataFrame, tags: DataFrame, image_tags: DataFrame, now: int, window: int = 10, threshold: int = 5, compare: tournament.CompareRows | None = None, gate: cur.Gate | None = None, cancelled: Callable[[], bool] = lambda: False) -> Outcome:
    """Finds groups of duplicates in ids(image_id) of images(image_id, project_id, captured_at, hash, ...) and tags all but each group's winner. The
    duplicate tag is cleared over the whole scope first, rejects included; rejects take no part in groups."""
    own = candidates("dedup", ids, tags, image_tags)
    chosen = cur.choose_winners(images.join(own.select("image_id").distinct(), "image_id", "left_semi"), window, threshold, compare, gate, cancelled)
    n = own.select("image_id").distinct().count()
    if chosen.outcome != "chosen":
        return Outcome(tags, image_tags, chosen.outcome, skipped=chosen.skipped, remaining=n)
    if not n:
        return Outcome(tags, image_tags, "empty")
    losers = cut(chosen.members.filter("image_id <> winner").select("image_id"), "losers")
    tags, duplicate = _engine_tag(tags, project_id, scope.DUPLICATE)
    tagged = losers.count()
    done = tagging.tag_duplicates(image_tags, ids, losers, duplicate, now)
    return Outcome(tags, done, groups=chosen.groups, tagged=tagged, skipped=chosen.skipped, fallbacks=chosen.fallbacks, remaining=n - tagged)


def retagged(project_id: int, images: DataFrame, tags: DataFrame, image_tags: DataFrame, chosen: DataFrame, apply_tag: str, now: int) -> tuple[DataFrame, DataFrame]:
    """tags and image_tags with the tag on exactly chosen(ordinal, image_id), in order: what it held before goes."""
    known = images.select(F.col("image_id").alias("id"), F.lit(project_id).cast("bigint").alias("project_id"))
    held = tags.filter((F.col("project_id") == project_id) & (scope.fold(F.col("name")) == scope.folded(apply_tag))).select("id").first()
    if held:
        image_tags = tagging.clear_tag(image_tags, held.id)
    else:
        tags = tagging.create_tag(tags, project_id, apply_tag, ordered=True)
    tags, image_tags, _ = tagging.apply_tag(tags, image_tags, known, project_id, apply_tag, chosen.select("ordinal", "image_id"), now)
    return tags, image_tags


def curate(project_id: int, ids: DataFrame, images: DataFrame, tags: DataFrame, image_tags: DataFrame, count: int, apply_tag: str, now: int, scope_tag: int | None = None, exclude: DataFrame | None = None, **model) -> Outcome:
    """Selects `count` of the scope and gives them the tag anew, in order: what the tag held before goes. exclude(image_id): ids that may not
    be selected. They take part in the selection, of as many more items as they are, and go afterwards, so a picture that was swapped out isn't
    replaced by its own near-duplicate. model: what curate() takes (window, threshold, evaluate, choose, compare, gate, cancelled...)."""
    own = candidates("curate", ids, tags, image_tags, scope_tag)
    out = {r.image_id for r in exclude.select("image_id").distinct().collect()} if exclude is not None and count > 0 else set()  # swapped out by hand
    got = cur.curate(images.join(own.select("image_id").distinct(), "image_id", "left_semi"), count + len(out), **model)
    if got.outcome != "chosen":
        return Outcome(tags, image_tags, got.outcome)
    kept = [i for i in got.ids if i not in out][:count]
    chosen = images.sparkSession.createDataFrame(list(enumerate(kept, 1)), "ordinal bigint, image_id bigint")  # count, 50 at most
    tags, image_tags = retagged(project_id, images, tags, image_tags, chosen, apply_tag, now)
    paths = chosen.join(images.select("image_id", "file_path"), "image_id") if "file_path" in images.columns else chosen
    return Outcome(tags, image_tags, selected=paths, tagged=len(kept), fallbacks=got.comparison_fallbacks, caption=got.caption)


def pick(project_id: int, ids: DataFrame, images: DataFrame, tags: DataFrame, image_tags: DataFrame, count: int, compare: tournament.CompareRows, now: int, window: int = 20, threshold: int = 10, gate: cur.Gate | None = None, cancelled: Callable[[], bool] = lambda: False) -> Outcome:
    """Keeps the `count` best of the scope by the comparator and rejects all others, or writes nothing. Each cluster sends its champion
    to a final; champions are no more than count, or the final's top-k is played among them. The gate hears the cost before any comparison."""
    own = cut(candidates("pick", ids, tags, image_tags).select("image_id").distinct(), "pick")
    n = own.count()
    if count <= 0 or n <= count:
        return Outcome(tags, image_tags, "insufficient", cost={"candidates": n})
    clusters = cur.choose_winners(images.join(own, "image_id", "left_semi"), window, threshold, cancelled=cancelled)
    if clusters.outcome != "chosen":
        return Outcome(tags, image_tags, clusters.outcome, cost={"candidates": n})
    cost = tournament.pick_cost(n, clusters.candidates, count)
    if gate is not None and not gate(cost):
        return Outcome(tags, image_tags, "declined", cost=cost)
    several = clusters.members.filter("size >= 2")
    first = bracket.top_k(several, compare, 1, ["cluster"], cancelled=cancelled)
    if first is None or cancelled() or not first.filter("image_id is null").isEmpty():
        return Outcome(tags, image_tags, "cancelled", cost=cost)
    made = first.agg(F.coalesce(F.sum("comparisons"), F.lit(0)).alias("n")).first().n
    single = clusters.members.filter("size = 1").select("image_id")
    champions = clusters.members.join(first.select("image_id").unionByName(single), "image_id", "left_semi")
    if count >= clusters.candidates:
        ranked = global_ordinal(champions, cur.seats()).select("ordinal", "image_id")
    else:
        seated = global_ordinal(champions, cur.seats(), "seat").withColumn("final", F.lit(1))
        final = bracket.top_k(seated, compare, count, ["final"], cancelled=cancelled)
        if final is None or cancelled() or not final.filter("image_id is null").isEmpty():
            return Outcome(tags, image_tags, "cancelled", cost=cost)
        made += final.first().comparisons
        ranked = final.select(F.col("rank").alias("ordinal"), "image_id")
    ranked = cut(ranked, "picked")
    rejected = global_ordinal(own.join(ranked.select("image_id"), "image_id", "left_anti"), [F.asc("image_id")])
    tags, reject = _engine_tag(tags, project_id, scope.REJECT)
    known = images.select(F.col("image_id").alias("id"), F.lit(project_id).cast("bigint").alias("project_id"))
    image_tags = tagging.add_entries(image_tags, tags, known, reject, rejected, now)
    return Outcome(tags, image_tags, tagged=cost["rejects"], selected=ranked, cost=cost, comparisons=made)


def narrowed(view: DataFrame, ids: DataFrame, cursor: int | None = None) -> tuple[DataFrame, int] | None:
    """view(ordinal, image_id) cut down to ids(image_id), its order kept; the cursor stays on its image if it is still there, else goes to the
    first. None if nothing is left: the switch is refused."""
    kept = view.join(ids.select("image_id").distinct(), "image_id", "left_semi").select("ordinal", "image_id")
    head = kept.orderBy("ordinal").first()
    if head is None:
        return None
    stays = cursor is not None and not kept.filter(F.col("image_id") == cursor).isEmpty()
    return kept, cursor if stays else head.image_id
