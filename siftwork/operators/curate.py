"""Curation with a budgeted model: cluster, let a comparator choose each cluster's winner, evaluate what isn't cached, let a selector pick, or
fall back.

The comparator runs in tasks, a cluster each. Evaluator and selector are injected callables that see the preselection alone (bounded by
the count asked for, 50 at most), so they run on the driver like any other client of a remote service.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.plans.lineage import cut

from . import bracket, cluster, projects, select, tournament

Evaluate = Callable[[int], dict | None]  # image id -> assessment, unusable, content; None: failed
Select = Callable[[list[dict], int], tuple[list, str] | None]  # numbered candidates, n -> 1-based picks and caption
Gate = Callable[[dict[str, int]], bool]


@dataclass
class Curated:
    ids: list[int]
    caption: str = ""
    evaluated: list[int] = field(default_factory=list)
    outcome: str = "chosen"  # chosen, declined, cancelled or empty: three different empty results
    selection_fallback: bool = False
    comparison_fallbacks: int = 0


@dataclass
class Chosen:
    """The partition of a scope into clusters. members: image_id, captured_at, cluster, size, winner; None if it was declined or
    cancelled."""

    members: DataFrame | None
    groups: int = 0  # clusters of two or more
    comparisons: int = 0
    candidates: int = 0  # clusters
    skipped: int = 0  # without a capture time
    fallbacks: int = 0
    outcome: str = "chosen"


def well_formed(answer: dict | None) -> bool:
    """All three fields, each of its own type."""
    return answer is not None and isinstance(answer.get("assessment"), str) and isinstance(answer.get("unusable"), bool) and isinstance(answer.get("content"), str)


def seats() -> list:
    """The order of clusters: groups by their block in time, then by smallest member, and single items behind them."""
    return [F.asc(F.col("size") < 2), F.asc_nulls_last(F.when(F.col("size") >= 2, F.col("block"))), F.asc("cluster")]


def choose_winners(items: DataFrame, window: int, threshold: int, compare: tournament.CompareRows | None = None, gate: Gate | None = None, cancelled: Callable[[], bool] = lambda: False) -> Chosen:
    """Clusters of one project's items with a winner each: the representative, or who wins the comparator's elimination (its failure
    leaves the representative). The gate hears the cost before any comparison; without groups it isn't asked."""
    labels = cluster.group_labels(items, window, threshold).withColumn("cluster", F.col("component"))
    untimed = items.filter("captured_at is null").withColumn("block", F.lit(None).cast("bigint")).withColumn("component", F.col("image_id")).withColumn("cluster", F.col("image_id"))
    rows = cut(labels.unionByName(untimed, allowMissingColumns=True), "clusters")
    keep = F.max_by("image_id", F.struct(F.col("captured_at"), -F.col("image_id")))
    groups = rows.groupBy("cluster").agg(F.count("*").alias("size"), F.coalesce(keep, F.min("image_id")).alias("fallback"))
    n = groups.agg(F.count("*").alias("candidates"), F.count_if(F.col("size") >= 2).alias("groups"), F.coalesce(F.sum(F.when(F.col("size") >= 2, F.col("size") - 1)), F.lit(0)).alias("comparisons")).first()
    skipped = rows.filter("captured_at is null").count()
    found = Chosen(None, n.groups, n.comparisons, n.candidates, skipped)
    if cancelled():
        found.outcome = "cancelled"
        return found
    members = rows.join(groups, "cluster")
    if compare is None or not n.groups:
        found.members = cut(members.withColumn("winner", F.col("fallback")).drop("fallback"), "winners")
        return found
    if gate is not None and not gate({"groups": n.groups, "comparisons": n.comparisons, "candidates": n.candidates}):
        found.outcome = "declined"
        return found
    won = bracket.eliminated(members.filter("size >= 2"), compare, ["cluster"], cancelled=cancelled)
    found.fallbacks = won.filter("failed").count() if won is not None else 0
    if won is None or cancelled():
        found.outcome = "cancelled"
        return found
    found.members = cut(members.join(won.select("cluster", F.col("winner").alias("won")), "cluster", "left").withColumn("winner", F.coalesce("won", "fallback")).drop("won", "fallback"), "winners")
    return found


def curate(items: DataFrame, count: int, window: int = 20, threshold: int = 10, multiple: float = 2.0, evaluations: DataFrame | None = None, evaluate: Evaluate | None = None, choose: Select | None = None, compare: tournament.CompareRows | None = None, gate: Gate | None = None, cancelled: Callable[[], bool] = lambda: False) -> Curated:
    """The delivered ids of one project's items. Fewer clusters than asked for are delivered as they are. Without a model: farthest points in
    delivery order. With one: the preselection is evaluated where it isn't cached, the selector sees all of it, and its cleaned picks stand
    in its order; no answer, or one that cleans to too few, falls back to the choice without a model. The gate is asked once, for
    comparisons and evaluations together if there is a comparator, else for evaluations if there are any to make."""
    if count <= 0:
        return Curated([], outcome="empty")
    ai, asked = evaluate is not None or choose is not None or compare is not None, []

    def combined(cost: dict[str, int]) -> bool:
        asked.append(cost)
        n = cost["candidates"]
        return gate({"comparisons": cost["comparisons"], "evaluations": 0 if n < count else select.preselection_size(multiple, count, n)})

    chosen = choose_winners(items, window, threshold, compare, combined if ai and gate else None, cancelled)
    if chosen.outcome != "chosen":
        return Curated([], outcome=chosen.outcome)
    if not chosen.candidates:
        return Curated([], outcome="empty")
    winners = chosen.members.filter("image_id = winner").select("project_id", "winner", "captured_at", "size", "block", "cluster")

    def in_time(rows: list) -> list[int]:
        return [r.winner for r in sorted(rows, key=lambda r: (r.captured_at is None, -(r.captured_at or 0), r.winner))]

    if chosen.candidates < count:  # so few that all are delivered
        return Curated(in_time(winners.collect()), comparison_fallbacks=chosen.fallbacks)
    plain = in_time(select.diverse_top(winners, count).join(winners.select("winner", "captured_at"), "winner").collect())
    if not ai:
        return Curated(plain)
    size = select.preselection_size(multiple, count, chosen.candidates)
    if size < chosen.candidates:
        pool = [r.winner for r in select.diverse_top(winners, size).orderBy("ordinal").collect()]
    else:  # no more than the preselection: clusters first, then single items
        pool = [r.winner for r in winners.orderBy(*seats()).select("winner").collect()]
    ids = winners.sparkSession.createDataFrame([(i,) for i in pool], "image_id bigint")
    cached: dict[int, dict] = {}
    if evaluations is not None:
        known = projects.read_evaluations(evaluations).join(F.broadcast(ids), "image_id", "left_semi")  # ids: the preselection
        cached = {r.image_id: (r.result.asDict() if r.result else {}) for r in known.collect()}
    todo = [i for i in pool if i not in cached] if evaluate is not None else []
    if gate is not None and not asked and todo and not gate({"comparisons": 0, "evaluations": len(todo)}):
        return Curated([], outcome="declined")
    done: list[int] = []
    for i in todo:
        if cancelled():
            return Curated([], evaluated=done, outcome="cancelled")  # what was evaluated stays
        answer = evaluate(i)
        if well_formed(answer):
            cached[i] = answer
            done.append(i)
    if cancelled():
        return Curated([], evaluated=done, outcome="cancelled")
    answer = choose([{"number": n, "image_id": i, **(cached.get(i) or {})} for n, i in enumerate(pool, 1)], count) if choose is not None else None
    picks = select.clean_selection(answer[0], len(pool), count) if answer else []
    if not picks:
        return Curated(plain, "", done, selection_fallback=True, comparison_fallbacks=chosen.fallbacks)
    caption = answer[1].strip() if isinstance(answer[1], str) else ""
    return Curated([pool[p - 1] for p in picks], caption, done, comparison_fallbacks=chosen.fallbacks)


def parse_answer(text: str, required: dict[str, type]) -> dict | None:
    """A model's JSON answer, a code fence around it allowed; None unless every required field has its type."""
    text = text.strip()
    if text.startswith("```"):
        text = text.split("\n", 1)[-1].rsplit("```", 1)[0]
    try:
        found = json.loads(text)
    except ValueError:
        return None
    ok = isinstance(found, dict) and all(isinstance(found.get(k), t) and not (t is int and isinstance(found[k], bool)) for k, t in required.items())
    return found if ok else None


def style_choice(answer: dict | None, candidates: list[str]) -> str | None:
    """A style from the closed list; a name that isn't in it is refused."""
    name = answer.get("style") if answer else None
    if name is not None and name not in candidates:
        raise ValueError(f"hallucinated style {name!r}")
    return name
