"""Tournaments with an injected comparator.

The comparator need not be transitive, so pairing is part of the contract: a single elimination pairs neighbours and lets an odd
last one through; top-k replays only the paths that its winners left. With a total order both equal a sort, which is what the queries
registered here use; a model-backed comparator runs in a grouped map over members that are already reduced.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwork.functions import scalar

#: True if the first is better, False if the second is; None if the comparison failed.
Compare = Callable[[int, int], bool | None]


def ceil_log2(n: int) -> int:
    return max(0, (n - 1).bit_length())


def comparison_bound(m: int, k: int) -> int:
    """Comparisons that top-k of m takes at most."""
    k = max(0, min(k, m))
    return 0 if k == 0 else (m - 1) + (k - 1) * ceil_log2(m)


def single_elimination(members: list[int], compare: Compare, fallback: int) -> tuple[int, int, bool]:
    """Winner, comparisons made and whether all succeeded; after a failure the winner is the fallback."""
    made, alive = 0, list(members)
    while len(alive) > 1:
        nxt = []
        for a, b in zip(alive[::2], alive[1::2]):
            made += 1
            better = compare(a, b)
            if better is None:
                return fallback, made, False
            nxt.append(a if better else b)
        alive = nxt + ([alive[-1]] if len(alive) % 2 else [])
    return (alive[0] if alive else fallback), made, True


def top_k(members: list[int], compare: Compare, k: int) -> tuple[list[int] | None, int]:
    """The k best in order, and comparisons made; None if a comparison failed. The bracket pairs neighbours round by round and lets an odd last
    one through; each match keeps its winner, and when a winner leaves, only the matches along its own path are played again."""
    m = len(members)
    k = max(0, min(k, m))
    made = 0
    if not k:
        return [], 0
    sides: dict[int, tuple[int, int]] = {}
    above: dict[int, int] = {}
    alive, node = list(range(m)), m
    while len(alive) > 1:
        through = [alive[-1]] if len(alive) % 2 else []
        nxt = []
        for pair in zip(alive[::2], alive[1::2]):
            sides[node] = pair
            above[pair[0]] = above[pair[1]] = node
            nxt.append(node)
            node += 1
        alive = nxt + through
    final = alive[0]
    best: list[int | None] = [*range(m), *[None] * (node - m)]

    def play(match: int) -> bool:
        nonlocal made
        a, b = (best[x] for x in sides[match])
        if a is None or b is None:
            best[match] = b if a is None else a
            return True
        made += 1
        better = compare(members[a], members[b])
        best[match] = a if better else b
        return better is not None

    if not all(map(play, range(m, node))):
        return None, made
    out: list[int] = []
    while True:
        top = best[final]
        out.append(members[top])
        if len(out) == k:
            return out, made
        best[top], at = None, top
        while at in above:
            at = above[at]
            if not play(at):
                return None, made


def without_pictures(a: dict, b: dict) -> bool:
    """Whether a beats b when at least one can't be decoded: the decodable one wins; else the later, no time being oldest; else the
    smaller id."""
    if a["decodable"] != b["decodable"]:
        return a["decodable"]
    late = lambda x: (x["captured_at"] is not None, x["captured_at"] or 0)
    return late(a) > late(b) if late(a) != late(b) else a["id"] < b["id"]


#: A comparator over rows: dicts of a member's columns. True if the first is better, False if the second; None or an error: failed.
CompareRows = Callable[[dict, dict], bool | None]


def judged(compare: CompareRows, rows: list[dict]) -> Compare:
    """The comparator over members' places. Members that can't be decoded (a column `decodable` that is false) are never shown to it."""

    def one(a: int, b: int) -> bool | None:
        x, y = rows[a], rows[b]
        if not (x.get("decodable", True) and y.get("decodable", True)):
            side = lambda r: {"decodable": bool(r.get("decodable", True)), "captured_at": r.get("captured_at"), "id": r["image_id"]}
            return without_pictures(side(x), side(y))
        try:
            return compare(x, y)
        except Exception:  # the comparator is the caller's; its failure is a failed comparison
            return None

    return one


def _members(pdf: pd.DataFrame) -> list[dict]:
    """In order of their seat, or else of their id: a comparator that isn't transitive finds its winner by the pairing."""
    ordered = pdf.sort_values("seat" if "seat" in pdf else "image_id").astype(object)
    return ordered.where(ordered.notna(), None).to_dict("records")


def eliminated(groups: DataFrame, compare: CompareRows, by: list[str]) -> DataFrame:
    """by, winner, comparisons, failed: single elimination of each group's members (image_id, fallback and whatever else the comparator
    looks at), in order of id. A failed comparison leaves the group's fallback as its winner. A group is one task: a model's time for a
    comparison, not a group's size, is what bounds it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _members(pdf)
        at, made, ok = single_elimination(list(range(len(rows))), judged(compare, rows), -1)
        winner = rows[at]["image_id"] if ok else rows[0]["fallback"]
        return pd.DataFrame([[*pdf[by].iloc[0], winner, made, not ok]], columns=[*by, "winner", "comparisons", "failed"])

    kinds = dict(groups.dtypes)
    return groups.groupBy(*by).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in by) + ", winner bigint, comparisons bigint, failed boolean")


def top_k_in_groups(groups: DataFrame, compare: CompareRows, k: int, by: list[str]) -> DataFrame:
    """by, rank, image_id, comparisons: the k best of each group by the comparator, in order of rank; a group in which a comparison failed has
    one row without rank and image_id."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _members(pdf)
        best, made = top_k(list(range(len(rows))), judged(compare, rows), k)
        out = [(None, None)] if best is None else [(i, rows[m]["image_id"]) for i, m in enumerate(best, 1)]
        done = pd.DataFrame([[*pdf[by].iloc[0], r, i, made] for r, i in out], columns=[*by, "rank", "image_id", "comparisons"])
        return done.astype({"rank": "Int64", "image_id": "Int64"})

    kinds = dict(groups.dtypes)
    return groups.groupBy(*by).applyInPandas(run, ", ".join(f"{x} {kinds[x]}" for x in by) + ", rank bigint, image_id bigint, comparisons bigint")


def top_k_total_order(items: DataFrame, order: list, k: int, by: str) -> DataFrame:
    """Top-k for a total order: a ranking, which Spark limits before it shuffles."""
    return items.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("rank") <= k)


def pick_cost(candidates: int, champions: int, count: int) -> dict[str, int]:
    """Figures shown before a pick: comparisons of the first stage, the most there can be, and how many will be rejected."""
    count = max(0, count)
    first = candidates - champions
    return {"candidates": candidates, "champions": champions, "first_stage": first, "max_comparisons": first + (comparison_bound(champions, count) if count < champions else 0), "rejects": candidates - min(count, champions)}


def pick_costs(groups: DataFrame, count: int) -> DataFrame:
    """The same for a row of groups(candidates, champions) each."""
    m = F.col("champions")
    final = F.when(m <= count, 0).otherwise(m - 1 + (count - 1) * scalar.ceil_log2(m))
    first = F.col("candidates") - m
    return groups.withColumns({"first_stage": first, "max_comparisons": (first + final).cast("long"), "rejects": F.col("candidates") - F.least(F.lit(count), m)})
