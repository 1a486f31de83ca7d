"""What a model makes of a user's words, turned into plans and changes: pure functions over its parsed answer.

The answer is a dictionary; who asked for it, and how, is the caller's. classify() does so for a table of messages by an injected callable.
An action that isn't of its kind is an error, never a guess. An absent brief leaves the old one, an empty text removes it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.plans.runs import StagePlan

from . import models

# fixed values: the actions of each kind of reply, and what a plan takes where nothing was said
ACTIONS = {
    "adjustment": ("set_count", "set_apply_tag", "set_selection_brief", "swap_out"),
    "gate": ("approve", "reject", "query", "set_count", "set_apply_tag", "set_selection_brief", "swap_out"),
    "confirmation": ("approve", "reject", "confirmed", "query", "clarify"),
    "collecting": ("intent", "start", "query", "cancel", "other"),
    "style_describe": ("describe", "skip", "cancel", "query"),
    "style_gate": ("approve", "redescribe", "cancel", "query"),
    "dedup_followup": ("narrow", "approve", "skip", "query", "cancel"),
    "running": ("cancel", "query", "other"),
    "cancel_confirmation": ("confirm", "deny", "other"),
}
COUNT, TAG, PROVIDER = 9, "精选", "local"


class ReplyError(ValueError):
    """kind: unknown_action, missing_selection_brief, index_out_of_range or hallucinated."""

    def __init__(self, kind: str, what: object = ""):
        super().__init__(f"{kind}: {what}")
        self.kind = kind


@dataclass
class Reply:
    action: str
    values: dict[str, Any] = field(default_factory=dict)  # parameters of the stage `curate`


def action_of(kind: str, answer: dict) -> str:
    action = answer.get("action")
    if action not in ACTIONS[kind]:
        raise ReplyError("unknown_action", f"{kind} {action!r}")
    return action


def classify(messages: DataFrame, ask: models.Ask, kind: str, id_col: str = "message_id") -> DataFrame:
    """message_id, action, error for each message; an action of another kind is an error."""
    return models._asked(messages, ask, id_col, {"action": str}, lambda a: a["action"] in ACTIONS[kind])


def brief_of(answer: dict) -> dict[str, str]:
    """The brief, if the answer holds one: a text, the empty one too."""
    return {"selection_brief": answer["selection_brief"]} if isinstance(answer.get("selection_brief"), str) else {}


def adjustment(answer: dict, selected: list, excluded: list | None = None, kind: str = "adjustment") -> Reply:
    """The change of curate's parameters that an answer asks for. selected: what was delivered, in order; excluded: ids swapped out before."""
    action, brief = action_of(kind, answer), brief_of(answer)
    if action in ("approve", "reject", "query"):
        return Reply(action)
    if action == "set_selection_brief":
        if not brief:
            raise ReplyError("missing_selection_brief")
        return Reply("adjust", brief)
    if action == "set_count":
        return Reply("adjust", {"count": answer["count"], **brief})
    if action == "set_apply_tag":
        return Reply("adjust", {"apply_tag": answer["apply_tag"], **brief})
    index = answer.get("index")
    if isinstance(index, bool) or not isinstance(index, int) or not 1 <= index <= len(selected):
        raise ReplyError("index_out_of_range", f"{index!r} of {len(selected)}")
    out = list(excluded or [])
    return Reply("adjust", {"exclude": out if selected[index - 1] in out else [*out, selected[index - 1]], **brief})


def gate(answer: dict, selected: list, excluded: list | None = None) -> Reply:
    """approve, reject or query, or an adjustment."""
    return adjustment(answer, selected, excluded, "gate")


def confirmation(answer: dict, proposed: dict) -> Reply:
    """An answer to a proposed plan; a change keeps what it doesn't name, a clarification brings its question."""
    action = action_of("confirmation", answer)
    if action == "clarify":
        return Reply(action, {"question": answer.get("question", "")})
    if action != "confirmed":
        return Reply(action)
    kept = {k: answer.get(k, proposed.get(k)) for k in ("count", "apply_tag", "ai_enabled", "provider")}
    return Reply(action, {**kept, "selection_brief": proposed.get("selection_brief"), **brief_of(answer)})


def dedup_followup(answer: dict) -> Reply:
    """What comes after dedup; a brief without words is none."""
    action = action_of("dedup_followup", answer)
    if action != "narrow":
        return Reply(action)
    return Reply(action, {"count": answer.get("count"), "apply_tag": answer.get("apply_tag"), "selection_brief": brief_of(answer).get("selection_brief") or None})


def plan_of(answer: dict) -> list[StagePlan]:
    """The plan of an intent. If no number was named but dedup was, dedup comes first and curate waits for a number; else curate follows at
    once, with COUNT if none was named."""
    ai = {"ai_enabled": answer.get("ai_enabled", False), "provider": answer.get("provider", PROVIDER)}
    first = answer.get("count") is None and bool(answer.get("dedup_requested", False))
    count = None if first else COUNT if answer.get("count") is None else answer["count"]
    curate = StagePlan("curate", {"count": count, "apply_tag": answer.get("apply_tag") or TAG, **ai, "selection_brief": answer.get("selection_brief") or ""}, "required" if first else "off")
    dedup = [StagePlan("dedup", dict(ai))] if first else []
    return [StagePlan("ingest"), *dedup, curate, StagePlan("style", {"provider": ai["provider"]}, "required"), StagePlan("style_all", {}, "required"), StagePlan("deliver")]


def style_of(answer: dict, names: list[str]) -> str:
    """The preset that a description was matched to, one of the names."""
    if answer.get("recipe_name") not in names:
        raise ReplyError("hallucinated", repr(answer.get("recipe_name")))
    return answer["recipe_name"]


def swapped_out(excluded: Column, path: Column) -> Column:
    """The list of excluded items with one more, each once, in the order they came."""
    held = F.coalesce(excluded, F.array().cast("array<string>"))
    return F.when(path.isNull() | F.array_contains(held, path), held).otherwise(F.concat(held, F.array(path)))
