"""Runs of a staged plan: validation, gates, failure and re-runs.

A plan is an ordered list of stages over DataFrames. Stages run one at a time in plan order once their inputs are there. A run stops at a
gate before its stage has done anything: "proceed" runs the stage, "hold" cancels the run with the stage untouched; only a courtesy gate may time
out, and its plan says with which of the two. A critical stage that fails ends the run, an optional one is skipped. Changing a stage's
parameters makes it and everything that depends on it pending again, behind their gates; a rerun takes new parameters past the stage's own
gate. When nothing is left to do the run is up for review, until it is approved.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

SHAPES = (("ingest", "dedup", "curate", "style", "style_all", "deliver"), ("ingest", "curate", "style", "style_all", "deliver"))
PROVIDERS = ("local", "gemini", "claude")  # fixed values
GATES = ("off", "courtesy", "required")
MAX_COUNT = 50


class PlanError(ValueError):
    pass


@dataclass
class Stage:
    name: str
    run: Callable[[dict[str, Any], dict[str, Any]], Any]  # inputs by name, parameters -> result
    inputs: tuple[str, ...] = ()
    critical: bool = True


@dataclass
class StagePlan:
    name: str
    params: dict[str, Any] = field(default_factory=dict)
    gate: str = "off"
    on_timeout: str = "proceed"  # of a courtesy gate: proceed or hold
    answered: bool = False  # its question isn't asked again


def validate_plan(plan: list[StagePlan]) -> None:
    """The stage list has one of two shapes and gates are known. Dedup and curate say whether a model is used (ai_enabled, true or false); they
    and style name a provider. Curate's count is a whole number from 1 to 50 or, exactly if its gate is required, null; its tag is a
    text that isn't empty, its brief a text."""
    names = tuple(s.name for s in plan)
    if names not in SHAPES:
        raise PlanError(f"stages {names}")
    by = {s.name: s for s in plan}
    for s in plan:
        if s.gate not in GATES:
            raise PlanError(f"gate {s.gate!r} of {s.name}")
    for s in (by[n] for n in ("dedup", "curate") if n in by):
        if not isinstance(s.params.get("ai_enabled"), bool):
            raise PlanError(f"ai_enabled of {s.name} isn't true or false")
    for s in (by[n] for n in ("dedup", "curate", "style") if n in by):
        if s.params.get("provider") not in PROVIDERS:
            raise PlanError(f"provider of {s.name}: {s.params.get('provider')!r}")
    curate = by["curate"]
    count = curate.params.get("count")
    if (count is None) != (curate.gate == "required"):
        raise PlanError("count is left open exactly if the gate of curate is required")
    if count is not None and (isinstance(count, bool) or not isinstance(count, int) or not 1 <= count <= MAX_COUNT):
        raise PlanError(f"count {count!r}")
    if not isinstance(curate.params.get("selection_brief", ""), str):
        raise PlanError("selection_brief isn't a text")
    if not isinstance(curate.params.get("apply_tag"), str) or not curate.params["apply_tag"]:
        raise PlanError("apply_tag is a text that isn't empty")


@dataclass
class Run:
    plan: list[StagePlan]
    stages: dict[str, Stage]
    states: dict[str, str] = field(default_factory=dict)  # pending, done, skipped, failed
    outputs: dict[str, Any] = field(default_factory=dict)
    status: str = "active"  # active, waiting, review, done, failed, cancelled
    errors: dict[str, str] = field(default_factory=dict)
    waiting: str | None = None

    def __post_init__(self):
        for s in self.plan:
            self.states.setdefault(s.name, "pending")

    def _spec(self, name: str) -> StagePlan:
        return next(s for s in self.plan if s.name == name)

    def stops_at(self, spec: StagePlan) -> bool:
        return spec.gate != "off" and not spec.answered

    def advance(self) -> str:
        """Runs pending stages up to a gate, a failure or the end; the run's status."""
        while self.status == "active":
            spec = next((s for s in self.plan if self.states[s.name] == "pending"), None)
            if spec is None:
                self.status = "review"
            elif self.stops_at(spec):
                self.status, self.waiting = "waiting", spec.name
            else:
                self._run(spec)
        return self.status

    def _run(self, spec: StagePlan) -> None:
        stage = self.stages[spec.name]
        missing = [i for i in stage.inputs if self.states.get(i) not in ("done", "skipped")]
        if missing:
            self._failed(spec.name, stage, f"needs {', '.join(missing)}")
            return
        try:
            self.outputs[spec.name] = stage.run({i: self.outputs.get(i) for i in stage.inputs}, spec.params)
            self.states[spec.name] = "done"
        except Exception as e:  # a stage's failure is the run's state
            self._failed(spec.name, stage, str(e))

    def _failed(self, name: str, stage: Stage, why: str) -> None:
        self.errors[name] = why
        self.states[name] = "failed" if stage.critical else "skipped"
        if stage.critical:
            self.status = "failed"

    def answer(self, proceed: bool = True) -> str:
        """Opens the gate that the run waits at, or cancels the run with the stage untouched."""
        if self.status != "waiting":
            raise PlanError("no gate is open")
        name, self.waiting = self.waiting, None
        if not proceed:
            self.status = "cancelled"
            return self.status
        self.status = "active"
        self._run(self._spec(name))
        return self.advance()

    def timed_out(self) -> str:
        """A courtesy gate goes on as its plan says, a required one keeps waiting."""
        if self.status == "waiting" and self._spec(self.waiting).gate == "courtesy":
            return self.answer(self._spec(self.waiting).on_timeout == "proceed")
        return self.status

    def rearm(self, name: str) -> str:
        """Asks a stage's question again, whatever was answered before; the stage counts as not run."""
        spec = self._spec(name)
        spec.answered = False
        self._reset(name)
        self.status, self.waiting = "waiting", name
        return self.status

    def approve(self) -> str:
        if self.status != "review":
            raise PlanError("the run isn't up for review")
        self.status = "done"
        return self.status

    def downstream(self, name: str) -> set[str]:
        found = {name}
        for s in self.plan:
            if found & set(self.stages[s.name].inputs):
                found.add(s.name)
        return found

    def _reset(self, name: str) -> None:
        for n in self.downstream(name):
            self.states[n] = "pending"
            self.outputs.pop(n, None)

    def adjust(self, name: str, **params: Any) -> str:
        """New parameters: the stage and all that depends on it run again, each behind its gate."""
        self._spec(name).params.update(params)
        self._reset(name)
        self.status, self.waiting = "active", None
        return self.advance()

    def rerun(self, name: str, answered: bool = False, **params: Any) -> str:
        """The parameters are the answer to the stage's gate: it runs past it, what depends on it is pending again. answered: the gate stays
        open from now on."""
        spec = self._spec(name)
        spec.params.update(params)
        spec.answered = spec.answered or answered
        self._reset(name)
        self.status, self.waiting = "active", None
        self._run(spec)
        return self.advance()

    def cancel(self) -> None:
        if self.status in ("active", "waiting", "review"):
            self.status, self.waiting = "cancelled", None
