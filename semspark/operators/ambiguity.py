"""Resolve or ask; never guess. Driver-side decisions, no data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass


@dataclass(frozen=True)
class Decision:
    action: str  # resolve | ask
    term: str
    value: object = None
    candidates: tuple[object, ...] = ()
    reason: str = ""

    @property
    def resolved(self) -> bool:
        return self.action == "resolve"


def ambiguity_gate(term: str, candidates: Sequence[object], pinned: object = None) -> Decision:
    """A pin among the candidates, or the only candidate, resolves; no or several candidates ask."""
    some = tuple(dict.fromkeys(candidates))
    if pinned is not None and pinned in some:
        return Decision("resolve", term, pinned, some, "pinned")
    if len(some) == 1:
        return Decision("resolve", term, some[0], some, "only candidate")
    return Decision("ask", term, None, some, "no candidate" if not some else f"{len(some)} candidates")


def required_axes(policies: Mapping[str, tuple[str, object]], bound: Mapping[str, object]) -> tuple[dict[str, object], list[Decision]]:
    """For axes with a policy (mandatory_no_default, assumable_default or blocked, and a default): values to use, and the
    decisions that must be put to the asker. A blocked axis may not be bound at all."""
    values, asks = dict(bound), []
    for axis, (policy, default) in policies.items():
        if policy == "blocked":
            if axis in bound:
                asks.append(Decision("ask", axis, reason="the axis is blocked"))
        elif axis in bound:
            continue
        elif policy == "assumable_default":
            values[axis] = default
        elif policy == "mandatory_no_default":
            asks.append(Decision("ask", axis, reason="required, and there is no default"))
        else:
            raise ValueError(f"unknown policy: {policy}")
    return values, asks
