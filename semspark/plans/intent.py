"""What is asked, and the answers that aren't data."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import date, timedelta


@dataclass(frozen=True)
class Window:
    """A half-open stretch of time on a column: start <= column < end."""

    column: str
    start: date
    end: date


@dataclass(frozen=True)
class Intent:
    """measure by partition columns, within restrictions and a window.

    Columns are named Concept.column. partition enters GROUP BY; restrict only filters, however many values it names.
    `via` names concepts (or edge ids) that the join path must pass, where several paths exist. `rules` are ids of
    predicate rules that must hold. `count` asks for the number of rows of a concept instead of a measure. A grouping's bare
    name in partition stands for what it rolls up to. `parameters` are what templates may ask for by name; a window's ends
    are period_start and period_end.
    """

    measure: str | None = None
    partition: tuple[str, ...] = ()
    restrict: Mapping[str, object] = field(default_factory=dict)
    window: Window | None = None
    via: tuple[str, ...] = ()
    rules: tuple[str, ...] = ()
    count: str | None = None
    fold: str | None = None
    parameters: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Ask:
    """The question has no single reading; what to decide."""

    term: str
    candidates: tuple[object, ...]
    reason: str


@dataclass(frozen=True)
class NotDerivable:
    """The model has no way to the answer; what is missing."""

    measure: str
    axis: str
    reached: tuple[str, ...]
    reason: str


def period(text: str, column: str) -> Window:
    """'1995', '1995-Q2', '1995-03' or '1995-03-07' as a half-open window."""
    if m := re.fullmatch(r"(\d{4})", text):
        return Window(column, date(int(m[1]), 1, 1), date(int(m[1]) + 1, 1, 1))
    if m := re.fullmatch(r"(\d{4})-?Q([1-4])", text):
        y, q = int(m[1]), int(m[2])
        return Window(column, date(y, 3 * q - 2, 1), date(y + q // 4, 3 * q % 12 + 1, 1))
    if m := re.fullmatch(r"(\d{4})-(\d{2})", text):
        y, mo = int(m[1]), int(m[2])
        return Window(column, date(y, mo, 1), date(y + mo // 12, mo % 12 + 1, 1))
    if m := re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})", text):
        day = date(int(m[1]), int(m[2]), int(m[3]))
        return Window(column, day, day + timedelta(days=1))
    raise ValueError(f"not a period: {text}")
