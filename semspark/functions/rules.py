"""Rules as expressions. Prose is never parsed into predicates: an executable rule is a template that the SQL parser takes,
or a predicate registered under its id that touches only the columns the rule binds."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_PREDICATES: dict[str, tuple[Callable[[], Column], tuple[str, ...]]] = {}


def registered(rule_id: str, *columns: str) -> Callable[[Callable[[], Column]], Callable[[], Column]]:
    """Registers a predicate builder under a rule's id, with the columns it reads."""

    def keep(f: Callable[[], Column]) -> Callable[[], Column]:
        _PREDICATES[rule_id] = (f, columns)
        return f

    return keep


def predicate(rule_id: str, binds: Sequence[str]) -> Column | None:
    """The rule's predicate; None if it has none. It must read no column but those that the rule binds."""
    found = _PREDICATES.get(rule_id)
    if found is None:
        return None
    f, columns = found
    if extra := set(columns) - set(binds):
        raise ValueError(f"rule {rule_id} reads {sorted(extra)}, which it doesn't bind")
    return f()


def expression(template: str) -> Column:
    """A sql_expression template as a Column; comments go, and qualifiers of single letters (table aliases) too."""
    text = re.sub(r"--[^\n]*", "", template).strip()
    return F.expr(re.sub(r"\b[a-z]{1,2}\.(?=\w)", "", text))


_TAG = re.compile(r"\{%\s*(if\s+(?:not\s+)?\w+|else|endif)\s*%\}")
_NAMED = re.compile(r"\{\{\s*(\w+)\s*\}\}|(?<![\w:]):(\w+)")


def rendered(template: str, given: Mapping[str, object], marker: str = "_bound_{}") -> tuple[str, dict[str, object]]:
    """A template with its conditionals settled ({% if name %} ... {% else %} ... {% endif %}, {% if not name %}; a parameter
    holds if it is given and not null), and the values that it names as {{ name }} or :name. These are bound: the text gets
    a marker for each, never the value. A name that isn't given is a KeyError; comments go first."""
    text = re.sub(r"--[^\n]*", "", template)
    out, open_ = [], []  # of each open conditional, if its part is kept
    at = 0
    for m in _TAG.finditer(text):
        if all(open_):
            out.append(text[at : m.start()])
        at = m.end()
        words = m[1].split()
        if words[0] == "if":
            open_.append((given.get(words[-1]) is not None) != (words[1] == "not" and len(words) == 3))
        elif not open_:
            raise ValueError(f"{{% {m[1]} %}} stands outside any conditional")
        elif words[0] == "else":
            open_[-1] = not open_[-1]
        else:
            open_.pop()
    if open_:
        raise ValueError("a conditional isn't closed")
    out.append(text[at:])
    bound: dict[str, object] = {}

    def bind(m: re.Match) -> str:
        name = m[1] or m[2]
        bound[marker.format(name).lstrip(":")] = given[name]
        return marker.format(name)

    return _NAMED.sub(bind, "".join(out)), bound


_UDFS: dict[str, Callable[..., Column]] = {}


def spark_udf(name: str, f: Callable[..., Column]) -> None:
    """Registers what a rule of render kind spark_udf calls: a builder of Columns (or a pandas UDF)."""
    _UDFS[name] = f


def call_udf(name: str, *columns: str) -> Column:
    if name not in _UDFS:
        raise KeyError(f"no function {name} is registered")
    return _UDFS[name](*(F.col(c) for c in columns))


@registered("lineitem.state.fulfilled", "l_linestatus")
def _fulfilled() -> Column:
    return F.col("l_linestatus") == "F"


@registered("order.revenue.paid_only", "paid_at")
def _paid() -> Column:
    return F.col("paid_at").isNotNull()


@registered("orders.revenue.settled_only", "o_orderstatus")
def _settled() -> Column:
    return F.col("o_orderstatus") != "P"
