"""Operators by name: what a model's `realized_by` binds to."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semspark.model.vocab import term
from semspark.operators.alias import AliasTable, relation_alias_resolve
from semspark.operators.ambiguity import ambiguity_gate
from semspark.operators.closure import closure_anomaly_check
from semspark.operators.densify import densify
from semspark.operators.filters import axis_default, exclusion_filter
from semspark.operators.hierarchy import hierarchy_rollup
from semspark.operators.latest import scoped_latest
from semspark.operators.registers import enum_from_register, grouping_from_register
from semspark.operators.snapshot import as_of, snapshot_collapse

Frames = Mapping[str, DataFrame]


def _snapshot(df: DataFrame, frames: Frames, p: Mapping) -> DataFrame:
    if p.get("as_of") is not None:
        return as_of(df, p["valid_from"], p["valid_to"], p["as_of"] if isinstance(p["as_of"], Column) else F.lit(p["as_of"]))
    key = p["natural_key"]
    return snapshot_collapse(df, [key] if isinstance(key, str) else list(key), p["order_by"], list(p["tie"]))


def _closure(df: DataFrame, frames: Frames, p: Mapping) -> DataFrame:
    found = closure_anomaly_check(df, p["column"], p["closure"], frames[p["register"]] if "register" in p else list(p.get("known_values") or []))
    return df.select(p["column"]).limit(0) if found is None else found


#: Operators that take a relation and give one: name -> f(relation, other relations by name, parameters).
RELATIONAL: dict[str, Callable[[DataFrame, Frames, Mapping], DataFrame]] = {
    "densify": lambda df, fs, p: densify(df, p["measure"], list(p["keys"]), fs[p["grid"]]),
    "scoped_latest": lambda df, fs, p: scoped_latest(df, p["date_column"], p.get("scope")),
    "closure_anomaly_check": _closure,
    "hierarchy_rollup": lambda df, fs, p: hierarchy_rollup(df, p["id_col"], p["parent_col"], p["root"]),
    "snapshot_collapse": _snapshot,
    "exclusion_filter": lambda df, fs, p: exclusion_filter(df, p["column"], p.get("not_in") or (), p.get("not_like") or ()),
    "axis_default": lambda df, fs, p: axis_default(df, p["axis_column"], p["default_value"], p.get("bound") or ()).df,
    "enum_from_register": lambda df, fs, p: enum_from_register(df, p.get("key_column", "code")),
    "grouping_from_register": lambda df, fs, p: grouping_from_register(df, p["group_key"], p.get("member_col"), p.get("carry") or (), member=p.get("member")),
}
#: Operators that give decisions, and need no relation.
DECISIONS = {"ambiguity_gate": ambiguity_gate, "alias_resolve": AliasTable.alias_resolve, "relation_alias_resolve": relation_alias_resolve}


def realize(df: DataFrame, binding: Mapping | Sequence[Mapping], frames: Frames | None = None, **given: object) -> DataFrame:
    """One binding {udf, params}, or a list of them applied in order. given: parameters known only when asked (a root, an
    instant); they win over the model's. Names may carry any namespace."""
    for b in [binding] if isinstance(binding, Mapping) else binding:
        name = term(b["udf"])
        if name not in RELATIONAL:
            raise KeyError(f"{name} is no operator on relations")
        df = RELATIONAL[name](df, frames or {}, {**(b.get("params") or {}), **given})
    return df
