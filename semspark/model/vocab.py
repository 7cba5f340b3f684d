"""Closed vocabularies and the law of measures.

Fixed values: the terms below are the words that model files use.
"""

from __future__ import annotations

CLASSES = ("entity", "event", "measure", "enumeration", "reference", "grouping", "meta")
AGGREGATION_EFFECTS = ("additive", "point_in_time", "averageable", "non_aggregable")
AXIS_KINDS = ("time", "categorical")
BINDING_MODES = ("restrict", "partition")
RULE_KINDS = ("resolution", "aggregation", "default", "ambiguity", "exclusion", "guarantee")
RENDER_KINDS = ("sql_expression", "sql_view", "derived_set", "spark_udf", "spec_only")
IDENTITY_KINDS = ("iso", "code", "namespace_code", "fk_name", "composite", "resolved_axis", "sme_pending")
KEYLESS_IDENTITIES = ("composite", "resolved_axis", "sme_pending")
CLOSURES = ("closed", "open", "unknown")
COLUMN_ROLES = ("primary_key", "foreign_key", "value", "discriminator", "audit", "composite_key_part", "unknown")
EDGE_LEVELS = ("physical", "business", "federation")
EDGE_TYPES = {"physical": ("foreign_key", "composite_key", "value_mapped_key"), "business": ("identity", "shared_attribute"), "federation": ("identity", "alias")}
INPUT_KINDS = ("raw_source", "dataset", "authored_seed", "external")
TABLE_TYPES = ("table", "view", "materialized_view")
ABSENCES = ("genuine_zero", "not_loaded", "structurally_untracked")
AXIS_POLICIES = ("mandatory_no_default", "assumable_default", "blocked")
FIELD_ROLES = ("key", "dimension", "attribute", "measure")

#: How a measure of each type may be combined along each kind of axis.
LAW = {
    "Flow": {"time": "additive", "categorical": "additive"},
    "Stock": {"time": "point_in_time", "categorical": "additive"},
    "Intensive": {"time": "averageable", "categorical": "averageable"},
    "Target": {"time": "non_aggregable", "categorical": "non_aggregable"},
}

#: What the answer to a rule of each kind is: act on it, ask, leave out, or rely on it.
LANES = {"resolution": "COMMIT", "aggregation": "COMMIT", "default": "COMMIT", "ambiguity": "ASK", "exclusion": "REFUSE", "guarantee": "INVARIANT"}


def term(name: object) -> str:
    """The last part of a dotted term: vocabularies may be written with any namespace, or none."""
    return str(name).rsplit(".", 1)[-1]


def effects(measure_type: str, axis_kinds: dict[str, str]) -> dict[str, str]:
    """axis -> effect, derived from the measure's type and the kinds of its axes."""
    law = LAW[term(measure_type)]
    return {axis: law[term(kind)] for axis, kind in axis_kinds.items()}
