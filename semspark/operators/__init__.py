"""Semantic operators as lazy DataFrame transformations; values are literals or bound arguments, never spliced text."""

from semspark.operators.alias import AliasTable, relation_alias_resolve
from semspark.operators.ambiguity import Decision, ambiguity_gate, required_axes
from semspark.operators.bindings import realize
from semspark.operators.closure import closure_anomaly_check, null_report
from semspark.operators.densify import absence_average, absence_average_over, cross_grid, densify
from semspark.operators.disposition import Disposed, Impurity, dispose
from semspark.operators.filters import attribute_filter, axis_default, exclusion_filter
from semspark.operators.hierarchy import hierarchy_rollup, in_subtree
from semspark.operators.history import value_before
from semspark.operators.latest import scoped_latest, value_at_latest
from semspark.operators.registers import composite_groupings, distinct_values, enum_from_register, grouping_from_register
from semspark.operators.relations import allocate, by_role, discriminated_union, federated, flag_counts, has_member, per_fact_as_of, pre_aggregated_left, ratio_of_sums, shared_attribute, value_mapped_join
from semspark.operators.snapshot import as_of, bitemporal_as_of, snapshot_collapse

__all__ = [
    "AliasTable", "Decision", "Disposed", "Impurity", "absence_average", "absence_average_over", "attribute_filter", "by_role", "dispose", "flag_counts", "value_before", "allocate", "ambiguity_gate", "as_of", "axis_default", "bitemporal_as_of", "closure_anomaly_check", "composite_groupings", "cross_grid", "densify", "discriminated_union", "distinct_values",
    "enum_from_register", "exclusion_filter", "grouping_from_register", "has_member", "hierarchy_rollup", "in_subtree", "null_report", "per_fact_as_of", "pre_aggregated_left", "ratio_of_sums", "relation_alias_resolve", "required_axes",
    "federated", "realize", "scoped_latest", "shared_attribute", "value_mapped_join", "snapshot_collapse", "value_at_latest",
]
