"""Checks of what the model says against the data, as Spark jobs."""

from semspark.quality.checks import assertion, cardinality, constraints, duplicate_keys, foreign_key_orphans, guarantees, lineage_gaps, not_null, produced_schema, reconcile, report

__all__ = ["assertion", "cardinality", "constraints", "duplicate_keys", "foreign_key_orphans", "guarantees", "lineage_gaps", "not_null", "produced_schema", "reconcile", "report"]
