"""Expressions: rule templates, folds, transforms."""

from semspark.functions.folds import fold, legal_folds
from semspark.functions.rules import call_udf, expression, predicate, registered, rendered, spark_udf
from semspark.functions.transforms import basis_points_to_fraction, canonical_status, cents_to_amount, lifecycle_state, milestone_lag

__all__ = ["basis_points_to_fraction", "call_udf", "canonical_status", "cents_to_amount", "expression", "fold", "legal_folds", "lifecycle_state", "milestone_lag", "predicate", "registered", "rendered", "spark_udf"]
