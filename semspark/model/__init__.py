"""The semantic model: concepts, rules, edges, and the descriptors of physical tables."""

from semspark.model.loader import load, resolve
from semspark.model.types import Citation, Concept, Edge, Model, Rule, Table, Transform

__all__ = ["Citation", "Concept", "Edge", "Model", "Rule", "Table", "Transform", "load", "resolve"]
