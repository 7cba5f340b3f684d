"""Gates that a model passes before it is used: structure, references, shapes."""

from semspark.gates.referential import check_references
from semspark.gates.report import Finding, accept, failed, unaccepted
from semspark.gates.shapes import BUILT_IN, check_shapes
from semspark.gates.structural import check_document, check_structure

__all__ = ["BUILT_IN", "Finding", "accept", "check_document", "check_references", "check_shapes", "check_structure", "failed", "unaccepted"]


def check_all(model) -> list[Finding]:
    return [*check_structure(model), *check_references(model), *check_shapes(model)]
