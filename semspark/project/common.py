"""What projectors ask of a model."""

from __future__ import annotations

import re

from semspark.model.types import Concept, Edge, Model, Table

NODE_CLASSES = ("entity", "event", "reference", "grouping")


def nodes(m: Model) -> list[Concept]:
    """Concepts that have instances of their own, with a described relation, by name."""
    return sorted((c for c in m.concepts.values() if c.kind in NODE_CLASSES and c.relation in m.tables), key=lambda c: c.name)


def table(m: Model, c: Concept) -> Table:
    return m.tables[c.relation or ""]


def key(m: Model, c: Concept) -> list[str]:
    """The full key: as the grounding says, else the concept's identity, else the descriptor's."""
    g = c.grounding
    said = next((s.get("key") for s in g.get("sources") or [] if s.get("key")), None) or g.get("key_column")
    if isinstance(said, str):
        said = [said]
    return list(said or table(m, c).key)


def links(m: Model) -> list[Edge]:
    names = {c.name for c in nodes(m)}
    return [e for e in m.edges.values() if e.level == "physical" and e.source in names and e.target in names]


def enumerations(m: Model) -> dict[tuple[str, str], Concept]:
    """(relation, column) -> the closed enumeration that it carries."""
    return {(c.relation, c.grounding["grounds_column"]): c for c in m.concepts.values() if c.kind == "enumeration" and c.closure == "closed" and c.relation and c.grounding.get("grounds_column")}


def one_line(text: object) -> str:
    return " ".join(str(text or "").split())


def upper_snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).upper()
