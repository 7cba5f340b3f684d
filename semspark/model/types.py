"""Model elements: immutable, driver-side."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

from semspark.model.vocab import effects, term

CLAUSE = re.compile(r"^\s*([\w.]+)\.(\w+)\s*=\s*([\w.]+)\.(\w+)\s*$")


@dataclass(frozen=True)
class Citation:
    """Where a part of an answer comes from."""

    clause: str
    element: str
    detail: str = ""


@dataclass(frozen=True)
class Concept:
    name: str
    kind: str
    doc: dict = field(compare=False, hash=False)
    path: str = ""

    @property
    def body(self) -> dict:
        return self.doc.get("concept") or {}

    @property
    def semantics(self) -> dict:
        return self.body.get("semantics") or {}

    @property
    def grounding(self) -> dict:
        return self.doc.get("grounding") or {}

    @property
    def relations(self) -> tuple[str, ...]:
        g = self.grounding
        names = [s["relation"] for s in g.get("sources") or []] + ([g["table"]] if g.get("table") else []) + list(g.get("tables") or []) + list(g.get("primary_tables") or [])
        return tuple(dict.fromkeys(n.split(".")[-1] for n in names))

    @property
    def relation(self) -> str | None:
        return self.relations[0] if self.relations else None

    @property
    def rules(self) -> list[dict]:
        contract = self.doc.get("contract")
        return list(contract.get("rules") or []) if isinstance(contract, dict) else []

    @property
    def codes(self) -> list[object]:
        return [i["code"] for i in (self.doc.get("values") or {}).get("items") or [] if "code" in i]

    @property
    def closure(self) -> str:
        return (self.doc.get("values") or {}).get("closure") or "unknown"

    @property
    def measure_type(self) -> str | None:
        t = self.semantics.get("measure_type")
        return term(t) if t else None

    @property
    def effects(self) -> dict[str, str]:
        """axis -> aggregation effect: derived from the type where axis kinds are given, else as declared."""
        kinds = self.semantics.get("axis_kinds")
        if self.measure_type and kinds:
            return effects(self.measure_type, kinds)
        return {k: term(v) for k, v in (self.semantics.get("additivity") or {}).items()}

    @property
    def field_roles(self) -> dict[str, str]:
        return {c: term(r) for c, r in (self.grounding.get("field_roles") or {}).items()}


@dataclass(frozen=True)
class Clause:
    left_relation: str
    left_column: str
    right_relation: str
    right_column: str


@dataclass(frozen=True)
class Edge:
    edge_id: str
    level: str
    type: str
    source: str
    target: str
    source_cardinality: str | None
    target_cardinality: str | None
    join_rule: str | None
    doc: dict = field(compare=False, hash=False)

    @cached_property
    def clauses(self) -> tuple[Clause, ...]:
        """The join rule's conjunction of equalities; empty if it is none."""
        if not self.join_rule:
            return ()
        parts = [CLAUSE.match(p) for p in re.split(r"\s+and\s+", self.join_rule.strip(), flags=re.I)]
        if not all(parts):
            return ()
        last = lambda r: r.split(".")[-1]
        return tuple(Clause(last(m[1]), m[2], last(m[3]), m[4]) for m in parts)  # type: ignore[index]

    def many_to_one(self, start: str) -> bool:
        """Going out from `start`, each row meets one row at most."""
        far = self.target_cardinality if start == self.source else self.source_cardinality
        return far in ("1", "0..1")

    @property
    def role(self) -> str | None:
        return ((self.doc.get("endpoints") or {}).get("from") or {}).get("role")


@dataclass(frozen=True)
class Rule:
    name: str
    derives: str
    over: tuple[str, ...]
    render_kind: str
    template: str | None
    doc: dict = field(compare=False, hash=False)


@dataclass(frozen=True)
class Table:
    name: str
    schema: str | None
    columns: tuple[dict, ...] = field(compare=False, hash=False)
    foreign_keys: tuple[dict, ...] = field(compare=False, hash=False)
    doc: dict = field(compare=False, hash=False)

    def column(self, name: str) -> dict | None:
        return next((c for c in self.columns if c["name"] == name), None)

    @property
    def key(self) -> list[str]:
        own = [c["name"] for c in self.columns if c["role"] == "primary_key"]
        return own or [c["name"] for c in self.columns if c["role"] == "composite_key_part"]


@dataclass(frozen=True)
class Transform:
    relation: str
    inputs: tuple[dict, ...] = field(compare=False, hash=False)
    steps: tuple[dict, ...] = field(compare=False, hash=False)
    sql: str | None = field(compare=False, hash=False)
    doc: dict = field(compare=False, hash=False)


@dataclass(frozen=True)
class Model:
    root: str
    concepts: dict[str, Concept]
    edges: dict[str, Edge]
    rules: dict[str, Rule]
    tables: dict[str, Table]
    transforms: dict[str, Transform]
    sources: dict[str, Table]
    files: dict[str, dict]

    def table(self, relation: str) -> Table:
        return self.tables[relation.split(".")[-1]]

    def owners(self, relation: str) -> list[Concept]:
        return [c for c in self.concepts.values() if relation.split(".")[-1] in c.relations]

    def all_rules(self) -> list[tuple[Concept, dict]]:
        return [(c, r) for c in self.concepts.values() for r in c.rules]
