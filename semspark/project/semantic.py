"""Datasets, relationships and metrics as a YAML document for semantic-layer tools."""

from __future__ import annotations

import re

import yaml

from semspark.model.types import Model
from semspark.plans.compiler import snake
from semspark.project.common import key, nodes, one_line

VERSION = "0.2.0.dev0"  # of the interchange format


def _sql(text: str) -> dict:
    return {"dialects": [{"dialect": "ANSI_SQL", "expression": text}]}


def semantic_model(m: Model, name: str) -> str:
    by_relation = {c.relation: c for c in reversed(nodes(m))}
    datasets = [{"name": t.name, "source": f"{t.schema}.{t.name}" if t.schema else t.name, "primary_key": key(m, by_relation[t.name]) if t.name in by_relation else t.key, "fields": [{"name": c["name"], "expression": _sql(c["name"])} for c in t.columns]} for t in sorted(m.tables.values(), key=lambda t: t.name)]
    relationships = []
    for e in m.edges.values():
        if e.level == "physical" and e.clauses:
            a = e.clauses[0]
            relationships.append({"name": e.edge_id, "from": a.left_relation, "to": a.right_relation, "from_columns": [c.left_column for c in e.clauses], "to_columns": [c.right_column for c in e.clauses]})
    metrics = []
    for c in sorted(m.concepts.values(), key=lambda c: c.name):
        rule = m.rules.get(c.doc.get("derived_by_rule") or "")
        if c.kind != "measure" or rule is None:
            continue
        text = one_line(re.sub(r"--[^\n]*", "", rule.template or ""))
        metric = {"name": snake(c.name), "expression": _sql(text), "description": one_line(rule.doc.get("logic"))}
        # filters and finer relations that the expression alone would lose
        kept = {"filters": [r["id"] for x in rule.over for r in (m.concepts[x].rules if x in m.concepts else []) if str(r["kind"]).endswith("exclusion")], "pre_aggregates": [p["relation"] for p in rule.doc.get("x-pre_aggregates") or []]}
        if any(kept.values()):
            metric["x-requires"] = {k: v for k, v in kept.items() if v}
        metrics.append(metric)
    return yaml.safe_dump({"version": VERSION, "semantic_model": [{"name": name, "datasets": datasets, "relationships": relationships, "metrics": metrics}]}, sort_keys=False, allow_unicode=True)
