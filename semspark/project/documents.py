"""A bundle of Markdown files, one for each concept, with a header of fields and links between them."""

from __future__ import annotations

import re

import yaml

from semspark.model.types import Concept, Model
from semspark.project.common import one_line


def _page(m: Model, c: Concept) -> str:
    said = c.doc.get("metadata") or {}
    label = c.body.get("label") or c.name
    t = m.tables.get(c.relation or "")
    head = {"type": c.kind.title(), "title": label, "description": one_line(c.body.get("definition")), "tags": [x for x in (said.get("source"), c.kind, f"confidence:{said['confidence']}" if said.get("confidence") else None) if x]}
    if t is not None:
        head["resource"] = f"table://{t.schema or 'default'}/{t.name}"
    out = ["---", yaml.safe_dump(head, sort_keys=False, allow_unicode=True).strip(), "---", "", f"# {label}", "", one_line(c.body.get("definition")), ""]
    if c.semantics.get("purpose"):
        out += ["## Purpose", "", one_line(c.semantics["purpose"]), ""]
    if c.kind == "measure":
        out += ["## Additivity", "", "| axis | effect |", "|---|---|", *(f"| {a} | {e} |" for a, e in c.effects.items()), ""]
    if c.codes:
        out += ["## Values", "", f"The set is {c.closure}.", "", "| code | label |", "|---|---|", *(f"| `{i['code']}` | {i.get('label') or ''} |" for i in c.doc["values"]["items"]), ""]
    if t is not None:
        out += ["## Schema", "", f"Grounded in `{t.name}`.", "", "| column | type | role |", "|---|---|---|", *(f"| `{x['name']}` | {x.get('type') or 'string'} | {x['role']} |" for x in t.columns), ""]
    rules = [f"- {r['id']}: {one_line(r.get('then'))}" for r in c.rules]
    rule = m.rules.get(c.doc.get("derived_by_rule") or "")
    if rule is not None:
        rules.append(f"- {rule.name}: {one_line(rule.doc.get('logic'))}")
    if rules:
        out += ["## Rules", "", *rules, ""]
    edges = [f"- {e.role or e.edge_id}: [{e.target}]({e.target}.md)" for e in m.edges.values() if e.source == c.name] + [f"- {e.role or e.edge_id} of [{e.source}]({e.source}.md)" for e in m.edges.values() if e.target == c.name and e.source != c.name]
    if edges:
        out += ["## Relations", "", *edges, ""]
    return "\n".join(out)


def bundle(m: Model) -> dict[str, str]:
    pages = {f"{c.name}.md": _page(m, c) for c in sorted(m.concepts.values(), key=lambda c: c.name)}
    pages["index.md"] = "# Index\n\n" + "".join(f"- [{n[:-3]}]({n})\n" for n in sorted(pages))
    return pages


def broken_links(pages: dict[str, str]) -> list[tuple[str, str]]:
    return [(n, to) for n, text in pages.items() for to in re.findall(r"\]\(([\w.-]+\.md)\)", text) if to not in pages]
