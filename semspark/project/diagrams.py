"""Mermaid diagrams: concepts over relations, entities, tables, and the flow of the data plane."""

from __future__ import annotations

import re

from semspark.model.types import Model
from semspark.project.common import key, links, nodes, table


def safe(text: str) -> str:
    """A type or name as a diagram takes it: letters, digits and underscores."""
    return re.sub(r"\W+", "_", text).strip("_") or "_"


def _title(text: str) -> list[str]:
    return ["---", f"title: {text}", "---"]


def flowchart(m: Model, name: str) -> str:
    out = [*_title(f"{name}: concepts and where they are grounded"), "flowchart LR", "  subgraph meaning"]
    out += [f'    {safe(c.name)}["{c.name} · {c.kind}"]' for c in m.concepts.values()]
    out += ["  end", "  subgraph data"]
    out += [f'    t_{safe(t)}[("{t}")]' for t in m.tables]
    out += ["  end"]
    out += [f'  {safe(e.source)} -->|"{e.role or e.edge_id}"| {safe(e.target)}' for e in m.edges.values()]
    out += [f"  {safe(c.name)} -.-> t_{safe(r)}" for c in m.concepts.values() for r in c.relations if r in m.tables]
    out += [f"  {safe(r.derives)} ==> {safe(x)}" for r in m.rules.values() for x in r.over if r.derives in m.concepts and x in m.concepts]
    return "\n".join(out) + "\n"


def _end(cardinality: str | None, left: bool) -> str:
    """crow's feet of each cardinality word."""
    pair = {"1": ("||", "||"), "0..1": ("|o", "o|"), "1..N": ("}|", "|{"), "0..N": ("}o", "o{")}.get(cardinality or "0..N", ("}o", "o{"))
    return pair[0] if left else pair[1]


def _box(name: str, columns: list[tuple[str, str, str]]) -> list[str]:
    return [f"  {safe(name)} {{", *(f"    {safe(t)} {c}{' ' + mark if mark else ''}" for t, c, mark in columns), "  }"]


def entity_relations(m: Model, name: str) -> str:
    out = [*_title(f"{name}: entities"), "erDiagram"]
    out += [f'  {e.target} {_end(e.target_cardinality, True)}--{_end(e.source_cardinality, False)} {e.source} : "{e.role or e.edge_id}"' for e in links(m)]
    for c in nodes(m):
        out += _box(c.name, [(col.get("type") or "string", col["name"], "PK" if col["name"] in key(m, c) else "") for col in table(m, c).columns])
    return "\n".join(out) + "\n"


def physical(m: Model, name: str) -> str:
    out = [*_title(f"{name}: tables"), "erDiagram"]
    for t in sorted(m.tables.values(), key=lambda t: t.name):
        own, far = set(t.key), {fk["from_column"] for fk in t.foreign_keys}
        out += _box(t.name, [(c.get("type") or "string", c["name"], ", ".join(x for x, s in (("PK", own), ("FK", far)) if c["name"] in s)) for c in t.columns])
    out += [f'  {safe(fk["to_table"])} ||--o{{ {safe(t.name)} : "{fk["from_column"]}"' for t in sorted(m.tables.values(), key=lambda t: t.name) for fk in t.foreign_keys]
    return "\n".join(out) + "\n"


def lineage(m: Model, name: str) -> str:
    out = [*_title(f"{name}: sources, transforms, datasets"), "flowchart LR"]
    shapes = {"raw_source": "[/{}/]", "dataset": "[({})]", "authored_seed": "[\\{}\\]", "external": "[/{}/]"}
    seen: dict[str, str] = {t: "dataset" for t in m.tables}
    for t in m.transforms.values():
        seen.setdefault(t.relation.split(".")[-1], "dataset")
        for i in t.inputs:
            seen.setdefault(i["relation"].split(".")[-1], i.get("kind", "dataset"))
    out += [f"  d_{safe(n)}" + shapes[kind].format(f'"{n}"') for n, kind in sorted(seen.items())]
    for t in m.transforms.values():
        to = t.relation.split(".")[-1]
        out.append(f'  x_{safe(to)}{{{{"{to}: {", ".join(s["id"] for s in t.steps)}"}}}}')
        out += [f"  d_{safe(i['relation'].split('.')[-1])} {'-.->' if i.get('kind') == 'dataset' else '-->'} x_{safe(to)}" for i in t.inputs]
        out.append(f"  x_{safe(to)} --> d_{safe(to)}")
    return "\n".join(out) + "\n"
