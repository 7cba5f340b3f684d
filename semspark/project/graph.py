"""A property graph schema in openCypher. Node keys are whole keys: of a composite one, all parts together."""

from __future__ import annotations

from semspark.model.types import Model
from semspark.model.vocab import KEYLESS_IDENTITIES, term
from semspark.project.common import key, links, nodes, table, upper_snake


def cypher(m: Model, name: str) -> str:
    out = [f"// {name}: {len(nodes(m))} node labels, {len(links(m))} relationships", "", "// keys"]
    for c in nodes(m):
        k = key(m, c)
        if not k:
            continue
        what = f"n.{k[0]} IS UNIQUE" if len(k) == 1 else "(" + ", ".join(f"n.{x}" for x in k) + ") IS NODE KEY"
        out.append(f"CREATE CONSTRAINT {c.name.lower()}_key IF NOT EXISTS FOR (n:{c.name}) REQUIRE {what};")
    out += ["", "// properties (* of the key)"]
    for c in nodes(m):
        shown = ", ".join(col["name"] + ("*" if col["name"] in key(m, c) else "") for col in table(m, c).columns)
        out.append(f"//   (:{c.name} {{{shown}}})   from {c.relation}")
    out += ["", "// relationships"]
    out += [f"//   (:{e.source})-[:{upper_snake(e.role or e.edge_id)}]->(:{e.target})   on {e.join_rule}" for e in links(m)]
    return "\n".join(out) + "\n"


def problems(m: Model) -> list[str]:
    """Nodes without a key that don't say so, and relationships whose ends are no nodes."""
    names = {c.name for c in nodes(m)}
    out = [f"{c.name} has no key" for c in nodes(m) if not key(m, c) and term((c.body.get("identity") or {}).get("kind", "")) not in KEYLESS_IDENTITIES]
    return out + [f"edge {e.edge_id}: {x} is no node" for e in m.edges.values() if e.level == "physical" for x in (e.source, e.target) if x not in names]
