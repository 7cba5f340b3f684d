"""What can be asked: a catalog, the data of an explorer, and a manual."""

from __future__ import annotations

import json

from semspark.meta.tables import rows
from semspark.model.types import Model
from semspark.model.vocab import LANES, term
from semspark.plans.paths import find_path, reachable
from semspark.project.common import one_line


def ask_grammar(m: Model) -> list[dict]:
    """For each measure: its fact, the columns that it may be grouped or filtered by, and how each is reached."""
    out = []
    for c in m.concepts.values():
        if c.kind != "measure":
            continue
        rule = m.rules.get(c.doc.get("derived_by_rule") or "")
        fact = rule.over[0] if rule else next((o.name for o in m.owners(c.relation or "") if o.kind in ("event", "entity")), None)
        if fact not in m.concepts:
            continue
        axes = []
        for name in reachable(m, fact):
            path = find_path(m, fact, name)
            safe = isinstance(path, list) and all(e.many_to_one(a) for a, e, _ in path)
            roles = m.concepts[name].field_roles
            columns = [col for col, r in roles.items() if r in ("key", "dimension")]
            axes.append({"concept": name, "columns": columns, "group": safe, "filter": True, "route": [e.edge_id for _, e, _ in path] if isinstance(path, list) else type(path).__name__.lower()})
        out.append({"measure": c.name, "fact": fact, "effects": c.effects, "axes": axes})
    return out


def model_catalog(m: Model, name: str) -> str:
    out = [f"# {name}", "", "## Measures", "", "| measure | type | rule | relation |", "|---|---|---|---|"]
    out += [f"| {r['measure']} | {r['measure_type'] or ''} | {r['realized_from'] or ''} | {r['grounds_relation'] or ''} |" for r in rows(m)["meta_measures"]]
    out += ["", "## Derivations", "", *(f"- {r.name}: {one_line(r.doc.get('logic'))}" for r in m.rules.values()), "", "## Dimensions", "", "| dimension | identity | key | relation |", "|---|---|---|---|"]
    out += [f"| {r['dimension']} | {r['identity_kind'] or ''} | {r['canonical_key'] or ''} | {r['realized_from'] or ''} |" for r in rows(m)["meta_dimensions"]]
    return "\n".join(out) + "\n"


def explorer(m: Model, name: str) -> str:
    """Nodes, edges, rules by lane, and the data plane, as JSON."""
    lanes: dict[str, list[dict]] = {x: [] for x in dict.fromkeys(LANES.values())}
    for c, r in m.all_rules():
        lanes[LANES[term(r["kind"])]].append({"id": r["id"], "concept": c.name, "then": one_line(r.get("then"))})
    out = {
        "name": name, "concepts": [{"name": c.name, "class": c.kind, "definition": one_line(c.body.get("definition")), "relations": list(c.relations)} for c in m.concepts.values()],
        "edges": [{"id": e.edge_id, "from": e.source, "to": e.target, "level": e.level, "join": e.join_rule} for e in m.edges.values()], "lanes": lanes, "questions": ask_grammar(m),
        "data": {"tables": sorted(m.tables), "sources": sorted(m.sources), "transforms": [{"produces": t.relation, "inputs": [i["relation"] for i in t.inputs], "steps": [s["id"] for s in t.steps]} for t in m.transforms.values()]},
    }
    return json.dumps(out, indent=1, ensure_ascii=False) + "\n"


def manual(m: Model, name: str) -> str:
    out = [f"# Manual of {name}", "", "## Concepts", "", *(f"- **{c.name}** ({c.kind}): {one_line(c.body.get('definition'))}" for c in m.concepts.values()), "", "## What can be asked", ""]
    for q in ask_grammar(m):
        by = [f"{a['concept']}.{c}" for a in q["axes"] if a["group"] for c in a["columns"]]
        asks = [a["concept"] for a in q["axes"] if a["route"] == "ask"]
        out.append(f"- **{q['measure']}** of {q['fact']}, by {', '.join(by) or 'nothing'}" + (f"; a route must be named for {', '.join(asks)}" if asks else ""))
    out += ["", "## Rules", "", *(f"- {r['id']} ({LANES[term(r['kind'])].lower()}): {one_line(r.get('then'))}" for _, r in m.all_rules())]
    out += ["", "## Limits", "", "- Questions are structured intents; text isn't interpreted.", "- What no declared edge reaches isn't derivable."]
    return "\n".join(out) + "\n"
