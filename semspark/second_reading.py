"""The oracle of the meta tables: the model's files read a second time, without the engine's loader and types, as SQL of literal
tables. Only the files and the published column lists are shared."""

from __future__ import annotations

import functools
import hashlib
import json
from pathlib import Path

import yaml

ROOT = Path(__file__).resolve().parent.parent / "models"
MODELS = ("tpch", "retail")
#: Combination along each kind of axis, by a measure's type; what follows from a rule of each kind.
ALONG = {"Flow": ("additive", "additive"), "Stock": ("point_in_time", "additive"), "Intensive": ("averageable", "averageable"), "Target": ("non_aggregable", "non_aggregable")}
LANE = {"resolution": "COMMIT", "aggregation": "COMMIT", "default": "COMMIT", "ambiguity": "ASK", "exclusion": "REFUSE", "guarantee": "INVARIANT"}


@functools.cache
def docs(model: str) -> dict[str, dict]:
    return {str(p.relative_to(ROOT / model)): yaml.safe_load(p.read_text()) for p in sorted((ROOT / model).rglob("*.yaml"))}


def concepts(model: str) -> list[dict]:
    return [d for d in docs(model).values() if "concept" in d]


def edges(model: str) -> list[dict]:
    return docs(model)["ontology/edges.yaml"]["edges"]


def derivations(model: str) -> list[dict]:
    return docs(model)["ontology/rules.yaml"]["rules"]


def last(x: str | None) -> str | None:
    return x.split(".")[-1] if x else None


def name(d: dict) -> str:
    return d["concept"]["name"]


def ground(d: dict) -> str | None:
    g = d.get("grounding") or {}
    return last(g["sources"][0]["relation"]) if g.get("sources") else g.get("table")


def rules(d: dict) -> list[dict]:
    c = d.get("contract")
    return c.get("rules", []) if isinstance(c, dict) else []


def listed(x: object) -> list:
    return [x] if isinstance(x, (str, dict)) else list(x or [])


def groups(model: str) -> list[tuple[str, dict]]:
    return [(name(d), g) for d in concepts(model) if d["concept"]["class"] == "grouping" for g in (d.get("members") or {}).get("definitions", [])]


def of(model: str, table: str) -> list[tuple]:
    cs, es, rs = concepts(model), edges(model), derivations(model)
    if table == "meta_measures":
        out = []
        for d in cs:
            if d["concept"]["class"] == "measure":
                sem = d["concept"]["semantics"]
                kind, axes = last(sem["measure_type"]), {a: last(k) for a, k in sem["axis_kinds"].items()}
                kpis = [k["code"] for k in d.get("individual_kpis", [])]
                out.append((name(d), name(d), "inline_enum" if kpis else "concept_only", kind, "measure", *ALONG[kind], "unknown" if kpis else None, ground(d), d.get("derived_by_rule"), d["concept"]["definition"], kpis or None, d["concept"]["label"], axes))
        return out
    if table == "meta_kpi_variants":
        out = []
        for d in cs:
            for k in d.get("individual_kpis", []):
                stem, dot, tail = k["code"].rpartition(".")
                out.append((stem if dot else k["code"], k["code"], k["label"], tail if dot else "", bool(k.get("default"))))
        return out
    if table == "meta_dimensions":
        out = []
        for d in cs:
            if d["concept"]["class"] in ("entity", "reference", "enumeration", "grouping"):
                i, g, codes = d["concept"]["identity"], d.get("grounding") or {}, (d.get("values") or {}).get("items", [])
                out.append((name(d), name(d), g.get("grain"), last(i["kind"]), i.get("canonical_key") or g.get("grounds_column"), ground(d), {"declared": len(codes)} if codes else None))
        return out
    if table in ("meta_group_members", "meta_group_definition_members"):
        long = table == "meta_group_definition_members"
        return [(s, g["namespace"], g["code"], m, "leaf") if long else (s, g["code"], m) for s, g in groups(model) for m in g["members"]]
    if table == "meta_group_definitions":
        every = groups(model)
        return [(s, g["namespace"], g["code"], g["label"], len(g["members"]), sorted(f"{t}:{h['namespace']}:{h['code']}" for t, h in every if h["code"] == g["code"] and h is not g)) for s, g in every]
    if table == "meta_enum":
        return [(name(d), v["code"], v.get("label")) for d in cs if d["concept"]["class"] == "enumeration" for v in (d.get("values") or {}).get("items", [])]
    if table == "meta_rules":
        own = [(r["id"], r["id"].split(".")[0], last(r["kind"]), r.get("scope", "general"), r.get("subject"), r.get("when"), r.get("then"), r.get("never"), r.get("confidence"), name(d), LANE[last(r["kind"])]) for d in cs for r in rules(d)]
        return own + [(r["rule"], "derivation", "aggregation", "general", r["derives"], f"{r['derives']} is asked for", r["logic"], None, r.get("confidence"), r["derives"], "COMMIT") for r in rs]
    if table == "meta_rule_refs":
        out = [(r["id"], "binds", b) for d in cs for r in rules(d) for b in r.get("binds", [])]
        out += [(r["id"], "realized_by", last(x["udf"])) for d in cs for r in rules(d) for x in listed(r.get("realized_by"))]
        out += [(r["rule"], "over", x) for r in rs for x in listed(r["over"])] + [(r["rule"], "relation", x) for r in rs for x in listed(r.get("validated_against"))]
        return out + [(d["derived_by_rule"], "cited_by", name(d)) for d in cs if "derived_by_rule" in d]
    if table == "meta_decision_policy":
        step = {"mandatory_no_default": "ASK", "assumable_default": "ASSUME", "blocked": "REFUSE"}
        out = [(f"{name(d)}.{a}", p["policy"], p.get("rule"), p.get("rule"), step.get(p["policy"])) for d in cs for a, p in d.get("x-axes", {}).items()]
        return out + [(name(d), "default_reading", None, None, "ASSUME") for d in cs if isinstance(d.get("contract"), dict) and "default_reading" in d["contract"]]
    if table == "meta_rule_kinds":
        return [(k, v, True) for k, v in LANE.items()]
    if table == "meta_edges":
        many = lambda e: "1" if e.get("cardinality") in ("1", "0..1") else "N"
        ends = lambda e: (e["endpoints"]["from"], e["endpoints"]["to"])
        return [(e["edge_id"], e["level"], e["type"], ends(e)[0]["concept"], ends(e)[1]["concept"], ":".join(map(many, ends(e))), e.get("join_rule"), ends(e)[0].get("role"), (e.get("realized_by") or {}).get("via_register"), e.get("verified_by"), e.get("confidence")) for e in es]
    if table == "meta_edge_join_clauses":
        parts = [(e["edge_id"], n, [x.strip().split(".") for x in c.split("=")]) for e in es if e.get("join_rule") for n, c in enumerate(e["join_rule"].split(" AND "))]
        return [(i, n, *a, *b) for i, n, (a, b) in parts]
    if table == "meta_provenance":
        out = []
        for path, d in docs(model).items():
            if not path.endswith(".project.yaml"):
                said, data = d.get("metadata") or {}, (ROOT / model / path).read_bytes()
                out.append((said.get("source"), {k: said[k] for k in ("version", "schema_version") if k in said} or None, path, hashlib.sha256(data).hexdigest(), len(data)))
        return out
    assert table == "meta_columns"
    out = []
    for path, d in docs(model).items():
        if "table" in d and not path.startswith("data/sources"):
            owners = [c for c in cs if d["table"]["name"] in [last(s["relation"]) for s in (c.get("grounding") or {}).get("sources", [])] + [(c.get("grounding") or {}).get("table")]]
            for c in d["columns"]:
                said = sorted({f"{r['id']}: {' '.join(r.get('then', '').split())}" for o in owners for r in rules(o) if c["name"] in r.get("binds", [])})
                roles = [(o.get("grounding") or {}).get("field_roles", {}).get(c["name"]) for o in owners]
                out.append((d["table"]["name"], c["name"], c["type"], c["role"], next((last(r) for r in roles if r), None), said or None))
    return out


COLUMNS = {"meta_columns": ("relation", "column", "type", "role", "field_role", "rules")}


def cell(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        v = str(v).lower()
    if isinstance(v, (list, dict)):
        v = json.dumps(v, sort_keys=True, ensure_ascii=False)
    return "'" + str(v).strip().replace("'", "''") + "'"


def second_reading(table: str) -> str:
    from semspark.meta import META_TABLES

    columns = (*(COLUMNS.get(table) or META_TABLES[table]), "model")
    rows = ["(" + ", ".join(map(cell, (*r, m))) + ")" for m in MODELS for r in of(m, table)]
    said = ", ".join(f'CAST("{c}" AS VARCHAR) AS "{c}"' for c in columns)
    return f"SELECT {said} FROM (VALUES {', '.join(rows)}) t({', '.join(f'{chr(34)}{c}{chr(34)}' for c in columns)})"
