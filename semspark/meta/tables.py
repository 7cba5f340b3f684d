"""Tables about the model. All columns are strings (nested values as JSON); an empty section is an empty table with its
columns. Column lists are fixed values: they are the tables' contract."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from semspark.model.types import Concept, Model
from semspark.model.vocab import LANES, LAW, RULE_KINDS, term

META_TABLES = {
    "meta_measures": ("measure", "stem", "source_kind", "measure_type", "type", "additivity_time", "additivity_categorical", "closure", "grounds_relation", "realized_from", "definition", "kpi_codes", "surface", "axis_kinds"),
    "meta_kpi_variants": ("stem", "kpi_code", "variant", "suffix", "is_default"),
    "meta_dimensions": ("dimension", "concept", "grain", "identity_kind", "canonical_key", "realized_from", "cardinality"),
    "meta_group_members": ("dimension", "group_code", "member"),
    "meta_group_definitions": ("scheme", "namespace", "code", "label", "member_count", "collides_with"),
    "meta_group_definition_members": ("scheme", "namespace", "code", "member", "member_kind"),
    "meta_enum": ("concept", "value", "label"),
    "meta_rules": ("rule_id", "family", "kind_term", "scope", "subject", "when_text", "then_text", "never_text", "confidence", "home_concept", "lane"),
    "meta_rule_refs": ("rule_id", "ref_kind", "ref_value"),
    "meta_decision_policy": ("slot", "policy", "governing_rule", "rule_id", "on_missing"),
    "meta_rule_kinds": ("term", "lane", "closed"),
    "meta_edges": ("edge_id", "level", "type", "from_concept", "to_concept", "cardinality", "join_rule", "role", "realized_by_register", "verified_by", "confidence"),
    "meta_edge_join_clauses": ("edge_id", "ordinal", "left_relation", "left_column", "right_relation", "right_column"),
    "meta_provenance": ("source", "versions", "input_path", "input_sha256", "input_bytes"),
}


def text(v: object) -> str | None:
    if v is None or isinstance(v, str):
        return v.strip() if isinstance(v, str) else None
    if isinstance(v, bool):
        return "true" if v else "false"
    return json.dumps(v, sort_keys=True, ensure_ascii=False) if isinstance(v, (dict, list, tuple)) else str(v)


def cardinality_label(e) -> str:
    many = lambda c: "N" if c is None or "N" in c else "1"
    return f"{many(e.source_cardinality)}:{many(e.target_cardinality)}"


def _register(e) -> str | None:
    by = e.doc.get("realized_by")
    return by.get("via_register") if isinstance(by, dict) else None


def variant(code: str) -> tuple[str, str]:
    """(stem, suffix) of a dotted code."""
    stem, _, suffix = code.rpartition(".")
    return (stem, suffix) if stem else (code, "")


def _measures(m: Model) -> list[dict]:
    out = []
    for c in m.concepts.values():
        if c.kind != "measure":
            continue
        e = c.effects
        kinds = {a: term(k) for a, k in (c.semantics.get("axis_kinds") or {}).items()}
        law = LAW.get(c.measure_type or "", {})
        kpis = [k.get("code") for k in c.doc.get("individual_kpis") or [] if isinstance(k, dict)]
        by = lambda kind: law.get(kind) or next((v for a, v in e.items() if kinds.get(a) == kind), None)  # noqa: E731, B023
        out.append({"measure": c.name, "stem": c.name, "source_kind": "inline_enum" if kpis else "concept_only", "measure_type": c.measure_type, "type": c.kind, "additivity_time": by("time"), "additivity_categorical": by("categorical"), "closure": c.closure if kpis else None, "grounds_relation": c.relation, "realized_from": c.doc.get("derived_by_rule"), "definition": c.body.get("definition"), "kpi_codes": kpis or None, "surface": c.body.get("label"), "axis_kinds": kinds or None})
    return out


def _variants(m: Model) -> list[dict]:
    out = []
    for c in m.concepts.values():
        for k in c.doc.get("individual_kpis") or []:
            if isinstance(k, dict) and k.get("code"):
                stem, suffix = variant(str(k["code"]))
                out.append({"stem": stem, "kpi_code": k["code"], "variant": k.get("label") or suffix, "suffix": suffix, "is_default": bool(k.get("default"))})
    return out


def _identity(c: Concept) -> dict:
    return c.body.get("identity") or {}


def _dimensions(m: Model) -> list[dict]:
    out = []
    for c in m.concepts.values():
        if c.kind in ("entity", "reference", "enumeration", "grouping"):
            i = _identity(c)
            out.append({"dimension": c.name, "concept": c.name, "grain": c.grounding.get("grain"), "identity_kind": term(i["kind"]) if i.get("kind") else None, "canonical_key": i.get("canonical_key") or c.grounding.get("grounds_column"), "realized_from": c.relation, "cardinality": {"declared": len(c.codes)} if c.codes else None})
    return out


def _definitions(m: Model) -> list[tuple[str, dict]]:
    return [(c.name, d) for c in m.concepts.values() if c.kind == "grouping" and isinstance(c.doc.get("members"), dict) for d in c.doc["members"].get("definitions") or []]


def _groups(m: Model) -> list[dict]:
    every = _definitions(m)
    ident = lambda s, d: f"{s}:{d.get('namespace') or ''}:{d['code']}"
    return [
        {"scheme": s, "namespace": d.get("namespace"), "code": d["code"], "label": d.get("label"), "member_count": len(d.get("members") or []), "collides_with": sorted(ident(s2, d2) for s2, d2 in every if d2["code"] == d["code"] and d2 is not d)} for s, d in every
    ]


def _members(m: Model) -> list[dict]:
    return [{"scheme": s, "namespace": d.get("namespace"), "code": d["code"], "member": x, "member_kind": "leaf"} for s, d in _definitions(m) for x in d.get("members") or []]


def _rules(m: Model) -> list[dict]:
    out = [
        {"rule_id": r["id"], "family": r["id"].split(".")[0], "kind_term": term(r["kind"]), "scope": r.get("scope") or "general", "subject": r.get("subject"), "when_text": r.get("when"), "then_text": r.get("then"), "never_text": r.get("never"), "confidence": r.get("confidence"), "home_concept": c.name, "lane": LANES.get(term(r["kind"]))}
        for c, r in m.all_rules()
    ]
    return out + [{"rule_id": r.name, "family": "derivation", "kind_term": "aggregation", "scope": "general", "subject": r.derives, "when_text": f"{r.derives} is asked for", "then_text": r.doc.get("logic"), "confidence": r.doc.get("confidence"), "home_concept": r.derives, "lane": "COMMIT"} for r in m.rules.values()]


def _rule_refs(m: Model) -> list[dict]:
    out = [{"rule_id": r["id"], "ref_kind": "binds", "ref_value": b} for _, r in m.all_rules() for b in r.get("binds") or []]
    out += [{"rule_id": r["id"], "ref_kind": "realized_by", "ref_value": term(x["udf"])} for _, r in m.all_rules() for x in ([r["realized_by"]] if isinstance(r.get("realized_by"), dict) else r.get("realized_by") or [])]
    out += [{"rule_id": r.name, "ref_kind": "over", "ref_value": x} for r in m.rules.values() for x in r.over]
    out += [{"rule_id": r.name, "ref_kind": "relation", "ref_value": x} for r in m.rules.values() for x in ([r.doc["validated_against"]] if isinstance(r.doc.get("validated_against"), str) else r.doc.get("validated_against") or [])]
    return out + [{"rule_id": c.doc["derived_by_rule"], "ref_kind": "cited_by", "ref_value": c.name} for c in m.concepts.values() if c.doc.get("derived_by_rule")]


def _policies(m: Model) -> list[dict]:
    ask = {"mandatory_no_default": "ASK", "assumable_default": "ASSUME", "blocked": "REFUSE"}
    out = [{"slot": f"{c.name}.{a}", "policy": p.get("policy"), "governing_rule": p.get("rule"), "rule_id": p.get("rule"), "on_missing": ask.get(p.get("policy"))} for c in m.concepts.values() for a, p in (c.doc.get("x-axes") or {}).items()]
    return out + [{"slot": c.name, "policy": "default_reading", "on_missing": "ASSUME"} for c in m.concepts.values() if isinstance(c.doc.get("contract"), dict) and c.doc["contract"].get("default_reading")]


def _provenance(m: Model) -> list[dict]:
    out = []
    for name in sorted(m.files):
        data = (Path(m.root) / name).read_bytes()
        said = m.files[name].get("metadata") or {}
        out.append({"source": said.get("source"), "versions": {k: said[k] for k in ("version", "schema_version") if k in said} or None, "input_path": name, "input_sha256": hashlib.sha256(data).hexdigest(), "input_bytes": len(data)})
    return out


def rows(m: Model) -> dict[str, list[dict]]:
    return {
        "meta_measures": _measures(m),
        "meta_kpi_variants": _variants(m),
        "meta_dimensions": _dimensions(m),
        "meta_group_members": [{"dimension": r["scheme"], "group_code": r["code"], "member": r["member"]} for r in _members(m)],
        "meta_group_definitions": _groups(m),
        "meta_group_definition_members": _members(m),
        "meta_enum": [{"concept": c.name, "value": i["code"], "label": i.get("label")} for c in m.concepts.values() if c.kind == "enumeration" for i in (c.doc.get("values") or {}).get("items") or []],
        "meta_rules": _rules(m),
        "meta_rule_refs": _rule_refs(m),
        "meta_decision_policy": _policies(m),
        "meta_rule_kinds": [{"term": k, "lane": LANES[k], "closed": True} for k in RULE_KINDS],
        "meta_edges": [{"edge_id": e.edge_id, "level": e.level, "type": e.type, "from_concept": e.source, "to_concept": e.target, "cardinality": cardinality_label(e), "join_rule": e.join_rule, "role": e.role, "realized_by_register": _register(e), "verified_by": e.doc.get("verified_by"), "confidence": e.doc.get("confidence")} for e in m.edges.values()],
        "meta_edge_join_clauses": [{"edge_id": e.edge_id, "ordinal": n, "left_relation": c.left_relation, "left_column": c.left_column, "right_relation": c.right_relation, "right_column": c.right_column} for e in m.edges.values() for n, c in enumerate(e.clauses)],
        "meta_provenance": _provenance(m),
    }


def column_meanings(spark: SparkSession, m: Model) -> DataFrame:
    """(relation, column, type, role, field_role, rules): a column's part in the data and in the concepts' rules."""
    out = []
    for t in m.tables.values():
        owners = m.owners(t.name)
        for c in t.columns:
            said = sorted({f"{r['id']}: {' '.join(str(r.get('then') or '').split())}" for o in owners for r in o.rules if c["name"] in (r.get("binds") or [])})
            role = next((o.field_roles[c["name"]] for o in owners if c["name"] in o.field_roles), None)
            out.append((t.name, c["name"], c.get("type") or "string", c["role"], role, text(said) if said else None))
    return spark.createDataFrame(out, "relation string, column string, type string, role string, field_role string, rules string")


def meta_tables(spark: SparkSession, m: Model, views: bool = False) -> dict[str, DataFrame]:
    out = {}
    for name, found in rows(m).items():
        columns = META_TABLES[name]
        out[name] = spark.createDataFrame([tuple(text(r.get(c)) for c in columns) for r in found], ", ".join(f"{c} string" for c in columns))
        if views:
            out[name].createOrReplaceTempView(name)
    return out


def _lines(width: int, **fields: object) -> list[str]:
    """Fields that are given, aligned."""
    return [f"{k:<{width}} {text(v)}" for k, v in fields.items() if v not in (None, "", [], {})]


def concept_cards(m: Model) -> dict[str, str]:
    """What is known of each concept, as one text by name: what it is, where its rows are, its rules and its edges."""
    out = {}
    for c in m.concepts.values():
        body = [f"# {c.name}", "", " ".join(str(c.body.get("definition") or "").split()), ""]
        body += _lines(10, kind=c.kind, identity=term(_identity(c).get("kind") or "") or None, relation=c.relation, grain=c.grounding.get("grain"), derived=c.doc.get("derived_by_rule"), closure=c.closure if c.codes else None, codes=c.codes or None, effects=c.effects or None)
        body += [f"rule       {r['id']} ({term(r['kind'])}): {' '.join(str(r.get('then') or '').split())}" for r in c.rules]
        body += [f"edge       {e.edge_id} ({cardinality_label(e)}): {e.source} -> {e.target}" for e in m.edges.values() if c.name in (e.source, e.target)]
        out[c.name] = "\n".join(body).rstrip() + "\n"
    return out


def descriptor_cards(m: Model) -> dict[str, str]:
    """What is known of each described relation, as one text by name: its columns with their parts, and where its keys lead."""
    out = {}
    for t in m.tables.values():
        owners = [c.name for c in m.owners(t.name)]
        body = [f"# {t.name}", "", *_lines(10, schema=t.schema, type=t.doc["table"].get("type"), key=t.key or None, concepts=owners or None)]
        body += [f"column     {c['name']} {c.get('type') or 'string'} ({c['role']})" for c in t.columns]
        body += [f"leads      {f['from_column']} -> {f['to_table']}.{f['to_column']}" for f in t.foreign_keys]
        out[t.name] = "\n".join(body) + "\n"
    return out


def write_cards(m: Model, folder: str | Path) -> list[str]:
    """concepts/<name>.md and descriptors/<name>.md under a folder; returns the files."""
    files = []
    for kind, cards in (("concepts", concept_cards(m)), ("descriptors", descriptor_cards(m))):
        place = Path(folder) / kind
        place.mkdir(parents=True, exist_ok=True)
        for name, body in cards.items():
            (place / f"{name}.md").write_text(body, encoding="utf-8")
            files.append(f"{kind}/{name}.md")
    return files


def coverage(m: Model) -> tuple[int, int]:
    """Slots that carry behaviour: those bound to an operator or an executable rule, and all."""
    bound = every = 0
    for c in m.concepts.values():
        slots = [c.doc.get("values"), c.doc.get("members"), c.semantics or None, *c.rules]
        for s in slots:
            if isinstance(s, dict):
                every += 1
                bound += bool(s.get("realized_by") or s.get("enforced_by") or (s is c.semantics and c.doc.get("derived_by_rule")))
    return bound, every
