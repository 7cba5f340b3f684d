"""OWL classes and properties, and SHACL shapes, as Turtle; and the shapes' constraints run on the data by Spark."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semspark.model.types import Model
from semspark.project.common import enumerations, key, links, nodes, one_line, table

XSD = {"string": "string", "integer": "integer", "int": "integer", "bigint": "integer", "decimal": "decimal", "numeric": "decimal", "number": "decimal", "float": "double", "double": "double", "boolean": "boolean", "date": "date", "timestamp": "dateTime", "datetime": "dateTime"}
PREFIXES = {"owl": "http://www.w3.org/2002/07/owl#", "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "rdfs": "http://www.w3.org/2000/01/rdf-schema#", "sh": "http://www.w3.org/ns/shacl#", "xsd": "http://www.w3.org/2001/XMLSchema#"}


def xsd(name: str | None) -> str:
    return "xsd:" + XSD.get((name or "string").lower().split("(")[0].strip(), "string")


def quoted(text: str) -> str:
    return json.dumps(one_line(text), ensure_ascii=False)


def _head(base: str, used: tuple[str, ...]) -> list[str]:
    return [f"@prefix : <{base}#> .", *(f"@prefix {p}: <{PREFIXES[p]}> ." for p in used), ""]


def _block(subject: str, pairs: list[tuple[str, str]]) -> str:
    return f"{subject} " + " ;\n    ".join(f"{p} {o}" for p, o in pairs) + " .\n"


def turtle(m: Model, name: str, base: str = "urn:semspark") -> str:
    out = _head(f"{base}:{name}", ("owl", "rdfs", "xsd")) + [_block(f"<{base}:{name}>", [("a", "owl:Ontology"), ("rdfs:label", quoted(name))])]
    for c in nodes(m):
        pairs = [("a", "owl:Class"), ("rdfs:label", quoted(c.body.get("label") or c.name))]
        if c.body.get("definition"):
            pairs.append(("rdfs:comment", quoted(c.body["definition"])))
        out.append(_block(f":{c.name}", pairs))
        for col in table(m, c).columns:
            out.append(_block(f":{c.name}.{col['name']}", [("a", "owl:DatatypeProperty"), ("rdfs:label", quoted(col["name"])), ("rdfs:domain", f":{c.name}"), ("rdfs:range", xsd(col.get("type")))]))
    for e in sorted(links(m), key=lambda e: e.edge_id):
        out.append(_block(f":{e.edge_id}", [("a", "owl:ObjectProperty"), ("rdfs:label", quoted(e.role or e.edge_id)), ("rdfs:domain", f":{e.source}"), ("rdfs:range", f":{e.target}")]))
    return "\n".join(out)


def _counts(cardinality: str | None) -> list[tuple[str, str]]:
    """Least and most of each cardinality word."""
    least, most = {"1": ("1", "1"), "0..1": (None, "1"), "1..N": ("1", None), "0..N": (None, None)}.get(cardinality or "0..N", (None, None))
    return [(p, v) for p, v in (("sh:minCount", least), ("sh:maxCount", most)) if v]


def shacl(m: Model, name: str, base: str = "urn:semspark") -> str:
    out, closed = _head(f"{base}:{name}", ("rdf", "rdfs", "sh", "xsd")), enumerations(m)
    for c in nodes(m):
        properties = []
        for col in table(m, c).columns:
            pairs = [("sh:path", f":{c.name}.{col['name']}"), ("sh:name", quoted(col["name"])), ("sh:nodeKind", "sh:Literal"), ("sh:datatype", xsd(col.get("type"))), ("sh:maxCount", "1")]
            if col["name"] in key(m, c):
                pairs += [("sh:minCount", "1"), ("sh:message", quoted(f"{c.name}.{col['name']} is part of the key and must be there"))]
            e = closed.get((c.relation, col["name"]))
            if e is not None:
                pairs.append(("sh:in", "( " + " ".join(quoted(str(x)) for x in e.codes) + " )"))
            properties.append(pairs)
        for e in links(m):
            if e.source == c.name:
                properties.append([("sh:path", f":{e.edge_id}"), ("sh:class", f":{e.target}"), *_counts(e.target_cardinality)])
        shown = " ,\n        ".join("[ " + " ; ".join(f"{p} {o}" for p, o in pairs) + " ]" for pairs in properties)
        out.append(_block(f":{c.name}Shape", [("a", "sh:NodeShape"), ("rdfs:label", quoted(f"{c.name} shape")), ("sh:targetClass", f":{c.name}"), ("sh:property", shown)]))
    return "\n".join(out)


def validate(m: Model, frames: dict[str, DataFrame]) -> list[tuple[str, str, int]]:
    """The shapes' constraints over the data: (concept, constraint, violations), in one pass for each relation."""
    out, closed = [], enumerations(m)
    for c in nodes(m):
        if c.relation not in frames:
            continue
        tests = {f"{k} is there": F.col(k).isNull() for k in key(m, c)}
        tests |= {f"{col} in closed set": F.col(col).isNotNull() & ~F.col(col).isin(e.codes) for (r, col), e in closed.items() if r == c.relation}
        if tests:
            row = frames[c.relation].agg(*(F.count(F.when(t, 1)) for t in tests.values())).first()
            out += [(c.name, n, v) for n, v in zip(tests, row, strict=True)]  # type: ignore[arg-type]
    return out
