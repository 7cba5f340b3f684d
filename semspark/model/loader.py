"""YAML to model, for flat and two-plane layouts."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

import yaml

from semspark.model.types import Concept, Edge, Model, Rule, Table, Transform


class _Loader(yaml.SafeLoader):
    """Dates stay strings."""


_Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:timestamp"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}


def read(path: Path) -> dict:
    out = yaml.load(path.read_text(encoding="utf-8"), Loader=_Loader)
    return out if isinstance(out, dict) else {}


@dataclass(frozen=True)
class Layout:
    root: Path
    ontology: Path
    descriptors: Path
    transforms: Path
    sources: Path


def resolve(root: str | Path) -> Layout:
    """Folders of a project: as its manifest (*.project.yaml) says, else flat (concepts beside tables)."""
    root = Path(root)
    manifest = next(iter(sorted(root.glob("*.project.yaml"))), None)
    said = read(manifest) if manifest else {}
    planes = said.get("planes") or {}
    ontology = root / planes.get("ontology", "ontology" if (root / "ontology").is_dir() else ".")
    data = root / planes.get("data", "data" if (root / "data").is_dir() else ".")

    def place(key: str, *names: str) -> Path:
        if key in said:
            return root / said[key]
        return next((data / n for n in names if (data / n).is_dir()), data / names[0])

    return Layout(root, ontology, place("descriptors", "datasets", "tables"), place("transforms", "transforms"), place("sources", "sources"))


def _table(doc: dict) -> Table:
    t = doc["table"]
    return Table(t["name"], t.get("schema"), tuple(doc.get("columns") or ()), tuple(doc.get("foreign_keys") or ()), doc)


def _edge(doc: dict) -> Edge:
    ends = doc.get("endpoints") or {}
    a, b = ends.get("from") or {}, ends.get("to") or {}
    name = doc.get("edge_id") or f"{a.get('concept')}__{b.get('concept')}"
    text = lambda x: None if x is None else str(x)
    return Edge(name, doc.get("level", ""), doc.get("type", ""), a.get("concept", ""), b.get("concept", ""), text(a.get("cardinality")), text(b.get("cardinality")), doc.get("join_rule"), doc)


def load(root: str | Path) -> Model:
    layout = resolve(root)
    files: dict[str, dict] = {}

    def every(folder: Path, pattern: str = "**/*.yaml") -> list[tuple[str, dict]]:
        found = []
        for p in sorted(folder.glob(pattern)) if folder.is_dir() else []:
            name = str(p.relative_to(layout.root))
            files[name] = read(p)
            found.append((name, files[name]))
        return found

    # what lacks a required key is loaded as far as it goes: the structural gate tells
    concepts = {d["concept"]["name"]: Concept(d["concept"]["name"], d["concept"].get("class", ""), d, n) for n, d in every(layout.ontology / "concepts") if isinstance(d.get("concept"), dict) and "name" in d["concept"]}
    edges = [_edge(e) for _, d in every(layout.ontology, "*edges.yaml") for e in d.get("edges") or []]
    listed = lambda x: tuple([x] if isinstance(x, str) else x or ())
    rules = [Rule(r["rule"], r.get("derives", ""), listed(r.get("over")), r.get("render_kind", ""), r.get("template"), r) for _, d in every(layout.ontology, "*rules.yaml") for r in d.get("rules") or [] if "rule" in r]
    tables = [_table(d) for _, d in every(layout.descriptors) if "table" in d]
    sources = [_table(d) for _, d in every(layout.sources) if "table" in d]
    transforms = []
    for _, d in every(layout.transforms):
        if "produces" in d:
            sql = layout.root / (d["produces"].get("sql_file") or "-")
            transforms.append(Transform(d["produces"]["relation"], tuple(d.get("inputs") or ()), tuple(d.get("transforms") or ()), sql.read_text() if sql.is_file() else None, d))
    return Model(str(layout.root), concepts, {e.edge_id: e for e in edges}, {r.name: r for r in rules}, {t.name: t for t in tables}, {t.relation: t for t in transforms}, {t.name: t for t in sources}, files)
