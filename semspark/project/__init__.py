"""The model in other formats. Each projector is text from the model alone; `write` puts all of them in a folder."""

from __future__ import annotations

from pathlib import Path

from semspark.model.types import Model
from semspark.project.catalog import explorer, manual, model_catalog
from semspark.project.diagrams import entity_relations, flowchart, lineage, physical
from semspark.project.documents import bundle, broken_links
from semspark.project.graph import cypher
from semspark.project.rdf import shacl, turtle
from semspark.project.semantic import semantic_model

__all__ = ["broken_links", "bundle", "cypher", "drifted", "entity_relations", "explorer", "flowchart", "lineage", "manual", "model_catalog", "physical", "project", "semantic_model", "shacl", "turtle", "write"]


def project(model: Model, name: str) -> dict[str, str]:
    """file name -> text."""
    out = {
        f"{name}.osi.yaml": semantic_model(model, name), f"{name}.ttl": turtle(model, name), f"{name}.shacl.ttl": shacl(model, name), f"{name}.graph.cypher": cypher(model, name), f"{name}.mmd": flowchart(model, name), f"{name}.er.mmd": entity_relations(model, name),
        f"{name}.physical.er.mmd": physical(model, name), f"{name}.lineage.mmd": lineage(model, name), f"{name}.catalog.md": model_catalog(model, name), f"{name}.explorer.json": explorer(model, name), f"{name}.manual.md": manual(model, name),
    }
    return out | {f"{name}.okf/{k}": v for k, v in bundle(model).items()}


def write(model: Model, name: str, folder: str | Path) -> list[str]:
    out = project(model, name)
    for file, text in out.items():
        p = Path(folder) / file
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text, encoding="utf-8")
    return sorted(out)


def drifted(model: Model, name: str, folder: str | Path) -> list[str]:
    """Files that differ from what would be written now."""
    return sorted(f for f, text in project(model, name).items() if not (Path(folder) / f).is_file() or (Path(folder) / f).read_text(encoding="utf-8") != text)
