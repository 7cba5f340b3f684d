"""Findings, and a baseline of accepted ones."""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass
from pathlib import Path


@dataclass(frozen=True, order=True)
class Finding:
    severity: str  # ERROR | WARNING | INFO
    where: str
    check: str
    message: str


def failed(findings: Iterable[Finding]) -> bool:
    return any(f.severity == "ERROR" for f in findings)


def accept(findings: Iterable[Finding], path: str | Path) -> None:
    Path(path).write_text(json.dumps(sorted([f.where, f.check, f.message] for f in findings), indent=1) + "\n")


def unaccepted(findings: Iterable[Finding], path: str | Path) -> list[Finding]:
    p = Path(path)
    known = {tuple(x) for x in json.loads(p.read_text())} if p.is_file() else set()
    return [f for f in findings if (f.where, f.check, f.message) not in known]
