"""Join paths over declared edges."""

from __future__ import annotations

from semspark.model.types import Edge, Model
from semspark.plans.intent import Ask, NotDerivable

Step = tuple[str, Edge, str]


def outward(model: Model, concept: str) -> list[Step]:
    """Edges that can be joined from a concept, and where they lead; only physical ones with a join rule."""
    out = []
    for e in model.edges.values():
        if e.level != "physical" or not e.clauses:
            continue
        if e.source == concept:
            out.append((concept, e, e.target))
        elif e.target == concept:
            out.append((concept, e, e.source))
    return out


def simple_paths(model: Model, start: str, goal: str, limit: int) -> list[list[Step]]:
    """All paths of at most `limit` edges that pass no concept twice."""
    found: list[list[Step]] = []
    stack: list[tuple[str, list[Step]]] = [(start, [])]
    while stack:
        at, path = stack.pop()
        if at == goal:
            found.append(path)
            continue
        if len(path) < limit:
            been = {start, *(s[2] for s in path)}
            stack += [(to, [*path, (at, e, to)]) for _, e, to in outward(model, at) if to not in been]
    return found


def reachable(model: Model, start: str) -> list[str]:
    seen, queue = [start], [start]
    while queue:
        for _, _, to in outward(model, queue.pop(0)):
            if to not in seen:
                seen.append(to)
                queue.append(to)
    return seen


def find_path(model: Model, start: str, goal: str, via: tuple[str, ...] = (), measure: str = "", limit: int = 8) -> list[Step] | Ask | NotDerivable:
    """The one shortest path on which every edge leads to one row at most and which passes all of via. Several shortest
    ones ask. Paths that multiply rows count only where no safe one exists."""
    if start == goal:
        return []
    paths = simple_paths(model, start, goal, limit)
    if not paths:
        return NotDerivable(measure, goal, tuple(reachable(model, start)), f"no declared edge leads from {start} to {goal}")
    passes = lambda p, v: any(v in (s[0], s[1].edge_id, s[2]) for s in p)
    safe = [p for p in paths if all(e.many_to_one(a) for a, e, _ in p)]
    paths = safe or paths
    for v in via:  # a named concept binds only the paths that could pass it
        some = [p for p in paths if passes(p, v)]
        paths = some or paths
    least = min(map(len, paths))
    best = [p for p in paths if len(p) == least]
    if len(best) > 1:
        return Ask(f"path from {start} to {goal}", tuple(" > ".join([start, *(s[2] for s in p)]) for p in sorted(best, key=str)), "several paths are equally short; name one by `via`")
    return best[0]
