"""Surface words to codes: what a scope says first, then what any language says."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semspark.operators.ambiguity import Decision, ambiguity_gate


def folded(token: str) -> str:
    return " ".join(token.split()).casefold()


@dataclass(frozen=True)
class AliasTable:
    """code -> {multilingual: {language: [words]}, scope_relative: {scope: [words]}}, over a value set."""

    codes: tuple[str, ...]
    map: Mapping[str, Mapping] = field(default_factory=dict)
    labels: Mapping[str, str] = field(default_factory=dict)
    closed: bool = True

    def rows(self) -> list[tuple[str, str, str, str]]:
        """(tier, scope or language, word, code)."""
        out = []
        for code, tiers in self.map.items():
            for tier in ("scope_relative", "multilingual"):
                out += [(tier, k, folded(w), code) for k, ws in (tiers.get(tier) or {}).items() for w in ws]
        return out

    def alias_resolve(self, token: str, scope: str | None = None) -> Decision:
        """A code or its label is itself; else the words of the scope; else those of all languages. Several codes, or none
        in a closed set, ask; in an open set an unknown token stands for itself."""
        t = folded(token)
        own = [c for c in self.codes if folded(c) == t or folded(str(self.labels.get(c, c))) == t]
        scoped = [c for tier, k, w, c in self.rows() if tier == "scope_relative" and scope is not None and k == scope and w == t]
        common = [c for tier, _, w, c in self.rows() if tier == "multilingual" and w == t]
        for found in (own, scoped, common):
            if found:
                return ambiguity_gate(token, found)
        return Decision("ask", token, None, self.codes, "not in the closed set") if self.closed else Decision("resolve", token, token, (), "open set")

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), "tier string, scope string, word string, code string")

    def resolved(self, df: DataFrame, column: str, out: str, scope_column: str | None = None) -> DataFrame:
        """df with `out`: the code of each value of a column, by the same rules; null where it would have to be asked."""
        word = F.lower(F.trim(F.regexp_replace(F.col(column), r"\s+", " ")))
        as_map = lambda pairs: F.create_map(*(F.lit(x) for p in pairs for x in p)) if pairs else F.create_map().cast("map<string,string>")

        def unique(rows: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
            by: dict[str, set[str]] = {}
            for w, c in rows:
                by.setdefault(w, set()).add(c)
            return [(w, next(iter(cs))) for w, cs in by.items() if len(cs) == 1]

        own = unique([(folded(c), c) for c in self.codes] + [(folded(str(v)), k) for k, v in self.labels.items() if folded(str(v)) != folded(k)])
        scoped = unique([(f"{k}\x00{w}", c) for tier, k, w, c in self.rows() if tier == "scope_relative"])
        common = unique([(w, c) for tier, _, w, c in self.rows() if tier == "multilingual"])
        looks = [as_map(own)[word]]
        if scope_column:
            looks.append(as_map(scoped)[F.concat(F.col(scope_column), F.lit("\x00"), word)])
        looks.append(as_map(common)[word])
        if not self.closed:
            looks.append(F.col(column))
        return df.withColumn(out, F.coalesce(*looks))


def relation_alias_resolve(token: str, aliases: Mapping[str, Mapping[str, Sequence[str]]]) -> Decision:
    """A surface word to the one edge whose aliases (edge id -> language -> words) have it; else ask."""
    t = folded(token)
    return ambiguity_gate(token, [edge for edge, by in aliases.items() if any(folded(w) == t for ws in by.values() for w in ws)])
