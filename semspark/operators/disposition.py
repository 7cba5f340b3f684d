"""Known impurities of served data: what is done about rows that may not belong."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semspark.plans.intent import NotDerivable


@dataclass(frozen=True)
class Impurity:
    """Rows that a condition marks, and how they are disposed of.

    bake: the condition tells them surely, so they go. register: it tells some of them surely (`sure`), which go; the others
    stay, and the figure carries a caveat. block: nobody can tell yet, so what touches them isn't answered.
    """

    name: str
    marks: Column
    disposition: str
    sure: Column | None = None
    note: str = ""


@dataclass(frozen=True)
class Disposed:
    """Clean rows; those that are in doubt among them, by impurity; and what to tell."""

    df: DataFrame
    doubtful: dict[str, Column]
    caveats: tuple[str, ...]

    def counted(self) -> DataFrame:
        """One row: n, and for each registered impurity how many of them are in doubt."""
        return self.df.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(c, 1)).alias(k) for k, c in self.doubtful.items()))


def dispose(df: DataFrame, impurities: Sequence[Impurity]) -> Disposed | NotDerivable:
    """A null condition marks no row."""
    doubtful, caveats = {}, []
    for x in impurities:
        if x.disposition not in ("bake", "register", "block"):
            raise ValueError(f"unknown disposition {x.disposition}")
        if x.disposition == "block":
            return NotDerivable(x.name, x.name, (), f"{x.name} isn't settled{': ' + x.note if x.note else ''}; someone who knows the data must say")
        marked = F.coalesce(x.marks, F.lit(False))
        if x.disposition == "bake":
            df = df.filter(~marked)
            continue
        if x.sure is not None:
            df = df.filter(~(marked & F.coalesce(x.sure, F.lit(False))))
        doubtful[x.name] = marked
        caveats.append(f"rows marked {x.name} are included{': ' + x.note if x.note else ''}")
    return Disposed(df, doubtful, tuple(caveats))
