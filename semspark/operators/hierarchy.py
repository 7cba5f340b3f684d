"""Trees in parent columns: a node stands for its subtree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 100


def hierarchy_rollup(df: DataFrame, id_col: str, parent_col: str, root: object, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Ids of root and all its descendants, each once; empty if no row has that id.

    One lazy recursive query: nothing runs or is kept while it is built, and its plan doesn't grow with the depth. Each way
    down carries the ids on it and never enters one again, so cycles end; a node with two parents counts once. A
    hierarchy deeper than max_depth, or of more rows than spark.sql.cteRecursionRowLimit, is an error when it runs.
    """
    edges = df.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"))
    return df.sparkSession.sql(
        f"WITH RECURSIVE subtree(id, way) MAX RECURSION LEVEL {int(max_depth)} AS (SELECT DISTINCT id, array(id) FROM {{edges}} WHERE id = :root "
        "UNION ALL SELECT c.id, array_append(s.way, c.id) FROM {edges} c JOIN subtree s ON c.parent = s.id WHERE NOT array_contains(s.way, c.id)) SELECT DISTINCT id FROM subtree",
        args={"root": root},
        edges=edges,
    )


def hierarchy_sql(table: str, id_col: str, parent_col: str, max_depth: int = MAX_DEPTH) -> str:
    """The same as one recursive query for spark.sql(..., args={"root": ...}); identifiers are checked, the root is bound.
    It needs a tree: a cycle stops at the depth limit with an error."""
    for name in (*table.split("."), id_col, parent_col):
        if not name.isidentifier():
            raise ValueError(f"not an identifier: {name}")
    return (
        f"WITH RECURSIVE subtree(id) MAX RECURSION LEVEL {int(max_depth)} AS (SELECT {id_col} FROM {table} WHERE {id_col} = :root "
        f"UNION ALL SELECT c.{id_col} FROM {table} c JOIN subtree s ON c.{parent_col} = s.id) SELECT DISTINCT id FROM subtree"
    )


def in_subtree(fact: DataFrame, key: str, subtree: DataFrame) -> DataFrame:
    """Fact rows whose key lies in the subtree (a semi join: no row is multiplied)."""
    return fact.join(subtree.select(F.col("id").alias(key)), key, "left_semi")
