"""Small tables for the operators: what every operator must survive, and brute-force versions."""

import random

DOC = "doc_id bigint, text string, lang string, source string, n_chars int"
#: Nulls in any column, empty, blank and long texts, repeated rows, rows that share an id, odd characters.
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one two three four five six", "en", None, 27), (4, "one two three four five six", "en", None, 27), (5, "one two three four five six", None, "b", 27),
    (None, "no id here, but text", "en", "b", 20), (None, None, None, None, None), (6, "é" * 5000 + " long word " + "x" * 70000, "fr", "c", 75000), (7, "漢字 и кириллица \U0001f600 don't we'll '' x's", "de", "c", 40), (8, "12345 !!! ###", "es", "c", 13), (9, "word " * 3000, "en", "a", 15000),
]


def documents(spark, rows=ODD, clash=True):
    """rows as documents, with further columns that are named like what operators use inside."""
    df = spark.createDataFrame(rows, DOC)
    if clash:
        for c in ("fp", "key", "id", "did", "size", "target", "whole", "rest", "cut", "_id", "_size", "_row", "_raw", "_new", "part", "kind", "score", "component_id", "n_pii"):
            df = df.selectExpr("*", f"'x' AS `{c}`")
    return df


def written(spark, tmp_path, rows, clash=False, parts=3):
    documents(spark, rows, clash).repartition(parts).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def prose(seed, n, words=(5, 120), vocabulary=2000):
    r = random.Random(seed)
    voc = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 8))) for _ in range(vocabulary)]
    return [[r.choice(voc) for _ in range(r.randint(*words))] for _ in range(n)], voc, r
