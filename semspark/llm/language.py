"""Language identification by multilingual mixture inference.

Learned: for every language of the labelled rows, the counts of letter trigrams (with word edges), hashed to BUCKETS
values; all rows are counted, in one pass with partial sums. Predicted: a document is a mixture of languages; EM
estimates the proportions that make its trigrams likeliest. The languages that count are chosen by penalised
likelihood: nested sets by falling proportion, a further language having to gain PENALTY * ln(trigrams + 1) nats.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semspark.llm.common import documents, prepare, texts

BUCKETS = 1 << 15
PENALTY = 6.0
STEPS = 12
NONE = "und"


@functools.cache
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of each letter with its two neighbours; anything that is no letter counts as a word edge."""
    if not text:
        return np.zeros(0, np.int64)
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[c]
    c = np.where(is_letter, c, 0).astype(np.uint32)
    before, after = np.zeros_like(c), np.zeros_like(c)
    before[1:], after[:-1] = c[:-1], c[1:]
    at = np.flatnonzero(is_letter)
    h = (before[at] * np.uint32(0x9E3779B1)) ^ (c[at] * np.uint32(0x85EBCA77)) ^ (after[at] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(17)).astype(np.int64)


class Model:
    """Smoothed trigram probabilities, (BUCKETS, languages): a quarter of a megabyte a language, whatever the corpus. Tasks get it
    with their function, which PySpark broadcasts when it is large."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.langs = sorted(counts)
        if self.langs:
            n = np.stack([counts[x] for x in self.langs], axis=1).astype(np.float64) + 0.05
            self.p = (n / n.sum(axis=0)).astype(np.float32)
            self.log = np.log(self.p)

    def mixture(self, text: str | None) -> list[tuple[str, float]]:
        """Languages and their proportions, greatest first; empty if there is no letter or no language."""
        h = trigrams(text)
        if not len(h) or not self.langs:
            return []
        alone = self.log[h].sum(axis=0, dtype=np.float64)
        best = int(alone.argmax())
        if len(self.langs) == 1:
            return [(self.langs[0], 1.0)]
        p = self.p[h]
        need = PENALTY * np.log(len(h) + 1)
        w, top = self.em(p, np.full(len(self.langs), 1 / len(self.langs)))
        if top - alone[best] <= need:
            return [(self.langs[best], 1.0)]
        order = np.argsort(-w, kind="stable")
        chosen, value, weight = [best], alone[best], np.ones(1)
        for k in range(2, len(order) + 1):
            some = order[:k]
            v, ll = self.em(p[:, some], w[some] / w[some].sum())
            if ll - need * (k - 1) > value:
                chosen, value, weight = list(some), ll - need * (k - 1), v
        ranked = sorted(zip(weight, chosen, strict=True), key=lambda x: (-x[0], self.langs[x[1]]))
        return [(self.langs[i], float(min(1.0, x))) for x, i in ranked]

    @staticmethod
    def em(p: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, float]:
        w = w.astype(np.float32)
        for _ in range(STEPS):
            w = w * (p.T @ (1 / (p @ w))) / len(p)
        return w, float(np.log(p @ w).sum(dtype=np.float64))


def learn(labelled: DataFrame) -> Model:
    """From all rows of (text, lang) whose lang isn't null. What comes to the driver is at most BUCKETS numbers for each
    language, whatever the number of rows."""
    prepare(labelled.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for text, lang in zip(texts(b), texts(b, "lang"), strict=True):
                by.setdefault(lang, []).append(trigrams(text))
            for lang, found in by.items():
                n = np.bincount(np.concatenate(found), minlength=BUCKETS)
                sums[lang] = sums[lang] + n if lang in sums else n
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bucket", "n"])

    rows = labelled.filter("lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    found = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = {}
    for lang, g in found.groupby("lang"):
        counts[lang] = np.bincount(g["bucket"], weights=g["n"], minlength=BUCKETS)
    return Model(counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred string, score double, mixture string (language:proportion, greatest first) appended.

    Null, empty and letterless texts: `und`, 0, ''. So is every text if no language was learned. Columns of those names
    in docs give way; all others are kept, and so are repeated rows.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "mixture")
    schema = T.StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double").add("mixture", "string")
    at = docs.schema.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.mixture(t) for t in b.column(at).to_pylist()]
            new = [pa.array([f[0][0] if f else NONE for f in found], pa.string()), pa.array([f[0][1] if f else 0.0 for f in found], pa.float64()), pa.array([",".join(f"{x}:{y:.3f}" for x, y in f) for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=schema.names)

    return docs.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3, is 1; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame) -> Model:
    """Learned from the rows of documents that aren't held out; rows without id or lang teach nothing."""
    return learn(docs.filter(~held_out() & F.col("doc_id").isNotNull()).select("text", "lang"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string"))
    return predict(rows, fitted(docs)).drop("text")
