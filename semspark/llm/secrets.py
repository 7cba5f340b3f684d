"""Secret scan: three fixed patterns, and a token-efficiency test for other random strings.

The test: a run of 20 or more key characters that mixes letters with digits, and that a public tiktoken vocabulary
splits into pieces of fewer than RATIO characters on average, is random rather than a word. Digests (hex of the usual
lengths), UUIDs and plain numbers are no secrets; runs that touch a span already found are left to it.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semspark.llm.common import documents, prepare, texts

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}")
KINDS = ("assign", "access", "hex", "random")
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])")
DIGEST = re.compile(r"[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|sha(?:1|256|384|512)-[A-Za-z0-9+/_-]+={0,2}")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
RATIO = 2.1


@functools.cache
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_run(run: str, path: str, ratio: float) -> bool:
    if not MIXED.match(run) or DIGEST.fullmatch(run) or UUID.fullmatch(run):
        return False
    return len(run) < ratio * len(encoding(path).encode_ordinary(run))


def spans(text: str | None, path: str, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """(start, end, kind) in code points, by start, then kind."""
    if not text:
        return []
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    base = sorted(found, key=lambda s: (s[0], s[2]))
    runs = [(m.start(), m.end(), 3) for m in RUN.finditer(text) if random_run(m.group(), path, ratio)]
    begins, reach = [s for s, _, _ in base], [*accumulate((e for _, e, _ in base), max)]
    runs = [r for r in runs if not (n := bisect_left(begins, r[1])) or reach[n - 1] <= r[0]]
    return sorted(base + runs, key=lambda s: (s[0], s[2]))


SCHEMA = "doc_id bigint, starts array<int>, ends array<int>, kinds array<string>, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, base_sha256 string, spans string"


def scan(docs: DataFrame, vocabulary: str | None = None, ratio: float = RATIO) -> DataFrame:
    """One row per row of docs (doc_id, text): spans as arrays (code points, end exclusive) and as kind:start:end text,
    counts by kind, SHA-256 of the fixed patterns' spans. Null and empty texts have no span; a null id stays null;
    repeated rows are scanned each; other columns are ignored. vocabulary: a tiktoken file, there on every worker."""
    prepare(docs.sparkSession)
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = [spans(t, path, ratio) for t in texts(b)]
            named = [[f"{KINDS[k]}:{s}:{e}" for s, e, k in found] for found in every]
            base = [",".join(x for x, s in zip(n, f, strict=True) if s[2] < 3) for n, f in zip(named, every, strict=True)]
            counts = [[sum(s[2] == k for s in f) for f in every] for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([[s[0] for s in f] for f in every], pa.list_(pa.int32())), pa.array([[s[1] for s in f] for f in every], pa.list_(pa.int32())), pa.array([[KINDS[s[2]] for s in f] for f in every], pa.list_(pa.string())),
                 *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string()), pa.array([",".join(n) for n in named], pa.string())],
                names=["doc_id", "starts", "ends", "kinds", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")
