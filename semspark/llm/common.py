"""What the operators share: shared-folder stages, Arrow helpers, byte hashes, components."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id inside operators.
NO_ID = (1 << 63) - 1
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: One thread for each worker, one malloc arena that keeps what a task's arrays need and gives more back, no pool of Arrow's own:
#: idle workers stay small, busy ones don't fetch the same pages again and again.
WORKER_ENV = {"MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": str(64 << 20), "MALLOC_MMAP_THRESHOLD_": str(32 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system", "OPENBLAS_NUM_THREADS": "1", "TOKENIZERS_PARALLELISM": "false"}


def prepare(spark: SparkSession) -> None:
    """Workers find this package and give freed memory back, and Arrow batches stay small enough for long texts."""
    env = spark.sparkContext.environment
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or that the session has set. A folder of our own only where
    neither is so and driver and executors are one process; on a cluster that is an error, as other machines couldn't read it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="semspark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stage(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read again: later plans start there, whatever executor is lost.
    The files go when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/semspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str | None]:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def small(batch: pa.RecordBatch, n: int = 20_000) -> Iterator[pa.RecordBatch]:
    for at in range(0, batch.num_rows, n):
        yield batch.slice(at, n)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column's bytes end to end, and where its values begin and end; null: empty."""
    text = pa.types.is_string(column.type) or pa.types.is_large_string(column.type)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if text else b"")
    _, where, held = column.buffers()
    bounds = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if where else np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(held, np.uint8) if held else np.zeros(0, np.uint8), bounds


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, rows: int = 1 << 16) -> Iterator[dict[str, np.ndarray]]:
    """Batches of a partition sorted by key, regrouped to about so many rows, no key being spread over two; columns as
    numpy arrays."""
    held: list[dict[str, np.ndarray]] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append({x: batch.column(i).to_numpy(zero_copy_only=False) for i, x in enumerate(batch.schema.names)})
        n += batch.num_rows
        if n < rows or held[0][key][0] == held[-1][key][-1]:
            continue
        now = joined(held)
        cut = int(np.searchsorted(now[key], now[key][-1], side="left"))
        yield {x: v[:cut] for x, v in now.items()}
        held, n = [{x: v[cut:] for x, v in now.items()}], n - cut
    if held:
        yield joined(held)


def joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return parts[0] if len(parts) == 1 else {n: np.concatenate([p[n] for p in parts]) for n in parts[0]}


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on unsigned 64-bit values (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any stretch of bytes (or of other small numbers): polynomials modulo 2^64 over mixed values, base odd."""

    def __init__(self, base: int = 0x9E3779B97F4A7C15, values: int = 256) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.value = mix64(np.arange(values, dtype=np.uint64) + np.uint64(1000003))
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(n, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        """s with hash of data[a:b] = (s[b] - s[a]) * down[a]."""
        n = len(data)
        self.powers(n + 1)
        s = np.zeros(n + 1, np.uint64)
        np.cumsum(self.value[data] * self.up[:n], out=s[1:], dtype=np.uint64)
        return s

    def of(self, s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix64((s[b] - s[a]) * self.down[a])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """out[i] = min of x[i : i + width], for each i that has so many."""
    n, reach = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while 2 * reach <= width:
        x = np.minimum(x[: len(x) - reach], x[reach:])
        reach *= 2
    return np.minimum(x[:n], x[width - reach : width - reach + n])


def united(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The intervals of each owner, sorted, those that overlap or touch made one."""
    if not len(owner):
        return owner, start, stop
    order = np.lexsort((start, owner))
    owner, start, stop = owner[order], start[order], stop[order]
    first = np.r_[True, owner[1:] != owner[:-1]]
    # a running maximum within each owner: lift each owner's stops over those before
    rank = np.cumsum(first) - 1
    lift = rank * (int(stop.max()) + 1)
    high = np.maximum.accumulate(stop + lift) - lift
    new = first.copy()
    new[1:] |= start[1:] > high[:-1]
    at = np.flatnonzero(new)
    return owner[at], start[at], np.maximum.reduceat(high, at)


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids that have edges, and each one's smallest reachable id."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while len(u):
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        np.minimum.at(label, u, low)
        np.minimum.at(label, v, low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
        open_ = label[u] != label[v]
        if not open_.any():
            break
    return ids, ids[label]


#: Edges (16 bytes each) that one task finishes; more are first contracted by distributed rounds.
FINISH_EDGES = 1_000_000


def components(edges: DataFrame, finish_edges: int = FINISH_EDGES) -> DataFrame:
    """Connected components of edges (a, b: bigint; nulls and loops are left out, repeats are harmless).

    Returns (id, root) for each id in an edge, root being its component's smallest id. While the edges are more than
    finish_edges, each round lets every node point to its smallest neighbour, follows the pointers to their ends by
    doubling, and replaces the edges' ends by those; the graph shrinks by half at least. The rest goes to one task.
    """
    spark = edges.sparkSession
    prepare(spark)
    e = stage(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps: list[DataFrame] = []
    while e.count() > finish_edges:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = stage(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
        while True:
            q = p.select(F.col("id").alias("via"), F.col("root").alias("far"))
            p2 = stage(p.join(q, p.root == q.via).select("id", "root", "far"))
            moved = not p2.filter("root <> far").isEmpty()
            p = p2.select("id", F.col("far").alias("root"))
            if not moved:
                break
        steps.append(p)
        pa_, pb = p.select(F.col("id").alias("a"), F.col("root").alias("x")), p.select(F.col("id").alias("b"), F.col("root").alias("y"))
        e = stage(e.join(pa_, "a").join(pb, "b").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [pa.Table.from_batches([b]) for b in batches]
        if not parts:
            return
        t = pa.concat_tables(parts)
        ids, roots = least_labels(t["a"].to_numpy(), t["b"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(roots)], ["id", "root"])

    found = stage(e.coalesce(1).mapInArrow(finish, "id bigint, root bigint"))
    for p in reversed(steps):  # what had pointed to a contracted node now points to that node's root
        r = found.select(F.col("id").alias("root"), F.col("root").alias("far"))
        found = stage(p.join(r, "root", "left").select("id", F.coalesce("far", "root").alias("root")))
    return found


def numbered(docs: DataFrame) -> tuple[DataFrame, int, Callable[..., DataFrame]]:
    """docs (doc_id, text) as (did, text), did being different for every row and in the order of doc_id, nulls last; how many
    bytes the texts have; and what turns columns of dids back into doc_ids.

    Where ids are unique, and one at most is null, did is the id. Else did is the row's place in the order of id, text's
    hash and text, worked out by a distributed sort; rows that are alike in all three may take any of their places.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(NO_ID))
    seen = rows.groupBy(key.alias("did")).agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size"))
    size, most = seen.agg(F.sum("size"), F.max("n")).first()
    if (most or 0) <= 1:
        return rows.select(key.alias("did"), "text"), size or 0, lambda df, *names: df.withColumns({c: F.nullif(F.col(c), F.lit(NO_ID)) for c in names})
    salted = rows.select(key.alias("did"), "doc_id", F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("salt"), "text")
    placed = salted.repartitionByRange(partitions(spark), "did", "th", "salt").sortWithinPartitions("did", "th", "text", "salt")
    placed = stage(placed.select("doc_id", "text", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    counts = placed.groupBy(part.alias("part")).count().orderBy("part").collect()  # one row for each partition
    before = np.cumsum([0, *(r["count"] for r in counts)]).tolist()
    starts = spark.createDataFrame([(r["part"], b) for r, b in zip(counts, before, strict=False)], "part bigint, start bigint")
    one = placed.withColumn("part", part).join(F.broadcast(starts), "part").select((F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("did"), "doc_id", "text")

    def back(df: DataFrame, *names: str) -> DataFrame:
        for c in names:
            known = one.select(F.col("did").alias("_did"), F.col("doc_id").alias("_doc"))
            df = df.join(known, df[c] == F.col("_did"), "left").withColumn(c, F.col("_doc")).drop("_did", "_doc")
        return df

    return one.select("did", "text"), size, back


def aside(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, and the whole row in one column `_row`: an operator's own columns then clash with none."""
    return df.select(*names, F.struct(*df.columns).alias("_row"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


Query = Callable[[SparkSession, str], DataFrame]
