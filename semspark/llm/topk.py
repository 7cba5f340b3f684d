"""Exact top-k by inner product over integer vectors: columnar branch-and-bound.

1. Vectors are put in the order of a random-projection code and cut into blocks, so a block's vectors are alike. In a block
   they lie dimension by dimension. Each block's queries meet their own block first, which gives each query a floor: its
   k-th best score so far.
2. A block's vectors lie in a few balls. Two blocks meet only if the inner product of two of their balls' farthest points may
   reach the lowest floor of the one ball's queries; only for such pairs are vectors shuffled, and only such balls meet.
3. In a pair scores are summed up dimension block by dimension block, dimensions of most energy first; after each, what is
   left of a score is at most the product of the norms left (Cauchy-Schwarz), and a candidate that can reach no query's
   floor is compacted away.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semspark.llm.common import embeddings, prepare, stage

CANDIDATES, TOGETHER, DIMENSIONS = 4096, 32, 16
PLANES = 24
#: Balls of a block that splits evenly.
BALLS = 8
log = logging.getLogger(__name__)


def usable(v: Column) -> Column:
    """The vector isn't null and holds only finite numbers."""
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))


def best(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For queries (n, dims) and candidates (dims, m): query, candidate and score of each query's k best, of those that reach
    its floor, if floors are given."""
    return searched(q_ids, q, c_ids, c, k, floors)[0]


def searched(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, floors: np.ndarray | None = None) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], float]:
    """What best returns, and the share of all products of dimensions that was worked out."""
    dims, m = c.shape
    top_q, top_c = (max(1, int(np.abs(x).max(initial=0))) for x in (q, c))
    kind = np.float64 if max(1, dims) * top_q * top_c < 1 << 53 else np.int64
    first = np.argsort(-(c.astype(np.float64) ** 2).sum(axis=1), kind="stable")
    q, c = q[:, first].astype(kind), c[first].astype(kind)
    floors = np.full(len(q), -np.inf) if floors is None else floors
    cuts = list(range(0, dims, DIMENSIONS))
    left = lambda x, axis: [np.sqrt((x.take(range(at, dims), axis).astype(np.float64) ** 2).sum(axis=axis)) for at in [*cuts[1:], dims]]
    q_left, c_left = left(q, 1), left(c, 0)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    work = 0
    for at in range(0, len(q), TOGETHER):
        own, mine = q_ids[at : at + TOGETHER], slice(at, at + TOGETHER)
        floor = floors[mine]
        alive = np.arange(m)
        score = np.zeros((len(own), m), kind)
        for n, d in enumerate(cuts):
            score = score + q[mine, d : d + DIMENSIONS] @ c[d : d + DIMENSIONS, alive]
            work += len(own) * len(alive) * min(DIMENSIONS, dims - d)
            if d + DIMENSIONS >= dims or not len(alive):
                continue
            slack = q_left[n][mine][:, None] * c_left[n][alive][None, :] * (1 + 1e-9) + 1e-6
            if len(alive) > k and not np.isfinite(floor).all():  # a floor from the own block is good enough elsewhere
                low = np.where(c_ids[alive][None, :] == own[:, None], -np.inf, score - slack)
                floor = np.maximum(floor, np.partition(low, len(alive) - k, axis=1)[:, len(alive) - k])
            keep = (score + slack >= floor[:, None]).any(axis=0)
            if not keep.all():
                alive, score = alive[keep], score[:, keep]
        found = np.where(c_ids[alive][None, :] == own[:, None], np.iinfo(np.int64).min, score.astype(np.int64))
        some = found >= np.maximum(floors[mine], -(2.0**63))[:, None]
        if len(alive) > k:
            some &= found >= np.partition(found, len(alive) - k, axis=1)[:, len(alive) - k][:, None]
        some &= c_ids[alive][None, :] != own[:, None]
        i, j = np.nonzero(some)
        ids, value = c_ids[alive[j]], found[i, j]
        order = np.lexsort((ids, -value, i))
        i, ids, value = i[order], ids[order], value[order]
        few = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((own[i[few]], ids[few], value[few]))
    none = (np.zeros(0, np.int64),) * 3
    return (tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else none), work / max(1, len(q) * m * dims)  # type: ignore[return-value]


BLOCK = "block int, dims int, width int, ids binary, data binary, sizes binary, centres binary, radii binary, n_q int, q_ids binary, q_data binary, q_sizes binary, q_centres binary, q_radii binary, q_highs binary, floors binary, found binary"
KINDS = {2: np.int16, 4: np.int32, 8: np.int64}


def balls(x: np.ndarray, limit: int) -> list[np.ndarray]:
    """Indices of vectors (n, dims), parted into groups of near ones: a group is split between the vector farthest from its
    centre and the one farthest from that, while it has more than `limit` or both halves have less than half its radius."""
    away = lambda at, p: np.sqrt(((x[at] - p) ** 2).sum(axis=1))
    radius = lambda at: away(at, x[at].mean(axis=0)).max()
    out, todo = [], [np.arange(len(x))] if len(x) else []
    while todo:
        at = todo.pop()
        to_centre = away(at, x[at].mean(axis=0))
        to_a = away(at, x[at[to_centre.argmax()]])
        left = to_a <= away(at, x[at[to_a.argmax()]])
        if left.all() or not left.any():  # all alike
            left = np.arange(len(at)) < len(at) // 2
        halves = [at[left], at[~left]]
        if len(at) > limit or len(at) > 1 and to_centre.max() > 0 and max(map(radius, halves)) < to_centre.max() / 2:
            todo += halves
        else:
            out.append(at)
    return out


def measured(x: np.ndarray, groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre, radius and greatest norm of each group."""
    centres = np.array([x[g].mean(axis=0) for g in groups]).reshape(len(groups), x.shape[1])
    radii = np.array([np.sqrt(((x[g] - c) ** 2).sum(axis=1)).max() for g, c in zip(groups, centres, strict=True)])
    return centres, radii, np.array([np.sqrt((x[g] ** 2).sum(axis=1)).max() for g in groups])


def reaching(r: dict) -> np.ndarray:
    """For balls of queries and of candidates (rows, columns): whether any query of the one may reach its floor in the other."""
    one = lambda c: np.frombuffer(r[c], np.float64)
    radii, q_radii = one("radii"), one("q_radii")
    q, c = one("q_centres").reshape(len(q_radii), r["dims"]), one("centres").reshape(len(radii), r["dims"])
    most = q @ c.T + q_radii[:, None] * np.sqrt((c**2).sum(axis=1))[None, :] + one("q_highs")[:, None] * radii[None, :]
    sizes, floors = np.frombuffer(r["q_sizes"], np.int64), one("floors")
    least = np.minimum.reduceat(floors, np.cumsum(sizes) - sizes)
    return most + np.abs(most) * 1e-9 + 1e-6 >= least[:, None]


def blocks(rows: DataFrame, size: int, k: int, seed: int = 3) -> tuple[DataFrame, int]:
    """Blocks of rows (vec_id, q, asks), one for each number of dimensions in a partition, each with its own queries and what
    these find in it; and how many partitions."""
    n = max(1, -(-rows.count() // size))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = np.zeros(b.num_rows, np.int64)
            lists = b.column(1)
            size, flat = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy()
            start = np.cumsum(size) - size
            for d in np.unique(size).tolist():
                at = np.flatnonzero(size == d)
                m = flat[start[at][:, None] + np.arange(d)].astype(np.float64)
                planes = np.random.default_rng([seed, d]).standard_normal((d, PLANES))
                code[at] = ((m @ planes) > 0) @ (1 << np.arange(PLANES - 1, -1, -1, dtype=np.int64))
            yield b.append_column("dims", pa.array(size.astype(np.int32))).append_column("code", pa.array(code))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, vectors, asks = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            vectors += b.column(1).to_pylist()
            asks += b.column(2).to_pylist()
        by: dict[int, list[int]] = {}
        for i, r in enumerate(vectors):
            by.setdefault(len(r), []).append(i)
        for dims, at in by.items():
            m = np.array([vectors[i] for i in at], np.int64).reshape(len(at), dims)
            top = int(np.abs(m).max(initial=0))
            width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
            mine, ask = np.array([ids[i] for i in at], np.int64), np.array([bool(asks[i]) for i in at])
            q, q_ids = m[ask], mine[ask]
            who, which, score = best(q_ids, q, mine, np.ascontiguousarray(m.T), k)
            floors = np.full(len(q), -np.inf)
            for i, x in enumerate(q_ids.tolist()):
                own = score[who == x]
                if len(own) >= k:
                    floors[i] = np.sort(own)[-k]
            limit = max(32, size // BALLS)
            kind, x = KINDS[width], m.astype(np.float64)
            groups, q_groups = balls(x, limit), balls(x[ask], limit)
            order, q_order = np.concatenate(groups), np.concatenate(q_groups) if q_groups else np.zeros(0, np.int64)
            centres, radii, _ = measured(x, groups)
            q_centres, q_radii, q_highs = measured(x[ask], q_groups)
            sizes, q_sizes = (np.array([len(g) for g in gs], np.int64) for gs in (groups, q_groups))
            parts = [mine[order], np.ascontiguousarray(m[order].T.astype(kind)), sizes, centres, radii], [q_ids[q_order], q[q_order].astype(kind), q_sizes, q_centres, q_radii, q_highs, floors[q_order], np.stack([who, which, score])]
            cells = [TaskContext.get().partitionId(), dims, width, *(v.tobytes() for v in parts[0]), len(q), *(v.tobytes() for v in parts[1])]
            yield pa.RecordBatch.from_pylist([dict(zip(names, cells, strict=True))], schema)

    names = [x.split()[0] for x in BLOCK.split(", ")]
    kinds = {"int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in BLOCK.split(", ")])
    placed = rows.mapInArrow(coded, "vec_id bigint, q array<bigint>, asks boolean, dims int, code bigint")
    return stage(placed.repartitionByRange(n, "dims", "code", "vec_id").drop("dims", "code").mapInArrow(run, BLOCK)), n


def meetings(held: DataFrame, n: int) -> DataFrame:
    """(qb, cb, dims): pairs of different blocks of which a query may find something in the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [bool(reaching(r).any()) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok, pa.bool_())) for c in ("qb", "cb", "dims")], ["qb", "cb", "dims"])

    asking = held.filter("n_q > 0").select(F.col("block").alias("qb"), "dims", "q_sizes", "q_centres", "q_radii", "q_highs", "floors", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("cb"))
    asked = held.select(F.col("block").alias("cb"), "dims", "centres", "radii")
    return asking.filter("qb <> cb").join(asked, ["cb", "dims"]).mapInArrow(run, "qb int, cb int, dims int")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, size: int = CANDIDATES) -> DataFrame:
    """(query_id, rank, vec_id, score) over vectors (vec_id, q array<bigint>): each query's k highest inner products with
    every other row of as many dimensions, ties to the smaller vec_id; all, if there are fewer.

    Rows without id or vector take no part; an empty vector meets other empty ones with a score of 0. Rows alike in id and
    vector count once; an id with several vectors keeps them all, and none of them is a candidate of another. An empty
    table gives no row. Scores must fit 64 bits.
    """
    prepare(vectors.sparkSession)
    rows = vectors.filter("vec_id is not null and q is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), "q", is_query.alias("asks")).dropDuplicates(["vec_id", "q"])
    held, n = blocks(stage(rows), size, k)
    pairs = stage(meetings(held, n))
    log.info("%d pairs of %d blocks meet", pairs.count(), n)
    a = held.select(F.col("block").alias("qb"), "dims", F.col("width").alias("q_width"), "q_ids", "q_data", "q_sizes", "q_centres", "q_radii", "q_highs", "floors")
    b = held.select(F.col("block").alias("cb"), "dims", "width", "ids", "data", "sizes", "centres", "radii")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                q_ids, c_ids, sizes, q_sizes = (np.frombuffer(r[x], np.int64) for x in ("q_ids", "ids", "sizes", "q_sizes"))
                q = np.frombuffer(r["q_data"], KINDS[r["q_width"]]).reshape(len(q_ids), r["dims"]).astype(np.int64)
                c = np.frombuffer(r["data"], KINDS[r["width"]]).reshape(r["dims"], len(c_ids)).astype(np.int64)
                floors = np.frombuffer(r["floors"], np.float64)
                # balls of queries that reach the same balls are searched together
                reach = reaching(r)
                for pattern in np.unique(reach, axis=0):
                    if pattern.any():
                        mine = np.repeat((reach == pattern).all(axis=1), q_sizes)
                        some = np.repeat(pattern, sizes)
                        found = best(q_ids[mine], q[mine], c_ids[some], c[:, some], k, floors[mine])
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.frombuffer(cell, np.int64).reshape(3, -1)], ["query_id", "vec_id", "score"])

    result = "query_id bigint, vec_id bigint, score bigint"
    far = pairs.join(a, ["qb", "dims"]).join(b, ["cb", "dims"]).drop("qb", "cb").mapInArrow(run, result)
    found = far.unionByName(held.filter("n_q > 0").select("found").mapInArrow(own, result))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = embeddings(spark, sf_dir).filter(usable(F.col("embedding")))
    q = e.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 64)).alias("q"))
    return top_k(q, F.col("vec_id") % 20 == 0, 20)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
