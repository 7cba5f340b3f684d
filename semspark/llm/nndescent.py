"""Embedding near-duplicates by NN-descent.

Vectors that are equal after scaling are one class with a multiplicity; all steps work on classes, so a vector that a third of
all rows have is one row.

1. A first neighbour graph: a few random-projection orders; in each, stretches of neighbours in the order are compared.
2. Rounds of NN-descent: at each vector its neighbours, and those that have it as a neighbour, are compared with each
   other, and every list keeps its best. A vector that very many have in their lists is split, by those, into groups that
   all hold its own neighbours, before any vector is sent there. Rounds end when few entries change.
3. Links at the threshold (less a margin for single precision) give coarse components. Lists of vectors in a component
   may be saturated, so each is enlarged to its whole component: blocks of near vectors of the component are compared with
   the blocks whose balls are near enough for a link, in double precision, which gives exact link counts and a spanning
   forest of links, whatever the component's size.
4. A saturated list may also lack links to other components. Saturated vectors of a component lie in balls of a centre and
   an angle; balls of two components that are near enough for a link are compared, and a link found joins the components.
5. An audit compares two bounded samples, of all vectors and of those that have links, with all others; below the recall
   asked for, rounds go on, and where they don't help the query fails. The figure is logged.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semspark.llm.common import components, embeddings, partitions, prepare, stage, whole_groups
from semspark.llm.topk import usable

LIST, JOINED, ORDERS, STRETCH, MEMBERS, BLOCK = 16, 8, 6, 512, 192, 512
MARGIN = 1e-3
SAMPLE, RECALL, ROUNDS = 512, 0.98, 6
LISTS = "id bigint, nbrs binary, sims binary"
#: Rows that a class's copies are spread over when they look up their class.
SALTS = 16

log = logging.getLogger(__name__)


def matrix(column: pa.Array | np.ndarray, kind: type) -> np.ndarray:
    cells = column.to_pylist() if isinstance(column, (pa.Array, pa.ChunkedArray)) else column
    return np.frombuffer(b"".join(cells), kind).reshape(len(cells), -1) if len(cells) else np.zeros((0, 0), kind)


def normalised(rows: DataFrame) -> DataFrame:
    """(id, dims, v32, v64) of (id, embedding) for vectors that can link: unit vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, dims, single, double = [], [], [], []
            for i, e in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v = np.array(e, np.float64)
                top = np.abs(v).max(initial=0)
                if not top:
                    continue
                v = v / top
                v /= np.sqrt(v @ v)
                ids.append(i)
                dims.append(len(v))
                single.append(v.astype(np.float32).tobytes())
                double.append(v.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(single, pa.binary()), pa.array(double, pa.binary())], ["id", "dims", "v32", "v64"])

    return rows.mapInArrow(run, "id bigint, dims int, v32 binary, v64 binary")


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal vectors as one: (id: the smallest, dims, v32, v64, mult); and (id, cid) for each vector that isn't alone. Copies are
    counted where they lie; they look up their class in SALTS places."""
    keyed = vectors.withColumn("digest", F.unhex(F.md5("v64")))
    one = stage(keyed.groupBy("digest").agg(F.min("id").alias("id"), F.first("dims").alias("dims"), F.first("v32").alias("v32"), F.first("v64").alias("v64"), F.count(F.lit(1)).alias("mult")))
    several = one.filter("mult > 1").select("digest", F.col("id").alias("cid"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    known = keyed.select("id", "digest", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")).join(several, ["digest", "salt"])
    return one.drop("digest"), stage(known.select("id", "cid"))


def nearest(ids: np.ndarray, m: np.ndarray, k: int) -> pa.RecordBatch:
    """Lists of each row's k most similar others in m."""
    s = m @ m.T
    same = ids[:, None] == ids[None, :]
    s[same] = -2
    k = min(k, len(ids) - 1)
    at = np.argpartition(-s, k - 1, axis=1)[:, :k]
    sims = np.take_along_axis(s, at, 1).astype(np.float32)
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x.tobytes() for x in ids[at]], pa.binary()), pa.array([x.tobytes() for x in sims], pa.binary())], ["id", "nbrs", "sims"])


def merged(lists: DataFrame, k: int) -> DataFrame:
    """One list of the k best for each id; `new` is how many of its entries the first kept list (old = true) had not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in whole_groups(batches, "id"):
            n = np.array([len(x) // 8 for x in g["nbrs"]])
            own = np.repeat(g["id"], n)
            nbr, sim = np.frombuffer(b"".join(g["nbrs"]), np.int64), np.frombuffer(b"".join(g["sims"]), np.float32)
            fresh = np.repeat(~g["old"].astype(bool), n)
            ok = (nbr != own) & (sim > -2)
            own, nbr, sim, fresh = own[ok], nbr[ok], sim[ok], fresh[ok]
            order = np.lexsort((fresh, nbr, own))
            own, nbr, sim, fresh = own[order], nbr[order], sim[order], fresh[order]
            first = np.r_[True, (own[1:] != own[:-1]) | (nbr[1:] != nbr[:-1])] if len(own) else np.zeros(0, bool)
            own, nbr, sim, fresh = own[first], nbr[first], sim[first], fresh[first]
            order = np.lexsort((nbr, -sim, own))
            own, nbr, sim, fresh = own[order], nbr[order], sim[order], fresh[order]
            few = np.arange(len(own)) - np.searchsorted(own, own) < k
            own, nbr, sim, fresh = own[few], nbr[few], sim[few], fresh[few]
            if not len(own):
                continue
            ids, start = np.unique(own, return_index=True)
            cut = [*start.tolist(), len(own)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array([nbr[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()), pa.array([sim[a:b].tobytes() for a, b in zip(cut, cut[1:], strict=False)], pa.binary()), pa.array(np.add.reduceat(fresh, start, dtype=np.int64))],
                ["id", "nbrs", "sims", "new"],
            )

    n = partitions(lists.sparkSession)
    return lists.repartition(n, "id").sortWithinPartitions("id").mapInArrow(run, LISTS + ", new bigint")


def compared(rows: DataFrame, size: int, k: int) -> DataFrame:
    """Lists from (part, id, dims, v32) sorted by part within partitions: stretches of up to `size` rows of one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                ids = np.array([x[1] for x in held], np.int64)
                yield nearest(ids, matrix([x[3] for x in held], np.float32), k)
            held.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (row[0] != held[0][0] or row[2] != held[0][2] or len(held) >= size):
                    yield from flush()
                held.append(row)
        yield from flush()

    return rows.mapInArrow(run, LISTS)


def first_graph(vectors: DataFrame, k: int, orders: int, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column(1).to_numpy()
            for d in np.unique(dims):
                part = b.filter(pa.array(dims == d))
                m, ids = matrix(part.column(2), np.float32), part.column(0).to_numpy()
                for o in range(orders):
                    planes = np.random.default_rng([seed, o, int(d)]).standard_normal((d, 25)).astype(np.float32)
                    p = m @ planes
                    sign = (p[:, :24] > 0) @ (1 << np.arange(23, -1, -1, dtype=np.int64))
                    fine = np.clip((p[:, 24] + 8) / 16 * (1 << 20), 0, (1 << 20) - 1).astype(np.int64)
                    salt = (ids * np.int64(0x9E3779B1) >> np.int64(7)) & np.int64((1 << 18) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), o, np.int32)), pa.array(sign << 38 | fine << 18 | salt), *(part.column(x) for x in range(3))], ["part", "place", "id", "dims", "v32"])

    n = partitions(vectors.sparkSession)
    rows = vectors.select("id", "dims", "v32").mapInArrow(run, "part int, place bigint, id bigint, dims int, v32 binary")
    rows = rows.repartitionByRange(n, "part", "dims", "place").sortWithinPartitions("part", "dims", "place")
    return compared(rows.select("part", "id", "dims", "v32"), STRETCH, k)


def round_of(lists: DataFrame, vectors: DataFrame, k: int, joined: int, members: int = MEMBERS) -> DataFrame:
    """Lists found at every vector among its best neighbours and those that have it among theirs."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nbrs = [x[: 8 * joined] for x in b.column(1).to_pylist()]
            own = np.repeat(b.column(0).to_numpy(), [len(x) // 8 for x in nbrs])
            to = np.frombuffer(b"".join(nbrs), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(to)], ["own", "hub"])

    n = partitions(lists.sparkSession)
    to = stage(lists.select("id", "nbrs").mapInArrow(edges, "own bigint, hub bigint"))
    # a hub with more in-neighbours than are compared at once is several groups, each with some of these and all of its own
    many = to.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > members).select("hub", F.ceil(F.col("n") / members).cast("int").alias("groups"))
    many = stage(many)
    inward = to.join(many, "hub", "left").withColumn("salt", F.when(F.col("groups").isNotNull(), F.pmod(F.xxhash64("own"), F.col("groups"))).otherwise(0).cast("int"))
    outward = to.select(F.col("own").alias("part"), F.col("hub").alias("id")).join(many.withColumnRenamed("hub", "part"), "part", "left")
    outward = outward.select("part", "id", F.explode(F.sequence(F.lit(0), F.coalesce("groups", F.lit(1)) - 1)).alias("salt"))
    pairs = inward.select(F.col("hub").alias("part"), F.col("own").alias("id"), "salt").unionByName(outward).distinct()
    rows = vectors.select("id", "dims", "v32").join(pairs, "id").select(F.xxhash64("part", "salt").alias("part"), "id", "dims", "v32")
    rows = rows.repartition(n, "part").sortWithinPartitions("part", "dims", F.xxhash64("id", "part"))
    return compared(rows, members + joined, k)


def spanning(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, row) of a forest that spans a symmetric link matrix."""
    left = np.arange(len(mask))
    a, b = [], []
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            hit = mask[np.ix_(frontier, left)]
            got = hit.any(axis=0)
            a.append(frontier[hit[:, got].argmax(axis=0)])
            b.append(left[got])
            frontier, left = left[got], left[~got]
    return (np.concatenate(a), np.concatenate(b)) if a else (left[:0], left[:0])


BLOCKS = "block bigint, root bigint, dims int, ids binary, mult binary, v64 binary, centre binary, radius double"


def blocked(members: DataFrame, vectors: DataFrame, seed: int = 17) -> DataFrame:
    """Members (id, root) with their vectors as blocks of up to BLOCK, each of one root and of near ones (neighbours in a
    random-projection order), with the ball that they lie in: centre, and greatest angle from it. Ranges are cut, so a
    component of any size is many blocks."""
    n, size = partitions(members.sparkSession), BLOCK

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, code = b.column(2).to_numpy(), np.zeros(b.num_rows, np.int64)
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                planes = np.random.default_rng([seed, d]).standard_normal((d, 24))
                code[at] = ((matrix(b.column(3).take(pa.array(at)), np.float64) @ planes) > 0) @ (1 << np.arange(23, -1, -1, dtype=np.int64))
            yield b.append_column("code", pa.array(code))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: list[tuple] = []
        count = TaskContext.get().partitionId() << 40

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal count
            if held:
                _, root, d, cells, mult = zip(*held, strict=True)
                m = matrix(list(cells), np.float64)
                c = m.mean(axis=0)
                c = c / np.linalg.norm(c) if np.linalg.norm(c) > 1e-6 else m[0]
                angle = float(np.arccos(np.clip(m @ c, -1, 1)).max())
                cells = [count, root[0], d[0], np.array([h[0] for h in held], np.int64).tobytes(), np.array(mult, np.int64).tobytes(), m.tobytes(), c.tobytes(), angle]
                yield pa.RecordBatch.from_pylist([dict(zip(names, cells, strict=True))], schema)
                count += 1
                held.clear()

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("id", "root", "dims", "v64", "mult")), strict=True):
                if held and (row[1:3] != held[0][1:3] or len(held) >= size):
                    yield from flush()
                held.append(row)
        yield from flush()

    names = [x.split()[0] for x in BLOCKS.split(", ")]
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in BLOCKS.split(", ")])
    weight = F.col("mult") if "mult" in vectors.columns else F.lit(1).cast("bigint")
    rows = members.join(vectors.select("id", "dims", "v64", weight.alias("mult")), "id").select("id", "root", "dims", "v64", "mult")
    rows = rows.mapInArrow(coded, "id bigint, root bigint, dims int, v64 binary, mult bigint, code bigint")
    rows = rows.repartitionByRange(n, "root", "dims", "code", "id").sortWithinPartitions("root", "dims", "code", "id")
    return stage(rows.mapInArrow(cut, BLOCKS))


def exact(members: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Over coarse components (id, root): rows (id, n, a, b), being counts of linked vectors of other classes, to be summed by id,
    and forest links. Blocks of a component are compared only if their balls are near enough for a link."""
    held, reach = blocked(members, vectors), float(np.arccos(threshold))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [np.arccos(np.clip(np.frombuffer(r["centre"], np.float64) @ np.frombuffer(r["other_centre"], np.float64), -1, 1)) <= r["radius"] + r["other_radius"] + reach + 1e-6 for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok, pa.bool_())) for c in ("block", "other")], ["block", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                one = "other_ids" not in r
                ids, mult = (np.frombuffer(r[c], np.int64) for c in ("ids", "mult"))
                m = np.frombuffer(r["v64"], np.float64).reshape(len(ids), -1)
                if one:
                    link = m @ m.T >= threshold
                    np.fill_diagonal(link, False)
                    n, (a, b) = link @ mult, spanning(link)
                    a, b = ids[a], ids[b]
                else:
                    ids2, mult2 = (np.frombuffer(r[c], np.int64) for c in ("other_ids", "other_mult"))
                    link = m @ np.frombuffer(r["other_v64"], np.float64).reshape(len(ids2), -1).T >= threshold
                    n = np.r_[link @ mult2, link.T @ mult]
                    whole = np.zeros((len(link) + len(ids2),) * 2, bool)
                    whole[: len(link), len(link) :], whole[len(link) :, : len(link)] = link, link.T
                    a, b = spanning(whole)
                    ids = np.r_[ids, ids2]
                    a, b = ids[a], ids[b]
                some = n > 0
                ids, n, none = ids[some], n[some], pa.nulls(len(a), pa.int64())
                wide = pa.nulls(len(ids), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(ids), none]), pa.concat_arrays([pa.array(n.astype(np.int64)), none]), pa.concat_arrays([wide, pa.array(a)]), pa.concat_arrays([wide, pa.array(b)])], ["id", "n", "a", "b"])

    ball = held.select("block", "root", "dims", "centre", "radius")
    other = ball.select(F.col("block").alias("other"), "root", "dims", F.col("centre").alias("other_centre"), F.col("radius").alias("other_radius"))
    pairs = stage(ball.join(other, ["root", "dims"]).filter("block < other").mapInArrow(near, "block bigint, other bigint"))
    data = held.select("block", "ids", "mult", "v64")
    far = data.select(*(F.col(c).alias("other" if c == "block" else f"other_{c}") for c in data.columns))
    result = "id bigint, n bigint, a bigint, b bigint"
    alone = held.filter(F.octet_length("ids") > 8).select("ids", "mult", "v64").mapInArrow(run, result)
    return alone.unionByName(pairs.join(data, "block").join(far, "other").drop("block", "other").mapInArrow(run, result))


def between(lists: DataFrame, coarse: DataFrame, vectors: DataFrame, threshold: float, k: int) -> DataFrame:
    """For saturated vectors of different components (id, root): a link (a, b) of each two balls that have one."""
    spark = lists.sparkSession
    n, reach = partitions(spark), float(np.arccos(threshold))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [len(x) == 4 * k and np.frombuffer(x, np.float32).min() >= threshold - MARGIN for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok, pa.bool_()))], ["id"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in whole_groups(batches, "part", 1 << 12):
            cut = np.flatnonzero(np.r_[True, (g["part"][1:] != g["part"][:-1]) | (g["dims"][1:] != g["dims"][:-1]), True])
            for s, e in zip(cut, cut[1:], strict=False):
                names, root, block, radius = (g[x][s:e] for x in ("ball", "root", "block", "radius"))
                c = matrix(g["centre"][s:e], np.float64)
                ok = np.arccos(np.clip(c @ c.T, -1, 1)) <= radius[:, None] + radius[None, :] + reach + 1e-6
                ok &= (root[:, None] != root[None, :]) & (names[:, None] < names[None, :])
                if g["i"][s] != g["j"][s]:
                    ok &= block[:, None] != block[None, :]
                x, y = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(names[x]), pa.array(names[y])], ["x", "y"])

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, ids2 = (np.frombuffer(r[c], np.int64) for c in ("ids", "other_ids"))
                link = np.frombuffer(r["v64"], np.float64).reshape(len(ids), -1) @ np.frombuffer(r["other_v64"], np.float64).reshape(len(ids2), -1).T >= threshold
                if link.any():
                    a, b = np.unravel_index(link.argmax(), link.shape)
                    yield pa.RecordBatch.from_arrays([pa.array([ids[a]]), pa.array([ids2[b]])], ["a", "b"])

    held = blocked(lists.select("id", "sims").mapInArrow(full, "id bigint").join(coarse, "id"), vectors)
    balls = held.select(F.col("block").alias("ball"), "root", "dims", "centre", "radius")
    blocks = -(-balls.count() // BLOCK)
    if not blocks:
        return spark.createDataFrame([], "a bigint, b bigint")
    rows = balls.withColumn("block", F.pmod(F.xxhash64("ball"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).withColumn("part", F.xxhash64("i", "j"))
    pairs = stage(rows.repartition(n, "part").sortWithinPartitions("part", "dims").mapInArrow(near, "x bigint, y bigint"))
    data = held.select(F.col("block").alias("x"), "ids", "v64")
    far = held.select(F.col("block").alias("y"), F.col("ids").alias("other_ids"), F.col("v64").alias("other_v64"))
    return stage(pairs.join(data, "x").join(far, "y").drop("x", "y").mapInArrow(linked, "a bigint, b bigint"))


def audit(vectors: DataFrame, counts: DataFrame, threshold: float, sample: int = SAMPLE) -> float:
    """Recall of the links of bounded samples, of all classes and of those that have links, held against all classes."""
    spread = vectors.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(sample).select("id", "v64")
    linked = vectors.join(counts.filter("n > 0").select("id"), "id", "left_semi").orderBy(F.xxhash64("id", F.lit(6)), "id").limit(sample).select("id", "v64")
    some = {r.id: r for r in [*spread.collect(), *linked.collect()]}
    by: dict[int, list] = {}
    for r in some.values():
        by.setdefault(len(r.v64), []).append(r)
    held = {d: (np.array([r.id for r in rs], np.int64), matrix([bytes(r.v64) for r in rs], np.float64)) for d, rs in by.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells, ids, mult = b.column(1).to_pylist(), b.column(0).to_numpy(), b.column(2).to_numpy()
            for d, (mine, m) in held.items():
                at = [i for i, x in enumerate(cells) if len(x) == d]
                if at:
                    link = (m @ matrix([cells[i] for i in at], np.float64).T >= threshold) & (mine[:, None] != ids[at][None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array((link @ mult[at]).astype(np.int64))], ["id", "true"])

    true = vectors.select("id", "v64", "mult").mapInArrow(run, "id bigint, true bigint").groupBy("id").agg(F.sum("true").alias("true"))
    r = true.join(counts, "id", "left").agg(F.sum("true").alias("t"), F.sum(F.least(F.coalesce("n", F.lit(0)), F.col("true"))).alias("f")).first()
    found = r.f / r.t if r.t else 1.0
    log.info("the audit of %d classes found %.4f of %d links", len(some), found, r.t or 0)
    return found


def near_duplicates(rows: DataFrame, threshold: float = 0.9, k: int = LIST, orders: int = ORDERS, rounds: int = 2, recall: float = RECALL, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for rows (vec_id, embedding).

    Null, zero, non-finite vectors and vectors with null components link with nothing; vectors of different dimensions
    don't link; rows that share a vec_id count once, with the smallest vector that can link; a null vec_id gives one
    row of its own that links with nothing; an empty table gives no row; other columns are ignored.
    """
    spark = rows.sparkSession
    prepare(spark)
    e = rows.select(F.col("vec_id").cast("bigint").alias("id"), F.when(usable(F.col("embedding")), F.col("embedding").cast("array<double>")).alias("e"))
    one = stage(e.groupBy("id").agg(F.min("e").alias("e")))
    vectors, copies = classes(stage(normalised(one.filter("id is not null and e is not null"))))
    lists = stage(merged(first_graph(vectors, k, orders, seed).withColumn("old", F.lit(False)), k))
    done = 0
    while True:
        for _ in range(rounds):
            found = round_of(lists, vectors, k, min(k, JOINED)).withColumn("old", F.lit(False))
            lists = stage(merged(lists.select("id", "nbrs", "sims", F.lit(True).alias("old")).unionByName(found), k))
            done += 1
            r = lists.agg(F.sum("new").alias("n"), F.count("*").alias("of")).first()
            if not r.n or r.n < 0.002 * r.of * k:
                break

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                sims = np.frombuffer(b"".join(b.column(2).to_pylist()), np.float32)
                nbrs = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
                own = np.repeat(b.column(0).to_numpy(), [len(x) // 8 for x in b.column(1).to_pylist()])
                ok = sims >= threshold - MARGIN
                yield pa.RecordBatch.from_arrays([pa.array(own[ok]), pa.array(nbrs[ok])], ["a", "b"])

        coarse = components(lists.select("id", "nbrs", "sims").mapInArrow(near, "a bigint, b bigint"))
        joined = between(lists, coarse, vectors, threshold, k)
        coarse = components(coarse.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(joined))
        dense = stage(exact(coarse, vectors, threshold))
        counts = stage(dense.filter("id is not null").groupBy("id").agg(F.sum("n").alias("n")))
        reached = audit(vectors, counts, threshold)
        if reached >= recall:
            break
        if done >= ROUNDS:
            raise RuntimeError(f"after {done} rounds the audit found {reached:.4f} of the links, and {recall} was asked for")
    final = components(dense.filter("a is not null").select("a", "b"))
    known = vectors.select(F.col("id").alias("cid"), "mult").join(counts.withColumnRenamed("id", "cid"), "cid", "left").join(final.withColumnRenamed("id", "cid"), "cid", "left")
    known = known.select("cid", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    # copies of a class look it up in SALTS places
    spread = known.join(copies.select("cid").distinct(), "cid", "left_semi").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = copies.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(spread, ["cid", "salt"]).select("id", "n_links", "root")
    alone = known.join(copies.select("cid").distinct(), "cid", "left_anti").select(F.col("cid").alias("id"), "n_links", "root")
    out = one.select("id").join(salted.unionByName(alone), "id", "left")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("root", "id").alias("component_id"), F.coalesce(F.coalesce("root", "id") == F.col("id"), F.lit(True)).alias("kept"))


def op8_nndescent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(embeddings(spark, sf_dir))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.e, b.e) / (a.n * b.n) >= 0.9),
r(id, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id AND r.root < l.b),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
