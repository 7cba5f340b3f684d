"""Fuzzy substring dedup: collinear chaining of shared word seeds.

Documents are dealt into blocks of some megabytes, which stay where they are in one exchange that every step reads.

1. Seeds: of each stretch of WINDOW successive shingles of SEED words the one with the smallest hash, and likewise, further
   apart, shingles of LONG words. A block sends of each seed all places, if they are few, else its first place and its
   least places in two hashed orders. Where the seeds of all blocks meet, a rare seed's partners are all its places, a
   frequent one's its first place and its least ones. They go back to the blocks. So a seed in a third of all documents
   costs a few rows for each block, never a pair for each two places, and what is found doesn't depend on the blocks.
   The long seeds are for passages that are put together from several earlier ones: whatever repeats LONG_RUN words
   meets an earlier place that has LONG of them in one piece.
   What else frequent seeds have in common is found by stretches: two seeds at most REACH words apart, one of both frequent,
   with the words between. Each two different stretches with the same ends are paired, however many there are; the first of
   those that are alike word for word stands for all. Two documents whose seeds lie in one passage of the later one need
   no more: what they give would lie in it too.
2. Chains: the matches of a document with another are chained by word order in both, a Fenwick tree giving the best chain
   so far; each skipped word costs GAP.
3. Alignment: the other document's words come from its block, one request for each block. A chain is aligned from seed to
   seed by edit distance over words, and extended while words agree. Passages of enough words that are similar enough
   are returned; a stretch that isn't is split at its costliest gap, and both parts are tried.
4. Of each document's passages those that lie within another one are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semspark.llm.common import Rolling, documents, mix64, numbered, partitions, prepare, sliding_min, small, text_bytes, united, whole_groups

SEED, WINDOW = 4, 8
LONG, LONG_WINDOW = 32, 16
#: Every repetition of so many words holds a long seed.
LONG_RUN = LONG + LONG_WINDOW - 1
#: A seed is worth SEED words; a chain pays GAP for each word that it skips and ends where that costs more than it has.
GAP = 0.1
LEAST_CHAIN = 12
MIN_WORDS, SIMILARITY = 40, 0.8
#: Seeds of up to so many places are matched place by place.
RARE = 4
#: Words beyond a chain that its alignment may look at; a run of SEED + WINDOW - 1 words that agree holds a seed.
MARGIN = 64
#: Stretches that are by so much less similar along their chain are aligned once more, freely.
CLOSE = 0.05
#: Seeds up to so many words apart are ends of a stretch.
REACH = MIN_WORDS
#: Of a seed that repeats itself within its own words one place for each so many words is an end of stretches.
STRIDE = 16
#: Pairs of stretches that are made at once.
PAIRS = 1 << 20
BLOCK = 2 << 20
#: Bytes of texts that a task holds before it deals them to blocks.
PACK = 32 << 20
#: Parts of the seeds in each partition, which are matched one after the other.
PARTS = 4
BASE = 0x9E3779B97F4A7C15

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FOLDED = mix64(np.arange(256, dtype=np.uint64) + np.uint64(31337))[_LOWER]


def word_places(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the words of texts that lie end to end and begin at bounds."""
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.r_[False, word[:-1]]
    after = np.r_[word[1:], False]
    return np.flatnonzero(word & (~before | edge[:-1])), np.flatnonzero(word & (~after | edge[1:])) + 1


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts that lie end to end: begin, end, and 64-bit hash, A-Z lower-cased."""
    begin, end = word_places(data, bounds)
    # the odd base's powers are taken within words, so long blocks need no long tables
    size = end - begin
    step = np.uint64(BASE)
    # longest words first: those that have one more letter come before the others
    least = np.minimum(size, 64).astype(np.uint8)
    order = np.argsort(np.uint8(64) - least, kind="stable")
    left = np.cumsum(np.bincount(least, minlength=65)[::-1])[::-1]  # how many words have so many letters, or more
    at = begin[order]
    sorted_ = np.zeros(len(begin), np.uint64)
    for k in range(64):
        n = int(left[k + 1])
        if not n:
            break
        sorted_[:n] *= step
        sorted_[:n] += _FOLDED[data[at[:n] + k]]
    h = np.empty_like(sorted_)
    h[order] = sorted_
    for i in np.flatnonzero(size > 64).tolist():
        for part in range(64, int(size[i]), 4096):
            x = _FOLDED[data[begin[i] + part : min(end[i], begin[i] + part + 4096)]]
            h[i] = mix64((h[i : i + 1] ^ np.bitwise_xor.reduce(mix64(x + np.arange(len(x), dtype=np.uint64) * step))))[0]
    return begin, end, mix64(h + size.astype(np.uint64))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """The hash of each n successive words; polynomials of doubled widths."""
    if len(h) < n:
        return h[:0]
    width, out = 1, h
    for bit in bin(n)[3:]:
        out = out[:-width] * np.uint64(pow(BASE, width, 1 << 64)) + out[width:]
        width *= 2
        if bit == "1":
            out = out[:-1] * np.uint64(BASE) + h[width:]
            width += 1
    return mix64(out + np.uint64(n))


def packed(rows: DataFrame) -> DataFrame:
    """Rows (block, did, text) as one compressed cell for each block in each PACK bytes of a partition: (block, n, size, cell)."""

    def cells(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        block = table.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        did = table.column("did").to_numpy()[order]
        data, bounds = text_bytes(pa.concat_arrays(table.column("text").chunks))
        data = data.tobytes()
        block, low, high = block[order], bounds[:-1][order].tolist(), bounds[1:][order].tolist()
        edge = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True])
        size, out = [], []
        for s, e in zip(edge.tolist(), edge[1:].tolist(), strict=False):
            lengths = np.array(high[s:e], np.int64) - np.array(low[s:e], np.int64)
            cell = b"".join([did[s:e].tobytes(), lengths.tobytes(), *(data[a:z] for a, z in zip(low[s:e], high[s:e], strict=True))])
            size.append(len(cell))
            out.append(pa.compress(cell, codec="zstd", asbytes=True))
        return pa.RecordBatch.from_arrays([pa.array(block[edge[:-1]], pa.int32()), pa.array(np.diff(edge), pa.int32()), pa.array(size, pa.int64()), pa.array(out, pa.binary())], ["block", "n", "size", "cell"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= PACK:
                yield from small(cells(held), 200)
                held, size = [], 0
        if held:
            yield from small(cells(held), 200)

    return rows.select("block", "did", "text").mapInArrow(run, "block int, n int, size bigint, cell binary")


def unpacked(table: pa.Table) -> pa.Table:
    """The documents (did, text) of packed rows."""
    out = []
    for n, size, cell in zip(*(table.column(c).to_pylist() for c in ("n", "size", "cell")), strict=True):
        cell = pa.decompress(cell, decompressed_size=size, codec="zstd")
        did, lengths = (np.frombuffer(cell, np.int64, n, 8 * n * k) for k in (0, 1))
        bounds = np.r_[0, np.cumsum(lengths)]
        text = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds), cell.slice(16 * n)])
        out.append(pa.table([pa.array(did), text], ["did", "text"]))
    return pa.concat_tables(out)


class Words:
    """The words of a block's documents, by document."""

    def __init__(self, table: pa.Table) -> None:
        did = table.column("did").to_numpy()
        order = np.argsort(did)
        self.did = did[order]
        table = table.select(["text"]).take(pa.array(order)).combine_chunks()
        self.data, self.bounds = text_bytes(table.column("text").chunk(0)) if len(did) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
        self.data = self.data[self.bounds[0] : self.bounds[-1]]
        self.bounds = self.bounds - self.bounds[0]

    def places(self) -> None:
        self.begin, self.end = word_places(self.data, self.bounds)
        self.index()

    def hashes(self) -> None:
        self.begin, self.end, self.hash = word_hashes(self.data, self.bounds)
        self.index()

    def index(self) -> None:
        #: a document's words are those from first[i] to first[i + 1]
        self.first = np.searchsorted(self.begin, self.bounds)

    def sampled(self, seed: int, window: int, ends: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Places of the smallest shingle of each window, the first if tied, and their hashes. A document of fewer
        shingles than a window has one window. With ends, also each document's first and last shingle."""
        s = shingles(self.hash, seed)
        none = np.uint64(0xFFFFFFFFFFFFFFFF)
        if not len(s):
            return np.zeros(0, np.int64), s
        i = np.arange(len(s))
        own = np.repeat(np.arange(len(self.did)), np.diff(self.first))[: len(s)]
        last = self.first[own + 1] - seed  # a document's last shingle
        ok = i <= last
        index = np.uint64(0xFFFFFFFF)
        keyed = np.where(ok, s & ~index | i.astype(np.uint64), none)
        low = sliding_min(np.r_[keyed, np.full(window, none)], window)[: len(s)]
        use = ok & (i <= np.maximum(self.first[own], last - window + 1))
        mark = np.zeros(len(s), bool)
        mark[(low[use] & index).astype(np.int64)] = True
        if ends:
            mark |= ok & ((i == self.first[own]) | (i == last))
        at = np.flatnonzero(mark)
        return at, s[at]

    def seeds(self, seed: int, window: int, long: int, long_window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Key, document's index, word and width of all seeds, sorted by key, document and word."""
        a, ka = self.sampled(seed, window, ends=True)
        b, kb = self.sampled(long, long_window)
        at, key = np.r_[a, b], np.r_[ka, mix64(kb)]
        width = np.r_[np.full(len(a), seed), np.full(len(b), long)]
        own = np.searchsorted(self.first, at, side="right") - 1
        order = np.argsort(key, kind="stable")
        at, key, width, own = at[order], key[order], width[order], own[order]
        return key, own, at - self.first[own], width


def planes(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte by byte of all their values, which compresses well."""
    return b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() for x in columns)


def columns(cell: bytes, n: int, *kinds: type) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.frombuffer(cell, np.uint8, size * n, at).reshape(size, n).T.copy().view(kind).ravel())
        at += size * n
    return out


def keyed(key: np.ndarray) -> np.ndarray:
    return np.diff(key, prepend=np.uint64(0))


def chosen(key: np.ndarray, did: np.ndarray, word: np.ndarray, total: np.ndarray, rare: int) -> np.ndarray:
    """Of places sorted by key, did and word, with the number of places of each key: all of a rare key, else the first and
    the least in two hashed orders."""
    few = total <= rare
    out = few.copy()
    many = np.flatnonzero(~few)
    if not len(many):
        return out
    out[many[np.r_[True, key[many][1:] != key[many][:-1]]]] = True
    for salt in (1, 2):
        h = mix64(did[many].astype(np.uint64) * np.uint64(4) + np.uint64(salt))
        order = many[np.lexsort((word[many], h, key[many]))]
        out[order[np.r_[True, key[order][1:] != key[order][:-1]]]] = True
    return out


SOWN = "part int, block int, n int, cell binary"


def sown(texts: DataFrame, seed: int, window: int, long: int, long_window: int, rare: int) -> DataFrame:
    """Of each block the places of its seeds that others may be matched with."""
    parts = PARTS * partitions(texts.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        x = Words(unpacked(table))
        x.hashes()
        key, own, word, _ = x.seeds(seed, window, long, long_window)
        did = x.did[own]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.r_[start, len(key)])
        use = chosen(key, did, word, np.repeat(size, size), rare)
        count = np.zeros(len(key), np.uint8)
        count[start] = np.minimum(size, 255)  # with a key's first place, how many it has here
        key, did, word, count = key[use], did[use], word[use].astype(np.uint32), count[use]
        part = (key % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        has = np.flatnonzero(np.diff(cut))
        cells = []
        for p in has.tolist():
            i = order[cut[p] : cut[p + 1]]
            cells.append(planes(keyed(key[i]), did[i], word[i], count[i]))
        return pa.table([pa.array(has.astype(np.int32)), pa.array(np.full(len(has), table.column("block")[0].as_py(), np.int32)), pa.array(np.diff(cut)[has].astype(np.int32)), pa.array(cells, pa.binary())], ["part", "block", "n", "cell"])

    return texts.groupBy("block").applyInArrow(run, SOWN)


def partners(found: DataFrame, rare: int) -> DataFrame:
    """(block, n, cell): for each block the partners of its seeds that have others than itself: key, did, word, and whether
    these are all places of the key."""
    n = partitions(found.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in whole_groups(batches, "part", 1):
            cut = np.flatnonzero(np.r_[True, g["part"][1:] != g["part"][:-1], True])
            for s, e in zip(cut, cut[1:], strict=False):
                got = [columns(c, k, np.uint64, np.int64, np.uint32, np.uint8) for c, k in zip(g["cell"][s:e], g["n"][s:e].tolist(), strict=True)]
                key = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in got])
                did, word, count = (np.concatenate([x[k] for x in got]) for k in (1, 2, 3))
                block = np.repeat(g["block"][s:e], g["n"][s:e])
                order = np.argsort(key)
                held = key[order]
                start = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
                size = np.diff(np.r_[start, len(held)])
                total = np.repeat(np.add.reduceat(count[order], start, dtype=np.int64), size)
                several = total > 1
                if not several.any():
                    continue
                group, total, order = np.repeat(np.arange(len(start)), size)[several], total[several], order[several]
                order = order[np.lexsort((word[order], did[order], group))]  # group and total stay: they are alike in a group
                key, did, word, block = (x[order] for x in (key, did, word, block))
                use = chosen(key, did, word, total, rare)
                # each block that has the key gets each of the partners
                asks = np.unique(group << 32 | block)
                asked, to = asks >> 32, (asks & 0xFFFFFFFF).astype(np.int32)
                i = np.flatnonzero(use)
                low, high = np.searchsorted(group[i], asked), np.searchsorted(group[i], asked, side="right")
                who = np.repeat(np.arange(len(asked)), high - low)
                at = i[np.arange(len(who)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[who]]
                to = to[who]
                order = np.argsort(to, kind="stable")
                to, at = to[order], at[order]
                edge = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True])
                cells = []
                for a, z in zip(edge.tolist(), edge[1:].tolist(), strict=False):
                    k = at[a:z]
                    cells.append(planes(keyed(key[k]), did[k], word[k], (total[k] <= rare).view(np.uint8)))
                yield from small(pa.RecordBatch.from_arrays([pa.array(to[edge[:-1]]), pa.array(np.diff(edge).astype(np.int32)), pa.array(cells, pa.binary())], ["block", "n", "cell"]), 500)

    return found.repartitionById(n, F.col("part")).sortWithinPartitions("part").mapInArrow(run, "block int, n int, cell binary")


def chains(x: np.ndarray, y: np.ndarray, worth: float, gap: float, least: int = 0) -> list[np.ndarray]:
    """Index arrays of collinear chains over matches (x, y), best first; each match is in one at most. Those whose ends are
    fewer than least words apart, in x or in y, are left out.

    score[i] = worth + max(0, score[j] - gap * (words skipped)) over j before i in x and in y. As the skipped words are
    those between j and i in x and in y, halved, the best j has the greatest score[j] + gap * (x + y) / 2: a prefix
    maximum over y, kept in a Fenwick tree.
    """
    order = np.lexsort((y, x))
    xs, ys = x[order], y[order]
    dx, dy = xs[1:] - xs[:-1], ys[1:] - ys[:-1]
    if len(xs) > 1 and (dx > 0).all() and (dx == dy).all():  # one diagonal
        cost = dx
        return [order[a] for a in np.split(np.arange(len(xs)), np.flatnonzero(gap * cost > worth * 4) + 1)]
    score, back = [0.0] * len(xs), [-1] * len(xs)
    xl, yl = xs.tolist(), ys.tolist()
    if rising := bool((dx > 0).all() and (dy > 0).all()):  # the best j is always the last one
        gain = 0.0
        for i in range(len(xl)):
            if i:
                gain = score[i - 1] + gap * (xl[i - 1] + yl[i - 1]) / 2 - gap * (xl[i] + yl[i]) / 2
            score[i], back[i] = (worth + gain, i - 1) if gain > 0 else (worth, -1)
    rank = [] if rising else np.searchsorted(np.unique(ys), ys) + 1
    n = 0 if rising else int(rank.max())
    tree: list[tuple[float, int]] = [(-1e300, -1)] * (n + 1)
    rl = [] if rising else rank.tolist()
    waiting: list[int] = []
    for i in range(len(rl)):
        if waiting and xl[waiting[0]] != xl[i]:  # matches at the same word don't follow each other
            for j in waiting:
                v, r = (score[j] + gap * (xl[j] + yl[j]) / 2, j), rl[j]
                while r <= n:
                    if tree[r] < v:
                        tree[r] = v
                    r += r & -r
            waiting = []
        best, r = (-1e300, -1), rl[i] - 1
        while r > 0:
            if tree[r] > best:
                best = tree[r]
            r -= r & -r
        gain = best[0] - gap * (xl[i] + yl[i]) / 2
        score[i], back[i] = (worth + gain, best[1]) if best[1] >= 0 and gain > 0 else (worth, -1)
        waiting.append(i)
    used = [False] * len(xl)
    out = []
    for i in sorted(range(len(xl)), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(i)
            i = back[i]
        if chain and min(xl[chain[0]] - xl[chain[-1]], yl[chain[0]] - yl[chain[-1]]) >= least:
            out.append(order[chain[::-1]])
    return out


def matches(x: Words, seeds: tuple[np.ndarray, ...], got: list[np.ndarray], seed: int) -> tuple[np.ndarray, ...]:
    """(document's index, other did, word, other word) of a block's seeds with their partners, sorted, without repeats. Of a
    pair whose seeds are all rare only the later document's block returns matches."""
    key, own, word, width = seeds
    pk, pd, pw, rare = got
    low, high = np.searchsorted(key, pk), np.searchsorted(key, pk, side="right")
    who = np.repeat(np.arange(len(pk)), high - low)
    at = np.arange(len(who)) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[who]
    doc, other, a, b, rare, width = own[at], pd[who], word[at], pw[who].astype(np.int64), rare[who], width[at]
    # a long seed is as good as its first and its last short one
    tail = width > seed
    doc, other, rare = np.r_[doc, doc[tail]], np.r_[other, other[tail]], np.r_[rare, rare[tail]]
    shift = width[tail] - seed
    a, b = np.r_[a, a[tail] + shift], np.r_[b, b[tail] + shift]
    did = x.did[doc]
    ok = (did != other) | (b < a)
    doc, other, a, b, rare, did = (v[ok] for v in (doc, other, a, b, rare, did))
    order = np.lexsort((rare, b, a, other, doc))
    doc, other, a, b, rare, did = (v[order] for v in (doc, other, a, b, rare, did))
    if not len(doc):
        return doc, other, a, b
    first = np.r_[True, (doc[1:] != doc[:-1]) | (other[1:] != other[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    doc, other, a, b, rare, did = (v[first] for v in (doc, other, a, b, rare, did))
    start = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (other[1:] != other[:-1])])
    size = np.diff(np.r_[start, len(doc)])
    span = np.minimum(np.maximum.reduceat(a, start) - np.minimum.reduceat(a, start), np.maximum.reduceat(b, start) - np.minimum.reduceat(b, start)) + seed
    use = (span >= LEAST_CHAIN) & ((other[start] <= did[start]) | ~np.minimum.reduceat(rare, start).astype(bool))
    use = np.repeat(use, size)
    return doc[use], other[use], a[use], b[use]


def stretches(x: Words, seeds: tuple[np.ndarray, ...], got: list[np.ndarray], seed: int) -> tuple[np.ndarray, ...]:
    """(key, hash of the words, did, word, words from seed to seed) of a block's stretches: from one short seed that others
    have to another one up to REACH words on, at least one of both being frequent. The upper half of a key is its first seed's.
    Sorted by key and hash; of those that are alike the first."""
    key, own, word, width = seeds
    pk, rare = got[0], got[3].astype(bool)
    met = np.searchsorted(pk, key)
    met = np.minimum(met, len(pk) - 1)
    use = np.flatnonzero((width == seed) & (pk[met] == key))
    use = use[np.lexsort((word[use], own[use]))]
    key, own, word, many = key[use], own[use], word[use], ~rare[met[use]]
    # a seed that overlaps or touches itself repeats a few words: its first and last place are kept, and some between
    again = np.r_[False, (key[1:] == key[:-1]) & (own[1:] == own[:-1]) & (word[1:] - word[:-1] <= seed)]
    begin = np.maximum.accumulate(np.where(again, 0, np.arange(len(key))))
    step = (word - word[begin]) // STRIDE
    inner = again & np.r_[again[1:], False] & np.r_[False, step[1:] == step[:-1]]
    key, own, word, many = (v[~inner] for v in (key, own, word, many))
    first, last = [], []
    for s in range(1, min(REACH, len(key) - 1) + 1):
        i = np.flatnonzero((own[s:] == own[:-s]) & (word[s:] - word[:-s] <= REACH))
        if not len(i):
            break
        i = i[many[i] | many[i + s]]
        first.append(i)
        last.append(i + s)
    none = np.zeros(0, np.int64)
    i, j = (np.concatenate(v) if v else none for v in (first, last))
    roll = Rolling()
    roll.powers(len(x.hash) + 1)
    sums = np.zeros(len(x.hash) + 1, np.uint64)
    np.cumsum(x.hash * roll.up[: len(x.hash)], out=sums[1:], dtype=np.uint64)
    at = x.first[own] + word
    text = roll.of(sums, at[i], at[j] + seed)
    half = np.uint64(32)
    pair = mix64(key)[i] >> half << half | mix64(key ^ np.uint64(BASE))[j] >> half
    did, word, gap = x.did[own[i]], word[i], (word[j] - word[i]).astype(np.uint8)
    order = np.lexsort((word, did, text, pair))
    order = order[np.r_[True, (pair[order][1:] != pair[order][:-1]) | (text[order][1:] != text[order][:-1])]] if len(order) else order
    return tuple(v[order] for v in (pair, text, did, word.astype(np.uint32), gap))


STRETCH_KINDS = (np.uint64, np.uint64, np.int64, np.uint32, np.uint8)
PAIR_KINDS = (np.int64, np.int64, np.uint32, np.uint32, np.uint8, np.uint8)
DONE_KINDS = (*[np.int64] * 7, np.float64)


FOUND = "block int, kind tinyint, did bigint, other bigint, low bigint, high bigint, cell binary"
#: Kinds of rows: a chain, a request for words of another document, stretches, matches at both ends of pairs of them, passages.
CHAIN, ASK, STRETCH, PAIR, DONE = range(5)


def found_rows(block, kind, did, other, low, high, cells) -> pa.Table:
    n = len(did)
    wide = lambda v, t: pa.array(np.broadcast_to(np.asarray(v, t), n))
    return pa.table([wide(block, np.int32), wide(kind, np.int8), *(wide(v, np.int64) for v in (did, other, low, high)), pa.array(cells, pa.binary()) if cells is not None else pa.nulls(n, pa.binary())], ["block", "kind", "did", "other", "low", "high", "cell"])


def chain_rows(block: int, did: np.ndarray, other: np.ndarray, a: np.ndarray, b: np.ndarray, seed: int, gap: float, known: set = frozenset()) -> pa.Table:
    """Chains of at least LEAST_CHAIN words along matches that are sorted: rows (block, CHAIN, did, other, matches), and, for
    each document that a block's chains lead to, what words of it the block needs: (block, ASK, other, low, high)."""
    none = np.zeros(0, np.int64)
    cut = np.flatnonzero(np.r_[True, (did[1:] != did[:-1]) | (other[1:] != other[:-1]), True]) if len(did) else none
    out, cells = [], []
    for s, e in zip(cut.tolist(), cut[1:].tolist(), strict=False):
        for c in chains(a[s:e], b[s:e], float(seed), gap, LEAST_CHAIN - seed):
            xs, ys = a[s + c], b[s + c]
            if min(xs[-1] - xs[0], ys[-1] - ys[0]) + seed >= LEAST_CHAIN:
                cell = planes(np.diff(xs, prepend=0).astype(np.uint32), np.diff(ys, prepend=0).astype(np.uint32))
                if (int(did[s]), int(other[s]), cell) not in known:
                    out.append((did[s], other[s], ys[0], ys[-1] + seed))
                    cells.append(cell)
    if not out:
        return found_rows(0, 0, none, none, none, none, None)
    one, to, low, high = np.array(out, np.int64).T
    w, lo, hi = united(to, np.maximum(0, low - MARGIN), high + MARGIN)
    return pa.concat_tables([found_rows(block, CHAIN, one, to, low, high, cells), found_rows(block, ASK, w, w, lo, hi, None)])


def linked(texts: DataFrame, replies: DataFrame, seed: int, window: int, long: int, long_window: int, gap: float) -> DataFrame:
    """Of each block the chains along the matches of its seeds with their partners, and its stretches, dealt by their first
    seeds: (block, STRETCH, other: the part, low: how many, cell)."""
    parts = PARTS * partitions(texts.sparkSession)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        if not left.num_rows or not right.num_rows:
            return found_rows(0, 0, none, none, none, none, None)
        block = left.column("block")[0].as_py()
        x = Words(unpacked(left))
        x.hashes()
        seeds = x.seeds(seed, window, long, long_window)
        got = [columns(c, n, np.uint64, np.int64, np.uint32, np.uint8) for c, n in zip(right.column("cell").to_pylist(), right.column("n").to_pylist(), strict=True)]
        got = [np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got]), *(np.concatenate([g[k] for g in got]) for k in (1, 2, 3))]
        order = np.argsort(got[0], kind="stable")
        got = [v[order] for v in got]
        doc, other, a, b = matches(x, seeds, got, seed)
        found = chain_rows(block, x.did[doc], other, a, b, seed, gap)
        pair, text, did, word, size = stretches(x, seeds, got, seed)
        part = ((pair >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(parts + 1))
        has = np.flatnonzero(np.diff(cut))
        cells = []
        for p in has.tolist():
            i = order[cut[p] : cut[p + 1]]
            cells.append(planes(keyed(pair[i]), text[i], did[i], word[i], size[i]))
        return pa.concat_tables([found, found_rows(block, STRETCH, 0 * has, has, np.diff(cut)[has], 0 * has, cells)])

    return texts.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, FOUND)


def paired(table: pa.Table) -> list[pa.Table]:
    """For each two stretches that begin with the same seed and end with the same seed, but have different words between, the
    matches of both ends: (block of the later, PAIR, low: how many, cell). Of stretches that are alike word for word the first
    stands for all; all pairs of different ones are made, however many there are."""
    size = table.column("low").to_numpy()
    got = [columns(c, n, *STRETCH_KINDS) for c, n in zip(table.column("cell").to_pylist(), size.tolist(), strict=True)]
    pair = np.concatenate([np.cumsum(g[0], dtype=np.uint64) for g in got])
    text, did, word, gap = (np.concatenate([g[k] for g in got]) for k in range(1, 5))
    block = np.repeat(table.column("block").to_numpy(), size)
    order = np.lexsort((word, did, text, pair))
    order = order[np.r_[True, (pair[order][1:] != pair[order][:-1]) | (text[order][1:] != text[order][:-1])]]
    order = order[np.lexsort((word[order], did[order], pair[order]))]
    pair, did, word, gap, block = (v[order] for v in (pair, did, word, gap, block))
    start = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    before = np.arange(len(pair)) - np.repeat(start, np.diff(np.r_[start, len(pair)]))  # how many are earlier
    upto = np.cumsum(before)
    out, s = [], 0
    while s < len(pair):
        e = max(s + 1, int(np.searchsorted(upto, (upto[s - 1] if s else 0) + PAIRS, side="right")))
        n = before[s:e]
        p = np.repeat(np.arange(s, e), n)
        q = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + (p - before[p])
        s = e
        if not len(p):
            continue
        # a place that begins several pairs of stretches with another place is sent with the farthest end
        order = np.lexsort((gap[q], gap[p], word[q], word[p], did[q], did[p], block[p]))
        p, q = p[order], q[order]
        last = np.r_[(did[p][1:] != did[p][:-1]) | (did[q][1:] != did[q][:-1]) | (word[p][1:] != word[p][:-1]) | (word[q][1:] != word[q][:-1]), True]
        p, q = p[last], q[last]
        to = block[p]
        edge = np.flatnonzero(np.r_[True, to[1:] != to[:-1], True])
        cells = [planes(did[p[a:z]], did[q[a:z]], word[p[a:z]], word[q[a:z]], gap[p[a:z]], gap[q[a:z]]) for a, z in zip(edge.tolist(), edge[1:].tolist(), strict=False)]
        zero = np.zeros(len(cells), np.int64)
        out.append(found_rows(to[edge[:-1]], PAIR, zero, zero, np.diff(edge), zero, cells))
    return out


def served(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Chains and passages as they are, the pairs of stretches, and each request (at dest, the block that has the document) with
    its answer: (block: the one that asked, ASK, other, low: number of the first word, high: its place in bytes, cell: the
    bytes)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.drop_columns(["dest"])
        kind = right.column("kind").to_numpy()
        out = [right.filter(pa.array((kind == CHAIN) | (kind == DONE)))]
        if (kind == STRETCH).any():
            out += paired(right.filter(pa.array(kind == STRETCH)))
        right = right.filter(pa.array(kind == ASK))
        if right.num_rows:
            left = unpacked(left)
            x = Words(left.filter(pa.array(np.isin(left.column("did").to_numpy(), right.column("other").to_numpy()))))
            x.places()
            ref, low, high = (right.column(c).to_numpy() for c in ("other", "low", "high"))
            i = np.searchsorted(x.did, ref)
            first, last = x.first[i], x.first[i + 1]
            low = np.minimum(low, last - first - 1)
            a, z = x.begin[first + low], x.end[np.minimum(first + high, last) - 1]
            cells = [x.data[s:e].tobytes() for s, e in zip(a.tolist(), z.tolist(), strict=True)]
            out.append(found_rows(right.column("block").to_numpy(), ASK, ref, ref, low, a - x.bounds[i], cells))
        return pa.concat_tables(out)

    return texts.groupBy("block").cogroup(found.groupBy("dest")).applyInArrow(run, FOUND)


def within(did: np.ndarray, low: np.ndarray, high: np.ndarray, covered: np.ndarray, seed: int) -> np.ndarray:
    """Whether the words from low to high of a document lie in one of its passages (did, low, high, words of the document),
    with the MARGIN words at either side that an alignment may look at. At the ends of a document, whose first and last
    shingles are seeds, fewer words than a seed may be left."""
    if not len(covered):
        return np.zeros(len(did), bool)
    one, begin, end, words = covered[np.lexsort(covered.T[1::-1])].T
    docs, first = np.unique(one, return_index=True)
    at = np.minimum(np.searchsorted(docs, did), len(docs) - 1)
    n = words[first][at]
    low = np.maximum(low - MARGIN, np.minimum(low, seed - 1))
    high = np.minimum(high + MARGIN, np.maximum(high, n - seed + 1))
    lift = int(words.max()) + 1
    rank = np.searchsorted(docs, one) * lift
    last = np.searchsorted(rank + begin, at * lift + low, side="right") - 1  # the last passage that begins there or before
    farthest = np.maximum.accumulate(rank + end)
    return (docs[at] == did) & (last >= first[at]) & (farthest[last] >= at * lift + high)


def bridged(block: int, chains_: pa.Table, pairs: pa.Table, covered: np.ndarray, seed: int, gap: float) -> pa.Table:
    """Chains along the ends of pairs of stretches, and along these together with the chains that the same two documents have
    already. Two documents whose seeds all lie within one passage that the later one has already need none: what they give
    would lie within that passage."""
    got = [columns(c, n, *PAIR_KINDS) for c, n in zip(pairs.column("cell").to_pylist(), pairs.column("low").to_pylist(), strict=True)]
    whole = covered[(covered[:, 1] == 0) & (covered[:, 2] == covered[:, 3]), 0]
    got = [[v[use] for v in g] for g in got for use in (~np.isin(g[0], whole),)]
    did, other, a, b, more, more2 = (np.concatenate([g[k] for g in got]).astype(np.int64) for k in range(6))
    meets = set(zip(did.tolist(), other.tolist(), strict=True))
    known, held = set(), [(did, other, a, b), (did, other, a + more, b + more2)]
    for one, to, cell in zip(*(chains_.column(c).to_pylist() for c in ("did", "other", "cell")), strict=True):
        if (one, to) in meets:
            known.add((one, to, cell))
            xs, ys = (np.cumsum(c, dtype=np.int64) for c in columns(cell, len(cell) // 8, np.uint32, np.uint32))
            held.append((np.full(len(xs), one), np.full(len(xs), to), xs, ys))
    did, other, a, b = (np.concatenate([h[k] for h in held]) for k in range(4))
    order = np.lexsort((b, a, other, did))
    did, other, a, b = (v[order] for v in (did, other, a, b))
    if len(did):
        first = np.r_[True, (did[1:] != did[:-1]) | (other[1:] != other[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        did, other, a, b = (v[first] for v in (did, other, a, b))
        cut = np.flatnonzero(np.r_[True, (did[1:] != did[:-1]) | (other[1:] != other[:-1]), True])
        use = np.repeat(~within(did[cut[:-1]], a[cut[:-1]], a[cut[1:] - 1] + seed, covered, seed), np.diff(cut))
        did, other, a, b = (v[use] for v in (did, other, a, b))
    return chain_rows(block, did, other, a, b, seed, gap, known)


def distance(a: list[int], b: list[int]) -> int:
    """Edit distance of word sequences, by bit-parallel columns (the whole of b in one integer)."""
    n, k = min(len(a), len(b)), 0
    while k < n and a[k] == b[k]:
        k += 1
    n, z = n - k, 0
    while z < n and a[-1 - z] == b[-1 - z]:
        z += 1
    a, b = a[k : len(a) - z], b[k : len(b) - z]
    if not a or not b:
        return len(a) + len(b)
    places: dict[int, int] = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    up, down = full, 0
    for x in a:
        eq = places.get(x, 0)
        v = eq | down
        eq |= (((eq & up) + up) ^ up)
        more = down | ~(eq | up) & full
        less = up & eq
        more = more << 1 | 1
        up = (less << 1 | ~(v | more)) & full
        down = more & v & full
    return len(a) + up.bit_count() - down.bit_count()  # the last column: its top, and all steps down from there


def nearest(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """Edit distance of words of which it is known that it is at most so much: so many words of one that the other has not,
    counting repeats, have to be edited, and mostly that is as much."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    k = n if same.all() else int(same.argmin())
    same = a[k:][::-1][: n - k] == b[k:][::-1][: n - k]
    z = n - k if same.all() else int(same.argmin())
    a, b = a[k : len(a) - z], b[k : len(b) - z]
    _, at = np.unique(np.r_[a, b], return_inverse=True)
    more = np.bincount(at[: len(a)], minlength=len(at)) - np.bincount(at[len(a) :], minlength=len(at))
    if max(int(np.maximum(more, 0).sum()), int(np.maximum(-more, 0).sum())) == most:
        return most
    return distance(a.tolist(), b.tolist())


def extended(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many words from the beginning of a and b on agree, some mismatches (up to a drop of 6 from the best) being passed
    over; and how many of these mismatch."""
    n = min(len(a), len(b))
    for reach in (min(n, 64), n):  # mostly short
        best, most, wrong, k = 0, 0, 0, 0  # how many words, worth 1 each and -2 if they mismatch; how many do
        for at in [*(a[:reach] != b[:reach]).nonzero()[0].tolist(), reach]:
            score = at - 3 * k
            if score > most:
                best, most, wrong = at, score, k
            if at < reach and most - (score - 2) > 6:
                return best, wrong
            k += 1
        if reach == n:
            break
    return best, wrong


def passages(ha: np.ndarray, hb: np.ndarray, x: np.ndarray, y: np.ndarray, seed: int, min_words: int, similarity: float) -> list[tuple[int, int, int, int, int, float]]:
    """Stretches (begin, end in a; begin, end in b; words; similarity) along a chain of matches (x, y) of the words ha, hb."""
    dx, dy = x[1:] - x[:-1], y[1:] - y[:-1]
    edits = np.zeros(len(dx), np.int64)
    level = dx == dy
    for k in np.flatnonzero(~level | (dx > seed)).tolist():
        a, b = ha[x[k] : x[k + 1]], hb[y[k] : y[k + 1]]
        edits[k] = np.count_nonzero(a != b) if level[k] else 3
        if edits[k] > 2:  # fewer changes than that, at equal lengths, are the distance
            edits[k] = distance(a.tolist(), b.tolist())
    total = np.r_[0, np.cumsum(edits)]
    out = []
    parts = [(0, len(x) - 1)]
    while parts:
        s, e = parts.pop()
        i, i2, j, j2 = int(x[s]), int(x[e]) + seed, int(y[s]), int(y[e]) + seed
        left, wrong = extended(ha[:i][::-1], hb[:j][::-1])
        right, wrong2 = extended(ha[i2:], hb[j2:])
        i, j, i2, j2 = i - left, j - left, i2 + right, j2 + right
        wrong += int(total[e] - total[s]) + wrong2
        lack = min_words - min(i2 - i, j2 - j)
        if lack > 0 and lack <= (1 - similarity) * min_words:  # words that differ may still belong to it
            more = min(lack, len(ha) - i2, len(hb) - j2)
            less = min(lack - more, i, j)
            wrong += int((ha[i2 : i2 + more] != hb[j2 : j2 + more]).sum()) + int((ha[i - less : i] != hb[j - less : j]).sum())
            i, j, i2, j2 = i - less, j - less, i2 + more, j2 + more
        n = max(i2 - i, j2 - j)
        if min(i2 - i, j2 - j) < min_words:
            continue
        near = 1 - wrong / n
        if (wrong > 2 or i2 - i != j2 - j) and near >= similarity - CLOSE:  # edits along the chain may be a few more than needed
            near = 1 - nearest(ha[i:i2], hb[j:j2], wrong) / n
        if near >= similarity:
            out.append((i, i2, j, j2, n, near))
        elif e > s:
            k = s + int(edits[s:e].argmax())
            parts += [(s, k), (k + 1, e)]
    return out


PASSAGES = "did bigint, start bigint, stop bigint, ref bigint, ref_start bigint, ref_stop bigint, n_words bigint, similarity double"


def passages_of(left: pa.Table, chains_: pa.Table, slices: pa.Table, seed: int, min_words: int, similarity: float) -> tuple[list[tuple], list[tuple[int, int, int, int]]]:
    """Passages along the chains of a block, given the other documents' words; and of those of the block's documents: did,
    first word, word after the last, and the document's words."""
    out: list[tuple] = []
    covered: list[tuple[int, int, int, int]] = []
    ours = chains_.column("did").to_numpy()
    left = unpacked(left)
    x = Words(left.filter(pa.array(np.isin(left.column("did").to_numpy(), ours))))
    x.hashes()
    # the other documents' slices, end to end, in the order of document and place
    ref, first, place = (slices.column(c).to_numpy() for c in ("other", "low", "high"))
    order = np.lexsort((first, ref))
    ref, first, place = ref[order], first[order], place[order]
    texts_ = slices.column("cell").take(pa.array(order)).to_pylist()
    edge = np.r_[0, np.cumsum([len(t) for t in texts_])]
    begin, end, words = word_hashes(np.frombuffer(b"".join(texts_), np.uint8), edge[:-1])
    cut = np.searchsorted(begin, edge)
    other, low = chains_.column("other").to_numpy(), chains_.column("low").to_numpy()
    # the last slice of the document that begins at the chain or before
    code = np.unique(ref)
    lift = int(max(first.max(), low.max())) + 1
    at = np.searchsorted(np.searchsorted(code, ref) * lift + first, np.searchsorted(code, other) * lift + low, side="right") - 1
    mine = np.searchsorted(x.did, ours)
    cells = chains_.column("cell").to_pylist()
    whole = -1  # the document that lies as a whole in one passage: later references give it nothing more
    for n in np.lexsort((low, other, ours)).tolist():
        k, i, cell = int(at[n]), int(mine[n]), cells[n]
        if i == whole and ours[n] > other[n]:
            continue
        s, e, w = int(x.first[i]), int(x.first[i + 1]), int(cut[k])
        a, b = (np.cumsum(c, dtype=np.int64) for c in columns(cell, len(cell) // 8, np.uint32, np.uint32))
        here, there = int(x.bounds[i]), int(place[k]) - int(edge[k])
        for i1, i2, j1, j2, size, near in passages(x.hash[s:e], words[w : cut[k + 1]], a, b - first[k], seed, min_words, similarity):
            one = (int(ours[n]), int(x.begin[s + i1]) - here, int(x.end[s + i2 - 1]) - here)
            two = (int(other[n]), int(begin[w + j1]) + there, int(end[w + j2 - 1]) + there)
            out.append((*one, *two, size, near) if one[:2] > two[:2] else (*two, *one, size, near))
            if one[:2] > two[:2]:
                covered.append((one[0], i1, i2, e - s))
            if i1 == 0 and i2 == e - s and ours[n] > other[n]:
                whole = i
    return out, covered


def aligned(texts: DataFrame, rows: DataFrame, seed: int, min_words: int, similarity: float, gap: float, last: bool) -> DataFrame:
    """Passages along the chains of each block: as rows if it is the last time, else in one cell (block, DONE, low: how many,
    cell), with the chains along the block's pairs of stretches and their requests."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        kind = right.column("kind").to_numpy() if right.num_rows else none
        chains_, slices, pairs, done = (right.filter(pa.array(kind == k)) for k in (CHAIN, ASK, PAIR, DONE))
        out, covered = passages_of(left, chains_, slices, seed, min_words, similarity) if chains_.num_rows else ([], [])
        held = [columns(c, n, *DONE_KINDS) for c, n in zip(done.column("cell").to_pylist(), done.column("low").to_pylist(), strict=True)]
        cols = list(zip(*out, strict=True)) or [()] * 8
        cols = [np.concatenate([np.array(c, t), *(h[k] for h in held)]) for k, (c, t) in enumerate(zip(cols, DONE_KINDS, strict=True))]
        names = ["did", "start", "stop", "ref", "ref_start", "ref_stop", "n_words", "similarity"]
        found = outer(pa.table([pa.array(c) for c in cols], names))
        if last:
            return found
        block = right.column("block")[0].as_py() if right.num_rows else 0
        zero = np.zeros(min(found.num_rows, 1), np.int64)
        rows = [found_rows(block, DONE, zero, zero, zero + found.num_rows, zero, [planes(*(c.to_numpy() for c in found.columns))] if len(zero) else [])]
        if pairs.num_rows:
            rows.append(bridged(block, chains_, pairs, np.array(covered, np.int64).reshape(-1, 4), seed, gap))
        return pa.concat_tables(rows)

    return texts.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(run, PASSAGES if last else FOUND)


def outer(found: pa.Table) -> pa.Table:
    """Rows that don't lie within another row of their document; of equal ones that with the earliest reference."""
    if not found.num_rows:
        return found
    did, start, stop, ref, ref_start, ref_stop, near = (found.column(c).to_numpy() for c in ("did", "start", "stop", "ref", "ref_start", "ref_stop", "similarity"))
    order = np.lexsort((ref_stop, -near, ref_start, ref, -stop, start, did))
    did, stop = did[order], stop[order]
    new = np.r_[True, did[1:] != did[:-1]]
    lift = (np.cumsum(new) - 1) * (int(stop.max()) + 1)
    high = np.maximum.accumulate(stop + lift)
    return found.take(pa.array(order[new | np.r_[True, (stop + lift)[1:] > high[:-1]]]))


def outermost(found: DataFrame) -> DataFrame:
    """outer, over whole documents; each block has done it for what it found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in whole_groups(batches, "did"):
            yield from outer(pa.table(g)).to_batches(max_chunksize=20_000)

    n = partitions(found.sparkSession)
    return found.repartition(n, "did").sortWithinPartitions("did").mapInArrow(run, PASSAGES)


def fuzzy_passages(docs: DataFrame, min_words: int = MIN_WORDS, similarity: float = SIMILARITY, seed: int = SEED, window: int = WINDOW, long: int = LONG, long_window: int = LONG_WINDOW, gap: float = GAP, block_bytes: int = BLOCK) -> DataFrame:
    """Passages of docs (doc_id, text) that occur, nearly alike, earlier: in a smaller doc_id, or further up.

    One row each: doc_id, start, stop (bytes of the UTF-8, end exclusive), ref_doc_id, ref_start, ref_stop, n_words (of the
    longer of the two), similarity (1 - word edits / n_words). A passage that recurs n times gives n - 1 rows, each with
    one earlier occurrence; what lies within another passage of its document has no row. Every repetition, word for word,
    of long + long_window - 1 words is covered; passages with changed words are found as far as their seeds meet (README).
    Null, empty and short texts have none; rows that share a doc_id, or have none, are documents of their own, which follow
    each other in the order of their texts' hashes, those without id last; an empty table gives no row; other columns are
    ignored. Blanks (space, U+0009 to U+000D) part words; A-Z count as a-z.
    """
    spark = docs.sparkSession
    prepare(spark)
    one, size, named = numbered(docs)
    blocks = F.lit(max(1, -(-size // block_bytes)))
    block_of = lambda c: F.pmod(F.xxhash64(c), blocks).cast("int")
    n = partitions(spark)
    # One plan: the texts are shuffled once, by block, and that exchange serves all four steps that read them.
    texts = packed(one.select(block_of("did").alias("block"), "did", "text")).repartition(n, "block")
    replies = partners(sown(texts, seed, window, long, long_window, RARE), RARE).repartition(n, "block")
    found = linked(texts, replies, seed, window, long, long_window, gap)
    for last in (False, True):  # chains with partners, then along stretches
        dest = F.when(F.col("kind") == ASK, block_of("other")).when(F.col("kind") == STRETCH, F.col("other").cast("int")).otherwise(F.col("block"))
        rows = served(texts, found.withColumn("dest", dest).repartition(n, "dest")).repartition(n, "block")
        found = aligned(texts, rows, seed, min_words, similarity, gap, last)
    out = outermost(found)
    return named(out.withColumnsRenamed({"did": "doc_id", "ref": "ref_doc_id"}), "doc_id", "ref_doc_id")


def op10_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_passages(documents(spark, sf_dir))
