"""Exact substring dedup: depth-limited radix order of suffixes, by most-significant-digit passes.

Every string of `length` bytes holds one anchor: the k bytes with the smallest hash in it (its first, if tied). Equal
strings have equal anchors at equal places, so only suffixes that begin at anchors are looked at, about one in 35, and a
string is a suffix with an offset.
  1. Suffixes meet by their anchor's bytes, as a 64-bit number; those that share it with no other are done, as no string
     through them repeats.
  2. Suffixes whose strings are all equal (the same stretch of bytes around the anchor: compared byte by byte in a block,
     by a further 64-bit number across blocks) are reduced to the first.
  3. The strings through what is left are put in order by most-significant-digit passes over their own bytes, DIGIT bytes a
     pass through all `length` bytes, a group being split by each digit and left when it has one member. Groups after
     the last pass are exactly the repeated strings; all but the first of each are removed.
What several documents share is cut down where it lies before it is shuffled, so a passage in a third of all documents
sends a few rows from each block; anchors with very many contexts are split by single strings, which go to as many
places: their bytes are compared in a block, and two independent 64-bit numbers stand for them across blocks.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semspark.llm.common import Rolling, documents, mix64, numbered, partitions, prepare, sliding_min, small, text_bytes, united, whole_groups

LENGTH = 100
BLOCK = 2 << 20
#: An anchor with more contexts than this in one block, or in all, is split by single strings.
HOT_HERE, HOT = 24, 256
#: Bytes of a digit.
DIGIT = 8


@functools.cache
def rolling() -> Rolling:
    return Rolling()


@functools.cache
def second() -> Rolling:
    """Hashes that are independent of rolling's."""
    return Rolling(0xD6E8FEB86659FD93)


def depth(length: int) -> tuple[int, int]:
    """Bytes of an anchor, and places that it can have in a string."""
    k = max(1, min(32, length // 3))
    return k, length - k + 1


Piece = tuple[int, int, np.ndarray, int, int, int]


def cut_up(did: np.ndarray, data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[list[Piece]]:
    """Blocks of pieces (document, bytes before, bytes, first and last string start, and if the document ends here).
    A document longer than a block is cut into pieces that overlap as far as its strings and their contexts reach."""
    out: list[Piece] = []
    size = 0
    margin = 2 * length
    for i, d in enumerate(did.tolist()):
        text = data[bounds[i] : bounds[i + 1]]
        n = len(text) - length + 1
        for at in range(0, max(0, n), BLOCK):
            low, high = max(0, at - margin), min(len(text), at + BLOCK + margin)
            out.append((d, low, text[low:high], at - low, min(n, at + BLOCK) - low, 0))
            size += high - low
            if size >= BLOCK:
                yield out
                out, size = [], 0
    if out:
        yield out


class Block:
    """Anchors of a block of pieces, with the stretch of strings through each."""

    def __init__(self, pieces: list[Piece], length: int) -> None:
        k, w = depth(length)
        self.length, self.k, self.w = length, k, w
        self.data = np.concatenate([p[2] for p in pieces])
        size = np.array([len(p[2]) for p in pieces])
        self.end = np.cumsum(size)
        self.begin = self.end - size
        self.did = np.array([p[0] for p in pieces], np.int64)
        self.base = np.array([p[1] for p in pieces], np.int64) - self.begin  # place in the block -> place in the document
        self.sums = rolling().sums(self.data)
        self.first, self.last = self.begin + [p[3] for p in pieces], self.begin + [p[4] for p in pieces]

    def hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return rolling().of(self.sums, a, b)

    def anchors(self) -> None:
        i = np.arange(len(self.data) - self.k + 1)
        h = self.hash(i, i + self.k)
        low = sliding_min((h & ~np.uint64((1 << 24) - 1)) | i.astype(np.uint64), self.w)
        valid = np.zeros(len(self.data) + 1, np.int8)
        np.add.at(valid, self.first, 1)
        np.add.at(valid, self.last, -1)
        at = (low[np.cumsum(valid[: len(low)]) > 0] & np.uint64((1 << 24) - 1)).astype(np.int64)
        self.at = at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at
        self.place()
        self.key = h[self.at]
        self.context = mix64(self.hash(self.low, self.high) ^ mix64((self.at - self.low << 16 | self.high - self.at).astype(np.uint64)))

    def place(self) -> None:
        """For the anchors: whose they are, and the stretch of the strings through each."""
        self.own = np.searchsorted(self.end, self.at, side="right")
        self.low = np.maximum(self.begin[self.own], self.at - self.w + 1)
        self.high = np.minimum(self.end[self.own], self.at + self.length)


#: reach: bytes from a stretch's begin to `at`, and from there to its end, in 32 bits each; mostly alike, so it packs well.
SUFFIXES = "part bigint, kind tinyint, context bigint, did bigint, at bigint, reach bigint"
#: Kinds of rows: an anchor, a stretch that is removed, an anchor asked for with its context or by single strings, a sign
#: that an anchor is hot.
ANCHOR, REMOVED, COLD_ASK, HOT_ASK, HOT_SIGN = range(5)


def rows(part, kind, context, did, at, low, high) -> pa.RecordBatch:
    n = len(at)
    wide = lambda x: np.broadcast_to(np.asarray(x), n)
    as_int = lambda x: np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64)
    reach = (at - low) << 32 | (high - at)
    return pa.RecordBatch.from_arrays([pa.array(as_int(wide(part))), pa.array(wide(kind).astype(np.int8)), *(pa.array(as_int(wide(x))) for x in (context, did, at, reach))], ["part", "kind", "context", "did", "at", "reach"])


def stretch(at: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end."""
    return at - (reach >> 32), at + (reach & 0xFFFFFFFF)


def removed(did: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    did, low, high = united(did, low, high)
    return rows(mix64(did.astype(np.uint64)), REMOVED, 0, did, low, low, high)


def differing(data: np.ndarray, begin: np.ndarray, size: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Rows that aren't, byte by byte, what their group's first is, though their numbers are the same."""
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    out = []
    rest = np.flatnonzero(~new)
    for at in range(0, len(rest), 8192):
        i = rest[at : at + 8192]
        j = first[i]
        same = size[i] == size[j]
        out.append(i[~same])
        i, j = i[same], j[same]
        mine, edge = gather(data, begin[i], size[i])
        theirs, _ = gather(data, begin[j], size[j])
        if len(i):
            out.append(i[np.add.reduceat(mine != theirs, edge) > 0])
    return np.concatenate(out) if out else rest


def digits_at(flat: np.ndarray) -> np.ndarray:
    """The DIGIT bytes from each place on as one big-endian number; zeros beyond the end."""
    padded = np.r_[flat, np.zeros(DIGIT, np.uint8)]
    out = np.zeros(len(flat), np.uint64)
    for k in range(DIGIT):
        out = out << np.uint64(8) | padded[k : k + len(flat)]
    return out


def equal_strings(flat: np.ndarray, start: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit passes over strings flat[start : start + length], within groups (their numbers in order): the rows
    that have equals, equal ones next to each other and in their given order, and the number of each one's group. A pass
    sorts only the groups that its digit splits."""
    row = np.arange(len(start))
    digits = digits_at(flat)
    for depth in range(0, length, DIGIT):
        if not len(row):
            break
        digit = digits[start[row] + depth]
        if length - depth < DIGIT:
            digit = digit >> np.uint64(8 * (DIGIT - (length - depth)))
        new = np.r_[True, group[1:] != group[:-1]]
        number, first = np.cumsum(new) - 1, np.flatnonzero(new)
        differ = digit != digit[first][number]
        if depth and not differ.any():
            continue
        split = np.zeros(len(first), bool)
        split[number[differ]] = True
        at = np.flatnonzero(split[number])
        order = np.lexsort((digit[at], number[at]))
        row[at], digit[at] = row[at][order], digit[at][order]
        number = np.cumsum(new | np.r_[False, digit[1:] != digit[:-1]]) - 1
        several = (np.bincount(number) > 1)[number]
        row, group = row[several], number[several]
    return row, group


def first_pass(docs: DataFrame, length: int, hot_here: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = text_bytes(b.column(1))
            for pieces in cut_up(b.column(0).to_numpy(), data, bounds, length):
                x = Block(pieces, length)
                x.anchors()
                did, base = x.did[x.own], x.base[x.own]
                at, low, high = x.at + base, x.low + base, x.high + base
                # a long document's pieces may find an anchor twice
                order = np.lexsort((at, did, x.context, x.key))
                key, context, did, at, low, high = (v[order] for v in (x.key, x.context, did, at, low, high))
                new_key = np.r_[True, key[1:] != key[:-1]]
                new = np.r_[True, (key[1:] != key[:-1]) | (context[1:] != context[:-1])]
                here = x.low[order]
                new[differing(x.data, here, high - low, new)] = True
                twice = np.r_[False, ~new[1:] & (did[1:] == did[:-1]) & (at[1:] == at[:-1])]
                gone = ~new & ~twice
                yield from small(removed(did[gone], low[gone], high[gone]))
                group = np.cumsum(new_key) - 1
                many = (np.bincount(group, weights=new) > hot_here)[group]
                for kind, some in ((ANCHOR, new & ~many), (HOT_ASK, new & many), (HOT_SIGN, new_key & many)):
                    yield from small(rows(key[some], kind, context[some] if kind == ANCHOR else 0, did[some], at[some], low[some], high[some]))

    return docs.mapInArrow(run, SUFFIXES)


def second_pass(suffixes: DataFrame, hot: int) -> DataFrame:
    """Rows REMOVED, COLD_ASK and HOT_ASK, from suffixes put in the order of their first two digits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in whole_groups(batches, "part"):
            kind = g["kind"]
            g["low"], g["high"] = stretch(g["at"], g["reach"])
            for k in (REMOVED, HOT_ASK):
                s = kind == k
                yield from small(rows(g["part"][s], k, 0, g["did"][s], g["at"][s], g["low"][s], g["high"][s]))
            signs = g["part"][kind == HOT_SIGN]
            s = kind == ANCHOR
            key, context, did, at, low, high = (g[x][s] for x in ("part", "context", "did", "at", "low", "high"))
            if not len(key):
                continue
            new_key = np.r_[True, key[1:] != key[:-1]]
            new = np.r_[True, (key[1:] != key[:-1]) | (context[1:] != context[:-1])]
            twice = np.r_[False, ~new[1:] & (did[1:] == did[:-1]) & (at[1:] == at[:-1])]
            gone = ~new & ~twice
            yield from small(removed(did[gone], low[gone], high[gone]))
            group = np.cumsum(new_key) - 1
            contexts = np.bincount(group, weights=new)[group]
            signed = np.isin(key, signs)
            for k, some in ((HOT_ASK, new & (signed | (contexts > hot))), (COLD_ASK, new & ~signed & (contexts > 1) & (contexts <= hot))):
                yield from small(rows(key[some], k, 0, did[some], at[some], low[some], high[some]))

    n = partitions(suffixes.sparkSession)
    return suffixes.repartition(n, "part").sortWithinPartitions("part", "kind", "context", "did", "at").mapInArrow(run, SUFFIXES)


STRINGS = "part bigint, kind tinyint, did bigint, low bigint, high bigint, bytes binary"


def string_rows(part, kind, did, low, high, cells=None) -> pa.RecordBatch:
    r = rows(part, kind, 0, did, low, low, high)
    return pa.RecordBatch.from_arrays([r.column(0), r.column(1), r.column(3), pa.array(low), pa.array(high), pa.array(cells, pa.binary()) if cells is not None else pa.nulls(r.num_rows, pa.binary())], ["part", "kind", "did", "low", "high", "bytes"])


def last_digits(asked: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """For anchors asked for: their contexts, or their strings one by one where the anchor is hot; and what is removed."""
    asks = asked.groupBy("did").agg(F.collect_list(F.struct("part", "kind", "at", "reach")).alias("asks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = text_bytes(b.column(1))
            did = b.column(0).to_numpy()
            lists = b.column(2)
            own = np.repeat(np.arange(len(did)), lists.value_lengths().to_numpy(zero_copy_only=False))
            part, kind, at, reach = (c.to_numpy() for c in lists.flatten().flatten())
            low, high = stretch(at, reach)
            r = kind == REMOVED
            gone = united(did[own[r]], low[r], high[r])
            yield from small(string_rows(mix64(gone[0].astype(np.uint64)), REMOVED, *gone))
            cold = np.flatnonzero(kind == COLD_ASK)
            for at in range(0, len(cold), 4096):
                i = cold[at : at + 4096]
                start = bounds[own[i]]
                cells = [data[s + a : s + z].tobytes() for s, a, z in zip(start.tolist(), low[i].tolist(), high[i].tolist(), strict=True)]
                yield string_rows(part[i], COLD_ASK, did[own[i]], low[i], high[i], cells)
            hot = np.flatnonzero(kind == HOT_ASK)
            for at in range(0, len(hot), 2048):
                i = hot[at : at + 2048]
                begin = bounds[own[i]] + low[i]
                size = high[i] - low[i]
                flat, edge = gather(data, begin, size)
                s = rolling().sums(flat)
                who, offset = ragged_starts(size - length + 1)
                a = edge[who] + offset
                h = mix64(rolling().of(s, a, a + length) ^ part[i][who].view(np.uint64))
                d, lo = did[own[i]][who], low[i][who] + offset
                order = np.lexsort((lo, d, h))
                h, d, lo = h[order], d[order], lo[order]
                new = np.r_[True, h[1:] != h[:-1]]
                new[differing(flat, a[order], np.full(len(h), length), new)] = True
                same = np.r_[False, ~new[1:] & (d[1:] == d[:-1]) & (lo[1:] == lo[:-1])]
                gone = united(d[~new & ~same], lo[~new & ~same], lo[~new & ~same] + length)
                yield string_rows(mix64(gone[0].astype(np.uint64)), REMOVED, *gone)
                begin = a[order][new]
                number = second().of(second().sums(flat), begin, begin + length)
                cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(number), [None, pa.py_buffer(number.tobytes())]).cast(pa.binary())
                yield from small(string_rows(h[new], HOT_ASK, d[new], lo[new], lo[new] + length, cells))

    return docs.join(asks, "did").select("did", "text", "asks").mapInArrow(run, STRINGS)


def gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches end to end, and where each begins."""
    edge = np.cumsum(size) - size
    return data[np.repeat(begin - edge, size) + np.arange(int(size.sum()))], edge


def ragged_starts(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    who = np.repeat(np.arange(len(count)), count)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(count) - count, count)


def beyond_the_first(part: np.ndarray, did: np.ndarray, low: np.ndarray, cells: np.ndarray, width: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (did, low, high) of the strings of `width` bytes in the cells that equal an earlier one of their part; strings
    at one place are one."""
    order = np.lexsort((low, did, part))
    part, did, low, cells = part[order], did[order], low[order], cells[order]
    size = np.array([len(c) for c in cells])
    edge = np.cumsum(size) - size
    who, offset = ragged_starts(size - width + 1)
    part, did, low, start = part[who], did[who], low[who] + offset, edge[who] + offset
    # the passes keep the order of document and place; only stretches that overlap are out of it
    if ((part[1:] == part[:-1]) & (did[1:] == did[:-1]) & (low[1:] < low[:-1])).any():
        order = np.lexsort((low, did, part))
        part, did, low, start = part[order], did[order], low[order], start[order]
    group = np.cumsum(np.r_[True, part[1:] != part[:-1]]) - 1
    row, group = equal_strings(np.frombuffer(b"".join(cells), np.uint8), start, group, width)
    did, low = did[row], low[row]
    again = np.r_[False, group[1:] == group[:-1]] if len(row) else np.zeros(0, bool)
    again[1:] &= (did[1:] != did[:-1]) | (low[1:] != low[:-1])
    return did[again], low[again], low[again] + length


def last_pass(strings: DataFrame, length: int) -> DataFrame:
    """Stretches (did, low, high) to remove: all but the first of equal strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(did: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
            did, low, high = united(did, low, high)
            yield from small(pa.RecordBatch.from_arrays([pa.array(did), pa.array(low), pa.array(high)], ["did", "low", "high"]))

        for g in whole_groups(batches, "part", 1 << 13):
            kind = g["kind"]
            s = kind == REMOVED
            yield from result(g["did"][s], g["low"][s], g["high"][s])
            # contexts give all strings in them, hot strings are there one by one, as numbers
            for s, width in ((kind == COLD_ASK, length), (kind == HOT_ASK, 8)):
                if s.any():
                    yield from result(*beyond_the_first(g["part"][s], g["did"][s], g["low"][s], g["bytes"][s], width, length))

    n = partitions(strings.sparkSession)
    return strings.repartition(n, "part").sortWithinPartitions("part", "kind").mapInArrow(run, "did bigint, low bigint, high bigint")


def repeated(docs: DataFrame, length: int = LENGTH, hot_here: int = HOT_HERE, hot: int = HOT) -> DataFrame:
    """(doc_id, text, spans array<struct<low, high>>) for docs (doc_id, text): the byte stretches of each text's UTF-8 that
    are covered by a string of `length` bytes that also starts earlier, in order, none touching another.

    Null text: empty. Rows that share a doc_id, or have none, are documents of their own, which follow each other in the order
    of their texts' hashes, those without id last; texts shorter than `length` have no span; an empty table gives no row;
    other columns are ignored.
    """
    prepare(docs.sparkSession)
    one, _, named = numbered(docs)
    one = one.repartition(partitions(docs.sparkSession), "did")
    # One plan: the texts are shuffled once, by document, and that exchange serves all three readers of `one`.
    asked = second_pass(first_pass(one, length, hot_here), hot)
    found = last_pass(last_digits(asked, one, length), length)
    spans = found.groupBy("did").agg(F.collect_list(F.struct("low", "high")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(2).to_pylist():
                if x:
                    low, high = np.array([s["low"] for s in x]), np.array([s["high"] for s in x])
                    _, low, high = united(np.zeros(len(x), np.int64), low, high)
                    x = [{"low": a, "high": z} for a, z in zip(low.tolist(), high.tolist(), strict=True)]
                out.append(x or [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())])))], ["doc_id", "text", "spans"])

    with_spans = one.join(spans, "did", "left").select("did", "text", "spans")
    out = with_spans.mapInArrow(run, "doc_id bigint, text string, spans array<struct<low:bigint,high:bigint>>")
    return named(out, "doc_id")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, bounds = text_bytes(b.column(1))
            n, gone, count, digest = [], [], [], []
            for i, spans in enumerate(b.column(2).to_pylist()):
                text = data[bounds[i] : bounds[i + 1]].tobytes()
                kept, at = hashlib.sha256(), 0
                for s in spans:
                    kept.update(text[at : s["low"]])
                    at = s["high"]
                kept.update(text[at:])
                n.append(len(text))
                gone.append(sum(s["high"] - s["low"] for s in spans))
                count.append(len(spans))
                digest.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, count)), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeated(documents(spark, sf_dir)).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


#: Texts and strings as BLOBs, places counted in bytes from 0; documents are taken to be shorter than 1 GB.
ORACLE = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, p, doc_id * 1000000000 + p AS place, b[p + 1 : p + 100] AS s FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 99)) AS p FROM d)),
f AS (SELECT s, min(place) AS first FROM w GROUP BY s HAVING count(*) > 1),
r AS (SELECT w.doc_id, w.p FROM w JOIN f USING (s) WHERE w.place <> f.first),
g AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM g),
s AS (SELECT doc_id, n, min(p) AS low, max(p) + 100 AS high FROM i GROUP BY doc_id, n),
k AS (SELECT doc_id, low, high, coalesce(lag(high) OVER (PARTITION BY doc_id ORDER BY low), 0) AS before FROM s),
c AS (
  SELECT d.doc_id, any_value(d.b) AS b, CAST(coalesce(sum(high - low), 0) AS BIGINT) AS n_removed, CAST(count(low) AS BIGINT) AS n_spans, CAST(coalesce(max(high), 0) AS BIGINT) AS last,
         coalesce(string_agg(CASE WHEN low > before THEN hex(d.b[before + 1 : low]) ELSE '' END, '' ORDER BY low), '') AS kept
  FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, n_removed, n_spans,
       sha256(unhex(kept || CASE WHEN octet_length(b) > last THEN hex(b[last + 1 : octet_length(b)]) ELSE '' END)) AS kept_sha256 FROM c
"""
