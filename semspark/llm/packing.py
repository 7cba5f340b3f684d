"""Best-fit packing of tokenised documents by hierarchical residual packing.

Tokens: ids are those of the vocabulary file's tokenizer. Its merges run in a faster engine where that is proven to give the
same ids (see Tokens); other texts go to the tokenizer itself.

Packing: partitions pack their pieces by best fit, longest first. Bins that are nearly full are final. Underfull bins
become items of the next round, in an eighth as many partitions, until one is left; what counts as nearly full doubles
its slack each round, so that what goes up the tree stays a few bins for each partition.
"""

from __future__ import annotations

import functools
import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from semspark.llm.common import documents, prepare, stage, texts

CAPACITY = 1024
END = 2
ITEMS_PER_TASK = 50_000
FAN_IN = 8
SLACK = 16


@functools.cache
def unsure() -> np.ndarray:
    """Code points that some version of Unicode's tables may class otherwise than another: letter, number, blank or neither."""
    def kind(category: str) -> str:
        return {"L": "letter", "N": "number", "Z": "blank"}.get(category[0], "other")

    old = unicodedata.ucd_3_2_0
    sure = lambda c: (was := old.category(c))[0] != "C" and kind(was) == kind(unicodedata.category(c))
    out = np.fromiter((not sure(chr(c)) for c in range(0x110000)), bool, 0x110000)
    out[9:14] = False
    return out


class Tokens:
    """Token ids of texts, equal to Tokenizer.encode(text, add_special_tokens=False).

    Byte-pair encoding may be run by merging, again and again, the two neighbours whose joint bytes are the token of the
    lowest id (as tiktoken does), instead of the lowest listed pair. Both give the same ids if a token's id is that of
    its merge, each merge joins tokens of lower ids, and the tokenizer encodes each token's bytes as this token. For
    suppose a first difference: all merges below some id are done alike, and neighbours p, q, which aren't a listed pair,
    have the joint bytes of that id's token. No merge has crossed their outer edges, so the token's bytes alone would
    also have come to p, q, and no listed merge would make them one; but the tokenizer encodes them as one token. All
    this is checked when a file is loaded; where it doesn't hold the tokenizer does everything. It also gets texts with
    special tokens in them or with code points whose class isn't the same in all versions of Unicode.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            self.engine = self.fast(json.load(f))

    def fast(self, spec: dict) -> tiktoken.Encoding | None:
        model, cutter = spec["model"], spec.get("pre_tokenizer") or {}
        plain = not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) and not spec.get("normalizer") and not spec.get("post_processor")
        if model.get("type", "BPE") != "BPE" or not plain or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex"):
            return None
        own = {t["content"] for t in spec.get("added_tokens", [])}
        ids = {k: i for k, i in model["vocab"].items() if k not in own}
        # a byte-level vocabulary writes each byte as one character: printable ones as themselves, the others from 256 on
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {chr(b): b for b in seen} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(seen))}
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        if len(ids) != 256 + len(pairs) or any(c not in ids or ids[c] >= 256 for c in letter):
            return None
        if any(ids.get(a + b) != 256 + n or not max(ids.get(a, 1 << 60), ids.get(b, 1 << 60)) < 256 + n for n, (a, b) in enumerate(pairs)):
            return None
        if any([t.id for t in self.tokenizer.model.tokenize(k)] != [i] for k, i in ids.items()):
            return None
        return tiktoken.Encoding("merges", pat_str=public_tokenizers.PATTERN, mergeable_ranks={bytes(letter[c] for c in k): i for k, i in ids.items()}, special_tokens={})

    def many(self, found: list[str]) -> list[bytes]:
        """Each text's ids, as little-endian unsigned 32-bit numbers."""
        return [self.one(t) for t in found]

    def one(self, text: str) -> bytes:
        odd = self.engine is None or any(s in text for s in self.special) or unsure()[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any()
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids if odd else self.engine.encode_to_numpy(text, disallowed_special=())
        return np.asarray(ids, "<u4").tobytes()


@functools.cache
def tokens(path: str) -> Tokens:
    return Tokens(path)


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The token pieces of docs (doc_id, text). Null and empty texts are the end token alone. Only documents of more than
    `capacity` tokens are cut; the first piece has what is left over, the others are full."""
    prepare(docs.sparkSession)
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = tokens(path)
        mark = np.array([end], "<u4").tobytes()
        for b in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for d, ids in zip(b.column(0).to_pylist(), coder.many([t or "" for t in texts(b)]), strict=True):
                whole = ids + mark
                total = len(whole) // 4
                at, n = 0, total % capacity or capacity
                while at < total:
                    doc.append(d)
                    piece.append(piece[-1] + 1 if at else 0)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(whole[4 * at : 4 * (at + n)]))
                    at, n = at + n, capacity
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For items, in the order given: each one's bin and offset; and each bin's fill."""
    bins, offsets, fill = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, n in enumerate(lengths.tolist()):
        m = mask >> n
        if m:
            r = n + (m & -m).bit_length() - 1
            b = free[r].pop()
            if not free[r]:
                mask ^= 1 << r
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        if r > n:
            free[r - n].append(b)
            mask |= 1 << (r - n)
    return bins, offsets, np.array(fill, np.int64)


def pack(items: DataFrame, capacity: int = CAPACITY, per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """items (length, and columns that go along) with sequence_id and offset; no length may pass capacity or be under 1."""
    spark = items.sparkSession
    prepare(spark)
    full = items.filter(F.col("length") == capacity).withColumns({"sequence_id": F.monotonically_increasing_id() * 2, "offset": F.lit(0).cast("bigint")})
    rest = items.filter(F.col("length") < capacity)
    tasks = max(1, -(-rest.count() // per_task))
    names = rest.columns
    schema = T.StructType(list(rest.schema.fields)).add("bin", "long").add("offset", "long").add("fill", "long")

    def packed(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            parts = list(batches)
            if not sum(p.num_rows for p in parts):
                return
            t = pa.Table.from_batches(parts)
            at = t.schema.get_field_index("length")
            order = np.lexsort([*(t.column(i).fill_null(-1).to_numpy() for i in range(t.num_columns) if i != at), -t.column(at).to_numpy()])
            t = t.take(pa.array(order))
            bins, offsets, fill = best_fit(t.column(at).to_numpy(), capacity)
            own = (level << 56 | TaskContext.get().partitionId() << 32) + bins
            for name, x in (("bin", own), ("offset", offsets), ("fill", fill[bins])):
                t = t.append_column(name, pa.array(x))
            yield from t.to_batches(max_chunksize=10_000)

        return run

    # rows that are alike in all columns are spread too: a third of a table may be empty texts without id
    key = F.xxhash64(*(c for c in names if c != "length"), F.monotonically_increasing_id())
    done = stage(rest.repartition(tasks, key).mapInArrow(packed(1), schema))
    under = done.filter(capacity - F.col("fill") > SLACK).groupBy("bin").agg(F.first("fill").alias("length"))
    level, maps = 1, []
    while tasks > 1:
        tasks, level = -(-tasks // FAN_IN), level + 1
        moved = stage(under.select("bin", "length").withColumnRenamed("bin", "was").repartition(tasks, F.xxhash64("was")).mapInArrow(packed(level), "was bigint, length bigint, bin bigint, offset bigint, fill bigint"))
        maps.append(moved)
        under = moved.filter(capacity - F.col("fill") > SLACK << (level - 1)).groupBy("bin").agg(F.first("fill").alias("length"))
    for moved in maps:
        m = moved.select("was", F.col("bin").alias("_bin"), F.col("offset").alias("_base"))
        done = done.join(m, done.bin == m.was, "left").withColumns({"bin": F.coalesce("_bin", "bin"), "offset": F.col("offset") + F.coalesce("_base", F.lit(0).cast("bigint"))}).drop("was", "_bin", "_base")
    return full.unionByName(done.withColumn("sequence_id", F.col("bin") * 2 + 1).drop("bin", "fill"))


def packed_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every row of docs, packed.

    Null and empty texts give one piece of one token; repeated rows give their pieces again; a null doc_id stays null;
    an empty table gives no row; other columns are ignored.
    """
    return pack(stage(pieces(docs, vocabulary, capacity)), capacity)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(documents(spark, sf_dir))
