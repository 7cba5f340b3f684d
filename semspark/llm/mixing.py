"""Mixing sources to target weights by capped water-filling. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semspark.llm.common import aside, documents, partitions, prepare, stage

WORD = r"[^\x20\x09-\x0D]+"
#: The seeded order is a 30-bit key, cut at the point where a source's share is full in three passes of 10 bits.
BITS, PASSES = 10, 3
#: Rows of one per source that are broadcast, and ranked in one task; beyond that they are joined by shuffling, and ranked in
#: ranges.
BROADCAST_SOURCES = 10_000


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")


def seeded(seed: int, doc_id: str = "doc_id", text: str = "text") -> Column:
    """48 bits of a hash of seed, id and text: the order in which a source's documents get their fractional repetition."""
    value = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 12), 16, 10).cast("bigint")


def sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.withColumns({"_size": words(), "_order": seeded(seed)})


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with sums over all rows before each, in an order that no two rows share: ranges are summed up on their own, and
    each gets what the ranges before it hold (one row for each range)."""
    n = partitions(rows.sparkSession)
    placed = stage(rows.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_part").agg(*(F.sum(c).alias(k) for k, c in sums.items()))
    offsets = totals.select("_part", *(F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(f"_{k}_ahead") for k in sums))
    both = placed.withColumns({k: F.coalesce(F.sum(c).over(within), F.lit(0)) for k, c in sums.items()}).join(F.broadcast(offsets), "_part")
    return both.select(*rows.columns, *((F.col(k) + F.col(f"_{k}_ahead")).alias(k) for k in sums))


def targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, source_size, target) of sized rows: weights repeat over the sources by code point, null last; a target
    stops at `most` times its source's size, and the excess goes to the others by weight.

    With the sources ordered by the level at which they are full, and the first k full, the level is what is left over
    the weights left; it rises while the next source would overflow and falls from there on, so the largest one holds.
    """
    by = stage(sizes.groupBy("source").agg(F.sum("_size").alias("source_size")))
    first, cap = F.col("source").asc_nulls_last(), (F.col("source_size") * most).alias("cap")
    weight = lambda n: F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int")).cast("bigint").alias("w")
    if by.count() > BROADCAST_SOURCES:
        by = stage(running(by, [first], {"n": F.lit(1)}).select("source", "source_size", weight(F.col("n")), cap))
        by = running(by, [(F.col("cap") / F.col("w")).asc(), first], {"full": F.col("cap"), "used": F.col("w")})
        by = stage(by)
        every = by.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
        level = by.agg(F.max((F.lit(every.size) - F.col("full")) / (F.lit(every.w) - F.col("used"))).alias("level")).first().level
        return by.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.lit(level)).alias("target"))
    every = Window.partitionBy()
    by = by.select("source", "source_size", weight(F.row_number().over(Window.orderBy(first)) - 1), cap)
    before = Window.orderBy((F.col("cap") / F.col("w")).asc(), first).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    shares = F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))
    by = by.withColumn("level", left / shares)
    return by.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.max("level").over(every)).alias("target"))


def beside(rows: DataFrame, sources: DataFrame, many: bool) -> DataFrame:
    right = sources.withColumnRenamed("source", "_source")
    return rows.join(right if many else F.broadcast(right), rows.source.eqNullSafe(right._source)).drop("_source")


def plan(sizes: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, bool]:
    """For each source: source_size, target, whole repetitions, and the key of the seeded order up to which documents
    get one more (those at the key itself share `rest` words); and if the sources are too many to broadcast."""
    t = targets(sizes, weights, most).withColumn("goal", F.round("target").cast("bigint"))
    whole = F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(0)
    s = stage(t.withColumn("whole", whole).withColumns({"rest": F.col("goal") - F.col("whole") * F.col("source_size"), "cut": F.lit(0).cast("bigint")}).drop("goal"))
    many = s.count() > BROADCAST_SOURCES
    for done in range(PASSES):
        key = F.col("_order").bitwiseAND((1 << 48) - 1)
        place = F.shiftright(key, 48 - BITS * (done + 1)).bitwiseAND((1 << BITS) - 1)
        over = F.shiftright(key, 48 - BITS * done) if done else F.lit(0).cast("bigint")
        rows = beside(sizes, s, many).filter((F.col("rest") > 0) & (over == F.col("cut"))).select("source", place.alias("place"), "_size")
        sums = rows.groupBy("source", "place").agg(F.sum("_size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("place"))
        hit = sums.withColumn("upto", upto).join(s.select(F.col("source").alias("_source"), F.col("rest").alias("_rest")), F.col("source").eqNullSafe(F.col("_source")))
        hit = hit.filter("upto >= _rest and upto - n < _rest").select("_source", "place", (F.col("_rest") - F.col("upto") + F.col("n")).alias("_left"))
        s = stage(
            s.join(hit, s.source.eqNullSafe(hit._source), "left")
            .withColumns({"cut": F.col("cut") * (1 << BITS) + F.coalesce("place", F.lit(0)), "rest": F.coalesce("_left", F.lit(0).cast("bigint"))})
            .select("source", "source_size", "target", "whole", "rest", "cut")
        )
    return s, many


def taken(rows: DataFrame, sources: DataFrame, many: bool) -> DataFrame:
    """rows with source_size, target, _taken: their whole repetitions' words, and those of the fractional one."""
    b = beside(rows, sources, many).withColumn("_key", F.shiftright("_order", 48 - BITS * PASSES))
    open_ = F.col("rest") > 0
    clear = b.filter(~(open_ & (F.col("_key") == F.col("cut")))).withColumn("_more", F.when(open_ & (F.col("_key") < F.col("cut")), F.col("_size")).otherwise(0))
    ordered = Window.partitionBy("source").orderBy("_order", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    at = b.filter(open_ & (F.col("_key") == F.col("cut"))).withColumn("_before", F.coalesce(F.sum("_size").over(ordered), F.lit(0)))
    at = at.withColumn("_more", F.greatest(F.lit(0), F.least(F.col("_size"), F.col("rest") - F.col("_before")))).drop("_before")
    return clear.unionByName(at).withColumn("_taken", F.col("whole") * F.col("_size") + F.col("_more"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs (doc_id, text, source).

    Every document is taken whole as many times as its source's target holds its size; the rest goes to documents in
    a seeded order, the last one giving only its first words, so that a source's words are its target, rounded. Null and
    blank texts have size 0 and give nothing; a null source is one source; repeated rows each count; an empty table
    gives no row; other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = stage(sized(docs.select("doc_id", "text", "source"), seed).drop("text"))
    sources, many = plan(rows, weights, most)
    return taken(rows, sources, many).select("doc_id", F.col("_size").alias("size"), "source_size", "target", F.col("_taken").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: int = 7) -> DataFrame:
    """The mix itself: docs' columns, a row for each repetition taken; of a partly taken document, the first words."""
    prepare(docs.sparkSession)
    rows = sized(aside(docs, "doc_id", "text", "source"), seed)
    sources, many = plan(stage(rows.select("doc_id", "source", "_size", "_order")), weights, most)
    t = taken(rows, sources, many)
    first = F.array_join(F.slice(F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda x: x != ""), 1, F.greatest(F.col("_more"), F.lit(1)).cast("int")), " ")
    part = (F.col("_more") > 0) & (F.col("_more") < F.col("_size"))
    copies = F.flatten(F.array(F.array_repeat("text", F.col("whole").cast("int")), F.when(part, F.array(first)).otherwise(F.array_repeat("text", F.when(F.col("_more") > 0, 1).otherwise(0)))))
    # a blank text has no word to take or leave: it stays once
    t = t.select("_row", F.explode(F.when(F.col("_size") == 0, F.array("text")).otherwise(copies)).alias("_text"))
    changed = {"text": F.col("_text"), "n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else F.lit(None)}
    return t.select(*(changed.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))


ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 12) AS BIGINT) AS o
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS level
  FROM s WINDOW b AS (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), w * max(level) OVER ()) AS target FROM l),
g AS (
  SELECT *, CAST(round(target) AS BIGINT) AS goal, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.whole, g.goal - g.whole * g.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM r
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
