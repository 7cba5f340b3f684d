"""Queries of the data-quality checks, the guards and the model's own tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from semspark import operators as O
from semspark import quality
from semspark.meta import META_TABLES, column_meanings, meta_tables
from semspark.plans import Intent, compile_intent
from semspark.plans.guards import additivity_guard, array_membership_guard, composite_key_guard, opaque_code_guard
from semspark.queries import ORACLES, QUERIES, catalog, query, retail, table, tpch
from semspark.second_reading import second_reading
from semspark.sources import build_view


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_uniqueness_lineitem(spark, d):
    return quality.duplicate_keys(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


FKS = [("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey")]


def _foreign_key(a: str, c: str, b: str, k: str):
    def orphans(spark, d):
        return quality.foreign_key_orphans(table(spark, d, a), [c], table(spark, d, b), [k])

    query(f"SELECT DISTINCT {c} FROM {a} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {b})", f"fk_integrity_{c}")(orphans)

    def most(spark, d):
        return quality.cardinality(table(spark, d, b), [k])

    query(f"SELECT max(n) AS most, count(*) AS keys FROM (SELECT count(*) AS n FROM {b} GROUP BY {k})", f"edge_cardinality_{c}")(most)


for fk in FKS:
    _foreign_key(*fk)


@query("SELECT count(*) FILTER (o_custkey IS NULL) AS o_custkey, count(*) FILTER (o_orderdate IS NULL) AS o_orderdate FROM orders")
def not_null_orders(spark, d):
    return quality.not_null(table(spark, d, "orders"), ["o_custkey", "o_orderdate"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_totalprice < 400000)")
def assertion_total_price(spark, d):
    return quality.assertion(table(spark, d, "orders"), "o_totalprice < 400000").select("o_orderkey", "o_totalprice")


@query("""SELECT round(a, 2) AS a, round(b, 2) AS b, round(a - b, 2) AS gap, round((a - b) / b, 6) AS share, false AS agrees
FROM (SELECT sum(l_extendedprice) AS a, sum(l_extendedprice * (1 - l_discount)) AS b FROM lineitem)""")
def reconcile_gross_net(spark, d):
    c = catalog(spark, d)
    gross, net = (compile_intent(tpch(), c, Intent(m)).df for m in ("GrossRevenue", "Revenue"))
    r = quality.reconcile(gross.toDF("v"), net.toDF("v"), "v")
    return r.select(F.round("a", 2).alias("a"), F.round("b", 2).alias("b"), F.round("gap", 2).alias("gap"), F.round("share", 6).alias("share"), "agrees")


@query("SELECT count(*) AS n, round(sum(l_extendedprice * (1 - round(l_discount, 4))), 2) AS net FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def transformed_lineitem(spark, d):
    """The lineitem pipeline, over raw lines whose discount is in basis points."""
    raw = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", F.round(F.col("l_discount") * 10000).cast("int").alias("l_discount_bps"))
    clean = build_view(spark, tpch(), tpch().transforms["tpch.lineitem_clean"], {"lineitem_raw": raw, "orders": table(spark, d, "orders")})
    return clean.agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount").cast("double"))), 2).alias("net"))


KEYS = [("customer", "c_custkey"), ("events", "event_id"), ("nation", "n_nationkey"), ("orders", "o_orderkey"), ("part", "p_partkey"), ("region", "r_regionkey"), ("supplier", "s_suppkey")]
PAIRS = "(SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem)"


def _offenders() -> str:
    parts = [f"SELECT 'unique' AS kind, 'partsupp' AS relation, 'ps_partkey,ps_suppkey' AS columns, count(*) AS offenders FROM (SELECT 1 FROM {PAIRS} GROUP BY ps_partkey, ps_suppkey HAVING count(*) > 1)"]
    parts += [f"SELECT 'unique', '{t}', '{k}', count(*) FROM (SELECT 1 FROM {t} GROUP BY {k} HAVING count(*) > 1)" for t, k in KEYS]
    fks = [*FKS, (PAIRS, "ps_partkey", "part", "p_partkey"), (PAIRS, "ps_suppkey", "supplier", "s_suppkey")]
    parts += [f"SELECT 'foreign_key', '{'partsupp' if a == PAIRS else a}', '{c}', count(DISTINCT {c}) FROM {a} WHERE {c} NOT IN (SELECT {k} FROM {b})" for a, c, b, k in fks]
    return " UNION ALL ".join(parts)


@query(_offenders())
def quality_report(spark, d):
    return quality.report(tpch(), catalog(spark, d).frames)


def _meta(name: str):
    def one(spark, d):
        said = [meta_tables(spark, m)[name].withColumn("model", F.lit(label)) for label, m in (("tpch", tpch()), ("retail", retail()))]
        return said[0].unionByName(said[1])

    query(second_reading(name), name)(one)


for name in META_TABLES:
    _meta(name)


@query(second_reading("meta_columns"))
def meta_columns(spark, d):
    said = [column_meanings(spark, m).withColumn("model", F.lit(label)) for label, m in (("tpch", tpch()), ("retail", retail()))]
    return said[0].unionByName(said[1])


SAID = {
    "additivity": "SUM(value) runs over ts (point_in_time); pin it to one value or group by it",
    "composite_key": "l_linenumber is used without its scope: l_orderkey",
    "opaque_code": "c_name is opaque: filter by c_mktsegment, not by a part of the code",
    "array_membership": "segments holds several values: test membership, not equality",
}


@query(f"""SELECT 'additivity' AS guard, '{SAID["additivity"]}' AS said, round(sum(value), 2) AS unsafe, round(sum(value) FILTER (ts = (SELECT max(ts) FROM events)), 2) AS safe FROM events
UNION ALL SELECT 'composite_key', '{SAID["composite_key"]}', count(*) FILTER (l_linenumber = 1), count(*) FILTER (l_linenumber = 1 AND l_orderkey = 1) FROM lineitem
UNION ALL SELECT 'opaque_code', '{SAID["opaque_code"]}', count(*) FILTER (c_name LIKE 'Customer#00%'), count(*) FILTER (c_mktsegment = 'BUILDING') FROM customer
UNION ALL SELECT 'array_membership', '{SAID["array_membership"]}', count(*) FILTER (n = 1 AND has), count(*) FILTER (has) FROM (SELECT count(DISTINCT c_mktsegment) AS n, bool_or(c_mktsegment = 'AUTOMOBILE') AS has FROM customer GROUP BY c_nationkey)""")
def guard_report(spark, d):
    """What each guard says of an unsafe question, what that question would have given, and what a safe one gives, of which the
    guard says nothing."""
    c, e, lines = (table(spark, d, n) for n in ("customer", "events", "lineitem"))
    latest = e.agg(F.max("ts")).first()[0]
    total, count = F.round(F.sum("value"), 2), F.count(F.lit(1)).cast("double")
    of_nation = c.groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("segments"))
    asked = [
        ("additivity", lambda q: additivity_guard(q, "value", {"ts": "point_in_time"}), e.agg(total.alias("v")), e.filter(F.col("ts") == F.lit(latest)).agg(total.alias("v"))),
        ("composite_key", lambda q: composite_key_guard(q, "l_linenumber", ["l_orderkey"]), lines.filter("l_linenumber = 1").agg(count.alias("v")), lines.filter("l_linenumber = 1 AND l_orderkey = 1").agg(count.alias("v"))),
        ("opaque_code", lambda q: opaque_code_guard(q, "c_name", "c_mktsegment"), c.filter(F.col("c_name").startswith("Customer#00")).agg(count.alias("v")), c.filter("c_mktsegment = 'BUILDING'").agg(count.alias("v"))),
        ("array_membership", lambda q: array_membership_guard(q, "segments"), of_nation.filter(F.col("segments") == F.array(F.lit("AUTOMOBILE"))).agg(count.alias("v")), of_nation.filter(F.array_contains("segments", "AUTOMOBILE")).agg(count.alias("v"))),
    ]
    out = None
    for name, guard, unsafe, safe in asked:
        said = "; ".join(guard(unsafe)) + "".join(f" (safe: {v})" for v in guard(safe))
        row = unsafe.select(F.lit(name).alias("guard"), F.lit(said).alias("said"), F.col("v").alias("unsafe")).withColumn("safe", safe.scalar())
        out = row if out is None else out.unionByName(row)
    return out


@query("SELECT answer, n FROM (VALUES ('Ask', 1), ('NotDerivable', 2)) t(answer, n)")
def refusals(spark, d):
    """An ambiguous path, a missing path, and a grouping that would multiply rows."""
    c = catalog(spark, d)
    asked = [Intent("Revenue", ("Nation.n_name",)), Intent("Revenue", ("MarketSegment.code",)), Intent(count="Customer", partition=("Orders.o_orderpriority",))]
    names = [type(compile_intent(tpch(), c, i)).__name__ for i in asked]
    return spark.createDataFrame([(n, names.count(n)) for n in sorted(set(names))], "answer string, n int")


__all__ = ["O", "ORACLES", "QUERIES"]
