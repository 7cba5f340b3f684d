"""The engine's queries over the driver's tables, and the same in DuckDB's SQL. Money is summed in doubles and rounded to
2 decimals on both sides; every column is aliased alike."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from semspark import operators as O
from semspark.functions import basis_points_to_fraction, canonical_status, fold
from semspark.model import Model, load
from semspark.operators.hierarchy import hierarchy_sql
from semspark.operators.latest import at_latest
from semspark.plans import Answer, Catalog, Intent, compile_intent, period
from semspark.plans.compiler import related

Query = Callable[[SparkSession, str], DataFrame]
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: Schemas by session, path and time of change, as a catalog keeps them: a file's footer is read for its schema once.
_SCHEMAS: dict[tuple[str, str, int], StructType] = {}


def changed(spark: SparkSession, path: str) -> int:
    """When a file or folder was last changed, in milliseconds, by the file system that has it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(place).getModificationTime()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path, changed(spark, path))
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


@functools.cache
def tpch() -> Model:
    return load(Path(__file__).resolve().parent.parent / "models" / "tpch")


@functools.cache
def retail() -> Model:
    return load(Path(__file__).resolve().parent.parent / "models" / "retail")


class Frames(Mapping):
    """The driver's tables, each read when it is asked for; and two views: partsupp, the distinct pairs of order lines, and
    nation_segments, the market segments of a nation's customers."""

    VIEWS = ("partsupp", "nation_segments")

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self.read = spark, sf_dir, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.read:
            if name == "partsupp":
                self.read[name] = self["lineitem"].select(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey")).distinct()
            elif name == "nation_segments":
                self.read[name] = self["customer"].groupBy(F.col("c_nationkey").cast("bigint").alias("nationkey")).agg(F.collect_set("c_mktsegment").alias("segments"))
            elif name in TABLES:
                self.read[name] = table(self.spark, self.sf_dir, name)
            else:
                raise KeyError(name)
        return self.read[name]

    def __contains__(self, name: object) -> bool:
        return name in self.VIEWS or name in TABLES

    def __iter__(self):
        return iter((*TABLES, *self.VIEWS))

    def __len__(self) -> int:
        return len(TABLES) + len(self.VIEWS)


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(spark, Frames(spark, sf_dir))


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return keep


def answered(spark: SparkSession, sf_dir: str, intent: Intent, model: Callable[[], Model] = tpch) -> DataFrame:
    found = compile_intent(model(), catalog(spark, sf_dir), intent)
    if not isinstance(found, Answer):
        raise ValueError(f"no answer: {found}")
    return found.df


def money(c: str, out: str | None = None) -> Column:
    return F.round(F.col(c), 2).alias(out or c)


PATH = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
NET = "round(sum(l_extendedprice * (1 - l_discount)), 2) AS net_revenue"

# ---- compiled from intents


@query(f"SELECT r_name, {NET} FROM {PATH} GROUP BY r_name")
def net_revenue_by_region(spark, d):
    return answered(spark, d, Intent("Revenue", ("Region.r_name",), via=("Customer",))).select("r_name", money("net_revenue"))


@query("SELECT n_name, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_linestatus = 'F' GROUP BY n_name")
def fulfilled_lines_by_nation(spark, d):
    return answered(spark, d, Intent(count="LineItem", partition=("Nation.n_name",), via=("Customer",), rules=("lineitem.state.fulfilled",)))


@query(f"SELECT {NET} FROM {PATH} WHERE r_name = 'EUROPE' AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'")
def net_revenue_europe_1995(spark, d):
    return answered(spark, d, Intent("Revenue", restrict={"Region.r_name": "EUROPE"}, window=period("1995", "Orders.o_orderdate"), via=("Customer",))).select(money("net_revenue"))


@query(f"SELECT p_brand, {NET} FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY p_brand")
def net_revenue_by_brand_asia(spark, d):
    return answered(spark, d, Intent("Revenue", ("Part.p_brand",), {"Region.r_name": "ASIA"}, via=("Supplier",))).select("p_brand", money("net_revenue"))


RETURNED = "orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice) AS returned FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) ON o_orderkey = l_orderkey"


@query(f"SELECT round(sum(o_totalprice) - sum(coalesce(returned, 0)), 2) AS net FROM {RETURNED} WHERE o_orderstatus <> 'P'")
def net_of_refunds(spark, d):
    return answered(spark, d, Intent("SettledRevenue")).select(money("net_of_returns", "net"))


@query(f"SELECT c_mktsegment, round(sum(o_totalprice) - sum(coalesce(returned, 0)), 2) AS net FROM {RETURNED} JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY c_mktsegment")
def net_of_refunds_by_segment(spark, d):
    return answered(spark, d, Intent("SettledRevenue", ("Customer.c_mktsegment",))).select("c_mktsegment", money("net_of_returns", "net"))


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def customers_per_nation(spark, d):
    return answered(spark, d, Intent(count="Customer", partition=("Nation.n_name",)))


@query("SELECT n_name, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def balance_by_nation(spark, d):
    return answered(spark, d, Intent("Balance", ("Nation.n_name",))).select("n_name", money("balance"))


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT') GROUP BY n_name")
def customers_with_urgent_orders(spark, d):
    """A restriction across a one-to-many edge: a semi join."""
    return answered(spark, d, Intent(count="Customer", partition=("Nation.n_name",), restrict={"Orders.o_orderpriority": "1-URGENT"}))


@query("SELECT p_type, median(l_discount) AS discount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type")
def median_discount_by_type(spark, d):
    return answered(spark, d, Intent("Discount", ("Part.p_type",), fold="median"))


@query("SELECT n_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'AUTOMOBILE' GROUP BY n_name")
def segment_by_alias(spark, d):
    """'cars' resolves to the segment AUTOMOBILE before anything is filtered."""
    doc = tpch().concepts["MarketSegment"].doc["values"]
    code = O.AliasTable(tuple(tpch().concepts["MarketSegment"].codes), doc["aliases"]["map"]).alias_resolve("cars").value
    c = catalog(spark, d)
    rows = c["orders"].join(c["customer"].filter(F.col("c_mktsegment") == F.lit(code)), F.col("o_custkey") == F.col("c_custkey")).join(c["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy("n_name").agg(F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT a.s_suppkey, b.s_suppkey AS related_suppkey FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
def related_suppliers(spark, d):
    return related(tpch(), catalog(spark, d), "supplier__shares_nation__supplier")


@query("SELECT a.s_suppkey, b.s_suppkey AS related FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
def shared_attribute_suppliers(spark, d):
    return O.shared_attribute(table(spark, d, "supplier"), "s_suppkey", "s_nationkey")


@query("SELECT round((SELECT sum(l_extendedprice) FROM lineitem), 2) AS gross, round((SELECT sum(l_extendedprice * (1 - l_discount)) FROM lineitem), 2) AS net")
def gross_vs_net(spark, d):
    gross, net = (answered(spark, d, Intent(m)) for m in ("GrossRevenue", "Revenue"))
    return spark.range(1).select(F.round(gross.scalar(), 2).alias("gross"), F.round(net.scalar(), 2).alias("net"))


# ---- operators


def daily(spark, d) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events").withColumn("day", F.to_date("ts"))
    return e, e.select("day").distinct()


@query("""SELECT CAST(day AS VARCHAR) AS day, event_type, coalesce(n, 0) AS n FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events) CROSS JOIN (SELECT DISTINCT event_type FROM events)
LEFT JOIN (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL) USING (day, event_type)""")
def densified_daily_events(spark, d):
    e, days = daily(spark, d)
    fact = e.groupBy("day", "event_type").agg(F.count("*").alias("n"))
    return O.densify(fact, "n", ["day", "event_type"], O.cross_grid(days, e.select("event_type").distinct())).withColumn("day", F.col("day").cast("string"))


@query("""WITH f AS (SELECT CAST(ts AS DATE) AS day, user_id, count(*) AS n FROM events GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT day FROM f) CROSS JOIN (SELECT DISTINCT user_id FROM f))
SELECT round(avg(coalesce(n, 0)), 6) AS densified, round(avg(n), 6) AS present_only, count(*) AS cells, count(n) AS present FROM g LEFT JOIN f USING (day, user_id)""")
def avg_with_absence(spark, d):
    e, days = daily(spark, d)
    fact = e.groupBy("day", "user_id").agg(F.count("*").alias("n"))
    found = O.absence_average_over(fact, "n", {"day": days, "user_id": e.select("user_id")})
    return found.select(F.round("average", 6).alias("densified"), "cells", "present", F.round("average_present", 6).alias("present_only"))


@query("SELECT max(ts) AS latest FROM events WHERE event_type = 'purchase'")
def latest_purchase(spark, d):
    return O.scoped_latest(table(spark, d, "events"), "ts", {"event_type": "purchase"})


@query("SELECT max(ts) AS latest FROM events")
def unscoped_latest(spark, d):
    return O.scoped_latest(table(spark, d, "events"), "ts")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase' AND ts = (SELECT max(ts) FROM events WHERE event_type = 'purchase')")
def rows_at_latest_purchase(spark, d):
    return at_latest(table(spark, d, "events"), "ts", {"event_type": "purchase"}).select("event_id", "user_id")


@query("SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('click', 'view', 'purchase', 'signup')")
def event_type_anomalies(spark, d):
    return O.closure_anomaly_check(table(spark, d, "events"), "event_type", "closed", ["click", "view", "purchase", "signup"])


@query("SELECT DISTINCT l_returnflag FROM lineitem WHERE l_returnflag NOT IN ('R', 'A', 'N')")
def returnflag_anomalies(spark, d):
    c = tpch().concepts["ReturnFlag"]
    return O.closure_anomaly_check(table(spark, d, "lineitem"), "l_returnflag", c.closure, c.codes)


@query("SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)")
def register_anomalies(spark, d):
    known = table(spark, d, "nation").filter("n_regionkey <> 2").select("n_nationkey")
    return O.closure_anomaly_check(table(spark, d, "customer"), "c_nationkey", "closed", known)


@query("SELECT count(*) FILTER (l_discount IS NULL) AS nulls, count(*) AS rows FROM lineitem")
def null_report_discount(spark, d):
    return O.null_report(table(spark, d, "lineitem"), "l_discount")


TREE = "(SELECT 'R' || r_regionkey AS id, NULL AS parent FROM region UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation)"


def tree(spark, d) -> DataFrame:
    r = table(spark, d, "region").select(F.concat(F.lit("R"), "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parent"))
    n = table(spark, d, "nation").select(F.concat(F.lit("N"), "n_nationkey").alias("id"), F.concat(F.lit("R"), "n_regionkey").alias("parent"))
    return r.unionByName(n)


@query(f"WITH RECURSIVE t AS (SELECT * FROM {TREE}), s(id) AS (SELECT id FROM t WHERE id = 'R3' UNION SELECT t.id FROM t JOIN s ON t.parent = s.id) SELECT id FROM s")
def region_subtree(spark, d):
    return O.hierarchy_rollup(tree(spark, d), "id", "parent", "R3")


@query(f"WITH RECURSIVE t AS (SELECT * FROM {TREE}), s(id) AS (SELECT id FROM t WHERE id = 'R3' UNION SELECT t.id FROM t JOIN s ON t.parent = s.id) SELECT id FROM s")
def region_subtree_recursive(spark, d):
    tree(spark, d).createOrReplaceTempView("region_tree")
    return spark.sql(hierarchy_sql("region_tree", "id", "parent"), args={"root": "R3"})


@query(f"WITH RECURSIVE t AS (SELECT * FROM {TREE}), s(id) AS (SELECT id FROM t WHERE id = 'R3' UNION SELECT t.id FROM t JOIN s ON t.parent = s.id) SELECT {NET} FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE 'N' || c_nationkey IN (SELECT id FROM s)")
def revenue_in_subtree(spark, d):
    nodes = O.hierarchy_rollup(tree(spark, d), "id", "parent", "R3")
    buyers = O.in_subtree(table(spark, d, "customer").withColumn("node", F.concat(F.lit("N"), "c_nationkey")), "node", nodes)
    orders = table(spark, d, "orders").join(buyers, F.col("o_custkey") == F.col("c_custkey"), "left_semi")
    rows = table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("net_revenue"))


@query("SELECT user_id, event_id, event_type, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_event_per_user(spark, d):
    return O.snapshot_collapse(table(spark, d, "events"), ["user_id"], "ts", ["event_id"]).select("user_id", "event_id", "event_type", "ts")


VERSIONS = "(SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ts_end FROM events)"


def versions(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("ts_end", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))


def instant(day: int) -> Column:
    return F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp_ntz")


@query(f"SELECT user_id, event_id, round(value, 4) AS value FROM {VERSIONS} WHERE ts <= TIMESTAMP '2024-01-15' AND (ts_end IS NULL OR ts_end > TIMESTAMP '2024-01-15')")
def events_as_of(spark, d):
    return O.as_of(versions(spark, d), "ts", "ts_end", instant(15)).select("user_id", "event_id", F.round("value", 4).alias("value"))


@query(f"SELECT user_id, event_id FROM {VERSIONS} WHERE ts <= TIMESTAMP '2024-01-15' AND (ts_end IS NULL OR ts_end > TIMESTAMP '2024-01-15') AND ts + INTERVAL 1 DAY <= TIMESTAMP '2024-01-16' AND (ts_end IS NULL OR ts_end + INTERVAL 1 DAY > TIMESTAMP '2024-01-16')")
def bitemporal_as_of(spark, d):
    v = versions(spark, d).withColumns({"rec": F.expr("ts + INTERVAL 1 DAY"), "rec_end": F.expr("ts_end + INTERVAL 1 DAY")})
    return O.bitemporal_as_of(v, ("ts", "ts_end"), ("rec", "rec_end"), instant(15), instant(16)).select("user_id", "event_id")


@query(f"SELECT e.event_id, v.event_id AS version FROM (SELECT * FROM events WHERE event_type = 'error') e JOIN {VERSIONS} v ON e.user_id = v.user_id AND v.ts <= e.ts + INTERVAL 1 HOUR AND (v.ts_end IS NULL OR v.ts_end > e.ts + INTERVAL 1 HOUR)")
def per_fact_as_of(spark, d):
    facts = table(spark, d, "events").filter("event_type = 'error'").select("event_id", "user_id", F.expr("ts + INTERVAL 1 HOUR").alias("at"))
    v = versions(spark, d).select("user_id", F.col("event_id").alias("version"), F.col("ts").alias("from_ts"), "ts_end")
    return O.per_fact_as_of(facts, v, ["user_id"], "at", "from_ts", "ts_end", "inner").select("event_id", "version")


@query("SELECT p_partkey, p_name FROM part WHERE p_type NOT IN ('PROMO') AND p_brand NOT LIKE 'Brand#1%'")
def exclusion_parts(spark, d):
    return O.exclusion_filter(table(spark, d, "part"), "p_brand", not_like=["Brand#1%"]).transform(lambda x: O.exclusion_filter(x, "p_type", ["PROMO"])).select("p_partkey", "p_name")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_returnflag")
def default_axis(spark, d):
    return O.axis_default(table(spark, d, "lineitem"), "l_linestatus", "F", bound=["l_returnflag"]).df.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT s_nationkey, array_to_string(list_sort(list(DISTINCT s_name)), ',') AS members, min(s_suppkey) AS first_key FROM supplier GROUP BY s_nationkey")
def supplier_set_by_nation(spark, d):
    reg = table(spark, d, "supplier").withColumn("first_key", F.col("s_suppkey"))
    return O.grouping_from_register(reg, "s_nationkey", "s_name", ["first_key"]).select("s_nationkey", F.array_join("members", ",").alias("members"), "first_key")


@query("SELECT DISTINCT n_name FROM nation")
def enum_from_nation_register(spark, d):
    return O.enum_from_register(table(spark, d, "nation"), "n_name")


@query("""WITH g AS (SELECT 'geo' AS scheme, r_name AS namespace, n_nationkey % 3 AS code, count(DISTINCT n_name) AS member_count FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT a.scheme, a.namespace, CAST(a.code AS VARCHAR) AS code, a.member_count, (SELECT coalesce(string_agg(b.scheme || ':' || b.namespace || ':' || b.code, ',' ORDER BY b.scheme || ':' || b.namespace || ':' || b.code), '') FROM g b WHERE b.code = a.code AND b.namespace <> a.namespace) AS collides_with FROM g a""")
def colliding_groupings(spark, d):
    reg = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    reg = reg.select(F.lit("geo").alias("scheme"), F.col("r_name").alias("namespace"), (F.col("n_nationkey") % 3).cast("string").alias("code"), "n_name")
    return O.composite_groupings(reg, "scheme", "namespace", "code", "n_name").withColumn("collides_with", F.array_join("collides_with", ","))


@query("SELECT count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE c_nationkey = n_nationkey AND r_name = 'ASIA')")
def customers_by_region_semi(spark, d):
    bridge = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    return O.has_member(table(spark, d, "customer"), bridge, "c_nationkey", "r_name", "ASIA").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def orders_with_returns(spark, d):
    bridge = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return O.has_member(table(spark, d, "orders"), bridge, "o_orderkey", "l_returnflag", "R").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def orders_without_lines(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("""WITH b AS (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem), n AS (SELECT l_orderkey, count(*) AS n FROM b GROUP BY l_orderkey)
SELECT l_returnflag, CAST(round(sum(CAST(o_totalprice / n AS DECIMAL(20,6))), 2) AS DOUBLE) AS allocated FROM orders JOIN n ON o_orderkey = l_orderkey JOIN b USING (l_orderkey) GROUP BY l_returnflag""")
def allocated_revenue(spark, d):
    bridge = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag")
    return O.allocate(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), bridge, "o_orderkey", "o_totalprice").groupBy("l_returnflag").agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(20,6)")), 2).cast("double").alias("allocated"))


@query("SELECT event_type, round(sum(value), 2) AS value FROM (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY ALL) GROUP BY event_type")
def balance_period_end(spark, d):
    return O.value_at_latest(table(spark, d, "events"), ["user_id", "event_type"], "ts", "value", "event_id").groupBy("event_type").agg(F.round(F.sum("value"), 2).alias("value"))


@query("""WITH s AS (SELECT o_orderpriority, o_orderstatus, sum(o_totalprice) AS total, count(*) AS n FROM orders GROUP BY ALL)
SELECT o_orderpriority, round(sum(total) / sum(n), 4) AS mean FROM s GROUP BY o_orderpriority""")
def summary_ratio(spark, d):
    s = table(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.sum("o_totalprice").alias("total"), F.count("*").alias("n"))
    return O.ratio_of_sums(s, ["o_orderpriority"], "total", "n", "mean").withColumn("mean", F.round("mean", 4))


@query("SELECT count(DISTINCT l_orderkey) AS orders, count(DISTINCT CASE WHEN l_returnflag = 'R' THEN l_orderkey END) AS returned FROM lineitem")
def distinct_case_count(spark, d):
    return table(spark, d, "lineitem").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct(F.when(F.col("l_returnflag") == "R", F.col("l_orderkey"))).alias("returned"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS BIGINT) AS k FROM events GROUP BY event_type")
def json_prop_sum(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("int")).alias("k"))


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'CLOSED' WHEN 'P' THEN 'PARTIAL' ELSE 'OPEN' END AS state, count(*) AS n FROM orders GROUP BY ALL")
def lifecycle_state(spark, d):
    from semspark.functions import lifecycle_state as state

    o = table(spark, d, "orders").withColumns({"partial_at": F.when(F.col("o_orderstatus").isin("P"), F.col("o_orderdate")), "closed_at": F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))})
    return o.groupBy(state([("partial_at", "PARTIAL"), ("closed_at", "CLOSED")], "OPEN").alias("state")).agg(F.count("*").alias("n"))


@query("SELECT kind, label, id FROM (SELECT 'customer' AS kind, c_name AS label, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_name, s_suppkey FROM supplier)")
def discriminated_union(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    refs = c.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id")).unionByName(s.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id")))
    return O.discriminated_union(refs, "kind", "id", {"customer": (c, "c_custkey", "c_name"), "supplier": (s, "s_suppkey", "s_name")}).select("kind", "label", "id")


@query("""SELECT 'order' AS role, CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
UNION ALL SELECT 'ship', CAST(year(l_shipdate) AS INTEGER), count(*) FROM lineitem GROUP BY ALL""")
def role_playing_dates(spark, d):
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return O.by_role({"order": (rows, F.year("o_orderdate")), "ship": (lines, F.year("l_shipdate"))}, "y")


@query("SELECT l_orderkey, count(*) AS n, round(sum(l_extendedprice), 2) AS gross FROM lineitem GROUP BY l_orderkey")
def degenerate_grain(spark, d):
    """The order's number is an axis that lies in the fact: no table is joined for it."""
    gross = answered(spark, d, Intent("GrossRevenue", ("LineItem.l_orderkey",))).select("l_orderkey", money("gross_revenue", "gross"))
    return gross.join(answered(spark, d, Intent(count="LineItem", partition=("LineItem.l_orderkey",))), "l_orderkey")


@query("SELECT round(avg(p_size), 6) AS size FROM part WHERE p_type = 'PROMO'")
def subtype_scoped_avg(spark, d):
    return answered(spark, d, Intent("ArticleSize", restrict={"Article.p_type": "PROMO"}), retail).select(F.round("article_size", 6).alias("size"))


@query("SELECT median(l_discount) AS median, quantile_cont(l_discount, 0.9) AS p90 FROM lineitem")
def median_discount(spark, d):
    return table(spark, d, "lineitem").agg(fold("median", F.col("l_discount")).alias("median"), fold("percentile", F.col("l_discount"), 0.9).alias("p90"))


@query("SELECT p_partkey, p_name FROM part WHERE p_brand = 'Brand#2' AND p_size BETWEEN 10 AND 20 AND p_type <> 'PROMO'")
def curated_attribute_filter(spark, d):
    kept = O.attribute_filter(table(spark, d, "part"), equal={"p_brand": "Brand#2"}, between={"p_size": (10, 20)})
    return O.exclusion_filter(kept, "p_type", ["PROMO"]).select("p_partkey", "p_name")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))")
def junk_dimension_flags(spark, d):
    return O.flag_counts(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"])


@query("SELECT round(sum(l_quantity * l_extendedprice), 2) AS payload FROM lineitem")
def associative_payload(spark, d):
    return answered(spark, d, Intent("Payload"), retail).select(money("payload"))


@query("SELECT o_orderstatus, round(avg(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))), 6) AS days, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linestatus = 'F' GROUP BY o_orderstatus")
def milestone_lag(spark, d):
    from semspark.functions import milestone_lag as lag

    rows = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).withColumn("shipped", F.when(F.col("l_linestatus") == "F", F.to_date("l_shipdate")))
    return rows.filter("shipped is not null").withColumn("placed", F.to_date("o_orderdate")).groupBy("o_orderstatus").agg(F.round(F.avg(lag("placed", "shipped")), 6).alias("days"), F.count("*").alias("n"))


@query("SELECT l_returnflag, CAST(CAST(sum(CAST(round(l_discount * 10000) AS BIGINT)) AS DECIMAL(30,4)) / 10000 AS DOUBLE) AS discounts, count(*) FILTER (CAST(round(l_discount * 10000) AS BIGINT) % 100 <> 0) AS uneven FROM lineitem GROUP BY l_returnflag")
def transform_discount_bps(spark, d):
    bps = F.round(F.col("l_discount") * 10000).cast("int")
    fraction = basis_points_to_fraction(bps)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(fraction).cast("double").alias("discounts"), F.count(F.when(fraction * 100 != F.floor(fraction * 100), 1)).alias("uneven"))


@query("SELECT CASE lower(trim(event_type)) WHEN 'click' THEN 'CLICK' WHEN 'view' THEN 'VIEW' WHEN 'purchase' THEN 'PURCHASE' ELSE 'OTHER' END AS status, count(*) AS n FROM events GROUP BY ALL")
def transform_status_canonical(spark, d):
    raw = F.concat(F.lit(" "), F.upper("event_type"))
    return table(spark, d, "events").groupBy(canonical_status(raw, {"click": "CLICK", "view": "VIEW", "purchase": "PURCHASE"}, "OTHER").alias("status")).agg(F.count("*").alias("n"))


def _bound_to(concept: str, sql: str, name: str) -> None:
    """The check that a model's enumeration binds, as its file says."""

    def run(spark, d):
        binding = tpch().concepts[concept].doc["values"]["realized_by"]
        return O.realize(table(spark, d, binding["params"]["table"]), binding)

    query(sql, name)(run)


_bound_to("LineStatus", "SELECT DISTINCT l_linestatus FROM lineitem WHERE l_linestatus NOT IN ('O', 'F')", "bound_linestatus_anomalies")
_bound_to("OrderStatus", "SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'F', 'P')", "bound_orderstatus_anomalies")
_bound_to("MarketSegment", "SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')", "bound_segment_anomalies")


@query("""WITH f AS (SELECT * FROM events WHERE event_type NOT IN ('error') AND event_type = 'purchase')
SELECT user_id, event_id FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def composed_binding(spark, d):
    """Three operators bound in order: an exclusion, a default, a collapse."""
    steps = [
        {"udf": "exclusion_filter", "params": {"column": "event_type", "not_in": ["error"]}},
        {"udf": "any.namespace.axis_default", "params": {"axis_column": "event_type", "default_value": "purchase"}},
        {"udf": "snapshot_collapse", "params": {"natural_key": "user_id", "order_by": "ts", "tie": ["event_id"]}},
    ]
    return O.realize(table(spark, d, "events"), steps).select("user_id", "event_id")


@query("SELECT o_orderpriority, n_name, count(*) AS n FROM orders LEFT JOIN nation ON n_nationkey = CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AND o_orderpriority <> '5-LOW' GROUP BY ALL")
def value_mapped_key(spark, d):
    """Priorities spelled as text meet nations by number through a mapping; the one that maps to two keys counts as unmapped."""
    orders, nation = table(spark, d, "orders"), table(spark, d, "nation")
    words = orders.select("o_orderpriority").distinct()
    mapping = words.select(F.col("o_orderpriority").alias("word"), F.substring("o_orderpriority", 1, 1).cast("int").alias("k"))
    mapping = mapping.unionByName(mapping.filter("word = '5-LOW'").withColumn("k", F.lit(17)))
    return O.value_mapped_join(orders, "o_orderpriority", mapping, "word", "k", nation, "n_nationkey").groupBy("o_orderpriority", "n_name").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT o_custkey AS c_custkey, l_suppkey AS s_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = l_suppkey")
def federation_alias(spark, d):
    """Customers that bought from the supplier of their own number are taken to be the same party."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    own = table(spark, d, "orders").join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).filter("o_custkey = l_suppkey")
    alias = own.select(F.col("o_custkey").alias("left_id"), F.col("l_suppkey").alias("right_id"))
    return O.federated(c, "c_custkey", alias, s, "s_suppkey").select("c_custkey", "s_suppkey")


@query("SELECT kind, n FROM (VALUES ('ask', 1), ('resolve', 1)) t(kind, n)")
def ambiguity_decisions(spark, d):
    asked = O.ambiguity_gate("revenue", ["net", "gross"]).action
    pinned = O.ambiguity_gate("revenue", ["net", "gross"], "net").action
    return spark.createDataFrame([(asked, 1), (pinned, 1)], "kind string, n int")


@query("SELECT o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderdate >= TIMESTAMP '1996-04-01' AND o_orderdate < TIMESTAMP '1996-07-01' GROUP BY o_orderpriority ORDER BY total DESC")
def quarter_totals(spark, d):
    w = period("1996-Q2", "o_orderdate")
    rows = table(spark, d, "orders").filter((F.col(w.column) >= F.lit(w.start)) & (F.col(w.column) < F.lit(w.end)))
    return rows.groupBy("o_orderpriority").agg(F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.desc("total"))


# quality, guards and the model as tables register themselves
from semspark import queries_model, queries_retail  # noqa: E402, F401

__all__ = ["ORACLES", "QUERIES", "catalog", "date", "datetime", "retail", "tpch"]
