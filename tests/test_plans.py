"""Paths, compilation, refusals and guards."""

from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from semspark.functions import predicate
from semspark.plans import Answer, Ask, Catalog, Intent, NotDerivable, compile_intent, find_path, period
from semspark.plans.guards import additivity_guard, array_membership_guard, composite_key_guard, join_clauses, lineage, opaque_code_guard
from semspark.queries import catalog, tpch


def test_periods():
    assert (period("1995", "c").start, period("1995", "c").end) == (date(1995, 1, 1), date(1996, 1, 1))
    assert (period("2026-Q1", "c").start, period("2026-Q4", "c").end) == (date(2026, 1, 1), date(2027, 1, 1))
    assert period("2024-12", "c").end == date(2025, 1, 1)
    assert period("2024-02-29", "c").end == date(2024, 3, 1)
    with pytest.raises(ValueError):
        period("spring", "c")


def test_paths():
    m = tpch()
    assert isinstance(find_path(m, "LineItem", "Nation"), Ask)
    ids = [e.edge_id for _, e, _ in find_path(m, "LineItem", "Region", ("Supplier",))]
    assert ids == ["lineitem__supplied_via__partsupp", "partsupp__from__supplier", "supplier__from__nation", "nation__in__region"]
    assert [e.edge_id for _, e, _ in find_path(m, "LineItem", "Part", ("Supplier",))] == ["lineitem__supplied_via__partsupp", "partsupp__of__part"]
    assert isinstance(find_path(m, "LineItem", "MarketSegment"), NotDerivable)
    assert find_path(m, "Part", "Part") == []


def test_provenance_and_disclosure(spark, sf_dir):
    a = compile_intent(tpch(), catalog(spark, sf_dir), Intent("Revenue", ("Region.r_name",), window=period("1995", "Orders.o_orderdate"), via=("Customer",)))
    assert isinstance(a, Answer)
    assert {c.element for c in a.provenance} >= {"edge lineitem__part_of__orders", "rule net_revenue", "concept Revenue"}
    assert a.disclosures == ("revenue without a qualifier is net of discount",)


def test_filters_reach_the_scan(spark, sf_dir):
    a = compile_intent(tpch(), catalog(spark, sf_dir), Intent("Revenue", restrict={"Region.r_name": "EUROPE"}, window=period("1995", "Orders.o_orderdate"), via=("Customer",)))
    plan = a.df._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(r_name), EqualTo(r_name,EUROPE)" in plan and "GreaterThanOrEqual(o_orderdate" in plan
    assert "l_comment" not in plan and "p_name" not in plan


@pytest.mark.parametrize(
    ("intent", "kind", "word"),
    [
        (Intent("Revenue", ("Nation.n_name",)), Ask, "via"),
        (Intent("Revenue", ("MarketSegment.code",)), NotDerivable, "no column"),
        (Intent("Nothing"), NotDerivable, "no concept"),
        (Intent("Customer"), NotDerivable, "no measure"),
        (Intent(count="Customer", partition=("Orders.o_orderpriority",)), NotDerivable, "count some twice"),
        (Intent("Revenue", restrict={"Part.p_name": "x"}), NotDerivable, "attribute"),
        (Intent("Revenue", restrict={"LineItem.l_tax": 0.1}), NotDerivable, "measure"),
        (Intent("Revenue", rules=("no.such.rule",)), NotDerivable, "no rule"),
        (Intent("Revenue", rules=("lineitem.revenue.net_of_discount",)), NotDerivable, "executable"),
        (Intent(), NotDerivable, "measure or a count"),
        (Intent("Discount", ("LineItem.l_returnflag",), fold="sum"), NotDerivable, "averageable"),
    ],
)
def test_refusals(spark, sf_dir, intent, kind, word):
    a = compile_intent(tpch(), catalog(spark, sf_dir), intent)
    assert isinstance(a, kind) and word in a.reason


def test_a_stock_needs_its_time_pinned(spark):
    m = tpch()
    c = m.concepts["Balance"]
    doc = {**c.doc, "x-axis_columns": {"time": "c_day", "customer": "c_custkey"}}
    table = replace(m.tables["customer"], columns=(*m.tables["customer"].columns, {"name": "c_day", "type": "date", "role": "value"}))
    m = replace(m, concepts={**m.concepts, "Balance": replace(c, doc=doc)}, tables={**m.tables, "customer": table})
    df = spark.createDataFrame([(1, "a", 1, 5.0, "AUTOMOBILE", date(2024, 1, d)) for d in (1, 2)], "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string, c_day date")
    cat = Catalog(spark, {"customer": df})
    assert isinstance(compile_intent(m, cat, Intent("Balance")), NotDerivable)
    assert compile_intent(m, cat, Intent("Balance", restrict={"Customer.c_day": date(2024, 1, 2)})).df.first().balance == 5.0
    assert compile_intent(m, cat, Intent("Balance", ("Customer.c_day",))).df.count() == 2


def test_default_axis_and_required_axis(spark, sf_dir):
    m = tpch()
    c = m.concepts["LineItem"]

    def with_axes(axes):
        return replace(m, concepts={**m.concepts, "LineItem": replace(c, doc={**c.doc, "x-axes": axes})})

    cat = catalog(spark, sf_dir)
    a = compile_intent(with_axes({"l_linestatus": {"policy": "assumable_default", "default": "F"}}), cat, Intent("GrossRevenue"))
    assert "assumed" in a.disclosures[0]
    assert a.df.first()[0] == pytest.approx(cat["lineitem"].filter("l_linestatus = 'F'").agg(F.sum("l_extendedprice")).first()[0])
    by = compile_intent(with_axes({"l_linestatus": {"policy": "assumable_default", "default": "F"}}), cat, Intent("GrossRevenue", ("LineItem.l_linestatus",)))
    assert by.df.count() == 2 and not by.disclosures
    assert isinstance(compile_intent(with_axes({"l_linestatus": {"policy": "mandatory_no_default"}}), cat, Intent("GrossRevenue")), Ask)


def test_a_null_discount_is_none(spark):
    lines = spark.createDataFrame([(1, 100.0, 0.1), (1, 50.0, None)], "l_orderkey bigint, l_extendedprice double, l_discount double")
    assert compile_intent(tpch(), Catalog(spark, {"lineitem": lines}), Intent("Revenue")).df.first()[0] == pytest.approx(140.0)


def test_predicate_reads_only_what_it_binds():
    assert predicate("lineitem.state.fulfilled", ["l_linestatus"]) is not None
    assert predicate("nobody.knows", []) is None
    with pytest.raises(ValueError):
        predicate("lineitem.state.fulfilled", ["l_tax"])


@pytest.fixture
def stock(spark):
    df = spark.createDataFrame([(date(2024, 1, 1), "w", "p", 5)], "day date, w string, p string, units int")
    df.createOrReplaceTempView("stock")
    return df


def test_additivity_guard(spark, stock):
    effects = {"day": "point_in_time"}
    bad = additivity_guard(stock.groupBy("w").agg(F.sum("units")), "units", effects)
    assert len(bad) == 1 and "day" in bad[0]
    assert not additivity_guard(stock.filter(F.col("day") == F.lit(date(2024, 1, 1))).agg(F.sum("units")), "units", effects)
    assert not additivity_guard(stock.groupBy("day").agg(F.sum("units")), "units", effects)
    assert additivity_guard(stock.filter(F.col("day") >= F.lit(date(2024, 1, 1))).agg(F.sum("units")), "units", effects)
    assert additivity_guard(stock.filter((F.col("day") == F.lit(date(2024, 1, 1))) | (F.col("w") == "w")).agg(F.sum("units")), "units", effects)
    assert additivity_guard(stock.filter(F.col("day") == F.col("day")).agg(F.sum("units")), "units", effects)
    assert additivity_guard(stock.select((F.col("units") * 2).alias("twice"), "w").groupBy("w").agg(F.sum("twice")), "units", effects)
    assert not additivity_guard(stock.groupBy("w").agg(F.max("units")), "units", effects)
    assert additivity_guard(stock.groupBy("day").agg(F.sum("units")), "units", {"day": "averageable"})
    assert not additivity_guard(stock.groupBy("day").agg(F.sum("units")), "units", {"day": "non_aggregable"})
    assert additivity_guard(stock.groupBy("day").agg(F.sum("units")), "units", {"day": "non_aggregable"}, strict=True)
    assert additivity_guard("SELECT w, SUM(units) FROM anything GROUP BY w", "units", effects, spark)
    assert not additivity_guard("SELECT SUM(units) FROM anything WHERE day = DATE '2024-01-01'", "units", effects, spark)
    # what a subquery pins isn't pinned outside
    assert additivity_guard("SELECT SUM(units) FROM a WHERE w IN (SELECT w FROM b WHERE day = DATE '2024-01-01')", "units", effects, spark)


def test_composite_key_guard(spark, stock):
    assert composite_key_guard(stock.filter("p = 'p'"), "p", ["w"])
    assert not composite_key_guard(stock.filter("p = 'p' and w = 'w'"), "p", ["w"])
    assert composite_key_guard(stock.groupBy("p").count(), "p", ["w"])
    assert not composite_key_guard(stock.groupBy("p", "w").count(), "p", ["w"])
    assert not composite_key_guard(stock.select("p"), "p", ["w"])
    assert composite_key_guard("SELECT * FROM t WHERE size_code = 'M'", "size_code", ["brand"], spark)
    assert not composite_key_guard("SELECT * FROM t WHERE size_code = 'M' AND brand = 'x'", "size_code", ["brand"], spark)


def test_opaque_and_membership_guards(spark, stock):
    assert opaque_code_guard(stock.filter("p like 'AB%'"), "p", "category")
    assert opaque_code_guard(stock.filter(F.substring("p", 1, 2) == "AB"), "p", "category")
    assert not opaque_code_guard(stock.filter("p = 'AB'"), "p", "category")
    assert opaque_code_guard("SELECT * FROM t WHERE code LIKE 'A%'", "code", "category", spark)
    tags = stock.withColumn("tags", F.array(F.lit("x")))
    assert array_membership_guard(tags.filter(F.col("tags") == F.array(F.lit("x"))), "tags")
    assert not array_membership_guard(tags.filter(F.array_contains("tags", "x")), "tags")


def test_lineage_and_join_rules(spark, stock):
    assert "stock" in lineage(spark.sql("SELECT w FROM stock"))
    assert join_clauses(spark, "a.x = b.y AND a.z = b.w") == [(("a", "x"), ("b", "y")), (("a", "z"), ("b", "w"))]
    assert join_clauses(spark, "a line belongs to its order") is None


def test_rule_of_a_registered_function(spark):
    from semspark.functions import spark_udf
    from semspark.model import Rule

    m = tpch()
    spark_udf("net", lambda price, discount: price * (1 - F.coalesce(discount, F.lit(0.0))))
    rule = Rule("by_function", "Revenue", ("LineItem",), "spark_udf", None, {"x-udf": {"name": "net", "columns": ["l_extendedprice", "l_discount"]}})
    c = m.concepts["Revenue"]
    m = replace(m, rules={**m.rules, "by_function": rule}, concepts={**m.concepts, "Revenue": replace(c, doc={**c.doc, "derived_by_rule": "by_function"})})
    lines = spark.createDataFrame([(1, 100.0, 0.1), (1, 50.0, None)], "l_orderkey bigint, l_extendedprice double, l_discount double")
    assert compile_intent(m, Catalog(spark, {"lineitem": lines}), Intent("Revenue")).df.first()[0] == pytest.approx(140.0)
    spec = Rule("only_said", "Revenue", ("LineItem",), "spec_only", None, {})
    m = replace(m, rules={**m.rules, "by_function": spec})
    assert isinstance(compile_intent(m, Catalog(spark, {"lineitem": lines}), Intent("Revenue")), NotDerivable)


def test_value_filter_and_unsupported_grounding(spark, sf_dir):
    m = tpch()
    c = m.concepts["Customer"]
    scoped = replace(m, concepts={**m.concepts, "Customer": replace(c, doc={**c.doc, "grounding": {**c.grounding, "value_filter": "c_mktsegment = 'BUILDING'"}})})
    cat = catalog(spark, sf_dir)
    assert compile_intent(scoped, cat, Intent(count="Customer")).df.first().n == cat["customer"].filter("c_mktsegment = 'BUILDING'").count()
    other = replace(m, concepts={**m.concepts, "Customer": replace(c, doc={**c.doc, "grounding": {**c.grounding, "kind": "api"}})})
    assert isinstance(compile_intent(other, cat, Intent(count="Customer")), NotDerivable)
