"""Operators on the small cases that tell right from wrong."""

from datetime import date

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from semspark import operators as O
from semspark.functions import basis_points_to_fraction, canonical_status, cents_to_amount, lifecycle_state
from semspark.operators.hierarchy import hierarchy_sql
from semspark.operators.snapshot import overlapping


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_densify_fills_absent_and_null(spark):
    fact = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", None, "y")], "d int, s string, n int, other string")
    grid = spark.createDataFrame([(d, "a") for d in (1, 2, 3)], "d int, s string")
    assert rows(O.densify(fact, "n", ["d", "s"], grid)) == [(1, "a", 5), (2, "a", 0), (3, "a", 0)]


def test_absence_average_of_a_month(spark):
    """Two rows in a month of 31 days: 5.0 among present rows, 10 / 31 with absence as zero."""
    fact = spark.createDataFrame([(3, 4), (17, 6)], "d int, n int")
    grid = spark.range(1, 32).select(F.col("id").cast("int").alias("d"))
    value = lambda m: O.absence_average(fact, "n", ["d"], grid, m).first().average
    assert value("structurally_untracked") == 5.0
    assert round(value("genuine_zero"), 2) == 0.32
    assert O.absence_average(fact, "n", ["d"], grid, "not_loaded", F.col("d") <= 20).first()[:] == (0.5, 31, 20)
    with pytest.raises(ValueError):
        value("other")


def test_scoped_latest(spark):
    df = spark.createDataFrame([("actual", date(2026, 3, 1), 1200.0), ("plan", date(2026, 12, 1), 900.0), (None, date(2027, 1, 1), 1.0)], "s string, m date, v double")
    assert O.scoped_latest(df, "m", {"s": "actual"}).first().latest == date(2026, 3, 1)
    assert O.scoped_latest(df, "m").first().latest == date(2027, 1, 1)
    assert O.scoped_latest(df, "m", {"s": "none"}).first().latest is None
    assert O.scoped_latest(df, "m", {"s": None}).first().latest == date(2027, 1, 1)


def test_stock_at_latest(spark):
    df = spark.createDataFrame([("w1", date(2026, 3, 30), 90, 1), ("w1", date(2026, 3, 31), 100, 2), ("w2", date(2026, 3, 31), 80, 3), ("w2", date(2026, 3, 31), 85, 4)], "w string, d date, n int, id int")
    assert O.value_at_latest(df, ["w"], "d", "n", "id").agg(F.sum("n")).first()[0] == 185


def test_closure(spark):
    df = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "c string")
    assert rows(O.closure_anomaly_check(df, "c", "closed", ["a", "b"])) == [("z",)]
    assert O.closure_anomaly_check(df, "c", "open", ["a"]) is None
    assert O.closure_anomaly_check(df, "c", "unknown", []) is None
    assert rows(O.closure_anomaly_check(df, "c", "closed", [])) == [("a",), ("b",), ("z",)]
    assert rows(O.closure_anomaly_check(df, "c", "closed", df.filter("c = 'z'"))) == [("a",), ("b",)]
    assert O.null_report(df, "c").first()[:] == (1, 4)
    with pytest.raises(ValueError):
        O.closure_anomaly_check(df, "c", "shut", [])


TREE = [("C1", None), ("C2", "C1"), ("C3", "C2"), ("C4", "C1"), ("X", None)]


def test_hierarchy(spark):
    df = spark.createDataFrame(TREE, "id string, parent string")
    assert rows(O.hierarchy_rollup(df, "id", "parent", "C1")) == [("C1",), ("C2",), ("C3",), ("C4",)]
    assert rows(O.hierarchy_rollup(df, "id", "parent", "none")) == []
    df.createOrReplaceTempView("tree_t")
    assert rows(spark.sql(hierarchy_sql("tree_t", "id", "parent"), args={"root": "C2"})) == [("C2",), ("C3",)]
    with pytest.raises(ValueError):
        hierarchy_sql("tree_t; drop", "id", "parent")


def test_hierarchy_with_cycle_and_two_parents(spark):
    df = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b"), ("d", "a"), ("d", "b")], "id string, parent string")
    assert rows(O.hierarchy_rollup(df, "id", "parent", "a")) == [("a",), ("b",), ("c",), ("d",)]


def test_snapshots(spark):
    v = spark.createDataFrame([(1, "x", date(2024, 1, 1), date(2024, 2, 1)), (1, "y", date(2024, 2, 1), None), (2, "z", date(2024, 1, 15), None)], "k int, v string, f date, t date")
    assert rows(O.as_of(v, "f", "t", date(2024, 2, 1)).select("k", "v")) == [(1, "y"), (2, "z")]
    assert rows(O.as_of(v, "f", "t", date(2024, 1, 1)).select("k", "v")) == [(1, "x")]
    assert rows(O.snapshot_collapse(v, ["k"], "f", ["v"]).select("k", "v")) == [(1, "y"), (2, "z")]
    assert "_rn" not in O.snapshot_collapse(v, ["k"], "f", ["v"]).columns
    assert overlapping(v, ["k"], "f", "t").count() == 0
    assert overlapping(v.unionByName(v.filter("v = 'y'")), ["k"], "f", "t").count() == 1
    with pytest.raises(ValueError):
        O.snapshot_collapse(v, ["k"], "f", [])


def test_bitemporal_price(spark):
    """The January price as known on January 10 is 12; after a correction on January 20 it is 11."""
    d = date
    p = spark.createDataFrame([("P", 12.0, d(2024, 1, 1), None, d(2024, 1, 1), d(2024, 1, 20)), ("P", 11.0, d(2024, 1, 1), None, d(2024, 1, 20), None)], "k string, price double, f date, t date, r date, s date")
    read = lambda at: O.bitemporal_as_of(p, ("f", "t"), ("r", "s"), d(2024, 1, 5), at).first().price
    assert read(d(2024, 1, 10)) == 12.0 and read(d(2024, 1, 25)) == 11.0


def test_per_fact_as_of(spark):
    f = spark.createDataFrame([(1, 5), (1, 15), (2, 5)], "k int, at int")
    v = spark.createDataFrame([(1, 0, 10, "old"), (1, 10, None, "new")], "k int, f int, t int, v string")
    assert rows(O.per_fact_as_of(f, v, ["k"], "at", "f", "t").select("k", "at", "v")) == [(1, 15, "new"), (1, 5, "old"), (2, 5, None)]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 6), st.integers(0, 50)), max_size=30))
def test_collapse_gives_one_row_a_key(spark, data):
    df = spark.createDataFrame(data, "k int, o int, t int")
    got = {r.k: (r.o, r.t) for r in O.snapshot_collapse(df, ["k"], "o", ["t"]).collect()}
    want = {}
    for k, o, t in data:
        want[k] = max(want.get(k, (-1, -1)), (o, t))
    assert got == want


def test_exclusion_drops_nulls_as_sql_does(spark):
    df = spark.createDataFrame([("a",), ("test1",), (None,)], "c string")
    assert rows(O.exclusion_filter(df, "c", not_like=["test%"])) == [("a",)]
    assert O.exclusion_filter(df, "c").count() == 3
    assert rows(O.exclusion_filter(df, "c", ["a"])) == [("test1",)]


def test_axis_default(spark):
    df = spark.createDataFrame([("actual", 1), ("plan", 2)], "s string, n int")
    d = O.axis_default(df, "s", "actual")
    assert d.applied and d.df.count() == 1 and "actual" in d.disclosure
    assert not O.axis_default(df, "s", "actual", bound=["s"]).applied


def test_ambiguity():
    assert O.ambiguity_gate("t", ["a", "b"]).action == "ask"
    assert O.ambiguity_gate("t", ["a", "b"], "b").value == "b"
    assert O.ambiguity_gate("t", ["a"], "wrong").value == "a"
    assert O.ambiguity_gate("t", []).action == "ask"
    values, asks = O.required_axes({"period": ("mandatory_no_default", None), "scenario": ("assumable_default", "actual"), "x": ("blocked", None)}, {"x": 1})
    assert values["scenario"] == "actual" and {a.term for a in asks} == {"period", "x"}


ALIASES = O.AliasTable(("CANCELLED", "RETURNED"), {"CANCELLED": {"multilingual": {"en": ["canceled"]}, "scope_relative": {"wholesale": ["rejected"]}}, "RETURNED": {"multilingual": {"en": ["sent back"], "de": ["canceled"]}}})


def test_aliases(spark):
    assert ALIASES.alias_resolve("cancelled").value == "CANCELLED"
    assert ALIASES.alias_resolve("rejected", "wholesale").value == "CANCELLED"
    assert ALIASES.alias_resolve("rejected").action == "ask"
    assert ALIASES.alias_resolve("canceled").action == "ask"
    assert ALIASES.alias_resolve(" Sent  Back ").value == "RETURNED"
    df = spark.createDataFrame([("rejected", "wholesale"), ("Rejected", "retail"), ("sent back", None), (None, None)], "w string, s string")
    assert [r.code for r in ALIASES.resolved(df, "w", "code", "s").collect()] == ["CANCELLED", None, "RETURNED", None]
    assert ALIASES.frame(spark).count() == 4
    assert O.relation_alias_resolve("Same Nation", {"e1": {"en": ["same nation"]}, "e2": {"en": ["other"]}}).value == "e1"


def test_registers(spark):
    reg = spark.createDataFrame([("kit", "p2", "Kit", "yes"), ("kit", "p1", "Kit", "no"), ("kit", "p1", "Kit", "no"), ("box", "p1", "Box", None)], "bundle string, product string, label string, featured string")
    got = rows(O.grouping_from_register(reg, "bundle", "product", ["label"]))
    assert got == [("box", ["p1"], "Box"), ("kit", ["p1", "p2"], "Kit")]
    assert rows(O.grouping_from_register(reg, ["bundle"], member="product")) == [("box", ["p1"]), ("kit", ["p1", "p2"])]
    codes = spark.createDataFrame([("a",), ("__total__",), (" ",), (None,), ("a",)], "code string")
    assert rows(O.enum_from_register(codes)) == [("a",)]


def test_two_refunds_dont_double_the_gross(spark):
    orders = spark.createDataFrame([(1, 100.0), (2, 50.0)], "id int, gross double")
    refunds = spark.createDataFrame([(1, 10.0), (1, 5.0)], "id int, amount double")
    r = O.pre_aggregated_left(orders, refunds, ["id"], {"refund": F.col("amount")})
    assert r.agg(F.sum("gross") - F.sum("refund")).first()[0] == 135.0


def test_relations(spark):
    p = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "sku int, cat string")
    assert rows(O.shared_attribute(p, "sku", "cat")) == [(1, 2), (2, 1)]
    fact = spark.createDataFrame([(1, 10.0), (2, 4.0)], "id int, v double")
    tags = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x")], "id int, tag string")
    assert O.has_member(fact, tags, "id", "tag", "x").count() == 2
    assert O.allocate(fact, tags, "id", "v").agg(F.sum("v")).first()[0] == 14.0


def test_transforms(spark):
    r = spark.createDataFrame([(700, 123456, " Shipped ", None), (99999999, 5, "??", date(2024, 1, 1))], "bps int, cents bigint, s string, d date")
    a = r.select(basis_points_to_fraction(F.col("bps")), cents_to_amount(F.col("cents")), canonical_status(F.col("s"), {"shipped": "SHIPPED"}, "UNKNOWN"), lifecycle_state([("d", "DONE")], "NEW")).collect()
    assert [str(x) for x in a[0]] == ["0.0700", "1234.56", "SHIPPED", "NEW"]
    assert [str(x) for x in a[1]][2:] == ["UNKNOWN", "DONE"]


def test_bindings(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("test", 3), ("z", 4)], "k string, v int")
    steps = [{"udf": "x.exclusion_filter", "params": {"column": "k", "not_like": ["te%"]}}, {"udf": "snapshot_collapse", "params": {"natural_key": ["k"], "order_by": "v", "tie": ["v"]}}]
    assert rows(O.realize(df, steps)) == [("a", 2), ("z", 4)]
    assert rows(O.realize(df, {"udf": "closure_anomaly_check", "params": {"column": "k", "closure": "closed", "register": "r"}}, {"r": df.filter("k <> 'z'").select("k")})) == [("z",)]
    assert O.realize(df, {"udf": "closure_anomaly_check", "params": {"column": "k", "closure": "open"}}).count() == 0
    tree = spark.createDataFrame(TREE, "id string, parent string")
    assert O.realize(tree, {"udf": "hierarchy_rollup", "params": {"id_col": "id", "parent_col": "parent"}}, root="C2").count() == 2
    with pytest.raises(KeyError):
        O.realize(df, {"udf": "additivity_guard"})


def test_mapped_and_federated_joins(spark):
    fact = spark.createDataFrame([("one", 1), ("two", 2), ("both", 3), (None, 4)], "w string, v int")
    mapping = spark.createDataFrame([("one", 1), ("one", 1), ("two", 2), ("both", 1), ("both", 2)], "w string, k int")
    dim = spark.createDataFrame([(1, "x"), (2, "y")], "k int, name string")
    assert rows(O.value_mapped_join(fact, "w", mapping.toDF("word", "to"), "word", "to", dim, "k").select("v", "name")) == [(1, "x"), (2, "y"), (3, None), (4, None)]
    alias = spark.createDataFrame([("one", 2), ("one", 2)], "left_id string, right_id int")
    assert rows(O.federated(fact, "w", alias, dim, "k").select("v", "name")) == [(1, "y")]
