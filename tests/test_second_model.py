"""Templates with conditionals, groupings, lists, guarantees, impurities, bounded histories, cards, plan shapes."""

from dataclasses import replace
from datetime import date

import pytest
from pyspark.sql import functions as F

from semspark import operators as O
from semspark import quality
from semspark.functions import rendered
from semspark.gates import check_all
from semspark.meta import concept_cards, descriptor_cards, write_cards
from semspark.plans import Answer, Catalog, Intent, NotDerivable, compile_intent, period
from semspark.plans.compiler import derived_set
from semspark.queries import catalog, retail, tpch


def test_second_model_is_sound():
    assert check_all(retail()) == [] and len(retail().concepts) == 9


@pytest.mark.parametrize(
    ("template", "given", "text", "bound"),
    [
        ("a {% if x %}b{% else %}c{% endif %} d", {"x": 1}, "a b d", {}),
        ("a {% if x %}b{% else %}c{% endif %} d", {}, "a c d", {}),
        ("{% if not x %}n{% endif %}{% if x %}{% if y %}xy{% endif %}x{% endif %}", {"x": 0, "y": None}, "x", {}),
        ("p >= {{ low }} AND q = :high -- :gone {{ away }}", {"low": 3, "high": "'; DROP"}, "p >= _bound_low AND q = _bound_high ", {"_bound_low": 3, "_bound_high": "'; DROP"}),
        ("{% if x %}{{ missing }}{% endif %}k::int", {}, "k::int", {}),
    ],
)
def test_templates(template, given, text, bound):
    assert rendered(template, given) == (text, bound)


def test_templates_that_are_wrong():
    for t in ("{% if x %}a", "a{% endif %}", "{% else %}"):
        with pytest.raises(ValueError):
            rendered(t, {})
    with pytest.raises(KeyError):
        rendered("{{ x }}", {})
    assert rendered("a = {{ x }}", {"x": 1}, ":{}") == ("a = :x", {"x": 1})


def test_values_are_bound_never_spliced(spark, sf_dir):
    c = catalog(spark, sf_dir)
    assert derived_set(retail(), c, "large_articles", {"least": 1, "type": "PROMO' OR '1' = '1"}).count() == 0
    a = compile_intent(retail(), c, Intent("Turnover", window=period("1996", "Sale.l_shipdate")))
    want = c["lineitem"].filter((F.col("l_shipdate") >= F.lit(date(1996, 1, 1))) & (F.col("l_shipdate") < F.lit(date(1997, 1, 1)))).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))).first()[0]
    assert a.df.first()[0] == pytest.approx(want) and "{%" not in str(a.provenance)


def test_groupings(spark, sf_dir):
    c = catalog(spark, sf_dir)
    by = {r.ArticleLine: r.n for r in compile_intent(retail(), c, Intent(count="Sale", partition=("ArticleLine",))).df.collect()}
    assert set(by) == {"A", "B", "C"} and sum(by.values()) == c["lineitem"].count()
    found = compile_intent(retail(), c, Intent(count="Sale", partition=("ArticleGrade",)))
    assert isinstance(found, NotDerivable) and "several groups" in found.reason
    m = retail()
    bare = replace(m, concepts={**m.concepts, "ArticleLine": replace(m.concepts["ArticleLine"], doc={**m.concepts["ArticleLine"].doc, "members": {"over": "Article"}})})
    assert isinstance(compile_intent(bare, c, Intent(count="Sale", partition=("ArticleLine",))), NotDerivable)


def test_lists_are_tested_for_membership(spark):
    cat = Catalog(spark, {"nation_segments": spark.createDataFrame([(1, ["a", "b"]), (2, ["b"]), (3, []), (4, None)], "nationkey bigint, segments array<string>")})
    count = lambda v: compile_intent(retail(), cat, Intent(count="Assortment", restrict={"Assortment.segments": v})).df.first().n
    assert (count("b"), count("a"), count(["a", "z"]), count("z"), count(None)) == (2, 1, 1, 0, 1)


def test_guarantees(spark):
    lines = spark.createDataFrame([(1.0, 0.1, 5.0), (-1.0, None, 50.0), (None, 2.0, None)], "l_extendedprice double, l_discount double, l_quantity double")
    got = {r.rule_id: r.offenders for r in quality.guarantees(retail(), {"lineitem": lines}).collect()}
    assert got == {"sale.amount.never_negative": 2, "sale.discount.is_a_share": 1, "sale.quantity.below_forty": 2}
    assert quality.guarantees(tpch(), {"lineitem": lines}).count() == 0


def test_dispositions(spark):
    df = spark.createDataFrame([("P-1",), ("P-TEST-1",), ("P-MISC",), (None,)], "id string")
    test, misc = F.col("id").like("P-TEST%"), F.col("id") == "P-MISC"
    assert O.dispose(df, [O.Impurity("test", test, "bake")]).df.count() == 3
    d = O.dispose(df, [O.Impurity("test", test, "bake"), O.Impurity("misc", misc, "register", note="under review")])
    assert d.counted().first()[:] == (3, 1) and d.caveats == ("rows marked misc are included: under review",)
    assert O.dispose(df, [O.Impurity("misc", misc, "register", sure=misc)]).counted().first()[:] == (3, 0)
    assert isinstance(O.dispose(df, [O.Impurity("misc", misc, "block")]), NotDerivable)
    with pytest.raises(ValueError):
        O.dispose(df, [O.Impurity("misc", misc, "hide")])


def test_histories_end(spark):
    df = spark.createDataFrame([("Kitchen", "Home")], "now string, before string")
    assert O.value_before(df, "category", ["now", "before"], 1).first().value == "Home"
    assert isinstance(O.value_before(df, "category", ["now", "before"], 2), NotDerivable)
    with pytest.raises(ValueError):
        O.value_before(df, "category", ["now"], -1)


def test_absence_without_a_grid(spark):
    axes = {"d": spark.range(4).select(F.col("id").alias("day")), "u": spark.range(5).select(F.col("id").alias("user"))}
    fact = spark.createDataFrame([(0, 0, 4.0), (1, 2, None), (3, 4, 6.0), (9, 0, 100.0)], "d bigint, u bigint, n double")
    assert O.absence_average_over(fact, "n", axes).first()[:] == (0.5, 5.0, 20, 2)
    assert O.absence_average_over(fact, "n", {"d": axes["d"].filter("day > 100"), "u": axes["u"]}).first()[:] == (None, None, 0, 0)


def test_allocation_counts_members_once(spark):
    fact, bridge = spark.createDataFrame([(1, 9.0), (2, 4.0)], "k int, v double"), spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, "c")], "k int, m string")
    assert sorted(r[:] for r in O.allocate(fact, bridge, "k", "v").collect()) == [(1, 3.0, "a"), (1, 3.0, "b"), (1, 3.0, "c")]


def test_cards(tmp_path):
    cards = concept_cards(tpch())
    assert "derived    net_revenue" in cards["Revenue"] and "edge       lineitem__part_of__orders (N:1): LineItem -> Orders" in cards["Orders"]
    assert "leads      l_orderkey -> orders.o_orderkey" in descriptor_cards(tpch())["lineitem"]
    assert len(write_cards(tpch(), tmp_path)) == 27 and (tmp_path / "concepts" / "Region.md").is_file()


def test_keys_at_hand_need_no_join(spark, sf_dir):
    """Pairs of the fact's own keys are passed through: the fact is read once, and nothing is made distinct."""
    a = compile_intent(tpch(), catalog(spark, sf_dir), Intent("Revenue", ("Part.p_brand",), {"Region.r_name": "ASIA"}, via=("Supplier",)))
    plan = a.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1 and plan.count("HashAggregate") == 2


def test_restrictions_are_joined_before_the_fact(spark, sf_dir):
    """The branch with a restriction is filtered at its far end and is the first to meet the fact."""
    a = compile_intent(tpch(), catalog(spark, sf_dir), Intent(count="LineItem", partition=("Orders.o_orderpriority", "Part.p_brand"), restrict={"Part.p_type": "PROMO"}, via=("Customer",)))
    assert isinstance(a, Answer)
    plan = a.df._jdf.queryExecution().analyzed().toString()
    assert plan.rindex("Join") < plan.index("Filter") and plan.index("Relation [p_partkey") < plan.index("Relation [o_orderkey")
    assert a.df.agg(F.sum("n")).first()[0] == catalog(spark, sf_dir)["lineitem"].join(catalog(spark, sf_dir)["part"].filter("p_type = 'PROMO'"), F.col("l_partkey") == F.col("p_partkey")).count()


def test_hierarchies_are_lazy(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("a", "c")], "id string, parent string")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "")
    out = O.hierarchy_rollup(df, "id", "parent", "a")
    assert list(jobs.getJobIdsForGroup("building")) == []
    spark.sparkContext.setJobGroup("other", "")
    assert sorted(r.id for r in out.collect()) == ["a", "b", "c"]
