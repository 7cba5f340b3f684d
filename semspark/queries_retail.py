"""Queries over the second model, of what the first has no case for: groupings, templates with conditionals, lists, promises,
impurities, bounded histories; and the gates and projections as tables."""

from __future__ import annotations

import copy
from dataclasses import replace

import yaml
from pyspark.sql import functions as F

from semspark import gates, project, quality
from semspark import operators as O
from semspark.functions import cents_to_amount, spark_udf
from semspark.meta import concept_cards, descriptor_cards, meta_tables
from semspark.model import Rule
from semspark.operators.snapshot import Window
from semspark.plans import Answer, Intent, NotDerivable, compile_intent, period
from semspark.plans.compiler import derived_set
from semspark.project.rdf import validate
from semspark.queries import answered, catalog, money, query, retail, table, tpch
from semspark.sources import drift, external_table_ddl, view_ddl


@query("SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net_revenue FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def grouping_roll_up(spark, d):
    """A grouping named alone rolls up along its own path."""
    return answered(spark, d, Intent("Revenue", ("SupplierRegion",))).select("r_name", money("net_revenue"))


@query("""SELECT CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'A' WHEN p_type IN ('SMALL', 'MEDIUM', 'LARGE') THEN 'B' WHEN p_type = 'STANDARD' THEN 'C' END AS line, round(sum(l_extendedprice), 2) AS turnover
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def grouping_of_listed_members(spark, d):
    return answered(spark, d, Intent("Turnover", ("ArticleLine",)), retail).select(F.col("ArticleLine").alias("line"), money("turnover"))


@query("SELECT round(sum(l_extendedprice * (1 - l_discount)) FILTER (l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01'), 2) AS turnover FROM lineitem")
def template_with_a_period(spark, d):
    return answered(spark, d, Intent("Turnover", window=period("1995", "Sale.l_shipdate")), retail).select(money("turnover"))


@query("SELECT p_type, round(sum(l_extendedprice), 2) AS turnover FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_type")
def template_without_a_period(spark, d):
    return answered(spark, d, Intent("Turnover", ("Article.p_type",)), retail).select("p_type", money("turnover"))


@query("SELECT 'typed' AS kind, p_partkey, p_size FROM part WHERE p_size >= 45 AND p_type = 'PROMO' UNION ALL SELECT 'all', p_partkey, p_size FROM part WHERE p_size >= 49")
def derived_set_with_parameters(spark, d):
    c = catalog(spark, d)
    typed = derived_set(retail(), c, "large_articles", {"least": 45, "type": "PROMO"}).withColumn("kind", F.lit("typed"))
    return typed.unionByName(derived_set(retail(), c, "large_articles", {"least": 49}).withColumn("kind", F.lit("all")))


@query("SELECT count(*) AS n FROM (SELECT DISTINCT c_nationkey FROM customer WHERE c_mktsegment = 'AUTOMOBILE')")
def array_membership(spark, d):
    """A restriction on a column that holds several values is membership."""
    return answered(spark, d, Intent(count="Assortment", restrict={"Assortment.segments": "AUTOMOBILE"}), retail)


@query("SELECT round(avg(p_size) FILTER (p_size > 0), 6) AS size, p_brand FROM part GROUP BY p_brand")
def averaged_property(spark, d):
    return answered(spark, d, Intent("ArticleSize", ("Article.p_brand",)), retail).select(F.round("article_size", 6).alias("size"), "p_brand")


@query("""SELECT 'sale.amount.never_negative' AS rule_id, 'lineitem' AS relation, count(*) FILTER (NOT l_extendedprice >= 0) AS offenders FROM lineitem
UNION ALL SELECT 'sale.discount.is_a_share', 'lineitem', count(*) FILTER (l_discount < 0 OR l_discount > 1) FROM lineitem
UNION ALL SELECT 'sale.quantity.below_forty', 'lineitem', count(*) FILTER (NOT l_quantity < 40) FROM lineitem""")
def guarantee_report(spark, d):
    return quality.guarantees(retail(), catalog(spark, d).frames)


@query("""SELECT 'bake' AS disposition, count(*) FILTER (p_type <> 'PROMO') AS n, 0 AS doubtful FROM part
UNION ALL SELECT 'register', count(*) FILTER (NOT (p_brand LIKE 'Brand#1%' AND p_size < 5)), count(*) FILTER (p_brand LIKE 'Brand#1%' AND NOT p_size < 5) FROM part UNION ALL SELECT 'block', NULL, NULL""")
def impurity_dispositions(spark, d):
    part = table(spark, d, "part")
    baked = O.dispose(part, [O.Impurity("promo", F.col("p_type") == "PROMO", "bake")]).counted().select(F.lit("bake").alias("disposition"), "n", F.lit(0).cast("bigint").alias("doubtful"))
    kept = O.dispose(part, [O.Impurity("rebadged", F.col("p_brand").like("Brand#1%"), "register", sure=F.col("p_size") < 5, note="small ones are surely rebadged")])
    kept = kept.counted().select(F.lit("register").alias("disposition"), "n", F.col("rebadged").alias("doubtful"))
    blocked = O.dispose(part, [O.Impurity("unknown", F.lit(True), "block", note="no one has looked")])
    none = spark.range(1).select(F.lit("block").alias("disposition"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("bigint").alias("doubtful"))
    return baked.unionByName(kept).unionByName(none) if isinstance(blocked, NotDerivable) else baked


LATEST = "SELECT user_id, event_type AS now, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events"


@query(f"SELECT 0 AS changes, now AS value, count(*) AS n FROM ({LATEST}) WHERE r = 1 GROUP BY ALL UNION ALL SELECT 1, before, count(*) FROM ({LATEST}) WHERE r = 1 GROUP BY ALL UNION ALL SELECT 2, 'not derivable', 0")
def value_before_changes(spark, d):
    """An attribute that keeps its current and its previous value; two changes ago can't be told."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kept = O.snapshot_collapse(table(spark, d, "events").withColumn("before", F.lag("event_type").over(w)), ["user_id"], "ts", ["event_id"])
    out = None
    for n in range(3):
        found = O.value_before(kept, "event_type", ["event_type", "before"], n)
        part = spark.createDataFrame([(n, "not derivable", 0)], "changes int, value string, n bigint") if isinstance(found, NotDerivable) else found.groupBy("value").agg(F.count("*").alias("n")).select(F.lit(n).alias("changes"), "value", "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT asked, answer, word FROM (VALUES ('turnover by grade', 'NotDerivable', 'several groups'), ('revenue by nation', 'Ask', 'via'), ('sum of sizes', 'NotDerivable', 'averageable'), ('a rule that is prose', 'NotDerivable', 'executable'),
('a missing parameter', 'NotDerivable', 'needs'), ('lines by urgency', 'Answer', '')) t(asked, answer, word)""")
def answers_and_refusals(spark, d):
    c = catalog(spark, d)
    needy = retail()
    needy = replace(needy, rules={**needy.rules, "payload": replace(needy.rules["payload"], template="SUM(l_quantity * {{ factor }})")})
    asked = [
        ("turnover by grade", retail(), Intent("Turnover", ("ArticleGrade",)), "several groups"), ("revenue by nation", tpch(), Intent("Revenue", ("Nation.n_name",)), "via"), ("sum of sizes", retail(), Intent("ArticleSize", fold="sum"), "averageable"),
        ("a rule that is prose", tpch(), Intent("Revenue", rules=("lineitem.revenue.net_of_discount",)), "executable"), ("a missing parameter", needy, Intent("Payload"), "needs"), ("lines by urgency", tpch(), Intent(count="LineItem", partition=("Orders.o_orderpriority",)), ""),
    ]
    out = []
    for name, model, intent, word in asked:
        found = compile_intent(model, c, intent)
        reason = "" if isinstance(found, Answer) else found.reason
        out.append((name, type(found).__name__, word if word in reason else reason))
    return spark.createDataFrame(out, "asked string, answer string, word string")


def _values(columns: str, rows: list[tuple]) -> str:
    """SQL of a literal table of strings and numbers."""
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({columns})"


CITED = [
    ("SELECT", "concept Revenue"), ("FROM", "concept LineItem"), ("WHERE", "concept Region"), ("WHERE", "concept Orders"), ("JOIN", "edge lineitem__part_of__orders"), ("JOIN", "edge orders__placed_by__customer"),
    ("JOIN", "edge customer__from__nation"), ("JOIN", "edge nation__in__region"), ("SELECT", "rule net_revenue"), ("GROUP BY", "concept Nation"), ("SAID", "revenue without a qualifier is net of discount"),
]


@query(_values("clause, element", CITED))
def cited_and_disclosed(spark, d):
    """What an answer cites for each clause, and what it says that it assumed."""
    a = compile_intent(tpch(), catalog(spark, d), Intent("Revenue", ("Nation.n_name",), {"Region.r_name": "EUROPE"}, period("1995", "Orders.o_orderdate"), ("Customer",)))
    return spark.createDataFrame([*((c.clause, c.element) for c in a.provenance), *(("SAID", s) for s in a.disclosures)], "clause string, element string")


#: Ways to spoil a model, each with the checks that must find it, and how often.
SPOILT = {
    "sound": [],
    "a measure without additivity": [("measure-declares-additivity", 1), ("structure", 1)],
    "an unknown class": [("concept-class-closed", 1), ("structure", 1)],
    "a rule that binds no column": [("rule-binds-grounded", 1)],
    "a field role of no column": [("field-roles-grounded", 1)],
    "an edge to no concept": [("endpoint", 1)],
    "a join of no column": [("join-rule-grounded", 1)],
    "an enumeration without closure": [("enumeration-declares-closure", 1)],
    "a concept without identity": [("concept-declares-identity", 1)],
}


def _spoilt(model, how: str):
    """The model with one fault put in; its files and its elements share their documents, so both show it."""
    model = copy.deepcopy(model)
    doc = lambda n: model.concepts[n].doc
    edge = next(iter(model.edges.values()))
    if how == "a measure without additivity":
        doc("Payload")["concept"]["semantics"].pop("additivity")
    elif how == "an unknown class":
        doc("Article")["concept"]["class"] = "thing"
    elif how == "a rule that binds no column":
        doc("Sale")["contract"]["rules"][0]["binds"].append("l_nothing")
    elif how == "a field role of no column":
        doc("Sale")["grounding"]["field_roles"]["l_nothing"] = "key"
    elif how == "an edge to no concept":
        edge.doc["endpoints"]["to"]["concept"] = "Nobody"
        model = replace(model, edges={edge.edge_id: replace(edge, target="Nobody")})
    elif how == "a join of no column":
        edge.doc["join_rule"] = "lineitem.l_partkey = part.p_nothing"
        model = replace(model, edges={edge.edge_id: replace(edge, join_rule=edge.doc["join_rule"])})
    elif how == "an enumeration without closure":
        doc("Priority")["values"].pop("closure")
    elif how == "a concept without identity":
        doc("Article")["concept"].pop("identity")
    return model


@query(_values("fault, finding, n", [(k, c, n) for k, v in SPOILT.items() for c, n in v]))
def gate_findings(spark, d):
    """What the gates find in a sound model (nothing) and in ones with a fault each."""
    out = []
    for how in SPOILT:
        found = [f.check for f in gates.check_all(_spoilt(retail(), how))]
        out += [(how, c, found.count(c)) for c in sorted(set(found))]
    return spark.createDataFrame(out, "fault string, finding string, n bigint")


PROJECTED = [
    ("turtle", "classes", 9), ("turtle", "object properties", 8), ("shacl", "node shapes", 9), ("shacl", "closed lists", 4), ("graph", "keys", 9), ("graph", "relationships", 8), ("semantic model", "datasets", 9), ("semantic model", "metrics", 3),
    ("diagram", "relations", 8), ("concept cards", "cards", 18), ("descriptor cards", "cards", 9),
]


@query(_values("artefact, part, n", PROJECTED))
def projected_parts(spark, d):
    """How many parts the first model has in each of its projections."""
    m = tpch()
    turtle, shacl, graph = project.turtle(m, "t"), project.shacl(m, "t"), project.cypher(m, "t")
    osi = yaml.safe_load(project.semantic_model(m, "t"))["semantic_model"][0]
    found = [
        ("turtle", "classes", turtle.count("a owl:Class")), ("turtle", "object properties", turtle.count("a owl:ObjectProperty")), ("shacl", "node shapes", shacl.count("a sh:NodeShape")), ("shacl", "closed lists", shacl.count("sh:in (")),
        ("graph", "keys", graph.count("CREATE CONSTRAINT")), ("graph", "relationships", graph.count("-[:")), ("semantic model", "datasets", len(osi["datasets"])), ("semantic model", "metrics", len(osi["metrics"])),
        ("diagram", "relations", project.entity_relations(m, "t").count("||--o{")), ("concept cards", "cards", len(concept_cards(m))), ("descriptor cards", "cards", len(descriptor_cards(m))),
    ]
    return spark.createDataFrame(found, "artefact string, part string, n bigint")


@query("SELECT o_orderstatus, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS total FROM orders GROUP BY o_orderstatus")
def amounts_in_cents(spark, d):
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.sum(cents_to_amount(cents)).cast("double").alias("total"))


@query("SELECT count(*) AS n FROM customer WHERE c_mktsegment = 'BUILDING'")
def scoped_concept(spark, d):
    """A concept that is a part of a shared relation: its value filter is on every question."""
    m = tpch()
    c = m.concepts["Customer"]
    m = replace(m, concepts={**m.concepts, "Customer": replace(c, doc={**c.doc, "grounding": {**c.grounding, "value_filter": "c_mktsegment = 'BUILDING'"}})})
    return answered(spark, d, Intent(count="Customer"), lambda: m)


@query("SELECT round(sum(l_extendedprice), 2) AS gross_revenue, 'assumed' AS said FROM lineitem WHERE l_linestatus = 'F'")
def assumed_axis(spark, d):
    """An axis with a default that the question doesn't name: the default is taken, and said."""
    m = tpch()
    c = m.concepts["LineItem"]
    m = replace(m, concepts={**m.concepts, "LineItem": replace(c, doc={**c.doc, "x-axes": {"l_linestatus": {"policy": "assumable_default", "default": "F"}}})})
    a = compile_intent(m, catalog(spark, d), Intent("GrossRevenue"))
    return a.df.select(money("gross_revenue"), F.lit("assumed" if any("is assumed" in s for s in a.disclosures) else "silent").alias("said"))


@query(_values("axis, reason", [("LineItem.l_linestatus", "required, and there is no default")]))
def required_axis(spark, d):
    m = tpch()
    c = m.concepts["LineItem"]
    m = replace(m, concepts={**m.concepts, "LineItem": replace(c, doc={**c.doc, "x-axes": {"l_linestatus": {"policy": "mandatory_no_default"}}})})
    asked = compile_intent(m, catalog(spark, d), Intent("GrossRevenue"))
    return spark.createDataFrame([(asked.term, asked.reason)], "axis string, reason string")


@query("SELECT l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem GROUP BY l_returnflag")
def rule_of_a_function(spark, d):
    """A rule whose value is a registered function of columns."""
    spark_udf("net_of_discount", lambda price, discount: price * (1 - F.coalesce(discount, F.lit(0.0))))
    m = tpch()
    c = m.concepts["Revenue"]
    rule = Rule("by_function", "Revenue", ("LineItem",), "spark_udf", None, {"x-udf": {"name": "net_of_discount", "columns": ["l_extendedprice", "l_discount"]}})
    m = replace(m, rules={**m.rules, "by_function": rule}, concepts={**m.concepts, "Revenue": replace(c, doc={**c.doc, "derived_by_rule": "by_function"})})
    return answered(spark, d, Intent("Revenue", ("LineItem.l_returnflag",)), lambda: m).select("l_returnflag", money("by_function", "revenue"))


@query("SELECT c_nationkey AS nationkey, count(DISTINCT c_mktsegment) AS segments FROM customer GROUP BY c_nationkey")
def rule_of_a_view(spark, d):
    """A rule that a view of the catalog realises."""
    m = retail()
    m = replace(m, rules={**m.rules, "assortments": Rule("assortments", "Assortment", ("Assortment",), "sql_view", None, {"view_ref": "nation_segments"})})
    return derived_set(m, catalog(spark, d), "assortments").select("nationkey", F.size("segments").cast("bigint").alias("segments"))


@query(_values("word, action, edge", [("same nation", "resolve", "supplier__shares_nation__supplier"), ("Nachbarn", "resolve", "supplier__shares_nation__supplier"), ("cousins", "ask", None)]))
def words_of_relations(spark, d):
    said = {e.edge_id: e.doc["aliases"]["multilingual"] for e in tpch().edges.values() if e.doc.get("aliases")}
    found = {w: O.relation_alias_resolve(w, said) for w in ("same nation", "Nachbarn", "cousins")}
    return spark.createDataFrame([(w, x.action, x.value) for w, x in found.items()], "word string, action string, edge string")


@query(_values("finding", [("part.p_size is string, described as int",), ("part.p_name is missing",), ("part.extra isn't described",)]))
def descriptor_drift(spark, d):
    """A relation held against its descriptor: as it is (nothing), and changed."""
    part = table(spark, d, "part")
    changed = part.withColumn("p_size", F.col("p_size").cast("string")).withColumnRenamed("p_name", "extra")
    return spark.createDataFrame([(x,) for x in [*drift(part, tpch().tables["part"]), *drift(changed, tpch().tables["part"])]], "finding string")


@query("""SELECT 'Customer' AS concept, 'c_mktsegment in closed set' AS test, count(*) FILTER (c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')) AS n FROM customer
UNION ALL SELECT 'Orders', 'o_orderstatus in closed set', count(*) FILTER (o_orderstatus NOT IN ('O', 'F', 'P')) FROM orders
UNION ALL SELECT 'LineItem', 'l_returnflag in closed set', count(*) FILTER (l_returnflag NOT IN ('R', 'A', 'N')) FROM lineitem
UNION ALL SELECT 'LineItem', 'l_linestatus in closed set', count(*) FILTER (l_linestatus NOT IN ('O', 'F')) FROM lineitem""")
def shapes_over_data(spark, d):
    """The closed sets of the model's shapes, over the data."""
    found = [f for f in validate(tpch(), catalog(spark, d).frames) if f[1].endswith("in closed set")]
    return spark.createDataFrame(found, "concept string, test string, n bigint")


@query(_values("relation, statement", [("meta_enum", "CREATE TABLE meta_enum (`concept` string, `value` string, `label` string) USING JSON LOCATION 'place/meta_enum'"), ("partsupp", "CREATE OR REPLACE TEMPORARY VIEW partsupp AS SELECT 1")]))
def statements_for_a_warehouse(spark, d):
    enum = meta_tables(spark, tpch())["meta_enum"]
    return spark.createDataFrame([("meta_enum", external_table_ddl("meta_enum", enum, "place")), ("partsupp", view_ddl(tpch().tables["partsupp"], "SELECT 1;"))], "relation string, statement string")
