"""Loading, gates, tables about the model, projections, data-quality checks."""

import copy
import shutil
from pathlib import Path

import pytest
import yaml

from semspark import project, quality
from semspark.gates import accept, check_all, check_document, check_shapes, failed, unaccepted
from semspark.meta import META_TABLES, coverage, meta_tables
from semspark.model import load
from semspark.model.vocab import LAW, effects, term
from semspark.project.graph import problems
from semspark.project.rdf import validate
from semspark.queries import catalog, tpch
from semspark.sources import bind, drift, external_table_ddl, read_register, spark_type, struct_type, write_ndjson

ROOT = Path(__file__).resolve().parent.parent / "models" / "tpch"


def test_law():
    assert effects("MeasureType.Stock", {"t": "axis_kind.time", "p": "categorical"}) == {"t": "point_in_time", "p": "additive"}
    assert term("a.b.c") == "c" and set(LAW) == {"Flow", "Stock", "Intensive", "Target"}


def test_the_model_passes_its_gates():
    assert check_all(tpch()) == []


def changed(tmp_path, file, change):
    root = tmp_path / "m"
    shutil.copytree(ROOT, root)
    p = root / file
    doc = yaml.safe_load(p.read_text())
    change(doc)
    p.write_text(yaml.safe_dump(doc))
    return load(root)


@pytest.mark.parametrize(
    ("file", "change", "check"),
    [
        ("ontology/edges.yaml", lambda d: d["edges"][0].update(join_rule="nation.n_regionkee = region.r_regionkey"), "join-rule-grounded"),
        ("ontology/edges.yaml", lambda d: d["edges"][0].update(type="shared_attribute"), "structure"),
        ("ontology/edges.yaml", lambda d: d["edges"][0].update(type="friendship"), "structure"),
        ("ontology/edges.yaml", lambda d: d["edges"][0].update(verified_by="ontology/none.yaml#x"), "path"),
        ("ontology/edges.yaml", lambda d: d["edges"][0]["endpoints"]["to"].update(concept="Planet"), "endpoint"),
        ("ontology/concepts/lineitem.yaml", lambda d: d["contract"]["rules"][0].update(binds=["l_nothing"]), "rule-binds-grounded"),
        ("ontology/concepts/lineitem.yaml", lambda d: d.pop("lifecycle"), "structure"),
        ("ontology/concepts/lineitem.yaml", lambda d: d["contract"]["rules"][0].update(kind="rule_kind.guess"), "term"),
        ("ontology/concepts/region.yaml", lambda d: d["grounding"]["field_roles"].update(r_none="key"), "field-roles-grounded"),
        ("ontology/concepts/region.yaml", lambda d: d["concept"].update({"class": "thing"}), "structure"),
        ("ontology/concepts/region.yaml", lambda d: d.update(surprise=1), "structure"),
        ("ontology/concepts/region.yaml", lambda d: d["concept"].pop("identity"), "concept-declares-identity"),
        ("ontology/concepts/revenue.yaml", lambda d: d["concept"]["semantics"].pop("additivity"), "measure-declares-additivity"),
        ("ontology/concepts/revenue.yaml", lambda d: d.update(derived_by_rule="nothing"), "rule"),
        ("ontology/concepts/returnflag.yaml", lambda d: d["values"].pop("closure"), "enumeration-declares-closure"),
        ("ontology/concepts/returnflag.yaml", lambda d: d["values"]["items"][0].pop("code"), "structure"),
        ("ontology/concepts/returnflag.yaml", lambda d: d.update(enumerations=[]), "structure"),
        ("ontology/concepts/returnflag.yaml", lambda d: d["values"]["realized_by"].update(udf="no_such"), "operator"),
        ("ontology/rules.yaml", lambda d: d["rules"][0].pop("render_kind"), "structure"),
        ("data/transforms/lineitem.yaml", lambda d: d["inputs"][0].update(kind="rumour"), "structure"),
        ("data/datasets/nation.yaml", lambda d: d["foreign_keys"][0].update(to_column="none"), "foreign_key"),
    ],
)
def test_gates_find(tmp_path, file, change, check):
    assert check in {f.check for f in check_all(changed(tmp_path, file, change))}


def test_other_documents():
    assert check_document({"note": 1}) == []
    assert [f.severity for f in check_document({"rules": [], "metadata": {"schema_version": "9"}}, versions=("1",))] == ["INFO"]
    prop = {"metadata": {"concept": "A", "source": "s", "schema_version": "1"}, "concept": {"name": "A", "class": "entity"}, "properties": [{"type": "string"}]}
    assert failed(check_document(prop)) and failed(check_document({**copy.deepcopy(prop), "properties": [], "value_set": 1}))


def test_shapes_of_ones_own(tmp_path):
    def change(d):
        d["members"] = {"over": "Supplier", "member_source": {"kind": "enumerated"}, "definitions": [{"code": "a", "members": ["x", "y"]}, {"code": "b", "members": ["y"]}]}

    m = changed(tmp_path, "ontology/concepts/supplierregion.yaml", change)
    shape = {"id": "p", "target": "concept", "severity": "error", "constraint": {"kind": "partition", "groups": "members.definitions[]"}}
    assert len(check_shapes(m, [shape])) == 1 and not check_shapes(tpch(), [shape])
    subset = {"id": "s", "target": "concept", "severity": "error", "where": {"concept.name": "LineItem"}, "constraint": {"kind": "subset_of", "left": "lifecycle.phases[].name", "right": ["lifecycle.phase_sequence"]}}
    assert not check_shapes(tpch(), [subset])
    m2 = changed(tmp_path / "b", "ontology/concepts/lineitem.yaml", lambda d: d["contract"]["rules"][0].update(then="join lineitem.l_orderkey = orders.o_orderkey"))
    assert len(check_shapes(m2, [{"id": "n", "target": "concept", "severity": "error", "constraint": {"kind": "no_predicate_restatement"}}])) == 1


def test_baseline(tmp_path):
    found = check_all(changed(tmp_path, "ontology/concepts/region.yaml", lambda d: d.update(surprise=1)))
    accept(found, tmp_path / "base.json")
    assert found and not unaccepted(found, tmp_path / "base.json") and unaccepted(found, tmp_path / "none.json") == found


def test_flat_layout(tmp_path):
    for a, b in (("ontology/concepts", "concepts"), ("data/datasets", "tables")):
        shutil.copytree(ROOT / a, tmp_path / b)
    shutil.copy(ROOT / "ontology/edges.yaml", tmp_path / "edges.yaml")
    shutil.copy(ROOT / "ontology/rules.yaml", tmp_path / "rules.yaml")
    m = load(tmp_path)
    assert (len(m.concepts), len(m.edges), len(m.tables), len(m.rules)) == (18, 9, 9, 4)


def test_meta_tables(spark):
    t = meta_tables(spark, tpch(), views=True)
    assert {n: tuple(df.columns) for n, df in t.items()} == META_TABLES
    assert all(f.dataType.simpleString() == "string" for df in t.values() for f in df.schema.fields)
    got = spark.sql("SELECT c.left_column FROM meta_edges e JOIN meta_edge_join_clauses c USING (edge_id) WHERE e.type = 'composite_key' ORDER BY int(c.ordinal)").collect()
    assert [r[0] for r in got] == ["l_partkey", "l_suppkey"]
    assert spark.sql("SELECT get_json_object(axis_kinds, '$.time') FROM meta_measures WHERE measure = 'Balance'").first()[0] == "time"
    assert t["meta_kpi_variants"].count() == 0
    bound, every = coverage(tpch())
    assert 0 < bound < every


def test_sinks(spark, tmp_path):
    t = meta_tables(spark, tpch())["meta_edges"]
    write_ndjson({"meta_edges": t}, str(tmp_path))
    spark.sql("DROP TABLE IF EXISTS meta_edges_t")
    spark.sql(external_table_ddl("meta_edges", t, str(tmp_path)).replace("CREATE TABLE meta_edges ", "CREATE TABLE meta_edges_t "))
    assert spark.table("meta_edges_t").count() == 9
    spark.sql("DROP TABLE meta_edges_t")


def test_registers_and_types(spark, tmp_path):
    (tmp_path / "r.csv").write_text("code,label\na,A\n")
    assert read_register(spark, str(tmp_path / "r.csv"), ["code", "flag"]).collect()[0][:] == ("a", None)
    assert read_register(spark, str(tmp_path / "none.csv"), ["code"]).count() == 0
    assert spark_type("decimal(12,2)").simpleString() == "decimal(12,2)" and spark_type("array<string>").simpleString() == "array<string>" and spark_type("odd").simpleString() == "string"


def test_binding(spark, sf_dir):
    frames = catalog(spark, sf_dir).frames
    assert bind(tpch(), frames) == []
    assert drift(frames["region"].withColumnRenamed("r_name", "x"), tpch().tables["region"]) == ["region.r_name is missing", "region.x isn't described"]
    assert struct_type(tpch().tables["part"]).names[0] == "p_partkey"


def test_projections(tmp_path):
    files = project.write(tpch(), "tpch", tmp_path)
    assert "tpch.ttl" in files and "tpch.okf/Revenue.md" in files
    assert project.drifted(tpch(), "tpch", tmp_path) == []
    (tmp_path / "tpch.ttl").write_text("other")
    assert project.drifted(tpch(), "tpch", tmp_path) == ["tpch.ttl"]
    assert project.broken_links(project.bundle(tpch())) == []
    assert "(n.l_orderkey, n.l_linenumber) IS NODE KEY" in project.cypher(tpch(), "t") and problems(tpch()) == []
    assert project.shacl(tpch(), "t").count("a sh:NodeShape") == 9 and 'sh:in ( "R" "A" "N" )' in project.shacl(tpch(), "t")
    assert project.turtle(tpch(), "t").count("owl:ObjectProperty") == 8
    osi = yaml.safe_load(project.semantic_model(tpch(), "t"))["semantic_model"][0]
    assert next(x for x in osi["metrics"] if x["name"] == "settled_revenue")["x-requires"] == {"filters": ["orders.revenue.settled_only"], "pre_aggregates": ["lineitem"]}
    assert next(x for x in osi["datasets"] if x["name"] == "lineitem")["primary_key"] == ["l_orderkey", "l_linenumber"]
    assert "erDiagram" in project.entity_relations(tpch(), "t") and "x_lineitem_clean" in project.lineage(tpch(), "t")


def test_shapes_on_data(spark, sf_dir):
    found = validate(tpch(), catalog(spark, sf_dir).frames)
    assert found and all(n == 0 for _, _, n in found)


def test_quality(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, None)], "k int, f int")
    assert [r[:] for r in quality.duplicate_keys(df, ["k"]).collect()] == [(1, 2)]
    assert [r[0] for r in quality.foreign_key_orphans(df, ["f"], spark.createDataFrame([(1,)], "id int"), ["id"]).collect()] == [2]
    assert quality.cardinality(df, ["k"]).first()[:] == (2, 2)
    assert quality.assertion(df, "f > 1").count() == 2
    a, b = (spark.createDataFrame([(x,)], "v double") for x in (1000000.0, 920000.0))
    assert quality.reconcile(a, b, "v").first()[:] == (1000000.0, 920000.0, 80000.0, 80000 / 920000, False)


def test_declared_inputs_are_those_read(spark, sf_dir):
    t = tpch().transforms["tpch.lineitem_clean"]
    frames = catalog(spark, sf_dir).frames
    frames["orders"].createOrReplaceTempView("orders")
    spark.createDataFrame([], "l_orderkey bigint, l_linenumber int, l_extendedprice double, l_discount_bps int").createOrReplaceTempView("lineitem_raw")
    assert quality.lineage_gaps(spark, t) == []
