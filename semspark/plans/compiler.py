"""An intent compiled to one DataFrame, and why.

SELECT comes from the measure's rule, JOIN from edges, tables and columns from descriptors, WHERE from restrictions,
windows, exclusion rules and defaults. Nothing runs here: the answer is a lazy DataFrame that Catalyst plans.

All paths that are needed are gathered first, as a tree that grows from the fact. Each branch is put together and
filtered on its own, from its far end, and then joined to the fact once: a restriction on a dimension's dimension shrinks
the near one before the fact is touched, and branches with restrictions come first.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semspark.functions.folds import fold
from semspark.functions.rules import call_udf, expression, predicate, rendered
from semspark.model.types import Citation, Concept, Model, Rule
from semspark.plans.guards import additivity_guard
from semspark.plans.intent import Ask, Intent, NotDerivable
from semspark.plans.paths import Step, find_path, reachable


class Catalog:
    """Relations by name: given DataFrames first, then the session's tables, with a schema or without."""

    def __init__(self, spark: SparkSession, frames: Mapping[str, DataFrame] | None = None) -> None:
        self.spark, self.frames = spark, frames or {}  # the mapping may load a frame when it is asked for

    def __getitem__(self, relation: str) -> DataFrame:
        name = relation.split(".")[-1]
        if name in self.frames:
            return self.frames[name]
        for n in (relation, name):
            if self.spark.catalog.tableExists(n):
                return self.spark.table(n)
        raise KeyError(f"no relation {relation}")


@dataclass(frozen=True)
class Answer:
    df: DataFrame
    provenance: tuple[Citation, ...]
    disclosures: tuple[str, ...] = ()
    violations: tuple[str, ...] = field(default=())


class Refused(Exception):
    def __init__(self, answer: Ask | NotDerivable) -> None:
        super().__init__(str(answer))
        self.answer = answer


def snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() and i else c.lower() for i, c in enumerate(name))


Key = tuple[str, ...]  # the edge ids of a path from the fact


class _Compilation:
    def __init__(self, model: Model, catalog: Catalog, intent: Intent) -> None:
        self.model, self.catalog, self.intent = model, catalog, intent
        self.cited: list[Citation] = []
        self.said: list[str] = []
        self.joined: dict[Key, str] = {}
        self.steps: dict[Key, Step] = {}
        #: conditions on columns of a place that no missing row meets, others, and semi joins (far side, ends)
        self.strict: dict[Key, list[Column]] = {}
        self.late: list[Column] = []
        self.semis: dict[Key, list[tuple[DataFrame, list[tuple[str, str]]]]] = {}

    def cite(self, clause: str, element: str, detail: str = "") -> None:
        self.cited.append(Citation(clause, element, detail))

    def refuse(self, reason: str, axis: str = "") -> Refused:
        start = self.fact.name if hasattr(self, "fact") else ""
        return Refused(NotDerivable(self.intent.measure or self.intent.count or "", axis, tuple(reachable(self.model, start)) if start else (), reason))

    def concept(self, name: str) -> Concept:
        if name not in self.model.concepts:
            raise self.refuse(f"no concept {name}", name)
        return self.model.concepts[name]

    def relation(self, concept: Concept) -> DataFrame:
        """The concept's rows: its relation, and only what its value filter leaves of a shared one."""
        if concept.grounding.get("kind", "sql_table") != "sql_table":
            raise self.refuse(f"{concept.name} is grounded by {concept.grounding['kind']}, which isn't supported", concept.name)
        if concept.relation is None:
            raise self.refuse(f"{concept.name} isn't grounded", concept.name)
        df = self.catalog[concept.relation]
        if scope := concept.grounding.get("value_filter"):
            df = df.filter(F.expr(scope))
            self.cite("WHERE", f"concept {concept.name}", f"value_filter {scope}")
        return df

    def place(self, path: list[Step]) -> str:
        return self.joined[tuple(s[1].edge_id for s in path)]

    def plan(self, path: list[Step]) -> Key:
        """Puts a path into the tree; each prefix of a path is there once."""
        for n in range(1, len(path) + 1):
            key = tuple(s[1].edge_id for s in path[:n])
            if key not in self.joined:
                self.joined[key] = f"j{len(self.joined)}"
                self.steps[key] = path[n - 1]
                self.cite("JOIN", f"edge {path[n - 1][1].edge_id}", path[n - 1][1].join_rule or "")
        return tuple(s[1].edge_id for s in path)

    def asked(self, key: Key) -> bool:
        """Something is asked of a place, or of one beyond it, that a missing row doesn't meet."""
        return any(k[: len(key)] == key for k in (*self.strict, *self.semis))

    def branch(self, df: DataFrame, key: Key) -> DataFrame:
        """df, which holds a place's rows, filtered, and with all branches that grow from there."""
        for test in self.strict.get(key, ()):
            df = df.filter(test)
        for n, (far, ends) in enumerate(self.semis.get(key, ())):
            far = far.toDF(*(f"_s{n}_{k}" for k in range(len(ends))))
            on = reduce(and_, (F.col(f"`{self.joined[key]}.{a}`") == F.col(f"_s{n}_{k}") for k, (a, _) in enumerate(ends)))
            df = df.join(far, on, "left_semi")
        children = [k for k in self.steps if k[:-1] == key]
        for child in sorted(children, key=lambda k: not self.asked(k)):
            df = self.attach(df, child)
        return df

    def attach(self, df: DataFrame, key: Key) -> DataFrame:
        start, edge, to = self.steps[key]
        near, name = self.joined[key[:-1]], self.joined[key]
        ends = self.ends(edge, start)
        concept = self.concept(to)
        # a target that need not be there keeps its row, unless something is asked of it
        optional = "0..1" in ((edge.target_cardinality if start == edge.source else edge.source_cardinality) or "") and not self.asked(key)
        if self.within(concept, start, ends) and not optional:
            there = reduce(and_, (F.col(f"`{near}.{a}`").isNotNull() for a, _ in ends))
            return self.branch(df.filter(there).withColumns({f"{name}.{b}": F.col(f"`{near}.{a}`") for a, b in ends}), key)
        right = self.relation(concept)
        right = self.branch(right.toDF(*(f"{name}.{c}" for c in right.columns)), key)
        on = reduce(and_, (F.col(f"`{near}.{a}`") == F.col(f"`{name}.{b}`") for a, b in ends))
        return df.join(right, on, "left" if optional else "inner")

    def within(self, concept: Concept, start: str, ends: list[tuple[str, str]]) -> bool:
        """The concept is nothing but the keys that rows of `start` name: its columns are at hand, no join is needed."""
        own = concept.grounding.get("x-distinct_keys_of") or {}
        near = self.concept(start)
        return bool(own) and own.get("relation") == near.relation and dict(own.get("columns") or {}) == {b: a for a, b in ends} and not concept.grounding.get("value_filter") and not near.grounding.get("value_filter")

    def ends(self, edge, start: str) -> list[tuple[str, str]]:
        near = set(self.concept(start).relations)
        out = []
        for c in edge.clauses:
            forward = start == edge.source if edge.source != edge.target and c.left_relation not in near | {""} or c.left_relation == c.right_relation else c.left_relation in near
            out.append((c.left_column, c.right_column) if forward else (c.right_column, c.left_column))
        return out

    def path(self, concept: str, via: tuple[str, ...] = ()) -> list[Step]:
        found = find_path(self.model, self.fact.name, self.concept(concept).name, (*self.intent.via, *via), self.intent.measure or self.intent.count or "")
        if isinstance(found, (Ask, NotDerivable)):
            raise Refused(found)
        return found

    def column(self, ref: str) -> tuple[str, str]:
        """Concept.column, checked against the concept's descriptor."""
        concept, _, column = ref.partition(".")
        c = self.concept(concept)
        t = self.model.tables.get(c.relation or "")
        if t is not None and t.column(column) is None:
            raise self.refuse(f"{c.relation} has no column {column}", ref)
        return concept, column

    def usable(self, ref: str, use: str) -> None:
        """A field role may forbid a use: attributes and measures are never filtered or grouped by."""
        concept, column = self.column(ref)
        role = self.concept(concept).field_roles.get(column)
        if role in ("attribute", "measure"):
            raise self.refuse(f"{ref} is {role}: not for {use}", ref)

    def matches(self, column: Column, value: object, ref: str) -> Column:
        """Equality; membership, where the column holds several values."""
        if value is None:
            return column.isNull()
        several = isinstance(value, (list, tuple, set))
        described = self.model.tables.get(self.concept(ref.partition(".")[0]).relation or "")
        if described is not None and str((described.column(ref.partition(".")[2]) or {}).get("type", "")).startswith("array"):
            return F.arrays_overlap(column, F.array(*map(F.lit, value))) if several else F.array_contains(column, value)  # type: ignore[arg-type]
        return column.isin(list(value)) if several else column == F.lit(value)  # type: ignore[arg-type]

    def grouped_by(self, ref: str) -> tuple[str, tuple[str, ...], Column | None]:
        """A partition's Concept.column, concepts that its path passes, and an expression over it, for a grouping's name:
        what the grouping rolls up to, or, where it lists its members, the code of the one that has the member."""
        concept = self.model.concepts.get(ref)
        if "." in ref or concept is None or concept.kind != "grouping":
            return ref, (), None
        members = concept.doc.get("members") or {}
        if to := members.get("x-rolls_up_to"):
            self.cite("GROUP BY", f"concept {ref}", f"rolls up to {to}")
            return to, (members["over"],) if members.get("over") else (), None
        column, said = members.get("x-member_column"), members.get("definitions") or []
        if not column or not said:
            raise self.refuse(f"{ref} has neither listed members nor a column that it rolls up to", ref)
        every = [m for d in said for m in d.get("members") or []]
        if len(every) != len(set(every)):
            raise self.refuse(f"{ref}: a member is in several groups, so it would count some twice", ref)
        self.cite("GROUP BY", f"concept {ref}", f"members of {column}")
        place = F.col(f"_member_{ref}")
        code = reduce(lambda c, d: c.when(place.isin(list(d.get("members") or [])), F.lit(str(d["code"]))), said, F)  # type: ignore[arg-type, return-value]
        return column, (), code  # type: ignore[return-value]

    def run(self) -> Answer:
        i = self.intent
        self.bound: dict[str, object] = {}
        if (i.measure is None) == (i.count is None):
            raise self.refuse("a measure or a count is asked for, not both")
        rule: Rule | None = None
        if i.count:
            self.fact = self.concept(i.count)
            measure = None
        else:
            measure = self.concept(i.measure or "")
            if measure.kind != "measure":
                raise self.refuse(f"{measure.name} is no measure", measure.name)
            rule = self.model.rules.get(measure.doc.get("derived_by_rule") or "")
            if rule is None and not measure.grounding.get("grounds_column"):
                raise self.refuse(f"{measure.name} has neither a rule nor a column", measure.name)
            self.fact = self.concept(rule.over[0]) if rule else next((c for c in self.model.owners(measure.relation or "") if c.kind in ("event", "entity")), measure)
            self.cite("SELECT", f"concept {measure.name}", rule.name if rule else measure.grounding["grounds_column"])
            if reading := (measure.doc.get("contract") or {}).get("default_reading"):
                self.said.append(str(reading))
        self.joined[()] = "f"
        self.cite("FROM", f"concept {self.fact.name}", self.fact.relation or "")
        wanted = self.restrictions()
        groups = []
        for asked in i.partition:
            ref, via, code = self.grouped_by(asked)
            self.usable(ref, "grouping")
            concept, column = self.column(ref)
            path = self.path(concept, via)
            if bad := next((e for a, e, _ in path if not e.many_to_one(a)), None):
                raise self.refuse(f"edge {bad.edge_id} meets several rows for one of {self.fact.name}; grouping by {ref} would count some twice", ref)
            groups.append((path, concept, column, asked if code is not None else column, code))
        for ref, test, strict in wanted:
            concept, column = self.column(ref)
            path = self.path(concept)
            many = next((n for n, (a, e, _) in enumerate(path) if not e.many_to_one(a)), None)
            if many is not None:
                self.exists(path, many, column, test)
                continue
            key = self.plan(path)
            condition = test(F.col(f"`{self.joined[key]}.{column}`"))
            if strict:
                self.strict.setdefault(key, []).append(condition)
            else:
                self.late.append(condition)
        for path, *_ in groups:
            self.plan(path)
        df = self.fact_rules(self.relation(self.fact))
        own = df.columns
        df = self.branch(df.toDF(*(f"f.{c}" for c in own)), ())
        for condition in self.late:
            df = df.filter(condition)
        value, name = self.value(measure, rule)
        df = self.finer(df, rule)
        names = {g[3] for g in groups}
        held = [f"`{self.place(path)}.{column}` AS `{f'_member_{name_}' if code is not None else name_}`" for path, _, column, name_, code in groups]
        plain = df.selectExpr(*held, *(f"`{c}` AS `{'f_' + c[2:] if c[2:] in names else c[2:]}`" for c in df.columns if c.startswith("f.")))
        for *_, name_, code in groups:
            if code is not None:
                plain = plain.withColumn(name_, code).drop(f"_member_{name_}")
        if self.bound:
            plain = plain.withColumns({k: F.lit(v) for k, v in self.bound.items()})
        out = plain.groupBy(*(g[3] for g in groups)).agg(value.alias(name))
        for _, concept, column, *_ in groups:
            self.cite("GROUP BY", f"concept {concept}", column)
        bad = self.guarded(plain, out, measure)
        if bad:
            raise self.refuse("; ".join(bad))
        return Answer(out, tuple(self.cited), tuple(self.said))

    def restrictions(self) -> list:
        i, out = self.intent, []
        for ref, value in i.restrict.items():
            self.usable(ref, "filtering")
            out.append((ref, lambda c, v=value, r=ref: self.matches(c, v, r), value is not None))
            self.cite("WHERE", f"concept {self.column(ref)[0]}", f"{self.column(ref)[1]} = {value!r}")
        if i.window:
            w = i.window
            out.append((w.column, lambda c: (c >= F.lit(w.start)) & (c < F.lit(w.end)), True))
            self.cite("WHERE", f"concept {self.column(w.column)[0]}", f"{w.start} <= {self.column(w.column)[1]} < {w.end}")
        bound = {*i.restrict, *i.partition, *([i.window.column] if i.window else [])}
        for axis, policy in (self.fact.doc.get("x-axes") or {}).items():
            ref = axis if "." in axis else f"{self.fact.name}.{axis}"
            if ref in bound:
                continue
            if policy.get("policy") == "mandatory_no_default":
                raise Refused(Ask(ref, tuple(policy.get("candidates") or ()), "required, and there is no default"))
            if policy.get("policy") == "assumable_default":
                out.append((ref, lambda c, v=policy["default"], r=ref: self.matches(c, v, r), policy["default"] is not None))
                self.said.append(f"{ref} was not given; {policy['default']!r} is assumed")
                self.cite("WHERE", f"default of {ref}", repr(policy["default"]))
        return out

    def exists(self, path: list[Step], many: int, column: str, test) -> None:
        """A restriction across an edge that meets several rows is a semi join, so none is multiplied."""
        key = self.plan(path[:many])
        start, edge, to = path[many]
        inner = _Compilation(self.model, self.catalog, self.intent)
        inner.fact = self.concept(to)
        inner.joined[()] = "f"
        far = inner.plan(path[many + 1 :])
        inner.strict[far] = [test(F.col(f"`{inner.joined[far]}.{column}`"))]
        right = inner.relation(inner.fact)
        right = inner.branch(right.toDF(*(f"f.{c}" for c in right.columns)), ())
        ends = self.ends(edge, start)
        self.semis.setdefault(key, []).append((right.select(*(F.col(f"`f.{b}`") for _, b in ends)), ends))
        self.cite("WHERE EXISTS", f"edge {edge.edge_id}", edge.join_rule or "")
        self.cited += inner.cited

    def fact_rules(self, df: DataFrame) -> DataFrame:
        """Rules asked for, and the fact's exclusion rules, as predicates; those without one are disclosed."""
        known = {r["id"]: r for r in self.fact.rules}
        for name in self.intent.rules:
            if name not in known:
                raise self.refuse(f"{self.fact.name} has no rule {name}", name)
        for rule_id, r in known.items():
            asked = rule_id in self.intent.rules
            always = str(r.get("kind", "")).endswith("exclusion") and self.intent.measure is not None
            if not asked and not always:
                continue
            test = predicate(rule_id, r.get("binds") or [])
            if test is None:
                if asked:
                    raise self.refuse(f"rule {rule_id} has no executable form", rule_id)
                self.said.append(f"{rule_id}: {r.get('then', '')}")
                continue
            df = df.filter(test)
            self.cite("WHERE", f"rule {rule_id}", ", ".join(r.get("binds") or []))
        return df

    def finer(self, df: DataFrame, rule: Rule | None) -> DataFrame:
        """Relations of a finer grain that a rule reads are summed up to the fact's key before they are joined."""
        for spec in (rule.doc.get("x-pre_aggregates") or []) if rule else []:
            keys = spec["keys"]  # fact column -> finer column
            agg = self.catalog[spec["relation"]]
            if spec.get("where"):
                agg = agg.filter(F.expr(spec["where"]))
            agg = agg.groupBy(*keys.values()).agg(*(F.sum(F.expr(e)).alias(f"f.{n}") for n, e in spec["sums"].items()))
            agg = agg.select(*(F.col(b).alias(f"_k{n}") for n, b in enumerate(keys.values())), *(F.col(f"`f.{n}`") for n in spec["sums"]))
            on = F.lit(True)
            for n, a in enumerate(keys):
                on = on & (F.col(f"`f.{a}`") == F.col(f"_k{n}"))
            df = df.join(agg, on, "left").drop(*(f"_k{n}" for n in range(len(keys))))
            df = df.withColumns({f"f.{n}": F.coalesce(F.col(f"`f.{n}`"), F.lit(0)) for n in spec["sums"]})
            self.cite("LEFT JOIN", f"rule {rule.name}", f"{spec['relation']} summed by {', '.join(keys)}")  # type: ignore[union-attr]
        return df

    def value(self, measure: Concept | None, rule: Rule | None) -> tuple[Column, str]:
        if measure is None:
            return F.count(F.lit(1)), "n"
        if rule is None:
            effects = set(measure.effects.values())
            name = self.intent.fold or ("avg" if "averageable" in effects else "sum")
            return fold(name, F.col(measure.grounding["grounds_column"])), snake(measure.name)
        if rule.render_kind == "spark_udf" and rule.doc.get("x-udf"):
            self.cite("SELECT", f"rule {rule.name}", rule.doc["x-udf"]["name"])
            return fold(rule.doc["x-udf"].get("fold", "sum"), call_udf(rule.doc["x-udf"]["name"], *rule.doc["x-udf"].get("columns") or [])), rule.name
        if rule.render_kind != "sql_expression" or not rule.template:
            raise self.refuse(f"rule {rule.name} ({rule.render_kind}) gives no expression to aggregate", rule.name)
        given = dict(self.intent.parameters)
        if self.intent.window:
            given |= {"period_start": self.intent.window.start, "period_end": self.intent.window.end}
        try:
            text, self.bound = rendered(rule.template, given)
        except KeyError as e:
            raise self.refuse(f"rule {rule.name} needs {e.args[0]}", e.args[0]) from None
        self.cite("SELECT", f"rule {rule.name}", text.strip())
        return expression(text), rule.name

    def guarded(self, plain: DataFrame, out: DataFrame, measure: Concept | None) -> list[str]:
        if measure is None or self.intent.fold not in (None, "sum"):
            return []
        # an axis without a column (null) is one that the relation has a single value of
        axes = measure.doc.get("x-axis_columns") or {}
        effects = {axes.get(a, a): e for a, e in measure.effects.items() if e != "additive" and axes.get(a, a) is not None}
        if not effects:
            return []
        columns = measure.doc.get("x-measure_columns") or [measure.grounding.get("grounds_column") or ""]
        return [v for c in columns if c for v in additivity_guard(out, c, effects)]


def compile_intent(model: Model, catalog: Catalog, intent: Intent) -> Answer | Ask | NotDerivable:
    try:
        return _Compilation(model, catalog, intent).run()
    except Refused as r:
        return r.answer


def derived_set(model: Model, catalog: Catalog, rule_name: str, parameters: Mapping[str, object] | None = None) -> DataFrame:
    """The rows of a rule that defines a set: its query, run over the catalog's relations by their bare names. Conditionals of
    its template are settled by the parameters, which are bound, never put into the text."""
    rule = model.rules[rule_name]
    if rule.render_kind == "sql_view":
        return catalog[rule.doc["view_ref"]]
    if rule.render_kind != "derived_set" or not rule.template:
        raise ValueError(f"rule {rule_name} ({rule.render_kind}) defines no set")
    for name in rule.doc.get("validated_against") or []:
        catalog[name].createOrReplaceTempView(name.split(".")[-1])
    text, bound = rendered(rule.template, parameters or {}, ":{}")
    return catalog.spark.sql(text, args=bound or None)


def related(model: Model, catalog: Catalog, edge_id: str) -> DataFrame:
    """The relation set of a business edge, through the rule that it names."""
    edge = model.edges[edge_id]
    if edge.level != "business" or not edge.doc.get("resolved_by"):
        raise ValueError(f"edge {edge_id} is resolved by no rule")
    return derived_set(model, catalog, str(edge.doc["resolved_by"]).rsplit(".", 1)[-1])
