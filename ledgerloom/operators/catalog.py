"""The schema of a graph: packages, types, taxonomies, from documents or from the graph's own schema nodes.

The registry is small and is compiled on the driver; what rows are checked
against are its tables (types and their ancestors, attributes with what they
inherit, edge ends, terms and their closure).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.shared import saved
from ..functions.text import META_TYPES, bare

MAX_HOPS = 32


def _meta_package() -> dict:
    """The fixed package that describes schema nodes themselves."""

    def attrs(*required: str, **more: str) -> dict:
        out = {n: {"type": "string", "required": True} for n in required}
        return {"attributes": out | {n: {"type": t} for n, t in more.items()}}

    usual = {"version": "int", "imports": "list<string>"}
    types = {t: attrs("name", "package", "definition", **usual) for t in ("EntityType", "EdgeType", "Struct", "ValidationRule")}
    types["TaxonomyTerm"] = attrs("name", "taxonomy", version="int", parents="list<string>", status="enum<active|deprecated>", definition="string")
    types["Policy"] = attrs("name", "definition")
    return {"ontology": "meta", "version": 1, "entity_types": types}


@dataclass
class Package:
    types: dict = field(default_factory=dict)
    edges: dict = field(default_factory=dict)
    structs: dict = field(default_factory=dict)
    rules: list = field(default_factory=list)
    imports: list = field(default_factory=list)
    version: int | None = None


@dataclass
class Registry:
    packages: dict[str, Package] = field(default_factory=dict)
    taxonomies: dict[str, dict[str, list[str]]] = field(default_factory=dict)

    @classmethod
    def of(cls, docs: list[dict]) -> Registry:
        """From ontology and taxonomy documents, on top of the meta package; others are passed over."""
        reg = cls()
        for doc in [_meta_package(), *docs]:
            if isinstance(name := doc.get("ontology"), str):
                imports = [i["ontology"] for i in doc.get("imports") or [] if isinstance(i, dict) and "ontology" in i]
                reg.packages[name] = Package(doc.get("entity_types") or {}, doc.get("edge_types") or {}, doc.get("structs") or {}, doc.get("validation_rules") or [], imports, doc.get("version"))
            elif isinstance(name := doc.get("taxonomy"), str):
                reg.taxonomies[name] = {t["name"]: list(t.get("parents") or []) for t in doc.get("terms") or [] if "name" in t}
        return reg

    @classmethod
    def of_nodes(cls, nodes: list[dict], parse) -> Registry:
        """From live schema nodes {type, attributes}; ``parse`` reads a definition's text."""
        reg = cls.of([])
        for node in nodes:
            kind, a = bare(node["type"]), node.get("attributes") or {}
            if kind == "meta/TaxonomyTerm":
                reg.taxonomies.setdefault(a["taxonomy"], {})[a["name"]] = list(a.get("parents") or [])
            elif kind in META_TYPES and kind != "meta/Policy":
                if a["package"] == "meta":
                    raise ValueError("schema nodes can't claim the meta package")
                p = reg.packages.setdefault(a["package"], Package())
                body = parse(a["definition"])
                if kind == "meta/ValidationRule":
                    p.rules.append(body)
                else:
                    {"meta/EntityType": p.types, "meta/EdgeType": p.edges, "meta/Struct": p.structs}[kind][a["name"]] = body or {}
                p.imports = sorted({*p.imports, *(a.get("imports") or [])})
                p.version = a.get("version", p.version)
        return reg

    def resolve(self, ref: str, package: str | None = None) -> tuple[str, str] | None:
        """(package, name) of an entity type; a bare name is the package's own."""
        name = bare(ref)
        package, name = name.rsplit("/", 1) if "/" in name else (package, name)
        return (package, name) if package in self.packages and name in self.packages[package].types else None

    def ancestors(self, ref: str, package: str | None = None) -> list[str]:
        """The type itself and what it extends, nearest first, up to 32 steps."""
        out, at = [], self.resolve(ref, package)
        while at and len(out) <= MAX_HOPS:
            out.append("/".join(at))
            parent = (self.packages[at[0]].types[at[1]] or {}).get("extends")
            at = self.resolve(parent, at[0]) if parent else None
        return out

    def satisfies(self, actual: str, allowed: str, package: str | None = None) -> bool:
        target = self.resolve(allowed, package)
        return target is not None and "/".join(target) in self.ancestors(actual, package)

    def attributes(self, ref: str) -> dict[str, dict]:
        """A type's attributes with what it inherits; the nearest definition wins."""
        out: dict[str, dict] = {}
        for name in dict.fromkeys(self.ancestors(ref)):
            package, t = name.rsplit("/", 1)
            for a, d in ((self.packages[package].types[t] or {}).get("attributes") or {}).items():
                out.setdefault(a, d or {})
        return out

    def struct(self, name: str) -> dict | None:
        return next((p.structs[name] for p in self.packages.values() if name in p.structs), None)

    def closure(self, term: str) -> set[str]:
        """A term and all its ancestors in any taxonomy; cycles end."""
        seen, todo = set(), [bare(term)]
        while todo:
            if (t := todo.pop()) not in seen:
                seen.add(t)
                todo += [bare(p) for terms in self.taxonomies.values() for p in terms.get(t, [])]
        return seen

    def term_exists(self, ref: str) -> bool:
        return any(bare(ref) in terms for terms in self.taxonomies.values())

    # tables

    def type_names(self) -> list[str]:
        return [f"{p}/{t}" for p, pkg in self.packages.items() for t in pkg.types]

    def ancestor_table(self, spark: SparkSession) -> DataFrame:
        rows = [(t, a, d) for t in self.type_names() for d, a in enumerate(self.ancestors(t))]
        return spark.createDataFrame(rows, "type string, ancestor string, depth int")

    def attribute_table(self, spark: SparkSession) -> DataFrame:
        rows = [(t, a, d.get("type"), d.get("required") is True) for t in self.type_names() for a, d in self.attributes(t).items()]
        return spark.createDataFrame(rows, "type string, attr string, texpr string, required boolean")

    def edge_table(self, spark: SparkSession) -> DataFrame:
        """(edge, side, allowed): every type that an edge's end may have, subtypes included."""
        rows = []
        for p, pkg in self.packages.items():
            for name, body in pkg.edges.items():
                for side, key in (("from_ref", "domain"), ("to_ref", "range")):
                    allowed = (body or {}).get(key) or []
                    for a in [allowed] if isinstance(allowed, str) else allowed:
                        rows += [(f"{p}/{name}", side, t) for t in self.type_names() if self.satisfies(t, a, p)]
        return spark.createDataFrame(sorted(set(rows)), "edge string, side string, allowed string")

    def term_table(self, spark: SparkSession) -> DataFrame:
        """(term, parent), parents united over all taxonomies; a root has a null parent."""
        rows = {(t, bare(p)) for terms in self.taxonomies.values() for t, ps in terms.items() for p in ps}
        rows |= {(t, None) for terms in self.taxonomies.values() for t in terms if not any(r[0] == t for r in rows)}
        return spark.createDataFrame(sorted(rows, key=str), "term string, parent string")


def closure(edges: DataFrame, child: str, parent: str, hops: int | None = None) -> DataFrame:
    """(node, ancestor, depth): the reflexive, transitive closure with least depths; cycles end."""
    pairs = edges.select(F.col(child).alias("c"), F.col(parent).alias("p"))
    far = reach(pairs, "c", "p", hops).where("node <> ancestor")
    nodes = pairs.select(F.explode(F.array("c", "p")).alias("node")).where("node is not null").distinct()
    return nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth")).unionByName(far.select("node", "ancestor", F.col("depth").cast("int").alias("depth")))


def reach(edges: DataFrame, child: str, parent: str, hops: int | None = None) -> DataFrame:
    """(node, ancestor, depth): pairs that one edge or more connect, with least depths, up to ``hops`` where they are given.

    A round doubles what is known: a shortest path of more than n edges and no
    more than 2 n starts with a shortest path of n, so only the paths of just n
    edges are composed with all.  The number of rounds is the logarithm of the
    depth; each is saved and keeps one row for a pair, so cycles end and
    diamonds cost nothing.
    """
    now = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).where("node is not null and ancestor is not null").distinct()
    now, span = saved(now.withColumn("depth", F.lit(1).cast("long")), "reach"), 1
    while (hops is None or span < hops) and now.where(F.col("depth") == span).limit(1).count():
        far = now.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("a2"), F.col("depth").alias("d2"))
        both = now.where(F.col("depth") == span).join(far, "ancestor").select("node", F.col("a2").alias("ancestor"), (F.col("depth") + F.col("d2")).alias("depth"))
        now = saved(now.unionByName(both).groupBy("node", "ancestor").agg(F.min("depth").alias("depth")), "reach")
        span *= 2
    return now if hops is None else now.where(F.col("depth") <= hops)


def cycles(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """(node): every node that is its own ancestor by one step or more."""
    return reach(edges, child, parent).where("node = ancestor").select("node").distinct()


def inherited(attrs: DataFrame, ancestors: DataFrame) -> DataFrame:
    """(type, attr, definition, declared_by): attributes of types with what they inherit; the nearest ancestor's wins."""
    joined = ancestors.join(attrs.select(F.col("type").alias("ancestor"), "attr", "definition"), "ancestor")
    best = joined.groupBy("type", "attr").agg(F.min_by(F.struct("definition", "ancestor"), F.struct("depth", "ancestor")).alias("d"))
    return best.select("type", "attr", "d.definition", F.col("d.ancestor").alias("declared_by"))


def describe(reg: Registry, spark: SparkSession) -> DataFrame:
    """A row for each package: its version, types with all attributes, edge types, structs, imports."""
    rows = []
    for name, p in sorted(reg.packages.items()):
        types = [f"{t}({', '.join(sorted(reg.attributes(f'{name}/{t}')))})" for t in sorted(p.types)]
        rows.append((name, p.version, types, sorted(p.edges), sorted(p.structs), sorted(p.imports), len(p.rules)))
    return spark.createDataFrame(rows, "package string, version int, types array<string>, edges array<string>, structs array<string>, imports array<string>, n_rules int")


def meta_nodes(state: DataFrame) -> DataFrame:
    """Live schema nodes of a state, in key order."""
    from .fold import live

    kinds = F.substring_index("type", "@", 1)
    return live(state).where((F.col("kind") == "node") & kinds.isin(META_TYPES)).select("id", "type", "attributes").orderBy("id")


def union_terms(terms: DataFrame) -> DataFrame:
    """(term, parents) of terms(term, parent): sorted parents united over all taxonomies; none for a root."""
    return terms.groupBy("term").agg(F.array_sort(F.collect_set("parent")).alias("parents"))


def dependency_order(packages: DataFrame, imports: DataFrame) -> DataFrame:
    """(package, n_before, order) of packages(package) by imports(package, import): every package after all that it imports.

    What a package rests on is less than what rests on it, so the number of
    packages that it reaches is such an order; names break ties.  Packages on
    a cycle have no order.
    """
    up = reach(imports, "package", "import")
    ring = up.where("node = ancestor").select(F.col("node").alias("package"))
    n = up.join(packages.select(F.col("package").alias("ancestor")), "ancestor", "left_semi").groupBy(F.col("node").alias("package")).agg(F.count("*").alias("n"))
    out = packages.join(n, "package", "left").select("package", F.coalesce("n", F.lit(0)).alias("n_before"))
    before = out.groupBy("n_before").agg(F.count("*").alias("__m"))
    starts = before.select("n_before", F.coalesce(F.sum("__m").over(Window.orderBy("n_before").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__s"))
    rank = F.row_number().over(Window.partitionBy("n_before").orderBy("package"))
    out = out.withColumn("__r", rank).join(starts, "n_before").join(ring.withColumn("__ring", F.lit(True)), "package", "left")
    return out.select("package", "n_before", F.when(F.col("__ring").isNull(), F.col("__s") + F.col("__r")).alias("order"))
