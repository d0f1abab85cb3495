"""Objects of older schema versions as a later version shows them: renamed attributes, split types, mapped terms."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bare_col

TABLE = "type string, version int, path int, conditions array<struct<attr:string,given:boolean,values:array<string>>>, to_type string, renames map<string,string>, gone array<string>"


@dataclass
class _Path:
    """What objects of one type and version become on the way through the splits that fit them."""

    type: str
    conditions: list[tuple[str, bool, tuple[str, ...]]] = field(default_factory=list)
    names: dict[str, str] = field(default_factory=dict)  # a renamed attribute's name at the start, by its name now
    gone: frozenset[str] = frozenset()  # names at the start of what gave way to another

    def source(self, name: str) -> str | None:
        """The name at the start of what is called so now; None if nothing is."""
        return self.names.get(name, None if name in self.gone or name in self.names.values() else name)


def _steps(paths: list[_Path], rules: list[dict]) -> list[_Path]:
    """Paths after the rules of one version: splits first, by the names of the old version, then the renames of the new types."""
    out = []
    for p in paths:
        split = next((r["split"] for r in rules if r["type"] == p.type and "split" in r), None)
        renames = next((r["rename"] for r in rules if r["type"] == p.type and "rename" in r), {})
        left = {p.source(new) for new in renames.values() if new not in renames} - {None}
        names = {now: source for now, source in p.names.items() if now not in renames and now not in renames.values()}
        names |= {new: source for old, new in renames.items() if (source := p.source(old)) is not None}
        gone = p.gone | left
        if not split:
            out.append(_Path(p.type, p.conditions, names, gone))
            continue
        source, by_type = p.source(split["attr"]), {}
        for value, type_ in split["values"].items():
            by_type.setdefault(type_, []).append(value)
        for type_, values in by_type.items():
            out.append(_Path(type_, [*p.conditions, (source or "", True, tuple(values))], names, gone))
        out.append(_Path(split.get("otherwise", p.type), [*p.conditions, (source or "", False, tuple(split["values"]))], names, gone))
    return out


def composed(spark: SparkSession, rules: list[dict], target: int) -> DataFrame:
    """TABLE: for each type and version below ``target`` that a rule speaks of, what its objects become, all steps in one.

    Rules are {"type", "from", "rename": {old: new}} and {"type", "from",
    "split": {"attr", "values": {value: type}, "otherwise"}}, from a version to
    the next, one of each kind for a type and version.  A split's conditions are
    told by the attribute's name at the start.  The table is as small as the
    schema, so it is made on the driver.
    """
    rows = []
    types = sorted({r["type"] for r in rules} | {t for r in rules if "split" in r for t in [*r["split"]["values"].values(), r["split"].get("otherwise", r["type"])]})
    for type_ in types:
        for version in range(1, target):
            paths = [_Path(type_)]
            for v in range(version, target):
                paths = _steps(paths, [r for r in rules if r["from"] == v])
            for i, p in enumerate(paths):
                rows.append((type_, version, i, [(a, g, list(vs)) for a, g, vs in p.conditions], p.type, {old: new for new, old in p.names.items() if old != new}, sorted(p.gone)))
    return spark.createDataFrame(rows, TABLE)


def view(nodes: DataFrame, rules: list[dict], target: int) -> DataFrame:
    """nodes(id, type, version, attributes, ...) with type, version and attributes as the target version shows them.

    One broadcast join with composed() and one projection, however many versions
    lie between; an object that no rule speaks of, or of the target version or
    a later one, stays as it is.  An attribute that has a new name of another
    gives way, whether that one is there or not.  Attributes are a JSON object; values keep their
    types.  Null attributes have none, a null type or version is left alone.
    """
    rule = F.broadcast(composed(nodes.sparkSession, rules, target)).withColumnsRenamed({"type": "__t", "version": "__v"})
    on = (bare_col(F.col("type")) == F.col("__t")) & (F.col("version") == F.col("__v"))
    values = F.from_json("attributes", "map<string,string>")

    def fits(c):
        # no such attribute: a null, which is none of the values
        known = F.coalesce(F.array_contains(c["values"], F.try_element_at(F.col("__values"), c["attr"])), F.lit(False))
        return known == c["given"]

    keyed = nodes.withColumn("__values", values).join(rule, on & F.forall("conditions", fits), "left")
    entries = F.map_entries(F.from_json("attributes", "map<string,variant>"))
    kept = F.filter(entries, lambda e: ~F.array_contains("gone", e["key"]))
    moved = F.transform(kept, lambda e: F.struct(F.coalesce(F.try_element_at(F.col("renames"), e["key"]), e["key"]).alias("key"), e["value"].alias("value")))
    changed = F.col("to_type").isNotNull()
    attributes = F.when(changed & F.col("attributes").isNotNull() & ((F.size("renames") > 0) | (F.size("gone") > 0)), F.to_json(F.map_from_entries(moved))).otherwise(F.col("attributes"))
    new = {"type": F.when(changed, F.concat(F.col("to_type"), F.lit(f"@{target}"))).otherwise(F.col("type")), "version": F.when(changed, F.lit(target)).otherwise(F.col("version")), "attributes": attributes}
    return keyed.select(*(new[c].alias(c) if c in new else F.col(c) for c in nodes.columns))


def terms(classifications: DataFrame, rules: list[dict], target: int) -> DataFrame:
    """classifications(term, version, ...) with terms mapped by {"term", "from", "to"} from each one's version to the target."""
    moves: dict[int, dict[str, str]] = {}
    for r in rules:
        moves.setdefault(r["from"], {})[r["term"]] = r["to"]
    names, rows = sorted({r["term"] for r in rules} | {r["to"] for r in rules}), []
    for name in names:
        for version in range(1, target):
            now = name
            for v in range(version, target):
                now = moves.get(v, {}).get(now, now)
            rows.append((name, version, now))
    table = F.broadcast(classifications.sparkSession.createDataFrame(rows, "__n string, __v int, __to string"))
    found = classifications.join(table, (bare_col(F.col("term")) == F.col("__n")) & (F.col("version") == F.col("__v")), "left")
    old = F.col("version") < target
    new = {"term": F.when(F.col("__to").isNotNull(), F.concat(F.col("__to"), F.lit(f"@{target}"))).otherwise(F.col("term")), "version": F.when(old & F.col("__to").isNotNull(), F.lit(target)).otherwise(F.col("version"))}
    return found.select(*(new[c].alias(c) if c in new else F.col(c) for c in classifications.columns))
