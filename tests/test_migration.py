import json
import random

from pyspark.sql import functions as F

from ledgerloom.operators import migration

RULES = [
    {"type": "p/Contact", "from": 1, "rename": {"mail": "email", "name": "label"}},
    {"type": "p/Contact", "from": 2, "split": {"attr": "sort", "values": {"person": "p/Person", "firm": "p/Firm", "shop": "p/Firm"}}, "rename": {"sort": "kind"}},
    {"type": "p/Person", "from": 3, "rename": {"label": "full_name", "email": "mail"}},
    {"type": "p/Firm", "from": 3, "split": {"attr": "kind", "values": {"shop": "p/Shop"}, "otherwise": "p/Company"}},
    {"type": "p/Shop", "from": 4, "rename": {"kind": "label"}},
]
TERMS = [{"term": "red", "from": 1, "to": "crimson"}, {"term": "crimson", "from": 2, "to": "dark"}, {"term": "blue", "from": 3, "to": "red"}]


def stepwise(node: dict, rules: list[dict], target: int) -> dict:
    """view() of one node {type, version, attributes}, a version at a time."""
    out, known = dict(node), {r["type"] for r in rules} | {t for r in rules if "split" in r for t in [*r["split"]["values"].values(), r["split"].get("otherwise", r["type"])]}
    if out["type"].split("@")[0] not in known or out["version"] >= target:
        return out
    type_, attrs = out["type"].split("@")[0], dict(out["attributes"])
    for v in range(out["version"], target):
        mine = [r for r in rules if r["from"] == v and r["type"] == type_]
        for r in mine:
            if "split" in r:
                value = attrs.get(r["split"]["attr"])
                type_ = r["split"]["values"].get(value if isinstance(value, str) else json.dumps(value), r["split"].get("otherwise", type_))
        for r in mine:
            renames = r.get("rename", {})
            moved = {renames[k]: x for k, x in attrs.items() if k in renames}
            attrs = {k: x for k, x in attrs.items() if k not in renames and k not in renames.values()} | moved
    return {"type": f"{type_}@{target}", "version": target, "attributes": attrs}


def test_one_step_equals_many(spark):
    r, nodes = random.Random(3), []
    for i in range(400):
        attrs = {k: v for k, v in {"mail": f"m{i}", "email": f"e{i}", "name": i, "label": [i, {"x": None}], "sort": r.choice(["person", "firm", "shop", "club", 7]), "kind": r.choice(["shop", "firm"]), "it's": True}.items() if r.random() < 0.6}
        nodes.append({"type": r.choice(["p/Contact", "p/Person@2", "p/Firm", "p/Shop@1", "p/Other"]), "version": r.randint(1, 6), "attributes": attrs})
    rows = [(str(i), n["type"], n["version"], json.dumps(n["attributes"]), "kept") for i, n in enumerate(nodes)]
    df = spark.createDataFrame([*rows, ("none", "p/Contact", 1, None, None), ("lost", None, None, "{}", None)], "id string, type string, version int, attributes string, more string")
    for target in (1, 2, 3, 4, 5):
        got = {x.id: x for x in migration.view(df, RULES, target).collect()}
        assert len(got) == len(rows) + 2 and got["lost"].type is None and got["none"].attributes is None
        for i, n in enumerate(nodes):
            x, want = got[str(i)], stepwise(n, RULES, target)
            assert {"type": x.type, "version": x.version, "attributes": json.loads(x.attributes)} == want, (n, target)
            assert x.more == "kept"
    assert {x.type for x in migration.view(df, RULES, 5).where("version = 5").select(F.substring_index("type", "@", 1).alias("type")).collect()} >= {"p/Contact", "p/Person", "p/Company", "p/Shop"}


def test_terms(spark):
    rows = [(t, v) for t in ("red", "red@1", "crimson", "blue@1", "green") for v in range(1, 6)]
    df = spark.createDataFrame(rows, "term string, version int")
    for target in (1, 2, 3, 4):
        got = sorted(map(tuple, migration.terms(df, TERMS, target).collect()))
        want = []
        for t, v in rows:
            name, at = t.split("@")[0], v
            if name != "green" and v < target:
                for k in range(v, target):
                    name = next((x["to"] for x in TERMS if x["from"] == k and x["term"] == name), name)
                want.append((f"{name}@{target}", target))
            else:
                want.append((t, at))
        assert got == sorted(want)
