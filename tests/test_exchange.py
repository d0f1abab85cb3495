import json
import subprocess

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import canon, sign
from ledgerloom.operators import catalog, diff, fold
from ledgerloom.sources import exchange, git, log

SEED = bytes(range(32))
PAYLOADS = [
    {"kind": "node", "id": "a", "type": "m/Note@1", "attributes": {"title": "A", "body": "long\n\ntext"}},
    {"kind": "node", "id": "b", "type": "m/Note@1", "attributes": {"title": "B: x", "body": ""}},
    {"kind": "node", "id": "c", "type": "m/Other", "attributes": {"n": 3}},
    {"kind": "node", "id": "s", "type": "meta/Struct@1", "attributes": {"name": "S"}},
    {"kind": "edge", "id": "e1", "type": "m/likes", "from": "node:a", "to": "node:b"},
    {"kind": "edge", "id": "e2", "type": "m/likes", "from": "node:a", "to": "node:c"},
    {"kind": "classification", "id": "k1", "subject": "node:a", "term": "work@1", "asserted_by": "x", "basis": "manual"},
    {"kind": "classification", "id": "k2", "subject": "node:b", "term": "desk", "asserted_by": "x", "basis": "manual"},
    {"kind": "classification", "id": "k3", "subject": "node:c", "term": "home", "asserted_by": "x", "basis": "manual"},
]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [log.op_row("h", i, {"create": p}) | {"seq": 1} for i, p in enumerate(PAYLOADS)]
    ops = spark.createDataFrame(rows, log.OPS + ", seq long")
    return ops, fold.latest_state(ops), spark.createDataFrame([("desk", "work"), ("work", None), ("home", None)], "t string, p string")


def test_bundle(spark, tables):
    ops, state, terms = tables
    closure = catalog.closure(terms, "t", "p")
    payloads = ops.select("kind", "id", "payload")
    head, objects = exchange.bundle(state, payloads, closure, "work", "g1", "g2", "rev", "anna", SEED, "2026-01-01T00:00:00Z")
    assert sorted((r.kind, r.id) for r in objects.collect()) == [("classification", "k1"), ("classification", "k2"), ("edge", "e1"), ("node", "a"), ("node", "b"), ("node", "s")]
    peers = {"g1": sign.public_key(SEED).hex()}
    assert all(r.rev_ok and r.proof_ok for r in exchange.verify_bundle(head, objects, peers, "g2").collect())
    bad = exchange.verify_bundle(head, objects.withColumn("payload", F.replace("payload", F.lit("long"), F.lit("short"))), peers, "g2").where("not rev_ok")
    assert [r.id for r in bad.collect()] == ["a"]
    assert exchange.verify_bundle(head, objects.withColumn("rev", F.lit("sha256:" + "0" * 64)), peers, "g2").where("proof_ok").count() == 0
    with pytest.raises(ValueError, match="audience"):
        exchange.verify_bundle(head, objects, peers, "g3")
    with pytest.raises(ValueError, match="peer"):
        exchange.verify_bundle(head, objects, {}, "g2")
    head["checkpoint"]["state_hash"] = "sha256:" + "0" * 64
    with pytest.raises(ValueError, match="signature"):
        exchange.verify_bundle(head, objects, peers, "g2")
    creates = exchange.imported(objects, head)
    assert creates[0]["create"]["provenance"]["derived_from"][0].startswith("graph:g1/a@sha256:")


def test_markdown_round_trip(spark, tables):
    _, state, _ = tables
    long_text = {"m/Note": "body"}
    pages = exchange.markdown(state, long_text)
    found = {r.path: r.text for r in pages.collect()}
    assert sorted(found) == ["desk/b.md", "home/c.md", "work/a.md"]
    assert found["work/a.md"].endswith("---\n\nlong\n\ntext\n") and "m/likes" in found["work/a.md"]
    back = exchange.read_markdown(pages, long_text)
    assert exchange.edited(back).count() == 0 and back.count() == 3
    changed = exchange.read_markdown(pages.withColumn("text", F.replace("text", F.lit("long"), F.lit("short"))), long_text)
    assert [r.id for r in exchange.edited(changed).collect()] == ["a"]
    broken = exchange.read_markdown(spark.createDataFrame([("x.md", "no front"), ("y.md", "---\nid: [\n---\n")], "path string, text string"), long_text)
    assert broken.where("error is not null").count() == 2


def test_six_tables_and_triples(spark, tables, tmp_path):
    ops, state, _ = tables
    sets = spark.createDataFrame([("h",)], "hash string")
    exchange.write_tables(state, sets, ops, str(tmp_path))
    got = exchange.read_tables(spark, str(tmp_path))
    assert {n: df.count() for n, df in got.items()} == {"nodes": 4, "edges": 2, "classifications": 3, "documents": 0, "changesets": 1, "lineage": 0}
    found = {tuple(r) for r in exchange.triples(state).collect()}
    assert ("node:a", "m/likes", "node:b") in found and ("node:c", "n", "3") in found and ("node:a", "classified", "work") in found


def test_log_files_and_yaml(spark, tmp_path):
    docs = [{"parents": [], "operations": [{"create": PAYLOADS[0]}], "timestamp": "2026-01-01"}]
    docs[0]["hash"] = canon.changeset_hash(docs[0])
    docs.append({"parents": [docs[0]["hash"]], "operations": [{"delete": {"kind": "node", "id": "a", "prior": "x"}}], "intent": "gone"})
    docs[1]["hash"] = canon.changeset_hash(docs[1])
    for d in docs:
        (tmp_path / f"{d['hash'][7:]}.yaml").write_text(log.dump_yaml(d))
    (tmp_path / "broken.yaml").write_text("a: [")
    (tmp_path / "list.yaml").write_text("- 1")
    files = log.files(spark, str(tmp_path))
    sets = log.read_changesets(files)
    assert {r.hash for r in sets.collect()} == {d["hash"] for d in docs} and sets.where("hash <> stored").count() == 0
    order = log.chain(sets.select("graph", "hash", "parents"), spark.createDataFrame([("g", docs[1]["hash"])], "graph string, head string"))
    assert [r.verb for r in log.numbered(log.read_ops(files), order).orderBy("seq").collect()] == ["create", "delete"]
    assert log.issues(files).count() == 2
    assert log.parse_yaml("on: yes\nt: 2026-01-01T00:00:00Z\nn: 0x1f\nb: true\nx: ~\nf: 1.5") == [{"on": "yes", "t": "2026-01-01T00:00:00Z", "n": 31, "b": True, "x": None, "f": 1.5}]


def test_git(spark, tmp_path):
    repo = str(tmp_path)

    def run(*args):
        subprocess.run(["git", "-C", repo, "-c", "user.name=a", "-c", "user.email=a@b", *args], check=True, capture_output=True)

    run("init", "-q", "-b", "main")
    (tmp_path / "a.rs").write_text("pub fn refund() {\n    validate();\n}\n\nfn validate() {\n}\n")
    (tmp_path / "b.rs").write_text("struct Thing {\n    x: u8,\n}\nfn alone() {\n    revalidate();\n}\n")
    run("add", ".")
    run("commit", "-qm", "one")
    first = git.resolve(repo, "main")
    (tmp_path / "a.rs").write_text("pub fn refund() {\n    1\n}\n\nfn validate() {\n    2\n}\n")
    (tmp_path / "b.rs").unlink()
    (tmp_path / "c.py").write_text("x")
    run("add", "-A")
    run("commit", "-qm", "two")
    second = git.resolve(repo, "main")
    assert {(r.path, r.verb) for r in git.changes(spark, repo, second).collect()} == {("a.rs", "update"), ("b.rs", "delete"), ("c.py", "create")}
    assert {r.verb for r in git.changes(spark, repo, first).collect()} == {"create"}
    assert git.revision(repo, second)["parents"] == [first] and git.heads(repo) == {"refs/heads/main": second}
    one, two = (git.code_graph(git.with_text(git.tree(spark, repo, c), repo)) for c in (first, second))
    assert {(r.caller, r.callee) for r in one["calls"].collect()} == {("refund", "validate"), ("alone", "validate")}
    delta = git.graph_changes(two, one)
    assert {(r.path, r.verb) for r in delta["files"].collect()} == {("a.rs", "update"), ("b.rs", "delete"), ("c.py", "create")}
    assert delta["calls"].where("verb = 'delete'").count() == 2 and delta["items"].where("verb = 'delete'").count() == 2
    assert all(df.count() == 0 for df in git.graph_changes(one, one).values())
    radius = git.blast_radius(spark.createDataFrame([("a.rs", "validate")], "path string, name string"), one["calls"])
    assert radius.first().callers == ["alone", "refund"]
    git.add_decision(repo, second, {"verdict": "approve"})
    git.add_decision(repo, second, {"verdict": "reject"})
    assert [d["verdict"] for d in git.decisions(repo, second)] == ["approve", "reject"] and git.decisions(repo, first) == []


def test_snapshot_nulls(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, None), (4, "y")], "k int, v string")
    assert {tuple(r) for r in diff.snapshot_diff(a, b, ["k"], ["v"]).collect()} == {(2, "update"), (3, "create"), (4, "delete")}
    assert json.loads("{}") == {}
