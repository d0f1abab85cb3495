"""Keys, stores, substrates and the everyday transactions."""

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import canon, sign
from ledgerloom.plans import engine as E
from ledgerloom.plans import flows
from ledgerloom.sources import exchange, git, log
from ledgerloom.sources.docstore import FsStore, HadoopStore, MemStore
from ledgerloom.sources.keys import FileKeys, MemoryKeys
from ledgerloom.sources.substrate import GitSubstrate, NativeSubstrate

TEXT = {"type": "string"}
CORE = {
    "ontology": "core",
    "version": 1,
    "entity_types": {
        "Principal": {"attributes": {"display_name": {"type": "string", "required": True}, "keys": {"type": "json"}, "status": TEXT, "delegated_by": TEXT, "scope": {"type": "json"}}},
        **{t: {"extends": "Principal"} for t in ("User", "Agent", "Service")},
        "Peer": {"attributes": {"graph_id": TEXT, "root_keys": {"type": "list<string>"}, "trust_basis": TEXT}},
        "Grant": {"attributes": {"audience": TEXT, "scope": {"type": "json"}, "rights": {"type": "list<string>"}}},
    },
}
MEMORY = {
    "ontology": "memory",
    "version": 1,
    "imports": [{"ontology": "core"}],
    "entity_types": {"Note": {"attributes": {"content": TEXT}}, "Preference": {"attributes": {"statement": TEXT, "strength": TEXT}}},
    "edge_types": {"relates_to": {"domain": ["Preference"], "range": ["Note"]}},
}
CODE = {
    "ontology": "code",
    "version": 1,
    "entity_types": {
        "Repository": {"attributes": {"name": TEXT, "origin": TEXT}},
        "SourceFile": {"attributes": {"path": TEXT, "language": TEXT, "blob": TEXT}},
        "Function": {"attributes": {"name": TEXT, "span": TEXT}},
        "Type": {"attributes": {"name": TEXT, "kind": TEXT, "span": TEXT}},
    },
    "edge_types": {"in_repo": {"domain": "SourceFile", "range": "Repository"}, "declares": {"domain": "SourceFile", "range": ["Function", "Type"]}, "calls": {"domain": "Function", "range": "Function"}},
}
TERMS = {"taxonomy": "t", "terms": [{"name": "workspace"}, {"name": "workspace/scratch", "parents": ["workspace"]}, {"name": "work"}]}
POLICY = {
    "policy": "local",
    "default_posture": "restricted",
    "roles": {"owner": []},
    "rules": [
        {"name": "scratch", "select": {"region": "workspace"}, "require": {}},
        {"name": "work", "select": {"region": "work"}, "require": {"reviewers": [{"role": "owner", "quorum": 1}]}},
        {"name": "users", "select": {"author_kind": "user"}, "require": {}},
        {"name": "agents", "select": {"author_kind": "agent"}, "require": {}},
    ],
}


@pytest.fixture(scope="module")
def plain(spark):
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    yield spark
    spark.conf.unset("spark.sql.codegen.wholeStage")
    spark.conf.unset("spark.sql.codegen.factoryMode")


def begin(spark, *more):
    keys = MemoryKeys()
    return flows.init(spark, MemStore(), keys, "anna", [CORE, *more, TERMS], POLICY), keys


def test_keys(tmp_path):
    for keys in (MemoryKeys(), FileKeys(str(tmp_path / "k"))):
        keys.store("a", bytes(32))
        assert keys.seed("a") == bytes(32) and keys.seed("b") is None
        with pytest.raises(FileExistsError):
            keys.store("a", bytes(range(32)))
        for name, seed in (("../x", bytes(32)), ("c", b"short")):
            with pytest.raises(ValueError):
                keys.store(name, seed)
    assert os.stat(tmp_path / "k" / "a.key").st_mode & 0o777 == 0o600
    assert FileKeys(str(tmp_path / "other"), str(tmp_path / "k")).seed("a") == bytes(32)


def test_stores_agree(spark, tmp_path):
    for store in (MemStore(), FsStore(str(tmp_path / "fs")), HadoopStore(spark, f"file://{tmp_path}/h")):
        assert store.read("a/b.yaml") is None and store.list("a") == []
        store.write("a/b.yaml", "é1")
        store.write("a/b.yaml", "é2")
        assert store.read("a/b.yaml") == "é2" and store.list("a") == ["b.yaml"]
        store.write("b/sha256:0%.yaml", "x")
        assert store.read("b/sha256:0%.yaml") == "x" and store.list("b") == ["sha256:0%.yaml"]
        assert store.create("a/c", "1") and not store.create("a/c", "2") and store.read("a/c") == "1"
        store.remove("a/b.yaml")
        assert store.list("a") == ["c"]
    for store in (FsStore(str(tmp_path / "fs")), HadoopStore(spark, f"file://{tmp_path}/h")):
        with pytest.raises(ValueError):
            store.read("../x")


def test_notes_preferences_packages(plain, tmp_path):
    g, keys = begin(plain, MEMORY)
    bot, out = flows.principal_add(g, keys, "bot", "agent", "anna")
    assert out.status == "admitted" and g.object("node", bot)["type"] == "core/Agent@1"
    with pytest.raises(E.GraphError, match="unknown principal kind"):
        flows.principal_add(g, keys, "x", "robot", "anna")
    note, out = flows.note(g, keys, "bot", "tea is green")
    assert out.status == "admitted"
    pref, held = flows.propose_preference(g, keys, "bot", "likes tea", "strong", note)
    assert held.status == "held" and held.reviewers == [("owner", 1)]
    assert g.decide(held.hash, "anna", keys.seed("anna")).status == "admitted"
    assert flows.classify(g, keys, note, "workspace@1", "anna").status == "admitted"
    profile = tmp_path / "p"
    profile.mkdir()
    (profile / "a.yaml").write_text(log.dump_yaml(CODE))
    (profile / "policy.yaml").write_text(log.dump_yaml(POLICY | {"version": 2}))
    docs, policy = flows.read_profile(str(profile))
    assert flows.install_package(g, keys, "anna", docs, policy | {"roles": {"owner": ["principal:anna"]}}).status == "admitted"
    assert g.policy()["version"] == 2 and "code" in g.registry().packages
    store = MemStore()
    assert flows.export_markdown(g, store, {"memory/Note": "content"}) == g.state().where("kind = 'node' and not deleted and type not like 'meta/%'").count()
    page = next(p for p in store.docs if p.endswith(f"{note}.md"))
    assert log.parse_yaml(store.read("manifest.yaml"))[0]["revision"] == g.head()
    pages = plain.createDataFrame([(p, t.replace("tea is green", "tea is black")) for p, t in store.docs.items() if p.endswith(".md")], "path string, text string")
    assert flows.import_markdown(g, keys, pages.where(F.col("path") == page), {"memory/Note": "content"}, "anna").status == "admitted"
    assert "tea is black" in g.object("node", note)["attributes"]
    with pytest.raises(E.GraphError, match="no page changed"):
        flows.import_markdown(g, keys, pages.where("false"), {}, "anna")
    native = NativeSubstrate(g)
    assert native.heads() == {"HEAD": g.head()} and native.revision(g.head())["author"] == "principal:anna"
    assert native.operation_set(g.head()).collect() == [("update", "node", note)]


def test_two_writers_and_checkpoints(plain):
    g, keys = begin(plain, MEMORY)
    seed = keys.seed("anna")
    one, two = (g.build("anna", seed, str(i), [E.create_node(f"n{i}", "memory/Note@1", {"content": "x"})]) for i in range(2))
    assert g.submit(one).status == "admitted"
    with pytest.raises(E.Conflict):
        g.append(two, {"decisions": [], "envelopes": []})
    assert g.head() == one["hash"] and len(g.chain()) == 2
    g.store.write("HEAD", one["parents"][0])  # a writer that stopped before it moved HEAD
    assert g.head() == one["hash"]
    cp = g.checkpoint("anna", seed)
    assert cp["state_hash"] == canon.merkle_root([canon.state_leaf(r.kind, r.id, r.rev, r.deleted) for r in g.entries().orderBy("idx").collect()], "state-node")
    assert [r.status for r in g.verify_checkpoints().collect()] == ["verified"]
    g.store.write(f"checkpoints/{cp['revision']}.yaml", log.dump_yaml(cp | {"state_hash": "sha256:" + "0" * 64}))
    assert [r.status for r in g.verify_checkpoints().collect()] == ["state hash does not recompute"]


def test_federation(plain):
    home, keys = begin(plain, MEMORY)
    away, their = begin(plain, MEMORY)
    seed, graph_id = their.seed("anna"), away.meta()["graph_id"]
    note, _ = flows.note(away, their, "anna", "shared")
    root = sign.public_key(seed).hex()
    assert flows.peer_add(home, keys, "away", graph_id, root, "anna").status == "admitted"
    grant_id, out = flows.grant(away, their, home.meta()["graph_id"], "workspace", "anna")
    assert out.status == "admitted"
    state = away.state()
    payloads = plain.createDataFrame([("node", note, __import__("json").dumps({k: v for k, v in next(o["create"] for c in away.chain() for o in c["operations"] if o.get("create", {}).get("id") == note).items()}))], "kind string, id string, payload string")
    terms = plain.createDataFrame([("workspace/scratch", "workspace/scratch"), ("workspace/scratch", "workspace")], "node string, ancestor string")
    head, objects = exchange.bundle(state, payloads, terms, "workspace", graph_id, home.meta()["graph_id"], away.head(), "anna", seed, "2026-01-01T00:00:00Z")
    assert flows.import_object(home, keys, head, objects, note, "anna").status == "admitted"
    assert home.object("node", note)["type"] == "memory/Note@1"
    with pytest.raises(E.GraphError, match="does not hold"):
        flows.import_object(home, keys, head, objects, "nothing", "anna")
    with pytest.raises(ValueError, match="unknown peer"):
        flows.import_object(away, their, head, objects, note, "anna")
    assert flows.revoke(away, their, grant_id, "anna").status == "admitted"
    with pytest.raises(E.GraphError, match="no live grant"):
        flows.revoke(away, their, grant_id, "anna")


def test_commits(plain, tmp_path):
    repo = str(tmp_path / "repo")
    os.makedirs(repo)

    def commit(files, *gone):
        for name, text in files.items():
            (tmp_path / "repo" / name).write_text(text)
        for name in gone:
            (tmp_path / "repo" / name).unlink()
        for args in (["add", "-A"], ["-c", "user.name=x", "-c", "user.email=x@y", "commit", "-qm", "c"]):
            subprocess.run(["git", "-C", repo, *args], check=True)

    subprocess.run(["git", "init", "-q", repo], check=True)
    g, keys = begin(plain, CODE)
    commit({"a.rs": "fn one() {\n    two();\n}\n\npub struct S {\n    x: u8,\n}\n", "b.rs": "fn two() {\n}\n", "c.txt": "text"})
    assert flows.import_commit(g, keys, repo, "HEAD", "anna").status == "admitted"
    with pytest.raises(E.GraphError, match="is indexed as it is"):
        flows.import_commit(g, keys, repo, "HEAD", "anna")

    def calls():
        return sorted((r.caller, r.callee) for r in git.index_state(g.state())["calls"].collect())

    assert calls() == [("one", "two")]
    commit({"a.rs": "fn one() {\n    three();\n}\n", "d.rs": "fn three() {\n    one();\n}\n"}, "b.rs")
    assert flows.import_commit(g, keys, repo, "HEAD", "anna").status == "admitted"
    assert calls() == [("one", "three"), ("three", "one")]
    have = git.index_state(g.state())
    assert sorted(r.path for r in have["files"].collect()) == ["a.rs", "c.txt", "d.rs"]
    assert sorted((r.kind, r.name) for r in have["items"].collect()) == [("fn", "one"), ("fn", "three")]
    assert all(r.integrity == "verified" for r in g.verify().collect())
    sub = GitSubstrate(plain, repo)
    now = sub.heads().popitem()[1]
    assert sorted(map(tuple, sub.operation_set(now).collect())) == [("create", "file", "d.rs"), ("delete", "file", "b.rs"), ("update", "file", "a.rs")]
    assert sub.verify_authorship(now) == "no signature" and len(sub.state_hash(now)) == 40


def test_a_log_that_tasks_read(plain, tmp_path):
    keys = MemoryKeys()
    g = flows.init(plain, HadoopStore(plain, f"file://{tmp_path}/g"), keys, "anna", [CORE, MEMORY, TERMS], POLICY)
    note, out = flows.note(g, keys, "anna", "x")
    assert out.status == "admitted" and g.length() == 2
    memory = E.Graph(plain, MemStore())
    for cs in g.chain():
        memory.append(cs, {})
    names = g.ops().columns
    assert sorted(map(str, g.ops().collect())) == sorted(map(str, memory.ops().select(names).collect()))
    first = g.chain()[0]["hash"]
    assert g.ops(upto=first).agg(F.max("seq")).first()[0] == 1 and g.state_hash() == memory.state_hash()
    assert g.ops([{"operations": [E.create_node("n", "memory/Note@1", {})]}]).where("id = 'n'").first().seq == 3
    with pytest.raises(E.GraphError, match="unknown revision"):
        g.ops(upto="sha256:0")
