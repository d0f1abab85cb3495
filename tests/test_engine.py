import pytest

from ledgerloom.functions import canon, sign
from ledgerloom.plans import engine as E
from ledgerloom.sources.docstore import FsStore, MemStore

ANNA, BOT = bytes(range(32)), bytes(range(1, 33))
CORE = {
    "ontology": "core",
    "version": 1,
    "structs": {"KeyRecord": {"key_id": {"type": "string", "required": True}, "public": {"type": "string", "required": True}}},
    "entity_types": {"Principal": {"attributes": {"display_name": {"type": "string", "required": True}, "keys": {"type": "list<KeyRecord>"}}}, "User": {"extends": "Principal"}, "Agent": {"extends": "Principal"}},
}
MEMORY = {
    "ontology": "memory",
    "version": 1,
    "imports": [{"ontology": "core"}],
    "entity_types": {"Note": {"attributes": {"content": {"type": "string", "required": True}, "mood": {"type": "enum<good|bad>"}}}, "Preference": {"extends": "Note"}},
    "edge_types": {"about": {"domain": ["Note"], "range": ["core/Principal"]}},
    "validation_rules": [{"name": "grounded", "on": {"type": "Preference"}, "require": {"edge": {"type": "about", "direction": "out", "within": "changeset"}}}],
}
TERMS = {"taxonomy": "places", "terms": [{"name": "scratch"}, {"name": "desk", "parents": ["scratch"]}, {"name": "safe"}]}
POLICY = {
    "policy": "local",
    "version": 1,
    "default_posture": "restricted",
    "roles": {"owner": ["principal:anna"]},
    "rules": [
        {"name": "scratch-free", "select": {"region": "scratch", "author_kind": "agent"}, "require": {}},
        {"name": "preferences", "select": {"type": "memory/Preference"}, "require": {"reviewers": [{"role": "owner", "quorum": 1}]}},
        {"name": "others", "select": {"all": [{"author_kind": "agent"}, {"not": {"type": "memory/Note"}}, {"not": {"type": "core/Principal"}}]}, "require": {}},
        {"name": "users", "select": {"author_kind": "user"}, "require": {}},
        {"name": "attested", "select": {"where": {"attr": "mood", "equals": "bad"}}, "require": {"attestation_required": {"attester_class": "build"}}},
    ],
}


@pytest.fixture(scope="module")
def begun(spark):
    """Documents of a graph after its first changeset; plans over a few rows aren't worth compiling."""
    spark.conf.set("spark.sql.codegen.wholeStage", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    g = E.Graph.create(spark, MemStore(), ["principal:anna"])
    n = iter(range(1000))
    ops = E.schema_ops([CORE, MEMORY, TERMS], POLICY, lambda: f"meta-{next(n):03}")
    ops += [E.create_node("anna", "core/User@1", {"display_name": "anna", "keys": [E.key_record(ANNA)]}), E.create_node("bot", "core/Agent@1", {"display_name": "bot", "keys": [E.key_record(BOT)]})]
    assert g.genesis("anna", ANNA, ops).status == "admitted"
    yield g.store.dump()
    spark.conf.unset("spark.sql.codegen.wholeStage")
    spark.conf.unset("spark.sql.codegen.factoryMode")


@pytest.fixture
def graph(spark, begun, tmp_path, request):
    store = FsStore(str(tmp_path)) if request.node.name == "test_admit_hold_decide_verify" else MemStore()
    for path, text in begun.items():
        store.write(path, text)
    return E.Graph.open(spark, store)


def note(id_, **more):
    return E.create_node(id_, "memory/Note@1", {"content": f"note {id_}", **more})


def test_admit_hold_decide_verify(graph):
    first = graph.commit("bot", BOT, "scratch", [note("n1"), E.classify("node:n1", "desk@1", "principal:bot", "deterministic", "c1")])
    assert first.status == "admitted" and first.matched_rules == ["others", "scratch-free"]
    ops = [E.create_node("p1", "memory/Preference", {"content": "tea"}), E.create_edge("e1", "memory/about@1", "node:p1", "node:anna")]
    held = graph.commit("bot", BOT, "preference", ops)
    assert held.status == "held" and held.reviewers == [("owner", 1)] and graph.proposals() == [held.hash]
    assert held.unmet == ["reviewers: role owner needs quorum 1, have 0"]
    assert graph.decide(held.hash, "bot", BOT).status == "unmet"
    assert graph.decide(held.hash, "anna", ANNA).status == "admitted"
    assert not graph.proposals()
    report = graph.verify().collect()
    assert len(report) == 3
    assert all((r.integrity, r.authorship, r.governance) == ("verified",) * 3 for r in report)
    assert graph.state(upto=first.hash).where("kind = 'node'").count() == graph.state().where("kind = 'node'").count() - 1
    assert graph.read_ops().count() == graph.ops().count()
    assert [(r.n_ops, r.intent) for r in graph.log().where("seq > 1").collect()] == [(2, "scratch"), (2, "preference")]
    assert graph.object("node", "p1")["type"] == "memory/Preference" and graph.object("node", "zz") is None
    assert graph.view().where("label = 'tea'").first().id == "p1"
    cp = graph.checkpoint("anna", ANNA)
    assert cp["state_hash"] == graph.state_hash()
    assert sign.verify(sign.public_key(ANNA).hex(), canon.unsigned(cp, "checkpoint"), cp["signature"])
    evidence = graph.evidence(held.hash)
    graph.store.write(f"changesets/{held.hash}.evidence.yaml", "decisions: []\nenvelopes: []\n")
    assert "quorum 1, have 0" in graph.verify().where("seq = 3").first().governance
    assert evidence["decisions"]


def test_rejections(graph):
    cases = [
        ("missing required", [E.create_node("a", "memory/Note@1", {})]),
        ("not declared", [note("b", colour="red")]),
        ("not in enum", [note("c", mood="ugly")]),
        ("does not resolve", [E.create_node("d", "memory/Nothing", {})]),
        ("resolves to no taxonomy term", [note("e"), E.classify("node:e", "nowhere", "principal:anna", "manual")]),
        ("create of existing", [note("f"), note("f")]),
        ("prior-revision mismatch", [E.update_node("anna", "core/User@1", "sha256:0", {"display_name": "anna"})]),
        ("unknown object", [E.delete("node", "nobody", "sha256:0")]),
        ("from_ref does not resolve", [E.create_edge("e1", "memory/about", "node:g", "node:anna"), note("g")]),
        ("subject does not resolve", [E.classify("node:h", "safe", "principal:anna", "manual"), note("h")]),
        ("edge end", [note("i"), E.create_edge("e2", "memory/about", "node:anna", "node:anna")]),
        ("grounded", [E.create_node("j", "memory/Preference", {"content": "tea"})]),
        ("unsupported", [{"resolve": {"kind": "node", "id": "anna"}}]),
        ("", [note("k"), E.create_edge("e3", "memory/about", "node:k", "node:bot"), note("m"), E.create_edge("e4", "memory/about", "node:m", "node:bot")]),
        ("dangling from_ref", [E.delete("node", "k", canon.revision_hash(note("k")["create"]))]),
        ("create of existing", [note("k")]),
        ("dangling from_ref", [{"redact-document": {"kind": "edge", "id": "e4"}}]),
        ("unknown object kind", [{"create": {"kind": "thing", "id": "l"}}]),
    ]
    before, found = graph.head(), {}
    sets = [{"hash": str(i), "operations": ops} for i, (_, ops) in enumerate(cases)]
    for r in graph.violations(sets).collect():
        found.setdefault(r.seq, []).append(f"{r.code} {r.detail}")
    for i, (text, _) in enumerate(cases):
        got = found.pop(i + 2, [])
        assert any(text in g for g in got) if text else not got, (text, got)
    assert not found
    with pytest.raises(E.Rejected, match="missing required"):
        graph.commit("anna", ANNA, "bad", cases[0][1])
    held = graph.commit("anna", ANNA, "bad", cases[11][1])
    with pytest.raises(E.Rejected, match="grounded"):
        graph.decide(held.hash, "anna", ANNA)
    assert graph.head() == before


def test_attestations_roots_and_tampering(graph):
    out = graph.commit("anna", ANNA, "bad mood", [note("m", mood="bad")])
    assert out.unmet == ["attestation_required: no verifiable envelope from class build"]
    out = graph.commit("anna", ANNA, "bad mood", [note("m", mood="bad")], lambda h: [graph.envelope("anna", ANNA, h)])
    assert out.status == "admitted" and "evidence is none" in out.degraded[0]
    graph.trust("m1")
    graph.trust("m1")
    assert graph.meta()["trusted_measurements"] == ["m1"]
    ok = graph.commit("anna", ANNA, "bad mood", [note("m2", mood="bad")], lambda h: [graph.envelope("anna", ANNA, h, "simulated", "m1")])
    assert ok.status == "admitted"
    no = graph.commit("anna", ANNA, "bad mood", [note("m3", mood="bad")], lambda h: [graph.envelope("anna", ANNA, h, "simulated", "m9")])
    assert no.status == "held"
    held = graph.commit("bot", BOT, "free", [note("f")])
    assert held.root_required and held.unmet == ["default posture is restricted: author principal:bot must hold root authority"]
    assert graph.decide(held.hash, "anna", ANNA, "reject").status == "rejected" and held.hash not in graph.proposals()
    with pytest.raises(E.GraphError):
        graph.commit("eve", bytes(32), "who", [note("w")])
    text = graph.store.read(f"changesets/{ok.hash}.yaml")
    graph.store.write(f"changesets/{ok.hash}.yaml", text.replace("note m2", "note mm"))
    row = graph.verify().where("seq = 3").first()
    assert "does not recompute" in row.integrity


def test_schema_round_trip(graph):
    nodes = graph._schema_nodes(graph.state())
    docs = dict(E.schema_docs(nodes))
    assert list(docs) == ["core", "memory", "places-taxonomy", "policy"]
    assert docs["policy"] == POLICY and docs["core"] == CORE and docs["memory"]["entity_types"] == MEMORY["entity_types"]
    n = iter(range(1000))
    again = E.schema_ops([d for k, d in docs.items() if k != "policy"], docs["policy"], lambda: f"meta-{next(n):03}")
    assert dict(E.schema_docs([op["create"] for op in again])) == docs
    late = {"ontology": "extra", "version": 1, "entity_types": {"Thing": {"attributes": {}}}}
    smuggle = [*E.schema_ops([late]), E.create_node("t", "extra/Thing", {})]
    with pytest.raises(E.Rejected, match="does not resolve"):
        graph.commit("anna", ANNA, "same changeset", smuggle)
    assert graph.commit("anna", ANNA, "schema", E.schema_ops([late])).status == "admitted"
    assert graph.commit("anna", ANNA, "use", [E.create_node("t", "extra/Thing", {})]).status == "admitted"
    assert all(r.integrity == "verified" for r in graph.verify().collect())


def test_decisions_stay(graph):
    one, two, three = (graph.commit("bot", BOT, f"n{i}", [note(f"n{i}")]) for i in range(3))
    assert {graph.proposal(x.hash)[2] for x in (one, two, three)} == {"pending"}
    assert graph.decide(one.hash, "anna", ANNA, "reject").status == "rejected"
    cs, evidence, status = graph.proposal(one.hash)
    assert status == "rejected" and cs["hash"] == one.hash and graph.closed() == [one.hash] and one.hash not in graph.proposals()
    assert [d["verdict"] for d in evidence["decisions"]] == ["reject"] and evidence["decisions"][0]["deciders"][0]["principal"] == "principal:anna"
    with pytest.raises(E.AlreadyDecided):
        graph.decide(one.hash, "anna", ANNA)
    with pytest.raises(E.AlreadyDecided):
        graph.decision(one.hash, "approve")
    with pytest.raises(E.GraphError, match="no proposal"):
        graph.decide("sha256:0", "anna", ANNA)

    record, message = graph.decision(two.hash, "approve")  # signed elsewhere
    for bad in (record | {"kind": "note"}, record | {"subject": three.hash}, record | {"verdict": "maybe"}, record, record | {"deciders": [{"principal": "principal:anna", "signature": "none"}]}):
        with pytest.raises(E.GraphError):
            graph.decide_with(two.hash, bad)
    out = graph.decide_with(two.hash, record | {"deciders": [{"principal": "principal:anna", "signature": sign.sign(ANNA, message)}]})
    assert out.status == "unmet" and out.unmet and graph.evidence(two.hash, "proposals")["decisions"]


def test_two_held_proposals(graph):
    def preference(k):
        return [E.create_node(f"p{k}", "memory/Preference", {"content": "tea"}), E.create_edge(f"e{k}", "memory/about@1", f"node:p{k}", "node:anna")]

    one, two = (graph.commit("bot", BOT, f"p{k}", preference(k)) for k in range(2))
    assert graph.decide(one.hash, "anna", ANNA).status == "admitted"
    with pytest.raises(E.AlreadyDecided):
        graph.decide(one.hash, "anna", ANNA)
    files = graph.store.list("changesets")
    out = graph.decide(two.hash, "anna", ANNA)
    assert out.status == "stale" and graph.proposal(two.hash)[2] == "stale"
    assert graph.store.list("changesets") == files and not graph.store.list("staged")  # nothing that is on no chain
    assert [d["verdict"] for d in graph.evidence(two.hash, "proposals")["decisions"]] == ["approve"]
    with pytest.raises(E.GraphError, match="is by"):
        graph.rebase(two.hash, "anna", ANNA)
    again = graph.rebase(two.hash, "bot", BOT)
    assert again.status == "held" and graph.proposal(two.hash)[1]["replaced_by"] == again.hash and graph.proposal(two.hash)[2] == "replaced"
    with pytest.raises(E.GraphError, match="nothing to rebase"):
        graph.rebase(again.hash, "bot", BOT)
    assert graph.decide(again.hash, "anna", ANNA).status == "admitted" and graph.head() == again.hash and not graph.proposals()


def test_a_lost_claim_leaves_nothing_and_a_stopped_one_is_finished(graph):
    head, before = graph.head(), graph.store.dump()
    one, two = (graph.build("anna", ANNA, f"n{k}", [note(f"n{k}")]) for k in range(2))
    graph.append(one, {"decisions": [], "envelopes": []})
    with pytest.raises(E.Conflict):
        graph.append(two, {"decisions": [], "envelopes": []})
    assert not graph.store.list("staged") and graph.changeset(two["hash"]) is None
    graph.append(one, {"decisions": [], "envelopes": []})  # the same again is no conflict
    for path, text in before.items():
        graph.store.write(path, text)
    assert graph.store.read("HEAD").strip() == head and graph.head() == one["hash"]
    for tail in ("", ".evidence"):  # stopped after the claim
        graph.store.write(f"staged/{one['hash']}{tail}.yaml", graph.store.read(f"changesets/{one['hash']}{tail}.yaml"))
        graph.store.remove(f"changesets/{one['hash']}{tail}.yaml")
    assert graph.head() == one["hash"] and graph.changeset(one["hash"])["hash"] == one["hash"] and not graph.store.list("staged")


def test_jobs_of_an_audit_don_t_grow_with_the_log(graph, spark):
    from ledgerloom.plans import audit

    def jobs(group):
        tracker = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(group, group)
        assert all((r.integrity, r.authorship, r.governance) == ("verified",) * 3 for r in audit.report(graph).collect())
        n = len(tracker.getJobIdsForGroup(group))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return n

    def grow(lo, hi):
        for k in range(lo, hi):
            graph.append(graph.build("anna", ANNA, f"n{k}", [note(f"m{k}")]), {"decisions": [], "envelopes": []})

    grow(0, 1)
    few = jobs("short")
    grow(1, 6)
    assert jobs("long") <= few + 10  # a doubling of the chain takes a join more
