"""Everyday transactions: packages, principals, notes, classifications, peers and grants, imports of commits, pages and bundles.

Each builds the operations of one changeset and submits it, so policy decides.
"""

from __future__ import annotations

import json
import secrets
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.shared import saved
from ..functions.text import bare
from ..operators import federation, fold
from ..sources import exchange, git, log
from ..sources.docstore import DocStore
from ..sources.keys import KeyBackend
from . import engine as E

PRINCIPALS = {"user": "core/User@1", "agent": "core/Agent@1", "service": "core/Service@1"}


def _seed(keys: KeyBackend, name: str) -> bytes:
    if (seed := keys.seed(name)) is None:
        raise E.GraphError(f"no key of {name}")
    return seed


def _mint() -> str:
    return str(uuid.uuid4())


def read_profile(folder: str) -> tuple[list[dict], dict | None]:
    """Schema documents and policy of a folder's YAML files, in the order of their names."""
    docs = [d for p in sorted(Path(folder).glob("*.y*ml")) for d in log.parse_yaml(p.read_text("utf-8")) if isinstance(d, dict)]
    policies = [d for d in docs if "policy" in d]
    if len(policies) > 1:
        raise E.GraphError("a profile has one policy")
    return [d for d in docs if "policy" not in d], policies[0] if policies else None


def init(spark, store, keys: KeyBackend, owner: str, docs: list[dict], policy: dict) -> E.Graph:
    """A graph whose first changeset has the profile's schema, its policy with every role bound to the owner, and the owner."""
    seed = keys.seed(owner) or secrets.token_bytes(32)
    graph = E.Graph.create(spark, store, [f"principal:{owner}"])
    policy = policy | {"roles": dict.fromkeys(policy.get("roles") or {}, [f"principal:{owner}"])}
    node = E.create_node(_mint(), PRINCIPALS["user"], {"display_name": owner, "keys": [E.key_record(seed)], "status": "active"})
    if keys.seed(owner) is None:
        keys.store(owner, seed)
    graph.genesis(owner, seed, [*E.schema_ops(docs, policy), node])
    return graph


def package_ops(graph: E.Graph, docs: list[dict], policy: dict | None = None) -> list[dict]:
    """Creates of schema nodes; where the graph has a policy already, the new one is an update of it."""
    ops = E.schema_ops(docs, policy)
    if policy:
        old = fold.live(graph.state()).where("kind = 'node' and type like 'meta/Policy%'").select("id", "rev", "type").collect()  # one at most
        for r in [r for r in old if bare(r.type) == "meta/Policy"][:1]:
            ops = [{"update": o["create"] | {"id": r.id, "prior": r.rev}} if bare(o["create"]["type"]) == "meta/Policy" else o for o in ops]
    return ops


def install_package(graph: E.Graph, keys: KeyBackend, by: str, docs: list[dict], policy: dict | None = None) -> E.Outcome:
    return graph.commit(by, _seed(keys, by), f"schema of {len(docs)} documents", package_ops(graph, docs, policy))


def principal_add(graph: E.Graph, keys: KeyBackend, name: str, kind: str, by: str) -> tuple[str, E.Outcome]:
    """Registers a principal with a new key; an agent is delegated by whoever adds it."""
    if kind not in PRINCIPALS:
        raise E.GraphError(f"unknown principal kind {kind!r}")
    attributes: dict = {}
    if kind == "agent":
        owner = graph.principal(graph.state(), f"principal:{by}")
        if not owner:
            raise E.GraphError(f"unknown principal principal:{by}")
        attributes = {"delegated_by": f"node:{owner['id']}", "scope": {"region": "workspace"}}
    seed, id_ = secrets.token_bytes(32), _mint()
    keys.store(name, seed)
    attributes = {"display_name": name, "keys": [E.key_record(seed)], "status": "active"} | attributes
    return id_, graph.commit(by, _seed(keys, by), f"{by} adds the {kind} {name}", [E.create_node(id_, PRINCIPALS[kind], attributes)])


def _derived(agent: str, tool: str) -> dict:
    return {"derived_by": f"principal:{agent}", "method": "model-assisted", "tool": tool}


def note(graph: E.Graph, keys: KeyBackend, agent: str, content: str, tool: str = "notes") -> tuple[str, E.Outcome]:
    """A note in the agent's scratch region."""
    id_ = _mint()
    ops = [E.create_node(id_, "memory/Note@1", {"content": content}, _derived(agent, tool)), E.classify(f"node:{id_}", "workspace/scratch@1", f"principal:{agent}", "model-assisted")]
    return id_, graph.commit(agent, _seed(keys, agent), "a note", ops)


def propose_preference(graph: E.Graph, keys: KeyBackend, agent: str, statement: str, strength: str, from_note: str | None = None, tool: str = "notes") -> tuple[str, E.Outcome]:
    """A preference, with an envelope of the agent's own; policy usually holds it."""
    id_, seed = _mint(), _seed(keys, agent)
    ops = [E.create_node(id_, "memory/Preference@1", {"statement": statement, "strength": strength}, _derived(agent, tool)), E.classify(f"node:{id_}", "work@1", f"principal:{agent}", "model-assisted")]
    if from_note:
        ops.append(E.create_edge(_mint(), "memory/relates_to@1", f"node:{id_}", f"node:{from_note}"))
    return id_, graph.commit(agent, seed, f"preference: {statement}", ops, lambda h: [graph.envelope(agent, seed, h)])


def classify(graph: E.Graph, keys: KeyBackend, node: str, term: str, by: str, basis: str = "manual") -> E.Outcome:
    return graph.commit(by, _seed(keys, by), f"{term} for node:{node}", [E.classify(f"node:{node}", term, f"principal:{by}", basis)])


# federation


def peer_add(graph: E.Graph, keys: KeyBackend, name: str, graph_id: str, root_key: str, by: str) -> E.Outcome:
    attributes = {"graph_id": graph_id, "root_keys": [root_key], "trust_basis": "out-of-band"}
    return graph.commit(by, _seed(keys, by), f"the graph {graph_id[:12]} becomes known as {name}", [E.create_node(_mint(), "core/Peer@1", attributes)])


def grant(graph: E.Graph, keys: KeyBackend, audience: str, region: str, by: str) -> tuple[str, E.Outcome]:
    id_ = _mint()
    attributes = {"audience": audience, "scope": {"region": region}, "rights": ["state", "subscribe"]}
    return id_, graph.commit(by, _seed(keys, by), f"{audience[:12]} may read {region}", [E.create_node(id_, "core/Grant@1", attributes)])


def revoke(graph: E.Graph, keys: KeyBackend, grant_id: str, by: str) -> E.Outcome:
    found = graph.object("node", grant_id)
    if not found:
        raise E.GraphError(f"no live grant {grant_id}")
    return graph.commit(by, _seed(keys, by), f"{grant_id[:12]} is taken back", [E.delete("node", grant_id, found["rev"])])


def import_object(graph: E.Graph, keys: KeyBackend, head: dict, objects: DataFrame, id_: str, by: str) -> E.Outcome:
    """One object of a bundle from a known peer, under its origin; ValueError for a bundle or object that doesn't verify."""
    known = {r.graph_id: r.public for r in federation.peers(graph.state()).where(F.col("graph_id") == head["graph_id"]).collect()}
    checked = exchange.verify_bundle(head, objects.where(F.col("id") == id_), known, graph.meta()["graph_id"], graph.namespace)
    row = checked.where("kind = 'node'").first()
    if row is None:
        raise E.GraphError(f"the bundle does not hold {id_}")
    if not (row.rev_ok and row.proof_ok):
        raise ValueError("the object doesn't verify")
    origin = {"derived_from": [f"{graph.namespace}:{head['graph_id']}/{id_}@{row.rev}"], "derived_by": f"principal:{by}", "method": "deterministic", "tool": "import"}
    return graph.commit(by, _seed(keys, by), f"{id_[:12]} out of graph {head['graph_id'][:12]}", [{"create": json.loads(row.payload) | {"provenance": origin}}])


# commits and pages


def commit_ops(state: DataFrame, files: DataFrame, name: str, origin: str, by: str, commit: str) -> list[dict]:
    """Operations that bring the code graph of a state to the files(path, blob, text) of a commit; none where nothing changed.

    Both sides are compared as tables; what reaches the driver is the
    difference, which is the changeset itself.
    """
    want, have = {k: saved(v, k) for k, v in git.code_graph(files).items()}, {k: saved(v, k) for k, v in git.index_state(state).items()}
    prov = {"derived_from": [f"git:#{commit}"], "derived_by": f"principal:{by}", "method": "deterministic", "tool": "code-scan"}
    delta = git.graph_changes(want, {k: have[k].select(want[k].columns) for k in ("files", "items", "calls")})
    ops: list[dict] = []
    last: list[tuple] = []  # deletes: calls, then what declares an item, the item, what holds a file, the file
    repo = have["repository"].first()
    repo_id = repo.id if repo else _mint()
    if not repo:
        ops.append(E.create_node(repo_id, "code/Repository@1", {"name": name, "origin": origin}, prov))

    def changed(what: str, key: list[str]):
        both = delta[what].join(want[what], key, "left").join(have[what].select(*key, "id", "rev"), key, "left")
        return both.orderBy(*key).toLocalIterator()

    at: dict = {}
    for r in changed("files", ["path"]):
        attributes = {"path": r.path, **({"language": r.language} if r.language else {}), "blob": f"git:{name}#{r.content}:{r.path}"}
        if r.verb == "create":
            at[r.path] = _mint()
            ops += [E.create_node(at[r.path], "code/SourceFile@1", attributes, prov), E.create_edge(_mint(), "code/in_repo@1", f"node:{at[r.path]}", f"node:{repo_id}")]
        elif r.verb == "update":
            ops.append(E.update_node(r.id, "code/SourceFile@1", r.rev, attributes, prov))
        else:
            last.append((2, "node", r.id, r.rev))
    gone = delta["files"].where("verb = 'delete'").select("path")
    last += [(1, "edge", r.id, r.rev) for r in have["in_repo"].join(gone, "path", "left_semi").toLocalIterator()]
    keyed = ["path", "kind", "name"]
    file_of = have["files"].select("path", F.col("id").alias("file"))
    made: dict = {}
    rows = delta["items"].join(want["items"], keyed, "left").join(have["items"].select(*keyed, "id", "rev"), keyed, "left").join(file_of, "path", "left")
    for r in rows.orderBy(*keyed).toLocalIterator():
        fn = r.kind == "fn"
        type_ = "code/Function@1" if fn else "code/Type@1"
        attributes = {"name": r.name, **({} if fn else {"kind": r.kind}), "span": "L" + (r.content or "").replace("-", "-L")}
        if r.verb == "create":
            id_ = _mint()
            if fn:
                made[r.path, r.name] = id_
            ops += [E.create_node(id_, type_, attributes, prov), E.create_edge(_mint(), "code/declares@1", f"node:{at.get(r.path) or r.file}", f"node:{id_}")]
        elif r.verb == "update":
            ops.append(E.update_node(r.id, type_, r.rev, attributes, prov))
        else:
            last.append((0, "node", r.id, r.rev))
    lost = delta["items"].where("verb = 'delete'").select(*keyed)
    last += [(-1, "edge", r.id, r.rev) for r in have["declares"].join(lost, keyed, "left_semi").toLocalIterator()]
    ends = have["items"].where("kind = 'fn'")
    calls = delta["calls"].join(have["calls"], want["calls"].columns, "left")
    calls = calls.join(ends.select("path", F.col("name").alias("caller"), F.col("id").alias("from_id")), ["path", "caller"], "left")
    calls = calls.join(ends.select(F.col("path").alias("target_path"), F.col("name").alias("callee"), F.col("id").alias("to_id")), ["target_path", "callee"], "left")
    for r in calls.orderBy("path", "caller", "target_path", "callee").toLocalIterator():
        if r.verb == "create":
            ends_ = (made.get((r.path, r.caller)) or r.from_id, made.get((r.target_path, r.callee)) or r.to_id)
            ops.append(E.create_edge(_mint(), "code/calls@1", *(f"node:{x}" for x in ends_)))
        else:
            last.append((-2, "edge", r.id, r.rev))
    return ops + [E.delete(kind, id_, rev) for _, kind, id_, rev in sorted(last)]


def import_commit(graph: E.Graph, keys: KeyBackend, repo: str, ref: str, by: str) -> E.Outcome:
    """One changeset with what a commit changes in the code graph; GraphError where nothing changed."""
    commit = git.resolve(repo, ref)
    files = git.with_text(git.tree(graph.spark, repo, commit), repo)
    ops = commit_ops(saved(graph.state(), "state"), files, Path(repo).name, repo, by, commit)
    if not ops:
        raise E.GraphError(f"{repo} at {commit[:12]} is indexed as it is")
    return graph.commit(by, _seed(keys, by), f"index of {commit[:12]}: {len(ops)} changes", ops)


def export_markdown(graph: E.Graph, out: DocStore, long_text: dict[str, str]) -> int:
    """Writes a document for every page, the schema's documents and a manifest to a store; the number of pages.

    Pages are made on the executors and reach the store one at a time.
    """
    state, n = saved(graph.state(), "state"), 0
    for r in exchange.markdown(state, long_text).toLocalIterator():
        out.write(r.path, r.text)
        n += 1
    for name, doc in E.schema_docs(graph._schema_nodes(state)):
        out.write(f"_schema/{name}.yaml", log.dump_yaml(doc))
    out.write("manifest.yaml", log.dump_yaml({"graph_id": graph.meta()["graph_id"], "revision": graph.head(), "state_hash": graph.state_hash(state), "pages": n, "losses": exchange.LOSSES}))
    return n


def import_markdown(graph: E.Graph, keys: KeyBackend, pages: DataFrame, long_text: dict[str, str], by: str) -> E.Outcome:
    """One changeset that updates every edited page(path, text); GraphError for unreadable pages or none that changed."""
    found = saved(exchange.read_markdown(pages, long_text, graph.namespace), "pages")
    if bad := found.where("error is not null").first():
        raise E.GraphError(f"{bad.path}: {bad.error}")
    ops = []
    for r in exchange.edited(found).orderBy("id").toLocalIterator():  # the changeset itself
        payload = json.loads(r.payload)
        ops.append(E.update_node(r.id, r.type, r.front_rev, payload["attributes"], payload.get("provenance")))
    if not ops:
        raise E.GraphError("no page changed")
    return graph.commit(by, _seed(keys, by), f"Edit {len(ops)} page(s)", ops)
