"""A governed graph: changesets are built, checked, admitted or held, decided on, and audited.

State, violations, contexts and checklists are DataFrames; the driver holds only
what one transaction needs: the changeset at hand, the schema and the policy.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from ..functions import canon, sign
from ..functions.shared import saved
from ..functions.text import bare, bare_col, is_meta_col
from ..operators import catalog, fold, merkle, policy, timeline, validate
from ..sources import log
from ..sources.docstore import DocStore, frame
from . import audit


class GraphError(Exception):
    pass


class Conflict(GraphError):
    """Another writer has appended to the same head."""


class AlreadyDecided(GraphError):
    """The proposal was rejected, replaced or admitted before."""


class Rejected(GraphError):
    """A changeset that the fold doesn't accept; carries the first violation."""


@dataclass
class Outcome:
    status: str  # admitted, held, rejected or unmet
    hash: str
    matched_rules: list[str] = field(default_factory=list)
    reviewers: list[tuple[str, int]] = field(default_factory=list)
    attestations: list[str] = field(default_factory=list)
    root_required: bool = False
    unmet: list[str] = field(default_factory=list)
    degraded: list[str] = field(default_factory=list)


def now_iso() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


# builders of operations


def create_node(id_: str, type_: str, attributes: dict, provenance: dict | None = None) -> dict:
    return {"create": {"kind": "node", "id": id_, "type": type_, "attributes": attributes} | ({"provenance": provenance} if provenance else {})}


def create_edge(id_: str, type_: str, source: str, target: str, attributes: dict | None = None) -> dict:
    return {"create": {"kind": "edge", "id": id_, "type": type_, "from": source, "to": target} | ({"attributes": attributes} if attributes else {})}


def classify(subject: str, term: str, by: str, basis: str, id_: str | None = None) -> dict:
    return {"create": {"kind": "classification", "id": id_ or str(uuid.uuid4()), "subject": subject, "term": term, "asserted_by": by, "basis": basis}}


def update_node(id_: str, type_: str, prior: str, attributes: dict, provenance: dict | None = None) -> dict:
    return {"update": {"kind": "node", "id": id_, "type": type_, "prior": prior, "attributes": attributes} | ({"provenance": provenance} if provenance else {})}


def delete(kind: str, id_: str, prior: str) -> dict:
    return {"delete": {"kind": kind, "id": id_, "prior": prior}}


def key_record(seed: bytes) -> dict:
    public = sign.public_key(seed)
    return {"key_id": sign.key_id(public), "algorithm": "ed25519", "public": public.hex(), "status": "active"}


def schema_ops(docs: list[dict], policy_doc: dict | None = None, mint=lambda: str(uuid.uuid4())) -> list[dict]:
    """Creates of schema nodes for ontology and taxonomy documents, and for a policy."""
    ops = []
    for doc in docs:
        name = doc.get("ontology")
        if name:
            imports = [i["ontology"] for i in doc.get("imports") or [] if "ontology" in i]
            common = {"package": name, **({"version": doc["version"]} if "version" in doc else {}), **({"imports": imports} if imports else {})}
            for key, kind in (("structs", "Struct"), ("entity_types", "EntityType"), ("edge_types", "EdgeType")):
                for n, body in (doc.get(key) or {}).items():
                    ops.append(create_node(mint(), f"meta/{kind}@1", {"name": n, **common, "definition": log.dump_yaml(body or {})}))
            for rule in doc.get("validation_rules") or []:
                ops.append(create_node(mint(), "meta/ValidationRule@1", {"name": rule["name"], **common, "definition": log.dump_yaml(rule)}))
        elif doc.get("taxonomy"):
            for term in doc.get("terms") or []:
                extra = {k: term[k] for k in ("parents", "status") if k in term} | ({"version": doc["version"]} if "version" in doc else {})
                ops.append(create_node(mint(), "meta/TaxonomyTerm@1", {"name": term["name"], "taxonomy": doc["taxonomy"], **extra}))
    if policy_doc:
        ops.append(create_node(mint(), "meta/Policy@1", {"name": policy_doc["policy"], "definition": log.dump_yaml(policy_doc)}))
    return ops


def schema_docs(nodes: list[dict]) -> list[tuple[str, dict]]:
    """The documents that schema nodes {type, attributes} project back to: ontologies, taxonomies, then the policy."""
    packages: dict[str, dict] = {}
    taxonomies: dict[str, dict] = {}
    policies = []
    keys = {"meta/Struct": "structs", "meta/EntityType": "entity_types", "meta/EdgeType": "edge_types"}
    for node in nodes:
        kind, a = bare(node["type"]), node["attributes"]
        if kind == "meta/Policy":
            policies.append(log.parse_yaml(a["definition"])[0])
        elif kind == "meta/TaxonomyTerm":
            doc = taxonomies.setdefault(a["taxonomy"], {"taxonomy": a["taxonomy"], "terms": []})
            doc |= {"version": a["version"]} if "version" in a else {}
            doc["terms"].append({"name": a["name"]} | {k: a[k] for k in ("parents", "status") if k in a})
        else:
            doc = packages.setdefault(a["package"], {"ontology": a["package"]})
            doc |= {"version": a["version"]} if "version" in a else {}
            if a.get("imports"):
                doc["imports"] = [{"ontology": i} for i in sorted({*(i["ontology"] for i in doc.get("imports", [])), *a["imports"]})]
            body = log.parse_yaml(a["definition"])[0]
            if kind == "meta/ValidationRule":
                doc.setdefault("validation_rules", []).append(body)
            else:
                doc.setdefault(keys[kind], {})[a["name"]] = body
    if len(policies) > 1:
        raise GraphError("a graph has one policy")
    for doc in packages.values():
        for k in (*keys.values(),):
            if k in doc:
                doc[k] = dict(sorted(doc[k].items()))
        if "validation_rules" in doc:
            doc["validation_rules"].sort(key=lambda r: r["name"])
    for doc in taxonomies.values():
        doc["terms"].sort(key=lambda t: t["name"])
    out = [(n, packages[n]) for n in sorted(packages)] + [(f"{n}-taxonomy", taxonomies[n]) for n in sorted(taxonomies)]
    return out + [("policy", p) for p in policies]


def payload_errors(reg: catalog.Registry, kind: str, payload: dict) -> list[str]:
    """What a payload breaks of the schema by itself, without looking at other objects."""
    if kind == "node":
        if not (t := payload.get("type")):
            return ["node needs a type"]
        if not reg.resolve(t):
            return [f"node type {t!r} does not resolve"]
        known, given = reg.attributes(t), payload.get("attributes") or {}
        out = [f"missing required attribute {a!r} of {bare(t)}" for a, d in sorted(known.items()) if d.get("required") is True and a not in given]
        out += [f"attribute {a!r} is not declared on {bare(t)}" for a in given if a not in known]
        return out + [f"attribute {a!r}: {e}" for a, v in given.items() if a in known and known[a].get("type") for e in validate.value_errors(reg, known[a]["type"], v)]
    if kind == "edge":
        name = bare(payload.get("type") or "")
        package, _, edge = name.rpartition("/")
        found = package in reg.packages and edge in reg.packages[package].edges
        return ([] if found else [f"edge type {payload.get('type')!r} does not resolve"]) + [f"edge needs {s}" for s in ("from", "to") if not payload.get(s)]
    if kind == "classification":
        out = [] if payload.get("subject") else ["classification needs subject"]
        term = payload.get("term")
        return out + (["classification needs term"] if not term else [] if reg.term_exists(term) else [f"term {term!r} resolves to no taxonomy term"])
    if kind == "document":
        return [] if payload.get("content_hash") else ["document needs content_hash"]
    return [f"unknown object kind {kind!r}"]


def schema_violations(ops: DataFrame, regs: list[tuple[int, int, catalog.Registry]]) -> DataFrame:
    """payload_errors() of every create and update by the schema in force, as violations; a batch at a time, as definitions nest."""
    shared = ops.sparkSession.sparkContext.broadcast(regs)

    def run(batches):
        import bisect

        import pyarrow as pa

        starts = [lo for lo, _, _ in shared.value]
        for batch in batches:
            rows = []
            for seq, idx, kind, id_, payload in zip(*(c.to_pylist() for c in batch.columns)):
                reg = shared.value[max(0, bisect.bisect_right(starts, seq) - 1)][2]
                rows += [(seq, 2, idx, "schema", kind, id_, e) for e in payload_errors(reg, kind, json.loads(payload))]
            types = [pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["seq", "stage", "op_idx", "code", "kind", "id", "detail"])

    writes = ops.where(F.col("verb").isin("create", "update")).select(F.col("seq").cast("long").alias("seq"), "op_idx", "kind", "id", "payload")
    return writes.mapInArrow(run, "seq long, stage int, op_idx int, code string, kind string, id string, detail string")


def end_type_violations(ops: DataFrame, regs: list[tuple[int, int, catalog.Registry]]) -> DataFrame:
    """Edges with an end whose type, as it stood at the edge's own position, is outside the edge's domain or range in the schema in force."""
    ends = None
    for i, (_, _, reg) in enumerate(regs):
        part = reg.edge_table(ops.sparkSession).withColumn("epoch", F.lit(i))
        ends = part if ends is None else ends.unionByName(part)
    epoch = timeline.epoch_col([lo for lo, _, _ in regs[1:]]) if regs[1:] else F.lit(0)
    at = F.struct(F.col("seq").cast("long").alias("seq"), F.col("op_idx").cast("int").alias("op_idx"))
    types = ops.where((F.col("kind") == "node") & F.col("verb").isin("create", "update")).select(F.concat_ws(":", "kind", "id").alias("ref"), at.alias("at"), bare_col(F.col("type")).alias("allowed"))
    edges = ops.where((F.col("kind") == "edge") & F.col("verb").isin("create", "update"))
    out = None
    for side in ("from_ref", "to_ref"):
        rows = edges.select("seq", "op_idx", "kind", "id", F.col("type").alias("t"), F.col(side).alias("ref"), at.alias("at"), epoch.alias("epoch"))
        typed = fold.asof_join(rows, types, "ref", "at", "allowed", "allowed").where("allowed is not null")
        bad = typed.withColumn("edge", bare_col(F.col("t"))).withColumn("side", F.lit(side)).join(ends, ["epoch", "edge", "side", "allowed"], "left_anti")
        part = bad.select(F.col("seq").cast("long").alias("seq"), F.lit(2).alias("stage"), F.col("op_idx").cast("int").alias("op_idx"), F.lit("edge end").alias("code"), "kind", "id", F.concat_ws(" ", "side", "allowed").alias("detail"))
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class Graph:
    spark: SparkSession
    store: DocStore
    namespace: str = canon.NAMESPACE

    # store

    @classmethod
    def create(cls, spark: SparkSession, store: DocStore, roots: list[str], namespace: str = canon.NAMESPACE) -> Graph:
        if store.read("graph.yaml"):
            raise GraphError("there is a graph already")
        store.write("graph.yaml", log.dump_yaml({"graph_id": str(uuid.uuid4()), "root_authority": roots, "trusted_measurements": []}))
        return cls(spark, store, namespace)

    @classmethod
    def open(cls, spark: SparkSession, store: DocStore, namespace: str = canon.NAMESPACE) -> Graph:
        if not store.read("graph.yaml"):
            raise GraphError("there is no graph")
        return cls(spark, store, namespace)

    def meta(self) -> dict:
        return log.parse_yaml(self.store.read("graph.yaml"))[0]

    def roots(self) -> list[str]:
        return list(self.meta().get("root_authority") or [])

    def trust(self, measurement: str) -> None:
        meta = self.meta()
        known = meta.setdefault("trusted_measurements", [])
        if measurement not in known:
            known.append(measurement)
        self.store.write("graph.yaml", log.dump_yaml(meta))

    def head(self) -> str | None:
        """The last changeset: HEAD, and what was appended after it should a writer have stopped before it moved HEAD."""
        at = (self.store.read("HEAD") or "").strip() or None
        while after := (self.store.read(f"next/{at or 'start'}") or "").strip():
            self._settle(after)
            at = after
        return at

    def _doc(self, folder: str, hash_: str, tail: str = "") -> dict | None:
        text = self.store.read(f"{folder}/{hash_}{tail}.yaml")
        return log.parse_yaml(text)[0] if text else None

    def changeset(self, hash_: str) -> dict | None:
        return self._doc("changesets", hash_)

    def evidence(self, hash_: str, folder: str = "changesets") -> dict:
        return self._doc(folder, hash_, ".evidence") or {"decisions": [], "envelopes": []}

    def chain(self) -> list[dict]:
        """Changesets from the first to the head, along first parents."""
        out, at = [], self.head()
        while at:
            cs = self.changeset(at)
            if cs is None:
                raise GraphError(f"changeset {at} is missing")
            out.append(cs)
            at = (cs.get("parents") or [None])[0]
        return out[::-1]

    def append(self, cs: dict, evidence: dict) -> None:
        """Claims the place after the parent, which can be done once, and only then makes the changeset part of the log.

        Until then it lies in ``staged``, from where a reader who meets the claim
        finishes the move should the writer have stopped; a writer who loses
        takes its files away again.
        """
        hash_, before = cs["hash"], (cs.get("parents") or ["start"])[0]
        self.store.write(f"staged/{hash_}.yaml", log.dump_yaml(cs))
        self.store.write(f"staged/{hash_}.evidence.yaml", log.dump_yaml(evidence))
        if not self.store.create(f"next/{before}", hash_) and (self.store.read(f"next/{before}") or "").strip() != hash_:
            self._remove("staged", hash_)
            raise Conflict(f"another changeset follows {before}")
        self._settle(hash_)
        self.store.write("HEAD", hash_)

    def _settle(self, hash_: str) -> None:
        if self.store.read(f"changesets/{hash_}.yaml"):
            return
        for tail in (".evidence", ""):  # a changeset is there when its evidence is
            if (text := self.store.read(f"staged/{hash_}{tail}.yaml")) is None:
                raise GraphError(f"changeset {hash_} is claimed but missing")
            self.store.write(f"changesets/{hash_}{tail}.yaml", text)
        self._remove("staged", hash_)

    def _remove(self, folder: str, hash_: str) -> None:
        self.store.remove(f"{folder}/{hash_}.yaml")
        self.store.remove(f"{folder}/{hash_}.evidence.yaml")

    def proposals(self) -> list[str]:
        """Hashes of what is held and neither admitted, rejected nor replaced."""
        return self._named("proposals")

    def closed(self) -> list[str]:
        """Hashes of proposals that were rejected or replaced; their changesets and signed records stay readable."""
        return self._named("closed")

    def _named(self, folder: str) -> list[str]:
        return sorted(n.removesuffix(".yaml") for n in self.store.list(folder) if not n.endswith(".evidence.yaml"))

    def proposal(self, hash_: str) -> tuple[dict, dict, str]:
        """A proposal's changeset, evidence and status: pending, stale (its parent is no longer the head), rejected, replaced or admitted."""
        for folder in ("proposals", "closed", "changesets"):
            cs = self._doc(folder, hash_)
            if cs is None:
                continue
            evidence, status = self.evidence(hash_, folder), "admitted"
            if folder == "closed":
                status = "replaced" if evidence.get("replaced_by") else "rejected"
            elif folder == "proposals":
                status = "pending" if (cs.get("parents") or [None])[0] == self.head() else "stale"
            return cs, evidence, status
        raise GraphError(f"no proposal {hash_}")

    # tables

    def ops(self, extra: list[dict] = (), upto: str | None = None) -> DataFrame:
        """Operations of the chain (to a changeset), and of further changesets after it.

        Where tasks can read the store themselves, the log doesn't pass the driver.
        """
        if getattr(self.store, "url", None) and self.head():
            known = self.read_ops(upto).select(*[c.split()[0] for c in log.OPS.split(", ")], "seq")
            rows = self._rows(extra, self.length(upto)) if extra else []
            return known.unionByName(self.spark.createDataFrame(rows, log.OPS + ", seq long")) if rows else known
        chain = self.chain()
        if upto is not None:
            hashes = [c["hash"] for c in chain]
            if upto not in hashes:
                raise GraphError(f"unknown revision {upto}")
            chain = chain[: hashes.index(upto) + 1]
        return self.spark.createDataFrame(self._rows([*chain, *extra], 0), log.OPS + ", seq long")

    def _rows(self, sets: list[dict], before: int) -> list[dict]:
        return [log.op_row(c.get("hash"), i, op, self.namespace) | {"seq": before + n} for n, c in enumerate(sets, 1) for i, op in enumerate(c.get("operations") or [])]

    def files(self, evidence: bool = False) -> DataFrame:
        """(path, text) of the changesets, or of their evidence."""
        if url := getattr(self.store, "url", None):
            return log.files(self.spark, f"{url}/changesets").where(F.col("path").contains(".evidence.") == F.lit(evidence))
        return frame(self.spark, self.store, "changesets", "" if evidence else ".evidence.yaml", ".evidence.yaml" if evidence else "")

    def order(self, upto: str | None = None) -> DataFrame:
        """(graph, hash, seq) of the chain, to a changeset, from the store's files, parsed on the executors."""
        sets = log.read_changesets(self.files(), namespace=self.namespace)
        return log.chain(sets.select("graph", "hash", "parents"), self.spark.createDataFrame([("g", upto or self.head())], "graph string, head string"))

    def length(self, upto: str | None = None) -> int:
        """Changesets of the chain, to a changeset."""
        if getattr(self.store, "url", None):
            return self.order(upto).count() if self.head() else 0
        hashes = [c["hash"] for c in self.chain()]
        return len(hashes) if upto is None else hashes.index(upto) + 1

    def read_ops(self, upto: str | None = None) -> DataFrame:
        """The chain's operations from the store's files, parsed on the executors; for logs that the driver shouldn't read."""
        order = self.order(upto)
        if upto and not order.limit(1).count():
            raise GraphError(f"unknown revision {upto}")
        return log.numbered(log.read_ops(self.files(), self.namespace), order)

    def state(self, upto: str | None = None) -> DataFrame:
        return fold.latest_state(self.ops(upto=upto))

    def _schema_nodes(self, state: DataFrame) -> list[dict]:
        return [{"type": r.type, "attributes": json.loads(r.attributes)} for r in catalog.meta_nodes(state).collect()]  # the schema is small

    def registry(self, state: DataFrame | None = None) -> catalog.Registry:
        state = self.state() if state is None else state
        return catalog.Registry.of_nodes(self._schema_nodes(state), lambda t: log.parse_yaml(t)[0])

    def policy(self, state: DataFrame | None = None) -> dict:
        for node in self._schema_nodes(self.state() if state is None else state):
            if bare(node["type"]) == "meta/Policy":
                return log.parse_yaml(node["attributes"]["definition"])[0]
        raise GraphError("the graph has no policy")

    def schema_context(self, state: DataFrame) -> str:
        meta = state.where((F.col("kind") == "node") & is_meta_col(F.col("type")))
        leaves = [r.leaf for r in merkle.leaves(meta, self.namespace).orderBy("kind", "id").collect()]
        return canon.merkle_root(leaves, "state-node", self.namespace) or canon.NO_SCHEMA

    def state_hash(self, state: DataFrame | None = None) -> str:
        leaves = merkle.leaves(self.state() if state is None else state, self.namespace)
        row = merkle.root(merkle.indexed(leaves, ["kind", "id"]), namespace=self.namespace).first()
        if row is None:
            raise GraphError("empty state")
        return row.root

    def principal(self, state: DataFrame, ref: str) -> dict | None:
        from ..operators.graph import principals

        row = principals(state).where(F.col("name") == ref.removeprefix("principal:")).first()
        return row and {"kind": row.kind, "id": row.id, "keys": json.loads(row.attributes).get("keys") or []}

    def object(self, kind: str, id_: str) -> dict | None:
        """A live object's payload and rev."""
        row = fold.live(self.state()).where((F.col("kind") == kind) & (F.col("id") == id_)).first()
        return row and {k: v for k, v in row.asDict().items() if v is not None}

    def log(self) -> DataFrame:
        """(seq, hash, author, n_ops, intent) of every changeset."""
        rows = [(n, c["hash"], c["author"]["principal"], len(c["operations"]), c.get("intent")) for n, c in enumerate(self.chain(), 1)]
        return self.spark.createDataFrame(rows, "seq long, hash string, author string, n_ops int, intent string")

    def view(self) -> DataFrame:
        """(kind, id, type, label, rev) of live objects."""
        from ..operators.graph import label_col

        return fold.live(self.state()).select("kind", "id", "type", label_col(F.col("attributes")).alias("label"), "rev")

    # transactions

    def build(self, author: str, seed: bytes, intent: str, ops: list[dict]) -> dict:
        head, state = self.head(), None
        cs = {
            "kind": "changeset",
            "parents": [head] if head else [],
            "author": {"principal": f"principal:{author}", "key": sign.key_id(sign.public_key(seed))},
            "timestamp": now_iso(),
            "intent": intent,
            "schema_context": canon.NO_SCHEMA if not head else self.schema_context(self.state() if state is None else state),
            "operations": ops,
        }
        cs["hash"] = canon.changeset_hash(cs, namespace=self.namespace)
        cs["signature"] = sign.sign(seed, cs["hash"])
        return cs

    def violations(self, extra: list[dict] = (), since: int = 1, ops: DataFrame | None = None, found: DataFrame | None = None, regs=None) -> DataFrame:
        """Everything that makes the chain, and changesets after it, inadmissible; of the schema and its rules from changeset ``since`` on.

        Operations are held against the schema that was in force at their
        parent; the first changeset against the one that it brings.  Rules see
        the state after each changeset that touches a type they speak of.  The
        number of jobs doesn't grow with the log.
        """
        ops = saved(self.ops(extra).withColumn("seq", F.col("seq").cast("long")), "ops") if ops is None else ops
        found = saved(timeline.versions(ops), "versions") if found is None else found
        regs = audit.schemas(found, ops.agg(F.max("seq")).first()[0] or 0) if regs is None else regs
        late = F.col("seq") >= since
        rules = timeline.rule_violations([(max(lo, since), hi, reg) for lo, hi, reg in regs if hi >= since], ops, found)
        rules = rules.select("seq", F.lit(4).alias("stage"), F.lit(0).alias("op_idx"), F.lit("rule").alias("code"), F.lit("node").alias("kind"), F.col("ref").alias("id"), F.concat_ws("/", "package", "rule").alias("detail"))
        return fold.violations(ops).unionByName(schema_violations(ops.where(late), regs)).unionByName(rules).unionByName(end_type_violations(ops, regs).where(late))

    def _evaluate(self, state: DataFrame, cs: dict, author_kind: str) -> Outcome:
        policy_doc, reg = self.policy(state), self.registry(state)
        rows = [log.op_row(cs["hash"], i, op, self.namespace) | {"seq": 1} for i, op in enumerate(cs["operations"])]
        ops = self.spark.createDataFrame(rows, log.OPS + ", seq long").withColumn("author_kind", F.lit(author_kind))
        terms = reg.term_table(self.spark)
        ctx = policy.contexts(ops, state, catalog.closure(terms, "term", "parent"), reg.ancestor_table(self.spark).select("type", "ancestor"), f"{self.namespace}:")
        row = policy.checklists(policy.with_matches(ctx, policy_doc), policy_doc).first()
        return Outcome("held", cs["hash"], list(row.matched_rules), [(r.role, r.quorum) for r in row.reviewers], list(row.attestations), row.root_required)

    def _satisfy(self, state: DataFrame, cs: dict, out: Outcome, evidence: dict) -> Outcome:
        policy_doc, author = self.policy(state), cs["author"]["principal"]
        if out.root_required and author not in self.roots():
            out.unmet.append(f"default posture is restricted: author {author} must hold root authority")
        out.unmet += self.reviewers_unmet(state, policy_doc, cs["hash"], out.reviewers, evidence["decisions"])
        for cls in out.attestations:
            notes = [n for e in evidence["envelopes"] if (n := self._attests(state, cs["hash"], e))]
            out.degraded += [f"attestation for class {cls}: {n}" for n in notes]
            if not notes:
                out.unmet.append(f"attestation_required: no verifiable envelope from class {cls}")
        return out

    def reviewers_unmet(self, state: DataFrame, policy_doc: dict, subject: str, reviewers, decisions: list[dict]) -> list[str]:
        """Quorums that approvals of a subject (a changeset's hash, or git:<sha>) under this policy don't reach."""
        context, unmet = canon.policy_context(policy_doc, self.namespace), []
        for role, quorum in reviewers:
            bound, have = set((policy_doc.get("roles") or {}).get(role) or []), set()
            for d in decisions:
                if d.get("subject") != subject or d.get("verdict") != "approve" or d.get("policy_context") != context:
                    continue
                message = canon.unsigned(d, "decision", self.namespace)
                for x in d.get("deciders") or []:
                    who = x.get("principal")
                    if who in bound and (p := self.principal(state, who)) and any(k.get("status") == "active" and sign.verify(k.get("public", ""), message, x.get("signature") or "") for k in p["keys"]):
                        have.add(who)
            if len(have) < quorum:
                unmet.append(f"reviewers: role {role} needs quorum {quorum}, have {len(have)}")
        return unmet

    def _attests(self, state: DataFrame, hash_: str, envelope: dict) -> str | None:
        if (envelope.get("statement") or {}).get("changeset_hash") != hash_ or not (p := self.principal(state, envelope.get("attester") or "")):
            return None
        message = canon.unsigned(envelope, "envelope", self.namespace)
        if not any(sign.verify(k.get("public", ""), message, envelope.get("signature") or "") for k in p["keys"]):
            return None
        measurement = (envelope.get("evidence") or {}).get("measurement")
        return {"none": "evidence is none", None: "evidence is none"}.get(envelope.get("evidence_type")) or (
            f"simulated measurement {measurement} is trusted" if envelope["evidence_type"] == "simulated" and measurement in self.meta().get("trusted_measurements", []) else None
        )

    def _accept(self, cs: dict) -> None:
        n = self.length() + 1
        bad = fold.first_violation(self.violations([cs], since=n).where(F.col("seq") == n)).first()
        if bad:
            raise Rejected(f"{bad.code}: {bad.kind}:{bad.id} {bad.detail}")

    def genesis(self, author: str, seed: bytes, ops: list[dict]) -> Outcome:
        """The first changeset admits itself; its author must be a root."""
        if self.head():
            raise GraphError("the graph has begun")
        cs = self.build(author, seed, "genesis", ops)
        self._accept(cs)
        self.append(cs, {"decisions": [], "envelopes": []})
        return Outcome("admitted", cs["hash"])

    def commit(self, author: str, seed: bytes, intent: str, ops: list[dict], envelopes=None) -> Outcome:
        """Admits a changeset whose requirements are met, else holds it as a proposal; ``envelopes(hash)`` may attest it."""
        return self.submit(self.build(author, seed, intent, ops), envelopes)

    def submit(self, cs: dict, envelopes=None) -> Outcome:
        state = saved(self.state(), "state")
        who = self.principal(state, cs["author"]["principal"])
        if not who:
            raise GraphError(f"unknown principal {cs['author']['principal']}")
        evidence = {"decisions": [], "envelopes": list(envelopes(cs["hash"])) if envelopes else []}
        out = self._satisfy(state, cs, self._evaluate(state, cs, who["kind"]), evidence)
        if out.unmet:
            self.store.write(f"proposals/{cs['hash']}.yaml", log.dump_yaml(cs))
            self.store.write(f"proposals/{cs['hash']}.evidence.yaml", log.dump_yaml(evidence))
            return out
        self._accept(cs)
        self.append(cs, evidence)
        out.status = "admitted"
        return out

    def envelope(self, attester: str, seed: bytes, hash_: str, evidence_type: str = "none", measurement: str | None = None) -> dict:
        body = {"kind": "envelope", "statement": {"changeset_hash": hash_}, "attester": f"principal:{attester}", "evidence_type": evidence_type}
        body |= {"evidence": {"measurement": measurement}} if measurement else {}
        return body | {"signature": sign.sign(seed, canon.unsigned(body, "envelope", self.namespace))}

    def decision(self, hash_: str, verdict: str, policy_doc: dict | None = None) -> tuple[dict, str]:
        """An unsigned record of a decision on a proposal, and the text that deciders sign; for signers that hold their keys elsewhere."""
        self._undecided(hash_)
        context = canon.policy_context(policy_doc or self.policy(), self.namespace)
        record = {"kind": "decision-record", "subject": hash_, "policy_context": context, "verdict": verdict, "timestamp": now_iso()}
        return record, canon.unsigned(record, "decision", self.namespace)

    def _undecided(self, hash_: str) -> tuple[dict, dict]:
        cs, evidence, status = self.proposal(hash_)
        if status in ("rejected", "replaced", "admitted"):
            raise AlreadyDecided(f"proposal {hash_} is {status}")
        return cs, evidence

    def decide(self, hash_: str, principal: str, seed: bytes, verdict: str = "approve") -> Outcome:
        """Signs and records a decision; see decide_with."""
        record, message = self.decision(hash_, verdict)
        return self.decide_with(hash_, record | {"deciders": [{"principal": f"principal:{principal}", "signature": sign.sign(seed, message)}]})

    def decide_with(self, hash_: str, record: dict) -> Outcome:
        """Records a decision that was signed elsewhere.

        A rejection closes the proposal, which keeps its record.  An approval
        that meets all that is asked admits it, unless the log has moved on
        meanwhile: then the approval is kept and the author must rebase.
        """
        cs, evidence = self._undecided(hash_)
        if record.get("kind") != "decision-record":
            raise GraphError(f"not a decision record: {record.get('kind')!r}")
        if record.get("subject") != hash_:
            raise GraphError(f"the record decides on {record.get('subject')!r}")
        if record.get("verdict") not in ("approve", "reject"):
            raise GraphError(f"unknown verdict {record.get('verdict')!r}")
        if not any(str(d.get("signature") or "").startswith("sig:ed25519:") for d in record.get("deciders") or []):
            raise GraphError("the record has no decider's signature")
        evidence["decisions"].append(record)
        if record["verdict"] == "reject":
            self._close(cs, evidence)
            return Outcome("rejected", hash_)
        state = saved(self.state(), "state")
        who = self.principal(state, cs["author"]["principal"])
        if not who:
            raise GraphError(f"unknown principal {cs['author']['principal']}")
        out = self._satisfy(state, cs, self._evaluate(state, cs, who["kind"]), evidence)
        out.status = "unmet" if out.unmet else "stale" if (cs.get("parents") or [None])[0] != self.head() else "admitted"
        if out.status == "admitted":
            self._accept(cs)
            try:
                self.append(cs, evidence)
                self._remove("proposals", hash_)
                return out
            except Conflict:
                out.status = "stale"
        self.store.write(f"proposals/{hash_}.evidence.yaml", log.dump_yaml(evidence))
        if out.status == "stale":
            out.unmet.append("the log has moved on: the author must rebase the proposal")
        return out

    def rebase(self, hash_: str, author: str, seed: bytes, envelopes=None) -> Outcome:
        """Submits a proposal's operations again on the head, signed anew by its author; the old one is closed and names what replaces it.

        Decisions name a hash, so they are made again for the new one.
        """
        cs, evidence = self._undecided(hash_)
        if cs["author"]["principal"] != f"principal:{author}":
            raise GraphError(f"{hash_} is by {cs['author']['principal']}")
        if (cs.get("parents") or [None])[0] == self.head():
            raise GraphError("nothing to rebase onto")
        out = self.submit(self.build(author, seed, cs.get("intent"), cs["operations"]), envelopes)
        self._close(cs, evidence | {"replaced_by": out.hash})
        return out

    def _close(self, cs: dict, evidence: dict) -> None:
        self.store.write(f"closed/{cs['hash']}.evidence.yaml", log.dump_yaml(evidence))
        self.store.write(f"closed/{cs['hash']}.yaml", log.dump_yaml(cs))
        self._remove("proposals", cs["hash"])

    def checkpoint(self, by: str, seed: bytes) -> dict:
        """A signed state hash of the head.  Its entries are proven by it, so they aren't listed; entries() has them as rows."""
        state = saved(self.state(), "state")
        body = {"kind": "checkpoint", "revision": self.head(), "state_hash": self.state_hash(state), "timestamp": now_iso(), "signer": f"principal:{by}"}
        body["signature"] = sign.sign(seed, canon.unsigned(body, "checkpoint", self.namespace))
        self.store.write(f"checkpoints/{body['revision']}.yaml", log.dump_yaml(body))
        return body

    def entries(self, upto: str | None = None) -> DataFrame:
        """(idx, kind, id, rev, deleted): what a state hash is over, numbered in its order, without a sort in one task."""
        return merkle.indexed(self.state(upto=upto).select("kind", "id", "rev", "deleted"), ["kind", "id"])

    def checkpoints(self) -> list[dict]:
        return [log.parse_yaml(self.store.read(f"checkpoints/{n}"))[0] for n in self.store.list("checkpoints")]

    def verify_checkpoints(self) -> DataFrame:
        """(revision, status): verified, or what is wrong with a checkpoint's revision, state hash or signature."""
        rows, known = [], {c["hash"] for c in self.chain()}
        for cp in self.checkpoints():
            who = self.principal(self.state(upto=cp["revision"]), cp["signer"]) if cp["revision"] in known else None
            message = canon.unsigned(cp, "checkpoint", self.namespace)
            if cp["revision"] not in known:
                status = "unknown revision"
            elif self.state_hash(self.state(upto=cp["revision"])) != cp["state_hash"]:
                status = "state hash does not recompute"
            elif not any(k.get("status") == "active" and sign.verify(k.get("public", ""), message, cp.get("signature") or "") for k in (who or {}).get("keys", [])):
                status = "bad signature"
            else:
                status = "verified"
            rows.append((cp["revision"], status))
        return self.spark.createDataFrame(rows, "revision string, status string")

    # audit

    def verify(self, policy_asof: str = "tip") -> DataFrame:
        """(seq, hash, author, integrity, authorship, governance, admitted_by, degraded) of every changeset; each level "verified" or what failed.

        Integrity: the stored hash is the content's and the changeset is
        admissible.  Authorship: the signature is that of the author's key as of
        the parent.  Governance: what the policy asked for is on record; by the
        tip's policy, or by the parent's with ``policy_asof="parent"``.
        admitted_by has the rules that asked, degraded the weak evidence.
        Tasks read the log; all changesets are judged at once, by steps and
        as-of joins (plans.audit), in a fixed number of jobs.
        """
        return audit.report(self, policy_asof)
