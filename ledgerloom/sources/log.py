"""A log of changesets: reading its documents, its order, and its operations as rows."""

from __future__ import annotations

import json
from functools import cache
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import canon
from ..functions.shared import saved

CHANGESETS = "graph string, hash string, stored string, parents array<string>, author string, author_key string, timestamp string, intent string, intent_hash string, schema_context string, signature string, op_count int, ops_root string"
EVIDENCE = "hash string, idx int, what string, subject string, verdict string, policy_context string, principal string, signature string, message string, evidence_type string, measurement string"
OPS = (
    "hash string, op_idx int, verb string, kind string, id string, type string, from_ref string, to_ref string, subject string, term string, asserted_by string, basis string, "
    "content_hash string, prior string, attributes string, method string, derived_from array<string>, rev string, leaf string, payload string"
)


def chain(changesets: DataFrame, heads: DataFrame) -> DataFrame:
    """(graph, hash, seq): each graph's first-parent chain from its head back to its start, numbered from the start.

    The walk doubles its step in every round, and so does the stretch below
    the head that is known to lie on the chain: a chain of n changesets takes
    log n joins, of which a few are planned together.  Changesets off the
    chain are left out; a hash that recurs ends it.
    """
    jump = changesets.select("graph", "hash", F.try_element_at("parents", F.lit(1)).alias("to"))
    jump = jump.withColumn("n", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long"))
    found = heads.select("graph", F.col("head").alias("hash"))
    longest = changesets.groupBy("graph").count().agg(F.max("count")).first()[0] or 0
    for k in range(max(1, longest).bit_length()):
        below = found.join(jump.where("n > 0"), ["graph", "hash"]).select("graph", F.col("to").alias("hash"))
        found = found.unionByName(below).distinct()
        far = jump.select("graph", F.col("hash").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"))
        jump = jump.join(far, ["graph", "to"], "left").select("graph", "hash", F.when(F.col("n2") > 0, F.col("to2")).otherwise(F.col("to")).alias("to"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"))
        if k % 3 == 2:
            jump, found = saved(jump, "jumps"), saved(found, "found")
    depth = jump.select("graph", "hash", (F.col("n") + 1).alias("seq"))
    return found.join(depth, ["graph", "hash"])


def touches_meta(ops: DataFrame, by: str = "seq") -> DataFrame:
    """(by, touches_meta) for each changeset: whether an operation of it is about a schema node."""
    from ..functions.text import is_meta_col

    return ops.groupBy(by).agg(F.bool_or((F.col("kind") == "node") & F.coalesce(is_meta_col(F.col("type")), F.lit(False))).alias("touches_meta"))


def summary(changesets: DataFrame, ops: DataFrame) -> DataFrame:
    """(graph, hash, short, author, n_ops, intent) of changesets, with the number of their operations."""
    from ..functions.text import short_col

    n = ops.groupBy("hash").agg(F.count("*").alias("n_ops"))
    return changesets.join(n, "hash", "left").select("graph", "hash", short_col(F.col("hash")).alias("short"), "author", F.coalesce("n_ops", F.lit(0)).alias("n_ops"), "intent")


#: Sequence numbers of a block of a long log's running counts.
SPAN = 1 << 16


def with_epochs(changesets: DataFrame, graph: list[str], seq: str) -> DataFrame:
    """changesets with position and epoch: how many of them, up to each, there are, and how many changed the schema.

    Blocks of SPAN sequence numbers are counted first, so that a long log is
    never one window.
    """
    block, n, m = "__block", "__n", "__m"
    rows = changesets.withColumn(block, F.floor(F.col(seq) / SPAN))
    touched = F.col("touches_meta").cast("long")
    per = rows.groupBy(*graph, block).agg(F.count("*").alias(n), F.coalesce(F.sum(touched), F.lit(0)).alias(m))
    before = Window.partitionBy(*graph).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*graph, block, *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in (n, m)))
    per = per.withColumnsRenamed({c: f"__of_{c}" for c in [*graph, block]})
    inside = Window.partitionBy(*graph, block).orderBy(seq)
    rows = rows.withColumn("position", F.row_number().over(inside)).withColumn("epoch", F.coalesce(F.sum(touched).over(inside), F.lit(0)))
    on = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in [*graph, block]]
    out = rows.join(per, on).withColumn("position", F.col("position") + F.col(n)).withColumn("epoch", F.col("epoch") + F.col(m))
    return out.select(*changesets.columns, "position", "epoch")


def parse_yaml(text: str) -> list:
    """Documents of a YAML 1.2 text: only null, booleans true and false, integers and floats are resolved."""
    import yaml

    fast, plain = _loader(True), _loader(False)
    try:
        return list(yaml.load_all(text, Loader=fast))
    except yaml.YAMLError:
        if fast is plain:
            raise
        return list(yaml.load_all(text, Loader=plain))  # what libyaml alone refuses is read; what both do has the same message as ever


def dump_yaml(value) -> str:
    import yaml

    return yaml.safe_dump(value, sort_keys=False, allow_unicode=True)


@cache
def _loader(fast: bool):
    """The loader, over libyaml's parser where that is there and ``fast``; made once in a process."""
    import re

    import yaml

    if fast and not hasattr(yaml, "CSafeLoader"):
        return _loader(False)

    class Loader(yaml.CSafeLoader if fast else yaml.SafeLoader):
        yaml_implicit_resolvers: dict = {}

    for tag, pattern, first in (
        ("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]),
        ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")),
        ("int", r"^[-+]?[0-9]+$|^0o[0-7]+$|^0x[0-9a-fA-F]+$", list("-+0123456789")),
        ("float", r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$|^[-+]?\.(?:inf|Inf|INF)$|^\.(?:nan|NaN|NAN)$", list("-+0123456789.")),
    ):
        Loader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), first)
    Loader.add_constructor("tag:yaml.org,2002:int", lambda self, node: int(node.value, 0) if node.value[:2] in ("0x", "0o") else int(node.value))
    return Loader


def op_row(hash_: str, idx: int, op: dict, namespace: str = canon.NAMESPACE) -> dict:
    """One operation as a row of OPS; an operation that isn't one verb over a map keeps nulls."""
    verb, p = next(iter(op.items())) if isinstance(op, dict) and op else (None, None)
    p = p if isinstance(p, dict) else {}
    prov = p.get("provenance") or {}
    body = {k: v for k, v in p.items() if k != "prior"}
    try:
        rev = canon.revision_hash(body, namespace) if verb in ("create", "update") else None
        leaf = canon.op_leaf(op, namespace)
    except ValueError:
        rev = leaf = None
    texts = {n: p.get(n) for n in ("kind", "id", "type", "subject", "term", "asserted_by", "basis", "content_hash", "prior")}
    return {
        "hash": hash_,
        "op_idx": idx,
        "verb": verb,
        **{k: None if v is None else str(v) for k, v in texts.items()},
        "from_ref": p.get("from"),
        "to_ref": p.get("to"),
        "attributes": json.dumps(p["attributes"], ensure_ascii=False) if isinstance(p.get("attributes"), dict) else None,
        "method": prov.get("method"),
        "derived_from": prov.get("derived_from"),
        "rev": rev,
        "leaf": leaf,
        "payload": json.dumps(p, ensure_ascii=False),
    }


def changeset_row(graph: str, cs: dict, namespace: str = canon.NAMESPACE) -> dict:
    ops = cs.get("operations") or []
    try:
        leaves = [canon.op_leaf(o, namespace) for o in ops]
        computed, top = canon.changeset_hash(cs, leaves, namespace), canon.merkle_root(leaves, "op-node", namespace)
    except ValueError:
        computed = top = None
    author = cs.get("author") or {}
    return {
        "graph": graph,
        "hash": computed,
        "stored": cs.get("hash"),
        "parents": cs.get("parents") or [],
        "author": author.get("principal") if isinstance(author, dict) else author,
        "author_key": author.get("key") if isinstance(author, dict) else None,
        "timestamp": cs.get("timestamp"),
        "intent": cs.get("intent"),
        "intent_hash": cs.get("intent_hash"),
        "schema_context": cs.get("schema_context"),
        "signature": cs.get("signature"),
        "op_count": len(ops),
        "ops_root": top,
    }


def _parsed(files: DataFrame, make, schema: str) -> DataFrame:
    """Rows that ``make`` yields for each document of files(path, text); a text that isn't YAML yields none."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for path, text in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    docs = [d for d in parse_yaml(text or "") if isinstance(d, dict)]
                except Exception as e:  # a broken file is reported by issues(), not by this table
                    if type(e).__module__.split(".")[0] != "yaml":
                        raise
                    docs = []
                rows += [r for d in docs for r in make(path, d)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(files.sparkSession.createDataFrame([], schema).schema)
    # parsing is the work here: few bytes are many documents, so they are dealt out by number and not by bytes
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "text").repartition(tasks, "path").mapInArrow(run, schema)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of every YAML file below a path, one row a file."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.y*ml")
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_changesets(source: DataFrame, graph: str = "g", namespace: str = canon.NAMESPACE) -> DataFrame:
    """Changesets of files(path, text), each with the hash that its content has."""
    return _parsed(source, lambda _, d: [changeset_row(graph, d, namespace)] if "operations" in d else [], CHANGESETS)


def read_ops(source: DataFrame, namespace: str = canon.NAMESPACE, stored: bool = False) -> DataFrame:
    """Operations of the changesets of files(path, text), named by the hash that the content has, or by the one stored with it."""

    def make(_, d):
        if "operations" not in d:
            return []
        rows = [op_row(d.get("hash"), i, op, namespace) for i, op in enumerate(d["operations"] or [])]
        if stored:
            return rows
        try:
            leaves = [r["leaf"] for r in rows]
            hash_ = None if None in leaves else canon.changeset_hash(d, leaves, namespace)
        except ValueError:
            hash_ = None
        return [r | {"hash": hash_} for r in rows]

    return _parsed(source, make, OPS)


def read_evidence(source: DataFrame, namespace: str = canon.NAMESPACE) -> DataFrame:
    """A row of EVIDENCE for each decider of a decision, and for each envelope, of evidence files named <hash>.evidence.yaml."""

    def make(path, d):
        hash_, out = unquote(path.rsplit("/", 1)[-1]).removesuffix(".evidence.yaml"), []
        for i, x in enumerate(d.get("decisions") or []):
            body = {"hash": hash_, "idx": i, "what": "decision", "subject": x.get("subject"), "verdict": x.get("verdict"), "policy_context": x.get("policy_context"), "message": canon.unsigned(x, "decision", namespace)}
            out += [body | {"principal": w.get("principal"), "signature": w.get("signature") or ""} for w in x.get("deciders") or []]
        for i, x in enumerate(d.get("envelopes") or []):
            out.append({"hash": hash_, "idx": i, "what": "envelope", "subject": (x.get("statement") or {}).get("changeset_hash"), "principal": x.get("attester"), "signature": x.get("signature") or "", "message": canon.unsigned(x, "envelope", namespace), "evidence_type": x.get("evidence_type"), "measurement": (x.get("evidence") or {}).get("measurement")})
        return out

    return _parsed(source, make, EVIDENCE)


def numbered(ops: DataFrame, order: DataFrame) -> DataFrame:
    """ops with the position of their changeset, seq."""
    return ops.join(order.select("hash", "seq"), "hash")


def issues(source: DataFrame) -> DataFrame:
    """(path, issue) for files that aren't YAML and documents that aren't maps."""

    def run(batches):
        import pyarrow as pa
        import yaml

        for batch in batches:
            rows = []
            for path, text in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    rows += [(path, f"document {i} is no map") for i, d in enumerate(parse_yaml(text or "")) if not isinstance(d, dict)]
                except yaml.YAMLError as e:
                    rows.append((path, f"not YAML: {getattr(e, 'problem', None) or e}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["path", "issue"])

    return source.select("path", "text").mapInArrow(run, "path string, issue string")
