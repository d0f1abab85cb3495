"""Forms in which a state leaves and enters: Parquet tables, Markdown, share bundles, triples."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canon, sign
from ..functions.shared import saved
from ..functions.text import bare, bare_col, is_meta_col
from ..operators import fold, graph, merkle
from . import log

# the Parquet binding: six tables

ENVELOPE = ["id", "rev", "deleted", "redacted", "last_seq"]
TABLES = {
    "nodes": ("node", ["type", "attributes"]),
    "edges": ("edge", ["type", "from_ref", "to_ref", "attributes"]),
    "classifications": ("classification", ["subject", "term", "basis"]),
    "documents": ("document", ["content_hash", "attributes"]),
}


def tables(state: DataFrame) -> dict[str, DataFrame]:
    return {n: state.where(F.col("kind") == k).select(*[c for c in [*ENVELOPE, *cols] if c in state.columns]) for n, (k, cols) in TABLES.items()}


def write_tables(state: DataFrame, changesets: DataFrame, ops: DataFrame, path: str) -> None:
    """nodes and edges laid out by type, the others plain, and the log's changesets and lineage."""
    for name, df in tables(state).items():
        if name in ("nodes", "edges"):
            df.withColumn("of_type", F.regexp_replace(bare_col(F.col("type")), "[^A-Za-z0-9._-]", "-")).repartition("of_type").write.mode("overwrite").partitionBy("of_type").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
    changesets.write.mode("overwrite").parquet(f"{path}/changesets")
    lineage(ops).write.mode("overwrite").parquet(f"{path}/lineage")


def read_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in (*TABLES, "changesets", "lineage")}


def lineage(ops: DataFrame) -> DataFrame:
    """(child, parent, method): what each written object is derived from."""
    return ops.where(F.col("verb").isin("create", "update")).select(F.concat_ws(":", "kind", "id").alias("child"), F.explode("derived_from").alias("parent"), "method")


def triples(state: DataFrame) -> DataFrame:
    """(s, p, o) of live objects: types, attributes, edges and terms; envelopes are lost."""
    rows = fold.with_ref(fold.live(state))
    nodes = rows.where("kind = 'node'")
    parts = [
        nodes.select(F.col("ref").alias("s"), F.lit("type").alias("p"), bare_col(F.col("type")).alias("o")),
        nodes.select("ref", F.explode(F.from_json("attributes", "map<string,string>"))).select(F.col("ref").alias("s"), F.col("key").alias("p"), F.col("value").alias("o")),
        rows.where("kind = 'edge'").select(F.col("from_ref").alias("s"), bare_col(F.col("type")).alias("p"), F.col("to_ref").alias("o")),
        rows.where("kind = 'classification'").select(F.col("subject").alias("s"), F.lit("classified").alias("p"), bare_col(F.col("term")).alias("o")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# Markdown

LOSSES = ["history", "classification-envelopes", "edge-envelopes", "documents"]


def markdown(state: DataFrame, long_text: dict[str, str]) -> DataFrame:
    """(path, text) of every live node that is neither redacted nor schema: front matter, then its long text.

    ``long_text`` names the attribute of each bare type that becomes the body.
    """
    rows = fold.with_ref(fold.live(state)).where((F.col("kind") == "node") & ~F.col("redacted") & ~is_meta_col(F.col("type")))
    cls = fold.live(state).where("kind = 'classification'").groupBy(F.col("subject").alias("ref")).agg(F.array_sort(F.collect_list("term")).alias("terms"))
    edges = fold.live(state).where("kind = 'edge'").groupBy(F.col("from_ref").alias("ref")).agg(F.array_sort(F.collect_list(F.struct("id", "type", F.col("to_ref").alias("to")))).alias("links"))
    rows = rows.join(cls, "ref", "left").join(edges, "ref", "left").select("id", "rev", "type", "attributes", "terms", F.transform("links", lambda x: F.struct(x["type"].alias("type"), x["to"].alias("to"))).alias("links"))

    def page(batches):
        import pyarrow as pa

        for batch in batches:
            paths, texts = [], []
            for r in batch.to_pylist():
                attributes = json.loads(r["attributes"] or "{}")
                body = attributes.pop(long_text.get(bare(r["type"] or ""), ""), "") or ""
                front = {"id": r["id"], "rev": r["rev"], "type": r["type"]}
                front |= {"classifications": r["terms"]} if r["terms"] else {}
                front["attributes"] = attributes
                front |= {"links": r["links"]} if r["links"] else {}
                paths.append(f"{bare(r['terms'][0]) if r['terms'] else '_unclassified'}/{r['id']}.md")
                texts.append("---\n" + log.dump_yaml(front) + "---\n\n" + body.rstrip("\n") + "\n")
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], ["path", "text"])

    return rows.mapInArrow(page, "path string, text string")


def read_markdown(pages: DataFrame, long_text: dict[str, str], namespace: str = canon.NAMESPACE) -> DataFrame:
    """(path, id, type, front_rev, rev, payload, error) of pages(path, text); an edited page's rev differs from its front matter's."""

    def parse(batches):
        import pyarrow as pa
        import yaml

        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    if not text.startswith("---\n") or "\n---\n" not in text[4:]:
                        raise ValueError("no front matter")
                    front, _, body = text[4:].partition("\n---\n")
                    front = log.parse_yaml(front)[0]
                    attributes = dict(front.get("attributes") or {})
                    if name := long_text.get(bare(front["type"])):
                        attributes[name] = body.strip()
                    payload = {"kind": "node", "id": front["id"], "type": front["type"], "attributes": attributes}
                    payload |= {"provenance": front["provenance"]} if "provenance" in front else {}
                    rows.append((path, front["id"], front["type"], front["rev"], canon.revision_hash(payload, namespace), json.dumps(payload, ensure_ascii=False), None))
                except (ValueError, KeyError, TypeError, yaml.YAMLError) as e:
                    rows.append((path, None, None, None, None, None, str(e)[:200] or type(e).__name__))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(7)], ["path", "id", "type", "front_rev", "rev", "payload", "error"])

    return pages.select("path", "text").mapInArrow(parse, "path string, id string, type string, front_rev string, rev string, payload string, error string")


def edited(pages: DataFrame) -> DataFrame:
    """Pages to import as updates."""
    return pages.where("error is null and rev <> front_rev")


# share bundles


def proofs(state: DataFrame, namespace: str = canon.NAMESPACE) -> tuple[DataFrame, str]:
    """(kind, id, rev, deleted, leaf, proof) of every object, and the state's root."""
    named = state.select("kind", "id", "rev", "deleted").withColumn("leaf", canon.state_leaf_col(F.col("kind"), F.col("id"), F.col("rev"), F.col("deleted"), namespace))
    level = saved(merkle.indexed(named, ["kind", "id"]), "leaves")
    top = merkle.root(level.select("idx", "leaf"), namespace=namespace).first()["root"]
    return level.join(merkle.paths(level.select("idx", "leaf"), namespace=namespace).drop("leaf"), "idx"), top


def bundle(state: DataFrame, payloads: DataFrame, terms: DataFrame, region: str, graph_id: str, audience: str, revision: str, by: str, seed: bytes, timestamp: str, namespace: str = canon.NAMESPACE) -> tuple[dict, DataFrame]:
    """A share of a region: its signed head, and (kind, id, rev, payload, proof) of what it discloses.

    ``payloads(kind, id, payload)`` are the objects' contents as JSON.
    """
    proven, top = proofs(state, namespace)
    scope = graph.share_scope(state, terms, region)
    checkpoint = {"kind": "checkpoint", "revision": revision, "state_hash": top, "timestamp": timestamp, "signer": f"principal:{by}"}
    checkpoint["signature"] = sign.sign(seed, canon.unsigned(checkpoint, "checkpoint", namespace))
    head = {"kind": "share-bundle", "graph_id": graph_id, "grant": {"audience": audience, "scope": {"region": region}}, "checkpoint": checkpoint}
    return head, proven.join(scope, ["kind", "id"], "left_semi").join(payloads, ["kind", "id"]).select("kind", "id", "rev", "deleted", "leaf", "payload", "proof")


def verify_bundle(head: dict, objects: DataFrame, peers: dict[str, str], own_id: str, namespace: str = canon.NAMESPACE) -> DataFrame:
    """Objects with rev_ok and proof_ok; ValueError for an unknown peer, a bad signature or another audience.

    ``peers`` has the public key of each known graph.
    """
    if (public := peers.get(head["graph_id"])) is None:
        raise ValueError(f"unknown peer {head['graph_id']}")
    cp = head["checkpoint"]
    if not sign.verify(public, canon.unsigned(cp, "checkpoint", namespace), cp.get("signature") or ""):
        raise ValueError("bad checkpoint signature")
    if head["grant"].get("audience") not in ("public", own_id):
        raise ValueError("the grant is for another audience")
    leaf = canon.state_leaf_col(F.col("kind"), F.col("id"), F.col("rev"), F.col("deleted"), namespace)
    checked = merkle.check_paths(objects.withColumn("leaf", leaf), cp["state_hash"], namespace=namespace).withColumnRenamed("ok", "proof_ok")
    return checked.withColumn("rev_ok", F.coalesce(canon.rev_udf(F.col("payload"), namespace) == F.col("rev"), F.lit(False)))


def imported(objects: DataFrame, head: dict, method: str = "deterministic", namespace: str = canon.NAMESPACE) -> list[dict]:
    """Creates of a bundle's nodes under their origin; only for a bundle that verify_bundle() has passed, so bounded by its scope."""
    out = []
    for r in objects.where("kind = 'node'").orderBy("id").toLocalIterator():
        payload = json.loads(r.payload)
        origin = {"derived_from": [f"{namespace}:{head['graph_id']}/{r.id}@{r.rev}"], "method": method}
        out.append({"create": payload | {"provenance": origin}})
    return out
