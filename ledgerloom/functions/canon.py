"""Canonical CBOR, domain-separated SHA-256 and the hashes built on them.

A log's hashes carry a namespace before the domain; it is a parameter, as logs
of different systems differ in it.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Namespace that hashes of this library's own logs carry.
NAMESPACE = "graph"
PREFIX = "sha256:"
#: What a log without any schema pins as its schema.
NO_SCHEMA = PREFIX + "0" * 64


def head(major: int, n: int) -> bytes:
    """A CBOR head in the shortest form (RFC 8949, 4.2.1)."""
    for size, info in ((1, 24), (2, 25), (4, 26), (8, 27)):
        if n < 24:
            return bytes([major << 5 | n])
        if n < 1 << 8 * size:
            return bytes([major << 5 | info]) + n.to_bytes(size, "big")
    raise ValueError(f"integer {n} has no canonical encoding")


def cbor(value) -> bytes:
    """Deterministic CBOR of None, bool, int, str, lists and maps with string keys; ValueError for anything else."""
    if value is None:
        return b"\xf6"
    if isinstance(value, bool):
        return b"\xf5" if value else b"\xf4"
    if isinstance(value, int):
        return head(0, value) if value >= 0 else head(1, -1 - value)
    if isinstance(value, str):
        data = value.encode()
        return head(3, len(data)) + data
    if isinstance(value, (list, tuple)):
        return head(4, len(value)) + b"".join(map(cbor, value))
    if isinstance(value, dict):
        if not all(isinstance(k, str) for k in value):
            raise ValueError("map keys must be strings")
        pairs = sorted((cbor(k), v) for k, v in value.items())
        return head(5, len(pairs)) + b"".join(k + cbor(v) for k, v in pairs)
    raise ValueError(f"{type(value).__name__} has no canonical encoding")


def domain_hash(domain: str, payload: bytes, namespace: str = NAMESPACE) -> str:
    return PREFIX + hashlib.sha256(f"{namespace}:{domain}:".encode() + payload).hexdigest()


def plain_hash(payload: bytes) -> str:
    return PREFIX + hashlib.sha256(payload).hexdigest()


def hash_value(domain: str, value, namespace: str = NAMESPACE) -> str:
    return domain_hash(domain, cbor(value), namespace)


def digest(text: str) -> bytes:
    if not text.startswith(PREFIX) or len(text) != len(PREFIX) + 64:
        raise ValueError(f"no digest: {text!r}")
    return bytes.fromhex(text[len(PREFIX) :])


def revision_hash(payload: dict, namespace: str = NAMESPACE) -> str:
    return hash_value("object", {k: v for k, v in payload.items() if k != "rev"}, namespace)


def op_leaf(op: dict, namespace: str = NAMESPACE) -> str:
    return hash_value("op-leaf", op, namespace)


def policy_context(policy: dict, namespace: str = NAMESPACE) -> str:
    return hash_value("package", policy, namespace)


def package_hash(doc: dict, namespace: str = NAMESPACE) -> str:
    return hash_value("package", doc, namespace)


def merkle_root(leaves: list[str], domain: str, namespace: str = NAMESPACE) -> str | None:
    """Root over leaves in order; an odd node is promoted unchanged; nothing has no root."""
    level = list(leaves)
    while len(level) > 1:
        pairs = [level[i : i + 2] for i in range(0, len(level), 2)]
        level = [domain_hash(domain, digest(p[0]) + digest(p[1]), namespace) if len(p) == 2 else p[0] for p in pairs]
    return level[0] if level else None


def merkle_path(leaves: list[str], at: int, domain: str, namespace: str = NAMESPACE) -> list[tuple[str, bool]]:
    """Siblings from a leaf up to the root, each with whether it stands on the left."""
    path, level = [], list(leaves)
    while len(level) > 1:
        if at ^ 1 < len(level):
            path.append((level[at ^ 1], bool(at & 1)))
        level = [merkle_root(level[i : i + 2], domain, namespace) for i in range(0, len(level), 2)]
        at //= 2
    return path


def verify_path(leaf: str, path: list[tuple[str, bool]], root: str, domain: str, namespace: str = NAMESPACE) -> bool:
    try:
        for sibling, left in path:
            pair = (sibling, leaf) if left else (leaf, sibling)
            leaf = domain_hash(domain, b"".join(map(digest, pair)), namespace)
    except ValueError:
        return False
    return leaf == root


def changeset_preimage(changeset: dict, leaves: list[str], namespace: str = NAMESPACE) -> bytes:
    root = merkle_root(leaves, "op-node", namespace)
    if root is None:
        raise ValueError("changeset has no operations")
    out = {k: v for k, v in changeset.items() if k not in ("hash", "signature", "intent_hash")}
    out["operations"] = root
    if isinstance(changeset.get("intent"), str):
        out["intent"] = domain_hash("intent", changeset["intent"].encode(), namespace)
        if "intent_hash" in changeset:
            out["intent_hash"] = changeset["intent_hash"]
    elif isinstance(changeset.get("intent_hash"), str):
        out["intent"] = changeset["intent_hash"]
    return cbor(out)


def changeset_hash(changeset: dict, leaves: list[str] | None = None, namespace: str = NAMESPACE) -> str:
    """Hash of a changeset; leaves stand in for operations that are elided."""
    leaves = leaves if leaves is not None else [op_leaf(op, namespace) for op in changeset["operations"]]
    return domain_hash("changeset", changeset_preimage(changeset, leaves, namespace), namespace)


def state_leaf(kind: str, id: str, rev: str, deleted: bool = False, namespace: str = NAMESPACE) -> str:
    entry = {"kind": kind, "id": id, "rev": rev}
    return hash_value("state-leaf", entry | ({"deleted": True} if deleted else {}), namespace)


def unsigned(record: dict, domain: str, namespace: str = NAMESPACE) -> str:
    """What is signed of a decision (subject, context, verdict and time), an envelope or a checkpoint (all but signatures)."""
    if domain == "decision":
        return hash_value(domain, {k: record[k] for k in ("subject", "policy_context", "verdict", "timestamp")}, namespace)
    return hash_value(domain, {k: v for k, v in record.items() if k != "signature"}, namespace)


# the same as columns, for shapes that are known beforehand


def plain_hash_col(payload: Column) -> Column:
    """plain_hash() of a string or binary column, as an expression."""
    return F.concat(F.lit(PREFIX), F.sha2(payload, 256))


def domain_hash_col(domain: str, payload: Column, namespace: str = NAMESPACE) -> Column:
    lead = F.lit(f"{namespace}:{domain}:".encode())
    return F.concat(F.lit(PREFIX), F.sha2(F.concat(lead, payload), 256))


def _head_col(major: int, n: Column) -> Column:
    def be(info: int, width: int) -> Column:
        return F.unhex(F.concat(F.lit(f"{major << 5 | info:02X}"), F.lpad(F.hex(n.cast("long")), 2 * width, "0")))

    short = F.unhex(F.lpad(F.hex((n + (major << 5)).cast("long")), 2, "0"))
    return F.when(n < 24, short).when(n < 1 << 8, be(24, 1)).when(n < 1 << 16, be(25, 2)).otherwise(be(26, 4))


def text_col(value: Column) -> Column:
    """CBOR of a string column, any length below 4 GiB."""
    data = F.encode(value, "utf-8")
    return F.concat(_head_col(3, F.length(data)), data)


def state_leaf_col(kind: Column, id: Column, rev: Column, deleted: Column, namespace: str = NAMESPACE) -> Column:
    """state_leaf() as an expression: keys in encoded order, deleted only where true."""

    def key(name: str) -> Column:
        return F.lit(cbor(name))

    body = F.concat(key("id"), text_col(id), key("rev"), text_col(rev), key("kind"), text_col(kind))
    gone = F.coalesce(deleted, F.lit(False))
    payload = F.when(gone, F.concat(F.lit(head(5, 4)), body, key("deleted"), F.lit(b"\xf5"))).otherwise(F.concat(F.lit(head(5, 3)), body))
    return domain_hash_col("state-leaf", payload, namespace)


def node_col(left: Column, right: Column, domain: str, namespace: str = NAMESPACE) -> Column:
    """An interior node over two digests; an odd one is promoted."""

    def raw(c: Column) -> Column:
        return F.unhex(F.substring(c, len(PREFIX) + 1, 64))

    return F.when(right.isNull(), left).otherwise(domain_hash_col(domain, F.concat(raw(left), raw(right)), namespace))


def rev_udf(payload: Column, namespace: str = NAMESPACE) -> Column:
    """revision_hash of a JSON payload of any shape; null for a payload that can't be encoded."""

    def rev(text: str | None) -> str | None:
        try:
            return None if text is None else revision_hash(json.loads(text), namespace)
        except ValueError:
            return None

    def revs(payloads):
        return payloads.map(rev)

    return F.pandas_udf(revs, "string")(payload)
