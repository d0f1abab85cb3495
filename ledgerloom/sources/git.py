"""Git as a source: trees as rows, what a commit changes, and the code graph of a tree."""

from __future__ import annotations

import json
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bare_col, items, language_col
from ..operators import diff
from ..operators.fold import live


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, *args], check=True, capture_output=True).stdout


def resolve(repo: str, ref: str) -> str:
    return _git(repo, "rev-parse", "--verify", f"{ref}^{{commit}}").decode().strip()


def revision(repo: str, commit: str) -> dict:
    """Parents, author, time and tree of a commit."""
    out = _git(repo, "show", "-s", "--format=%P%n%an <%ae>%n%aI%n%T%n%G?", commit).decode().split("\n")
    return {"hash": commit, "parents": out[0].split(), "author": out[1], "timestamp": out[2], "tree": out[3], "signed": out[4] in ("G", "U")}


def heads(repo: str) -> dict[str, str]:
    rows = _git(repo, "for-each-ref", "--format=%(refname) %(objectname)", "refs/heads").decode().splitlines()
    return dict(r.split(" ") for r in rows)


def tree(spark: SparkSession, repo: str, commit: str, skip: str = ".graph/") -> DataFrame:
    """(path, blob) of a commit's files."""
    raw = _git(repo, "ls-tree", "-r", "-z", commit).decode("utf-8", "replace")
    rows = []
    for entry in filter(None, raw.split("\0")):
        meta, _, path = entry.partition("\t")
        _, kind, blob = meta.split(" ")
        if kind == "blob" and not path.startswith(skip):
            rows.append((path, blob))
    return spark.createDataFrame(rows, "path string, blob string")


def with_text(files: DataFrame, repo: str) -> DataFrame:
    """files with the text of their blobs, read where the rows are; the repository must be reachable there."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [_git(repo, "cat-file", "blob", b).decode("utf-8", "replace") for b in batch.column(batch.schema.get_field_index("blob")).to_pylist()]
            yield batch.append_column("text", pa.array(texts, pa.string()))

    return files.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in files.dtypes) + ", text string")


def changes(spark: SparkSession, repo: str, commit: str) -> DataFrame:
    """(path, verb) of a commit against its first parent; everything is created by a commit without one."""
    new = tree(spark, repo, commit, skip="\0")
    parents = revision(repo, commit)["parents"]
    old = tree(spark, repo, parents[0], skip="\0") if parents else new.where("false")
    return diff.snapshot_diff(new, old, ["path"], ["blob"])


def code_items(files: DataFrame) -> DataFrame:
    """(path, kind, name, start, end, body) of the items of files(path, text); of equal path, kind and name the last counts."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = {}
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, name, start, end, body in items(text or ""):
                    rows[path, kind, name] = (path, kind, name, start, end, body)
            types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows.values()], t) for i, t in enumerate(types)], ["path", "kind", "name", "start", "end", "body"])

    return files.select("path", "text").mapInArrow(run, "path string, kind string, name string, start int, end int, body string")


def calls(found: DataFrame) -> DataFrame:
    """(path, caller, target_path, callee): functions whose body has "name(" of another item; equal names mean the first definition."""
    fns = found.where("kind = 'fn'")
    bodies = fns.select(F.struct("path", "name").alias("id"), F.col("body").alias("text"))
    named = diff.references_within(bodies, fns.select("name"))
    target = diff.first_definition(fns.select("name", "path", "kind")).select(F.col("name").alias("callee"), F.col("path").alias("target_path"))
    out = named.select(F.col("id.path").alias("path"), F.col("id.name").alias("caller"), F.col("name").alias("callee"))
    return out.where("caller <> callee").join(target, "callee").select("path", "caller", "target_path", "callee").distinct()


def code_graph(files: DataFrame) -> dict[str, DataFrame]:
    """files, items and calls of files(path, blob, text) as they should stand in a graph."""
    found = code_items(files)
    return {
        "files": files.select("path", F.col("blob").alias("content"), language_col(F.col("path")).alias("language")),
        "items": found.select("path", F.when(F.col("kind") == "trait", "interface").otherwise(F.col("kind")).alias("kind"), "name", F.concat_ws("-", "start", "end").alias("content")),
        "calls": calls(found),
    }


def index_state(state: DataFrame) -> dict[str, DataFrame]:
    """repository, files, items, calls, in_repo and declares of the code graph that a state has, with ids and revs.

    files, items and calls have the columns of code_graph() as well.
    """
    rows = live(state)

    def nodes(*types: str) -> DataFrame:
        return rows.where(F.col("kind") == "node").where(bare_col(F.col("type")).isin(*types))

    def edges(type_: str, *columns) -> DataFrame:
        return rows.where(F.col("kind") == "edge").where(bare_col(F.col("type")) == type_).select("id", "rev", F.col("from_ref").alias("from"), F.col("to_ref").alias("to"))

    def attr(name: str):
        return F.get_json_object("attributes", f"$.{name}")

    blob = F.regexp_extract(attr("blob"), r"^git:[^#]*#([^:]*)", 1)
    files = nodes("code/SourceFile").select(attr("path").alias("path"), blob.alias("content"), attr("language").alias("language"), "id", "rev")
    at = files.select("path", F.concat(F.lit("node:"), "id").alias("from"))
    declares = edges("code/declares").join(at, "from")
    fn = bare_col(F.col("type")) == "code/Function"
    named = nodes("code/Function", "code/Type").select(F.when(fn, "fn").otherwise(attr("kind")).alias("kind"), attr("name").alias("name"), F.regexp_replace(attr("span"), "L", "").alias("content"), F.concat(F.lit("node:"), "id").alias("to"), F.col("id").alias("item"), F.col("rev").alias("item_rev"))
    found = declares.join(named, "to")
    items = found.select("path", "kind", "name", "content", F.col("item").alias("id"), F.col("item_rev").alias("rev"))
    ends = found.where("kind = 'fn'").select("path", "name", F.col("to").alias("ref"))
    calls = edges("code/calls").join(ends.select(F.col("ref").alias("from"), "path", F.col("name").alias("caller")), "from")
    calls = calls.join(ends.select(F.col("ref").alias("to"), F.col("path").alias("target_path"), F.col("name").alias("callee")), "to")
    return {
        "repository": nodes("code/Repository").select("id", "rev").orderBy("id").limit(1),
        "files": files,
        "items": items,
        "calls": calls.select("path", "caller", "target_path", "callee", "id", "rev"),
        "in_repo": edges("code/in_repo").join(at, "from").select("path", "id", "rev"),
        "declares": found.select("path", "kind", "name", "id", "rev"),
    }


def graph_changes(desired: dict[str, DataFrame], existing: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What brings one code graph to another; no rows where nothing changed."""
    return {
        "files": diff.snapshot_diff(desired["files"], existing["files"], ["path"], ["content", "language"]),
        "items": diff.snapshot_diff(desired["items"], existing["items"], ["path", "kind", "name"], ["content"]),
        "calls": diff.set_diff(desired["calls"], existing["calls"]),
    }


def blast_radius(changed: DataFrame, calls_now: DataFrame) -> DataFrame:
    """(path, name, callers): of changed items the functions that call them."""
    hit = changed.select(F.col("path").alias("target_path"), F.col("name").alias("callee")).distinct()
    return hit.join(calls_now, ["target_path", "callee"], "left").groupBy(F.col("target_path").alias("path"), F.col("callee").alias("name")).agg(F.array_sort(F.collect_set("caller")).alias("callers"))


def decisions(repo: str, commit: str, ref: str = "decisions") -> list[dict]:
    """Decision records in a commit's notes."""
    done = subprocess.run(["git", "-c", "safe.directory=*", "-C", repo, "notes", "--ref", ref, "show", commit], capture_output=True)
    return json.loads(done.stdout) if done.returncode == 0 and done.stdout.strip() else []


def add_decision(repo: str, commit: str, record: dict, ref: str = "decisions") -> None:
    text = json.dumps([*decisions(repo, commit, ref), record], sort_keys=True)
    _git(repo, "-c", "user.name=graph", "-c", "user.email=graph@localhost", "notes", "--ref", ref, "add", "-f", "-m", text, commit)


def op_paths(ops: DataFrame, op: str = "op") -> DataFrame:
    """ops with a row for each verb and path of its JSON operations {verb: {"id": path}}; what has another form is left out."""
    found = ops.withColumn("__e", F.explode(F.map_entries(F.from_json(op, "map<string,string>"))))
    return found.withColumn("verb", F.col("__e.key")).withColumn("path", F.get_json_object(F.col("__e.value"), "$.id")).where("path is not null").drop("__e")
