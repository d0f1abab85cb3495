"""What the engine asks of a revision store, for its own log and for git."""

from __future__ import annotations

from typing import TYPE_CHECKING, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import git

if TYPE_CHECKING:
    from ..plans.engine import Graph


class Substrate(Protocol):
    def revision(self, hash_: str) -> dict: ...

    def operation_set(self, hash_: str) -> DataFrame: ...

    def state_hash(self, hash_: str) -> str: ...

    def heads(self) -> dict[str, str]: ...

    def verify_authorship(self, hash_: str) -> str: ...


class NativeSubstrate:
    """A graph's own log."""

    def __init__(self, graph: Graph):
        self.graph = graph

    def revision(self, hash_):
        cs = self.graph.changeset(hash_)
        if cs is None:
            raise KeyError(hash_)
        return {"hash": hash_, "parents": cs.get("parents") or [], "author": cs["author"]["principal"], "timestamp": cs.get("timestamp")}

    def operation_set(self, hash_):
        """(verb, kind, id) of the changeset's operations."""
        return self.graph.ops(upto=hash_).where(F.col("hash") == hash_).select("verb", "kind", "id")

    def state_hash(self, hash_):
        return self.graph.state_hash(self.graph.state(upto=hash_))

    def heads(self):
        head = self.graph.head()
        return {"HEAD": head} if head else {}

    def verify_authorship(self, hash_):
        return self.graph.verify().where(F.col("hash") == hash_).first().authorship


class GitSubstrate:
    """A git repository that the driver can open."""

    def __init__(self, spark: SparkSession, repo: str):
        self.spark, self.repo = spark, repo

    def revision(self, hash_):
        return git.revision(self.repo, hash_)

    def operation_set(self, hash_):
        return git.changes(self.spark, self.repo, hash_).select("verb", F.lit("file").alias("kind"), F.col("path").alias("id"))

    def state_hash(self, hash_):
        return git.revision(self.repo, hash_)["tree"]

    def heads(self):
        return git.heads(self.repo)

    def verify_authorship(self, hash_):
        return "verified" if git.revision(self.repo, hash_)["signed"] else "no signature"
