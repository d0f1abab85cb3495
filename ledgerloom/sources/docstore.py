"""Where a graph's documents live: text under slash-separated paths."""

from __future__ import annotations

from pathlib import Path
from typing import Protocol
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

LAYOUT = {"graph": "graph.yaml", "head": "HEAD", "changesets": "changesets", "proposals": "proposals", "closed": "closed", "staged": "staged", "checkpoints": "checkpoints"}


class DocStore(Protocol):
    def read(self, path: str) -> str | None: ...

    def write(self, path: str, text: str) -> None: ...

    def list(self, folder: str) -> list[str]: ...

    def remove(self, path: str) -> None: ...

    def create(self, path: str, text: str) -> bool:
        """Writes a document that must not exist yet; False where it does, whoever else is writing."""
        ...


class MemStore:
    """Documents in memory; load() merges, the last write wins."""

    def __init__(self, docs: dict[str, str] | None = None):
        self.docs = dict(docs or {})

    def read(self, path):
        return self.docs.get(path)

    def write(self, path, text):
        self.docs[path] = text

    def list(self, folder):
        lead = f"{folder}/" if folder else ""
        return sorted({p[len(lead) :] for p in self.docs if p.startswith(lead) and "/" not in p[len(lead) :]})

    def remove(self, path):
        self.docs.pop(path, None)

    def create(self, path, text):
        return self.docs.setdefault(path, text) is text

    def dump(self):
        return dict(self.docs)

    def load(self, docs):
        self.docs.update(docs)


class FsStore:
    """Documents below a folder that the driver can open."""

    def __init__(self, root: str):
        self.root = Path(root)

    def _at(self, path: str) -> Path:
        at = (self.root / path).resolve()
        if self.root.resolve() not in (at, *at.parents):
            raise ValueError(f"{path} lies outside the store")
        return at

    def read(self, path):
        at = self._at(path)
        return at.read_text("utf-8") if at.is_file() else None

    def write(self, path, text):
        at = self._at(path)
        at.parent.mkdir(parents=True, exist_ok=True)
        new = at.with_name(at.name + ".new")
        new.write_text(text, "utf-8")
        new.replace(at)

    def list(self, folder):
        at = self._at(folder)
        return sorted(p.name for p in at.iterdir() if p.is_file()) if at.is_dir() else []

    def remove(self, path):
        self._at(path).unlink(missing_ok=True)

    def create(self, path, text):
        at = self._at(path)
        at.parent.mkdir(parents=True, exist_ok=True)
        try:
            with at.open("x", encoding="utf-8") as f:
                f.write(text)
        except FileExistsError:
            return False
        return True


class HadoopStore:
    """Documents below a folder of any file system that Spark reaches; ``url`` is where tasks read them themselves."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.root = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), root.rstrip("/")
        self.url = self.root

    def _at(self, path: str):
        if ".." in path.split("/") or path.startswith("/"):
            raise ValueError(f"{path} lies outside the store")
        path = path.replace("%", "%25").replace(":", "%3A")  # such file systems have no colons in names
        at = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}" if path else self.root)
        return at, at.getFileSystem(self.conf)

    def read(self, path):
        at, fs = self._at(path)
        if not fs.exists(at) or not fs.getFileStatus(at).isFile():
            return None
        stream = fs.open(at)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _put(self, at, fs, text: str, overwrite: bool) -> None:
        stream = fs.create(at, overwrite)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def write(self, path, text):
        at, fs = self._at(path)
        new = at.suffix(".new")
        self._put(new, fs, text, True)
        fs.delete(at, False)
        fs.rename(new, at)

    def list(self, folder):
        at, fs = self._at(folder)
        return sorted(unquote(p.getPath().getName()) for p in fs.listStatus(at) if p.isFile()) if fs.exists(at) else []

    def remove(self, path):
        at, fs = self._at(path)
        fs.delete(at, False)

    def create(self, path, text):
        from py4j.protocol import Py4JJavaError

        at, fs = self._at(path)
        try:
            self._put(at, fs, text, False)
        except Py4JJavaError as e:
            if fs.exists(at):
                return False
            raise e
        return True


def frame(spark: SparkSession, store: DocStore, folder: str, skip: str = ".evidence.yaml", only: str = "") -> DataFrame:
    """(path, text) of a folder's documents whose names end with ``only`` and not with ``skip``."""
    names = [n for n in store.list(folder) if n.endswith(only) and not (skip and n.endswith(skip))]
    return spark.createDataFrame([(f"{folder}/{n}", store.read(f"{folder}/{n}")) for n in names], "path string, text string")
