"""Where signing seeds live: a small interface with a store in memory and one of private files."""

from __future__ import annotations

import os
from pathlib import Path
from typing import Protocol


class KeyBackend(Protocol):
    def seed(self, name: str) -> bytes | None: ...

    def store(self, name: str, seed: bytes) -> None: ...


def _check(name: str, seed: bytes) -> None:
    if len(seed) != 32:
        raise ValueError("a seed has 32 bytes")
    if not name or "/" in name or name.startswith("."):
        raise ValueError(f"bad key name {name!r}")


class MemoryKeys:
    def __init__(self, seeds: dict[str, bytes] | None = None):
        self.seeds = dict(seeds or {})

    def seed(self, name):
        return self.seeds.get(name)

    def store(self, name, seed):
        _check(name, seed)
        if name in self.seeds:
            raise FileExistsError(name)
        self.seeds[name] = seed


class FileKeys:
    """A file for each key, which only its owner can read and which is never overwritten; further folders are only read."""

    def __init__(self, folder: str, *fallbacks: str):
        self.folder, self.folders = Path(folder), [Path(folder), *map(Path, fallbacks)]

    def seed(self, name):
        for folder in self.folders:
            at = folder / f"{name}.key"
            if "/" not in name and at.is_file():
                return bytes.fromhex(at.read_text("ascii").strip())
        return None

    def store(self, name, seed):
        _check(name, seed)
        self.folder.mkdir(parents=True, exist_ok=True)
        handle = os.open(self.folder / f"{name}.key", os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o600)
        with os.fdopen(handle, "w") as f:
            f.write(seed.hex() + "\n")
