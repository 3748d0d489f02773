"""State that the driver keeps: generations, registry, workspaces, traces, notes.

These are small files. Tables of a generation are written by Spark into a folder
that becomes visible by one rename, and named by a pointer file.
"""

from __future__ import annotations

import fcntl
import json
import os
import tempfile
import tomllib
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.excerpts import unified_diff
from spindrift.functions.ids import new_ulid

#: Most bytes of a manifest, of the traces, and of one trace; most traces read at once.
MOST_MANIFEST, MOST_TRACES, MOST_TRACE, MOST_TAIL = 1 << 20, 8 << 20, 64 << 10, 1000


class StoreError(ValueError):
    pass


@contextmanager
def locked(path: Path) -> Iterator[None]:
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(f"{path}.lock", "w") as lock:
        fcntl.flock(lock, fcntl.LOCK_EX)
        yield


def replaced(path: Path | str, content: str | bytes) -> None:
    """The file with a new content, all or nothing; it keeps its mode."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    with os.fdopen(handle, "wb") as f:
        f.write(content.encode() if isinstance(content, str) else content)
        f.flush()
        os.fsync(f.fileno())
    if path.exists():
        os.chmod(name, path.stat().st_mode)
    os.replace(name, path)


def loaded(path: Path, default: dict) -> dict:
    if not path.exists():
        return default
    if path.stat().st_size > MOST_MANIFEST:
        raise StoreError(f"{path.name} exceeds 1 MiB")
    return json.loads(path.read_text(encoding="utf-8"))


@dataclass(frozen=True)
class Config:
    """Settings of a repository; unknown keys are refused."""

    repository_id: str
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    language_overrides: tuple[tuple[str, str], ...] = ()

    @staticmethod
    def load(path: str | Path) -> Config:
        raw = Path(path).read_bytes()
        if len(raw) > MOST_MANIFEST:
            raise StoreError("the configuration exceeds 1 MiB")
        d = tomllib.loads(raw.decode())
        unknown = set(d) - {"schema", "repository_id", "include", "exclude", "language_overrides"}
        if unknown or d.get("schema") != 1 or not d.get("repository_id"):
            raise StoreError(f"configuration: unknown keys {sorted(unknown)}, or no schema 1 with a repository_id")
        for p in [*d.get("include", []), *d.get("exclude", []), *d.get("language_overrides", {})]:
            if p.startswith("/") or "\\" in p or ".." in p.split("/"):
                raise StoreError(f"configuration: unsafe pattern {p}")
        return Config(d["repository_id"], tuple(d.get("include", [])), tuple(d.get("exclude", [])), tuple(d.get("language_overrides", {}).items()))


class Registry:
    """Checkouts of repositories on this machine."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def entries(self) -> list[dict]:
        return loaded(self.path, {"schema": 1, "registrations": []})["registrations"]

    def add(self, repository: str, checkout: str, alternate: bool = False) -> None:
        """Register a checkout; a second one of a repository must be an alternate."""
        checkout = os.path.realpath(checkout)
        with locked(self.path):
            known = self.entries()
            if any((e["repository_id"], e["checkout"]) == (repository, checkout) for e in known):
                return
            if not alternate and any(e["repository_id"] == repository for e in known):
                raise StoreError(f"{repository} is registered already")
            known.append({"repository_id": repository, "checkout": checkout, "alternate_worktree": alternate})
            known.sort(key=lambda e: (e["repository_id"], e["checkout"]))
            replaced(self.path, json.dumps({"schema": 1, "registrations": known}, indent=1))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(e["repository_id"], e["checkout"]) for e in self.entries()], "repository string, checkout string")


class WorkspaceStore:
    """Named sets of repositories."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def _path(self, name: str) -> Path:
        if not name or not all(c.isalnum() or c in "._-" for c in name):
            raise StoreError(f"not a workspace name: {name!r}")
        return self.folder / f"{name}.json"

    def create(self, name: str) -> None:
        path = self._path(name)
        with locked(path):
            if path.exists():
                raise StoreError(f"workspace {name} exists")
            replaced(path, json.dumps({"schema": 1, "repositories": []}))

    def members(self, name: str) -> list[str]:
        path = self._path(name)
        if not path.exists():
            raise StoreError(f"no workspace {name}")
        return loaded(path, {})["repositories"]

    def names(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.json"))

    def _change(self, name: str, change) -> None:
        with locked(self._path(name)):
            members = sorted(change(set(self.members(name))))
            replaced(self._path(name), json.dumps({"schema": 1, "repositories": members}))

    def add(self, name: str, repository: str) -> None:
        self._change(name, lambda m: m | {repository})

    def remove(self, name: str, repository: str) -> None:
        self._change(name, lambda m: m - {repository})


class SharedFolder:
    """Small files in a folder of any file system that Spark can write to."""

    def __init__(self, root: str | Path):
        self.root = str(root).rstrip("/")

    def _context(self):
        spark = SparkSession.getActiveSession()
        if spark is None:
            raise StoreError("needs a session")
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return jvm, path.getFileSystem(conf), jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.getFileSystem(conf).getUri(), conf)

    def path(self, *names: str) -> str:
        return "/".join((self.root, *names))

    def exists(self, *names: str) -> bool:
        jvm, files, _ = self._context()
        return files.exists(jvm.org.apache.hadoop.fs.Path(self.path(*names)))

    def renamed(self, old: str, new: str, overwrite: bool = False) -> None:
        """Rename in one step; fails where the new name exists, unless it is overwritten."""
        jvm, _, context = self._context()
        option = jvm.org.apache.hadoop.fs.Options.Rename
        options = jvm.java.lang.reflect.Array.newInstance(option.OVERWRITE.getClass(), 1)
        options[0] = option.OVERWRITE if overwrite else option.NONE
        at = jvm.org.apache.hadoop.fs.Path
        context.rename(at(self.path(old)), at(self.path(new)), options)

    def replaced(self, name: str, text: str) -> None:
        """Write a small file so that readers see the old or the new text."""
        jvm, files, _ = self._context()
        fresh = f"{name}.{new_ulid()}"
        out = files.create(jvm.org.apache.hadoop.fs.Path(self.path(fresh)), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.renamed(fresh, name, overwrite=True)

    def text(self, *names: str) -> str:
        jvm, files, _ = self._context()
        at = files.open(jvm.org.apache.hadoop.fs.Path(self.path(*names)))
        try:
            return bytes(at.readAllBytes()).decode()
        finally:
            at.close()


class Generations:
    """Generations of tables below a folder that all executors share, and the pointer to the current one.

    A generation becomes visible by one rename, the pointer changes by another;
    of two that are activated at once the later stays.
    """

    POINTER = "CURRENT"

    def __init__(self, root: str | Path):
        self.folder = SharedFolder(root)

    def write(self, tables: dict[str, DataFrame], violations: DataFrame | None = None, generation_id: str | None = None) -> str:
        """Write, check, seal and activate a generation; gives its id.

        A generation with violations, or of which a write fails, stays behind
        as ``<id>.building`` and is never used.
        """
        generation_id = generation_id or f"gen_{new_ulid()}"
        building = f"{generation_id}.building"
        if self.folder.exists(building) or self.folder.exists(generation_id):
            raise StoreError(f"generation {generation_id} exists")
        for name, df in tables.items():
            df.write.parquet(self.folder.path(building, f"{name}.parquet"))
        if violations is not None and (bad := violations.limit(5).collect()):
            raise StoreError(f"generation is not sound: {bad}")
        self.folder.replaced(f"{building}/SEALED", json.dumps({"generation_id": generation_id, "tables": sorted(tables)}))
        self.folder.renamed(building, generation_id)
        self.activate(generation_id)
        return generation_id

    def activate(self, generation_id: str) -> None:
        if not self.folder.exists(generation_id, "SEALED"):
            raise StoreError(f"{generation_id} is not sealed")
        self.folder.replaced(self.POINTER, generation_id + "\n")

    def current(self) -> str | None:
        return self.folder.text(self.POINTER).strip() if self.folder.exists(self.POINTER) else None

    def read(self, spark: SparkSession, name: str, generation_id: str | None = None) -> DataFrame:
        generation_id = generation_id or self.current()
        if not generation_id or not self.folder.exists(generation_id, "SEALED"):
            raise StoreError("no sealed generation")
        return spark.read.parquet(self.folder.path(generation_id, f"{name}.parquet"))


TRACE = "seq long, generation_id string, active_scorers array<string>, selected array<string>, omitted array<struct<entity_id:string,reason:string>>, diagnostics array<string>"


class Traces:
    """An append-only record of queries, without their text or sources."""

    def __init__(self, path: str | Path):
        self.path = Path(path)

    def append(self, trace: dict) -> None:
        with locked(self.path):
            held = self.path.stat().st_size if self.path.exists() else 0
            n = sum(1 for _ in self.path.open("rb")) if held else 0
            line = (json.dumps({"seq": n} | trace, ensure_ascii=False, separators=(",", ":")) + "\n").encode()
            if len(line) > MOST_TRACE or held + len(line) > MOST_TRACES:
                raise StoreError("the trace exceeds its bounds")
            with self.path.open("ab") as f:
                f.write(line)
                f.flush()
                os.fsync(f.fileno())

    def tail(self, spark: SparkSession, limit: int) -> DataFrame:
        """The last ``limit`` traces in the order they were written."""
        if not 1 <= limit <= MOST_TAIL:
            raise StoreError("limit must be 1 to 1000")
        if not self.path.exists():
            return spark.createDataFrame([], TRACE)
        return ordered_tail(spark.read.schema(TRACE).json(str(self.path)), "seq", limit)


def ordered_tail(rows: DataFrame, order: str, limit: int, *ties: str) -> DataFrame:
    """The last ``limit`` rows of an order, in that order."""
    return rows.orderBy(F.desc(order), *[F.desc(t) for t in ties]).limit(limit).orderBy(order, *ties)


class PersonalNotes:
    """A person's own notes, and their promotion into a repository."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def create(self, title: str) -> str:
        if not title.strip() or "\n" in title or "\r" in title:
            raise StoreError("a title has one line")
        note_id = f"note_{new_ulid()}"
        quoted = title.strip().replace("\\", "\\\\").replace('"', '\\"')
        replaced(self.folder / f"{note_id}.md", f'---\nid: {note_id}\ntitle: "{quoted}"\n---\n\n# {title.strip()}\n')
        return note_id

    def ids(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("note_*.md"))

    def read(self, note_id: str) -> str:
        if note_id not in self.ids():
            raise StoreError(f"no note {note_id}")
        return (self.folder / f"{note_id}.md").read_text(encoding="utf-8")

    def promote(self, note_id: str, destination: str | Path, confirm: bool = False, overwrite: bool = False) -> str:
        """The diff that promotion makes; written only with ``confirm``."""
        text, path = self.read(note_id), Path(destination)
        old = path.read_text(encoding="utf-8") if path.exists() else None
        if confirm:
            if old is not None and old != text and not overwrite:
                raise StoreError("the destination exists; overwriting must be acknowledged")
            replaced(path, text)
        return unified_diff(old, text, path.name)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
