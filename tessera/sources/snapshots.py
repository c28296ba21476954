"""Relations kept in a shared folder, changed as one.

A version of a store names, for each relation, the folders of its rows, by part where a relation is dealt to parts. A
change writes new folders and then one manifest; until that stands, readers see the version they had, and a change that
fails, or that another writer was faster than, leaves nothing behind. Parts that a change does not touch are named again,
not written again. Versions stay readable until vacuum().
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.manifests import Manifest
from tessera.operators import graph, maintenance
from tessera.shared import discard, materialize

#: Parts of a relation that is dealt by file.
PARTS = 64
WHOLE = ""


class Change:
    """What one version is to change: folders are written as they are told, and named when the change is committed."""

    def __init__(self, store: "SnapshotStore"):
        self.store = store
        self.base, content = store.manifest.read()
        self.relations: dict[str, dict] = {k: {"schema": v["schema"], "parts": dict(v["parts"])} for k, v in content.get("relations", {}).items()}
        self.written: list[str] = []

    def rows(self, name: str, parts: Sequence[str] | None = None) -> DataFrame:
        """A relation as this change has it so far, or some of its parts."""
        return self.store._rows(self.relations[name], parts)

    def _write(self, name: str, rows: DataFrame, by: str | None = None, dealt: bool = False) -> str:
        folder = self.store.manifest.folder(name)
        self.written.append(folder)
        writer = rows.write if by is None else (rows if dealt else rows.repartition(by)).write.partitionBy(by)
        writer.parquet(folder)
        return folder

    def replace(self, name: str, rows: DataFrame) -> None:
        """The relation's rows are these."""
        self.relations[name] = {"schema": rows.schema.json(), "parts": {WHOLE: [self._write(name, rows)]}}

    def append(self, name: str, rows: DataFrame) -> None:
        """The relation has these rows too; what it has is not written again. A new relation begins with them."""
        if name not in self.relations:
            return self.replace(name, rows)
        schema = T.StructType.fromJson(json.loads(self.relations[name]["schema"]))
        rows = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema))
        self.relations[name]["parts"].setdefault(WHOLE, []).append(self._write(name, rows))

    def replace_parts(self, name: str, rows: DataFrame, parts: Sequence[str], by: str = "part", kept: DataFrame | None = None) -> None:
        """Of a relation dealt to parts, these parts' rows are those of rows, whose column `by` (text) tells the part, and of
        kept, if there are any: rows read from these parts, which are written again where they are read, without moving."""
        schema = T.StructType([f for f in rows.schema if f.name != by])
        now = self.relations.setdefault(name, {"schema": schema.json(), "parts": {}})
        marked = [(x.withColumn(by, F.concat(F.lit("p"), by)), x is kept) for x in (rows, kept) if x is not None]
        folders = [self._write(name, x, by, dealt) for x, dealt in marked]
        for p in parts:
            now["parts"].pop(p, None)
        for folder in folders:
            for p in self.store._children(folder, by):
                now["parts"].setdefault(p.removeprefix("p"), []).append(f"{folder}/{by}={p}")

    def drop(self, name: str) -> None:
        self.relations.pop(name)


class SnapshotStore:
    """The store below path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.manifest = spark, Manifest(spark, path)

    def _children(self, folder: str, by: str) -> list[str]:
        fs, hadoop = self.manifest._fs, self.manifest._hadoop
        return [n.removeprefix(f"{by}=") for x in fs.listStatus(hadoop.Path(folder)) if (n := x.getPath().getName()).startswith(f"{by}=")]

    def _rows(self, relation: dict, parts: Sequence[str] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(relation["schema"]))
        folders = [f for p, own in relation["parts"].items() if parts is None or p in parts for f in own]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None, skip: Sequence[str] = ()) -> dict[str, DataFrame]:
        """The relations of a version, the newest unless one is named."""
        _, content = self.manifest.read(version)
        return {name: self._rows(x) for name, x in content.get("relations", {}).items() if name not in skip}

    def change(self, make: Callable[[Change], object]) -> int:
        """Make a change and commit it: all of it or, if make() or the commit raises, none. The new version's number."""
        change = Change(self)
        try:
            make(change)
            return self.manifest.commit(change.base, {"relations": change.relations})
        except BaseException:
            self.manifest.remove(change.written)
            raise

    def save(self, relations: dict[str, DataFrame]) -> int:
        """Replace these relations as one."""
        return self.change(lambda c: [c.replace(name, df) for name, df in relations.items()])

    def folders(self, version: int | None = None) -> set[str]:
        """Folders that a version names."""
        return {f for x in self.manifest.read(version)[1].get("relations", {}).values() for own in x["parts"].values() for f in own}

    def vacuum(self) -> None:
        """Delete the folders that the newest version does not name."""
        *old, newest = self.manifest.versions()
        kept = self.folders(newest)
        self.manifest.remove({f for v in old for f in self.folders(v)} - kept)


# ---- namespaces

#: Relations of a store of code graphs that are not keyed by a node's id.
CRATES, FILES, EDGES, WORKSPACES = "crates", "files", "edges", "workspaces"
#: Indexes that a change of a namespace makes stale.
INDEXES = {"sparse", "dense"}


def _keyed(relations: dict[str, DataFrame], keys: dict[str, str]) -> dict[str, tuple[DataFrame, str]]:
    return {name: (df, keys.get(name, "id")) for name, df in relations.items() if name not in (CRATES, FILES, EDGES, WORKSPACES)}


def export_namespace(store: SnapshotStore, namespace: str, artefact: SnapshotStore, keys: dict[str, str] | None = None) -> int:
    """Write a namespace to a store of its own: its crate (which must be one) and files, the rows of its nodes in every
    relation (by their id, or the column that keys names), and the edges between and to them."""
    now = store.read()
    ids = graph.written(maintenance.inventory(now[CRATES], now[FILES], now[EDGES], namespace).select("id"))
    out = maintenance.export(_keyed(now, keys or {}), ids, now[EDGES])
    out |= {name: now[name].where(F.col("namespace") == namespace) for name in (CRATES, FILES)}
    if WORKSPACES in now:
        out[WORKSPACES] = now[WORKSPACES].where(F.array_contains("members", namespace)).withColumn("members", F.array(F.lit(namespace)))
    version = artefact.save(out)
    discard(ids)
    return version


def import_namespace(store: SnapshotStore, artefact: SnapshotStore) -> set[str]:
    """Take in what an artefact holds, as one: rows are appended, workspaces of one root merged. ValueError, and nothing
    changed, if it conflicts with what is there (namespace, crate name, root path, workspace root). Returns the indexes
    that this makes stale."""
    incoming = artefact.read()

    def make(change: Change) -> None:
        have = set(change.relations)
        report = maintenance.conflicts(change.rows(CRATES), incoming[CRATES])
        if WORKSPACES in have and WORKSPACES in incoming:
            report = report.unionByName(maintenance.workspace_conflicts(change.rows(WORKSPACES), incoming[WORKSPACES]))
        found = report.limit(5).collect()
        if found:
            raise ValueError("conflicts: " + ", ".join(f"{r.field}={r.value}" for r in found))
        for name, rows in incoming.items():
            if name == WORKSPACES and name in have:
                change.replace(name, maintenance.merge_workspaces(change.rows(name), rows))
            else:
                change.append(name, rows)

    store.change(make)
    return set(INDEXES)


def remove_namespace(store: SnapshotStore, namespace: str, keys: dict[str, str] | None = None) -> set[str]:
    """Take a namespace out of every relation, as one; the indexes that this makes stale."""
    stale: set[str] = set()

    def make(change: Change) -> None:
        now = {name: change.rows(name) for name in change.relations}
        out, made = maintenance.remove_namespace(_keyed(now, keys or {}), now[CRATES], now[FILES], now[EDGES], now.get(WORKSPACES, now[CRATES].select(F.array("namespace").alias("members"))), namespace)
        for name, rows in out.items():
            if name in now:
                change.replace(name, rows)
        stale.update(made)

    store.change(make)
    return stale


# ---- changed files


def part_of(file_path, parts: int = PARTS):
    """The part that a file's rows lie in, as text."""
    return F.pmod(F.xxhash64(file_path), F.lit(parts)).cast("string")


HASHES = "file_hashes"


def refresh(store: SnapshotStore, contents: DataFrame, parse: Callable[[DataFrame], dict[str, DataFrame]], parts: int = PARTS) -> DataFrame:
    """Bring a store up to date with contents(file_path, content): (file_path, change) of what was added, removed or
    modified, by content hash. Only files that were added or modified are parsed; parse() gives relations with the column
    file_path. Only parts that hold a changed file are read and written, in all relations as one version; with no change
    there is none. Files without content, and rows that repeat a path, are errors of the caller: a path has one row."""
    hashed = contents.select("file_path", F.sha2("content", 256).alias("hash"))
    _, content = store.manifest.read()
    known = HASHES in content.get("relations", {})
    stored = store.read()[HASHES] if known else hashed.limit(0)
    changes = materialize(maintenance.scan_changes(stored, hashed), "changes")
    touched = [r["part"] for r in changes.select(part_of("file_path", parts).alias("part")).distinct().collect()]  # PARTS at most
    if not touched:
        return changes
    # of a new store all files are fresh, and their contents need not move to be found
    fresh = contents.join(changes.where("change != 'removed'").select("file_path"), "file_path", "left_semi") if known else contents
    made = parse(fresh) | {HASHES: fresh.select("file_path", F.sha2("content", 256).alias("hash"))}

    def make(change: Change) -> None:
        for name, rows in made.items():
            dealt, kept = part_of("file_path", parts), None
            if name in change.relations:
                kept = change.rows(name, touched).join(changes.select("file_path"), "file_path", "left_anti")
                rows, kept = rows.select(*kept.columns), kept.withColumn("part", dealt)
            change.replace_parts(name, rows.withColumn("part", dealt), touched, kept=kept)

    store.change(make)
    return changes
