"""Versions of a small JSON document in a folder that all share: each is written once, under the next number, or not at all.

A version names the folders that make up a table or an index at that time. Folders are never changed once a version names
them, so whoever has read a version keeps it, whatever is written meanwhile. A new version comes into being by one rename
that fails where its number is taken: of two writers that began with the same version one wins, and the other gets a
Conflict with nothing changed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from tessera.shared import remove_path


class Conflict(RuntimeError):
    """Somebody else has written the next version."""


class Manifest:
    """The versions below path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._at = self._hadoop.Path(f"{self.path}/_versions")
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._fs = self._at.getFileSystem(self._conf)

    def versions(self) -> list[int]:
        if not self._fs.exists(self._at):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._at)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def read(self, version: int | None = None) -> tuple[int, dict]:
        """A version (the newest unless one is named) and its number; 0 and nothing if there is none."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return 0, {}
        stream = self._fs.open(self._hadoop.Path(self._at, f"{version:012d}.json"))
        try:
            return version, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: int, content: dict) -> int:
        """Write content as the version that follows base, or raise Conflict."""
        draft = self._hadoop.Path(self._at, f"_draft-{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(content).encode()))
        finally:
            stream.close()
        options = self.spark._sc._gateway.new_array(self._hadoop.Options.Rename, 0)  # none: an existing file stays
        try:
            self._hadoop.FileContext.getFileContext(self._fs.makeQualified(self._at).toUri(), self._conf).rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._hadoop.Path(self._at, f"{base + 1:012d}.json")), options)
        except Exception as error:
            self._fs.delete(draft, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {base + 1} of {self.path} exists") from None
            raise
        return base + 1

    def trim(self, keep: int) -> None:
        """Forget all but the newest versions, of what nobody reads later."""
        for version in self.versions()[:-keep]:
            self._fs.delete(self._hadoop.Path(self._at, f"{version:012d}.json"), False)

    def folder(self, name: str) -> str:
        """A path for a new folder that a version will name."""
        return f"{self.path}/{name}-{uuid.uuid4().hex}"

    def remove(self, folders) -> None:
        for folder in folders:
            remove_path(self.spark, folder)
