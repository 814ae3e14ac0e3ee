"""Versioned manifests: a folder's content is what its newest manifest names.

Data are written beside, under new names, and count once a manifest of the next number
has been put in place, which only one writer can do. Readers take the newest manifest
and read the files that it names, so they see one version whole, whatever is written
meanwhile; older files stay until :meth:`Versions.vacuum`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Versions:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def new(self, name: str) -> str:
        """A name, relative to the folder, that nobody else uses."""
        return f"{name}-{uuid.uuid4().hex}"

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._at("manifests")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at("manifests"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._at(f"manifests/{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def current(self) -> tuple[int, dict | None]:
        """The newest number and its manifest; 0 and None if there is none."""
        found = self.numbers()
        return (found[-1], self.read(found[-1])) if found else (0, None)

    def commit(self, after: int, manifest: dict) -> bool:
        """Put the manifest after version ``after`` in place; False if another writer was first."""
        draft, to = self._at(f"manifests/.{uuid.uuid4().hex}"), self._at(f"manifests/{after + 1:012d}.json")
        stream = self._fs.create(draft, True)
        stream.write(bytearray(json.dumps(manifest, indent=1, sort_keys=True).encode()))
        stream.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        plain = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(to), plain)  # refuses to replace
        except Exception as e:
            self._fs.delete(draft, False)
            if "AlreadyExists" in str(e):
                return False
            raise
        return True

    def vacuum(self, names, keep: int = 1) -> list[str]:
        """Delete what only versions before the last ``keep`` need; ``names`` tells the
        folders that a manifest needs. Returns what went."""
        found = self.numbers()
        kept = {n for v in found[-keep:] for n in names(self.read(v))}
        gone = [s.getPath().getName() for s in self._fs.listStatus(self._at("")) if s.isDirectory() and s.getPath().getName() != "manifests" and s.getPath().getName() not in kept]
        for name in gone:
            self._fs.delete(self._at(name), True)
        for v in found[:-keep]:
            self._fs.delete(self._at(f"manifests/{v:012d}.json"), False)
        return gone
