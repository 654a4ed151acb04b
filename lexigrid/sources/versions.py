"""Numbered versions of a folder's content, each published by one rename.

A version is a small file of JSON.  Versions are numbered and the greatest counts, so
readers see one or the other, a write that fails anywhere changes nothing, and of two
writers of one version the second fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Taken(RuntimeError):
    """Another write published this version first."""


class Conflict(RuntimeError):
    """Another write changed what this one was based on; it can be run again."""


class Versions:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("versions").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Numbers of the published versions, in order."""
        fs, folder = self._fs(), self._path("versions")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n) for n in names if n.isdigit())

    def version(self) -> int | None:
        return max(self.versions(), default=None)

    def _content(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.root}/versions/{number:012d}", wholetext=True).first()[0])

    def _publish(self, number: int, manifest: dict) -> None:
        """The one step that makes a version current."""
        fs, ready = self._fs(), self._path(f"versions/.{uuid.uuid4().hex}")
        out = fs.create(ready, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target = self._path(f"versions/{number:012d}")
        if fs.exists(target) or not fs.rename(ready, target):
            raise Taken(f"another write published version {number} of {self.root}")
