"""Trained artifacts on shared storage, found again by other sessions (A5).

An artifact's address is the digest of everything that it follows from: the input's files
(path, size, time), feature names, parameters and the version of the code that trains. Its
data is written to a folder with a name of its own; then a manifest, ``<kind>-<digest>.json``,
that names the folder is written beside it under a temporary name and renamed. A reader
follows the manifest only, so it meets all of an artifact or nothing; what a lost writer
leaves has no manifest and is never read (``sweep`` removes it). Two writers at once both
write complete folders, and the manifest names one of them.

The store lies at ``spark.basketlab.artifacts``, else below ``spark.checkpoint.dir``; only a
local session without either has one of its own.
"""
from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from basketlab.session import ensure_checkpoint_dir


def store_root(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    for name, below in (("spark.basketlab.artifacts", ""), ("spark.checkpoint.dir", "/artifacts")):
        root = spark.conf.get(name, None) or conf.get(name, None)
        if root:
            return root.rstrip("/") + below
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/artifacts"


class ArtifactStore:
    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or store_root(spark)).rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _write(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path))
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    @staticmethod
    def digest(**parts) -> str:
        return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]

    def find(self, kind: str, digest: str) -> str | None:
        """The artifact's folder, or None if it was never published or its data is gone."""
        manifest = f"{self.root}/{kind}-{digest}.json"
        if not self._fs.exists(self._path(manifest)):
            return None
        path = f"{self.root}/data/{json.loads(self._read(manifest))['folder']}"
        return path if self._fs.exists(self._path(path)) else None

    def publish(self, kind: str, digest: str, write: Callable[[str], None]) -> str:
        """``write`` fills a new folder, which then becomes the artifact at once."""
        folder = f"{kind}-{digest}-{uuid.uuid4().hex[:12]}"
        path = f"{self.root}/data/{folder}"
        write(path)
        manifest = f"{self.root}/{kind}-{digest}.json"
        part = f"{self.root}/.{folder}.part"
        self._write(part, json.dumps({"folder": folder, "kind": kind, "digest": digest,
                                      "time": int(time.time())}))
        if not self._fs.rename(self._path(part), self._path(manifest)):
            # another writer was first (file systems that don't replace on rename)
            self._fs.delete(self._path(part), False)
            self._fs.delete(self._path(path), True)
            return self.find(kind, digest)
        return path

    def get(self, kind: str, digest: str, write: Callable[[str], None]) -> str:
        """The artifact's folder, made now if it isn't there."""
        return self.find(kind, digest) or self.publish(kind, digest, write)

    def progress(self, kind: str, digest: str) -> str:
        """A folder for the intermediate state of an artifact in the making; a training that
        was cut off goes on from it."""
        return f"{self.root}/progress/{kind}-{digest}"

    def drop_progress(self, kind: str, digest: str) -> None:
        self._fs.delete(self._path(self.progress(kind, digest)), True)

    def sweep(self, older_than_sec: float = 7 * 86400.0) -> list[str]:
        """Remove folders that no manifest names and that are older than that."""
        named = set()
        if self._fs.exists(self._path(self.root)):
            for f in self._fs.listStatus(self._path(self.root)):
                name = f.getPath().getName()
                if name.endswith(".json"):
                    named.add(json.loads(self._read(f.getPath().toString()))["folder"])
        data, gone = self._path(f"{self.root}/data"), []
        for f in self._fs.listStatus(data) if self._fs.exists(data) else []:
            name = f.getPath().getName()
            if name not in named and f.getModificationTime() / 1000 <= time.time() - older_than_sec:
                self._fs.delete(f.getPath(), True)
                gone.append(name)
        return gone
