"""Build stages on the file system all executors see.

A stage is a folder with versions and one manifest.  A version is written
under a name of its own and is never changed; the manifest names the version
that counts, the key it was built with and what was counted while it was
built.  The manifest is replaced by one rename after the data is whole, so a
reader sees the old version or the new one, never half of one, and a build
that dies leaves only a version nobody names.  Everything goes through
Hadoop's file systems: the same code serves a laptop, HDFS and object stores.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Input key of a stage that reads no other stage.
ROOT_HASH = "root"
_MANIFEST = "manifest.json"


def canonical_json(value: object) -> str:
    """The same text for equal values, whatever their order of keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True)


def cache_key(stage_config: dict, input_hash: str) -> str:
    """SHA-1 of a stage's own settings and the key of what it reads, so that a change travels down the chain."""
    return hashlib.sha1(f"{canonical_json(stage_config)}|{input_hash}".encode()).hexdigest()


def rows_hash(df: DataFrame) -> str:
    """A digest of the rows of a table, whatever their order and files; for small fitted tables and checks."""
    sums = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.pmod("h", F.lit(2**31 - 1))), F.lit(0)).alias("a"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("b")
    )
    r = sums.first()
    return hashlib.sha1(canonical_json([df.columns, r.n, r.a, r.b]).encode()).hexdigest()


class Stages:
    """The stages under one root."""

    def __init__(self, spark: SparkSession, root: object) -> None:
        self.spark = spark
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        path = self._jvm.org.apache.hadoop.fs.Path(str(root))
        self.fs = path.getFileSystem(self._conf)
        self.root = str(path.makeQualified(self.fs.getUri(), self.fs.getWorkingDirectory()))

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def read_text(self, *parts: str) -> str | None:
        """The text of a small file, None where there is none."""
        at = self._path(*parts)
        if not self.fs.exists(at):
            return None
        stream = self.fs.open(at)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def replace_text(self, text: str, *parts: str) -> None:
        """Write a small file beside its place and rename it there, over an older one."""
        at, part = self._path(*parts), self._path(*parts[:-1], f".{parts[-1]}.{uuid.uuid4().hex}")
        stream = self.fs.create(part, True)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        over = self.spark.sparkContext._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self._conf).rename(part, at, over)

    def manifest(self, stage: str) -> dict | None:
        """What is published of a stage; None if that is nothing, or cannot be read."""
        try:
            held = json.loads(self.read_text(stage, _MANIFEST) or "null")
        except ValueError:
            return None
        return held if isinstance(held, dict) and {"key", "version"} <= held.keys() else None

    def is_fresh(self, stage: str, key: str) -> bool:
        held = self.manifest(stage)
        return held is not None and held["key"] == key and self.fs.exists(self._path(stage, held["version"]))

    def path(self, stage: str, *parts: str) -> str:
        """Where the published version of a stage, or something in it, lies."""
        held = self.manifest(stage)
        if held is None:
            raise FileNotFoundError(f"stage {stage!r} has not been built under {self.root}")
        return "/".join((self.root, stage, held["version"], *parts))

    def read(self, stage: str, *parts: str) -> DataFrame:
        return self.spark.read.parquet(self.path(stage, *parts))

    def has(self, stage: str, *parts: str) -> bool:
        held = self.manifest(stage)
        return held is not None and self.fs.exists(self._path(stage, held["version"], *parts))

    def build(self, stage: str, settings: dict, upstream: str, write: Callable[[str], dict | None], force: bool = False) -> str:
        """Bring a stage up to date and return its key.  ``write`` fills the folder it is given and returns what it counted."""
        key = cache_key(settings, upstream)
        if not force and self.is_fresh(stage, key):
            return key
        before, began = self.manifest(stage), time.time()
        version = f"v-{key[:12]}-{uuid.uuid4().hex[:8]}"
        counted = write("/".join((self.root, stage, version))) or {}
        record = {"key": key, "version": version, "settings": settings, "upstream": upstream, "seconds": round(time.time() - began, 1), "counted": counted}
        self.replace_text(json.dumps(record, ensure_ascii=False, indent=2), stage, _MANIFEST)
        if before is not None:
            self.fs.delete(self._path(stage, before["version"]), True)
        return key
