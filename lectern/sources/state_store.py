"""Sessions' states as versioned snapshots that outlive the application.

A version is written in full under a name of its own, and only then published: a manifest that says which
parts make up the version is renamed into place, which fails if another writer was faster. Readers start
from the newest manifest, so they never see a version that is half written; what a killed job leaves behind
is never read, and goes with :meth:`StateStore.vacuum`.

A version holds the rows that it changes. The newest row of a key counts; after ``COMPACT`` versions a
version holds all rows again, so that few parts are read.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts of a version at most, and the tokens of earlier versions that a manifest knows.
COMPACT, TOKENS = 8, 1000
_VERSION = "__version"


class Conflict(RuntimeError):
    """Another writer has published this version."""


class StateStore:
    """Rows by ``key`` in a folder of a shared file system whose renames are atomic."""

    def __init__(self, spark: SparkSession, folder: str, key: str):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _fs(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        fs, path = self._fs(), self._path(folder)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def versions(self) -> list[int]:
        """The published versions, oldest first."""
        return sorted(int(n[:-5]) for n in self._names("manifests") if n.endswith(".json") and n[:-5].isdigit())

    def _manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/{version:012d}.json", wholetext=True).first()[0])

    def latest(self) -> dict | None:
        """The newest manifest: (version, parts, schema, tokens)."""
        found = self.versions()
        return self._manifest(found[-1]) if found else None

    def read(self, version: int | None = None) -> DataFrame | None:
        """The rows of a version, the newest by default; None if nothing is published."""
        manifest = self._manifest(version) if version is not None else self.latest()
        return self._rows(manifest) if manifest else None

    def _rows(self, manifest: dict) -> DataFrame:
        parts = [self.spark.read.schema(StructType.fromJson(manifest["schema"])).parquet(f"{self.folder}/parts/{p}").withColumn(_VERSION, F.lit(k)) for k, p in enumerate(manifest["parts"])]
        if len(parts) == 1:
            return parts[0].drop(_VERSION)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (self.key, _VERSION)]), _VERSION).alias("r"))
        return newest.select(*[F.col(c) if c == self.key else F.col(f"r.{c}").alias(c) for c in parts[0].columns if c != _VERSION])

    def publish(self, changed: DataFrame, token: str) -> int:
        """Adds or replaces the rows of ``changed`` (a row a key) and returns the version.

        ``token`` names the job: if a version of that token is published, nothing is done and the version it
        made is returned, so a job that is run again changes nothing. The columns are those of the first
        version. If another writer publishes first, :class:`Conflict` is raised and nothing is changed.
        """
        manifest = self.latest()
        if manifest and token in manifest["tokens"]:
            return manifest["tokens"][token]
        version = manifest["version"] + 1 if manifest else 1
        part = f"{version:012d}-{uuid.uuid4().hex}"
        parts = [part]
        if manifest:
            changed = changed.select(*StructType.fromJson(manifest["schema"]).names)
            if len(manifest["parts"]) < COMPACT:
                parts = [*manifest["parts"], part]
            else:
                changed = self._rows(manifest).join(changed.select(self.key), self.key, "left_anti").select(*changed.columns).unionByName(changed)
        changed.write.parquet(f"{self.folder}/parts/{part}")
        schema = manifest["schema"] if manifest else json.loads(changed.schema.json())
        tokens = dict(list((manifest["tokens"] if manifest else {}).items())[-TOKENS + 1 :]) | {token: version}
        self._put(version, {"version": version, "parts": parts, "schema": schema, "tokens": tokens})
        return version

    def _put(self, version: int, manifest: dict) -> None:
        jvm = self.spark.sparkContext._jvm
        fs, draft, final = self._fs(), self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{version:012d}.json")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            files.rename(draft, final, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as failed:
            fs.delete(draft, False)
            if fs.exists(final):
                raise Conflict(f"version {version} is another writer's") from failed
            raise

    def vacuum(self, keep: int = 2) -> list[str]:
        """Deletes what the newest ``keep`` versions don't need, and returns the parts that went.

        No job may be writing meanwhile, as what it has written so far isn't published yet.
        """
        found = self.versions()
        wanted = {p for v in found[-keep:] for p in self._manifest(v)["parts"]}
        gone = [p for p in self._names("parts") if p not in wanted]
        for v in found[:-keep]:
            self._fs().delete(self._path(f"manifests/{v:012d}.json"), False)
        for p in gone:
            self._fs().delete(self._path(f"parts/{p}"), True)
        return gone
