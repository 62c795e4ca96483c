"""Tables of documents and what belongs to them, written in whole versions.

A commit writes new files, the ids of the documents whose rows they replace, and last a manifest that names them all, put in
place by one rename. Until then readers see the version before; a commit that fails leaves it as it was, and a second
writer that took the same version number first makes the rename fail. A reader stays with the version it opened. A row is
live if no later commit replaced its document in its table. compact() writes the live rows anew, so that neither the manifest nor the replaced ids grow without end.

The manifest also lists the batches of work that are done and what they counted; a batch that is listed isn't done again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..errors import Conflict, ValidationError

KEY = "document_id"


@dataclass(frozen=True)
class Snapshot:
    """A version as its manifest has it."""

    spark: SparkSession
    manifest: dict

    @property
    def version(self) -> int:
        return self.manifest["version"]

    @property
    def log(self) -> dict[str, dict]:
        """What was counted by each batch that is done."""
        return self.manifest["log"]

    def tables(self) -> list[str]:
        return sorted(self.manifest["schemas"])

    def table(self, name: str) -> DataFrame:
        """The live rows of a table."""
        schema = self.manifest["schemas"].get(name)
        if schema is None:
            raise ValidationError(f"no table {name}")
        parts = [p["tables"][name] for p in self.manifest["parts"] if name in p["tables"]]
        rows = self.spark.read.schema(f"{schema}, _version long").parquet(*parts) if parts else self.spark.createDataFrame([], f"{schema}, _version long")
        columns = [c for c in rows.columns if c != "_version"]
        gone = [p["replaced"][name] for p in self.manifest["parts"] if name in p["replaced"]]
        if gone:
            last = self.spark.read.schema(f"{KEY} {self.manifest['key']}, _at long").parquet(*gone).groupBy(KEY).agg(F.max("_at").alias("_at"))
            rows = rows.join(last, KEY, "left").where("_at is null or _version >= _at").drop("_at")
        return rows.select(*columns)


class Store:
    """Versions under a folder."""

    def __init__(self, spark: SparkSession, folder: str, key: str = "string"):
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    def _manifest(self, version: int) -> str:
        return f"{self.folder}/versions/{version:012d}.json"

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in storage.names(self.spark, f"{self.folder}/versions") if n.endswith(".json")]

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The newest version, or the one given."""
        known = self.versions()
        if version is not None and version not in known:
            raise ValidationError(f"no version {version}")
        if not known:
            return Snapshot(self.spark, {"version": 0, "key": self.key, "schemas": {}, "parts": [], "log": {}})
        return Snapshot(self.spark, json.loads(storage.get_text(self.spark, self._manifest(known[-1] if version is None else version))))

    def commit(self, rows: Mapping[str, DataFrame], replaced: Mapping[str, DataFrame], base: Snapshot | None = None, batch: str | None = None, counted: dict | None = None) -> Snapshot:
        """The next version: for each table, the rows of `replaced` documents (document_id) gone, and `rows` added. base: the version
        that the rows were made from; if there is a newer one by now, Conflict."""
        base = base or self.snapshot()
        version, place = base.version + 1, f"{self.folder}/data/{uuid.uuid4().hex}"
        manifest = json.loads(json.dumps(base.manifest))
        part: dict = {"tables": {}, "replaced": {}}
        for name, frame in rows.items():
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
            if manifest["schemas"].setdefault(name, schema) != schema:
                raise ValidationError(f"{name} has other columns: {manifest['schemas'][name]}")
            part["tables"][name] = f"{place}/{name}"
            frame.withColumn("_version", F.lit(version).cast("long")).write.option("compression", "zstd").parquet(part["tables"][name])
        for name, keys in replaced.items():
            part["replaced"][name] = f"{place}/{name}-replaced"
            keys.select(F.col(KEY).cast(self.key)).distinct().withColumn("_at", F.lit(version).cast("long")).write.parquet(part["replaced"][name])
        manifest["parts"].append(part)
        if batch is not None:
            manifest["log"][batch] = counted or {}
        return self._publish(manifest, version)

    def compact(self) -> Snapshot:
        """A version with the live rows in one part."""
        base = self.snapshot()
        version, place = base.version + 1, f"{self.folder}/data/{uuid.uuid4().hex}"
        manifest = json.loads(json.dumps(base.manifest))
        manifest["parts"] = [{"tables": {n: f"{place}/{n}" for n in base.tables()}, "replaced": {}}]
        for name in base.tables():
            base.table(name).withColumn("_version", F.lit(version).cast("long")).write.option("compression", "zstd").parquet(f"{place}/{name}")
        return self._publish(manifest, version)

    def _publish(self, manifest: dict, version: int) -> Snapshot:
        manifest["version"] = version
        draft = f"{self.folder}/drafts/{uuid.uuid4().hex}.json"
        storage.put_text(self.spark, draft, json.dumps(manifest))
        storage.put_text(self.spark, f"{self.folder}/versions/_", "")  # the folder must be there
        if not storage.rename(self.spark, draft, self._manifest(version)):
            raise Conflict(f"version {version} was written by someone else")
        return Snapshot(self.spark, manifest)

    def vacuum(self, keep: int = 1) -> None:
        """Removes files that none of the `keep` newest versions names, and the older manifests. No writer may be at work."""
        known = self.versions()
        named = {p.rpartition("/")[0].rpartition("/")[2] for v in known[-keep:] for part in self.snapshot(v).manifest["parts"] for p in [*part["tables"].values(), *part["replaced"].values()]}
        for v in known[:-keep]:
            storage.remove(self.spark, self._manifest(v))
        for name in storage.names(self.spark, f"{self.folder}/data"):
            if name not in named:
                storage.remove(self.spark, f"{self.folder}/data/{name}")
