"""A keyed table of large rows that micro-batches change a little at a time.

Each batch writes the rows of the keys it changes (a delta, in a folder of its
own) and a manifest: key -> the newest batch that holds it. Rows of other keys
stay where they are. A manifest names at most `most` folders; when a batch would
exceed that, it also takes over the keys of the oldest folder, so that a read
opens a bounded number of folders and old ones are freed. Nothing is removed
before the batch that no longer needs it is committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinogrid import scratch


class DeltaTable:
    """Rows of `schema` below root/name; `keys` name a row or a few rows that are always written together."""

    def __init__(self, spark: SparkSession, root: str, name: str, schema: str, keys: list[str], most: int = 8):
        self.spark, self.folder, self.schema, self.keys, self.most = spark, f"{root}/{name}", schema, keys, most
        kinds = dict(field.split() for field in schema.split(", "))
        self._manifest_schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + ["at BIGINT"])

    def _delta_path(self, batch: int) -> str:
        return f"{self.folder}/delta/batch={batch}"

    def _manifest_path(self, batch: int) -> str:
        return f"{self.folder}/manifest/batch={batch}"

    def manifest(self, batch: int) -> DataFrame:
        """(keys, at) after a batch; empty before the first. What a run was begun with is under number -1."""
        if batch >= -1 and scratch.committed(self.spark, self._manifest_path(batch)):
            return self.spark.read.schema(self._manifest_schema).parquet(self._manifest_path(batch))
        return self.spark.createDataFrame([], self._manifest_schema)

    def _folders(self, manifest: DataFrame) -> list[int]:
        return sorted(r["at"] for r in manifest.select("at").distinct().collect())

    def read(self, batch: int, only: DataFrame | None = None) -> DataFrame:
        """Current rows after a batch; `only` (some of the keys) leaves out the folders that hold none of them."""
        manifest = self.manifest(batch)
        if only is not None:
            manifest = manifest.join(only.select(*self.keys).distinct(), self.keys, "left_semi")
        return self._rows(manifest, self._folders(manifest))

    def _rows(self, manifest: DataFrame, folders: list[int]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        found = None
        for at in folders:
            one = self.spark.read.schema(self.schema).parquet(self._delta_path(at)).withColumn("at", F.lit(at).cast("bigint"))
            found = one if found is None else found.unionByName(one)
        return found.join(manifest, [*self.keys, "at"], "left_semi").drop("at")

    def write(self, delta: DataFrame, batch: int, gone: DataFrame | None = None) -> None:
        """Put the rows of `delta` for its keys and forget those of `gone` (keys); a repeated batch replaces its own."""
        before = self.manifest(batch - 1)
        changed = delta.select(*self.keys).distinct()
        still = before.join(changed, self.keys, "left_anti")
        if gone is not None:
            still = still.join(gone.select(*self.keys).distinct(), self.keys, "left_anti")
        delta = delta.select(*[field.split()[0] for field in self.schema.split(", ")])
        folders = self._folders(before)
        if len(folders) >= self.most:
            old = still.where(F.col("at") == folders[0])
            delta, still = delta.unionByName(self._rows(old, folders[:1])), still.where(F.col("at") != folders[0])
        delta.write.mode("overwrite").parquet(self._delta_path(batch))
        written = self.spark.read.schema(self.schema).parquet(self._delta_path(batch))
        if gone is not None:
            written = written.join(gone.select(*self.keys).distinct(), self.keys, "left_anti")
        new = written.select(*self.keys).distinct().withColumn("at", F.lit(batch).cast("bigint"))
        still.unionByName(new).write.mode("overwrite").parquet(self._manifest_path(batch))

    def tidy(self, batch: int) -> None:
        """After the batch is committed: remove the manifest before it and the folders that no key needs any more."""
        needed = set(self._folders(self.manifest(batch))) | {batch}
        for at in set(self._folders(self.manifest(batch - 1))) | {batch - 1}:
            if at not in needed:
                scratch.discard(self.spark, self._delta_path(at))
        scratch.discard(self.spark, self._manifest_path(batch - 1))
