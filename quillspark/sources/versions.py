"""Tables with versions (B7): upserts as new files beside the old ones, and a manifest for each version.

Rows are dealt into buckets by their id. A change reads and rewrites the buckets that its ids fall into, and no others; the
new version's manifest names the folder of each bucket. A manifest is created exclusively: of two writers of one version the
later one fails (VersionConflict) and changes nothing. What a writer that dies leaves are files that no manifest names, or a
manifest that is not whole, which is passed over; readers see the version before. Older versions can be read as long as
their folders are kept.

Defined cases: ids are not null (rows with a null id are an error). Of rows of one change with the same id one is kept, the
largest by all columns. A change without rows makes a version that is like the one before.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import saved


class VersionConflict(RuntimeError):
    pass


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, id: str = "id"):
        self.spark, self.path, self.id = spark, path.rstrip("/"), id

    # --- manifests

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def manifests(self) -> dict[int, dict]:
        """Whole manifests by version."""
        fs, p = self._fs("")
        if not fs.exists(p):
            return {}
        rows = self.spark.read.text(f"{self.path}/versions", wholetext=True).collect()  # one small file for each version
        out = {}
        for r in rows:
            try:
                m = json.loads(r.value)
            except ValueError:  # its writer died
                continue
            out[m["version"]] = m
        return out

    def latest(self) -> int:
        return max(self.manifests(), default=-1)

    def _commit(self, manifest: dict) -> None:
        fs, p = self._fs(f"{manifest['version']:08d}.json")
        try:
            out = fs.create(p, False)
        except Exception as e:  # noqa: BLE001
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                raise VersionConflict(f"version {manifest['version']} is there already") from e
            raise
        out.write(json.dumps(manifest).encode())
        out.close()

    # --- rows

    def _bucket(self, buckets: int):
        return F.pmod(F.xxhash64(self.id), F.lit(buckets)).cast("int").alias("bucket")

    def _put(self, rows: DataFrame, buckets: int) -> str:
        folder = uuid.uuid4().hex
        rows.select("*", self._bucket(buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        return folder

    def create(self, rows: DataFrame, buckets: int = 64) -> int:
        """The first version."""
        folder = self._put(self._one(rows), buckets)
        self._commit({"version": 0, "buckets": buckets, "schema": rows.schema.json(), "folders": {str(b): folder for b in range(buckets)}, "touched": buckets})
        return 0

    def _manifest(self, version: int | None) -> dict:
        found = self.manifests()
        if not found:
            raise ValueError(f"no table at {self.path}")
        version = max(found) if version is None else version
        if version not in found:
            raise ValueError(f"no version {version}")
        return found[version]

    def read(self, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The rows of a version (the latest one); only: of these buckets."""
        m = self._manifest(version)
        schema = StructType.fromJson(json.loads(m["schema"]))
        by_folder: dict[str, list[int]] = {}
        for b, folder in m["folders"].items():
            if only is None or int(b) in only:
                by_folder.setdefault(folder, []).append(int(b))
        out = self.spark.createDataFrame([], schema)
        for folder, own in by_folder.items():
            rows = self.spark.read.schema(StructType(schema.fields).add("bucket", "integer")).parquet(f"{self.path}/data/{folder}")
            out = out.unionByName(rows.where(F.col("bucket").isin(own)).select(*schema.names))
        return out

    def _one(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c != self.id]
        rows = rows.withColumn(self.id, F.coalesce(self.id, F.raise_error(F.lit("a row without id")).cast(dict(rows.dtypes)[self.id])))
        return rows.groupBy(self.id).agg(F.max(F.struct(*rest)).alias("_r")).select(*(F.col(self.id) if c == self.id else F.col(f"_r.{c}").alias(c) for c in rows.columns))

    def _change(self, ids: DataFrame, change, onto: int | None) -> int:
        base = self._manifest(onto)
        touched = sorted(r.bucket for r in ids.select(self._bucket(base["buckets"])).distinct().collect())  # as many as there are buckets at most
        folders = dict(base["folders"])
        if touched:
            folder = self._put(change(self.read(base["version"], touched)), base["buckets"])
            folders |= {str(b): folder for b in touched}
        self._commit(base | {"version": base["version"] + 1, "folders": folders, "touched": len(touched)})
        return base["version"] + 1

    def upsert(self, new: DataFrame, onto: int | None = None) -> int:
        """Rows of new in place of those with their ids, and beside the others; onto: the version that the writer has seen."""
        new = saved(self._one(new))
        return self._change(new, lambda rows: rows.join(new.select(self.id), self.id, "left_anti").select(*new.columns).unionByName(new), onto)

    def delete(self, ids: DataFrame, onto: int | None = None) -> int:
        ids = saved(ids.select(self.id).where(F.col(self.id).isNotNull()).distinct())
        return self._change(ids, lambda rows: rows.join(ids, self.id, "left_anti").select(*rows.columns), onto)
