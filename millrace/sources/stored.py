"""Keyed tables as versions of bucketed Parquet: merges copy the buckets that they touch, readers see one whole version.

Layout: ``data/<write>/bucket=<n>/`` holds a bucket as one write left it; ``versions/<version>.json`` names the folder of every bucket;
``current`` names the version that counts, and is replaced by one rename. A write that fails leaves files that no version names. One
writer at a time: a second one that started from the same version raises an error.
"""

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import tables


class StoredTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark._jsc.hadoopConfiguration()
        self._files = self._path(self.path).getFileSystem(self._conf)

    # Small files: the pointer and the versions, each at most a line a bucket.
    def _write(self, name: str, text: str, replace: bool) -> None:
        fresh = self._path(f"{self.path}/{name}.{uuid.uuid4().hex}")
        out = self._files.create(fresh, False)
        out.write(bytearray(text.encode()))
        out.close()
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri() if fresh.toUri().getScheme() else self._files.getUri(), self._conf)
        modes = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        modes[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE if replace else jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context.rename(self._files.makeQualified(fresh), self._files.makeQualified(self._path(f"{self.path}/{name}")), modes)

    def _read(self, name: str) -> str:
        return "\n".join(r.value for r in self.spark.read.text(f"{self.path}/{name}").collect())

    def version(self) -> int:
        """The version that counts; 0 where there is none."""
        return int(self._read("current")) if self._files.exists(self._path(f"{self.path}/current")) else 0

    def _manifest(self, version: int) -> dict:
        return json.loads(self._read(f"versions/{version}.json"))

    def buckets(self, version: int | None = None) -> dict[int, str]:
        """The folder of every bucket that has rows."""
        return {int(k): v for k, v in self._manifest(version or self.version())["buckets"].items()}

    def _bucket(self, keys: list[str], n: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")

    def _stored(self, rows: DataFrame, keys: list[str], n: int) -> dict[int, str]:
        """Writes the buckets of ``rows``; their folders."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket(keys, n)).repartition(n, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        found = [s.getPath().getName() for s in self._files.listStatus(self._path(f"{self.path}/{folder}"))]
        return {int(f.partition("=")[2]): f"{folder}/{f}" for f in found if f.startswith("bucket=")}

    def _commit(self, before: int, manifest: dict) -> int:
        self._write(f"versions/{before + 1}.json", json.dumps(manifest), replace=False)  # fails where another writer was first
        self._write("current", str(before + 1), replace=True)
        return before + 1

    def create(self, rows: DataFrame, keys: list[str], buckets: int) -> int:
        """The first version: one row for each key."""
        folders = self._stored(rows, keys, buckets)
        return self._commit(0, {"keys": keys, "n": buckets, "schema": rows.schema.json(), "buckets": {str(k): v for k, v in folders.items()}})

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version (default: the one that counts)."""
        return self._rows(self._manifest(version or self.version()))

    def _rows(self, manifest: dict, only: set[int] | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(manifest["schema"]))
        folders = [f"{self.path}/{v}" for k, v in manifest["buckets"].items() if only is None or int(k) in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def lookup(self, *values) -> DataFrame:
        """The row of one key: of its bucket alone."""
        manifest = self._manifest(self.version())
        types = {f["name"]: f["type"] for f in json.loads(manifest["schema"])["fields"]}
        one = self.spark.range(1).select(*(F.lit(v).cast(types[k]).alias(k) for k, v in zip(manifest["keys"], values, strict=True)))
        bucket = one.select(self._bucket(manifest["keys"], manifest["n"]).alias("b")).first().b
        rows = self._rows(manifest, {bucket})
        for k, v in zip(manifest["keys"], values, strict=True):
            rows = rows.where(F.col(k).eqNullSafe(F.lit(v).cast(types[k])))
        return rows

    def merge(self, new: DataFrame, keep: tuple[str, ...] = ()) -> int:
        """Upserts ``new`` (one row for each key; see ``tables.latest``): a version in which only the buckets that it touches are new."""
        before = self.version()
        manifest = self._manifest(before)
        keys, n = manifest["keys"], manifest["n"]
        touched = {r.b for r in new.select(self._bucket(keys, n).alias("b")).distinct().collect()}  # n numbers at most
        if not touched:
            return before
        folders = self._stored(tables.upsert(self._rows(manifest, touched), new, keys, keep), keys, n)
        return self._commit(before, manifest | {"buckets": manifest["buckets"] | {str(k): v for k, v in folders.items()}})
