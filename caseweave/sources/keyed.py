"""Tables of one row per key that grow by batches: a merged base in buckets and, on top, the batches since.

Below the table's folder lie

* ``delta/batch=N/bucket=B``     the rows of one batch, merged per key within the batch
* ``base/version=V/bucket=B``    the merged rows of a bucket, as compaction V left them
* ``manifest/V.json``            the number of buckets, for each the version that holds it, and the last batch that is merged into the base

Reading merges the base with the later batches. ``compact`` rewrites only the buckets that those batches touch and then publishes a new
manifest by a rename, so a reader sees the table before or after. A batch that is written again replaces its own rows; one that is already
merged is skipped. The table has one writer.

The merge must be closed: merged rows merged again give what all rows give at once (sums, minima, maxima, the row of a greatest stamp).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets of a table unless given; a table for very many keys should have so many that a bucket fits a task.
BUCKETS = 16


class Files:
    """The few calls of Hadoop's file system that the manifest needs."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.store = self._path(folder).getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def names(self, pattern: str) -> list[str]:
        return sorted(str(f.getPath().toString()) for f in self.store.globStatus(self._path(pattern)) or [])

    def read(self, name: str) -> str:
        stream = self.store.open(self._path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """The file appears whole or not at all."""
        made = self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = self.store.create(made, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        if self.store.exists(self._path(name)) or not self.store.rename(made, self._path(name)):
            self.store.delete(made, False)
            raise RuntimeError(f"{name} was published by another writer")

    def delete(self, name: str) -> None:
        self.store.delete(self._path(name), True)


class KeyedTable:
    """``keys`` name a row; the first of them, or ``bucket_by``, choose its bucket. ``merge`` gives one aggregate per other column, under the
    column's name."""

    def __init__(
        self, spark: SparkSession, folder: str, schema: str | T.StructType, keys: Sequence[str], merge: Callable[[], list[Column]], bucket_by: Sequence[str] = (), buckets: int = BUCKETS
    ) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.keys, self.merge = list(keys), merge
        self.bucket_by, self.buckets = list(bucket_by) or self.keys[:1], buckets
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.files = Files(spark, self.folder)

    # The manifest

    def manifest(self) -> dict:
        found = self.files.names(f"{self.folder}/manifest/*.json")
        out = json.loads(self.files.read(found[-1])) if found else {"version": 0, "through": -1, "buckets": {}, "of": self.buckets}
        if out["of"] != self.buckets:
            raise ValueError(f"{self.folder} has {out['of']} buckets, not {self.buckets}")
        return out

    def _publish(self, manifest: dict) -> None:
        self.files.publish(f"{self.folder}/manifest/{manifest['version']:010d}.json", json.dumps(manifest))

    def _deltas(self, after: int, through: int | None = None) -> dict[int, list[int]]:
        """The buckets that each batch later than ``after`` touches."""
        out: dict[int, list[int]] = {}
        for name in self.files.names(f"{self.folder}/delta/batch=[0-9]*/bucket=*"):
            batch, bucket = map(int, re.search(r"batch=(\d+)/bucket=(\d+)$", name).groups())
            if batch > after and (through is None or batch <= through):
                out.setdefault(batch, []).append(bucket)
        return out

    # Rows

    def bucket(self) -> Column:
        return F.pmod(F.hash(*self.bucket_by), F.lit(self.buckets))

    def merged(self, rows: DataFrame, *more: str) -> DataFrame:
        return rows.groupBy(*more, *self.keys).agg(*self.merge()).select(*more, *self.schema.names)

    def _write(self, rows: DataFrame, path: str) -> None:
        """Rows with ``bucket``; one sorted file a bucket, or several where a bucket is more than a task should sort."""
        placed = rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", *self.keys)
        placed.write.mode("overwrite").partitionBy("bucket").parquet(path)

    def append(self, rows: DataFrame, batch: int) -> None:
        """The rows of a batch. Batch 0 belongs to a new stream and empties the table first."""
        manifest = self.manifest()
        if batch == 0:
            for name in self.files.names(f"{self.folder}/delta/batch=[0-9]*"):
                self.files.delete(name)
            manifest = {"version": manifest["version"] + 1, "through": -1, "buckets": {}, "of": self.buckets}
            self._publish(manifest)
        if batch > manifest["through"]:
            self._write(self.merged(rows.select(*self.schema.names)).withColumn("bucket", self.bucket()), f"{self.folder}/delta/batch={batch}")

    def _read(self, buckets: Sequence[int] | None = None, through: int | None = None, manifest: dict | None = None) -> tuple[DataFrame, bool]:
        """The stored rows with their bucket, and whether a key may have several."""
        manifest = manifest or self.manifest()
        wanted = None if buckets is None else set(buckets)
        keep = lambda b: wanted is None or int(b) in wanted
        base = [f"{self.folder}/base/version={v}/bucket={b}" for b, v in manifest["buckets"].items() if keep(b)]
        deltas = [f"{self.folder}/delta/batch={n}/bucket={b}" for n, of in self._deltas(manifest["through"], through).items() for b in of if keep(b)]
        stored = T.StructType([*self.schema.fields, T.StructField("bucket", T.IntegerType())])
        rows = self.spark.createDataFrame([], stored)
        for part, paths in (("base", base), ("delta", deltas)):
            if paths:
                rows = rows.unionByName(self.spark.read.schema(stored).option("basePath", f"{self.folder}/{part}").parquet(*paths).select(*stored.names))
        return rows, bool(deltas)

    def read(self, through: int | None = None) -> DataFrame:
        """One row per key, up to the given batch."""
        rows, open_ = self._read(through=through)
        return self.merged(rows) if open_ else rows.drop("bucket")

    def lookup(self, wanted: DataFrame, through: int | None = None) -> DataFrame:
        """The rows whose bucketing columns are among ``wanted``. Only the buckets that ``wanted`` names are opened; their numbers, at most as many
        as there are buckets, are all that reaches the driver."""
        ids = wanted.select(*self.bucket_by).distinct()
        buckets = [r[0] for r in ids.select(self.bucket().alias("b")).distinct().collect()]
        rows, open_ = self._read(buckets, through)
        found = rows.join(ids, self.bucket_by, "left_semi").select(*self.schema.names)
        return self.merged(found) if open_ else found

    def compact(self, through: int | None = None) -> list[int]:
        """Merge the batches up to ``through`` into the base; the buckets that were rewritten."""
        manifest = self.manifest()
        deltas = self._deltas(manifest["through"], through)
        if not deltas:
            return []
        touched = sorted({b for of in deltas.values() for b in of})
        version = manifest["version"] + 1
        rows, _ = self._read(touched, max(deltas), manifest)
        path = f"{self.folder}/base/version={version}"
        self._write(self.merged(rows, "bucket"), path)
        written = {str(b): version for b in touched}
        self._publish({"version": version, "through": max(deltas), "buckets": {**manifest["buckets"], **written}, "of": self.buckets})
        self._sweep(manifest["through"])
        return touched

    def _sweep(self, through: int) -> None:
        """Remove what no reader of the last two manifests opens."""
        found = self.files.names(f"{self.folder}/manifest/*.json")
        live = {(int(b), v) for name in found[-2:] for b, v in json.loads(self.files.read(name))["buckets"].items()}
        for name in self.files.names(f"{self.folder}/base/version=*/bucket=*"):
            version, bucket = map(int, re.search(r"version=(\d+)/bucket=(\d+)$", name).groups())
            if (bucket, version) not in live:
                self.files.delete(name)
        for name in self.files.names(f"{self.folder}/delta/batch=[0-9]*"):
            if int(name.rpartition("=")[2]) <= through:
                self.files.delete(name)
        for name in found[:-2]:
            self.files.delete(name)


def compact_every(tables: Sequence[KeyedTable], batch: int, every: int) -> None:
    """In the course of a stream: merge the batches before this one, which no replay can change any more."""
    if batch and batch % every == 0:
        for table in tables:
            table.compact(batch - 1)
