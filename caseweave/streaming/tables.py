"""Append-only result tables written per micro-batch.

Every batch owns one folder per table and overwrites only that folder, so a batch that is replayed
after a failure replaces its own rows and nothing is added twice. Batch 0 belongs to a new checkpoint:
it removes what the batches of an earlier one left, however those were cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def batch_path(folder: str, table: str, batch: int) -> str:
    return f"{folder.rstrip('/')}/{table}/batch={batch}"


def remove_batches(spark: SparkSession, folder: str, table: str) -> None:
    """Delete the batches of a table, but not the empty one that gives it its columns."""
    jvm = spark.sparkContext._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{table}/batch=[0-9]*")
    store = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in store.globStatus(pattern) or []:
        store.delete(found.getPath(), True)


def write_batch(df: DataFrame, folder: str, table: str, batch: int) -> None:
    if batch == 0:
        remove_batches(df.sparkSession, folder, table)
    df.drop("batch").write.mode("overwrite").parquet(batch_path(folder, table, batch))


def prepare(spark: SparkSession, folder: str, schemas: dict[str, str]) -> None:
    """Create empty tables, so that the first batch has something to read."""
    for table, schema in schemas.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(batch_path(folder, table, -1))


def read_all(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}").withColumn("batch", F.col("batch").cast("bigint"))


def read_before(spark: SparkSession, folder: str, table: str, batch: int) -> DataFrame:
    """Rows of earlier batches only, which is what a replay must see as well."""
    return read_all(spark, folder, table).where(F.col("batch") < batch)


def file_stream(spark: SparkSession, folder: str, schema, name_glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


#: State that does not fit the heap lies on the executors' disks and is saved by its changes.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: No batch without rows: state that waits for the clock would else ask for one after the other.
ROWS_ONLY = {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Queries started inside run with these settings; those of the session come back."""
    before = {name: spark.conf.get(name) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def run_available(writer, checkpoint: str) -> None:
    """Process what is there and stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
