"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scale import materialize, shared_folder

__all__ = ["materialize", "shared_folder"]

#: The characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SLICE_ROWS = 64
SLICE_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def blank_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null and empty texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def once(value: Column) -> Column:
    """The same value, which the optimizer computes where it stands: a later filter would else be pushed below and repeat it many times."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


#: Rows of a file of a small intermediate table.
FILE_ROWS = 50_000


def stored(df: DataFrame, rows: int) -> DataFrame:
    """``materialize`` for a table of at most ``rows`` narrow rows, in one file for each FILE_ROWS of them."""
    return materialize(df.coalesce(max(1, -(-rows // FILE_ROWS))))


def kept_in_worker(key: object, make: Callable[[], object]) -> object:
    """An object that later tasks of the same Python worker find again."""
    holder = sys.modules.setdefault("caseweave_worker_state", types.ModuleType("caseweave_worker_state"))
    state = holder.__dict__.setdefault("objects", {})
    if key not in state:
        state[key] = make()
    return state[key]


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in short slices, so that few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def slices_of_bytes(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of up to ``size`` bytes of a text column each, or of one longer row."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def crc32_of(column: Column) -> Column:
    return F.crc32(column.cast("string").cast("binary"))


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a file in the shared folder (file:, hdfs:, s3:, gs: or a plain path)."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def work_folder(spark: SparkSession, kind: str) -> str:
    """A new folder below the shared one for files that tasks write themselves."""
    import uuid

    folder = shared_folder(spark).rstrip("/")
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[len("file:"):]
    target = f"{folder}/caseweave-{kind}/{uuid.uuid4().hex}"
    store, path = open_store(target)
    store.create_dir(path, recursive=True)
    return target


def crc_of_ids(data: bytes) -> int:
    """Unsigned crc32 of ids held as little-endian unsigned 32-bit integers."""
    return zlib.crc32(data) & 0xFFFFFFFF
