"""Token ids in files of patched frame-of-reference blocks.

One file holds the ids of consecutive documents in ascending key order:

    magic | blocks | block starts (u64 each) | document keys (i64 each) | tokens of each document (u64 each) | foot

A block holds up to BLOCK ids: its least id (u32), the packing width (u8), the number of exceptions (u16) and of ids (u16), then
the ids less the least one, packed at the width that a percentile of them needs, and last the exceptions: those that need more bits,
as places (u16) and values (u32). Block starts give random access.

Files are written by tasks under names that no other attempt uses; only files in the manifest, itself a table of the shared
folder, are read. A lost executor costs a task, never a file that was counted.

Edges: a null or empty text holds the end id alone. Documents of equal key stay together, ordered by text. A null key comes first
and is kept as such. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of_ids, kept_in_worker, materialize, open_store, slices_of_bytes, work_folder
from .encode import TextEncoder

MAGIC = b"CWPFOR01"
BLOCK = 1024
PERCENTILE = 90
HEAD, HEAD_SIZE = "<IBHH", 9
FOOT, FOOT_SIZE = "<QQQ8s", 32  # first byte of the block starts, blocks, documents, magic
NO_KEY = -(2**63)
#: Bytes of files for one reading task.
READ_BYTES = 8 << 20
#: Ids held before their blocks are written.
HELD = 64 * BLOCK


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of up to 65,535 ids."""
    least = int(ids.min())
    rest = (ids - np.uint32(least)).astype(np.uint32)
    rank = min(len(rest) - 1, int(len(rest) * percentile / 100))
    width = int(np.partition(rest, rank)[rank]).bit_length()
    places = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, dtype=np.int64)
    packed = b""
    if width:
        kept = rest.astype("<u2" if width <= 16 else "<u4")
        kept[places] = 0
        lane = kept.dtype.itemsize
        packed = kept.tobytes()
        if width < 8 * lane:
            bits = np.unpackbits(kept.view(np.uint8).reshape(-1, lane), axis=1, bitorder="little")
            packed = np.packbits(bits[:, :width], bitorder="little").tobytes()
    return struct.pack(HEAD, least, width, len(places), len(rest)) + packed + places.astype("<u2").tobytes() + rest[places].astype("<u4").tobytes()


def unpack_block(data: bytes, at: int = 0) -> np.ndarray:
    least, width, odd, n = struct.unpack_from(HEAD, data, at)
    at += HEAD_SIZE
    size = (n * width + 7) // 8
    rest = np.zeros(n, np.uint32)
    if width:
        kind = np.dtype("<u2" if width <= 16 else "<u4")
        packed = np.frombuffer(data, np.uint8, size, at)
        if width < 8 * kind.itemsize:
            bits = np.zeros((n, 8 * kind.itemsize), np.uint8)
            bits[:, :width] = np.unpackbits(packed, count=n * width, bitorder="little").reshape(n, width)
            packed = np.packbits(bits, bitorder="little")
        rest = packed.view(kind).astype(np.uint32)
    at += size
    if odd:
        places = np.frombuffer(data, "<u2", odd, at)
        rest[places] = np.frombuffer(data, "<u4", odd, at + 2 * odd)
    return rest + np.uint32(least)


class BlockWriter:
    """Writes documents to one open binary file."""

    def __init__(self, out, block: int = BLOCK, percentile: float = PERCENTILE) -> None:
        self.out, self.block, self.percentile = out, block, percentile
        self.held: list[bytes] = []
        self.n_held = 0
        self.starts: list[int] = []
        self.keys: list[int] = []
        self.lengths: list[int] = []
        self.at = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: int | None, ids: bytes) -> None:
        self.keys.append(NO_KEY if key is None else key)
        self.lengths.append(len(ids) // 4)
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= HELD:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        end = len(ids) if last else len(ids) - len(ids) % self.block
        for start in range(0, end, self.block):
            self.starts.append(self.at)
            self._put(pack_block(ids[start : min(end, start + self.block)], self.percentile))
        self.held = [ids[end:].tobytes()]
        self.n_held = len(ids) - end

    def close(self) -> None:
        if self.n_held:
            self._flush(True)
        table = self.at
        self._put(np.array(self.starts, "<u8").tobytes() + np.array(self.keys, "<i8").tobytes() + np.array(self.lengths, "<u8").tobytes())
        self._put(struct.pack(FOOT, table, len(self.starts), len(self.keys), MAGIC))


class BlockReader:
    """Reads documents, or any run of ids, from one open random-access file."""

    def __init__(self, file, size: int) -> None:
        self.file = file
        file.seek(size - FOOT_SIZE)
        self.table, blocks, docs, magic = struct.unpack(FOOT, file.read(FOOT_SIZE))
        if magic != MAGIC:
            raise ValueError("not a token file")
        file.seek(self.table)
        self.starts = np.frombuffer(file.read(8 * blocks), "<u8")
        self.keys = np.frombuffer(file.read(8 * docs), "<i8")
        self.lengths = np.frombuffer(file.read(8 * docs), "<u8").astype(np.int64)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of the blocks from ``first`` up to ``last``, the latter not included."""
        begin = int(self.starts[first])
        end = int(self.starts[last]) if last < len(self.starts) else self.table
        self.file.seek(begin)
        data = self.file.read(end - begin)
        return np.concatenate([unpack_block(data, int(s) - begin) for s in self.starts[first:last]])

    def ids(self, start: int, length: int, block: int = BLOCK) -> np.ndarray:
        """Any run of ids, by the block starts."""
        if length <= 0:
            return np.zeros(0, np.uint32)
        first = start // block
        got = self.blocks(first, -(-(start + length) // block))
        return got[start - first * block :][:length]

    def documents(self, at_once: int = 64) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, start, ids) of every document in order, with few blocks held."""
        held, block, start = np.zeros(0, np.uint32), 0, 0
        for key, n in zip(self.keys.tolist(), self.lengths.tolist()):
            while len(held) < n:
                step = min(len(self.starts), block + at_once)
                held = np.concatenate([held, self.blocks(block, step)])
                block = step
            yield (None if key == NO_KEY else key), start, held[:n]
            held, start = held[n:], start + n


def written(vocabulary: str, folder: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker(("encoder", vocabulary), lambda: TextEncoder(vocabulary))
        end = end_id.to_bytes(4, "little")
        writer = stream = None
        first_key, docs = None, 0
        uri = f"{folder}/{uuid.uuid4().hex}.pfor"
        for part in slices_of_bytes(batches, 1):
            texts = [t or "" for t in part.column(1).to_pylist()]
            for key, ids in zip(part.column(0).to_pylist(), encoder.encode_all(texts)):
                if writer is None:
                    store, path = open_store(uri)
                    stream = store.open_output_stream(path)
                    writer, first_key = BlockWriter(stream), key
                writer.add(key, ids + end)
                docs += 1
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.record_batch({
                "path": pa.array([uri]), "first_key": pa.array([first_key], pa.int64()), "bytes": pa.array([writer.at], pa.int64()),
                "docs": pa.array([docs], pa.int64()), "tokens": pa.array([sum(writer.lengths)], pa.int64()),
            })

    return run


def write_token_files(docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text and write the ids in ascending key order; returns the manifest, one row per file.

    Documents are dealt by key range, so that a file is one range; nothing passes through the driver.
    """
    folder = folder or work_folder(docs.sparkSession, "tokens")
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("key").sortWithinPartitions(F.col("key").asc_nulls_first(), F.col("text").asc_nulls_first())
    files = ordered.mapInArrow(written(vocabulary, folder, end_id), "path string, first_key bigint, bytes bigint, docs bigint, tokens bigint")
    return materialize(files.repartition(1))  # a row per file


def read_back(with_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, begin in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "start"))):
                store, name = open_store(path)
                with store.open_input_file(name) as file:
                    rows: list[tuple] = []
                    for key, start, ids in BlockReader(file, size).documents():
                        rows.append((key, begin + start, len(ids), crc_of_ids(ids.astype("<u4").tobytes()), ids.tolist() if with_ids else None))
                        if len(rows) >= 512:
                            yield packed(rows, with_ids)
                            rows = []
                    if rows:
                        yield packed(rows, with_ids)

    return run


def packed(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    keys, starts, lengths, sums, ids = zip(*rows)
    columns = {"key": pa.array(keys, pa.int64()), "start": pa.array(starts, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())}
    return pa.record_batch(columns | ({"ids": pa.array(ids, pa.list_(pa.int64()))} if with_ids else {}))


def read_token_files(manifest: DataFrame, key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """(key, start, n_tokens, ids_crc32[, ids]) of every document in the files; ``start`` counts the ids of all documents before it."""
    order = Window.orderBy(F.col("first_key").asc_nulls_first(), "path").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(order), F.lit(0)))  # one row per file
    held = manifest.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    files = placed.select("path", "bytes", "start").repartition(max(1, -(-held // READ_BYTES)))
    schema = "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<bigint>" if with_ids else "")
    return files.mapInArrow(read_back(with_ids), schema).withColumnRenamed("key", key)
