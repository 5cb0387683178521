"""Best-fit packing of documents into sequences of a fixed number of tokens.

Bounded-space online best-fit: each task keeps at most ``open_bins`` bins. A bitset has bit f set while some open bin has f free
tokens; the best bin for a piece of n tokens is found from the lowest set bit at or above n. When a new bin would exceed the
bound, the fullest open bin closes, found from the lowest set bit of all.

Pieces are dealt by hash into blocks of about ``block_pieces``, so that the number of blocks grows with the input, and come to a task in the order of
another hash, the same on every attempt. The task looks at ``lookahead`` pieces at a time and places the longest of them first, ties in their
order of arrival; it never holds more than these and its bins. A block wastes about one sequence.

Edges: a null or empty text is the end id alone. Longer documents are cut into whole sequences and a last piece; nothing else is
cut. Repeated rows are packed each. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_ids, kept_in_worker, materialize, slices, slices_of_bytes
from .encode import TextEncoder

CAPACITY = 2048
OPEN_BINS = 512
LOOKAHEAD = 1024
BLOCK_PIECES = 20_000


class BestFit:
    """Places lengths one after the other; at most ``open_bins`` bins are open."""

    def __init__(self, capacity: int, open_bins: int) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.bits = 0  # bit f: some open bin has f free tokens
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = 0
        self.n_bins = 0

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) of a piece of 1 to ``capacity`` tokens."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            chosen = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, chosen = self.capacity, self.n_bins
            self.n_bins += 1
        left = free - length
        if left:
            self.by_free[left].append(chosen)
            self.bits |= 1 << left
            self.n_open += 1
        return chosen, self.capacity - free

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        chosen = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return chosen


def cut_pieces(vocabulary: str, capacity: int, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker(("encoder", vocabulary), lambda: TextEncoder(vocabulary))
        end = end_id.to_bytes(4, "little")
        for part in slices_of_bytes(batches, 1):
            keys, pieces, starts, lengths, sums = [], [], [], [], []
            texts = [t or "" for t in part.column(1).to_pylist()]
            for key, ids in zip(part.column(0).to_pylist(), encoder.encode_all(texts)):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    keys.append(key)
                    pieces.append(piece)
                    starts.append(at // 4)
                    lengths.append(len(cut) // 4)
                    sums.append(crc_of_ids(cut))
            yield pa.record_batch({
                "key": pa.array(keys, part.schema.field(0).type), "piece": pa.array(pieces, pa.int32()), "start": pa.array(starts, pa.int64()),
                "length": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(sums, pa.int64()),
            })

    return run


def packed(capacity: int, open_bins: int, lookahead: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 33
        bins = BestFit(capacity, open_bins)
        for part in slices(batches, lookahead):
            lengths = part.column(3).to_numpy()
            places = np.empty((part.num_rows, 2), dtype=np.int64)
            for i in np.argsort(-lengths, kind="stable").tolist():
                places[i] = bins.place(int(lengths[i]))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(places[:, 0] + first), pa.array(places[:, 1])], names=[*part.schema.names, "sequence_id", "offset"],
            )

    return run


def document_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32): every document with its end id in pieces of at most ``capacity`` tokens."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(cut_pieces(vocabulary, capacity, end_id), f"key {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, block_pieces: int = BLOCK_PIECES, lookahead: int = LOOKAHEAD) -> DataFrame:
    """Adds (sequence_id, offset) to (key, piece, start, length, ids_crc32); ``pieces`` should be materialized, for it is read twice."""
    blocks = max(1, -(-pieces.count() // block_pieces))
    dealt = pieces.repartition(blocks, F.xxhash64("key", "piece", "ids_crc32", F.lit(7)))
    ordered = dealt.sortWithinPartitions(F.xxhash64("key", "piece", "ids_crc32", F.lit(11)), "key", "piece", "ids_crc32")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ordered.mapInArrow(packed(capacity, open_bins, lookahead), f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    pieces = materialize(document_pieces(docs, vocabulary, capacity, end_id, key, text))
    return pack_pieces(pieces, capacity, open_bins).withColumnRenamed("key", key)
