"""Passages that repeat, within a text or across texts, by super-k-mer partitioning.

A window is ``width`` consecutive words of one text. Every word is marked that is covered by a window whose word sequence also starts
anywhere else.

Super-k-mers: the minimiser of a window is the least hash of its stretches of STRETCH words, in its first place. Consecutive windows of one minimiser
in one place (SPAN of them at most) are one super-k-mer and travel as one packed string, their words joined by one space, to the bucket of the
minimiser's hash. Equal windows have equal minimisers in equal places, so they are in different super-k-mers and meet in a bucket, where the windows are ranked by sorting words, then pairs of ranks, then pairs of those, up to the whole
width; windows of one rank are equal word by word, which no hash decides. A bucket reports the packed strings with a repeated window.

Three passes read the texts: the first counts super-k-mers by minimiser. The second sends the packed strings; equal ones of a task are sent once
with their number. Where a minimiser was met once, its windows are unique, so nothing is sent. A minimiser that holds more than HOT_ROWS super-k-mers
and more than 1 / HOT_KEYS of all (so there are at most HOT_KEYS) is split: its windows travel one by one, each to the bucket of the hash of all its
words. The last joins the reports with the texts' super-k-mers by a 128-bit digest, and each text with what was reported of it. Minimisers
met before are kept as a table of FILTER_BITS bits in the shared folder; if it fills up, more strings travel than need to, which changes no result.

Edges: null and empty texts and those of fewer words than a window have nothing marked. A text is read whole by one task, whatever its
length. Repeated rows count as repeats and stay rows; the key may be null or repeated, as texts are found again by their digest. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import blake2b, md5
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker, open_store, slices, stored, work_folder

#: Words of the stretches whose least hash is a window's minimiser.
STRETCH = 5
#: Windows of a super-k-mer at most.
SPAN = 31
HOT_ROWS = 4000
HOT_KEYS = 1_000_000
FILTER_BITS = 1 << 27
#: Bytes of packed strings that a task holds before it sends them, and words that a bucket task sorts at a time.
HELD_BYTES = 16 << 20
SORTED_WORDS = 1 << 18
#: Rows of a small table that a document is reckoned to give, which decides over how many files a table has.
ROWS_EACH = 6
SEED = 12
MIX = np.uint64(0x9E3779B97F4A7C15)


def stretch_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the ``n`` words from each place on; only places with so many words after them are there."""
    out, done = words[: len(words) if len(words) >= n else 0], 1
    while done < n and len(out):
        step = min(done, n - done)
        out, done = out[: len(out) - step] * MIX + out[step:], done + step
        out = out ^ out >> np.uint64(29)
    return out * MIX ^ out >> np.uint64(32)


def least_of(values: np.ndarray, n: int) -> np.ndarray:
    """The least of the ``n`` values from each place on."""
    out, done = values[: len(values) if len(values) >= n else 0], 1
    while done < n and len(out):
        step = min(done, n - done)
        out, done = np.minimum(out[: len(out) - step], out[step:]), done + step
    return out


class Cut:
    """The super-k-mers of some texts: ``text``, ``start`` (word), ``windows`` and ``minimiser`` of each, in order."""

    def __init__(self, texts: list[list[bytes]], width: int) -> None:
        from xxhash import xxh64_intdigest

        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.begins = np.append(0, np.cumsum(sizes))
        words = [w for t in texts for w in t]
        codes, distinct = pd.factorize(np.array([*words, None], dtype=object)[:-1]) if words else (np.zeros(0, dtype=np.int64), [])
        self.hashes = np.fromiter(map(xxh64_intdigest, distinct, repeat(SEED)), dtype=np.uint64, count=len(distinct))[codes]
        stretch = min(STRETCH, width)
        found = stretch_hashes(self.hashes, stretch)
        low = np.uint64((1 << len(words).bit_length()) - 1)  # of equal hashes the first place counts
        least = least_of(found & ~low | np.arange(len(found), dtype=np.uint64), width - stretch + 1) & low
        counts = np.maximum(sizes - width + 1, 0)
        self.first = np.append(0, np.cumsum(counts))  # windows are numbered through
        shift = np.repeat(self.begins[:-1] - self.first[:-1], counts)
        least = least[np.arange(len(shift)) + shift]
        new = np.append(True, least[1:] != least[:-1])[: len(least)]
        new[self.first[:-1][counts > 0]] = True
        runs = np.flatnonzero(new)
        pieces = -(-np.diff(np.append(runs, len(least))) // SPAN)
        offset = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.repeat(runs, pieces) + offset * SPAN
        self.windows = np.diff(np.append(begin, len(least)))
        self.minimiser = found[least[begin].astype(np.int64)].view(np.int64)
        self.text = np.searchsorted(self.first, begin, side="right") - 1
        self.start = begin - self.first[self.text]


def tokenised(column: pa.Array) -> list[list[bytes]]:
    return [(t or b"").split() for t in column.cast(pa.binary()).to_pylist()]  # of bytes: exactly at 20, 09-0D


def counted(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            minimisers, n = np.unique(Cut(tokenised(part.column(0)), width).minimiser, return_counts=True)
            yield pa.record_batch({"minimiser": minimisers, "n": n})

    return run


class Filter:
    """Which minimisers were met more than once (a table of bits, some of them shared), and which of them are hot."""

    def __init__(self, bits_at: str, hot_at: str, bits: int) -> None:
        rows = read_table(bits_at)
        self.table = np.zeros(bits // 64, dtype=np.uint64)
        self.table[rows["word"].to_numpy()] = rows["mask"].to_numpy().view(np.uint64)
        self.hot = np.sort(read_table(hot_at)["minimiser"].to_numpy())
        self.bits = bits

    def has(self, minimisers: np.ndarray) -> np.ndarray:
        place = minimisers.view(np.uint64) % np.uint64(self.bits)
        return self.table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1) == 1

    def is_hot(self, minimisers: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hot, minimisers)
        return np.append(self.hot, 0)[at] == minimisers if len(self.hot) else np.zeros(len(minimisers), dtype=bool)


def filter_at(where: tuple[str, str, int]) -> Filter:
    """The filter of these files; a worker keeps the last one."""
    kept = kept_in_worker("minimisers met", dict)
    if where not in kept:
        kept.clear()
        kept[where] = Filter(*where)
    return kept[where]


def read_table(uri: str) -> pa.Table:
    store, path = open_store(uri)
    return pyarrow.parquet.read_table(path, filesystem=store)


def packed_rows(texts: list[list[bytes]], width: int, known: Filter) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(text, start, windows, bucket, packed string) of all super-k-mers that may repeat; those of hot minimisers window by window."""
    cut = Cut(texts, width)
    may = np.flatnonzero(known.has(cut.minimiser))
    hot = known.is_hot(cut.minimiser[may])
    whole = stretch_hashes(cut.hashes, width).view(np.int64) if hot.any() else None
    columns = (cut.text[may].tolist(), cut.start[may].tolist(), cut.windows[may].tolist(), cut.minimiser[may].tolist(), hot.tolist())
    for text, start, windows, minimiser, split in zip(*columns):
        words = texts[text]
        if not split:
            yield text, start, windows, minimiser, b" ".join(words[start : start + windows + width - 1])
            continue
        at = int(cut.begins[text])
        for s, bucket in enumerate(whole[at + start : at + start + windows].tolist(), start):
            yield text, s, 1, bucket, b" ".join(words[s : s + width])


def sent(width: int, where: tuple) -> Callable:
    """Packed strings with their bucket and number; equal ones that are held together are one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = filter_at(where)
        held: dict[tuple[int, bytes], int] = {}
        size = 0
        for part in slices(batches, 256):
            for _, _, _, bucket, packed in packed_rows(tokenised(part.column(0)), width, known):
                n = held.get((bucket, packed), 0)
                held[bucket, packed] = n + 1
                size += 0 if n else len(packed) + 200
            if size > HELD_BYTES:
                yield from as_rows(held)
                held, size = {}, 0
        yield from as_rows(held)

    def as_rows(held: dict[tuple[int, bytes], int]) -> Iterator[pa.RecordBatch]:
        keys = list(held)
        yield pa.record_batch({
            "bucket": pa.array([b for b, _ in keys], pa.int64()), "packed": pa.array([p for _, p in keys], pa.binary()), "n": pa.array(list(held.values()), pa.int64()),
        })

    return run


def ranks(words: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the stretches of ``width`` words from each place on: equal stretches, and only those, have equal numbers."""
    rank, done = words, 1
    while done < width:
        step = min(done, width - done)
        rank = np.unique(rank[: len(rank) - step].astype(np.int64) << 32 | rank[step:], return_inverse=True)[1]
        done += step
    return rank


def repeats(packed: list[bytes], n: np.ndarray, width: int) -> np.ndarray:
    """For each packed string, the bits of its windows that occur again among all the strings, each of which counts ``n`` times."""
    texts = [p.split(b" ") for p in packed]
    sizes = np.array([len(t) for t in texts])
    words = pd.factorize(np.array([w for t in texts for w in t] + [None], dtype=object)[:-1])[0]
    windows = sizes - width + 1
    row = np.repeat(np.arange(len(packed)), windows)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    rank = ranks(words, width)[(np.cumsum(sizes) - sizes)[row] + offset]
    again = np.bincount(rank, weights=n[row])[rank] > 1
    bits = np.zeros(len(packed), dtype=np.int64)
    np.bitwise_or.at(bits, row[again], np.int64(1) << offset[again])
    return bits


def digest(packed: bytes) -> bytes:
    return blake2b(packed, digest_size=16).digest()


def sorted_buckets(width: int) -> Callable:
    """Rows come sorted by bucket; whole buckets are judged together, many small ones at a time. Equal strings, which several tasks may send, are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, counts, size = None, {}, 0
        for batch in batches:
            for bucket, string, count in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != last and size > SORTED_WORDS:
                    yield judged(counts)
                    counts, size = {}, 0
                last = bucket
                n = counts.get(string, 0)
                counts[string] = n + count
                size += 0 if n else string.count(b" ") + 1
        if counts:
            yield judged(counts)

    def judged(counts: dict[bytes, int]) -> pa.RecordBatch:
        packed = list(counts)
        bits = repeats(packed, np.fromiter(counts.values(), dtype=np.int64, count=len(packed)), width)
        found = np.flatnonzero(bits)
        return pa.record_batch({"digest": pa.array([digest(packed[i]) for i in found.tolist()], pa.binary()), "windows": bits[found]})

    return run


def places(width: int, where: tuple) -> Callable:
    """(text's digest, start, string's digest) of the super-k-mers that may repeat; of equal texts that a task has met lately, the first gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = filter_at(where)
        met: set[bytes] = set()
        for part in slices(batches, 256):
            met = met if len(met) < 100_000 else set()
            ids = [md5(t or b"").digest() for t in part.column(0).cast(pa.binary()).to_pylist()]
            fresh = [i for i, d in enumerate(ids) if d not in met and not met.add(d)]
            texts = tokenised(part.column(0).take(pa.array(fresh, pa.int64())))
            rows = [(ids[fresh[text]], start, digest(packed)) for text, start, _, _, packed in packed_rows(texts, width, known)]
            yield pa.record_batch({
                "text_digest": pa.array([r[0] for r in rows], pa.binary()), "start": pa.array([r[1] for r in rows], pa.int64()), "digest": pa.array([r[2] for r in rows], pa.binary()),
            })

    return run


FOUND = "array<struct<start: bigint, windows: bigint>>"


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, start, windows) come sorted; one row per text with what stands in it, however often a copy of the text reported it."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("windows", pa.int64())]))
    text, found = None, []
    for batch in batches:
        texts, lists = [], []
        for name, start, windows in zip(*(c.to_pylist() for c in batch.columns)):
            if name != text:
                if found:
                    texts.append(text)
                    lists.append(found)
                text, found = name, []
            if not found or found[-1]["start"] != start:
                found.append({"start": start, "windows": windows})
        yield pa.record_batch({"text_digest": pa.array(texts, pa.binary()), "found": pa.array(lists, kind)})
    if found:
        yield pa.record_batch({"text_digest": pa.array([text], pa.binary()), "found": pa.array([found], kind)})


def marked_spans(found: list[dict], width: int) -> list[dict]:
    """The spans that repeated windows cover together, in order; ``found`` has the bits of windows from a start on."""
    starts = np.sort(np.concatenate([np.flatnonzero(place["windows"] >> np.arange(SPAN) & 1) + place["start"] for place in found]))
    apart = np.flatnonzero(np.diff(starts) > width)
    first, last = np.append(starts[0], starts[apart + 1]), np.append(starts[apart], starts[-1])
    return [{"start": a, "end": b + width} for a, b in zip(first.tolist(), last.tolist())]


def removed(width: int) -> Callable:
    """Spans of marked words and the text without them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 256):
            texts, spans, kept = tokenised(part.column(1)), [], []
            for words, found in zip(texts, part.column(2).to_pylist()):
                spans.append(marked_spans(found, width) if found else [])
                at = 0
                rest = []
                for span in spans[-1]:
                    rest += words[at : span["start"]]
                    at = span["end"]
                kept.append(b" ".join(rest + words[at:] if at else words).decode("utf-8"))
            yield pa.record_batch({
                "key": part.column(0), "n_words": pa.array([len(t) for t in texts], pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "kept": pa.array(kept, pa.string()),
            })

    return run


def filter_files(seen: DataFrame, bits: int, hot_rows: int) -> tuple[str, str, int]:
    """Folders with the bits of the minimisers ``seen`` and with the hot ones of them, and the number of bits (a power of two)."""
    place = F.pmod(F.col("minimiser"), F.lit(bits))
    mask = F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(minimiser, {bits}) & 63 as int))"))
    share = F.greatest(F.lit(hot_rows), seen.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar() / HOT_KEYS)
    folder = work_folder(seen.sparkSession, "minimisers")
    seen.groupBy(F.shiftright(place, 6).alias("word")).agg(mask.alias("mask")).coalesce(8).write.parquet(f"{folder}/bits")
    seen.where(F.col("n") > share).select("minimiser").coalesce(1).write.parquet(f"{folder}/hot")
    return f"{folder}/bits", f"{folder}/hot", bits


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 35, hot_rows: int = HOT_ROWS, bits: int = FILTER_BITS) -> DataFrame:
    """(key, n_words, spans, kept) of every row: the spans of marked words (``start`` to before ``end``) and the text without them."""
    kind = docs.schema[key].dataType.simpleString()
    texts = docs.select(F.col(text).alias("text"))
    rows = ROWS_EACH * docs.count()
    seen = stored(texts.mapInArrow(counted(width), "minimiser bigint, n bigint").groupBy("minimiser").agg(F.sum("n").alias("n")).where("n > 1"), rows)
    where = filter_files(seen, bits, hot_rows)
    strings = texts.mapInArrow(sent(width, where), "bucket bigint, packed binary, n bigint")
    buckets = strings.repartition("bucket").sortWithinPartitions("bucket")
    found = stored(buckets.mapInArrow(sorted_buckets(width), "digest binary, windows bigint"), rows)
    at = texts.mapInArrow(places(width, where), "text_digest binary, start bigint, digest binary")
    by_text = at.join(found, "digest").select("text_digest", "start", "windows").repartition("text_digest").sortWithinPartitions("text_digest", "start")
    marked = stored(by_text.mapInArrow(gathered, f"text_digest binary, found {FOUND}"), rows)
    named = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))).alias("text_digest"))
    joined = named.join(marked, "text_digest", "left").select("key", "text", "found")
    out = joined.mapInArrow(removed(width), f"key {kind}, n_words bigint, spans array<struct<start: bigint, end: bigint>>, kept string")
    return out.withColumnRenamed("key", key)
