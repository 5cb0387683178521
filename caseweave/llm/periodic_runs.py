"""Periodic runs of words in whole texts, by recompression.

A run is a stretch of words whose smallest period is q (words q apart are identical), at least max(LEAST, TIMES * q) words long, that no
neighbouring word extends.

Grammar: the texts of a slice become one string of word numbers, with a wall (a symbol of its own) before, between and after them. Recompression
alternates two steps until every text is one symbol: block compression writes a maximal block of one symbol as one symbol (the symbol and how
often), pair compression splits the symbols into left and right ones by a hash and writes every left-right pair as one symbol. The levels are a
run-length grammar. Equal stretches are compressed alike but for their ends, so how far two places agree is found by climbing the levels while their
symbols agree and descending where they differ; forwards and backwards, without suffix arrays.

Candidates: a run of period q has at least 3 q places in a row whose word returns q places later, so one of the places 0, 3 q, 6 q, ... is
among them. The places of all these grids whose word returns are extended both ways. A stretch found for several multiples of its
period is reported for the least, which is its smallest period because it is at least four times as long as any of them.

Edges: null and empty texts have no words and no runs, and collapse to the empty text. A text of any length is read whole, by one task; a slice
has about SLICE words, or one text if that is longer, and about 100 bytes of grammar a word. Repeated rows and keys stay apart, as do null keys. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blank_words, crc32_of, slices

#: A run has at least LEAST words and TIMES periods.
LEAST = 6
TIMES = 4
#: Words of texts that share a grammar.
SLICE = 1 << 17
MIX = 0x9E3779B97F4A7C15


class Level:
    """A string of the grammar and how it is written in the next one.

    ``first`` has, for each symbol of the next string, the place of the first symbol it stands for, and the length of this string at the
    end; ``parent`` the place in the next string of the symbol that stands for each of this one.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        self.symbols = symbols
        self.blocks = False
        self.first = self.parent = np.zeros(0, dtype=np.int32)

    def written(self, first: np.ndarray, blocks: bool) -> None:
        self.first = np.append(first, len(self.symbols)).astype(np.int32)
        self.parent = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(self.first))
        self.blocks = blocks


def block_step(level: Level, fresh: int) -> tuple[np.ndarray, int] | None:
    """The string with each block as one symbol and the next unused symbol; None if no symbol follows itself."""
    s = level.symbols
    first = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    if len(first) == len(s):
        return None
    level.written(first, True)
    length = np.diff(level.first)
    out, many = s[first], length > 1
    codes, names = pd.factorize(out[many].astype(np.int64) << 32 | length[many])
    out[many] = fresh + codes
    return out, fresh + len(names)


def pair_step(level: Level, fresh: int, seed: int) -> tuple[np.ndarray, int] | None:
    """The string with each left-right pair as one symbol; None if the sides of this seed pair nothing. Walls have no side."""
    s = level.symbols
    side = ((s.astype(np.uint64) + np.uint64(seed)) * np.uint64(MIX) >> np.uint64(40)).astype(np.int8) & 1
    side[s < 0] = 2
    rising, falling = (side[:-1] == 0) & (side[1:] == 1), (side[:-1] == 1) & (side[1:] == 0)
    pairs = np.flatnonzero(rising if np.count_nonzero(rising) >= np.count_nonzero(falling) else falling)
    if not len(pairs):
        return None
    starts = np.ones(len(s), dtype=bool)
    starts[pairs + 1] = False
    first = np.flatnonzero(starts)
    level.written(first, False)
    out = s[first]
    codes, names = pd.factorize(s[pairs].astype(np.int64) << 32 | s[pairs + 1])
    out[level.parent[pairs]] = fresh + codes
    return out, fresh + len(names)


def recompress(symbols: np.ndarray) -> list[Level]:
    """The levels of a string of non-negative symbols between walls (distinct negative ones), up to one symbol between any two walls."""
    levels, fresh, seed = [Level(symbols.astype(np.int32))], int(symbols.max(initial=0)) + 1, 0
    while True:
        s = levels[-1].symbols
        if not np.any((s[:-1] >= 0) & (s[1:] >= 0)):
            return levels
        step = block_step(levels[-1], fresh)
        if step is None:
            seed += 0x632BE59BD9B4E019
            step = pair_step(levels[-1], fresh, seed & (1 << 64) - 1)
        if step is not None:
            fresh = step[1]
            levels.append(Level(step[0]))


def agreement(levels: list[Level], a: np.ndarray, b: np.ndarray, forward: bool) -> np.ndarray:
    """How many symbols from places ``a`` and ``b`` on agree, forwards or backwards. The places of a pair differ, and a wall ends every text."""
    step = 1 if forward else -1
    x, y = a.astype(np.int64), b.astype(np.int64)
    stopped = np.zeros(len(x), dtype=np.int32)
    live = np.arange(len(x))
    for k, level in enumerate(levels):  # up, while the symbols agree
        if not len(live):
            break
        same = level.symbols[x[live]] == level.symbols[y[live]]
        stopped[live[~same]] = k
        live = live[same]
        if not len(live):
            break
        u, v = x[live], y[live]
        to_u, to_v = left_in(level, u, forward), left_in(level, v, forward)
        whole_u, whole_v = width(level, u) == to_u, width(level, v) == to_v
        moves = ~(whole_u & whole_v)
        ahead = np.minimum(to_u, to_v) if level.blocks else 1
        u, v = u + step * moves * ahead, v + step * moves * ahead
        ends = moves & (to_u != to_v) if level.blocks else np.zeros(len(u), dtype=bool)  # the shorter rest of a block ends the agreement
        x[live], y[live] = np.where(ends, u, level.parent[u]), np.where(ends, v, level.parent[v])
        stopped[live[ends]] = k
        live = live[~ends]
    for k in range(int(stopped.max(initial=0)) - 1, -1, -1):  # down to the words, where the symbols differ
        level = levels[k]
        at = np.flatnonzero(stopped > k)
        u, v = x[at], y[at]
        n_u, n_v = level.first[u + 1] - level.first[u], level.first[v + 1] - level.first[v]
        u, v = (level.first[u], level.first[v]) if forward else (level.first[u + 1] - 1, level.first[v + 1] - 1)
        same = level.symbols[u] == level.symbols[v]
        ahead = step * same * (np.minimum(n_u, n_v) if level.blocks else 1)
        x[at], y[at] = u + ahead, v + ahead
    return (x - a) * step


def width(level: Level, places: np.ndarray) -> np.ndarray:
    p = level.parent[places]
    return level.first[p + 1] - level.first[p]


def left_in(level: Level, places: np.ndarray, forward: bool) -> np.ndarray:
    """Symbols from a place to the end of what its parent stands for, itself included."""
    p = level.parent[places]
    return level.first[p + 1] - places if forward else places - level.first[p] + 1


def find_runs(symbols: np.ndarray, longest: int) -> np.ndarray:
    """(start, length, period) of all runs in texts of at most ``longest`` words, by start and period."""
    n = len(symbols)
    places, periods = [np.zeros(0, dtype=np.int64)], [0]
    for q in range(1, longest // TIMES + 1):
        grid = (TIMES - 1) * q
        found = np.flatnonzero(symbols[: n - q : grid] == symbols[q::grid])
        if len(found):
            places.append(found * grid)
            periods.append(q)
    q = np.repeat(np.array(periods, dtype=np.int64), [len(p) for p in places])
    i = np.concatenate(places)
    if not len(i):
        return np.zeros((0, 3), dtype=np.int64)
    levels = recompress(symbols)
    back = agreement(levels, i - 1, i + q - 1, False)
    start, length = i - back, agreement(levels, i, i + q, True) + back + q
    long = length >= np.maximum(LEAST, TIMES * q)
    rows = np.stack([start[long], length[long], q[long]], axis=1)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    least = np.ones(len(rows), dtype=bool)
    least[1:] = (rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1])
    rows = rows[least]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def judged(keys: list[pa.Array], texts: list[list[bytes]]) -> pa.RecordBatch:
    """The runs of some texts, which become one string."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    walls = np.append(0, np.cumsum(sizes + 1))
    ends = walls[1:]
    words = [w for t in texts for w in t]
    symbols = np.empty(int(walls[-1]) + 1, dtype=np.int64)
    inner = np.ones(len(symbols), dtype=bool)
    inner[walls] = False
    symbols[inner] = pd.factorize(np.array([*words, None], dtype=object)[:-1])[0] if words else []
    symbols[walls] = -1 - np.arange(len(walls))
    runs = find_runs(symbols, int(sizes.max(initial=0)))
    text_of = np.searchsorted(ends, runs[:, 0])
    marks = np.zeros(len(symbols) + 1, dtype=np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(marks) == 0
    collapsed = [
        b" ".join(t if (whole := kept[w + 1 : w + 1 + len(t)]).all() else compress(t, whole)) for t, w in zip(texts, walls[:-1].tolist())
    ]
    offsets = np.append(0, np.cumsum(np.bincount(text_of, minlength=len(texts))))
    columns = [runs[:, 0] - walls[text_of] - 1, runs[:, 1], runs[:, 2]]
    rows = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["start", "length", "period"])
    return pa.record_batch({
        "key": pa.concat_arrays(keys), "n_words": pa.array(sizes), "runs": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows),
        "collapsed": pa.array([c.decode("utf-8") for c in collapsed], pa.string()),
    })


def runs_of_batches(slice_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[pa.Array] = []
        texts: list[list[bytes]] = []
        size = 0
        for part in slices(batches):
            keys.append(part.column(0))
            for text in part.column(1).to_pylist():
                texts.append((text or "").encode("utf-8").split())  # of bytes: exactly at 20, 09-0D
                size += len(texts[-1])
            if size >= slice_words:
                yield judged(keys, texts)
                keys, texts, size = [], [], 0
        if texts:
            yield judged(keys, texts)

    return run


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", slice_words: int = SLICE) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row: runs of ``start``, ``length`` and ``period`` in words, and the text without the words that
    a run contains after its first period."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = rows.mapInArrow(
        runs_of_batches(slice_words), f"key {kind}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    )
    return found.withColumnRenamed("key", key)


def looped(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with the words of every tenth key, by the hash of the key, made periodic from some word on."""
    split = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), crc32_of(F.col(key)).alias("h"), F.when(crc32_of(F.col(key)) % 10 == 0, blank_words(F.col(text))).alias("w"))
    n, g = F.size("w").cast("bigint"), F.floor(F.col("h") / 10)
    a = g % n
    period = 1 + F.floor((n - a) / (3 + g % 8))
    part = lambda words, start, length: F.slice(words, (start + 1).cast("int"), length.cast("int"))
    again = F.flatten(F.array_repeat(part(F.col("w"), a, period), F.ceil((n - a) / period).cast("int")))
    made = F.array_join(part(F.concat(part(F.col("w"), F.lit(0), a), again), F.lit(0), n), " ")
    return split.select(F.col("key").alias(key), F.when((F.col("h") % 10 == 0) & (n > 0), made).otherwise(F.col("text")).alias(text))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The count, the longest run and the digests of what ``periodic_runs`` found."""
    runs = F.col("runs")
    best: Column = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    return found.select(key, F.size(runs).cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")).select(
        key, "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )
