"""Similar-method matching: TF-IDF cosine within a block, and tag overlap."""

from __future__ import annotations

import io
import math
import re
import sys
from collections.abc import Callable, Iterator, Sequence
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import jaccard
from ..functions.texts import joined_text, words
from .checks import InputError, block_column, id_column, require_all
from .scale import dense_index, materialize, scalar_of, skew_safe_join

# The tile comparison travels to the executors by value; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TILE_ROWS = 512  # profiles that are compared with a panel at once
TILE_WORDS = 4096  # words of the dense product of two panels
DENSE_CELLS = 8_000_000  # cells of a panel in that product
DENSE_SHARE = 0.05  # share of profiles from which on a word belongs in it
OUTER_CELLS = 100  # products of a word that are added by themselves
PANEL_TERMS = 2_000_000  # terms of a panel; a profile counts for PROFILE_TERMS at least
PROFILE_TERMS = 256
PANELS = 12  # panels of fewer terms than that many full ones
LEAST_PANEL = 100_000
CODED_TERMS = 1_000_000  # terms that are looked up at once
PANEL_GROUP = 4  # panels on a side of what a task compares, at most
COMMON_WORDS = 50_000  # bounds the words whose weights are broadcast

# Fixed: text columns in the order in which they are joined.
TEXT_COLUMNS = (
    "mo_text", "description", "narrative", "modus_operandi", "weapon_used",
    "entry_method", "target_type", "vehicle_used", "offender_description",
)
SCANNED = 2048  # columns that are scanned at once
SCORE_DIGITS = 9  # scores are rounded to this before ranking, so that float noise cannot order ties
POINTS = 10**SCORE_DIGITS


def documents(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(block, doc, text) from whichever text columns are present."""
    present = [c for c in TEXT_COLUMNS if c in df.columns]
    if not present:
        raise InputError(f"none of the text columns {TEXT_COLUMNS} is present")
    return df.select(
        block_column(df).alias("block"), id_column(df, keys).alias("doc"), joined_text([F.col(c) for c in present]).alias("text")
    )


def word_profiles(docs: DataFrame) -> DataFrame:
    """Each document with its sorted words and a key shared by documents of equal word counts."""
    return docs.withColumn("ws", F.array_sort(words(F.col("text")))).withColumn(
        "key", F.sha2(F.concat_ws(" ", "ws"), 256)
    )


def _counted_words(ws: str) -> Column:
    """(token, tf) per distinct word of a sorted array, by the places at which its words change."""
    last = F.size(ws) - 1
    changes = F.filter(F.sequence(F.lit(0), last), lambda i: (i == 0) | (F.get(ws, i) != F.get(ws, i - 1)))
    ends = F.concat(F.slice(changes, 2, F.greatest(F.size(changes), F.lit(1))), F.array(F.size(ws)))
    pairs = F.arrays_zip(changes.alias("at"), ends.alias("end"))
    counted = F.transform(pairs, lambda x: F.struct(F.get(ws, x["at"]).alias("token"), (x["end"] - x["at"]).cast("bigint").alias("tf")))
    return F.when(F.size(ws) > 0, counted).otherwise(F.array().cast("array<struct<token:string,tf:bigint>>"))


def _token_weights(counts: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(block, token, df, idf): of the words that many rows of ``counts`` hold, and of the rest, if any.

    ``counts`` are (block, terms, mult), ``sizes`` (block, n). A word is frequent if it stands in a COMMON_WORDS-th of all rows, so there are at most so many.
    """
    rows = counts.select("block", "mult", F.explode("terms.token").alias("token"))
    frequency = materialize(rows.groupBy("block", "token").agg(F.sum("mult").alias("df"), F.count(F.lit(1)).alias("_rows")).join(sizes, "block"))
    idf = F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0
    weights = frequency.withColumn("_frequent", F.col("_rows") >= scalar_of(frequency, F.sum("_rows")) / COMMON_WORDS)
    columns = ["block", "token", "df", idf.alias("idf")]
    rare = weights.where("not _frequent").select(*columns)
    return weights.where("_frequent").select(*columns), None if rare.isEmpty() else rare


def _weighted(terms: DataFrame, weights: tuple[DataFrame, DataFrame | None]) -> DataFrame:
    """Rows with ``block`` and ``token``, with df and idf. The frequent words are broadcast, so no key of the other join is hot."""
    frequent, rare = weights
    if rare is None:
        return terms.join(F.broadcast(frequent), ["block", "token"])
    met = terms.join(F.broadcast(frequent), ["block", "token"], "left")
    return met.where("idf is not null").unionByName(met.where("idf is null").drop("df", "idf").join(rare, ["block", "token"]))


def _unit_weights(counts: DataFrame, sizes: DataFrame, key: str) -> DataFrame:
    """The rows of ``counts`` (block, ``key``, terms, mult and more), one per term, with token, tf, df and w of unit length per ``key``."""
    weights = _token_weights(counts, sizes)
    raw = _weighted(counts.select("block", key, F.explode("terms").alias("t")).select("block", key, "t.token", "t.tf"), weights)
    lengths = raw.groupBy("block", key).agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.col("idf"), F.lit(2.0)))).alias("_length"))
    measured = counts.join(materialize(lengths), ["block", key])
    others = [c for c in counts.columns if c != "terms"]
    every = measured.select(*others, "_length", F.explode("terms").alias("t")).select(*others, "_length", "t.token", "t.tf")
    return _weighted(every, weights).withColumn("w", F.col("tf") * F.col("idf") / F.col("_length")).drop("_length", "idf")


def tfidf_weights(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Long sparse matrix (block, doc, token, weight). Blocks of one document yield nothing.

    Each document is weighed by itself under a number of its own, so its words are stored once and no list of words is shuffled as rows
    but for words that are rare.
    """
    docs = documents(df, keys).select("block", "doc", F.array_sort(words(F.col("text"))).alias("ws"))
    counts = materialize(docs.select("block", "doc", F.lit(1).cast("bigint").alias("mult"), _counted_words("ws").alias("terms"), F.monotonically_increasing_id().alias("row")))
    sizes = materialize(counts.groupBy("block").agg(F.count(F.lit(1)).alias("n")))
    worded = counts.where(F.size("terms") > 0).join(sizes.where("n > 1").select("block"), "block", "left_semi")
    return _unit_weights(worded, sizes, "row").select("block", "doc", "token", F.col("w").alias("weight"))


def ordered_vectors(terms: DataFrame, limit: float) -> DataFrame:
    """One row per profile: words rarest first, their weights, and the prefix that matters.

    The prefix ends once the rest of the vector is shorter than ``limit``: two vectors that share
    only words of their rests cannot reach it. ``tail`` is the length from a word to the end.
    """
    vectors = terms.groupBy("block", "key").agg(F.array_sort(F.collect_list(F.struct("word", "w"))).alias("v"))
    # Lengths from the end: running sums over the reversed squares, reversed again.
    squares = F.reverse(F.transform("v", lambda x: x["w"] * x["w"]))
    start = F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("out"))
    running = F.aggregate(
        squares,
        start,
        lambda acc, q: F.struct((acc["s"] + q).alias("s"), F.concat(acc["out"], F.array(F.sqrt(acc["s"] + q))).alias("out")),
        lambda acc: F.reverse(acc["out"]),
    )
    zipped = F.arrays_zip(F.transform("v", lambda x: x["word"]).alias("word"), F.col("tails").alias("tail"))
    return vectors.withColumn("tails", running).select(
        "block",
        "key",
        F.transform("v", lambda x: x["word"]).alias("words"),
        F.transform("v", lambda x: x["w"]).alias("weights"),
        F.filter(zipped, lambda x: x["tail"] >= limit).alias("prefix"),
    )


def _numbered_words(counted: DataFrame) -> DataFrame:
    """(block, token, word, idf): the words of blocks of several rows, numbered over all blocks, so that rows of different blocks share none."""
    sizes = counted.groupBy("block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = counted.select("block", F.explode("terms.token").alias("token"))
    idf = F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0
    vocabulary = rows.groupBy("block", "token").agg(F.count(F.lit(1)).alias("df")).join(sizes, "block").select("block", "token", idf.alias("idf"))
    return materialize(dense_index(vocabulary, ["block", "token"], "word"))


def _read(uri: str, columns: list[str]) -> pa.Table:
    """Columns of a file in the shared folder, as Spark names it."""
    uri = unquote(uri)
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    store, path = pyarrow.fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")
    with store.open_input_file(path) as file:
        return pq.ParquetFile(file).read(columns)


def _packed(**arrays: np.ndarray) -> bytes:
    held = io.BytesIO()
    np.savez(held, **arrays)
    raw = held.getvalue()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    with np.load(io.BytesIO(raw)) as found:
        return {n: found[n] for n in found.files}


def _runs(sizes: np.ndarray) -> np.ndarray:
    """0, 1, 2, ... for each of several runs."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _terms_of(rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of the terms of some rows of a table whose rows have ``sizes`` terms."""
    return np.repeat((np.cumsum(sizes) - sizes)[rows], sizes[rows]) + _runs(sizes[rows])


def _coder(vocabulary: list[str]) -> Callable:
    """For batches (slot, block, key, tokens, tfs) of rows with words: (slot, part), the rows of a slot packed with their words as numbers.

    Each lot of CODED_TERMS terms goes once through the files of the ``vocabulary``, of which a task holds one at a time.
    """

    def coded(table: pa.Table) -> Iterator[tuple[int, bytes]]:
        sizes = pc.list_value_length(table["tokens"]).to_numpy().astype(np.int64)
        tokens, tfs = [pc.list_flatten(table[c].combine_chunks()) for c in ("tokens", "tfs")]
        tfs = tfs.to_numpy().astype(np.int32)
        names = table["block"].to_pylist()
        numbers = {name: i for i, name in enumerate(dict.fromkeys(names))}
        owner = np.repeat(np.array([numbers[n] for n in names], np.int32), sizes)
        places, distinct, which = {}, {}, {}
        for name, i in numbers.items():
            places[name] = np.flatnonzero(owner == i)
            met = pc.dictionary_encode(tokens.take(pa.array(places[name])))
            distinct[name], which[name] = met.dictionary, met.indices.to_numpy()
        del tokens, owner
        found = {name: (np.zeros(len(x), np.int64), np.zeros(len(x))) for name, x in distinct.items()}
        for file in vocabulary:
            known = _read(file, ["block", "token", "word", "idf"])
            for name in pc.unique(known["block"]).to_pylist():
                if name in found:
                    at = pc.index_in(known["token"], value_set=distinct[name])
                    hit = pc.and_(at.is_valid(), pc.equal(known["block"], name))
                    at = at.filter(hit).to_numpy()
                    for values, column in zip(found[name], ("word", "idf")):
                        values[at] = known[column].filter(hit).to_numpy()
        words, idfs = np.zeros(len(tfs), np.int64), np.zeros(len(tfs))
        for name, at in places.items():
            words[at], idfs[at] = found[name][0][which[name]], found[name][1][which[name]]
        rows = np.repeat(np.arange(len(sizes)), sizes)
        lengths = np.sqrt(np.bincount(rows, (tfs * idfs) ** 2, minlength=len(sizes)))
        order = np.lexsort((words, rows))
        words, idfs, tfs = words[order], idfs[order], tfs[order]
        keys, slots = np.array(table["key"].to_pylist(), dtype="S64"), table["slot"].to_numpy()
        for slot in np.unique(slots):
            some = np.flatnonzero((slots == slot) & (lengths > 0))  # the words of a block of one row are not in the vocabulary
            at = _terms_of(some, sizes)
            word, first, places_ = np.unique(words[at], return_index=True, return_inverse=True)
            yield int(slot), _packed(keys=keys[some], lengths=lengths[some], sizes=sizes[some], places=np.diff(places_, prepend=0).astype(np.int32), tfs=tfs[at], word=word, idf=idfs[at][first])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()  # equal profiles leave a task once
        held: list[pa.RecordBatch] = []

        def lot() -> pa.RecordBatch:
            made = list(coded(pa.Table.from_batches(held))) if sum(x.num_rows for x in held) else []
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in made], pa.int32()), pa.array([x[1] for x in made], pa.binary())], names=["slot", "part"])

        terms = 0
        for batch in batches:
            sizes = pc.list_value_length(batch.column("tokens")).to_numpy()
            fresh: list[int] = []
            for i, key in enumerate(batch.column("key").to_pylist()):
                if key not in seen:
                    seen.add(key)
                    fresh.append(i)
                    terms += int(sizes[i])
                if terms >= CODED_TERMS:
                    held.append(batch.take(pa.array(fresh, pa.int64())))
                    fresh, terms = [], 0
                    yield lot()
            held.append(batch.take(pa.array(fresh, pa.int64())))
        yield lot()

    return code


def _panel(table: pa.Table) -> pa.Table:
    """(slot, panel) from a slot's parts and from rows (keys, pids): each profile once, under its number."""
    parts = [_unpacked(x) for x in table["part"].drop_null().to_pylist()]
    keys, pids = [np.array(pc.list_flatten(table[c].combine_chunks()).to_pylist(), dtype=kind) for c, kind in (("keys", "S64"), ("pids", np.int64))]
    order = np.argsort(keys)
    keys, pids = keys[order], pids[order]
    word, first = np.unique(np.concatenate([p["word"] for p in parts]), return_index=True)
    idf = np.concatenate([p["idf"] for p in parts])[first]
    _, once = np.unique(np.concatenate([p["keys"] for p in parts]), return_index=True)
    sizes = np.concatenate([p["sizes"] for p in parts])
    places = np.concatenate([np.searchsorted(word, p["word"])[np.cumsum(p["places"], dtype=np.int64)] for p in parts])
    at = _terms_of(once, sizes)
    found = {
        "pids": pids[np.searchsorted(keys, np.concatenate([p["keys"] for p in parts])[once])], "lengths": np.concatenate([p["lengths"] for p in parts])[once],
        "sizes": sizes[once], "places": np.diff(places[at], prepend=0).astype(np.int32), "tfs": np.concatenate([p["tfs"] for p in parts])[at], "word": word, "idf": idf,
    }
    return pa.table({"slot": pa.array([table["slot"][0].as_py()], pa.int32()), "panel": pa.array([_packed(**found)], pa.binary())})


def _vectors(panel: bytes) -> dict:
    """Unit vectors of a panel as terms (row, place of the word in ``word``, w)."""
    x = _unpacked(panel)
    rows = np.repeat(np.arange(len(x["pids"]), dtype=np.int32), x["sizes"])
    places = np.cumsum(x["places"], dtype=np.int32)
    return {"pids": x["pids"], "word": x["word"], "rows": rows, "places": places, "w": x["tfs"] * x["idf"][places] / x["lengths"][rows]}


def _best(rows: np.ndarray, others: np.ndarray, scores: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The ``keep`` best others of each row, ties to the lower, and the rank of each."""
    order = np.lexsort((others, -scores, rows))
    rows, others, scores = rows[order], others[order], scores[order]
    starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    rank = _runs(np.diff(np.append(starts, len(rows))))
    good = rank < keep
    return rows[good], others[good], scores[good], rank[good]


class _Top:
    """The best others of the rows of a panel so far, and what a score must reach to be among them."""

    def __init__(self, rows: int, threshold: float, keep: int) -> None:
        self.cut, self.threshold, self.keep = np.full(rows, threshold), threshold, keep
        self.held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def add(self, rows: np.ndarray, others: np.ndarray, scores: np.ndarray) -> None:
        scores = np.round(np.clip(scores, 0.0, 1.0), SCORE_DIGITS)
        good = scores >= self.threshold
        if not good.any():
            return
        new = rows[good], others[good], scores[good]
        *held, rank = _best(*[np.concatenate(pair) for pair in zip(self.held, new)], self.keep)
        self.held = tuple(held)
        last = rank == self.keep - 1
        self.cut[held[0][last]] = held[2][last]


def _compare(x: dict, y: dict, threshold: float, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(pid, other, score): the best of ``y`` for each row of ``x``, and, if they are two panels, the reverse.

    Words that many profiles hold are multiplied as dense matrices. A rarer word adds the products of its weights to the cells of its profiles.
    """
    nx, ny = len(x["pids"]), len(y["pids"])
    shared, ix, iy = np.intersect1d(x["word"], y["word"], assume_unique=True, return_indices=True)
    sides = []
    for side, at in ((x, ix), (y, iy)):
        place = np.full(len(side["word"]), -1, np.int32)
        place[at] = np.arange(len(shared), dtype=np.int32)
        place = place[side["places"]]
        some = place >= 0
        sides.append((side["rows"][some], place[some], side["w"][some]))
    (xr, xp, xw), (yr, yp, yw) = sides
    many = np.bincount(xp, minlength=len(shared)) * np.bincount(yp, minlength=len(shared)).astype(float)
    often = np.flatnonzero(many >= DENSE_SHARE**2 * nx * ny)
    often = often[np.argsort(-many[often], kind="stable")][: max(1, min(TILE_WORDS, DENSE_CELLS // max(1, ny)))]
    column = np.full(len(shared), -1, np.int32)
    column[often] = np.arange(len(often))

    def dense(rows: np.ndarray, places: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(often)))
        some = column[places] >= 0
        out[rows[some], column[places[some]]] = w[some]
        return out

    y_dense = dense(yr, yp, yw, ny).T
    rare = column[yp] < 0
    order = np.argsort(yp[rare], kind="stable")
    y_rows, y_w = yr[rare][order].astype(np.int64), yw[rare][order]
    y_ends = np.cumsum(np.bincount(yp[rare], minlength=len(shared)))
    y_starts = np.concatenate([[0], y_ends[:-1]])[: len(shared)]
    mine, theirs = _Top(nx, threshold, keep), _Top(ny, threshold, keep)
    for low in range(0, nx, TILE_ROWS):
        n = min(TILE_ROWS, nx - low)
        a, b = np.searchsorted(xr, [low, low + n])
        rows, places, w = xr[a:b] - low, xp[a:b], xw[a:b]
        scores = dense(rows, places, w, n) @ y_dense
        cells = scores.reshape(-1)
        rare = column[places] < 0
        order = np.argsort(places[rare], kind="stable")
        rows, places, w = rows[rare][order].astype(np.int64) * ny, places[rare][order], w[rare][order]
        starts = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]])) if len(places) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(places))
        word = places[starts]
        long = (ends - starts) * (y_ends[word] - y_starts[word]) >= OUTER_CELLS
        for s, e, from_, to in zip(starts[long].tolist(), ends[long].tolist(), y_starts[word[long]].tolist(), y_ends[word[long]].tolist()):
            cells[(rows[s:e, None] + y_rows[from_:to]).ravel()] += (w[s:e, None] * y_w[from_:to]).ravel()
        short = np.repeat(~long, ends - starts)
        rows, places, w = rows[short], places[short], w[short]
        lengths = y_ends[places] - y_starts[places]
        there = np.repeat(y_starts[places], lengths) + _runs(lengths)
        np.add.at(cells, np.repeat(rows, lengths) + y_rows[there], np.repeat(w, lengths) * y_w[there])
        for left in range(0, ny, SCANNED):
            some, to = np.nonzero(scores[:, left : left + SCANNED] >= (mine.cut[low : low + n] - 1e-9)[:, None])
            values, to = scores[some, to + left], to + left
            other = x["pids"][some + low] != y["pids"][to]
            mine.add(some[other] + low, y["pids"][to[other]], values[other])
        if x is not y:
            some, to = np.nonzero(scores >= theirs.cut - 1e-9)
            theirs.add(to, x["pids"][some + low], scores[some, to])
    for top, side in ((mine, x), (theirs, y)):
        yield side["pids"][top.held[0]], top.held[1], top.held[2]


def _panels(counted: DataFrame, ids: DataFrame) -> tuple[dict[int, str], list[tuple[int, int]]]:
    """(file of each slot, pairs of slots to compare). A large block has slots of its own, small blocks share some."""
    spark = counted.sparkSession
    worded = counted.where(F.size("terms") > 0)
    loads = materialize(worded.groupBy("block").agg(F.sum(F.greatest(F.size("terms"), F.lit(PROFILE_TERMS))).alias("terms"), F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    total = loads.agg(F.coalesce(F.sum("terms"), F.lit(0))).first()[0]
    full = min(PANEL_TERMS, max(LEAST_PANEL, total / PANELS))
    large = [(r["block"], -int(-r["terms"] // full)) for r in loads.where(F.col("terms") >= full).orderBy("block").collect()]  # at most total / full
    first = [max(1, int(-(-total // full)))]
    for _, n in large:
        first.append(first[-1] + n)
    spread = F.broadcast(spark.createDataFrame([(b, at, n) for (b, n), at in zip(large, first)], "block string, _first int, _n int"))
    slot = F.coalesce(F.col("_first") + F.pmod(F.xxhash64("key"), F.col("_n")), F.pmod(F.xxhash64("block"), F.lit(first[0]))).cast("int").alias("slot")
    sent = worded.join(spread, "block", "left").select(slot, "block", "key", F.col("terms.token").alias("tokens"), F.col("terms.tf").alias("tfs"))
    parts = sent.mapInArrow(_coder(_numbered_words(counted).inputFiles()), "slot int, part binary")
    named = ids.join(spread, "block", "left").select(slot, "key", "pid").groupBy("slot").agg(F.collect_list(F.struct("key", "pid")).alias("k"))
    none, n = F.array(), F.lit(None)
    both = parts.select("slot", "part", none.cast("array<string>").alias("keys"), none.cast("array<bigint>").alias("pids")).unionByName(
        named.select("slot", n.cast("binary").alias("part"), F.col("k.key").alias("keys"), F.col("k.pid").alias("pids"))
    )
    built = materialize(both.groupBy("slot").applyInArrow(_panel, "slot int, panel binary"), "slot")
    files = {int(m[1]): f for f in built.inputFiles() if (m := re.search(r"/slot=(\d+)/", f))}
    ranges = [range(at, at + n) for (_, n), at in zip(large, first)]
    pairs = [(i, i) for i in range(first[0])] + [(i, j) for own in ranges for i in own for j in own if i <= j]
    return files, [(i, j) for i, j in pairs if i in files and j in files]


def _grouped(pairs: list[tuple[int, int]], tasks: int) -> list[list[tuple[int, int]]]:
    """Pairs of panels that a task compares: those between few panels, so that a row's best are merged before they leave, in ``tasks`` groups or more."""
    side = max(1, min(PANEL_GROUP, math.isqrt(len(pairs) // tasks)))
    groups: dict[tuple, list] = {}
    for i, j in pairs:
        groups.setdefault((i // side, j // side), []).append((i, j))
    return list(groups.values())


def best_neighbours(counted: DataFrame, ids: DataFrame, threshold: float, keep: int) -> DataFrame:
    """(pid, other, score): for every profile a superset of its ``keep`` best other profiles whose cosine reaches ``threshold``, ties by
    the number of the profile, which follows the lowest document id.

    The words of the rows of ``counted`` are numbered, and profiles are dealt by hash into panels that a task can hold. A panel is stored once; a task
    compares several pairs of panels, which it reads from the shared folder, so that no panel is copied for those that it meets.
    """
    spark = counted.sparkSession
    files, pairs = _panels(counted, ids)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at in (at for batch in batches for at in batch.column(0).to_pylist()):
            found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            held: dict[int, dict] = {}
            for pair in groups[at]:
                held = {slot: held.get(slot) or _vectors(_read(files[slot], ["panel"])["panel"][0].as_py()) for slot in pair}
                for more in _compare(held[pair[0]], held[pair[1]], threshold, keep):
                    found = _best(*[np.concatenate(x) for x in zip(found, more)], keep)[:3]
            pid, other, points = found[0], found[1], np.rint(found[2] * POINTS).astype(np.int32)
            yield from pa.table({"pid": pid, "other": other, "points": points}).to_batches(500_000)

    groups = _grouped(pairs, 4 * spark.sparkContext.defaultParallelism)
    if not groups:
        return spark.createDataFrame([], "pid bigint, other bigint, score double")
    found = materialize(spark.range(0, len(groups), 1, len(groups)).mapInArrow(compare, "pid bigint, other bigint, points int"))
    return found.select("pid", "other", (F.col("points") / F.lit(float(POINTS))).alias("score"))


def _lowest_ids(profiles: DataFrame, keep: int, keys: Sequence[str]) -> DataFrame:
    """The ``keep`` lowest document ids per key; trimmed in every task before the shuffle."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("doc"))
    return (
        profiles.select(*keys, "doc")
        .withColumn("_r", first)
        .where(F.col("_r") <= keep)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list("doc")).alias("ids"))
    )


def cosine_top_k(df: DataFrame, threshold: float = 0.3, top_k: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """(incident_id, matched_incident_id, similarity_score): the ``top_k`` best matches of each
    incident inside its block, ties by matched id.

    Incidents with equal word counts form one profile; only distinct profiles are compared. A
    profile needs at most top_k + 1 documents of any neighbour, so its candidate list is short, and
    it is attached to all of the profile's incidents by a skew-safe join.
    """
    require_all(
        [(0.0 <= threshold <= 1.0, "threshold must be within [0, 1]"), (top_k >= 1, "top_k must be >= 1")], "matcher parameters"
    )
    docs = documents(df, keys).select("block", "doc", F.array_sort(words(F.col("text"))).alias("ws"))
    # The words hold no line break, so the key tells blocks apart.
    key = F.sha2(F.concat(F.col("block"), F.lit("\n"), F.concat_ws(" ", "ws")), 256)
    counted = materialize(docs.select("block", "doc", key.alias("key"), _counted_words("ws").alias("terms")))
    keep = top_k + 1
    lowest = _lowest_ids(counted.where(F.size("terms") > 0), keep, ["block", "key"])
    ids = materialize(dense_index(lowest.withColumn("first_id", F.get("ids", F.lit(0))), ["first_id", "key"], "pid").drop("first_id"))
    best_first = Window.partitionBy("pid").orderBy(F.col("score").desc(), "other")
    both = best_neighbours(counted, ids, max(threshold, 1e-9), keep).withColumn("_r", F.row_number().over(best_first)).where(F.col("_r") <= keep)
    own = ids.select("pid", F.lit(1.0).alias("score"), "ids")
    ranked = skew_safe_join(both.select("pid", "other", "score"), ids.select(F.col("pid").alias("other"), "ids"), ["other"]).select("pid", "score", "ids")
    listed = (
        own.unionByName(ranked)
        .select("pid", "score", F.explode("ids").alias("match"))
        .withColumn("_r", F.row_number().over(Window.partitionBy("pid").orderBy(F.col("score").desc(), "match")))
        .where(F.col("_r") <= keep)
        .groupBy("pid")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("match").alias("m")))).alias("c"))
        .join(ids.select("pid", "block", "key"), "pid")
        .drop("pid")
    )
    profiles = counted.select("block", "key", "doc", "terms")
    attached = skew_safe_join(profiles.select("block", "key", "doc"), listed, ["block", "key"], "left")
    if threshold == 0.0:
        attached = _with_zero_matches(attached, profiles, top_k)
    best = F.slice(F.filter("c", lambda x: x["m"] != F.col("doc")), 1, top_k)
    return attached.select(F.col("doc").alias("incident_id"), F.explode(best).alias("x")).select(
        "incident_id", F.col("x.m").alias("matched_incident_id"), (-F.col("x.s")).alias("similarity_score")
    )


def _with_zero_matches(attached: DataFrame, profiles: DataFrame, top_k: int) -> DataFrame:
    """Threshold 0 also admits documents without a shared word. They only ever fill up the list, and
    the block's 2 * top_k + 1 lowest ids are enough to fill any list."""
    worded = profiles.groupBy("block").agg(F.max(F.size("terms")).alias("m")).where(F.col("m") > 0).select("block")
    spare = _lowest_ids(profiles.join(worded, "block", "left_semi"), 2 * top_k + 1, ["block"]).withColumnRenamed("ids", "spare")
    joined = skew_safe_join(attached, spare, ["block"], "left")
    none = F.array().cast("array<struct<s:double,m:string>>")
    have = F.coalesce("c", none)
    extra = F.transform(
        F.filter("spare", lambda i: ~F.array_contains(F.transform(have, lambda x: x["m"]), i) & (i != F.col("doc"))),
        lambda i: F.struct(F.lit(0.0).alias("s"), i.alias("m")),
    )
    return joined.withColumn("c", F.concat(have, F.coalesce(extra, none))).drop("spare")


def tag_prefix(tags: str, threshold: float) -> Column:
    """The tags of a sorted set of which any set at or above the threshold shares one with its own such tags."""
    return F.slice(tags, 1, _prefix_length(F.size(tags), threshold))


def _prefix_length(size: Column, threshold: float) -> Column:
    """Tags that must be indexed so that any pair at or above the threshold shares one of them."""
    return size - F.ceil(size * F.lit(threshold) - F.lit(1e-9)).cast("int") + 1


def tag_set_matches(sets_a: DataFrame, sets_b: DataFrame, threshold: float = 0.4) -> DataFrame:
    """(tags_a, tags_b, shared, score) for distinct tag sets with Jaccard >= threshold > 0.

    Inputs hold sorted distinct arrays in a column ``tags``. As with words, only a prefix of each
    set is joined and a pair is examined at its first shared prefix tag.
    """
    require_all([(0.0 < threshold <= 1.0, "threshold must be within (0, 1]")], "matcher parameters")

    def prefixed(df: DataFrame, s: str) -> DataFrame:
        p = tag_prefix("tags", threshold)
        return df.where(F.size("tags") > 0).select(F.col("tags").alias(f"tags_{s}"), p.alias(f"p_{s}"), F.explode(p).alias("tag"))

    joined = skew_safe_join(prefixed(sets_a, "a"), prefixed(sets_b, "b"), ["tag"])
    return joined.where(
        (F.element_at(F.array_intersect("p_a", "p_b"), 1) == F.col("tag")) & (jaccard(F.col("tags_a"), F.col("tags_b")) >= threshold)
    ).select(
        "tags_a", "tags_b", F.array_sort(F.array_intersect("tags_a", "tags_b")).alias("shared"),
        F.round(jaccard(F.col("tags_a"), F.col("tags_b")), 4).alias("score"),
    )


def with_tag_set(df: DataFrame, tags: str = "mo_tags") -> DataFrame:
    clean = F.filter(F.coalesce(F.col(tags), F.array().cast("array<string>")), lambda t: t.isNotNull())
    return df.withColumn("tags", F.array_sort(F.array_distinct(clean)))


def tag_set_summary(df: DataFrame, threshold: float = 0.4, tags: str = "mo_tags") -> DataFrame:
    """Matching tag sets of one table with the number of cases on each side."""
    sets = with_tag_set(df, tags).groupBy("tags").agg(F.count(F.lit(1)).alias("cases"))
    found = tag_set_matches(sets.select("tags"), sets.select("tags"), threshold)
    a = sets.select(F.col("tags").alias("tags_a"), F.col("cases").alias("cases_a"))
    b = sets.select(F.col("tags").alias("tags_b"), F.col("cases").alias("cases_b"))
    return found.join(a, "tags_a").join(b, "tags_b")


def tag_matches(
    new: DataFrame, pool: DataFrame, threshold: float = 0.4, key: str = "fir_number", tags: str = "mo_tags", top_k: int | None = None
) -> DataFrame:
    """(source, target, shared_mo_tags, similarity_score) of each new case against the pool, self
    excluded. Sets are matched once each and only then expanded to cases. ``top_k`` asks for the best matches of each new
    case, ties to the lowest key; the expansion then grows with the new cases, not with the square of a common set."""
    n, p = with_tag_set(new, tags), with_tag_set(pool, tags)
    found = tag_set_matches(n.select("tags").distinct(), p.select("tags").distinct(), threshold)
    return cases_of_sets(found, n.select(F.col(key).alias("source"), "tags"), p.select(F.col(key).alias("target"), "tags"), top_k)


def cases_of_sets(found: DataFrame, sources: DataFrame, targets: DataFrame, top_k: int | None) -> DataFrame:
    """The cases behind matching sets: ``sources`` (source, tags) and ``targets`` (target, tags)."""
    if top_k is not None:  # of equal sets no case needs more than these, itself left out
        first = F.row_number().over(Window.partitionBy("tags").orderBy("target"))
        targets = targets.withColumn("_first", first).where(F.col("_first") <= top_k + 1).drop("_first")
    hits = skew_safe_join(targets.withColumnRenamed("tags", "tags_b"), found.join(sources.withColumnRenamed("tags", "tags_a"), "tags_a"), ["tags_b"])
    matches = hits.where(F.col("source") != F.col("target")).select(
        "source", "target", F.col("shared").alias("shared_mo_tags"), F.col("score").alias("similarity_score")
    )
    if top_k is None:
        return matches
    best = F.row_number().over(Window.partitionBy("source").orderBy(F.col("similarity_score").desc(), "target"))
    return matches.withColumn("_best", best).where(F.col("_best") <= top_k).drop("_best")


def match_edges(matches: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Links written for strong matches."""
    return matches.where(F.col("similarity_score") >= threshold).select(
        *matches.columns, F.lit(True).alias("auto_linked"), F.lit(False).alias("verified_by_investigator")
    )

