"""Near-duplicate documents by 64-bit SimHash fingerprints and BK-trees.

Fingerprints: hashes of word shingles vote per bit. Only distinct fingerprints take part in the search; copies follow their
fingerprint.

Search: two fingerprints that differ in at most two bits agree in one of any three blocks of bits, so each fingerprint goes to
three shards, one per block. A shard is named by as many bits of its block as give about TREE fingerprints a shard, and becomes one BK-tree: children hang
below their parent by integer Hamming distance, and a search follows only the edges within the radius of the distance at hand. So every fingerprint is
searched in three trees of about TREE nodes, however many there are. A shard above SHARD fingerprints is dealt again by the three blocks
of the bits not yet fixed, five times at most; then so few bits are left that no shard can be larger. So every link is found and nothing is
capped. A tree goes to the one task that has its shard's fingerprints; none is sent to all executors, for all trees together grow with the corpus.

A shard reports, instead of all its pairs, one link from each fingerprint to the root of its local component. The links of all
shards go through connected components.

Edges: null and empty texts have fingerprint zero, which links like any other. Repeated rows stay. A null key never names a
component unless all keys of the component are null. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import materialize, slices, stored

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Fingerprints of a usual tree, and of the largest.
TREE = 512
SHARD = 2048
#: Hashes turned into bits at a time.
VOTES = 1 << 15
BLOCKS = 3
LEVELS = 6


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of a text as a signed 64-bit integer: a bit is set if over half of the shingles' hashes have it."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()  # of bytes: A-Z only, and exactly the blanks 20, 09-0D
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter(map(xxh64_intdigest, grams, repeat(seed)), dtype="<u8", count=n)
    votes = np.zeros(64, dtype=np.int64)
    for start in range(0, n, VOTES):
        votes += np.unpackbits(hashes[start : start + VOTES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<i8")[0])


class BKTree:
    """Distinct unsigned integers; a child hangs below its parent by their Hamming distance."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, dict[int, int]]] = []

    def add_and_find(self, value: int, radius: int) -> list[int]:
        """Places of the values within ``radius``, then adds the value."""
        nodes = self.nodes
        if not nodes:
            nodes.append((value, {}))
            return []
        found, todo = [], [0]
        while todo:
            at = todo.pop()
            other, children = nodes[at]
            distance = (value ^ other).bit_count()
            if distance <= radius:
                found.append(at)
            if children:
                for d in range(distance - radius, distance + radius + 1):
                    if d in children:
                        todo.append(children[d])
        at = 0
        while True:
            other, children = nodes[at]
            distance = (value ^ other).bit_count()
            if distance not in children:
                children[distance] = len(nodes)
                nodes.append((value, {}))
                return found
            at = children[distance]


def local_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, root) for each value but the roots, where roots stand for the components among ``values``."""
    values = sorted(set(values))
    tree, parent = BKTree(), list(range(len(values)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, value in enumerate(values):
        for j in tree.add_and_find(value, radius):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    return [(v, values[root(i)]) for i, v in enumerate(values) if root(i) != i]


def fingerprinted(shingle: int, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 512):
            yield pa.record_batch({"key": part.column(0), "fp": pa.array([simhash(t, shingle, seed) for t in part.column(1).to_pylist()], pa.int64())})

    return run


def linked_in_shards(radius: int) -> Callable:
    """Rows come sorted by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            links: list[tuple[int, int]] = []
            for *at, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if at != shard:  # (mask, fixed bits)
                    links += local_links(held, radius) if len(held) > 1 else []
                    shard, held = at, []
                held.append(fp & (1 << 64) - 1)
            yield as_batch(links)
        yield as_batch(local_links(held, radius) if held else [])

    def as_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
        columns = [np.array([x[i] for x in links], dtype=np.uint64).view(np.int64) for i in (0, 1)]
        return pa.record_batch({"u": pa.array(columns[0], pa.int64()), "v": pa.array(columns[1], pa.int64())})

    return run


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(key, fp) of every row."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(fingerprinted(shingle, seed), f"key {kind}, fp bigint")


def fixed_bits(first: int, levels: int = LEVELS) -> list[list[int]]:
    """Per level, the masks of the bits that a shard fixes: ``first`` bits of a block, then whole blocks of the bits left. Those cut from mask i of a level are the
    BLOCKS masks from BLOCKS * i on of the next; without ``first`` bits there is one shard to begin with."""
    out: list[list[int]] = []
    now = [0]
    for level in range(levels):
        masks = []
        for mask in now:
            free = [b for b in range(64) if not mask >> b & 1]
            width = len(free) // BLOCKS
            used = width if level else min(first, width)
            masks += [mask | sum(1 << b for b in free[i * width : i * width + used]) for i in range(BLOCKS if used else 1)]
        out.append(masks)
        now = masks
    return out


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links_within(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD, tree: int = TREE) -> DataFrame:
    """(u, v) links between distinct fingerprints ``fp`` whose components are those of all pairs within ``radius`` (2 at most)."""
    if not 0 <= radius < BLOCKS:
        raise ValueError(f"shards are cut for a radius below {BLOCKS}")
    rows, n_rows = prints.select("fp", F.lit(0).alias("at")), prints.count()
    found: DataFrame | None = None
    levels = fixed_bits((max(1, n_rows // tree) - 1).bit_length())
    for level, masks in enumerate(levels):
        last = level == LEVELS - 1
        fixed = F.array(*[F.lit(signed(m)) for m in masks])
        cut = len(masks) // (len(levels[level - 1]) if level else 1)
        dealt = rows.select("fp", F.explode(F.sequence(F.col("at") * cut, F.col("at") * cut + cut - 1)).alias("at")).select(
            "fp", "at", F.col("fp").bitwiseAND(F.element_at(fixed, F.col("at") + 1)).alias("bits")
        )
        sizes = stored(dealt.groupBy("at", "bits").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), cut * n_rows)
        placed = dealt.join(sizes, ["at", "bits"])
        small = placed if last else placed.where(F.col("n") <= shard)
        by_shard = small.select("at", "bits", "fp").repartition("at", "bits").sortWithinPartitions("at", "bits")
        links = materialize(by_shard.mapInArrow(linked_in_shards(radius), "u bigint, v bigint"))
        found = links if found is None else found.unionByName(links)
        if last or sizes.where(F.col("n") > shard).isEmpty():
            break
        rows = stored(placed.where(F.col("n") > shard).select("fp", "at"), cut * n_rows)
        n_rows = rows.count()
    return found


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE, shard: int = SHARD) -> DataFrame:
    """(key, fingerprint, component_id) of every row; ``component_id`` is the least key that links reach."""
    prints = materialize(fingerprints(docs, key, text, shingle))
    rows = prints.count()
    least = stored(prints.groupBy("fp").agg(F.min("key").alias("least")), rows)
    links = links_within(least, radius, shard)
    ends = links.select(F.col("u").alias("fp")).unionByName(links.select(F.col("v").alias("fp"))).distinct()
    once = links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()  # found in up to three shards
    roots = stored(connected_components(once, ends, "u", "v", "fp").withColumnRenamed("component", "root"), rows)
    first = stored(least.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component")), rows)
    named = stored(least.join(roots.join(first, "root").drop("root"), "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id")), rows)
    return prints.join(named, "fp").select(
        F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each group of near-duplicates: that of the least key, null last; of rows with that key the one whose text has the least hash.

    The rows are written with a number each, which ranks last and by which the survivors are found, so neither null nor repeated keys lose a group.
    """
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")))
    own = F.col("doc").getField
    rank = F.struct(own(key).isNull().alias("nameless"), own(key).alias("key"), F.xxhash64(own(text)).alias("digest"), "row")
    groups = near_duplicates(rows.select(rank.alias("rank"), own(text).alias("text")), "rank", "text", radius)
    kept = groups.where(F.col("rank.row") == F.col("component_id.row")).select("rank.row")
    return rows.join(kept, "row", "left_semi").select("doc.*")
