"""Benchmark decontamination by a distributed positional inverted index. DataFrame functions only.

Index: one posting (term, doc, position) per training word that the benchmark uses, stored as a table of the shared folder.
Search: the terms of every window of a test item are ranked by their corpus frequency, counted over the whole index. A window with a
term of frequency zero cannot occur. For the others, the posting lists of the ``depth`` rarest places are shifted by their offsets and
intersected, so a start survives only where all of them agree. Windows that share their rarest places are probed once.
Proof: the surviving alignments of a document are compared word by word with the item, inside the document's row, which gives every
exact occurrence of every window, and the number of document words inside.

The index side is never sorted or shuffled by term: the probes, a few per item, go to it, by broadcast if they are few, else by a
shuffled join. A passage that a third of the documents share gives a few rows per document.

Edges: null and empty texts have no words. Items without words are left out; an item shorter than the window is one window. Items with the
same words count each; repeated item rows count once. Repeated document rows are judged each, with the same result. A null key is judged as any other.
Rows meet their alignments by a hash of key and text, so rows without a key, or of one key, try their own only. Empty tables give zero hits or an empty result. Extra columns are kept by ``contamination`` unless they are named like those it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, once, stored

WINDOW = 13
DEPTH = 2
#: Test terms and probes are broadcast up to this many rows of a few numbers or one term each, and items up to this many words in all; beyond it the
#: join is left to Spark.
FEW = 500_000
#: Everything outside [^\x00-\x2F\x3A-\x60\x7B-\x7F], and outside A-Z, which count as their lower-case letters.
BREAKS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_words(text: Column) -> Column:
    """Words of a text, not yet lower-cased."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BREAKS), lambda w: w != "")


def lowered(word: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def small(df: DataFrame) -> DataFrame:
    """``df``, a materialized table, marked for broadcast if it is short."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def test_items(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words) with the words lower-cased; a row per distinct item and text."""
    words = F.transform(split_words(F.col(text)), lowered)
    return benchmark.select(F.col(item).alias("item"), words.alias("words")).where(F.size("words") > 0).distinct()


def row_hash(key: str, text: str) -> Column:
    """What tells rows apart; rows that share it by chance only try each other's alignments too."""
    return F.xxhash64(F.col(key), F.col(text))


def build_index(docs: DataFrame, terms: DataFrame | None = None, key: str = "doc_id", text: str = "text", doc: Column | None = None) -> DataFrame:
    """The stored postings (term, doc, position) of the words of ``docs``; with ``terms`` (term) only of those. ``doc`` is the key unless given."""
    split = docs.select((F.col(key) if doc is None else doc).alias("doc"), F.split(F.coalesce(F.col(text), F.lit("")), BREAKS).alias("words"))
    # A text that starts with a break has an empty first word, which takes no position.
    led = split.withColumn("lead", (F.get("words", F.lit(0)) == "").cast("int"))
    words = led.select("doc", "lead", F.posexplode("words").alias("place", "word")).where("word <> ''")
    postings = words.select(lowered(F.col("word")).alias("term"), "doc", (F.col("place") - F.col("lead")).alias("position"))
    return materialize(postings if terms is None else postings.join(small(terms), "term", "left_semi"))


def probes(items: DataFrame, index: DataFrame, window: int = WINDOW, depth: int = DEPTH) -> DataFrame:
    """(probe, entry, size, y, term): for each window of an item the places ``y`` of its rarest terms, the same set once. ``entry`` stands for item and words."""
    frequency = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    places = items.select("item", "words", F.posexplode("words").alias("y", "term"))
    known = places.join(frequency, "term", "left").fillna(0, ["n"])
    item = known.groupBy("item", "words").agg(F.sort_array(F.collect_list(F.struct("y", "n"))).alias("ns"))
    length = F.least(F.size("words"), F.lit(window))
    starts = F.sequence(F.lit(0), F.size("words") - length)
    rarest = lambda o: F.slice(F.sort_array(F.transform(F.slice("ns", o + 1, length), lambda p: F.struct(p["n"].alias("n"), p["y"].alias("y")))), 1, depth)
    windows = item.select("item", "words", F.explode(F.transform(starts, rarest)).alias("r"))
    able = windows.where(F.get(F.col("r")["n"], F.lit(0)) > 0)
    sets = able.select("item", "words", F.sort_array(F.col("r")["y"]).alias("ys")).distinct()
    named = sets.withColumns({"probe": F.xxhash64("item", "words", "ys"), "entry": F.xxhash64("item", "words")})
    return named.select("probe", "entry", "words", F.size("ys").alias("size"), F.explode("ys").alias("y")).withColumn("term", F.get("words", F.col("y"))).drop("words")


def alignments(index: DataFrame, probed: DataFrame) -> DataFrame:
    """(doc, shift, probe): the shifts of an item against a document on which all places of a probe agree."""
    matched = index.join(small(probed.select("probe", "size", "y", "term")), "term").select("probe", "size", "doc", "y", (F.col("position") - F.col("y")).alias("shift"))
    met = matched.groupBy("doc", "shift", "probe", "size").agg(F.count(F.lit(1)).alias("n")).where("n >= size")
    return met.select("doc", "shift", "probe")


def phrase_matches(docs: DataFrame, items: DataFrame, index: DataFrame, window: int = WINDOW, depth: int = DEPTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with n_words and ``hits``: (item, start, length) of every stretch of words covered by exact occurrences of an item's windows. ``index`` names rows by
    ``row_hash``."""
    spread = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    probed = stored(probes(items, index, window, depth), depth * spread)
    aligned = alignments(index, probed)
    of_probe = probed.select("probe", "entry").distinct()
    entries = items.withColumn("entry", F.xxhash64("item", "words"))
    entries = F.broadcast(entries) if spread <= FEW else entries
    rows = aligned.join(small(stored(of_probe, spread)), "probe").select("doc", "entry", "shift").distinct().join(entries, "entry").select("doc", "item", "words", "shift")
    found = materialize(rows.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("item", "words", "shift")).alias("_tries")))
    # Always by shuffle, each text once, for the documents with alignments grow with the input. Words are made after it.
    joined = docs.drop("n_words", "hits", "_doc", "_tries", "_words").join(found.hint("merge"), row_hash(key, text) == F.col("_doc"), "left")
    split = joined.withColumn("_words", once(split_words(F.col(text))))
    low = split.withColumn("_words", once(F.when(F.col("_tries").isNotNull(), F.transform("_words", lowered)).otherwise(F.col("_words"))))

    def runs(attempt: Column) -> Column:
        """Starts of the windows of one alignment that agree word by word."""
        length = F.least(F.size(attempt["words"]), F.lit(window))
        first = F.greatest(F.lit(0), -attempt["shift"])
        last = F.least(F.size(attempt["words"]), F.size("_words") - attempt["shift"]) - length
        places = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
        equal = lambda o: F.slice(attempt["words"], o + 1, length) == F.slice(F.col("_words"), o + attempt["shift"] + 1, length)
        return F.transform(F.filter(places, equal), lambda o: F.struct(attempt["item"].alias("item"), (o + attempt["shift"]).alias("start"), length.alias("length")))

    hits = F.coalesce(F.flatten(F.transform("_tries", runs)), F.array().cast(f"array<struct<item:{items.schema['item'].dataType.simpleString()},start:int,length:int>>"))
    return low.withColumns({"n_words": once(F.size("_words").cast("bigint")), "hits": once(hits)}).drop("_doc", "_tries", "_words")


def covered(hits: Column) -> Column:
    """Words inside the union of the hits."""
    spans = F.sort_array(F.transform(hits, lambda h: F.struct(h["start"].alias("s"), (h["start"] + h["length"]).alias("e"))))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    step = lambda a, h: F.struct((a["n"] + F.greatest(F.lit(0), h["e"] - F.greatest(h["s"], a["end"]))).cast("bigint").alias("n"), F.greatest(a["end"], h["e"]).alias("end"))
    return F.aggregate(spans, start, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, depth: int = DEPTH, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """``docs`` with (n_words, n_hit, n_items, items_sha256, contaminated)."""
    items = stored(test_items(benchmark, item), benchmark.count())
    spread = items.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    terms = stored(items.select(F.explode("words").alias("term")).distinct(), spread)
    index = build_index(docs, terms, key, text, row_hash(key, text))
    found = phrase_matches(docs.drop("n_hit", "n_items", "items_sha256", "contaminated"), items, index, window, depth, key, text)
    names = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["item"].cast("string"))))
    out = found.withColumns({"n_hit": once(covered(F.col("hits"))), "_names": once(names)})
    return out.withColumns({
        "n_items": F.size("_names").cast("bigint"),
        "items_sha256": F.sha2(F.array_join("_names", ",").cast("binary"), 256),
        "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")),
    }).drop("_names", "hits")


def proximity_matches(index: DataFrame, terms: DataFrame, slack: int) -> DataFrame:
    """(query, doc, start, end): for each place where one ends, the shortest span that holds all terms of a query and at most ``slack`` other words.

    ``terms`` has a row (query, term) per distinct term. Only documents with the rarest term of a query are looked at; their postings
    of its terms are folded once, in order, in the document's row.
    """
    wanted = terms.select("query", "term").distinct()
    frequency = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    ranked = wanted.join(frequency, "term", "left").fillna(0, ["n"])
    of_query = Window.partitionBy("query")
    listed = materialize(ranked.withColumns({
        "size": F.count(F.lit(1)).over(of_query).cast("int"), "rarest": F.min(F.struct("n", "term")).over(of_query)["term"],
        "k": F.row_number().over(of_query.orderBy("term")) - 1,
    }))
    postings = index.join(small(listed), "term").select("query", "size", "rarest", "term", "k", "doc", "position")
    holders = postings.where("term = rarest").select("query", "doc").distinct()
    events = postings.join(holders, ["query", "doc"], "left_semi").groupBy("query", "doc", "size").agg(F.sort_array(F.collect_list(F.struct("position", "k"))).alias("events"))
    nothing = F.struct(F.transform(F.sequence(F.lit(1), F.col("size")), lambda _: F.lit(-1)).alias("last"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(a: Column, e: Column) -> Column:
        last = F.transform(a["last"], lambda p, i: F.when(i == e["k"], e["position"]).otherwise(p))
        start = F.array_min(last)
        span = F.array(F.struct(start.alias("start"), e["position"].alias("end")))
        return F.struct(last.alias("last"), F.when((start >= 0) & (e["position"] - start < F.col("size") + slack), F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return events.select("query", "doc", F.explode(F.aggregate("events", nothing, step, lambda a: a["spans"])).alias("s")).select("query", "doc", "s.start", "s.end")
