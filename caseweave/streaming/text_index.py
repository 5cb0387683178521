"""Similar texts and tags of new incidents by stored inverted indexes.

Incidents with equal word counts are one profile. Four keyed tables grow with the stream and no text is read twice:

* ``postings``   (block, token) -> profiles that have the token in their prefix, with the length of the vector from the token on
* ``vectors``    (block, profile) -> words and weights, of unit length
* ``members``    (block, profile) -> the lowest incident ids, as many as a list of matches can take
* ``frequency``  (block, token) -> documents; with ``sizes`` it gives the weights, which are frozen before the first batch

A prefix ends once the rest of the vector is shorter than the threshold. Words are ordered alike in all vectors, rarest first, so two vectors
that reach the threshold share a word of both prefixes. A batch opens the buckets of its own prefix words, then the vectors of the
profiles found there, and takes the exact cosine of each such pair. A word that is new since the weights were frozen weighs like one that no
document has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scale import materialize
from ..operators.similarity import SCORE_DIGITS, cases_of_sets, documents, ordered_vectors, tag_prefix, tag_set_matches, with_tag_set, word_profiles
from ..sources.keyed import BUCKETS, KeyedTable, compact_every
from .tables import read_all, run_available, write_batch

COMPACT_EVERY = 8
_PROFILE = ["block", "key"]


def _any(*names: str):
    return lambda: [F.any_value(n).alias(n) for n in names]


class TextIndex:
    def __init__(self, spark: SparkSession, folder: str, threshold: float = 0.3, top_k: int = 5, buckets: int = BUCKETS) -> None:
        if not (0.0 < threshold <= 1.0 and top_k >= 1):
            raise ValueError("threshold must be within (0, 1] and top_k at least 1")
        self.limit, self.threshold, self.keep, self.top_k = threshold - 1e-9, threshold, top_k + 1, top_k
        listed = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, self.keep).alias("ids")
        self.frequency = KeyedTable(spark, f"{folder}/frequency", "block string, token string, df bigint", ["block", "token"], lambda: [F.sum("df").alias("df")], ["block", "token"], buckets)
        self.sizes = KeyedTable(spark, f"{folder}/sizes", "block string, n bigint", ["block"], lambda: [F.sum("n").alias("n")], buckets=1)
        self.postings = KeyedTable(
            spark, f"{folder}/postings", "block string, token string, key string, tail double", ["block", "token", "key"], lambda: [F.max("tail").alias("tail")], ["block", "token"], buckets
        )
        self.vectors = KeyedTable(spark, f"{folder}/vectors", "block string, key string, words array<string>, weights array<double>", _PROFILE, _any("words", "weights"), _PROFILE, buckets)
        self.members = KeyedTable(spark, f"{folder}/members", "block string, key string, ids array<string>", _PROFILE, lambda: [listed], _PROFILE, buckets)

    def freeze(self, reference: DataFrame) -> None:
        """Take the weights of words from the texts of ``reference``."""
        profiles = materialize(word_profiles(documents(reference)))
        tokens = profiles.select("block", F.explode(F.array_distinct("ws")).alias("token"))
        self.frequency.append(tokens.groupBy("block", "token").agg(F.count(F.lit(1)).alias("df")), 0)
        self.sizes.append(profiles.groupBy("block").agg(F.count(F.lit(1)).alias("n")), 0)

    def _vectors(self, profiles: DataFrame) -> DataFrame:
        """(block, key, words, weights, prefix) of the distinct profiles with a word."""
        distinct = profiles.where(F.size("ws") > 0).groupBy(*_PROFILE).agg(F.any_value("ws").alias("ws"))
        counts = materialize(distinct.select(*_PROFILE, F.explode("ws").alias("token")).groupBy(*_PROFILE, "token").agg(F.count(F.lit(1)).alias("tf")))
        known = counts.join(self.frequency.lookup(counts), ["block", "token"], "left").join(F.broadcast(self.sizes.read()), "block", "left")
        idf = F.log((1.0 + F.coalesce("n", F.lit(0))) / (1.0 + F.coalesce("df", F.lit(0)))) + 1.0
        raw = known.select(*_PROFILE, F.struct((-idf).alias("order"), "token").alias("word"), (F.col("tf") * idf).alias("w"))
        length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(*_PROFILE)))
        made = ordered_vectors(raw.withColumn("w", F.col("w") / length), self.limit)
        return made.select(
            *_PROFILE, F.transform("words", lambda x: x["token"]).alias("words"), "weights",
            F.transform("prefix", lambda p: F.struct(p["word"]["token"].alias("token"), p["tail"].alias("tail"))).alias("prefix"),
        )

    def add(self, incidents: DataFrame, batch: int) -> DataFrame:
        """Add the incidents of a batch; (incident_id, matched_incident_id, similarity_score): their best matches of the same block among all incidents
        so far, ties by matched id."""
        compact_every([self.postings, self.vectors, self.members], batch, COMPACT_EVERY)
        profiles = materialize(word_profiles(documents(incidents)).select("block", "doc", "ws", "key"))
        fresh = materialize(self._vectors(profiles))
        prefixes = fresh.select(*_PROFILE, F.explode("prefix").alias("p")).select(*_PROFILE, "p.token", "p.tail")
        first = F.row_number().over(Window.partitionBy(*_PROFILE).orderBy("doc"))
        lowest = profiles.where(F.size("ws") > 0).select(*_PROFILE, "doc").distinct().withColumn("r", first).where(F.col("r") <= self.keep)
        self.postings.append(prefixes, batch)
        self.vectors.append(fresh, batch)
        self.members.append(lowest.groupBy(*_PROFILE).agg(F.array_sort(F.collect_list("doc")).alias("ids")), batch)
        return self._matches(profiles, fresh, prefixes, batch)

    def _matches(self, profiles: DataFrame, fresh: DataFrame, prefixes: DataFrame, batch: int) -> DataFrame:
        met = self.postings.lookup(prefixes, batch).withColumnsRenamed({"key": "other", "tail": "other_tail"})
        reach = (F.col("key") != F.col("other")) & (F.col("tail") * F.col("other_tail") >= self.limit)
        pairs = materialize(prefixes.join(met, ["block", "token"]).where(reach).select(*_PROFILE, "other").distinct())
        others = self.vectors.lookup(pairs.select("block", F.col("other").alias("key")), batch)
        weight = F.map_from_arrays("words", "weights")
        sides = pairs.join(fresh.select(*_PROFILE, F.arrays_zip("words", "weights").alias("v")), _PROFILE).join(
            others.select("block", F.col("key").alias("other"), weight.alias("m")), ["block", "other"]
        )
        dot = F.aggregate("v", F.lit(0.0), lambda s, x: s + x["weights"] * F.coalesce(F.element_at("m", x["words"]), F.lit(0.0)))
        found = materialize(sides.select(*_PROFILE, "other", F.round(F.least(F.lit(1.0), dot), SCORE_DIGITS).alias("score")).where(F.col("score") >= self.threshold))
        both = found.unionByName(fresh.select(*_PROFILE, F.col("key").alias("other"), F.lit(1.0).alias("score")))
        ids = self.members.lookup(both.select("block", F.col("other").alias("key")), batch).withColumnRenamed("key", "other")
        listed = both.join(ids, ["block", "other"]).select(*_PROFILE, "score", F.explode("ids").alias("match"))
        rank = F.row_number().over(Window.partitionBy(*_PROFILE).orderBy(F.col("score").desc(), "match"))
        best = listed.withColumn("r", rank).where(F.col("r") <= self.keep).groupBy(*_PROFILE).agg(F.array_sort(F.collect_list(F.struct("r", "match", "score"))).alias("c"))
        mine: Column = F.slice(F.filter("c", lambda x: x["match"] != F.col("doc")), 1, self.top_k)
        return profiles.select(*_PROFILE, "doc").distinct().join(best, _PROFILE).select(F.col("doc").alias("incident_id"), F.explode(mine).alias("x")).select(
            "incident_id", F.col("x.match").alias("matched_incident_id"), F.col("x.score").alias("similarity_score")
        )


class TagIndex:
    """Tag sets by the tags of their prefixes, and the incidents of each set. A batch opens the buckets of its own prefix tags and of the sets that match."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str, threshold: float = 0.4, top_k: int | None = None, buckets: int = BUCKETS) -> None:
        self.threshold, self.top_k = threshold, top_k
        least = lambda: [F.min("n").alias("n")]
        self.postings = KeyedTable(spark, f"{folder}/postings", "tag string, tags array<string>, n int", ["tag", "tags"], least, buckets=buckets)
        self.members = KeyedTable(spark, f"{folder}/members", f"tags array<string>, target {id_type}, n int", ["tags", "target"], least, buckets=buckets)

    def add(self, incidents: DataFrame, batch: int, key: str = "incident_id", tags: str = "mo_tags") -> DataFrame:
        """Add the incidents of a batch; their matches among all incidents so far, as ``similarity.tag_matches`` gives them."""
        cases = with_tag_set(incidents, tags).select(F.col(key).alias("source"), "tags").where(F.size("tags") > 0)
        sets = materialize(cases.select("tags").distinct())
        prefixes = sets.select(F.explode(tag_prefix("tags", self.threshold)).alias("tag"), "tags", F.lit(1).alias("n"))
        self.postings.append(prefixes, batch)
        self.members.append(cases.select("tags", F.col("source").alias("target"), F.lit(1).alias("n")), batch)
        pool = self.postings.lookup(prefixes.select("tag"), batch).select("tags").distinct()
        found = materialize(tag_set_matches(sets, pool, self.threshold))
        targets = self.members.lookup(found.select(F.col("tags_b").alias("tags")), batch).select("target", "tags")
        return cases_of_sets(found, cases, targets, self.top_k)


def run_text_matches(incidents: DataFrame, reference: DataFrame | None, folder: str, checkpoint: str, threshold: float = 0.3, top_k: int = 5, buckets: int = BUCKETS) -> None:
    """Store the matches of each batch below ``folder/text_matches``. ``reference`` has the texts whose word counts weigh words; it is
    needed once, before the first batch."""
    index = TextIndex(incidents.sparkSession, f"{folder}/text_index", threshold, top_k, buckets)
    if reference is not None:
        index.freeze(reference)

    def apply(df: DataFrame, batch: int) -> None:
        write_batch(index.add(materialize(df), batch), folder, "text_matches", batch)

    run_available(incidents.writeStream.foreachBatch(apply), checkpoint)


def text_matches(spark: SparkSession, folder: str) -> DataFrame:
    return read_all(spark, folder, "text_matches").drop("batch")
