"""URL filter: listed rules first; other urls by host words and naive Bayes.

Host words: the labels of a host are split at everything that is no letter and no digit, and what is between by a unigram Viterbi search. Word counts come from
all page texts without their markup. A distinct stretch is cut into its possible words, those are joined with the counts, and the search runs over
the words that exist, so neither the vocabulary nor the labels go to any one place. A word has at most LONGEST letters, as many as a
host name may have, so both the cutting and the search are linear in a stretch of any length.

Naive Bayes: the urls that a rule decides are the examples. Tokens are host words and path tokens (numbers become ``<n>``); each token is counted
by itself, multinomial with add-one smoothing over the distinct tokens of all urls. The counts stay a table that the tokens of the urls are joined
with. A url that no rule decides is blocked if the log odds of its tokens favour block.

Edges: a null url, or one without ``://``, has an empty host and path, fits no rule and is judged by the class shares alone. Without any example, or
with a tie, a url is allowed. Null page texts add no words. Repeated rows are judged each. An empty table gives an empty result. Extra columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scale import skew_safe_join
from .common import materialize

#: Letters of the longest host name.
LONGEST = 253
#: Letters of a stretch that are cut into words at a time.
PIECE = 1024
#: What is no text: comments, scripts and styles with their bodies, tags, and entities.
MARKUP = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[a-z/!?][^>]*>|&#?\w+;"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


BREAKS = r"[^\p{L}\p{M}\p{N}]+"


def host_and_path(url: Column) -> dict[str, Column]:
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    whole = F.coalesce(url, F.lit(""))
    return {"host": F.translate(F.regexp_extract(whole, parts, 1), UPPER, LOWER), "path": F.regexp_extract(whole, parts, 2)}


def by_rules(rules: Sequence[tuple[str, str, str]], host: str = "host", path: str = "path") -> dict[str, Column]:
    """The longest rule that fits and its verdict, null where none does."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = lambda r: ((F.col(host) == r[1]) | F.col(host).endswith("." + r[1])) & F.col(path).startswith(r[2])
    chain = lambda value: reduce(lambda so_far, r: so_far.when(fits(r), value(r)), longest[1:], F.when(fits(longest[0]), value(longest[0])))
    if not longest:
        return {"rule": F.lit(None).cast("string"), "listed": F.lit(None).cast("string")}
    return {"rule": chain(lambda r: r[1] + r[2]), "listed": chain(lambda r: r[0])}


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """(word, n) over all texts without markup: runs of letters with their marks, and digits, of any script and length, lower-cased."""
    words = texts.select(F.explode(F.split(F.lower(F.regexp_replace(F.col(text), MARKUP, " ")), BREAKS)).alias("word"))
    return words.where(F.col("word") != "").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def best_split(label: str, counts: dict[str, int], total: float) -> list[str]:
    """The most likely words of a label; an unknown stretch of k letters costs as much as a word of 1 / (total 10^k). Of equal ones the longest last word wins."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    unknown, letter = math.log(total), math.log(10.0)
    lengths = sorted({len(w) for w in counts if len(w) <= LONGEST}, reverse=True)
    open_cost, open_start = math.inf, 0  # of the best unknown stretch that reaches this far
    for end in range(1, len(label) + 1):
        open_cost, open_start = min((open_cost + letter, open_start), (best[end - 1][0] + unknown + letter, end - 1))
        found = (open_cost, open_start)
        for length in lengths:
            start = end - length
            if start >= 0 and (n := counts.get(label[start:end])):
                found = min(found, (best[start][0] + math.log(total / n), start))
        best.append(found)
    words, end = [], len(label)
    while end:
        start = best[end][1]
        words.append(label[start:end])
        end = start
    return words[::-1]


def segmented(total: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, found = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            words = [best_split(x, {w["word"]: w["n"] for w in known}, total) for x, known in zip(labels, found)]
            yield pa.record_batch({"label": batch.column(0), "words": pa.array(words, pa.list_(pa.string()))})

    return run


def label_words(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words) of distinct ``labels`` (label), by ``counts`` (word, n)."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)) + 1).first()[0]
    lengths = [r[0] for r in counts.select(F.length("word").alias("l")).where(F.col("l") <= LONGEST).distinct().collect()]  # LONGEST numbers at most
    named = labels.where("label <> ''").withColumn("id", F.md5("label"))
    # Pieces of a stretch, which overlap by a word, so that no row holds more than the words of one piece.
    starts = F.sequence(F.lit(1), F.length("label"), F.lit(PIECE))
    parts = named.select("id", F.explode(F.transform(starts, lambda s: F.substr("label", s, F.lit(PIECE + LONGEST)))).alias("part"))
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.length("part") - n + 1), lambda s: F.substr("part", s, n))
    fitting = F.filter(F.lit(lengths).cast("array<int>"), lambda n: n <= F.length("part"))
    pieces = parts.select("id", F.explode(F.array_distinct(F.flatten(F.transform(fitting, cut)))).alias("word"))
    known = pieces.join(counts, "word").groupBy("id").agg(F.collect_set(F.struct("word", "n")).alias("known"))
    nothing = F.array().cast("array<struct<word:string,n:bigint>>")
    every = named.join(known, "id", "left").select("label", F.coalesce("known", nothing).alias("known"))
    return every.mapInArrow(segmented(float(total)), "label string, words array<string>")


def host_words(hosts: DataFrame, counts: DataFrame) -> DataFrame:
    """(host, words) of distinct ``hosts`` (host): the words of its labels in order."""
    placed = hosts.select("host", F.posexplode(F.split("host", BREAKS)).alias("place", "label"))
    split = materialize(label_words(placed.select("label").distinct(), counts))
    joined = placed.join(split, "label").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("place", "words"))).alias("parts"))
    return joined.select("host", F.flatten(F.col("parts")["words"]).alias("words"))


def url_tokens(words: Column, path: Column) -> Column:
    pieces = F.filter(F.split(F.lower(path), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    named = F.transform(pieces, lambda t: F.concat(F.lit("p:"), F.when(t.rlike(r"^\d+$"), F.lit("<n>")).otherwise(t)))
    return F.concat(F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w)), named)


def fit_odds(urls: DataFrame) -> tuple[DataFrame, float]:
    """(token, odds), the log odds of block of every token of ``urls`` (tokens, listed), and the log odds of the class shares."""
    blocked, allowed = F.count(F.when(F.col("listed") == "block", 1)), F.count(F.when(F.col("listed") == "allow", 1))
    classes = urls.agg(blocked, allowed).first()
    counts = materialize(urls.select("listed", F.explode("tokens").alias("token")).groupBy("token").agg(blocked.alias("block"), allowed.alias("allow")))
    size, *sums = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0))).first()
    logs = [F.log(F.col(c) + 1.0) - F.lit(math.log(max(1, n + size))) for c, n in zip(("block", "allow"), sums)]
    return counts.select("token", (logs[0] - logs[1]).alias("odds")), math.log((classes[0] + 1) / (classes[1] + 1))


def judged(urls: DataFrame, odds: DataFrame, prior: float) -> DataFrame:
    """(row, block_odds) of the ``urls`` (row, tokens) that have tokens; odds are added in order of size, so that their sum does not depend on the run."""
    found = skew_safe_join(urls.select("row", F.explode("tokens").alias("token")), odds, ["token"])
    every = found.groupBy("row").agg(F.sort_array(F.collect_list("odds")).alias("every"))
    return every.select("row", F.aggregate("every", F.lit(prior), lambda total, x: total + x).alias("block_odds"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url", text: str | None = "html") -> DataFrame:
    """(key, host, path, rule, verdict, block_odds) of every row; without ``text`` host labels are words as they are."""
    parts = [c.alias(n) for n, c in host_and_path(F.col("url")).items()]
    rows = materialize(pages.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(url).alias("url")).select("row", "key", *parts))
    texts = pages.select(F.col(text).alias("text")) if text else pages.select(F.lit("").alias("text"))
    counts = materialize(word_counts(texts, "text"))
    words = materialize(host_words(rows.where("host <> ''").select("host").distinct(), counts))
    tokens = rows.withColumns(by_rules(rules)).join(words, "host", "left").withColumn("tokens", url_tokens(F.col("words"), F.col("path"))).drop("words")
    tokens = materialize(tokens)
    odds, prior = fit_odds(tokens)
    scored = tokens.join(judged(tokens, odds, prior), "row", "left").withColumn("block_odds", F.coalesce("block_odds", F.lit(prior)))
    method = F.when(F.col("block_odds") > 0, "block").otherwise("allow")
    return scored.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("listed", method).alias("verdict"), "block_odds")
