"""Quality rules whose cutoffs carry a statistical guarantee. DataFrame functions only.

Each rule rejects a document whose measure exceeds a cutoff. Labels are dealt into two folds by a hash of the key. For each stratum and
rule, the cutoffs of a fixed grid are tested on the second fold, loosest first: a cutoff is certified if the exact binomial
tail shows that a rule which rejects a share of ``risk`` of good documents would hardly ever reject so few, and if all looser ones
are. Testing in a fixed order needs no correction within a rule; across strata and rules ``doubt`` is divided by their number
(Bonferroni), and ``risk`` is divided by the number of rules, so that with a probability of at least 1 - ``doubt`` every stratum loses at most
the share ``risk`` of its good documents. Among certified cutoffs the first fold picks the one that best tells bad from good, so
none is tightened without use. A rule without a certified or useful cutoff rejects nothing in that stratum.

Base measures (``base_measures``) are computed whole, inside the row of a document: repeated 5-word windows are found by sorting window
hashes, compared as words where hashes agree, so no document is exploded or shuffled.

Edges: null and empty texts have no words and fail the base rule. A null stratum is the stratum ``none``. Labels without a document, or with
a null quality, are ignored; of several labels for one key the lowest counts. Strata without labels have no cutoffs. Repeated rows are
judged each. An empty table gives an empty result; extra columns are kept by ``keep``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, blank_words, crc32_of, materialize, once, stored

RISK = 0.02
DOUBT = 0.05
WINDOW = 5
#: A good document rejected weighs as much as this share of bad ones kept, when a certified cutoff is picked.
WEIGHT = 10.0
#: Steps of each rule's grid, from 0 to 1.
STEPS = 200
#: More strata than this are joined by shuffle instead of broadcast.
FEW_STRATA = 10_000

RULES = {
    "symbols": lambda: F.col("n_symbols") / F.greatest(F.col("n_words"), F.lit(1)),
    "dup_lines": lambda: F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    "repeats": lambda: F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
    "long_words": lambda: F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)) / 20,
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words which the text has twice or more; ``words`` must be a plain column."""

    def at(i: Column) -> Column:
        return F.slice(words, i + 1, window)

    places = F.sequence(F.lit(0), F.size(words) - window)
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            def same(a: Column, b: Column) -> Column:
                return F.when(a["h"] == b["h"], at(a["i"]) == at(b["i"])).otherwise(False)

            def doubled(x: Column, k: Column) -> Column:
                before = F.when(k > 0, same(x, F.get(s, k - 1))).otherwise(False)
                after = F.when(k < F.size(s) - 1, same(x, F.get(s, k + 1))).otherwise(False)
                return before | after

            return F.sort_array(F.transform(F.filter(s, doubled), lambda x: x["i"]))

        def total(p: Column) -> Column:
            """Union of the windows that start at the ascending places ``p``."""
            start = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
            step = lambda a, i: F.struct((a["n"] + F.least(F.lit(window), i - a["last"])).alias("n"), i.alias("last"))
            return F.aggregate(p, start, step, lambda a: a["n"])

        return inside(ordered, lambda s: inside(marked(s), total))

    some = inside(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))
    return F.when(F.size(words) > window, some).otherwise(F.lit(0))


def inside(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures of BASE and n_lines; columns of these names are replaced."""
    whole = F.coalesce(F.col(text), F.lit(""))
    has_word = lambda line: F.btrim(line, F.lit(BLANKS)) != ""
    split = docs.drop(*BASE, "n_lines", "_words", "_lines").withColumns(
        {"_words": once(blank_words(F.col(text))), "_lines": once(F.filter(F.split(whole, "\n"), has_word))}
    )
    measures = {
        "n_words": F.size("_words").cast("bigint"),
        "word_chars": F.char_length(F.array_join("_words", "")).cast("bigint"),
        "n_symbols": F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("bigint"),
        "n_lines": F.size("_lines").cast("bigint"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
        "n_repeat_words": repeat_words(F.col("_words")).cast("bigint"),
    }
    return split.withColumns({name: once(value) for name, value in measures.items()}).drop("_words", "_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def stratum_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("none"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of n draws with share p, summed exactly from the logarithms of its terms."""
    first = F.struct((n * F.log1p(F.lit(-p))).alias("term"), F.exp(n * F.log1p(F.lit(-p))).alias("sum"))
    odds = F.log(F.lit(p / (1 - p)))

    def add(a: Column, i: Column) -> Column:
        term = a["term"] + F.log((n - i + 1) / i) + odds
        return F.struct(term.alias("term"), (a["sum"] + F.exp(term)).alias("sum"))

    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, first, add, lambda a: a["sum"])


def step_of(measure: Column) -> Column:
    """The step of the grid up to which a measure reaches; a cutoff rejects the steps above it."""
    return F.least(F.ceil(measure * STEPS), F.lit(STEPS + 1)).cast("int")


def fit_cutoffs(measured: DataFrame, labels: DataFrame, key: str = "doc_id", quality: str = "quality", stratum: str = "stratum", risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """(stratum, a step of the grid per rule): the certified cutoffs, null where a rule has none.

    ``measured`` has the key, the stratum and the base measures; its documents that fail the base rule do not count.
    """
    marks = labels.where(F.col(quality).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min(quality).alias("_good"))
    known = measured.where(~base_failed()).join(marks, F.col(key) == F.col("_key"))
    share = risk / len(RULES)
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), step_of(value()).alias("step")) for name, value in RULES.items()]))
    tested = F.pmod(crc32_of(F.col("_key")), F.lit(2)) == 0
    good = F.col("_good") >= 1
    ones = lambda condition: F.count(F.when(condition, 1))
    counts = known.select(stratum, good.alias("good"), tested.alias("tested"), each.alias("e")).groupBy(stratum, "e.rule", "e.step").agg(
        ones(F.col("tested") & F.col("good")).alias("held"), ones(~F.col("tested") & F.col("good")).alias("good"), ones(~F.col("tested") & ~F.col("good")).alias("bad")
    )
    # Every cutoff of the grid, also between the steps that have documents. At most STEPS + 2 rows per stratum and rule from here on.
    grid = counts.select(stratum, "rule").distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(STEPS + 1))))
    filled = grid.join(counts, [stratum, "rule", "step"], "left").fillna(0, ["held", "good", "bad"])
    of_rule = Window.partitionBy(stratum, "rule")
    above = of_rule.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = {f"{c}_{w}": F.coalesce(F.sum(c).over(over), F.lit(0)) for c in ("held", "good", "bad") for w, over in (("above", above), ("all", of_rule))}
    families = filled.select(stratum, "rule").distinct().agg(F.greatest(F.count(F.lit(1)), F.lit(1))).scalar()
    tail = F.when(F.col("held_above") > F.col("held_all") * share, F.lit(1.0)).otherwise(binomial_tail(F.col("held_above"), F.col("held_all"), share))
    proved = filled.withColumns(totals).withColumn("passes", (F.col("held_all") > 0) & (tail <= F.lit(doubt) / families))
    so_far = of_rule.orderBy(F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    gain = F.col("bad_above") / F.greatest("bad_all", F.lit(1)) - WEIGHT * F.col("good_above") / F.greatest("good_all", F.lit(1))
    certified = proved.where("step <= " + str(STEPS)).withColumn("certified", F.min("passes").over(so_far)).withColumn("gain", gain).where("certified and gain > 0")
    chosen = certified.groupBy(stratum, "rule").agg(F.max(F.struct("gain", "step"))["step"].alias("step"))
    return chosen.groupBy(stratum).agg(*[F.max(F.when(F.col("rule") == name, F.col("step"))).alias(f"_cut_{name}") for name in RULES])


def with_verdict(measured: DataFrame, cutoffs: DataFrame, stratum: str = "stratum") -> DataFrame:
    """``measured`` with (base_failed, kept). ``cutoffs`` should be materialized; it has a row per stratum."""
    few = cutoffs.limit(FEW_STRATA + 1).count() <= FEW_STRATA
    joined = measured.join(F.broadcast(cutoffs) if few else cutoffs, stratum, "left")
    rejects = reduce(lambda a, b: a | b, [F.coalesce(step_of(value()) > F.col(f"_cut_{name}"), F.lit(False)) for name, value in RULES.items()])
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~rejects).drop(*[f"_cut_{n}" for n in RULES])


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """(key, base measures, base_failed, kept) of every row."""
    measured = materialize(with_base(docs.select(key, text, stratum_of(stratum).alias("stratum")), text).drop(text))
    cutoffs = stored(fit_cutoffs(measured, labels, key, risk=risk, doubt=doubt), 1)  # a row per stratum
    return with_verdict(measured, cutoffs).select(key, *BASE, "base_failed", "kept")


def keep(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang", risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """The rows of ``docs`` that pass. Texts are measured twice, to fit and to judge, and never shuffled."""
    measured = materialize(with_base(docs.select(key, text, stratum_of(stratum).alias("stratum")), text).drop(text))
    cutoffs = stored(fit_cutoffs(measured, labels, key, risk=risk, doubt=doubt), 1)  # a row per stratum
    whole = F.struct(*docs.columns)
    fresh = with_base(docs.select(F.col(text).alias("text"), stratum_of(stratum).alias("stratum"), whole.alias("_row")))
    return with_verdict(fresh, cutoffs).where("kept").select("_row.*")
