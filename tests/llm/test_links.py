"""Near-duplicates, decontamination and quality rules against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import xxhash
from pyspark.sql import functions as F

from caseweave.llm import decontamination, near_duplicates, quality_rules

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DICE = random.Random(11)


def spelled(n: int, letters: str = "abcABC") -> str:
    return " ".join(DICE.choice(letters) for _ in range(n))


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def components(prints: dict) -> dict:
    parent = {k: k for k in prints}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {k: root(k) for k in prints}


def test_fingerprints():
    for text in (None, "", " \n", "One", "one TWO", "É é one two three", spelled(500), "a\x0bb\x1cc d\u00a0e", "x " * 70_000):
        assert near_duplicates.simhash(text) & (1 << 64) - 1 == fingerprint(text)


def test_near_duplicates(spark):
    base = [spelled(40, "abcdefghij") for _ in range(30)]
    rows = list(enumerate(base + base[:5] + [b + " a" for b in base] + [None, "", " ", "a b"]))
    docs = spark.createDataFrame([(k, t, "clash") for k, t in rows], "doc_id bigint, text string, fp string")
    prints = {k: fingerprint(t) for k, t in rows}
    least = components(prints)
    for shard in (2048, 2):
        out = near_duplicates.near_duplicates(docs, shard=shard).collect()
        assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == {k: (f"{prints[k]:016x}", least[k]) for k in prints}
    kept = near_duplicates.keep_first(docs.unionByName(docs))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0


def test_one_of_each_group_stays_without_keys(spark):
    """Rows without a key, and rows of one key whose texts are in different groups, stand for their groups like any other."""
    a, b, c, d = (spelled(40, "abcdefghij") for _ in range(4))
    rows = [(None, a), (None, a), (None, b), (5, b), (7, c), (7, d), (7, d), (8, d), (None, None), (None, "")]
    schema = "doc_id bigint, text string, row string, doc string"
    for order in (rows, rows[::-1]):
        kept = near_duplicates.keep_first(spark.createDataFrame([(k, t, "clash", "clash") for k, t in order], schema).repartition(3))
        got = [(r.doc_id, r.text or "") for r in kept.collect()]
        assert sorted(got, key=repr) == sorted([(None, a), (5, b), (7, c), (7, d), (None, "")], key=repr)
    alike = [(1, " ".join(["same"] * n)) for n in (30, 31)]  # of one key and one group
    assert fingerprint(alike[0][1]) == fingerprint(alike[1][1])
    stays = {near_duplicates.keep_first(spark.createDataFrame(o, "doc_id bigint, text string")).first().text for o in (alike, alike[::-1])}
    assert len(stays) == 1


def test_chains_link_through_every_shard_level(spark):
    """Fingerprints that differ in one or two bits of any places; chains are longer than the radius."""
    prints = {0: 0}
    for k in range(1, 300):
        value = prints[DICE.randrange(k)]
        for bit in DICE.sample(range(64), DICE.choice((1, 2, 2, 9))):
            value ^= 1 << bit
        prints[k] = value
    frame = spark.createDataFrame([(near_duplicates.signed(p),) for p in set(prints.values())], "fp bigint")
    want = components({p: p for p in prints.values()})
    for shard in (2048, 1):
        links = [(r.u & (1 << 64) - 1, r.v & (1 << 64) - 1) for r in near_duplicates.links_within(frame, shard=shard).collect()]
        parent = {p: p for p in want}

        def root(p):
            while parent[p] != p:
                p = parent[p]
            return p

        for a, b in links:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
        assert {p: root(p) for p in want} == want


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contamination(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        n = min(13, len(words))
        for o in range(len(words) - n + 1 if words else 0):
            windows[tuple(words[o : o + n])].add(item)
    out = []
    for key, text in docs:
        words, hit, found = words_of(text), set(), set()
        for n in {len(w) for w in windows}:
            for p in range(len(words) - n + 1):
                if items_there := windows.get(tuple(words[p : p + n])):
                    hit.update(range(p, p + n))
                    found |= items_there
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((key, len(words), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(words)))
    return sorted(out, key=repr)


def test_contamination(spark):
    letters = ["a", "B", "b", "c", "É", "é", "A"]
    text = lambda n: "".join(DICE.choice(letters) + DICE.choice([" ", ". ", " ", "-"]) for _ in range(n))
    docs = [(k, text(DICE.choice([0, 3, 20, 60]))) for k in range(150)] + [(500, None), (501, "--"), (3, text(30)), (None, text(40)), (502, text(4000))]
    items = [(i, text(DICE.choice([0, 1, 2, 3, 14, 16]))) for i in range(25)] + [(99, docs[7][1]), (99, "a b"), (99, "a b"), (98, "unseen"), (97, None), (96, docs[9][1])]
    frame = spark.createDataFrame([(k, t, 1, "y") for k, t in docs], "doc_id bigint, text string, n_hit int, words string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    out = decontamination.contamination(frame, bench)
    assert sorted(map(tuple, out.select(*columns).collect()), key=repr) == contamination(docs, items)
    assert "words" in out.columns
    nothing = decontamination.contamination(frame, bench.limit(0)).agg(F.sum("n_hit"), F.count(F.lit(1))).first()
    assert tuple(nothing) == (0, len(docs))
    assert decontamination.contamination(frame.limit(0), bench).count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x a y y b z a b"), (2, "a only"), (3, "b y y y y y a"), (4, None)], "doc_id bigint, text string")
    terms = spark.createDataFrame([("q", "a"), ("q", "b")], "query string, term string")
    index = decontamination.build_index(docs)
    out = {tuple(r) for r in decontamination.proximity_matches(index, terms, 2).collect()}
    assert out == {("q", 1, 1, 4), ("q", 1, 4, 6), ("q", 1, 6, 7)}


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, hit, seen, dup = Counter(windows), set(), set(), 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            hit.update(range(i, i + 5))
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_base_measures(spark):
    texts = [None, "", " \n\t", "a b c d e a b c d e", "x " * 5, "x " * 6, "x " * 300, "É é\nb\nb\n \n \nb ", "#*$ |<>&%", spelled(400, "ab"), "\n".join(["a\x1cb c d e f"] * 3)]
    docs = spark.createDataFrame([(k, t, "en", 7) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, n_words int")
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1)], "doc_id bigint, quality int")
    out = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    for k, text in enumerate(texts):
        got = base(text)
        assert tuple(out[k])[1:6] == got
        failed = got[0] < 10 or 100 * got[4] > 20 * got[0]
        assert (out[k].base_failed, out[k].kept) == (failed, not failed)
    assert quality_rules.keep(docs, labels).columns == docs.columns
    assert quality_rules.judge(docs.limit(0), labels).count() == 0


def test_binomial_tail(spark):
    cases = [(0, 10), (1, 10), (3, 50), (10, 400), (0, 40_000), (150, 40_000)]
    out = spark.createDataFrame(cases, "k bigint, n bigint").select(quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.02)).collect()
    for (k, n), (got,) in zip(cases, out):
        exact = sum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(0.02) + (n - i) * math.log(0.98)) for i in range(k + 1))
        assert math.isclose(got, exact, rel_tol=1e-6)


def test_cutoffs_are_certified(spark):
    """Enough labels certify the symbol rule in one stratum; the other has too few and gets no cutoff."""
    rows = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, "few").otherwise("many").alias("stratum"), F.lit(100).cast("bigint").alias("n_words"),
        F.lit(500).cast("bigint").alias("word_chars"), F.when(F.col("id") % 10 == 3, 60).when(F.col("id") % 10 == 4, 2).otherwise(0).cast("bigint").alias("n_symbols"),
        F.lit(10).cast("bigint").alias("n_lines"), F.lit(0).cast("bigint").alias("n_dup_lines"), F.lit(0).cast("bigint").alias("n_repeat_words"),
    )
    labels = rows.select("doc_id", (F.col("doc_id") % 10 != 3).cast("int").alias("quality"))
    cutoffs = {r.stratum: r for r in quality_rules.fit_cutoffs(rows, labels).collect()}
    step = cutoffs["many"]._cut_symbols / quality_rules.STEPS
    assert 0.02 <= step < 0.6
    assert "few" not in cutoffs or cutoffs["few"]._cut_symbols is None
    kept = quality_rules.with_verdict(rows, quality_rules.fit_cutoffs(rows, labels)).where("stratum = 'many' and kept").select("n_symbols").distinct().collect()
    assert {r[0] for r in kept} == {0, 2}
