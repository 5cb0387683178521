"""Periodic runs, repeated windows and repaired conversations against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from caseweave.llm import conversation_repair, periodic_runs, queries, repeated_windows

DATA = "/root/testdata/sf0.001"
DICE = random.Random(29)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def said(n, letters="abcdefgh"):
    return [DICE.choice(letters) for _ in range(n)]


# Periodic runs


def all_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def looping(n, letters):
    w = said(n, letters)
    if w and DICE.random() < 0.6:
        a = DICE.randrange(n)
        p = DICE.randint(1, max(1, (n - a) // 3))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_grammar_answers_extensions():
    """How far two places agree, both ways, on strings with long blocks, many repeats and several texts."""
    for _ in range(60):
        texts = [looping(DICE.choice([0, 1, 7, 40, 150]), "abc"[: DICE.randint(1, 3)]) for _ in range(DICE.randint(1, 4))]
        flat, walls = [-1], [0]
        for number, t in enumerate(texts, 2):
            flat += [ord(x) for x in t] + [-number]
            walls.append(len(flat) - 1)
        places = [i for i, s in enumerate(flat) if s >= 0]
        if len(places) < 2:
            continue
        levels = periodic_runs.recompress(np.array(flat))
        assert max(b - a for a, b in zip(np.flatnonzero(levels[-1].symbols < 0), np.flatnonzero(levels[-1].symbols < 0)[1:])) <= 2
        pairs = [sorted(DICE.sample(places, 2)) for _ in range(80)]
        for forward, step in ((True, 1), (False, -1)):
            got = periodic_runs.agreement(levels, np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), forward)
            for (a, b), n in zip(pairs, got):
                k = 0
                while flat[a + step * k] == flat[b + step * k]:
                    k += 1
                assert k == n


def test_runs_of_texts(spark):
    texts = [None, "", " \n\t", "a", "a a a a a", "a a a a a a", "  " * 7, "x\x1cy " * 9, "é " * 5000 + "b", "ab cd " * 4 + "ab"]
    texts += [" ".join(looping(DICE.choice([3, 20, 60, 200]), "abcdefgh"[: DICE.randint(1, 8)])) for _ in range(150)] + ["a b " * 30] * 5
    docs = spark.createDataFrame([(None if i % 11 == 0 else i // 2, t, i, "z") for i, t in enumerate(texts)], "doc_id bigint, text string, key bigint, runs string")
    for size in (periodic_runs.SLICE, 50):
        out = {r.key: r for r in periodic_runs.periodic_runs(docs, key="key", slice_words=size).collect()}
        assert len(out) == len(texts)
        for i, t in enumerate(texts):
            w = words_of(t)
            runs = all_runs(w)
            assert out[i].n_words == len(w)
            assert [tuple(r) for r in out[i].runs] == runs
            assert out[i].collapsed == collapsed(w, runs)
    assert periodic_runs.periodic_runs(docs).count() == len(texts)
    assert periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.looped(docs.limit(0)))).count() == 0


def test_periodic_query(spark):
    rows = {r["doc_id"]: r["text"] for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}
    got = {r.doc_id: r for r in queries.op11_periodic_runs(spark, DATA).collect()}
    assert got.keys() == rows.keys()
    looped = 0
    for key, text in rows.items():
        w = words_of(text)
        n, h = len(w), zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            looped += 1
        runs = all_runs(w)
        r = got[key]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert (r.n_runs, r.runs_sha256) == (len(runs), sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)))
        assert r.collapsed_sha256 == sha(collapsed(w, runs))
    assert looped > 5


# Repeated windows


def without_repeats(texts, width):
    ws = [words_of(t) for t in texts]
    counts = Counter(tuple(w[i : i + width]) for w in ws for i in range(len(w) - width + 1))
    out = []
    for w in ws:
        gone = {j for i in range(len(w) - width + 1) if counts[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.fixture(scope="module")
def passages():
    vocabulary = [f"w{i}" for i in range(50)]
    shared, short = said(60, vocabulary), said(34, vocabulary)
    texts = [None, "", " \n", "a b", "a b " * 40]
    for i in range(120):
        w = said(DICE.randint(0, 120), vocabulary)
        w = said(DICE.randint(0, 20), vocabulary) + shared + said(DICE.randint(0, 20), vocabulary) if i % 3 == 0 else w
        texts.append(" ".join(w + (short if i % 5 == 0 else []) + (["x"] * DICE.randint(1, 100) if i % 7 == 0 else [])))
    return texts + texts[10:30] + texts[10:12] * 20 + [" ".join(said(3000, "ab"))]


@pytest.mark.parametrize("given", [{}, {"hot_rows": 3}, {"width": 5, "hot_rows": 2, "bits": 64}, {"width": 1}, {"width": 3, "bits": 128}])
def test_repeated_windows(spark, passages, given):
    """The same words go whichever minimisers are split and however full the table of bits is."""
    rows = [(None if i % 9 == 0 else i // 2, t, i, "z") for i, t in enumerate(passages)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key bigint, packed string").repartition(5)
    out = {r.key: (r.n_words, sum(s.end - s.start for s in r.spans), r.kept) for r in repeated_windows.repeated_windows(docs, key="key", **given).collect()}
    assert [out[i] for i in range(len(passages))] == without_repeats(passages, given.get("width", 35))


def test_repeated_windows_edges(spark):
    docs = spark.createDataFrame([(None, "a " * 40), (None, "a " * 36), (1, None)], "doc_id bigint, text string")
    out = sorted((r.n_words, r.kept) for r in repeated_windows.repeated_windows(docs).collect())
    assert out == [(0, ""), (36, ""), (40, "")]
    assert repeated_windows.repeated_windows(docs.limit(0)).count() == 0


def test_super_k_mers_cover_every_window_once():
    texts = [[w.encode() for w in said(n, "abcdefghijklmnop")] for n in (0, 34, 35, 36, 500)] + [[b"x"] * 100]
    cut = repeated_windows.Cut(texts, 35)
    covered = Counter((int(t), int(s) + i) for t, s, n in zip(cut.text, cut.start, cut.windows) for i in range(n))
    assert covered == Counter((t, i) for t, w in enumerate(texts) for i in range(len(w) - 34))
    assert cut.windows.max() <= repeated_windows.SPAN
    assert sum(cut.text == 4) < 466 / 8


def test_passages_query(spark):
    rows = pq.read_table(f"{DATA}/documents.parquet").to_pylist()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op12_repeated_passages(spark, DATA).collect()}
    expected = without_repeats([r["text"] for r in rows], 35)
    assert got == {r["doc_id"]: (n, gone, sha(kept)) for r, (n, gone, kept) in zip(rows, expected)}
    assert sum(gone for _, gone, _ in expected) > 100


# Conversations

PATTERN = re.compile(r"(s?(ua)+)?$")
OPEN = re.compile(r"(s?(ua)*u?)?$")


def cheapest(rows):
    """(cost, audit, repaired rows) by a search over whole audits; rows are (role, text, fault)."""
    heap, met = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, initials, kept = heapq.heappop(heap)
        if (i, initials[-1:]) in met:
            continue
        met.add((i, initials[-1:]))
        if i == len(rows) and PATTERN.match(initials):
            return cost, audit, kept
        ways = [(5, "I", i, r) for r in ("user", "assistant")]
        if i < len(rows):
            role, _, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, initials, kept))
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                ways += [(1 + extra, "R", i + 1, r) for r in ("user", "assistant")]
                ways += [(extra, "K", i + 1, role)] if role[:1] in ("s", "u", "a") else []
        for more, letter, j, role in ways:
            if OPEN.match(initials + role[0]):
                heapq.heappush(heap, (cost + more, audit + letter, j, initials + role[0], (*kept, (role, rows[i][1] if letter != "I" else ""))))


def test_search():
    for _ in range(1500):
        rows = [
            (DICE.choice(["user", "assistant", "system", "tool", "", " "][: DICE.choice([2, 3, 6])]), "x", DICE.choice([None, None, "blank", "duplicate", "truncated"][: DICE.choice([1, 2, 5])]))
            for _ in range(DICE.randint(0, 14))
        ]
        search = conversation_repair.Repair()
        out = []
        for n, (role, text, fault) in enumerate(rows):
            search.row(n, role, text, fault)
            out += search.taken()
        search.end()
        out += search.taken()
        cost, audit, _ = cheapest(rows)
        assert (sum(e[-1] for e in out), "".join(e[0] for e in out)) == (cost, audit)
        assert PATTERN.match("".join(e[3][:1] for e in out if e[0] != "D"))


def held(search):
    todo, n = [search.root], 0
    while todo:
        n += 1
        todo += todo.pop().later
    return n


@pytest.mark.parametrize("faults", [[None], ["blank"], [None, "blank", "truncated"]])
def test_search_holds_what_is_undecided(faults):
    """Edits leave while rows arrive; a tree of 20,000 rows stays small."""
    search, largest, out = conversation_repair.Repair(), 0, 0
    for n in range(20_000):
        search.row(n, DICE.choice(["user", "assistant"]), "x", DICE.choice(faults))
        out += len(search.taken())
        largest = max(largest, held(search)) if n % 50 == 0 else largest
    assert largest < 2_000 and out > 15_000


def described(rows):
    """The totals of one conversation's rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    met, faults, judged = set(), Counter(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]+$", "", text)
        fault = "blank" if not words_of(text) else "duplicate" if (role, text) in met else "truncated" if solid[-1] not in ".!?" else None
        met.add((role, text))
        faults[fault] += 1
        judged.append((role, text, fault))
    initials = [r[:1] for r, _, _ in judged]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = {t for t, _, _ in rows if t is not None}
    cost, audit, kept = cheapest(judged)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in kept))


def audits(rows):
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        plain = lambda v: " " if v is None else v
        h = zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20
        role, text = "user" if h == 4 else plain(role), "" if h == 1 else re.sub("[.!?]", "", plain(text)) if h == 2 else plain(text)
        groups[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(h, 1)
    return {conv: described(g) for conv, g in groups.items()}


def as_dict(df):
    return {r.conv_id: tuple(r)[1:] for r in df.select("conv_id", *conversation_repair.TOTALS).collect()}


def test_conversations(spark):
    roles, lines = ["user", "assistant", "system", "tool", "", None], ["Yes.", "No", "Why?", " ", "", None, "Ok. \n", " ", "x" * 30_000 + "!"]
    rows = [(None if c == 7 else c, DICE.choice([None, t, t, t + 1, 3]), DICE.choice(roles), DICE.choice(lines)) for c in range(60) for t in range(DICE.randint(1, 12))]
    rows += rows[:40] + [(100, None, "user", "Hi."), (101, None, None, None), *[(102, t, "user", "All the same.") for t in range(50)]]
    table = spark.createDataFrame([(*r, "z", "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, conversation string, fault string").repartition(4)
    assert as_dict(conversation_repair.audited(table)) == audits(rows)
    assert conversation_repair.audited(table.limit(0)).count() == 0
    edits = conversation_repair.repair(table.where("conv_id = 102")).orderBy("step").collect()
    assert [(e.step, e.edit, e.fault) for e in edits] == [(n, "D", "duplicate" if n else None) for n in range(50)]


def test_conversations_query(spark):
    rows = [tuple(r.values()) for r in pq.read_table(f"{DATA}/conversations.parquet", columns=["conv_id", "turn", "role", "text"]).to_pylist()]
    expected = audits(rows)
    assert as_dict(queries.op13_repair_conversations(spark, DATA)) == expected
    assert len({e[6] for e in expected.values()}) > 3


def test_dropped_conversation_stays(spark):
    keys = [k for k in range(500) if zlib.crc32(f"{k}:0".encode()) % 20 == 0][:2]
    out = conversation_repair.audited(spark.range(0).select(F.lit(0).alias("conv_id"), F.lit(0).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text")).union(
        spark.createDataFrame([(k, 0, "user", "Hi.") for k in keys], "conv_id int, turn int, role string, text string")))
    assert {tuple(r)[1:] for r in out.collect()} == {(0, 0, 0, 0, 0, 0, "", sha(""))}
