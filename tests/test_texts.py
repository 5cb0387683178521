import math
import re
from collections import Counter

import numpy as np
import pytest

from caseweave.operators import similarity
from caseweave.operators.checks import InputError


def brute(docs, threshold, k):
    """docs: [(id, block, text)] -> {(id, match): score} by direct TF-IDF."""
    out = {}
    for block in {b for _, b, _ in docs}:
        mine = [(i, Counter(re.findall(r"\b\w\w+\b", t.lower()))) for i, b, t in docs if b == block]
        if len(mine) < 2:
            continue
        df = Counter(w for _, c in mine for w in c)
        vectors = {}
        for i, c in mine:
            v = {w: n * (math.log((1 + len(mine)) / (1 + df[w])) + 1) for w, n in c.items()}
            length = math.sqrt(sum(x * x for x in v.values()))
            vectors[i] = {w: x / length for w, x in v.items()}
        for i in vectors:
            scored = [(round(min(1.0, sum(x * vectors[j].get(w, 0.0) for w, x in vectors[i].items())), 9), j) for j in vectors if j != i]
            kept = sorted(((s, j) for s, j in scored if s >= threshold), key=lambda x: (-x[0], x[1]))
            out.update({(i, j): s for s, j in kept[:k]})
    return out


def run(spark, docs, threshold=0.3, k=5):
    df = spark.createDataFrame([(i, b, t) for i, b, t in docs], "incident_id string, crime_type string, mo_text string")
    return {(r[0], r[1]): r[2] for r in similarity.cosine_top_k(df, threshold, k).collect()}


def close(got, want):
    assert got.keys() == want.keys()
    assert all(got[p] == pytest.approx(want[p], abs=1e-8) for p in want)


WORDS = ["knife", "night", "window", "car", "market", "phone", "gang", "rear", "lock", "atm", "forged", "bike"]


def made_up(n, seed, blocks=("a", "b")):
    rng = np.random.default_rng(seed)
    return [(f"{i:04d}", str(rng.choice(blocks)), " ".join(rng.choice(WORDS, size=rng.integers(1, 6)))) for i in range(n)]


@pytest.mark.parametrize("tile,words", [(512, 4096), (7, 3)])
@pytest.mark.parametrize("threshold", [0.0, 0.3, 0.8])
def test_matches_brute_force(spark, monkeypatch, tile, words, threshold):
    monkeypatch.setattr(similarity, "TILE_ROWS", tile)
    monkeypatch.setattr(similarity, "TILE_WORDS", words)
    docs = made_up(120, 11)
    close(run(spark, docs, threshold, 3), brute(docs, threshold, 3))


def test_a_profile_holding_most_incidents(spark):
    docs = [(f"{i:04d}", "a", "night window") for i in range(200)] + [("9000", "a", "night car"), ("9001", "a", "phone")]
    close(run(spark, docs, 0.1), brute(docs, 0.1, 5))


def test_blank_single_and_short_words(spark):
    docs = [("1", "a", "  "), ("2", "a", "x y"), ("3", "a", "lock atm"), ("4", "a", "LOCK, atm!"), ("5", "solo", "lock atm"), ("6", "a", "Éclair élan"), ("7", "a", "élan éclair")]
    got = run(spark, docs)
    assert got == {("3", "4"): 1.0, ("4", "3"): 1.0, ("6", "7"): 1.0, ("7", "6"): 1.0}


def test_column_order_and_missing_parts(spark):
    df = spark.createDataFrame([("1", None, " car ", "knife"), ("2", " ", None, "gun")], "incident_id string, crime_type string, vehicle_used string, weapon_used string")
    rows = {r["doc"]: (r["block"], r["text"]) for r in similarity.documents(df).collect()}
    assert rows == {"1": ("UNKNOWN", "knife car"), "2": (" ", "gun")}
    with pytest.raises(InputError):
        similarity.documents(df.select("incident_id"))


def test_tag_matches(spark):
    rows = [("n", ["a", "b"]), ("p", ["a", "b", "c", "d", "e"]), ("q", ["a"]), ("r", []), ("s", ["b", "a", "a"]), ("t", None)]
    df = spark.createDataFrame(rows, "fir_number string, mo_tags array<string>")
    got = {(r["source"], r["target"]): (r["shared_mo_tags"], r["similarity_score"]) for r in similarity.tag_matches(df.where("fir_number = 'n'"), df).collect()}
    assert got == {("n", "p"): (["a", "b"], 0.4), ("n", "q"): (["a"], 0.5), ("n", "s"): (["a", "b"], 1.0)}


def test_tag_sets_match_brute_force(spark):
    rng = np.random.default_rng(5)
    sets = {tuple(sorted(set(rng.choice(WORDS, size=rng.integers(1, 6))))) for _ in range(60)}
    df = spark.createDataFrame([(list(map(str, s)),) for s in sets], "tags array<string>")
    for t in (0.4, 0.75):
        got = {(tuple(r["tags_a"]), tuple(r["tags_b"])) for r in similarity.tag_set_matches(df, df, t).collect()}
        assert got == {(a, b) for a in sets for b in sets if len(set(a) & set(b)) / len(set(a) | set(b)) >= t}
