"""Matches of new texts by the stored index against all pairs."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from caseweave.streaming.text_index import TextIndex, run_text_matches, text_matches

SCHEMA = "incident_id string, crime_type string, narrative string, block string"


def vectors(texts, reference):
    """Unit vectors of (block, text) with the word weights of ``reference``."""
    sizes, df = Counter(), Counter()
    for block, text in reference:
        sizes[block] += 1
        df.update((block, t) for t in set(re.findall(r"\w\w+", text.lower())))
    out = []
    for block, text in texts:
        tf = Counter(re.findall(r"\w\w+", text.lower()))
        v = {t: n * (math.log((1 + sizes[block]) / (1 + df[block, t])) + 1) for t, n in tf.items()}
        length = math.sqrt(sum(x * x for x in v.values())) or 1
        out.append({t: x / length for t, x in v.items()})
    return out


def best(rows, reference, batches, threshold, top_k):
    """The matches of every incident among those of its batch and of earlier ones."""
    vs = vectors([(b or "UNKNOWN", t or "") for _, b, t in rows], [(b or "UNKNOWN", t or "") for _, b, t in reference])
    out = defaultdict(list)
    for (i, x), v, m in zip(enumerate(rows), vs, batches):
        for (j, y), w, n in zip(enumerate(rows), vs, batches):
            if i != j and n <= m and x[1] == y[1]:
                s = round(min(1.0, sum(a * w.get(t, 0) for t, a in v.items())), 9)
                if s >= threshold:
                    out[x[0]].append((-s, y[0]))
    return {k: [(m, round(-s, 6)) for s, m in sorted(v)[:top_k]] for k, v in out.items()}


def found(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.incident_id].append((-r.similarity_score, r.matched_incident_id))
    return {k: [(m, round(-s, 6)) for s, m in sorted(v)] for k, v in out.items()}


@pytest.fixture(scope="module")
def incidents():
    dice = random.Random(4)
    words = [f"word{i}" for i in range(25)]
    rows = []
    for i in range(90):
        text = " ".join(["common"] + [dice.choice(words) for _ in range(dice.randint(0, 6))])
        rows.append((f"i{i:03d}", dice.choice(["a", "b", None]), dice.choice([text, text, text, "same words again", None, ""])))
    return rows


@pytest.mark.parametrize("threshold,top_k", [(0.3, 5), (0.8, 2)])
def test_batches(spark, tmp_path, incidents, threshold, top_k):
    batches = [i % 3 for i in range(len(incidents))]
    frame = lambda rows: spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).drop("block")
    index = TextIndex(spark, str(tmp_path), threshold, top_k, buckets=3)
    index.freeze(frame(incidents[:30]))
    got = {}
    for n in range(3):
        rows = [r for r, b in zip(incidents, batches) if b == n]
        first = found(index.add(frame(rows), n))
        again = found(index.add(frame(rows), n))  # a replay adds nothing
        assert first == again
        got.update(first)
        if n == 1:
            index.postings.compact(0)
            index.members.compact(1)
    assert got == best(incidents, incidents[:30], batches, threshold, top_k)
    assert found(index.add(frame([]), 3)) == {}


def test_earlier_texts_are_not_read(spark, tmp_path, incidents):
    schema = "incident_id string, crime_type string, narrative string"
    for n in range(2):
        spark.createDataFrame([r for i, r in enumerate(incidents) if i % 2 == n], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        run_text_matches(stream, spark.createDataFrame(incidents, schema) if n == 0 else None, f"{tmp_path}/t", f"{tmp_path}/cp", buckets=3)
        for name in (tmp_path / "in" / str(n)).glob("*.parquet"):
            name.write_bytes(b"")  # whoever reads it again fails
    assert found(text_matches(spark, f"{tmp_path}/t")) == best(incidents, incidents, [i % 2 for i in range(len(incidents))], 0.3, 5)
