"""The pipeline and the queries without SQL on the smallest supplied tables, against brute force."""

import zlib

import corpus_pipeline
import numpy as np
import pyarrow.parquet as pq
import pytest
from test_links import base, components, contamination, fingerprint
from test_tokens import WORDS, library

from caseweave.llm.common import materialize, table
from caseweave.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The rows of every stage, input first."""
    rows = [table(spark, FOLDER, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        rows.append(materialize(stage(spark, rows[-1], FOLDER)))
    return rows


def texts(df) -> dict:
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns_and_only_drop(stages):
    for before, after in zip(stages[:-2], stages[1:-1]):
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert texts(after).items() <= texts(before).items()


def test_classifier_keeps_the_good(stages):
    kept = set(texts(stages[1]))
    marks = pq.read_table(f"{FOLDER}/labels.parquet").to_pylist()
    good = [r["doc_id"] in kept for r in marks if r["quality"] == 1]
    bad = [r["doc_id"] in kept for r in marks if r["quality"] == 0]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.2


def test_rules_drop_no_more_than_the_base(stages):
    """The smallest tables have too few labels to certify a cutoff."""
    want = set()
    for key, text in texts(stages[1]).items():
        words, _, _, _, repeats = base(text)
        if not (words < 10 or 100 * repeats > 20 * words):
            want.add(key)
    assert set(texts(stages[2])) == want


def test_one_of_each_group_stays(stages):
    assert set(texts(stages[3])) == set(components({k: fingerprint(t) for k, t in texts(stages[2]).items()}).values())


def test_no_contaminated_document_is_left(stages):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{FOLDER}/benchmark.parquet").to_pylist()]
    judged = contamination(list(texts(stages[3]).items()), items)
    assert set(texts(stages[4])) == {r[0] for r in judged if not r[5]}


def test_packed_pieces(spark, stages):
    ids = library(WORDS)
    want = set()
    for key, text in texts(stages[4]).items():
        own = np.append(ids(text), 0).astype("<u4")
        want |= {(key, p, s, len(own[s : s + 2048]), zlib.crc32(own[s : s + 2048].tobytes())) for p, s in enumerate(range(0, len(own), 2048))}
    rows = [tuple(r) for r in stages[5].collect()]
    assert {r[:5] for r in rows} == want and len(rows) == len(want)
    assert len({r[5] for r in rows}) <= -(-sum(r[3] for r in rows) // 2048) + 1
    whole = [tuple(r)[:5] for r in corpus_pipeline.run(spark, FOLDER).collect()]
    assert set(whole) == want


def test_query_near_duplicates(spark):
    prints = {k: fingerprint(t) for k, t in texts(table(spark, FOLDER, "documents")).items()}
    least = components(prints)
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op8_near_duplicates"][0](spark, FOLDER).collect()}
    assert out == {k: (f"{p:016x}", least[k]) for k, p in prints.items()}


def test_query_decontaminate(spark):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{FOLDER}/benchmark.parquet").to_pylist()]
    out = QUERIES["op4_decontaminate"][0](spark, FOLDER).collect()
    assert sorted(map(tuple, out), key=repr) == contamination(list(texts(table(spark, FOLDER, "documents")).items()), items)


@pytest.mark.parametrize("name", [n for n in QUERIES if n != "op2_page_archives"])
def test_every_document_or_page_has_its_rows(spark, name):
    source, key = {"op10": ("pages", "page_id"), "op13": ("conversations", "conv_id")}.get(name.split("_")[0], ("documents", "doc_id"))
    every = table(spark, FOLDER, source)
    assert QUERIES[name][0](spark, FOLDER).select(key).distinct().count() == every.select(key).distinct().count()


def test_stages_take_any_rows(spark, tmp_path):
    """Columns that clash with what stages add, null texts, null and repeated ids, a very long text, and empty tables."""
    good = [r["text"] for r in pq.read_table(f"{FOLDER}/documents.parquet").to_pylist()][:60]
    names = ["n_words", "hits", "n_hit", "words", "doc", "row", "key", "text_digest", "contaminated", "_doc", "score", "stratum"]
    rows = [(None if i % 7 == 0 else i // 2, t, "en", "s", *["mine"] * len(names)) for i, t in enumerate([*good, None, "", " ", " ".join(good) * 3])]
    schema = "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names)
    for part, n in ((rows, "some"), ([], "none")):
        folder = f"{tmp_path}/{n}"
        spark.createDataFrame(part, schema).write.parquet(f"{folder}/documents.parquet")
        for other in ("labels", "benchmark"):
            frame = table(spark, FOLDER, other)
            (frame if part else frame.limit(0)).write.parquet(f"{folder}/{other}.parquet")
        docs = table(spark, folder, "documents")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = materialize(stage(spark, docs, folder))
            assert kept.columns == docs.columns
            assert kept.where(" or ".join(f"{c} <> 'mine'" for c in names)).isEmpty()
            assert kept.exceptAll(docs).isEmpty()
            docs = kept
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
        assert pieces.where("piece = 0").count() == docs.count()
        assert (docs.count() > 0) == bool(part)
