"""Encoding, counting, token files and packing against the tokenizers library."""

import io
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from caseweave.llm import packing, token_blocks, token_counts
from caseweave.llm.common import slices_of_bytes
from caseweave.llm.encode import TextEncoder, never_joined

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = [" ", "  ", "\n", "a", "B", "é", ".", ",", "1", "<|endoftext|>", "\t", "'s", "日", "!", "\x1c", "\u0301", "th", "ing", "***", " the", "\u00a0"]
ODD = ["", " ", "\n", " a", "a ", "a\n", "\na", "a  b", "a \n b", "x<|endoftext|> y", "ΑΣ. İx", "don't we'll 's", "\r\n\t x\ty", "foo, <|end bar.", "a" * 3000]


def texts(n: int) -> list[str]:
    dice = random.Random(7)
    return ODD + ["".join(dice.choice(PARTS) for _ in range(dice.randint(1, 30))) for _ in range(n)]


def library(path: str):
    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


ROWS = [(1, "The first, the second."), (2, None), (3, ""), (4, "word " * 3000), (5, "The first, the second."), (5, "The first, the second."), (None, "no key"), (6, "<|endoftext|> x")]


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id bigint, text string, n_tokens string, piece int")


@pytest.mark.parametrize("path", [BYTES, WORDS])
@pytest.mark.parametrize("remembered", [1_000_000, 40])
def test_encoder_equals_library(path, remembered):
    encoder, ids = TextEncoder(path, remembered), library(path)
    assert encoder.kind in ("leading", "dropped")
    for text in texts(1500):
        assert encoder.encode(text) == ids(text).tobytes(), repr(text)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_special_strings_in_capitals(path):
    """Lower-cased they equal the special string, which they are not; words around and after them keep their own ids."""
    encoder, ids = TextEncoder(path), library(path)
    for text in (
        "hello <|ENDOFTEXT|> planet-9 a,b see x.y", "x.y a,b planet-9", "<|EndOfText|>", "q-1 <|endoftext|> r-2 <|ENDOFTEXT|>z s-3", "q-1 r-2 s-3 <|endoftext|>",
        "é <|ENDOFTEXT|> t-4 u-5", "<|ENDOFTEXT|><|endoftext|>", "<|endoftext|><|ENDOFTEXT|>", "a <|endoftext|> B-6",
    ):
        assert encoder.encode(text) == ids(text).tobytes(), text


def test_counter_equals_library():
    ids = library(BYTES)
    for remembered in (1000, 20):
        counter = token_counts.MergeCounter(BYTES, remembered)
        for text in texts(1500):
            assert counter.count(text) == len(ids(text)), repr(text)


def test_counts(spark):
    ids = library(BYTES)
    out = [tuple(r) for r in token_counts.token_counts(documents(spark), BYTES).collect()]
    want = [(k, len((t or "").encode()), len(ids(t)), len(ids(t)) > 1024) for k, t in ROWS]
    assert sorted(out, key=repr) == sorted(want, key=repr)
    assert token_counts.token_counts(documents(spark, []), BYTES).count() == 0


@pytest.mark.parametrize("width", range(33))
def test_block_round_trip(width):
    dice = np.random.default_rng(width)
    ids = dice.integers(0, 2**width, 1000, dtype=np.uint64).astype("<u4")
    ids[::50] = dice.integers(0, 2**32, 20, dtype=np.uint64)
    for n in (1, 7, 1000):
        assert (token_blocks.unpack_block(b"xx" + token_blocks.pack_block(ids[:n]) + b"yy", 2) == ids[:n]).all()


def test_file_random_access():
    dice = np.random.default_rng(1)
    docs = [dice.integers(0, 50_000, n).astype("<u4") for n in (1, 5000, 0, 70_000, 1024, 3)]
    out = io.BytesIO()
    writer = token_blocks.BlockWriter(out)
    for key, ids in enumerate(docs):
        writer.add(key if key else None, ids.tobytes())
    writer.close()
    reader = token_blocks.BlockReader(io.BytesIO(out.getvalue()), len(out.getvalue()))
    every = np.concatenate(docs)
    assert [(k, s, i.tolist()) for k, s, i in reader.documents(3)] == [(k or None, sum(map(len, docs[:k])), d.tolist()) for k, d in enumerate(docs)]
    for start, n in ((0, 1), (1023, 2), (4000, 9000), (76_000, 28), (5, 0)):
        assert (reader.ids(start, n) == every[start : start + n]).all()


def test_token_files(spark):
    ids = library(BYTES)
    out = token_blocks.read_token_files(token_blocks.write_token_files(documents(spark), BYTES), with_ids=True).collect()
    want, start = [], 0
    for key, text in sorted(ROWS, key=lambda r: (r[0] is not None, r[0], r[1] or "")):
        own = np.append(ids(text), 0).astype("<u4")
        want.append((key, start, len(own), zlib.crc32(own.tobytes()), own.tolist()))
        start += len(own)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == want
    assert token_blocks.read_token_files(token_blocks.write_token_files(documents(spark, []), BYTES)).count() == 0


def test_packing(spark):
    ids = library(WORDS)
    out = packing.pack_documents(documents(spark), WORDS, capacity=64).collect()
    want = []
    for key, text in ROWS:
        own = np.append(ids(text), 0).astype("<u4")
        want += [(key, p, s, len(own[s : s + 64]), zlib.crc32(own[s : s + 64].tobytes())) for p, s in enumerate(range(0, len(own), 64))]
    assert sorted((tuple(r)[:5] for r in out), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for row in out:
        bins[row.sequence_id].append((row.offset, row.length))
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 64
    assert len(bins) <= -(-sum(w[3] for w in want) // 64) + 1
    assert packing.pack_documents(documents(spark, []), WORDS).count() == 0


def test_best_fit_is_bounded_and_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.place(n) for n in (6, 9, 7)] == [(0, 0), (1, 0), (2, 0)]  # bin 1, with one free, closes
    assert bins.n_open == 2
    assert bins.place(3) == (2, 7)  # the best fit, not the first
    assert bins.place(1) == (0, 6)
    assert bins.place(10) == (3, 0)
    dice = random.Random(1)
    bins = packing.BestFit(2048, 50)
    lengths = [dice.randint(1, 2048) for _ in range(20_000)]
    for n in lengths:
        bins.place(n)
        assert bins.n_open <= 50
    assert bins.n_bins < 1.06 * sum(lengths) / 2048


def test_bound_acts_at_the_query_s_own_settings():
    """In tasks of the query bins close before they are full, and yet few more sequences are made than must be."""
    dice = random.Random(3)
    lengths = np.array([min(2048, int(dice.lognormvariate(5.3, 1.0)) + 1) for _ in range(packing.BLOCK_PIECES)])
    bins, closed = packing.BestFit(packing.CAPACITY, packing.OPEN_BINS), 0
    for start in range(0, len(lengths), packing.LOOKAHEAD):
        for n in np.sort(lengths[start : start + packing.LOOKAHEAD])[::-1].tolist():
            closed += not bins.bits >> n and bins.n_open == packing.OPEN_BINS
            bins.place(n)
            assert bins.n_open <= packing.OPEN_BINS
    assert closed > 0
    assert bins.n_bins <= 1.015 * lengths.sum() / packing.CAPACITY


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_texts_encoded_together(path):
    """What is new in several texts goes to the library at once; special strings, blanks and empty texts among them."""
    ids = library(path)
    mixed = texts(300) + ["", "<|endoftext|>", "a <|endoftext|> b", " ", "x" * 5000, "new<|endoftext|>words here"]
    for size in (1, 7, 400):
        encoder = TextEncoder(path, 500)
        for start in range(0, len(mixed), size):
            part = mixed[start : start + size]
            assert encoder.encode_all(part) == [ids(t).tobytes() for t in part]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_closing_marks_and_accents(path):
    """Marks after a word are taken off it, also where the text itself has the character that stands for that; accented words are spelled in bytes."""
    dice, ids = random.Random(11), library(path)
    parts = [*PARTS, "\0", ", ", ". ", ",", " \0,", "\0. ", "été", " Éa", "ß ÿ", "Ġ", "Ģ", "word", ".,", ")", "9", "\x85", " ª", "\u2028"]
    mixed = ["".join(dice.choice(parts) for _ in range(dice.randint(1, 25))) for _ in range(3000)] + ["a,", "a, \0, b", "à, â.", ", a", ".\n,\n9."]
    for size in (1, 50, len(mixed)):
        encoder = TextEncoder(path, 2000)
        for start in range(0, len(mixed), size):
            part = mixed[start : start + size]
            assert encoder.encode_all(part) == [ids(t).tobytes() for t in part]


def test_library_gets_each_word_once_and_without_its_marks():
    """Plain words reach the library through the bare model only, a distinct one once, whatever closes it; the pattern runs for none of them."""
    encoder, got = TextEncoder(BYTES), []

    class Bare:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **options):
            got.extend(texts)
            return self.tokenizer.encode_batch_fast(texts, **options)

    encoder.bare = Bare(encoder.bare)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiouéà" for c in "lmnrst"]
    text = "The " + " ".join(w + m for m in ("", ",", ".") for w in words) + " end."
    want = library(BYTES)(text).tobytes()
    assert encoder.encode_all([text, "", text]) == [want, b"", want]
    assert sum(t.count("\u0120") for t in got) == len(words) + 1
    keys = set(encoder.seen.now)
    assert keys == {*words, "end", "\0,", "\0."}


def test_slices_of_bytes():
    batch = pa.record_batch({"key": pa.array(range(7)), "text": pa.array(["a" * 4, None, "b" * 4, "c" * 30, "", "d" * 4, "e"])})
    parts = list(slices_of_bytes([batch, batch.slice(0, 0), batch.slice(5)], 1, 8))
    assert [p.column(0).to_pylist() for p in parts] == [[0, 1, 2], [3], [4, 5, 6], [5, 6]]


def test_merges_over_a_space_keep_the_pattern():
    """Words are put together for the bare model only if no merge reaches from one to the next."""
    model = {"type": "BPE", "merges": ["a b", ["\u0120\u00c2\u0142", "\u0120\u00c2\u0142"]]}
    assert never_joined({"model": model})
    assert not never_joined({"model": model | {"merges": [*model["merges"], ["ab", "\u0120c"]]}})
    assert not never_joined({"model": model | {"ignore_merges": True}})
    assert not never_joined({"model": model, "added_tokens": [{"content": "abc"}]})
