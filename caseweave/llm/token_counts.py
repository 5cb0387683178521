"""Token counts by byte-pair merging on a heap and a linked list; no identifier is ever made.

A stretch of text starts as one symbol per byte. A heap holds the adjacent pairs by merge rank and position; the lowest is
popped, checked against the linked list (a stale entry is skipped), merged, and its two new neighbours are pushed. The
count is the number of initial symbols minus the number of merges.

Texts are cut the way the vocabulary's pre-tokenizer cuts them, and the count of each distinct stretch is remembered within
bounds, so a frequent word is merged once per Python worker. Long stretches cost n log n, not n squared.

Edges: null and empty texts count 0 tokens. The vocabulary's special strings count one token each wherever they stand in
a text, as the library does by default. Repeated rows are counted each. Extra columns are ignored by ``token_counts``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_in_worker, slices
from .encode import EDGE, ENDINGS, PLAIN_WORD, RUN

#: Fixed: the pattern of byte-level pre-tokenizers.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 400_000
#: Longer stretches are not remembered.
MEMORABLE = 64
#: Bits of a symbol's number in a pair, and of a place in a heap entry.
PAIR, PLACE = 24, 40
PLACES = (1 << PLACE) - 1


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones as they are, others from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


class MergeCounter:
    """Counts the tokens of a text under a byte-level BPE vocabulary file."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        import regex

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        pre, model = described["pre_tokenizer"], described["model"]
        if pre["type"] != "ByteLevel" or not pre["use_regex"] or pre["add_prefix_space"] or described.get("normalizer") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        letters = byte_letters()
        if any(letter not in model["vocab"] for letter in letters):
            raise ValueError(f"{path} lacks some bytes")
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        # A symbol is a number: a byte's own value, or the next free one for each new string of letters.
        numbers = {letter: b for b, letter in enumerate(letters)}
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (left, right) in enumerate(merges):
            self.made.append(numbers.setdefault(left + right, len(numbers)))
            self.ranks[numbers[left] << PAIR | numbers[right]] = rank
        self.pieces = regex.compile(PIECES)
        specials = [t["content"] for t in described.get("added_tokens") or []]
        self.specials = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.special_texts = specials
        self.remembered = remembered // 2
        self.counts: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.specials is not None and any(s in text for s in self.special_texts):
            found = len(self.specials.findall(text))
            return found + sum(self._plain(part) for part in self.specials.split(text))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        """A single space or line feed between non-blanks never joins what stands before it, so a text may be cut there."""
        if not text:
            return 0
        if RUN.search(text):
            stretches = EDGE.split(text)
        else:
            first, *rest = text.replace("\n", " \n").split(" ")
            stretches = [r if r[:1] == "\n" else " " + r for r in rest]
            if first:
                stretches.append(first)
        if len(self.counts) > self.remembered:
            self.older, self.counts = self.counts, {}
        counts, older = self.counts, self.older
        found = list(map(counts.get, stretches))
        if None in found:
            for i, n in enumerate(found):
                if n is None:
                    stretch = stretches[i]
                    n = counts.get(stretch) or older.get(stretch) or self._stretch(stretch)
                    if len(stretch) <= MEMORABLE:
                        counts[stretch] = n
                    found[i] = n
        return sum(found)

    def _stretch(self, stretch: str) -> int:
        if stretch[-1] in ENDINGS and PLAIN_WORD.fullmatch(stretch, 1, len(stretch) - 1):  # the closing mark is a token of its own
            word = stretch[:-1]
            n = self.counts.get(word) or self.older.get(word)
            if n is None:
                n = self.counts[word] = sum(map(self.merged, self.pieces.findall(word)))
            return n + 1
        if PLAIN_WORD.fullmatch(stretch, 1):
            return self.merged(stretch) if stretch[0] == " " else sum(map(self.merged, self.pieces.findall(stretch)))
        return sum(map(self.merged, self.pieces.findall(stretch)))

    def merged(self, piece: str) -> int:
        """Symbols left of one pre-token."""
        symbols = list(piece.encode("utf-8"))
        n = len(symbols)
        rank_of, made = self.ranks.get, self.made
        heap = [r << PLACE | i for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank_of(a << PAIR | b)) is not None]
        if not heap:
            return n
        heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        merges = 0
        while heap:
            top = heappop(heap)
            i = top & PLACES
            j = after[i]
            # A pair that has changed since it was pushed is skipped; a merged-away symbol is -1 and has no pairs.
            if j >= n or symbols[i] < 0 or rank_of(symbols[i] << PAIR | symbols[j]) != top >> PLACE:
                continue
            new = symbols[i] = made[top >> PLACE]
            symbols[j] = -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank_of(new << PAIR | symbols[k])) is not None:
                    heappush(heap, r << PLACE | i)
            h = before[i]
            if h >= 0 and (r := rank_of(symbols[h] << PAIR | new)) is not None:
                heappush(heap, r << PLACE | h)
        return n - merges


def counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_in_worker(("merge counter", path), lambda: MergeCounter(path))
        for part in slices(batches):
            texts = part.column(1).to_pylist()
            yield pa.record_batch({
                "key": part.column(0),
                "n_bytes": pa.array([len(t.encode("utf-8")) if t else 0 for t in texts], pa.int64()),
                "n_tokens": pa.array([counter.count(t) for t in texts], pa.int64()),
            })

    return run


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every row. ``vocabulary`` is a path that every task can open."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    out = rows.mapInArrow(counted(vocabulary), f"key {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
