"""Token ids of whole texts by the tokenizers library, with every distinct stretch between blanks encoded once.

The two supported kinds of tokenizer never join text across certain blanks, so a text may be cut there without changing
one id:

* ``leading``  byte-level BPE whose pattern is `` ?letters| ?digits| ?others|blanks``: a single space or line feed between two
  non-blanks always starts a token (a space) or is a token of its own (a line feed);
* ``dropped``  a pattern that removes blanks: any space or line feed separates.

Any other tokenizer gets its texts whole.

A full stop or comma that closes a word is a token of its own and is taken off before, so that the word is looked up and encoded
once, whatever follows it. New plain words of a ``leading`` tokenizer go to its model without the pattern, if no merge can join two.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct stretches of usual length that one Python worker remembers, at STRETCH_BYTES each; longer ones count for more.
REMEMBERED = 1_000_000
STRETCH_BYTES = 200
ENTRY_BYTES = 150
#: Words in one text for the bare model, and such texts in one call; its work for a word grows with the text.
BARE_WORDS = 32
RUN = re.compile(r"\s\s")
#: RUN for Arrow, whose own class knows fewer blanks.
UNEVEN = f"[{''.join(filter(str.isspace, map(chr, range(0x10000))))}]{{2}}"
#: Stands for no space before a stretch; texts that have it themselves are encoded whole.
BARE_MARK = "\0"
#: A full stop or comma that closes a stretch after a letter or digit: a token of its own, so that the stretch is the one that has none.
CLOSING = [(mark, re.compile(rf"{re.escape(mark)}(?= |\Z)(?<=[A-Za-z0-9À-ÖØ-öø-ÿ]{re.escape(mark)})")) for mark in ",."]
EDGE = re.compile(r"(?<=\S)(?=[ \n]\S)")
PLAIN_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
PLAIN_LETTERS = "".join(filter(PLAIN_WORD.fullmatch, map(chr, range(256))))
#: The letters of PLAIN_WORD as byte-level tokenizers spell their UTF-8 bytes: bytes that are no visible Latin-1 characters from U+0100 on.
HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
SPELLED = {ord(c): "".join(chr(256 + HIDDEN.index(b)) if b in HIDDEN else chr(b) for b in c.encode()) for c in PLAIN_LETTERS}
ENDINGS = frozenset(".,;:!?")
#: A word and the marks that close it, which are separate tokens in both kinds.
CLOSED_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]+)")


class Seen:
    """Ids by stretch in two generations. Once those asked for take ``limit`` bytes, they become the older generation, from which those asked for again return."""

    def __init__(self, limit: int) -> None:
        self.limit, self.held = limit, 0
        self.now: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def missing(self, keys: list[str]) -> set[str]:
        """The keys that neither generation has."""
        new = set(keys).difference(self.now)
        back = [k for k in new if k in self.older] if self.older else []
        if back:
            self.learnt(back, list(map(self.older.__getitem__, back)))
            new.difference_update(back)
        return new

    def learnt(self, keys: list[str], ids: list[bytes]) -> None:
        self.now.update(zip(keys, ids))
        self.held += sum(map(len, keys)) + sum(map(len, ids)) + ENTRY_BYTES * len(keys)

    def turn(self) -> None:
        if self.held > self.limit:
            self.older, self.now, self.held = self.now, {}, 0


class TextEncoder:
    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has one task per core already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.kind = kind_of(described)
        added = [t for t in described.get("added_tokens") or [] if not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])]
        self.specials = [t["content"] for t in described.get("added_tokens") or []]
        self.separator = (added[-1]["content"], added[-1]["id"]) if added else None
        if any(re.search(r"\s", s) for s in self.specials) or len(added) < len(self.specials):
            self.kind = "whole"
        self.bare = Tokenizer(self.tokenizer.model) if self.kind == "leading" and never_joined(described) else None
        self.closing = [c for c in CLOSING if not any(c[0] in s for s in self.specials)]
        self.edges = self._edges()
        self.seen = Seen(remembered * STRETCH_BYTES // 2)
        self.heads: dict[str, bytes] = {}

    def _edges(self) -> np.ndarray:
        """By id, whether a token starts a word after a space (``leading``) or ends a word (``dropped``)."""
        vocabulary = self.tokenizer.get_vocab(True)
        edges = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        for token, number in vocabulary.items():
            edges[number] = token.startswith("\u0120") if self.kind == "leading" else token.endswith("</w>")
        return edges

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of some texts; what is new in any of them goes to the library together."""
        self.seen.turn()
        if len(self.heads) > self.remembered // 10:
            self.heads.clear()
        out = [b""] * len(texts)
        plain: list[tuple[int, str]] = []
        cut: list[tuple[int, list[str]]] = []
        uneven = pc.match_substring_regex(pa.array(texts, pa.large_string()), UNEVEN).to_pylist() if self.kind == "leading" else [False] * len(texts)
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.kind == "whole" or self._respelled(text) or self.kind == "leading" and BARE_MARK in text:
                out[i] = self._whole(text)
            elif self.kind == "dropped":
                text = (text.lower() if text.isascii() else text).replace("\n", " ")  # what the library does to it anyway
                plain.append((i, self._parted(text, " ")))
            elif uneven[i]:
                first, *rest = EDGE.split(text)
                out[i] = self._head(first)
                cut.append((i, [r[1:] if r[0] == " " else r for r in rest]))
            else:
                first, blank, rest = self._parted(text.replace("\n", " \n"), f" {BARE_MARK}").partition(" ")
                out[i] = self._head(first)
                if blank:
                    plain.append((i, rest))
        if plain or cut:
            self._join(out, plain, cut)
        return out

    def _join(self, out: list[bytes], plain: list[tuple[int, str]], cut: list[tuple[int, list[str]]]) -> None:
        """Append the ids of texts that are still to be split at spaces and of those already cut; every distinct stretch is looked up once.

        In a ``leading`` text, stretches lost their space, start with a line feed or are a closing mark after BARE_MARK.
        """
        parts = pc.split_pattern(pa.array([text for _, text in plain], pa.large_string()), " ")
        stretches = pa.concat_arrays([parts.flatten(), pa.array([key for _, keys in cut for key in keys], pa.large_string())]).dictionary_encode()
        counts = [*pc.list_value_length(parts).to_pylist(), *(len(keys) for _, keys in cut)]
        distinct = stretches.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.seen.now.get, distinct))
        lacking = [place for place, ids in enumerate(known) if ids is None]
        if lacking:
            wanted = self.seen.missing([distinct[place] for place in lacking])
            if wanted:
                self._learn(wanted)
            for place in lacking:
                known[place] = self.seen.now[distinct[place]]
        ids = pa.array(known, pa.large_binary()).take(stretches.indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, "<i8")[np.cumsum([0, *counts])].tolist()
        for (i, _), start, end in zip([*plain, *cut], ends, ends[1:]):
            if start < end:
                out[i] += data[start:end].to_pybytes()

    def _parted(self, text: str, before: str) -> str:
        """The text with its closing marks taken off their stretches."""
        for mark, closing in self.closing:
            text = closing.sub(before + mark, text)
        return text

    def _head(self, first: str) -> bytes:
        """Ids of the first stretch of a ``leading`` text, which no space precedes."""
        head = self.heads.get(first)
        if head is None:
            head = self.heads[first] = self._whole(first) if first else b""
        return head

    def _respelled(self, text: str) -> bool:
        """Whether its lower-casing makes or unmakes a special string of the text; stretches of such a text are not remembered."""
        if self.kind != "dropped" or not text.isascii():
            return False
        lowered = text.lower()
        return any((s in lowered or s in text) and [p.lower() for p in text.split(s)] != lowered.split(s) for s in self.specials)

    def _spelled(self, key: str) -> str:
        if self.kind == "leading" and key[:1] == BARE_MARK and key[1:] in ENDINGS:
            return key[1:]
        return key if self.kind == "dropped" or key[:1] == "\n" else " " + key

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, wanted: set[str]) -> None:
        """Encode new stretches: words of letters together, the rest with a special token between, and what has a special string alone."""
        seen, closed, words, joined = self.seen, [], set(), []
        for key in wanted:
            if key.isalpha():
                words.add(key)
                continue
            parts = CLOSED_WORD.fullmatch(key)
            if parts is not None:
                closed.append((key, parts[1], parts[2]))
            elif key == "" and self.kind == "dropped":  # nothing between two blanks
                seen.learnt([key], [b""])
            elif self.separator is None or any(s in key for s in self.specials):
                seen.learnt([key], [self._whole(self._spelled(key))])
            else:
                joined.append(key)
        if closed:
            words |= seen.missing([word for _, word, _ in closed])
        if words and self.bare is not None:
            words.difference_update(self._learn_bare([word for word in words if PLAIN_WORD.fullmatch(word)]))
        if self.separator is None:
            seen.learnt(list(words), [self._whole(self._spelled(key)) for key in words])
        elif words and not self._learn_words(list(words)):
            joined += words
        if joined:
            text, mark = self.separator
            ids = np.array(self.tokenizer.encode_batch_fast([text.join(map(self._spelled, joined))], add_special_tokens=False)[0].ids, dtype="<u4")
            data, ends = ids.tobytes(), (np.flatnonzero(ids == mark) * 4).tolist()
            seen.learnt(joined, [data[start:end] for start, end in zip([0, *(e + 4 for e in ends)], [*ends, len(data)])])
        tails = {marks for _, _, marks in closed}.difference(self.heads)
        self.heads.update((marks, self._whole(marks)) for marks in tails)
        seen.learnt([key for key, _, _ in closed], [seen.now[word] + self.heads[marks] for _, word, marks in closed])

    def _learn_bare(self, words: list[str]) -> list[str]:
        """Encode words of PLAIN_WORD through the bare model, some at a time; returns those whose ids are told apart by their edges."""
        learnt: list[str] = []
        for part in ([w for w in words if w.isascii()], [w for w in words if not w.isascii()]):
            texts = ["\u0120" + "\u0120".join(part[at : at + BARE_WORDS]) for at in range(0, len(part), BARE_WORDS)]
            if part and not part[0].isascii():
                texts = [text.translate(SPELLED) for text in texts]
            numbers: list[int] = []
            for at in range(0, len(texts), BARE_WORDS):
                for found in self.bare.encode_batch_fast(texts[at : at + BARE_WORDS], add_special_tokens=False):
                    numbers += found.ids
            if self._told_apart(part, np.array(numbers, dtype="<u4")):
                learnt += part
        return learnt

    def _learn_words(self, words: list[str]) -> bool:
        """Encode words of letters as one text, told apart by their edges; False if these do not fit the words one to one."""
        text = " " + " ".join(words) if self.kind == "leading" else " ".join(words)
        return self._told_apart(words, np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4"))

    def _told_apart(self, words: list[str], ids: np.ndarray) -> bool:
        """Remember the ids of words, told apart by their edges; False if these do not fit the words one to one."""
        places = np.flatnonzero(self.edges[ids])
        if len(places) != len(words) or self.kind == "leading" and len(places) and places[0]:
            return False
        cuts = [*(places * 4).tolist(), 4 * len(ids)] if self.kind == "leading" else [0, *(places * 4 + 4).tolist()]
        data = ids.tobytes()
        self.seen.learnt(words, [data[start:end] for start, end in zip(cuts, cuts[1:])])
        return True


def never_joined(described: dict) -> bool:
    """Whether the merges of a ``leading`` tokenizer cannot reach from a word of PLAIN_WORD over the space of the next one.

    Then the model gives such words, spelled in bytes and put together, the same ids as one by one, and the pattern need not run.
    """
    model = described["model"]
    if model.get("type") != "BPE" or any(model.get(k) for k in ("ignore_merges", "continuing_subword_prefix", "end_of_word_suffix", "unk_token")):
        return False
    if any(t["content"].isalpha() for t in described.get("added_tokens") or []):
        return False
    letters = set("\u0120" + PLAIN_LETTERS.translate(SPELLED))
    pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
    return not any("\u0120" in right and letters.issuperset(left + right) for left, right in pairs)


def kind_of(described: dict) -> str:
    """How blanks behave in a tokenizer file: ``leading``, ``dropped`` or, if unknown, ``whole``."""
    pre, normalizer = described.get("pre_tokenizer") or {}, described.get("normalizer")
    if described.get("truncation") or described.get("padding") or described["model"].get("dropout"):
        return "whole"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and normalizer is None:
        return "leading"
    steps = [normalizer] if normalizer and normalizer.get("type") != "Sequence" else (normalizer or {}).get("normalizers", [])
    plain = all(s["type"] in ("NFC", "Lowercase") or s["type"] == "Replace" and s["pattern"] == {"Regex": r"\s+"} and s["content"] == " " for s in steps)
    parts = pre.get("pretokenizers", [])
    if plain and len(parts) == 2 and parts[0].get("type") == "Split" and parts[1].get("type") == "ByteLevel":
        split, level = parts
        words = split["pattern"].get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        if words and split["behavior"] == "Removed" and split["invert"] and not level["add_prefix_space"] and not level["use_regex"]:
            return "dropped"
    return "whole"
