"""Splits texts into the pre-tokens of a byte-level BPE vocabulary file, as the tokenizers library does.

Pre-tokens are found with the pattern of byte-level BPE: over Latin letters with classes spelled out,
which the standard library's `re` matches fastest, over other settled characters with `regex`.  For
characters on which the installed Unicode tables may differ, the library's own splitter is asked, so
the split is always the library's.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer, pre_tokenizers

#: Fixed value: the pattern that splits text before the merges of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_find = regex.compile(PATTERN).findall
#: Letters and numbers below U+02B0.
_LETTERS, _NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af", "0-9\xb2\xb3\xb9\xbc-\xbe"
_find_latin = re.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LETTERS}{_NUMBERS}]").replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", f"[{_NUMBERS}]")).findall
#: Anything beside ASCII, Latin letters and common punctuation; white space other than ASCII's too, on which libraries differ.
_beyond_latin = re.compile("[^\t-\r -~\xa1-\u02af\u2010-\u2027\u2030-\u205e]").search
#: Anything outside blocks whose letters and numbers have long been settled.
_unsettled = regex.compile("[^\x00-՗‐- ₠-₿　-〿ぁ-ゖァ-ヺ一-鿯가-힣]").search
_library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


def byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else 256, 257, ... in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """A byte-level BPE file: token bytes by id, and special tokens by their text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_characters()
        self.path = path
        self.ids = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes_of = [b""] * self.size
        for token, i in self.ids.items():
            self.bytes_of[i] = token
        for text, i in self.special.items():
            self.bytes_of[i] = text.encode()
        self.sizes = np.array([len(b) for b in self.bytes_of])
        self.merges = []
        for pair in spec["model"]["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.append((bytes(of[c] for c in a), bytes(of[c] for c in b)))
        self._cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else None

    def split(self, text: str) -> list[str]:
        """Pre-tokens in order; a special token's text is one piece of its own."""
        if self._cut and any(s in text for s in self.special):
            return [w for part in self._cut(text) if part for w in ([part] if part in self.special else split_plain(part))]
        return split_plain(text)


def split_plain(text: str) -> list[str]:
    if _beyond_latin(text) is None:
        return _find_latin(text)
    if _unsettled(text) is None:
        return _find(text)
    return [text[a:b] for _, (a, b) in _library.pre_tokenize_str(text)]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """One copy for each Python worker."""
    return Vocabulary(path)


@lru_cache(2)
def tokenizer(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


#: A space and Latin letters: words that stay pre-tokens when they stand side by side.
_joinable = re.compile(f" [{_LETTERS}]+").fullmatch
#: Words that are encoded side by side.
SIDE_BY_SIDE = 2000


def encoded(words: list[str], path: str) -> list[bytes]:
    """The ids of each word (a pre-token or a special token) by the tokenizers library, as little-endian 32-bit integers.

    Words that can stand side by side are encoded as one text, which costs less than a call for each; the
    bytes of its tokens tell where each word ends.
    """
    # the worker's other core belongs to another task: no threads of the library's own
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    encode, sizes = tokenizer(path).encode_batch_fast, vocabulary(path).sizes
    out: dict[str, bytes] = {}
    joinable = [w for w in words if _joinable(w)]
    for lo in range(0, len(joinable), SIDE_BY_SIDE):
        part = joinable[lo : lo + SIDE_BY_SIDE]
        ids = np.array(encode(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
        reached, ends = np.cumsum(sizes[ids]), np.cumsum([len(w.encode()) for w in part])
        last = np.minimum(np.searchsorted(reached, ends), len(ids) - 1)
        if len(ids) and (reached[last] == ends).all():
            raw, cuts = ids.tobytes(), [0, *((last + 1) * 4).tolist()]
            out.update(zip(part, (raw[a:b] for a, b in zip(cuts, cuts[1:]))))
    rest = [w for w in words if w not in out]
    if rest:
        out.update(zip(rest, (np.array(found.ids, "<u4").tobytes() for found in encode(rest, add_special_tokens=False))))
    return [out[w] for w in words]


class KnownWords:
    """The ids of the distinct pre-tokens that a worker has met, as little-endian 32-bit integers; the table is bounded and starts anew when full."""

    def __init__(self, path: str, most: int):
        self.path, self.most, self.ids = path, most, {}

    def meet(self, words: Iterable[str]) -> None:
        """Looks up the words' ids, once for each distinct word."""
        if len(self.ids) > self.most:
            self.ids.clear()
        new = list(set(words) - self.ids.keys())
        self.ids.update(zip(new, encoded(new, self.path)))


@lru_cache(2)
def known_words(path: str, most: int) -> KnownWords:
    return KnownWords(path, most)
