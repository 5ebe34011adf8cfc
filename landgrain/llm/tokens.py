"""Token ids of whole texts by a vocabulary file of the ``tokenizers`` library, word by word with a bounded cache.

The vocabulary's own rules never join characters across a blank or a line end, so a text is cut there and every
distinct word is encoded once. Words of letters alone are encoded together, by ``tiktoken`` with the file's own merges
as ranks; all others by the library, which gives a special string inside a text its one id, as a plain call does.
``tests/llm`` compares the ids with the library's own for whole texts.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np
import tiktoken
from tokenizers import Tokenizer

GENERATION = 120_000  # words in each of the two generations of the cache
WORD_END = "</w>"
#: Letters whose small form is one composed letter, then signs that cannot begin a contraction.
LETTERS_SIGNS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿŒœ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(rest)) for b in range(256)]


def word_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary as bytes -> id, with a blank, which is in no word, for the end of a word."""
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    out = {}
    for token, i in vocabulary.items():
        stem = token.removesuffix(WORD_END)
        out[bytes(byte_of[c] for c in stem) + b" " * (stem != token)] = i
    return out


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)
        ranks = word_ranks(path)
        self.words = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.is_end = np.zeros(max(ranks.values()) + 1, bool)
        self.is_end[[i for token, i in ranks.items() if token.endswith(b" ")]] = True
        self.signs: dict[str, bytes] = {}

    def encoded(self, word: str) -> bytes:
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def learn(self, words: list[str]) -> None:
        """Adds the ids of ``words``; signs behind the letters are a word of their own."""
        plain, lows, signs = [], [], self.signs
        for word in words:
            found = LETTERS_SIGNS(word)
            if found is None:
                self.known[word] = self.encoded(word)
                continue
            stem, sign = found.groups()
            if sign not in signs:
                signs[sign] = self.encoded(sign)
            plain.append((word, signs[sign]))
            lows.append(stem)
        if plain:
            ids = np.array(self.words.encode_ordinary(" ".join(lows).lower() + " "), "<u4")
            raw, start = ids.tobytes(), 0
            for (word, sign), end in zip(plain, (4 * np.flatnonzero(self.is_end[ids]) + 4).tolist()):
                self.known[word] = raw[start:end] + sign
                start = end
        if len(signs) > GENERATION:
            self.signs = {}

    def of(self, text: str | None) -> bytes:
        if len(self.known) > GENERATION:
            self.old, self.known = self.known, {}
        words = (text or "").replace("\n", " ").split(" ")
        known, old = self.known, self.old
        new = set(words).difference(known)
        for word in [w for w in new if w in old]:
            known[word] = old[word]
            new.remove(word)
        if new:
            self.learn(list(new))
        return b"".join(map(known.__getitem__, words))


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per Python worker and vocabulary file."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]
