"""Exact token ids from the tokenizers library, with each distinct word encoded once.

A text is split where the tokenizer itself always splits; each piece's ids come from the library's own
model (for plain words) or its whole encode (for anything else) and are kept in a table of the worker
process. A text in which those split points are not certain is encoded whole. A table has two generations
of bounded bytes: when the young one is full it becomes the old one, and what the old one held and nobody
asked for since is let go, which costs time but never changes an id.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
#: Bytes of each of the two generations of a worker's table, about, and what an entry takes besides its word and ids.
TABLE_BYTES, ENTRY_BYTES = 112 << 20, 190
#: A longer word is encoded anew each time.
LONGEST_WORD = 64
#: Ids as bytes: little-endian, two bytes while they suffice.
NARROW, WIDE = np.dtype("<u2"), np.dtype("<u4")
#: White space besides space and line feed up to U+00FF, and beyond.
_NARROW_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"
_WIDE_SPACES = re.compile("[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Separators that only some libraries count as white space, letters whose lower case depends on the context, and what
#: may be a special token.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85", "İ", "Σ", "<|")
_POINTS = frozenset(".,;:!?")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _single_spaces(text: str) -> bool:
    """Whether all white space is single spaces and line feeds between other characters; other texts are encoded whole.
    Substring tests, since an expression that looks at every character takes longer than the rest of the encoding."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[-1] in " \n":
        return False
    if any(c in text for c in _NARROW_SPACES):
        return False
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return not _WIDE_SPACES.search(text)
    return True


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + extra)
            extra += 1
    return [out[b] for b in range(256)]


_LETTERS = _byte_letters()


def _spelt(word: str) -> str:
    return word if word.isascii() else "".join([_LETTERS[b] for b in word.encode("utf-8")])


class Words(dict):
    """word → its ids as bytes; prefix is the spelling of what stands before the word. The dict is the young generation."""

    def __init__(self, owner: Encoder, before: str, size: int):
        super().__init__()
        self.owner, self.before, self.size = owner, before, size
        self.old: dict[str, bytes] = {}
        self.held = 0

    def made(self, word: str) -> bytes:
        o = self.owner
        if word.isalpha():
            return o.pack([t.id for t in o.model.tokenize(o.spelt_space(self.before) + _spelt(word))])
        if word and word[-1] in _POINTS and word[:-1].isalpha():
            return self[word[:-1]] + o.point(word[-1])
        return o.pack(o.tokenizer.encode(self.before + word, add_special_tokens=False).ids) if word else b""

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self.made(word)
        if len(word) > LONGEST_WORD:
            return ids
        if self.held >= self.size:
            self.old = dict(self)
            self.clear()
            self.held = 0
        self[word] = ids
        self.held += ENTRY_BYTES + len(word) + len(ids)
        return ids


class Encoder:
    """Ids of whole texts under one tokenizer file, as the library gives them with add_special_tokens=False."""

    def __init__(self, path: str, table_bytes: int = TABLE_BYTES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):  # the model's own table would hold the same words once more
            self.model._resize_cache(0)
        self.dtype = NARROW if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else WIDE
        self.code = "H" if self.dtype == NARROW else "I"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = str(spec.get("normalizer")) + str(spec.get("pre_tokenizer"))
        self.word_level = "Lowercase" in kinds and "'Removed'" in kinds
        self.byte_level = spec.get("normalizer") is None and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        self.points: dict[str, bytes] = {}
        # Byte-level words mostly stand after a space; at word level there is but the one table.
        self.bare = Words(self, "", table_bytes // 4 if self.byte_level else table_bytes)
        self.spaced = Words(self, " ", table_bytes)
        self.line = self.pack(self.tokenizer.encode("\n", add_special_tokens=False).ids) if self.byte_level else b""

    def pack(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes() if sys.byteorder == "little" else np.array(ids, self.dtype).tobytes()

    def spelt_space(self, before: str) -> str:
        return _LETTERS[32] if before else ""

    def point(self, c: str) -> bytes:
        if c not in self.points:
            self.points[c] = self.pack(self.tokenizer.encode(c, add_special_tokens=False).ids)
        return self.points[c]

    def whole(self, text: str) -> bytes:
        return self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text, packed; null counts as empty."""
        if not text:
            return b""
        if self.byte_level and _single_spaces(text):
            out: list[bytes] = []
            bare, spaced = self.bare, self.spaced.__getitem__
            for k, line in enumerate(text.split("\n")):
                if k:
                    out.append(self.line)
                words = line.split(" ")
                out.append(bare[words[0]])
                out.extend(map(spaced, words[1:]))
            return b"".join(out)
        if self.word_level and not any(c in text for c in _ODD) and unicodedata.is_normalized("NFC", text):
            return b"".join(map(self.bare.__getitem__, text.lower().split()))
        return self.whole(text)

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode(text), self.dtype)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each file and worker process."""
    return Encoder(path)
