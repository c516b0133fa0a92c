"""Ids of whole texts by a public tokenizer, fast enough for a corpus.

Prose repeats its words, so a task remembers the ids of words it has met and
hands the library only new ones.  Splitting at plain spaces and line feeds
never changes the ids: no normalisation, pre-token or merge of the tokenizers
used here reaches across white space.  A new word of plain letters (with
trailing marks) goes straight to the library's merge model; anything else runs
through the library's whole pipeline.  ``encode_all`` takes many texts at once:
their distinct words, and of these the distinct letters and marks, are found by
Arrow, so words that differ in case or marks cost one look-up.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words remembered by one task, in two generations of half this size.
REMEMBERED = 400_000
#: Longer words are encoded each time they occur.
LONGEST = 48
#: Plain letters as far as U+00FF, and the marks that may follow them (printable ASCII but digits, letters, ' and <).
LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
MARKS = r"[!-&(-/:;=-@\[-`{-~]*"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file (installed on every executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.merges = self.whole.model.tokenize
        self.fresh: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.older_heads: dict[str, bytes] = {}
        # Letters that normalisation only lower-cases and the byte alphabet
        # spells the same way; other words take the whole pipeline.
        self.plain = re.compile(LETTERS)
        self.spelling = {ord(c): "".join(_byte_letters()[b] for b in c.encode()) for c in map(chr, range(0xC0, 0x100))}
        self.direct = self._agrees()

    def _agrees(self) -> bool:
        """Whether the short way gives the library's ids on probes of every kind of letter."""
        letters = "".join(map(chr, [*range(65, 91), *range(97, 123), *(c for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))]))
        probes = [*letters, letters, *(letters[i: i + 5] for i in range(0, len(letters), 3)), "Hello", "éauxCh", "Straße", "niño"]
        return all(self._short(p) == self._long(p) and self._short(p) + self._long(",.!") == self._long(p + ",.!") for p in probes)

    def _short(self, letters: str) -> bytes:
        spelled = letters.lower()
        if not spelled.isascii():
            spelled = spelled.translate(self.spelling)
        return array("I", [t.id for t in self.merges(spelled)]).tobytes()

    def _long(self, word: str) -> bytes:
        return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self._new(word)
        if len(word) <= LONGEST:
            if len(self.fresh) >= REMEMBERED // 2:
                self.older, self.fresh = self.fresh, {}
            self.fresh[word] = ids
        return ids

    def _new(self, word: str) -> bytes:
        if self.direct and (head := self.plain.match(word)):
            head = head[0]
            marks = word[len(head):]
            if not marks:
                return self._short(head)
            if marks.isascii() and not any(c.isalnum() for c in marks) and marks.isprintable() and "'" not in marks and "<" not in marks:
                return self._part(head, self._short) + self._part(marks, self._long)
        return self._long(word)

    def _part(self, part: str, encode) -> bytes:
        ids = self.fresh.get(part) or self.older.get(part)
        if ids is None:
            ids = encode(part)
            if len(part) <= LONGEST:
                self.fresh[part] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        known, word = self.fresh.get, self.word
        return b"".join([known(w) or word(w) for w in text.replace("\n", " ").split(" ") if w])

    def _head(self, lowered: str) -> bytes:
        ids = self.older_heads.get(lowered)
        if ids is None:
            ids = self._short(lowered)
        if len(lowered) <= LONGEST:
            if len(self.heads) >= REMEMBERED // 2:
                self.older_heads, self.heads = self.heads, {}
            self.heads[lowered] = ids
        return ids

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after the other, and the n + 1 bounds."""
        if not self.direct:
            return _strung([self.word(w) if w else b"" for w in _strings(words)])
        parts = pc.extract_regex(words, f"^(?P<head>{LETTERS})(?P<marks>{MARKS})$")
        other = pc.is_null(parts)
        heads, marks = (x.dictionary_encode() for x in (pc.utf8_lower(pc.struct_field(parts, "head")), pc.struct_field(parts, "marks")))
        known, head, known_head = self.fresh.get, self._head, self.heads.get
        pieces = [known_head(h) or head(h) for h in _strings(heads.dictionary)]
        first = len(pieces)
        pieces += [self.word(m) if m else b"" for m in _strings(marks.dictionary)]
        second = len(pieces)
        pieces += [(known(w) or self.word(w)) if w else b"" for w in _strings(words.filter(other))]
        pieces.append(b"")
        odd = other.to_numpy(zero_copy_only=False)
        which = np.empty((len(words), 2), np.int64)
        which[~odd, 0], which[~odd, 1] = heads.indices.drop_null().to_numpy(), marks.indices.drop_null().to_numpy() + first
        which[odd, 0], which[odd, 1] = np.arange(second, len(pieces) - 1), len(pieces) - 1
        ids, bounds = _picked(*_strung(pieces), which.ravel())
        return ids, bounds[::2]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: none), one after the other, and the n + 1 bounds."""
        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        words = split.flatten().dictionary_encode()
        ids, bounds = _picked(*self._words(words.dictionary), words.indices.to_numpy())
        places = split.offsets.to_numpy()
        return ids, bounds[places - places[0]]


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist


def _strung(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    bounds = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum([len(p) // 4 for p in pieces], out=bounds[1:])
    return np.frombuffer(b"".join(pieces), "<u4"), bounds


def _picked(ids: np.ndarray, bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``which`` of ``ids`` in this order, and their bounds."""
    sizes = np.diff(bounds)[which]
    ends = np.append(0, np.cumsum(sizes))
    out = np.empty(ends[-1], ids.dtype)
    for k in range(0, len(which), 1 << 18):  # the places of a long text's ids are not held all at once
        here = slice(k, k + (1 << 18))
        low, high = ends[k], ends[min(k + (1 << 18), len(which))]
        out[low:high] = ids[np.repeat(bounds[which[here]] - ends[:-1][here], sizes[here]) + np.arange(low, high)]
    return out, ends


@lru_cache(1)
def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes spell themselves, others the letters from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
