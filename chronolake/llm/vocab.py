"""Token ids of whole texts by a public tokenizer, a column at a time.

The tokenizer drops white space and cuts the rest, lower-cased, into letters,
single digits and other signs, before its byte pair merges.  For printable ASCII
and composed Latin letters these parts are found by a few passes over the bytes
of all texts; equal parts are merged once, and remembered.  A run of other bytes
that has anything else in it (apostrophes cut differently, marks compose, special
tokens come first) is a part of its own and goes through the whole tokenizer.

The memory has two halves of a fixed size: what was met since the older half was
dropped stays, so frequent parts do and a worker's memory doesn't grow.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

from chronolake.llm import bytekit as bk

#: Classes of bytes; letters include both bytes of the composed Latin letters.
BLANK, LETTER, DIGIT, SIGN, ODD, WHOLE = range(6)
CLASS = np.full(256, ODD, np.uint8)
CLASS[0x21:0x7F] = SIGN
CLASS[ord("'")] = ODD
for _first, _last, _kind in (("A", "Z", LETTER), ("a", "z", LETTER), ("0", "9", DIGIT)):
    CLASS[ord(_first) : ord(_last) + 1] = _kind
CLASS[bk.SPACE] = BLANK
#: Parts that need only the merges, and how runs of plain characters with apostrophes are cut.
MERGED = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|(?:(?!<\|)[!-&(-/:-@[-`{-~])+")
PLAIN = re.compile(r"(?:(?!<\|)[!-~À-ÖØ-öø-ÿ])+")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: How the merges show bytes: printable Latin-1 as it is, the others from code point 256 on.
_PRINTED = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
KEPT = 300_000


def parts(raw: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The parts of joined texts (bytes, text offsets), lower-cased, and the number of parts before each text's end."""
    kind, low = CLASS[raw], bk.LOWER[raw]
    lead = np.flatnonzero(raw == 0xC3)
    trail = raw[lead + 1]
    letter = (trail != 0x97) & (trail != 0xB7)  # all but these two
    kind[lead[letter]] = kind[lead[letter] + 1] = LETTER
    low[lead[letter & (trail < 0x9F)] + 1] += 32
    special = np.flatnonzero(raw == ord("<"))
    special = special[special < len(raw) - 1]
    kind[special[raw[special + 1] == ord("|")]] = ODD
    solid = kind != BLANK
    opens = np.zeros(len(raw), bool)  # where a text begins
    opens[offs[:-1][offs[:-1] < len(raw)]] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | opens[1:]
    runs = np.flatnonzero(first)
    odd = np.unique(np.searchsorted(runs, np.flatnonzero(kind == ODD), "right") - 1)
    if len(odd):
        edge = np.zeros(len(raw) + 1, np.int8)
        np.add.at(edge, runs[odd], 1)
        np.add.at(edge, np.append(runs, len(raw))[odd + 1], -1)
        whole = np.cumsum(edge[:-1], dtype=np.int8).astype(bool) & solid
        kind[whole] = WHOLE
        np.copyto(low, raw, where=whole)
    first = solid.copy()
    first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) | opens[1:]
    starts = np.flatnonzero(first)
    upto = np.cumsum(solid, dtype=np.int32)
    ends = np.append(upto[starts] - 1, upto[-1] if len(upto) else 0).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(low[solid])])
    return found, np.searchsorted(starts, offs[1:])


class Vocabulary:
    """Ids of texts, as numbers of 16 bits where all of a vocabulary's fit, else of 32."""

    def __init__(self, path: str, kept: int = KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.whole, self.kept = Tokenizer.from_file(path), kept
        self.model = self.whole.model
        self.width = 2 if self.whole.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.code = next(c for c in "HIL" if array(c).itemsize == self.width)
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def _merged(self, text: str) -> bytes:
        shown = text if text.isascii() else text.encode().decode("latin-1").translate(SHOWN)
        return self.packed([t.id for t in self.model.tokenize(shown)])

    def _made(self, part: bytes) -> bytes:
        if part.isalpha():  # of bytes: ASCII letters only, and lower-cased
            return self._merged(part.decode())
        text = part.decode("utf-8", "replace")
        if MERGED.fullmatch(text):
            return self._merged(text)
        if PLAIN.fullmatch(text):
            return b"".join([self._merged(p) if "'" in p else self.known(p.encode()) for p in PARTS.findall(text.lower())])
        return self.packed(self.whole.encode(text, add_special_tokens=False).ids)

    def known(self, part: bytes) -> bytes:
        got = self.young.get(part)
        if got is None:
            got = self.old.get(part)
            if got is None:
                got = self._made(part)
            if len(part) <= 64:
                if len(self.young) >= self.kept:
                    self.young, self.old = {}, self.young
                self.young[part] = got
        return got

    def encode(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of joined texts, one text after the other, and how many there are up to each text's end."""
        found, of_text = parts(raw, offs)
        coded = found.dictionary_encode()
        each = list(map(self.known, coded.dictionary.to_pylist()))
        table = np.frombuffer(b"".join(each), np.dtype(f"u{self.width}"))
        size = np.fromiter(map(len, each), np.int64, len(each)) // self.width
        begin = np.cumsum(size) - size
        which = coded.indices.to_numpy()
        many = size[which]
        end = np.concatenate(([0], np.cumsum(many)))
        return table[np.repeat(begin[which] - end[:-1], many) + np.arange(end[-1])], end[of_text]


_opened: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary a worker and file, kept from task to task."""
    if path not in _opened:
        _opened[path] = Vocabulary(path)
    return _opened[path]
