"""Exact and fast ids from the tokenizers library.

A byte-pair encoder works on one pre-token (word piece of text) at a time, so
equal pre-tokens always give equal ids. Here numpy finds the pre-tokens of a
whole batch, each distinct one is given to the library's model once, and the
ids are gathered from that memory. Texts or tokenizers outside the two known
splitting rules go to the library whole. The memory is bounded: it is emptied
when it holds MAX_PIECES.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np
import pandas as pd
import regex
from tokenizers import Tokenizer

from .textvec import _table, flatten, span_hashes

MAX_PIECES = 1_500_000
_SPACE, _LETTER, _NUMBER, _OTHER = 1, 2, 3, 4


@cache
def _classes() -> np.ndarray:
    out = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    for kind, pattern in ((_SPACE, r"\p{White_Space}"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
        found = "".join(regex.findall(pattern + "+", every))
        out[np.frombuffer(found.encode("utf-32-le"), "<u4")] = kind
    return out


@cache
def _lower() -> np.ndarray:
    """Code point -> its lower case; 0 where that isn't one code point of the same class."""
    kinds = _classes()

    def one(c: str) -> int:
        low = c.lower()
        return ord(low) if len(low) == 1 and kinds[ord(low)] == kinds[ord(c)] else 0

    return _table(one)


@cache
def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256 and up."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


def _contractions(cp: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each "'" in at: the length of 's 't 'm 'd 're 've 'll there, or 0."""
    last = off[np.searchsorted(off, at, "right")] - 1  # last place of the same text
    one = cp[np.minimum(at + 1, last)]
    two = cp[np.minimum(at + 2, last)]
    room1, room2 = at + 1 <= last, at + 2 <= last
    short = room1 & np.isin(one, [ord(c) for c in "stmd"])
    long = room2 & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
    return np.where(short, 2, np.where(long, 3, 0))


class PieceTokenizer:
    """ids(texts) equals the library's encode(text, add_special_tokens=False).ids of each."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        pre, norm = repr(self.tokenizer.pre_tokenizer), repr(self.tokenizer.normalizer)
        letters = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
        if norm == "None" and re.fullmatch(r"ByteLevel\(add_prefix_space=False, trim_offsets=\w+, use_regex=True\)", pre):
            self.rule = "spaced"
        elif letters in pre.replace("\\\\", "\\") and "Lowercase()" in norm and "NFC()" in norm and "add_prefix_space=False" in pre:
            self.rule = "words"
        else:
            self.rule = "whole"
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of known pieces
        self.where = np.zeros(0, np.int64)  # of each: its entry
        self.at = np.zeros(1, np.int64)  # entry -> start of its ids in pool
        self.pool = np.zeros(0, np.uint32)

    def ids(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (uint32) and the offsets of each text."""
        texts = [t or "" for t in texts]
        if self.rule == "whole":
            return self._whole(texts)
        if self.rule == "words":
            if odd := {i for i, t in enumerate(texts) if not unicodedata.is_normalized("NFC", t)}:
                return self._mixed(texts, odd)
        cp, off = flatten(texts)
        if self.rule == "words":
            low = _lower()[cp]
            if len(odd := np.flatnonzero((low == 0) & (cp != 0))):  # characters whose lower case is several
                return self._mixed(texts, set(np.searchsorted(off, odd, "right") - 1))
            cp = low
        start, end = self._pieces(cp, off)
        hashes = span_hashes(cp, start, end)
        code, unique = pd.factorize(hashes)
        first = np.zeros(len(unique), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        entry = self._entries(unique, cp, start[first], end[first])
        n = (self.at[entry + 1] - self.at[entry])[code]
        begin = self.at[entry][code]
        total = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=total[1:])
        flat = self.pool[np.repeat(begin - total[:-1], n) + np.arange(total[-1])]
        return flat, total[np.searchsorted(start, off)]

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        off = np.zeros(len(got) + 1, np.int64)
        np.cumsum([len(x) for x in got], out=off[1:])
        return np.fromiter((i for x in got for i in x), np.uint32, off[-1]), off

    def _mixed(self, texts: list[str], odd: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """Texts at odd go to the library whole, the others by pieces; in order."""
        rest = [i for i in range(len(texts)) if i not in odd]
        a, a_off = self.ids([texts[i] for i in rest])
        b, b_off = self._whole([texts[i] for i in sorted(odd)])
        parts: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        for k, i in enumerate(rest):
            parts[i] = a[a_off[k] : a_off[k + 1]]
        for k, i in enumerate(sorted(odd)):
            parts[i] = b[b_off[k] : b_off[k + 1]]
        off = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=off[1:])
        return np.concatenate(parts), off

    def _pieces(self, cp: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the pre-tokens start and end."""
        n = len(cp)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kind = _classes()[cp]
        border = np.zeros(n + 1, bool)
        border[off] = True
        turn = np.ones(n, bool)  # a run of one class begins
        np.not_equal(kind[1:], kind[:-1], out=turn[1:])
        turn |= border[:-1]
        cut = turn.copy()
        space = kind == _SPACE
        if self.rule == "spaced":
            ends = np.ones(n, bool)  # the last of a run
            ends[:-1] = turn[1:]
            last = np.flatnonzero(space & ends & ~border[1:])  # the last white space before something
            cut[last] = True
            cut[last[cp[last] == 0x20] + 1] = False
        else:
            cut |= kind == _NUMBER
        ticks = np.flatnonzero((cp == 0x27) & turn)
        if len(ticks):
            if self.rule == "spaced":
                ticks = ticks[border[ticks] | (cp[ticks - 1] != 0x20)]
            size = _contractions(cp, off, ticks)
            ticks, size = ticks[size > 0], size[size > 0]
            cut[ticks + 1] = False
            after = ticks + size
            cut[after[after < n]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], n)
        if self.rule == "words":
            keep = ~space[start]
            start, end = start[keep], end[keep]
        return start, end

    def _entries(self, hashes: np.ndarray, cp: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The entry of each distinct piece; asks the model for those not known yet."""
        if len(self.keys) > MAX_PIECES:
            self._clear()
        place = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), bool)
        inside = place < len(self.keys)
        known[inside] = self.keys[place[inside]] == hashes[inside]
        out = np.zeros(len(hashes), np.int64)
        out[known] = self.where[place[known]]
        if len(new := np.flatnonzero(~known)):
            letters, ask = _byte_letters(), self.model.tokenize
            got, sizes = [], []
            for s, e in zip(start[new].tolist(), end[new].tolist(), strict=True):
                text = cp[s:e].tobytes().decode("utf-32-le")
                ids = [t.id for t in ask("".join([letters[b] for b in text.encode()]))]
                got += ids
                sizes.append(len(ids))
            base = len(self.at) - 1
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
            self.pool = np.concatenate([self.pool, np.array(got, np.uint32)])
            out[new] = base + np.arange(len(new))
            new = new[np.argsort(hashes[new])]
            place = np.searchsorted(self.keys, hashes[new])
            self.keys, self.where = np.insert(self.keys, place, hashes[new]), np.insert(self.where, place, out[new])
        return out


@cache
def tokenizer(path: str) -> PieceTokenizer:
    """One for each worker process and file."""
    return PieceTokenizer(path)
