"""Token ids of Latin-1 texts for tokenizers that keep letters, digits and signs apart and drop case.

A batch of texts is one array of bytes. Its units (runs of letters, runs of signs, single digits; words with an
apostrophe whole) are found and hashed by numpy, each distinct unit that the worker doesn't know goes through the
tokenizer once, and the ids of all units are gathered. Units are told apart by a hash of 64 bits.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np

from .byte_words import hashes

#: Units whose ids a worker keeps; beyond it those used longest ago go, down to half.
CACHED_UNITS = 1_000_000
BLANK, LETTER, SIGN, NUMBER = range(4)
#: Byte-level vocabularies write bytes that don't print as the characters from 256. Blanks stay, as they part units here.
_SHOWN = np.arange(256, dtype="<u4")
_SHOWN[[*range(33), *range(127, 161), 173]] = 256 + np.arange(68)
_SHOWN[32] = 32


def _kind(code: int) -> int:
    if code in (9, 10, 11, 12, 13, 32, 133, 160):
        return BLANK
    first = unicodedata.category(chr(code))[0]
    return LETTER if first == "L" else NUMBER if first == "N" else SIGN


_KINDS = np.array([_kind(c) for c in range(256)], np.uint8)


class LatinUnits:
    """Encodes lists of Latin-1 texts; `whole` gives the ids of a word with an apostrophe."""

    def __init__(self, tokenizer, dtype: np.dtype, whole: Callable[[str], list[int]]):
        from tokenizers import Tokenizer, pre_tokenizers

        self.plain = Tokenizer(tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.whole, self.dtype = whole, dtype
        self.ends = np.zeros(tokenizer.get_vocab_size(), bool)
        self.ends[[k for t, k in tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.keys, self.rows = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.starts, self.sizes, self.used, self.ids = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, dtype)
        self.turn = 0

    def _learn(self, units: list[bytes], mixed: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units one after another, how many each has)."""
        alone = [u.decode("latin-1") for u, m in zip(units, mixed, strict=True) if not m]
        joined = " ".join(alone)
        if not joined.isascii() or not joined.isprintable():
            joined = _SHOWN[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-32-le")
        found = np.array(self.plain.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
        last = np.flatnonzero(self.ends[found]) + 1
        if len(last) != len(alone):  # a vocabulary without some of the bytes
            raise ValueError("the tokenizer leaves out characters of Latin texts")
        sizes = np.diff(last, prepend=0)
        if len(alone) == len(units):
            return found, sizes
        rest, out, k = iter(np.split(found, last[:-1]) if len(last) else []), [], 0
        for u, m in zip(units, mixed, strict=True):
            out.append(np.array(self.whole(u.decode("latin-1")), self.dtype) if m else next(rest))
            k += 1
        return np.concatenate(out), np.array([len(x) for x in out], np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. All texts must be Latin-1 and lower-case."""
        data = "\n".join(texts).encode("latin-1") + b"\n"
        raw = np.frombuffer(data, np.uint8)
        kind = _KINDS[raw]
        edge = np.empty(len(raw), bool)
        edge[0] = True
        np.not_equal(kind[1:], kind[:-1], out=edge[1:])
        number = kind == NUMBER
        if number.any():
            edge |= number
        quoted = None
        if 39 in data:
            word = np.cumsum((kind != BLANK) & np.append(True, kind[:-1] == BLANK))
            odd = np.zeros(int(word[-1]) + 1, bool)
            odd[word[raw == 39]] = True
            quoted = odd[word] & (kind != BLANK)
            edge &= ~quoted | np.append(True, kind[:-1] == BLANK)
        at = np.flatnonzero(edge)
        size = np.diff(at, append=len(raw))
        keep = kind[at] != BLANK
        at, size = at[keep], size[keep]
        bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
        if not len(at):
            return [np.empty(0, self.dtype)] * len(texts)
        key = hashes(raw, at, size)
        keys, first, back = np.unique(key, return_index=True, return_inverse=True)
        row = self._rows(keys, at[first], size[first], data, None if quoted is None else quoted[at[first]])
        unit_row = row[back]
        sizes = self.sizes[unit_row]
        ends = np.cumsum(sizes)
        out = self.ids[np.arange(int(ends[-1])) + np.repeat(self.starts[unit_row] - ends + sizes, sizes)]
        cut = np.append(0, ends)[np.searchsorted(at, bounds)]
        return [out[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]

    def _rows(self, keys: np.ndarray, at: np.ndarray, size: np.ndarray, data: bytes, quoted: np.ndarray | None) -> np.ndarray:
        """Row in the cache of each unit (sorted keys); new units are encoded and kept."""
        self.turn += 1
        if len(self.keys) > CACHED_UNITS:
            self._forget()
        place = np.searchsorted(self.keys, keys)
        known = place < len(self.keys)
        known[known] = self.keys[place[known]] == keys[known]
        row = np.empty(len(keys), np.int64)
        row[known] = self.rows[place[known]]
        new = np.flatnonzero(~known)
        if len(new):
            a, n = at[new].tolist(), size[new].tolist()
            mixed = [False] * len(new) if quoted is None else quoted[new].tolist()
            ids, sizes = self._learn([data[i : i + k] for i, k in zip(a, n, strict=True)], mixed)
            row[new] = np.arange(len(self.sizes), len(self.sizes) + len(new))
            self.starts = np.concatenate((self.starts, len(self.ids) + np.cumsum(sizes) - sizes))
            self.sizes, self.ids = np.concatenate((self.sizes, sizes)), np.concatenate((self.ids, ids))
            self.used = np.concatenate((self.used, np.zeros(len(new), np.int64)))
            self.keys = np.insert(self.keys, place[new], keys[new])
            self.rows = np.insert(self.rows, place[new], row[new])
        self.used[row] = self.turn
        return row

    def _forget(self) -> None:
        """Keeps the half of the units that was used last."""
        age = self.used[self.rows]
        stay = age >= np.partition(age, len(age) // 2)[len(age) // 2]
        if stay.all():  # all of one batch: none is older
            stay = np.arange(len(age)) % 2 == 0
        rows = self.rows[stay]
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        self.ids = self.ids[np.arange(int(ends[-1])) + np.repeat(self.starts[rows] - ends + sizes, sizes)]
        self.starts, self.sizes, self.used = ends - sizes, sizes, self.used[rows]
        self.keys, self.rows = self.keys[stay], np.arange(len(rows))
