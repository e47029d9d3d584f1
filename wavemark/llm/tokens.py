"""Whole-text encoding with a public tokenizer, and fixed-width packing of the ids."""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np

from .common import cpu_env
from .latin_units import LatinUnits

#: Distinct words whose ids a worker keeps, in each of two generations: words seen since the last change outlive it.
CACHED_WORDS = 250_000
#: Longer words are encoded without being kept.
CACHED_WORD_CHARS = 48

#: Fixed value: the pre-tokenizer pattern of the word tokenizers whose letters and other signs never join.
LETTERS_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters of texts that are encoded at a time.
PIECE_CHARS = 1 << 21


class Encoder:
    """Encodes texts with a `tokenizers` file whose pre-tokenizer never joins across blanks.

    Where the file's own description says that letters, digits and signs are apart and case is dropped, Latin-1 texts go
    to LatinUnits. Others are split at blanks, and the distinct words that a batch of texts has and the worker doesn't
    know yet go through the tokenizer once. `by_word=False` encodes each text as one string, for tokenizers that see blanks.
    """

    def __init__(self, path: str, by_word: bool = True):
        cpu_env()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.by_word = by_word
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        told = json.loads(self.tokenizer.to_str())
        self.special = [x["content"] for x in told["added_tokens"]]
        steps = (told["pre_tokenizer"] or {}).get("pretokenizers", [])
        kinds = [x["type"] for x in (told["normalizer"] or {}).get("normalizers", [])]
        apart = kinds == ["NFC", "Replace", "Lowercase"] and len(steps) == 2 and steps[0].get("pattern") == {"Regex": LETTERS_APART} and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"]
        apart = apart and told["model"]["type"] == "BPE" and told["model"].get("end_of_word_suffix") == "</w>"
        self.latin = LatinUnits(self.tokenizer, self.dtype, self._list) if apart else None

    def _list(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _words(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text by its words. Words live through two generations of the cache; long ones are never kept."""
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        if len(self.known) > CACHED_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        fresh = set().union(*split).difference(known)
        for w in fresh:
            found = older.get(w)
            known[w] = array(self.code, self._list(w)).tobytes() if found is None else found
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), self.dtype) for words in split]
        for w in fresh:
            if len(w) > CACHED_WORD_CHARS:
                del known[w]
        return out

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each whole text; a null text counts as empty. Some texts, or a piece of a long one, are encoded at a time."""
        if not self.by_word:
            return [np.array(self._list(t) if t else [], self.dtype) for t in texts]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        latin: list[tuple[int, str]] = []
        other: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            for held, encode in ((latin, self.latin and self.latin.encode), (other, self._words)):
                if held:
                    for (row, _), found in zip(held, encode([t for _, t in held]), strict=True):
                        out[row].append(found)
                    held.clear()

        for row, text in enumerate(texts):
            at, text = 0, text or ""
            while at < len(text):
                end = len(text)
                if end - at > PIECE_CHARS:  # a text is cut at a blank
                    end = text.find(" ", at + PIECE_CHARS) + 1 or end
                piece = text[at:end]
                if self.latin and _is_latin(piece) and not any(x in piece for x in self.special):
                    latin.append((row, piece.lower()))
                else:
                    other.append((row, piece))
                size += end - at
                at = end
                if size >= PIECE_CHARS:
                    flush()
                    size = 0
        flush()
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.empty(0, self.dtype) for x in out]

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of one whole text."""
        return self.many([text])[0]


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, by_word: bool = True) -> Encoder:
    """This worker process's encoder of the file; it outlives a task, as workers do."""
    if (path, by_word) not in _encoders:
        _encoders[path, by_word] = Encoder(path, by_word)
    return _encoders[path, by_word]


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)


def width_of(vocabulary: int) -> int:
    """The least number of bits that holds every id of the vocabulary."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """Ids one after another, `width` bits each, lowest bit first, the last byte filled with zeros."""
    if width in (8, 16, 32):
        return np.ascontiguousarray(ids, f"<u{width // 8}").tobytes()
    shifts, out = np.arange(width, dtype=np.uint32), []
    for at in range(0, len(ids), 1 << 18):  # a multiple of 8 ids ends at a whole byte
        some = np.asarray(ids[at : at + (1 << 18)], np.uint32)
        out.append(np.packbits(((some[:, None] >> shifts) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack_bits(payload: bytes, width: int, first: int, count: int) -> np.ndarray:
    """`count` ids from the id numbered `first`; only their own bytes are read."""
    if width in (8, 16, 32):
        size = width // 8
        return np.frombuffer(payload, f"<u{size}", count, first * size)
    at, out, shifts = first * width, np.empty(count, np.uint32), np.arange(width, dtype=np.uint32)
    for k in range(0, count, 1 << 18):
        n = min(1 << 18, count - k)
        begin = at + k * width
        raw = np.frombuffer(payload, np.uint8, (begin + n * width + 7) // 8 - begin // 8, begin // 8)
        bits = np.unpackbits(raw, bitorder="little")[begin % 8 : begin % 8 + n * width].reshape(n, width)
        out[k : k + n] = (bits.astype(np.uint32) << shifts).sum(1, dtype=np.uint32)
    return out
