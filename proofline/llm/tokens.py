"""Exact token ids of whole texts with the ``tokenizers`` library, many texts at a time.

A byte-level BPE without normaliser cuts a text into pieces and encodes each by itself.  Where a piece begins follows
from the kinds of its characters (letter, number, white space, other), so the borders of many texts are found at once in
numpy; the kind of a character is asked of the library's pre-tokeniser.  Every distinct piece is encoded once by the
library's model and remembered; the ids of a text are the ids of its pieces in a row.  Texts with an added token
inside, and all other tokenisers, are encoded by the library whole.
"""

from __future__ import annotations

import functools
import json
import os
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Pieces that a Python worker remembers; later ones are encoded again in each group of texts that holds them.
KEPT_PIECES = 1_000_000
#: Characters that are cut into pieces at once; a longer text is a group of its own.
GROUP_CHARS = 1 << 22
#: Letters that byte-level vocabularies write for the bytes of a text: printable ones stand for themselves, the others follow 255 in order. Fixed values.
_PLAIN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_OTHERS = [b for b in range(256) if b not in _PLAIN]
_LETTERS = np.array([b if b in _PLAIN else 256 + _OTHERS.index(b) for b in range(256)], dtype="<u2")
#: Kinds of characters by one of each, white space behind them, and what stands for a character that was not asked for yet.
_SAMPLES, _WHITE, _UNASKED = "a1!", 3, 255
#: Endings that are a piece with the apostrophe before them where it begins one.
_ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file lies on this machine; every executor asks for itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _values(array: pa.LargeBinaryArray) -> list[bytes]:
    """The values of a whole array without nulls, without a scalar for each."""
    _, spots, data = array.buffers()
    borders, data = np.frombuffer(spots, dtype=np.int64)[: len(array) + 1].tolist(), data.to_pybytes()
    return [data[a:b] for a, b in zip(borders, borders[1:])]


def _groups(texts: list[str], order: list[int]) -> Iterator[list[int]]:
    """Numbers of texts in the given order, so many at once that they hold about ``GROUP_CHARS`` characters."""
    group, chars = [], 0
    for i in order:
        if group and chars + len(texts[i]) > GROUP_CHARS:
            yield group
            group, chars = [], 0
        group.append(i)
        chars += len(texts[i])
    if group:
        yield group


class Encoder:
    """Ids of whole texts as packed little-endian integers of ``width`` bytes (2 if the vocabulary allows)."""

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = vocabulary_path(name)
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            setup = json.load(file)
        before = setup.get("pre_tokenizer") or {}
        self.cuts = (
            setup.get("normalizer") is None and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space", True)
        )
        self.added = [x["content"] for x in setup.get("added_tokens", [])]
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        self.known: dict[bytes, bytes] = {}
        self.kinds = np.full(sys.maxunicode + 1, _UNASKED, dtype=np.uint8)

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype=self.kind).tobytes() for x in found]

    def _kinds_of(self, points: np.ndarray) -> np.ndarray:
        """Kind of each code point; a character is of a sample's kind if the pre-tokeniser leaves both in one piece."""
        found = self.kinds[points]
        if (unasked := found == _UNASKED).any():
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            for point in np.unique(points[unasked]).tolist():
                self.kinds[point] = next((k for k, x in enumerate(_SAMPLES) if len(split(x + chr(point))) == 1), _WHITE)
            found = self.kinds[points]
        return found

    def _starts(self, points: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the pieces of texts begin that lie in a row, none of them empty."""
        kinds = self._kinds_of(points)
        last = np.zeros(len(points), dtype=bool)
        last[ends - 1] = True
        white = kinds == _WHITE
        start = np.ones(len(points), dtype=bool)
        # a run of one kind is a piece, and takes a blank before it along
        start[1:] = (kinds[1:] != kinds[:-1]) & (white[1:] | (points[:-1] != ord(" ")))
        # so the last of several white spaces stands apart, unless it ends the text
        start[:-1] |= white[:-1] & ~white[1:] & ~last[:-1]
        start[begins] = True
        quotes = np.flatnonzero((points == ord("'")) & start)
        for ending in _ENDINGS:
            hits = quotes
            for k, letter in enumerate(ending):
                hits = hits[~last[hits + k]]
                hits = hits[points[hits + k + 1] == ord(letter)]
            start[hits + 1] = False
            hits = hits + len(ending)
            start[hits[~last[hits]] + 1] = True
        return np.flatnonzero(start)

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of pieces by the library's model, which wants a letter for each byte."""
        text = _LETTERS[np.frombuffer(b"".join(pieces), dtype=np.uint8)].tobytes().decode("utf-16-le")
        tokenize, low, ids, spots = self.tokenizer.model.tokenize, 0, [], [0]
        for piece in pieces:
            ids += [x.id for x in tokenize(text[low : low + len(piece)])]
            spots.append(len(ids) * self.width)
            low += len(piece)
        packed = np.asarray(ids, dtype=self.kind).tobytes()
        return {x: packed[a:b] for x, a, b in zip(pieces, spots, spots[1:])}

    def _by_pieces(self, texts: list[str]) -> list[bytes]:
        """Packed ids of texts, none of them empty or with an added token."""
        text = "".join(texts)
        raw = text.encode()
        ends = np.cumsum([len(x) for x in texts])
        begins = np.append(0, ends[:-1])
        points = np.frombuffer(raw, dtype=np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
        starts = self._starts(points, begins, ends)
        firsts = np.searchsorted(starts, begins)
        if len(points) < len(raw):
            starts = np.flatnonzero((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)[starts]
        spots = pa.py_buffer(np.append(starts, len(raw)).astype(np.int64, copy=False))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, spots, pa.py_buffer(raw)]).dictionary_encode()
        distinct, codes, known = _values(pieces.dictionary), pieces.indices.to_numpy(), self.known
        found = list(map(known.get, distinct))
        if missing := [x for x, ids in zip(distinct, found) if ids is None]:
            learnt = self._learn(missing)
            found = [learnt[x] if ids is None else ids for x, ids in zip(distinct, found)]
            known.update((x, learnt[x]) for x in missing[: max(0, KEPT_PIECES - len(known))])
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // self.width
        n = sizes[codes]
        before = np.cumsum(n) - n
        source = np.repeat((np.cumsum(sizes) - sizes)[codes] - before, n)
        source += np.arange(len(source))
        packed = np.frombuffer(b"".join(found), dtype=self.kind)[source].tobytes()
        borders = [*(before[firsts] * self.width).tolist(), len(packed)]
        return [packed[a:b] for a, b in zip(borders, borders[1:])]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed ids of each text; null counts as empty."""
        out: list[bytes] = [b""] * len(texts)
        filled = [i for i, x in enumerate(texts) if x]
        whole = [i for i in filled if not self.cuts or any(a in texts[i] for a in self.added)]
        for i, ids in zip(whole, self._library([texts[i] for i in whole])):
            out[i] = ids
        for group in _groups(texts, sorted(set(filled).difference(whole), key=lambda i: (not texts[i].isascii(), i))):
            for i, ids in zip(group, self._by_pieces([texts[i] for i in group])):
                out[i] = ids
        return out

    def words(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, dtype=self.kind)


@functools.cache
def encoder(name: str) -> Encoder:
    return Encoder(name)


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    wide = ids.astype("<u4", copy=False)
    return zlib.crc32(wide if sys.byteorder == "little" else wide.tobytes())
