"""Words of whole texts as numpy arrays: where they are, exact codes of them and of runs of them, and digests.

A word is a maximal run of bytes other than ASCII white space, so of `[^\\x20\\x09-\\x0D]+`. Codes number the words
(or runs) of one batch: equal code, equal words. Digests are BLAKE2b over the words themselves and hold between
batches.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa

U = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Odd multipliers of the two lanes that digests of runs have.
LANES = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))
#: Words whose digests a worker keeps.
KEPT = 60_000
_known: dict[bytes, bytes] = {}


def forget() -> None:
    """Drop the digests that a worker keeps."""
    _known.clear()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def lanes(digests: list[bytes]) -> np.ndarray:
    """16-byte digests as (n, 2) words."""
    return np.frombuffer(b"".join(digests), U).reshape(-1, 2)


def digest(data: bytes | memoryview, salt: int = 0) -> bytes:
    return blake2b(data, digest_size=16, salt=salt.to_bytes(16, "little")).digest()


def word_digests(words: list[bytes]) -> np.ndarray:
    """(n, 2) lanes of distinct words."""
    if len(_known) > KEPT:
        _known.clear()
    out = []
    for w in words:
        d = _known.get(w)
        if d is None:
            d = digest(w)
            if len(w) < 64:
                _known[w] = d
        out.append(d)
    return lanes(out)


def _pieces(width: int) -> list[int]:
    """`width` as a sum of powers of two, the greatest first."""
    return [1 << b for b in range(width.bit_length() - 1, -1, -1) if width >> b & 1]


def _runs(values: np.ndarray, width: int, join) -> np.ndarray:
    """A value for each run of `width` values, joined two at a time in a tree."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    out, place, of, span = None, 0, {}, 1
    pieces, h = _pieces(width), values
    while True:
        if span in pieces:
            of[span] = h
        if span == pieces[0]:
            break
        h = join(h[:-span], h[span:])
        span *= 2
    for p in pieces:
        part = of[p][place : place + n]
        out = part if out is None else join(out, part)
        place += p
    return out


def run_digests(values: np.ndarray, width: int, lane: int) -> np.ndarray:
    """A digest for each run of `width` digests of one lane. Every join is mixed, so that no two orders of the same
    words, however regular, meet but by chance."""
    a = LANES[lane]
    return _runs(values, width, lambda x, y: mix(x * a + y))


def run_codes(codes: np.ndarray, width: int) -> np.ndarray:
    """An exact code for each run of `width` codes: two are equal if and only if the runs are."""

    def join(x, y):
        top = int(y.max()) + 1 if len(y) else 1
        if len(x) and int(x.max()) + 1 > (1 << 62) // top:
            x = np.unique(x, return_inverse=True)[1]
            if (int(x.max()) + 1) * top > 1 << 62:
                y = np.unique(y, return_inverse=True)[1]
                top = int(y.max()) + 1
        return x * top + y

    return _runs(codes.astype(np.int64), width, join)


def coded(data: np.ndarray, inside: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Codes of strings, and the distinct ones: `inside` marks the bytes of `data` that belong to them, and they
    stand there one after another in `size` bytes each."""
    offsets = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=offsets[1:])
    d = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


class Words:
    """The words of a batch of texts (null: none): text number and byte span of each."""

    def __init__(self, col: pa.Array, lower: bool = False):
        rows = [(t or "").encode("utf-8") for t in col.to_pylist()]
        self.n_texts = len(rows)
        data = b" ".join(rows) + b" "
        self.bytes = np.frombuffer(data, np.uint8)
        if lower:
            self.bytes = LOWER[self.bytes]
        size = np.fromiter(map(len, rows), np.int64, len(rows)) + 1
        self.text_end = np.cumsum(size)
        self.text_start = self.text_end - size
        inside = ~IS_SPACE[self.bytes]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=np.int8(0)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, np.concatenate([self.text_start, [len(data)]]))
        self.count = np.diff(self.first)
        self.text = np.repeat(np.arange(len(rows)), self.count)
        self.inside = inside

    def codes(self) -> tuple[np.ndarray, list[bytes]]:
        """A code for each word, and the distinct words."""
        codes, words = coded(self.bytes, self.inside, self.end - self.start)
        return codes, words.to_pylist()

    def digests(self) -> np.ndarray:
        """(words, 2) lanes."""
        codes, words = self.codes()
        return word_digests(words)[codes]

    def spans(self, first: np.ndarray, last: np.ndarray, salt: int = 0) -> list[bytes]:
        """Digests of the words from `first` to before `last` of each run, one blank between words: of the words
        themselves, whatever stood between them."""
        held = self.inside.copy()
        if len(self.end):
            held[self.end] = True  # one byte after each word
        data = np.where(self.inside, self.bytes, np.uint8(32))[held].tobytes()
        ends = np.cumsum(self.end - self.start + 1)
        a = (ends - (self.end - self.start + 1))[first].tolist()
        b = (ends[last - 1] - 1).tolist()
        view = memoryview(data)
        return [digest(view[i:j], salt) for i, j in zip(a, b, strict=True)]

    def sums(self, per_word: np.ndarray) -> np.ndarray:
        """Sum of a value per word, by text."""
        total = np.concatenate([[0], np.cumsum(per_word)])
        return np.diff(total[self.first])
