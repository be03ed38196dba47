"""Word shingle sets of whole texts as sorted 64-bit hashes, computed with numpy over many texts at once."""

from __future__ import annotations

import numpy as np
import xxhash

_U = np.uint64
#: Bytes looked at in one go; words are never cut.
_SPAN = 1 << 18
#: Bytes of a word that are hashed in lanes of eight; what a longer word has beyond them goes through a library.
_LANED = 256
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Strings:
    """Byte strings that stand in one array, read in lanes of eight bytes."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends, self.sizes = data, starts, ends, ends - starts
        full = np.zeros(len(data) // 8 * 8 + 24, np.uint8)
        full[: len(data)] = data
        self._aligned = full.view("<u8")

    def __len__(self) -> int:
        return len(self.starts)

    def listed(self, some: np.ndarray) -> list[bytes]:
        data = self.data.tobytes() if len(some) else b""
        return [data[a:b] for a, b in zip(self.starts[some].tolist(), self.ends[some].tolist(), strict=True)]

    def lane(self, i: int, some: np.ndarray | None = None) -> np.ndarray:
        """Bytes 8 * i and following of each string (or of some), as a number; bytes beyond its end are 0."""
        starts, sizes = (self.starts, self.sizes) if some is None else (self.starts[some], self.sizes[some])
        at = starts + 8 * i
        word, off = at >> 3, ((at & 7) << 3).astype(np.uint64)
        word = np.minimum(word, len(self._aligned) - 2)
        low, high = self._aligned[word] >> off, self._aligned[word + 1] << ((_U(64) - off) & _U(63))
        return np.where(off > 0, low | high, low) & _MASK[np.clip(sizes - 8 * i, 0, 8)]

    def hashes(self, seed: int = 0) -> np.ndarray:
        """64-bit hashes. Of two strings of at most eight bytes and one length no two are alike; longer ones are chained
        through a bijection that mixes every lane before the next one comes in."""
        out = mix(mix(self.lane(0) ^ _U(seed)) + self.sizes.astype(np.uint64) * _U(0xD1342543DE82EF95))
        some, i = np.flatnonzero(self.sizes > 8), 1
        while len(some) and 8 * i < _LANED:
            out[some] = mix(out[some] ^ self.lane(i, some))
            i += 1
            some = some[self.sizes[some] > 8 * i]
        for j in some.tolist():
            rest = self.data[self.starts[j] + _LANED : self.ends[j]].tobytes()
            out[j : j + 1] = mix(out[j : j + 1] ^ _U(xxhash.xxh3_64_intdigest(rest, seed)))
        return out


def split_words(encoded: list[bytes]) -> tuple[Strings, np.ndarray]:
    """The words of all texts, A-Z lower-cased, in their order, and the number of words of each text."""
    data = _LOWER[np.frombuffer(b" ".join([*encoded, b""]), np.uint8)]
    starts, ends = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for at in range(0, len(data), _SPAN):
        apart = _SEPARATOR[data[at : at + _SPAN]]
        before = bool(_SEPARATOR[data[at - 1]]) if at else True
        edges = np.diff(np.concatenate([[before], apart]).view(np.int8))
        starts.append(np.flatnonzero(edges < 0) + at)
        ends.append(np.flatnonzero(edges > 0) + at)
    words = Strings(data, np.concatenate(starts), np.concatenate(ends))  # the last byte is a separator
    limits = np.cumsum([len(x) + 1 for x in encoded])
    return words, np.diff(np.searchsorted(words.starts, limits, "left"), prepend=0)


def word_hashes(texts: list[str], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in their order, and the number of words of each text."""
    words, counts = split_words([t.encode("utf-8", "surrogatepass") for t in texts])
    return words.hashes(seed), counts


def shingle_sets(texts: list[str], width: int = 5, seed: int = 0) -> list[np.ndarray]:
    """For each text its distinct shingles, sorted; a text of fewer words has them all as one, without words none."""
    words, counts = word_hashes(texts, seed)
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | _U(1)
    whole = max(0, len(words) - width + 1)
    rolled = np.zeros(whole, np.uint64)
    for j in range(width):
        rolled += words[j : j + whole] * factors[j]
    rolled = mix(rolled + _U(width))
    out, at = [], 0
    for n in counts.tolist():
        if n >= width:
            s = np.sort(rolled[at : at + n - width + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif n:
            s = mix(np.atleast_1d((words[at : at + n] * factors[:n]).sum(dtype=np.uint64)) + _U(n))
        else:
            s = np.empty(0, np.uint64)
        out.append(s)
        at += n
    return out


def set_key(s: np.ndarray, salt: int = 0xA5A5F00DCAFEBEEF) -> int:
    """A signed 64-bit key of a set, whatever its order; other salts give independent keys."""
    return int((mix(s ^ _U(salt)).sum(dtype=np.uint64) + _U(len(s))).astype(np.int64)) if len(s) else 0


def set_bits(s: np.ndarray) -> bytes:
    """A bitmap of at least four bits an element; its length is a power of two."""
    size = 64
    while size < 4 * len(s):
        size *= 2
    marked = np.zeros(size, bool)
    marked[(s & _U(size - 1)).astype(np.int64)] = True
    return np.packbits(marked, bitorder="little").tobytes()


def set_words(s: np.ndarray) -> np.ndarray:
    """A bitmap of 512 bits as eight signed 64-bit numbers."""
    marked = np.zeros(512, bool)
    marked[(s & _U(511)).astype(np.int64)] = True
    return np.packbits(marked, bitorder="little").view("<i8")


def most_common(a: bytes, b: bytes, n: int, m: int) -> int:
    """No two sets of n and m elements with these bitmaps share more: bits that differ stand for elements that do."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return (n + m - int(np.bitwise_count(x ^ y).sum())) // 2
