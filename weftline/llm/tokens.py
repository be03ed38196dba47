"""Whole texts to token ids with the tokenizers library, remembering the ids of words met before.

The word vocabulary encodes each pre-token by itself, and no pre-token holds white space. Texts of common characters are
cut at white space, and only pieces not met before go through the library; any other text goes through it whole.
"""

from __future__ import annotations

import os
import re

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from weftline.llm.common import rest_worker, take_worker, worker_cache  # noqa: E402
from weftline.llm.shingles import Strings, mix, split_words  # noqa: E402

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
#: Id appended to every document.
END = 1
#: Fixed value: the vocabulary's pre-token pattern, spelt for characters on which Python's classes agree with it.
_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+|\n")
#: Characters whose normal form, lower case or class needs the library; <| may begin a special token.
_CONTROL = re.compile("[\0-\x08\x0e-\x1f\x7f]|<\\|")
_ODD = re.compile("[^\t-\r -~¡-¬®-±´-¸º»¿-įı-ɏ‐-‧€]|<\\|")
#: Pieces remembered by a process at once, and bytes up to which a string stands in the table itself.
REMEMBERED, SHORT = 500_000, 16

_held: dict[str, TextEncoder] = {}


def joined(strings: list[bytes]) -> Strings:
    """Strings that follow each other."""
    ends = np.cumsum([len(x) for x in strings], dtype=np.int64)
    return Strings(np.frombuffer(b"".join(strings), np.uint8), np.concatenate([[0], ends[:-1]]), ends)


class Memo:
    """Strings and the ids of each, as stretches of one array; a string is found by all of its bytes.

    Strings of up to SHORT bytes stand, as two numbers, in an open-addressing table that is searched for many at once.
    Longer ones, and the rare ones whose hash another string has, are kept in a dictionary. No string holds a zero byte.
    """

    def __init__(self, bits: int = 16) -> None:
        self._table(bits)
        self.count = 0
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.length = np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int32)
        self.low, self.high = np.empty(1 << 14, np.uint64), np.empty(1 << 14, np.uint64)
        self.hits = np.empty(1 << 14, np.int32)
        self.odd: dict[bytes, int] = {}

    def _table(self, bits: int) -> None:
        self.keys, self.values, self.mask = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32), (1 << bits) - 1

    def find(self, strings: Strings) -> np.ndarray:
        """The place of each string, -1 for those not met."""
        low, high, hashes = self._spelt(strings)
        out = np.full(len(hashes), -1, np.int64)
        slot, left = (hashes & np.uint64(self.mask)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            key = self.keys[slot]
            same = key == hashes[left]
            out[left[same]] = self.values[slot[same]]
            on = ~same & (key != 0)
            left, slot = left[on], (slot[on] + 1) & self.mask
        odd = strings.sizes > SHORT
        if self.count:
            odd |= (out >= 0) & ((self.low[out] != low) | (self.high[out] != high))
        some = np.flatnonzero(odd)
        out[some] = [self.odd.get(x, -1) for x in strings.listed(some)]
        return out

    def _spelt(self, strings: Strings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The first SHORT bytes as two numbers, and their hash, which is never 0."""
        low, high = strings.lane(0), np.zeros(len(strings), np.uint64)
        some = np.flatnonzero(strings.sizes > 8)
        high[some] = strings.lane(1, some)
        return low, high, mix(mix(low) + high) | np.uint64(1)

    def _enter(self, hashes: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Which of these strings stand in the table; of those with one hash, the first to come."""
        slot, left, lost = (hashes & np.uint64(self.mask)).astype(np.int64), np.arange(len(hashes)), []
        while len(left):
            free = np.flatnonzero(self.keys[slot] == 0)
            mine = free[np.unique(slot[free], return_index=True)[1]]  # one string for each free slot
            self.keys[slot[mine]], self.values[slot[mine]] = hashes[left[mine]], values[left[mine]]
            met = self.keys[slot] == hashes[left]
            met[mine] = True
            other = met.copy()
            other[mine] = False
            lost.append(left[other])
            left, slot = left[~met], (slot[~met] + 1) & self.mask
        inside = np.ones(len(hashes), bool)
        inside[np.concatenate([np.empty(0, np.int64), *lost])] = False
        return inside

    def add(self, strings: Strings, ids: np.ndarray, stops: np.ndarray) -> None:
        """Distinct strings not met before; stops: where the ids of each end."""
        n, m = self.count, len(strings)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + m > len(self.start):
            self.start, self.length, self.low, self.high, self.hits = (np.concatenate([x, np.empty_like(x)]) for x in (self.start, self.length, self.low, self.high, self.hits))
        low, high, hashes = self._spelt(strings)
        self.flat[self.used : self.used + len(ids)] = ids
        begins = np.concatenate([[0], stops[:-1]])
        self.start[n : n + m], self.length[n : n + m] = self.used + begins, stops - begins
        self.low[n : n + m], self.high[n : n + m], self.hits[n : n + m] = low, high, 0
        self.used += len(ids)
        self.count += m
        if 2 * self.count > self.mask:
            keys, values = self.keys[held := self.keys != 0], self.values[held]
            self._table(int(2 * self.count).bit_length() + 1)
            self._enter(keys, values)
        short = np.flatnonzero(strings.sizes <= SHORT)
        inside = self._enter(hashes[short], (n + short).astype(np.int32))
        odd = np.concatenate([np.flatnonzero(strings.sizes > SHORT), short[~inside]])
        self.odd.update(zip(strings.listed(odd), (n + odd).tolist(), strict=True))

    def prune(self, most: int) -> None:
        """Keep the ``most`` strings that were asked for most often; their hits count half from now on."""
        kept = np.sort(np.argsort(-self.hits[: self.count], kind="stable")[:most])
        place = np.full(self.count, -1, np.int32)
        place[kept] = np.arange(len(kept), dtype=np.int32)
        length, hits = self.length[kept], self.hits[kept] // 2
        ids, ends = self.ids(kept)
        keys, values = self.keys[self.keys != 0], place[self.values[self.keys != 0]]
        begins = ends - length
        low, high = self.low[kept], self.high[kept]
        odd = {x: int(place[i]) for x, i in self.odd.items() if place[i] >= 0}
        self.__init__(max(16, (2 * len(kept)).bit_length() + 1))
        self.count, self.used, self.odd = len(kept), len(ids), odd
        self.flat = np.concatenate([ids, self.flat])
        self.start, self.length = np.concatenate([begins, self.start]), np.concatenate([length, self.length])
        self.low, self.high, self.hits = np.concatenate([low, self.low]), np.concatenate([high, self.high]), np.concatenate([hits, self.hits])
        self._enter(keys[values >= 0], values[values >= 0])

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the strings at these places in a row, and where those of each end."""
        self.hits[: self.count] += np.bincount(at, minlength=self.count).astype(np.int32)
        length = self.length[at].astype(np.int64)
        ends = np.cumsum(length)
        return self.flat[np.repeat(self.start[at] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)], ends


class TextEncoder:
    """Pieces between white space are looked up, their pre-tokens are where they are new, and new pre-tokens are encoded.

    Beyond ``remembered`` pieces, or pre-tokens, the half that was asked for most often stays.
    """

    def __init__(self, path: str, remembered: int):
        self.remembered = remembered
        self.tokenizer = Tokenizer.from_file(path)
        shape = self.tokenizer.to_str(pretty=False)
        self.by_word = '"end_of_word_suffix":"</w>"' in shape and r"'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in shape
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        vocabulary = self.tokenizer.get_vocab()
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        """Drop all that is remembered."""
        self.pieces, self.words = Memo(), Memo()

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, pieces: list[bytes]) -> None:
        """Remember distinct pieces: their pre-tokens are looked up, and those not met before are encoded."""
        found = _PRE_TOKEN.findall(b"\n".join([*pieces, b""]).decode())  # no piece holds a line feed: it ends the piece
        last = np.flatnonzero(np.array([w == "\n" for w in found], bool)) - np.arange(1, len(pieces) + 1)
        words = [w for w in found if w != "\n"]
        encoded = " ".join(words).encode().split(b" ")
        spelt = joined(encoded)
        at = self.words.find(spelt)
        if (at < 0).any():
            unknown = np.flatnonzero(at < 0)
            strings = {encoded[j]: words[j] for j in unknown.tolist()}
            ids = self._whole(" ".join(strings.values()))
            stops = np.flatnonzero(self.ends[ids]) + 1  # the ids that end a pre-token
            if len(stops) != len(strings):
                each = [self._whole(w) for w in strings.values()]
                ids, stops = np.concatenate(each), np.cumsum([len(x) for x in each])
            self.words.add(joined(list(strings)), ids, stops)
            at = self.words.find(spelt)
        ids, ends = self.words.ids(at)
        self.pieces.add(joined(pieces), ids, ends[last])

    def documents(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each whole text (none for null) and the end id, as unsigned 32-bit numbers."""
        out: list = [np.array([END], np.uint32)] * len(texts)
        plain, encoded = [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.by_word or (_ODD.search(text) if not text.isascii() else _CONTROL.search(text)):
                out[i] = np.append(self._whole(text), np.uint32(END))
                continue
            plain.append(i)
            encoded.append(text.lower().encode())
        for memo in (self.pieces, self.words):
            if memo.count > self.remembered:
                memo.prune(self.remembered // 2)
        pieces, counts = split_words(encoded)
        at = self.pieces.find(pieces)
        if (at < 0).any():
            unknown = np.flatnonzero(at < 0)
            self._learn(list(dict.fromkeys(pieces.listed(unknown))))
            at[unknown] = self.pieces.find(Strings(pieces.data, pieces.starts[unknown], pieces.ends[unknown]))
        ids, ends = self.pieces.ids(at)
        ends = np.concatenate([[0], ends])[np.cumsum([0, *counts.tolist()])]
        joined = np.insert(ids, ends[1:], np.uint32(END))  # one end id after the ids of each text
        for j, i in enumerate(plain):
            out[i] = joined[ends[j] + j : ends[j + 1] + j + 1]
        return out


def encoder(path: str, remembered: int = REMEMBERED) -> TextEncoder:
    """One encoder a process and vocabulary file, which remembers so many pieces at most."""
    take_worker("tokens")
    if path not in _held:
        _held[path] = TextEncoder(path, remembered)
        rest_worker()  # what reading the vocabulary took
    _held[path].remembered = remembered
    return _held[path]


worker_cache("tokens", _held.clear)
