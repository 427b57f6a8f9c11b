"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

Words of a whole block are found by array operations. Words not seen before lie in one flat symbol array; each
round looks up every neighbouring pair by binary search over the sorted pair keys, takes the lowest rank of every
word and merges all its occurrences at once, until no word has a pair left. A direct-mapped table keyed by two
64-bit word hashes remembers words already encoded in this worker; its size is fixed, and a word that is pushed
out is simply encoded again.

Ids are those of the tokenizers library for the same file with ``add_special_tokens=False`` and no truncation or
padding: added tokens found in a text become their own id and split it. Null and empty texts have no ids.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import regex

from .textarrays import PrefixHash, mix, ranges, spans

_SLOTS = 1 << 21  # remembered words of a worker
_POOL = 1 << 23  # ids kept for them; the memory starts anew when they are full
_LONG = 1 << 10  # words beyond this many bytes are encoded but not remembered

LETTER, NUMBER, WHITE, OTHER = 0, 1, 2, 3


@lru_cache(1)
def class_table() -> np.ndarray:
    """Letter, number, white space or other for every code point, as the split pattern sees them."""
    table = np.full(0x110000, OTHER, np.uint8)
    points = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\p{White_Space}+")):
        for found in regex.finditer(pattern, points):
            table[ord(points[found.start()]) : ord(points[found.end() - 1]) + 1] = kind
    table[0xD800:0xE000] = OTHER
    return table


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies, and back."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    """Encoder and decoder of one tokenizer file; ``Bpe.load`` keeps one for each worker."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        to_byte = byte_symbols()
        self.size = max(max(vocab.values()), *[a["id"] for a in spec["added_tokens"]], 0) + 1
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.byte_ids = np.zeros(256, np.int32)
        for symbol, byte in to_byte.items():
            self.byte_ids[byte] = vocab[symbol]
        content = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items() if all(c in to_byte for c in t)}
        self.added = {a["content"].encode(): a["id"] for a in spec["added_tokens"]}
        content |= {i: t for t, i in self.added.items()}
        pieces = [content.get(i, b"") for i in range(self.size)]
        self.piece_at = np.concatenate([[0], np.cumsum([len(p) for p in pieces])])
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self._forget()

    @staticmethod
    @lru_cache(4)
    def load(path: str) -> Bpe:
        return Bpe(path)

    def _forget(self):
        self.slot_key = np.zeros((2, _SLOTS), np.uint64)
        self.slot_at = np.zeros(_SLOTS, np.int64)
        self.slot_n = np.zeros(_SLOTS, np.int32)
        self.pool, self.pooled = np.zeros(_POOL, np.int32), 0

    # -- words -----------------------------------------------------------------------------------------------

    def _added_spans(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """Start, end and id of every added token, leftmost first, the longest at a place; none crosses texts."""
        raw, found = data.tobytes(), []
        if not any(t and t in raw for t in self.added):
            return found
        pattern = regex.compile(b"|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)))
        for start, end in zip(offsets[:-1], offsets[1:], strict=True):
            found += [(m.start(), m.end(), self.added[m[0]]) for m in pattern.finditer(raw, start, end)]
        return found

    @staticmethod
    def _classes(data: np.ndarray) -> np.ndarray:
        """Class of the code point that each byte belongs to."""
        table = class_table()
        out = table[data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            padded = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.uint32)
            b0, b1, b2, b3 = (padded[lead + k] for k in range(4))
            point = np.where(
                b0 < 0xE0,
                (b0 & 0x1F) << 6 | b1 & 0x3F,
                np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | (b1 & 0x3F) << 6 | b2 & 0x3F, (b0 & 7) << 18 | (b1 & 0x3F) << 12 | (b2 & 0x3F) << 6 | b3 & 0x3F),
            )
            kind = table[point]
            for k, width in ((0, 0xC0), (1, 0xC0), (2, 0xE0), (3, 0xF0)):
                wide = b0 >= width
                out[lead[wide] + k] = kind[wide]
        return out

    def split(self, data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Starts of all words. ``cuts``: sorted offsets no word or look-ahead may cross, 0 and the end included.

        The rule is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
        """
        n = len(data)
        if not n:
            return np.zeros(0, np.int64)
        kind = self._classes(data)
        is_cut = np.zeros(n + 1, bool)
        is_cut[cuts] = True
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        start |= is_cut[:n]
        run = np.flatnonzero(start)
        run_end = np.append(run[1:], n)
        # The last white space before a word goes to the word if it is a blank, else it is a word of its own.
        white = (kind[run] == WHITE) & ~is_cut[run_end]
        last = run_end[white] - 1
        while len(more := np.flatnonzero((data[last] & 0xC0) == 0x80)):  # of several bytes: back to the first
            last[more] -= 1
        start[last] = True
        blank = data[last] == 0x20
        start[run_end[white][blank]] = False
        # Contractions: a lone apostrophe that begins a word, and letters after it.
        lone = run[(kind[run] == OTHER) & (run_end - run == 1) & (data[run] == 0x27)]
        lone = lone[start[lone] & ~is_cut[np.minimum(lone + 1, n)]]
        if len(lone):
            padded = np.append(data, np.zeros(2, np.uint8))
            a, b = padded[lone + 1], padded[lone + 2]
            b = np.where(is_cut[np.minimum(lone + 2, n)], 0, b)
            one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
            two = np.zeros(len(lone), bool)
            for pair in (b"re", b"ve", b"ll"):
                two |= (a == pair[0]) & (b == pair[1])
            begin = lone[one | two]
            after = begin + np.where(one, 2, 3)[one | two]
            start[begin + 1] = False
            inner = after[after < n]
            inner = inner[(kind[inner] == LETTER) & (kind[inner - 1] == LETTER) & ~is_cut[inner]]
            start[inner] = True
        return np.flatnonzero(start)

    # -- encoding --------------------------------------------------------------------------------------------

    def _merge(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given words and the number of ids of each, by merge rounds over one flat array."""
        lengths = ends - starts
        words = len(starts)
        symbols = self.byte_ids[data[ranges(starts, lengths)]]
        word = np.repeat(np.arange(words), lengths)
        done_word, done_symbols = [], []
        none = np.int32(len(self.keys))
        rank = np.full(len(symbols), none)  # of the pair that begins at a symbol
        changed = np.arange(len(symbols))
        while len(symbols):
            last = np.append(word[1:] != word[:-1], True)
            changed = changed[~last[changed]]
            key = symbols[changed].astype(np.int64) << 32 | symbols[changed + 1]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank[changed] = np.where(self.keys[at] == key, self.ranks[at], none)
            rank[last] = none
            first = np.flatnonzero(np.append(True, last[:-1]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(symbols)))
            best_of = np.repeat(best, size)
            take = (rank == best_of) & (best_of < none)
            again = np.flatnonzero(take[1:] & take[:-1])  # runs of one symbol merge from the left, two by two
            if len(again):
                begin = np.flatnonzero(take & ~np.append(False, take[:-1]))
                here = np.flatnonzero(take)
                base = begin[np.searchsorted(begin, here, "right") - 1]
                take[here[(here - base) % 2 == 1]] = False
            symbols[take] = self.merged[rank[take]]
            keep = ~np.append(False, take[:-1])
            over = best_of == none
            if over.any():
                done_word.append(word[over])
                done_symbols.append(symbols[over])
                keep &= ~over
            symbols, word, rank, take = symbols[keep], word[keep], rank[keep], take[keep]
            changed = np.flatnonzero(take | np.append(take[1:], False))
        if not done_word:
            return np.zeros(0, np.int32), np.zeros(words, np.int64)
        word, symbols = np.concatenate(done_word), np.concatenate(done_symbols)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=words)

    def _words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, place, number): the ids of word i are ids[place[i]:place[i] + number[i]]."""
        keys = [PrefixHash(data, salt).pieces(starts, ends) for salt in (0, 1)]
        mixed = mix(keys[0])
        slot = (mixed >> np.uint64(64 - _SLOTS.bit_length() + 1)).astype(np.int64)
        known = (self.slot_key[0][slot] == keys[0]) & (self.slot_key[1][slot] == keys[1])
        place, number = self.slot_at[slot], self.slot_n[slot].astype(np.int64)
        missing = np.flatnonzero(~known)
        if not len(missing):
            return self.pool, place, number
        a, b = keys[0][missing], keys[1][missing]
        order = np.lexsort((b, a))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(fresh) - 1
        first = missing[order[fresh]]
        ids, count = self._merge(data, starts[first], ends[first])
        at = np.cumsum(count) - count
        if self.pooled + len(ids) > _POOL:  # nothing of the old pool may be used below: keep it for this call
            old = self.pool
            self._forget()
            if len(ids) > _POOL:
                joined = np.concatenate([old, ids])
                place[missing], number[missing] = at[which] + len(old), count[which]
                return joined, place, number
            joined = np.concatenate([old, ids])
            place[missing], number[missing] = at[which] + len(old), count[which]
        else:
            joined = self.pool
            place[missing], number[missing] = at[which] + self.pooled, count[which]
        self.pool[self.pooled : self.pooled + len(ids)] = ids
        short = ends[first] - starts[first] <= _LONG
        into, source = slot[first][short], first[short]
        self.slot_key[0][into], self.slot_key[1][into] = keys[0][source], keys[1][source]
        self.slot_at[into], self.slot_n[into] = (at + self.pooled)[short], count[short]
        # Two new words may share a slot: all four fields come from the one that was written last.
        self.pooled += len(ids)
        return joined, place, number

    def _pieces(self, data: np.ndarray, offsets: np.ndarray):
        """(ids, place, number, first word of every text) of a block."""
        added = self._added_spans(data, offsets)
        cuts = np.unique(np.concatenate([offsets, [x for s, e, _ in added for x in (s, e)]]).astype(np.int64))
        starts = self.split(data, cuts)
        if added:
            inside = np.zeros(len(data), bool)
            for s, e, _ in added:
                inside[s:e] = True
            starts = np.union1d(starts[~inside[starts]], [s for s, _, _ in added]).astype(np.int64)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        ids, place, number = self._words(data, starts, ends)
        if added:
            ids = np.concatenate([ids, np.array([i for _, _, i in added], np.int32)])
            at = np.searchsorted(starts, [s for s, _, _ in added])
            place[at], number[at] = len(ids) - len(added) + np.arange(len(added)), 1
        return ids, place, number, np.searchsorted(starts, offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a block one after another, and the offsets of the texts among them."""
        ids, place, number, first = self._pieces(data, offsets)
        at = np.concatenate([[0], np.cumsum(number)])
        return ids[ranges(place, number)], at[first]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all id sequences one after another, and their offsets; unknown ids stand for nothing."""
        ids = np.asarray(ids, np.int64)
        valid = (ids >= 0) & (ids < self.size)
        ids = np.where(valid, ids, 0)
        size = np.where(valid, self.piece_at[ids + 1] - self.piece_at[ids], 0)
        at = np.concatenate([[0], np.cumsum(size)])
        return self.piece_bytes[ranges(self.piece_at[ids], size)], at[offsets]


def default_path() -> str:
    """The public byte-level vocabulary of 50,257 ids; called on the worker, so no file is shipped."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


__all__ = ["Bpe", "class_table", "default_path", "spans"]
