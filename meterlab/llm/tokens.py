"""Token ids of whole batches through the tokenizers library.

Texts are cut where no token can cross: before a single blank between two visible characters, around a
single line feed between two, and between a letter and a mark that ends a clause.  Pieces repeat a lot, so each distinct piece is encoded once and kept in a
bounded table; ids are then gathered for the whole batch at once.
"""

from __future__ import annotations

import numpy as np

from .bytes import LOWER, mix, ranges, span_hashes

#: Places in the table of known pieces (a power of two), and ids kept before it starts anew.
PLACES, KEPT_IDS = 1 << 21, 4 << 20
#: First bytes of the characters among which Unicode has white space outside ASCII: no cuts next to these.
WIDE_GAPS = (0xC2, 0xE1, 0xE2, 0xE3)


def _visible() -> tuple[np.ndarray, np.ndarray]:
    plain = np.zeros(256, bool)
    plain[0x21:0x7F] = True
    follows = plain.copy()
    follows[0x80:] = True
    lead = follows.copy()
    lead[list(WIDE_GAPS)] = False
    return follows, lead


FOLLOWS, LEAD = _visible()
LETTER, CLAUSE_END = np.zeros(256, bool), np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
CLAUSE_END[list(b".,;:!?")] = True


def piece_cuts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Offsets of the pieces: the texts' own and those where every tokenizer of the family cuts."""
    n = len(buf)
    if n < 3:
        return np.unique(off)
    at = np.flatnonzero((buf[1:-1] == 32) | (buf[1:-1] == 10)) + 1
    before, after = buf[at - 1], buf[at + 1]
    ok = FOLLOWS[before] & LEAD[after]
    wide = (before >= 0x80) & ((buf[at - 2] == 0xC2) | np.isin(buf[at - 3], WIDE_GAPS[1:]))  # at small positions these wrap to other bytes: at worst a cut fewer
    at = at[ok & ~wide]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    at = at[~edge[at] & ~edge[at + 1]]
    lines = at[buf[at] == 10] + 1
    edge[at] = True
    edge[lines] = True
    ends = np.flatnonzero(CLAUSE_END[buf[2:]]) + 2
    last = buf[ends - 1]
    edge[ends[LETTER[last] | ((buf[ends - 2] == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7))]] = True
    return np.flatnonzero(edge)


class Encoder:
    """``Encoder(text of the file)(buf, off)`` gives all ids (uint32) and the number of ids of each text."""

    def __init__(self, text: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(text)
        steps = (json.loads(text).get("normalizer") or {}).get("normalizers", [])
        self.folds = any(x.get("type") == "Lowercase" for x in steps)
        self._clear()

    @classmethod
    def shared(cls, text: str) -> Encoder:
        """The encoder of this worker process: what one task has learnt serves the next."""
        import sys

        held = vars(sys).setdefault("_meterlab_encoders", {})
        key = hash(text)
        if key not in held:
            held[key] = cls(text)
        return held[key]

    def _clear(self) -> None:
        self.keys = np.zeros(PLACES, np.uint64)
        self.place = np.full(PLACES, -1, np.int32)
        self.ids = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.start = np.empty(1 << 16, np.int64)
        self.size = np.empty(1 << 16, np.int64)
        self.known = 0

    def _learn(self, pieces: list[str]) -> np.ndarray:
        """Numbers of the new pieces."""
        lists = [e.ids for e in self.model.encode_batch_fast(pieces, add_special_tokens=False)]
        lens = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((i for x in lists for i in x), np.uint32, int(lens.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.known + len(lens) > len(self.start):
            self.start = np.concatenate([self.start, np.empty_like(self.start)])
            self.size = np.concatenate([self.size, np.empty_like(self.size)])
        self.ids[self.used:self.used + len(flat)] = flat
        self.start[self.known:self.known + len(lens)] = self.used + np.cumsum(lens) - lens
        self.size[self.known:self.known + len(lens)] = lens
        numbers = np.arange(self.known, self.known + len(lens))
        self.used += len(flat)
        self.known += len(lens)
        return numbers

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.used > KEPT_IDS:
            self._clear()
        raw = buf.tobytes()
        if self.folds and b"<|" not in raw:  # special tokens are matched before case is dropped
            buf = LOWER[buf]
            raw = buf.tobytes()
        cuts = piece_cuts(buf, off)
        s, e = cuts[:-1], cuts[1:]
        if not len(s):
            return np.empty(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        h = span_hashes(buf, s, e)
        h[h == 0] = 1
        slot = (mix(h ^ np.uint64(0x51ED270B)) & np.uint64(PLACES - 1)).astype(np.int64)
        number = np.where(self.keys[slot] == h, self.place[slot], -1).astype(np.int64)
        miss = np.flatnonzero(number < 0)
        if len(miss):
            distinct, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[first]
            new = self._learn([raw[a:b].decode("utf-8", "replace") for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)])
            number[miss] = new[back]
            self.keys[slot[at]] = distinct
            self.place[slot[at]] = new
        size = self.size[number]
        ids = self.ids[ranges(self.start[number], size)]
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(total[np.searchsorted(cuts, off)])
