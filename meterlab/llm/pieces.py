"""Sentence pieces by vectorised merge rounds, and their decoding.

Texts are cut between characters that no piece holds side by side, so no merge crosses a cut, and each distinct word
of a slice of texts is encoded once.  Words lie in flat arrays of symbols.  A round finds the least pair rank of each
word (a segmented minimum), merges its pairs of that rank from the left, all at once, and closes the gaps; words
without a known pair leave.  Merging at once equals merging one by one as long as no pair that a merge creates ranks as
low as the merged ones, so the pairs after the first merge that does so wait for the next round.

Made for models of type BPE with byte fallback and without normalisation, user-defined or unused pieces; others are
refused.  Null text is empty; an empty text has the end id alone; rows are kept as they are, repeated or not; an empty
table gives no rows; columns other than the keys and the text are ignored.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytes import ranges, slices, utf8
from .tallies import strings

SPACE = "▁"
#: Rank of a pair that is no piece.
NONE = np.iinfo(np.int32).max
#: Bytes of text encoded and ids decoded at once.
SLICE = 2 << 20


class Pieces:
    """The tables of a model: symbols of characters, pieces of pairs and their ranks, bytes of pieces."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        own, norm = spec.trainer_spec, spec.normalizer_spec
        kinds = np.array([p.type for p in spec.pieces])
        if own.model_type != own.BPE or not own.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces \
                or own.treat_whitespace_as_suffix or not norm.add_dummy_prefix or not norm.escape_whitespaces or np.isin(kinds, (4, 5)).any():
            raise ValueError("needs a BPE model with byte fallback and a dummy prefix, without normalisation or user-defined pieces")
        sp = SentencePieceProcessor(model_proto=model)
        self.end = sp.eos_id()
        names = [p.piece for p in spec.pieces]
        normal = {names[i]: i for i in np.flatnonzero(kinds == 1).tolist()}
        symbol = dict(normal)
        for name in normal:
            for c in name:  # a character that is no piece of its own may still be part of one
                symbol.setdefault(c, len(names) + len(symbol) - len(normal))
        self.width = len(names) + len(symbol)
        self.of_char = np.full(0x110000, -1, np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        self.of_char[32] = self.of_char[ord(SPACE)]
        order = {s: i for i, s in enumerate(sorted({spec.pieces[i].score for i in normal.values()}, reverse=True))}
        pairs = {}
        self.joins = np.zeros((256, 256), bool)
        self.joins[:, 0x80:0xC0] = True  # within a character
        for name, i in normal.items():
            raw = [c.encode() for c in name.replace(SPACE, " ")]
            for j in range(1, len(name)):
                self.joins[raw[j - 1][-1], raw[j][0]] = True
                a, b = symbol.get(name[:j]), symbol.get(name[j:])
                if a is not None and b is not None:
                    pairs[a * self.width + b] = (i, order[spec.pieces[i].score])
        self._place(pairs)
        byte = {int(names[i][3:5], 16): i for i in np.flatnonzero(kinds == 6).tolist()}
        self.byte = np.array([byte[b] for b in range(256)], np.int32)
        shown = [b"" if k == 3 else own.unk_surface.encode() if k == 2 else bytes([int(n[3:5], 16)]) if k == 6 else n.replace(SPACE, " ").encode()
                 for n, k in zip(names, kinds.tolist(), strict=True)]
        self.raw = np.frombuffer(b"".join(shown), np.uint8)
        self.raw_at = np.concatenate([[0], np.cumsum([len(x) for x in shown])])
        self.is_byte = kinds == 6
        self.blank_first = np.array([len(x) > 0 and x[0] == 32 and k == 1 for x, k in zip(shown, kinds.tolist(), strict=True)])

        self.blanks = self._blanks([spec.pieces[normal[n]].score for n in names if set(n) == {SPACE} and len(n) > 1 and n in normal],
                                   min(p.score for p in spec.pieces), max((len(n) for n in names if set(n) == {SPACE}), default=1))

    def _blanks(self, scores: list[float], least: float, longest: int) -> int:
        """After how many blanks a run of them may be cut (0: nowhere): they must merge last, and from the left in blocks."""
        if not scores or max(scores) > least:
            return 0
        runs = [self.words(SPACE * n, np.array([n]))[0].tolist() for n in range(1, 3 * longest + 1)]
        return longest if all(runs[n] == runs[longest - 1] + runs[n - longest] for n in range(longest, len(runs))) else 0

    @classmethod
    def shared(cls, model: bytes) -> "Pieces":
        """The tables of this worker process."""
        held = vars(sys).setdefault("_meterlab_pieces", {})
        if model not in held:
            held.clear()
            held[model] = cls(model)
        return held[model]

    def _place(self, pairs: dict[int, tuple[int, int]]) -> None:
        """The pairs in a table with few collisions; a pair lies at its place or soon after."""
        bits = max(4, (len(pairs) * 12).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.piece, self.rank = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), np.full(1 << bits, NONE, np.int32)
        keys = np.array(sorted(pairs), np.int64)
        for key, at in zip(keys.tolist(), self._slot(keys).tolist(), strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) & self.last
            self.keys[at], (self.piece[at], self.rank[at]) = key, pairs[key]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols, NONE if it is no piece."""
        key = left.astype(np.int64) * self.width + right
        key[(left < 0) | (right < 0)] = -2
        at = self._slot(key)
        held = self.keys[at]
        wrong = np.flatnonzero((held != key) & (held >= 0))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) & self.last
            held = self.keys[at[wrong]]
            wrong = wrong[(held != key[wrong]) & (held >= 0)]
        return np.where(self.keys[at] == key, self.rank[at], NONE), self.piece[at]

    def cuts(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Offsets of the words: the texts' own, and those where no piece joins two characters."""
        edge = np.ones(len(buf) + 1, bool)
        edge[1:-1] = ~self.joins[buf[:-1], buf[1:]]
        edge[off] = True
        if self.blanks:
            blank = buf == 32
            long = np.flatnonzero(blank & np.concatenate([[False], blank[:-1]]))  # rare: blanks after blanks
            if len(long):
                first = np.maximum.accumulate(np.where(blank & ~np.concatenate([[False], blank[:-1] & ~edge[1:-1]]), np.arange(len(buf)), 0))
                edge[long[(long - first[long]) % self.blanks == 0]] = True
        return np.flatnonzero(edge)

    def words(self, text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that stand one after the other in ``text``, with their numbers of characters; and how many each has."""
        char = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        symbol, word = self.of_char[char], np.repeat(np.arange(len(lengths)), lengths)
        done = []
        rank, piece = np.full(len(symbol), NONE, np.int32), np.zeros(len(symbol), np.int32)

        def rate(at):  # the pairs that begin at these places
            at = at[(at >= 0) & (at < len(symbol) - 1)]
            rank[at], piece[at] = self.pairs(symbol[at], symbol[at + 1])
            rank[at[word[at] != word[at + 1]]] = NONE

        rate(np.arange(len(symbol)))
        while len(symbol):
            start = np.flatnonzero(np.diff(word, prepend=-1))
            size = np.diff(np.append(start, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, start), size)
            over = least == NONE
            if over.any():
                done.append((word[over], symbol[over], char[over]))
                stay = ~over
                symbol, word, char, rank, piece, least = symbol[stay], word[stay], char[stay], rank[stay], piece[stay], least[stay]
                if not len(symbol):
                    break
            hit = rank == least
            place = np.arange(len(symbol))
            begin = hit & ~np.concatenate([[False], hit[:-1]])
            at = np.flatnonzero(hit & ((place - np.maximum.accumulate(np.where(begin, place, 0))) % 2 == 0))
            # what a merge creates: with the symbol before it, merged or not, and with the one after it
            before = symbol[at - 1].copy()
            joined = np.flatnonzero(np.diff(at) == 2) + 1
            before[joined] = piece[at[joined - 1]]
            left, _ = self.pairs(before, piece[at])
            left[(at == 0) | (word[at - 1] != word[at])] = NONE
            after = np.minimum(at + 2, len(symbol) - 1)
            right, _ = self.pairs(piece[at], symbol[after])
            right[(at + 2 >= len(symbol)) | (word[after] != word[at])] = NONE
            early = np.minimum(left, right) <= least[at]
            if early.any():
                own = word[at]
                head = np.flatnonzero(np.diff(own, prepend=-1))
                seen = np.cumsum(early) - early
                at = at[seen == np.repeat(seen[head], np.diff(np.append(head, len(own))))]
            symbol[at] = piece[at]
            stay = np.ones(len(symbol), bool)
            stay[at + 1] = False
            at = at - np.arange(len(at))  # one symbol went for each merge before
            symbol, word, char, rank, piece = symbol[stay], word[stay], char[stay], rank[stay], piece[stay]
            rank[-1] = NONE
            rate(np.concatenate([at - 1, at]))
        if not done:
            return np.empty(0, np.int32), np.zeros(len(lengths), np.int64)
        word, symbol, char = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        word, symbol, char = word[order], symbol[order], char[order]
        lost = np.flatnonzero((symbol < 0) | (symbol >= len(self.is_byte)))
        if len(lost):  # bytes of characters that are no pieces
            raw = [chr(c).encode() for c in char[lost].tolist()]
            n = np.ones(len(symbol), np.int64)
            n[lost] = [len(x) for x in raw]
            ids = np.repeat(symbol, n)
            at = np.cumsum(n) - n
            ids[ranges(at[lost], n[lost])] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
            symbol, word = ids, np.repeat(word, n)
        return symbol, np.bincount(word, minlength=len(lengths))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids with the end ids, and the number of ids of each text."""
        buf, off = utf8(texts)
        if SPACE.encode() in buf.tobytes():
            buf, off = utf8(pc.replace_substring(texts, SPACE, " "))
        filled = np.diff(off) > 0
        shift = np.concatenate([[0], np.cumsum(filled)])
        own = np.full(len(buf) + int(shift[-1]), 32, np.uint8)  # a blank before each text
        own[np.arange(len(buf)) + np.repeat(shift[1:], np.diff(off))] = buf
        off = off + shift
        if not len(own):
            return np.full(len(off) - 1, self.end, np.int32), np.ones(len(off) - 1, np.int64)
        cuts = self.cuts(own, off)
        coded = strings(own, np.diff(cuts)).dictionary_encode()
        chars, at = utf8(coded.dictionary)
        lead = np.concatenate([[0], np.cumsum((chars & 0xC0) != 0x80)])
        ids, n = self.words(chars.tobytes().decode(), np.diff(lead[at]))
        code = coded.indices.to_numpy()
        first = np.cumsum(n) - n
        per = np.add.reduceat(np.append(n[code], 0), np.searchsorted(cuts[:-1], off[:-1])) if len(off) > 1 else np.empty(0, np.int64)
        per = np.where(filled, per, 0)
        out = np.full(int(per.sum()) + len(per), self.end, np.int32)
        out[np.arange(int(per.sum())) + np.repeat(np.arange(len(per)), per)] = ids[ranges(first[code], n[code])]
        return out, per + 1

    def decode(self, ids: np.ndarray, n: np.ndarray) -> pa.Array:
        """The text of each run of ``n`` ids."""
        at = np.cumsum(n) - n
        size = self.raw_at[ids + 1] - self.raw_at[ids]
        start = self.raw_at[ids].copy()
        shown = np.flatnonzero(size > 0)
        head = np.searchsorted(shown, at)  # the first piece of each text that shows
        head = shown[head[(head < len(shown))]] if len(shown) else shown
        text = np.repeat(np.arange(len(n)), n)
        head = np.unique(head)
        head = head[self.blank_first[ids[head]] & (np.searchsorted(shown, at[text[head]]) == np.searchsorted(shown, head))]
        start[head] += 1
        size[head] -= 1
        buf = self.raw[ranges(start, size)]
        ends = np.concatenate([[0], np.cumsum(size)])
        off = ends[np.concatenate([[0], np.cumsum(n)])]
        loose = self.is_byte[ids]
        apart = loose[:-2] & loose[2:] & (size[1:-1] == 0)  # a control piece parts two bytes
        broken = np.unique(text[1:-1][apart]) if len(ids) > 2 else np.zeros(0, np.int64)
        try:
            buf.tobytes().decode()
        except UnicodeDecodeError:
            broken = np.unique(text[loose])
        if not len(broken):
            return strings(buf, np.diff(off))
        run = np.where(loose, np.cumsum(~loose) + 1, 0)
        out = [buf[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        for i in broken.tolist():
            mine = slice(int(at[i]), int(at[i] + n[i]))
            out[i] = _mended(out[i], np.repeat(run[mine], size[mine])).encode()
        return pa.array(out, pa.binary()).cast(pa.string())


def _mended(raw: bytes, run: np.ndarray) -> str:
    """Bytes of a run of byte pieces that form no character become replacement characters, one each."""
    out, i = [], 0
    while i < len(raw):
        for k in range(1, 5):
            try:
                if i + k <= len(raw) and (run[i:i + k] == run[i]).all():
                    out.append(raw[i:i + k].decode())
                    i += k
                    break
            except UnicodeDecodeError:
                pass
        else:
            out.append("\ufffd")
            i += 1
    return "".join(out)


def _lists(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(docs: DataFrame, model: bytes, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys`` and ``ids``, the array of the text's ids with the end id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.shared(model)
        for batch in batches:
            for part in slices(batch, "__text", SLICE):
                ids, n = pieces.encode(part.column("__text"))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in keys], _lists(ids, n)], names=[*keys, "ids"])

    rows = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    return rows.mapInArrow(run, T.StructType([*[rows.schema[k] for k in keys], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, model: bytes, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys``, ``ids`` and ``text``, the text that the ids stand for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.shared(model)
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False).astype(np.int64))
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE // 4, "right")))
                part = batch.slice(i, j - i)
                lists = part.column("ids")
                text = pieces.decode(lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in (*keys, "ids")], pc.cast(text, pa.string())], names=[*keys, "ids", "text"])
                i = j

    rows = encoded.select(*keys, "ids")
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())]))
