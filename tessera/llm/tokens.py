"""Token ids in bulk, equal to the tokenizer's own, at the price of its distinct pieces.

The vocabulary file lower-cases, drops white space and splits letters, single digits and other signs before any merge,
so a text's ids are those of its pieces in order.  Whether a file does is tried on load, on texts of all kinds; for
others every text goes to the tokenizer whole.  Pieces are found with numpy, each distinct one is encoded once a
worker, and ids are gathered.  Texts for which this split isn't plain (apostrophes, special-token strings, control
characters, characters beyond Latin-1 letters) go to the tokenizer whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from tessera.llm import kernel as K

END = 1
#: texts on which the split is held against the tokenizer itself
TRIAL = ("The Quick brown-fox, 12,345 TIMES!", "über naïve Ångström straße façade", " lead\ttab\n\nlines  and   gaps ", "(x) [y] {z} #tag @at $5.00 50% a_b a/b c:d;e", "supercalifragilistic 1990s 3rd x2y", "?!... -- ~ ^ | \\ < > = + * & \"q\"")
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_KIND[0x30:0x3A] = 2
_ODD = np.zeros(256, bool)
_ODD[[*range(0x00, 0x09), *range(0x0E, 0x20), 0x27, 0x7F, *range(0xC0, 0xC3), *range(0xC4, 0x100)]] = True
#: distinct pieces that one worker remembers, some 30 bytes each
CACHE = 1_000_000


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


class PieceTokenizer:
    _own: dict[str, PieceTokenizer] = {}

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        names = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(names.values()) + 1, bool)
        self.closes[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.kind = np.uint16 if len(self.closes) <= 1 << 16 else np.uint32
        self._clear()
        self.split = True
        self.split = all(self._alone(x) == self.tokenizer.encode(x, add_special_tokens=False).ids for x in TRIAL)
        self._clear()

    def _alone(self, text: str) -> list[int] | None:
        try:
            return next(self.encode(pa.array([text])))[1].tolist()[:-1]
        except (ValueError, IndexError):
            return None

    @classmethod
    def of(cls, path: str) -> PieceTokenizer:
        """One per worker process and file, so the cache outlives a task."""
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def _clear(self) -> None:
        # sorted hashes of known pieces, and where each one's ids begin and how many they are
        self.hashes = np.zeros(0, np.uint64)
        self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.ids, self.used = np.zeros(1 << 16, self.kind), 0

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Position of each of the ascending hashes among the known ones, and whether it is there."""
        at = np.searchsorted(self.hashes, hashes)
        found = np.zeros(len(hashes), bool)
        inside = at < len(self.hashes)
        found[inside] = self.hashes[at[inside]] == hashes[inside]
        return at, found

    def _learn(self, at: np.ndarray, hashes: np.ndarray, pieces: list[str]) -> None:
        """Encode many pieces as one text: every piece ends with its only id that closes a word."""
        flat = np.array(self.tokenizer.encode(" ".join(pieces), add_special_tokens=False).ids, np.int64)
        ends = np.flatnonzero(self.closes[flat]) + 1
        if len(ends) != len(pieces) or ends[-1] != len(flat):
            encoded = [x.ids for x in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            flat, ends = np.array([i for x in encoded for i in x], np.int64), np.cumsum([len(x) for x in encoded])
        size = np.diff(ends, prepend=0)
        self.ids = _room(self.ids, self.used + len(flat))
        self.ids[self.used : self.used + len(flat)] = flat
        self.hashes = np.insert(self.hashes, at, hashes)
        self.first = np.insert(self.first, at, (self.used + ends - size).astype(np.uint32))
        self.size = np.insert(self.size, at, size.astype(np.uint32))
        self.used += len(flat)

    def encode(self, column: pa.Array):
        """(low, ids, offsets) for runs of rows, each row's ids closed by END; nulls are empty texts."""
        for low, high, data, offsets in K.blocks(column):
            rows = high - low
            odd = _ODD[data]
            if len(data) > 1:
                odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
                odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
            total = np.concatenate([[0], np.cumsum(odd)])
            plain = (total[offsets[1:]] == total[offsets[:-1]]) & self.split
            part = K.LOWER[data]
            starts, ends = K.runs(_KIND[part], offsets, single=2)
            piece = K.Slice(low, high, part, offsets, starts, ends, np.searchsorted(starts, offsets))
            row = piece.row_of_word()
            keep = plain[row]
            starts, ends, row = starts[keep], ends[keep], row[keep]
            codes, first, which = np.unique(piece.span_hasher()(starts, ends), return_index=True, return_inverse=True)
            if len(self.hashes) > CACHE:
                self._clear()
            at, found = self._places(codes)
            if not found.all():
                new = ~found
                self._learn(at[new], codes[new], [part[starts[i] : ends[i]].tobytes().decode() for i in first[new]])
                at, _ = self._places(codes)
            place = at[which]
            size, begin = self.size[place].astype(np.int64), self.first[place].astype(np.int64)
            count = np.bincount(row, weights=size, minlength=rows).astype(np.int64) if len(row) else np.zeros(rows, np.int64)
            whole = {r: self.tokenizer.encode(data[offsets[r] : offsets[r + 1]].tobytes().decode(), add_special_tokens=False).ids for r in np.flatnonzero(~plain)}
            for r, ids in whole.items():
                count[r] = len(ids)
            out_offsets = np.concatenate([[0], np.cumsum(count + 1)])
            out = np.empty(int(out_offsets[-1]), np.uint32)
            out[out_offsets[1:] - 1] = END
            if len(size):
                n = int(size.sum())
                within = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
                before = np.concatenate([[0], np.cumsum(np.where(plain, count, 0))])[:-1]
                to = np.arange(n) - np.repeat(before, np.where(plain, count, 0)) + np.repeat(out_offsets[:-1], np.where(plain, count, 0))
                out[to] = self.ids[np.repeat(begin, size) + within]
            for r, ids in whole.items():
                out[out_offsets[r] : out_offsets[r] + len(ids)] = ids
            yield low, out, out_offsets
