"""Token ids of whole texts with the `tokenizers` library, encoding each distinct piece of a batch only once.

The text is cut only where the tokenizer's own pre-tokenizer always cuts: at ASCII white space, and between ASCII
letters, ASCII digits and other ASCII bytes, never next to an apostrophe (contractions) nor next to a non-ASCII byte
(normalisation). ASCII capitals are lowered first unless a non-ASCII byte follows. A text that holds a special token's
string in any case, is encoded whole by the library, and so is every text if the file's pre-tokenizer isn't of that
kind. Pieces of ASCII and Latin-1 letters alone are one word each; many of them are encoded in one call, joined by spaces,
and told apart by the ids that end a word. tests/llm/test_tokens.py holds all this against plain encoding.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from planeworks.llm.text import LOWER_BYTES, SPACE, dictionary, give_back, mapped, row_bytes, runs_of, slices

#: Id that ends a document.
END = 1
#: Bytes of distinct pieces, with their ids, that a worker remembers within a task; beyond that it keeps those of the last
#: slice (only speed depends on it).
REMEMBER = 16 << 20
#: Bytes of text to encode at once: the arrays of a slice take about 25 times as much.
SLICE = 4 << 20
_AT_ONCE = 1 << 14

_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[128:] = 4
_KIND[39] = 5
_KIND[SPACE] = 0
#: Bytes of words of one piece: ASCII letters, and the letters U+00C0 to U+00FF (0xC3 and a second byte; two are signs).
_NO_LETTER = np.ones(256, np.uint8)
_NO_LETTER[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 0
_NO_LETTER[[0x97, 0xB7]] = 1
#: A piece begins at a byte of kind b after one of kind a if _BEGINS[8 * a + b].
_BEGINS = np.zeros(256, np.uint8)
_BEGINS[1:6] = 1
for _a in (1, 2, 3):
    for _b in (1, 2, 3):
        _BEGINS[8 * _a + _b] = _a != _b


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """encode(bytes, offsets) gives (ids, ids before each row and in all), each row with the end id."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content.lower().encode() for t in self.library.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            shape = json.load(file)
        mark = shape["model"].get("end_of_word_suffix")
        self.cuts = bool(mark) and "Lowercase" in str(shape["normalizer"]) and "Split" in str(shape["pre_tokenizer"])
        vocabulary = self.library.get_vocab()
        self.size = max([END, *vocabulary.values()]) + 1
        self.ends_word = np.zeros(self.size, bool)
        if mark:
            self.ends_word[[i for w, i in vocabulary.items() if w.endswith(mark)]] = True
        self.kind = np.dtype(np.uint16 if self.size <= 1 << 16 else np.uint32)
        self.forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One a Python worker."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.known_ids, self.known_at = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _fresh(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of pieces by the library."""
        raw, at = row_bytes(pieces)
        other = np.add.reduceat(mapped(raw, _NO_LETTER), at[:-1], dtype=np.int64) > 0
        sizes = np.zeros(len(pieces), np.int64)
        words, rest = np.flatnonzero(~other), np.flatnonzero(other)
        found = []
        for k in range(0, len(words), _AT_ONCE):
            text = b" ".join(pieces.take(pa.array(words[k : k + _AT_ONCE])).to_pylist()).decode()
            found.append(np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32))
        joined = np.concatenate(found) if found else np.zeros(0, np.uint32)
        stop = np.flatnonzero(self.ends_word[joined]) + 1
        if len(stop) == len(words):
            sizes[words] = np.diff(stop, prepend=0)
        else:  # the vocabulary has no such word end after all
            rest, joined = np.arange(len(pieces)), joined[:0]
        lists = [e.ids for e in self.library.encode_batch_fast([x.decode("utf-8", "surrogatepass") for x in pieces.take(pa.array(rest)).to_pylist()], add_special_tokens=False)]
        sizes[rest] = np.fromiter(map(len, lists), np.int64, len(lists))
        out = np.empty(int(sizes.sum()), np.uint32)
        own = np.zeros(len(pieces), bool)
        own[rest] = True
        from_rest = np.repeat(own, sizes)
        out[~from_rest] = joined
        out[from_rest] = np.fromiter((i for x in lists for i in x), np.uint32, int(sizes[rest].sum()))
        return out, sizes

    def _ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of distinct pieces, from memory where they have been met before."""
        place = pc.index_in(pieces, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            added = pieces.take(pa.array(new))
            flat, sizes = self._fresh(added)
            if self.known.nbytes + self.known_ids.nbytes + self.known_at.nbytes + added.nbytes + flat.nbytes > REMEMBER:
                kept = np.unique(place[place >= 0])
                self.known_ids, self.known_at = gather(self.known_ids, self.known_at, kept)
                self.known = self.known.take(pa.array(kept))
                place = np.where(place >= 0, np.searchsorted(kept, place), place)
            place[new] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, added])
            self.known_at = np.concatenate([self.known_at, self.known_at[-1] + np.cumsum(sizes)])
            self.known_ids = np.concatenate([self.known_ids, flat])
        return gather(self.known_ids, self.known_at, place)

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.tobytes()
        lists = [e.ids for e in self.library.encode_batch_fast([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], add_special_tokens=False)]
        at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)) + 1)])
        out = np.full(at[-1], END, np.uint32)
        is_id = np.ones(len(out), bool)
        is_id[at[1:] - 1] = False
        out[is_id] = np.fromiter((i for x in lists for i in x), np.uint32, int(is_id.sum()))
        return out, at

    def parts(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        """(doc_ids, ids, ids before each row and in all) slice by slice. What a task remembers ends with it, so that a
        worker that is kept for other work holds the vocabulary alone."""
        try:
            for part, data, offsets in slices(batches, SLICE):
                yield part.column(0), *self.encode(data, offsets)
        finally:
            self.forget()
            give_back()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if n == 0:
            return np.full(len(offsets) - 1, END, np.uint32), np.arange(len(offsets), dtype=np.int64)
        if not self.cuts:
            return self._whole(data, offsets)
        raw = data.tobytes()
        low = np.frombuffer(raw.translate(LOWER_BYTES), np.uint8)
        keep = np.flatnonzero((data[1:] >= 128) & (low[:-1] != data[:-1]))  # a non-ASCII byte comes next
        if len(keep):
            low = low.copy()
            low[keep] = data[keep]
        kind = mapped(low, _KIND)
        inside = kind > 0
        starts, ends, before = runs_of(inside, mapped(kind[:-1] * np.uint8(8) + kind[1:], _BEGINS).view(bool), offsets)
        codes, pieces = dictionary(low, starts, ends, inside)
        ids, at = self._ids(pieces)
        flat, ends_at = gather(ids, at, codes)
        rows = ends_at[before]
        whole: dict[int, np.ndarray] = {}
        if b"<|" in raw and any(s in raw.lower() for s in self.special):
            for r in range(len(offsets) - 1):
                text = raw[offsets[r] : offsets[r + 1]]
                if any(s in text.lower() for s in self.special):
                    whole[r] = np.asarray(self.library.encode(text.decode(), add_special_tokens=False).ids, np.uint32)
        sizes = np.diff(rows)
        for r, x in whole.items():
            sizes[r] = len(x)
        out_at = np.concatenate([[0], np.cumsum(sizes + 1)])
        out = np.full(out_at[-1], END, np.uint32)
        if whole:
            for r in range(len(sizes)):
                out[out_at[r] : out_at[r + 1] - 1] = whole.get(r, flat[rows[r] : rows[r + 1]])
        else:
            is_id = np.ones(len(out), bool)
            is_id[out_at[1:] - 1] = False
            out[is_id] = flat
        return out, out_at


def gather(values: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ragged take: the runs values[at[r]:at[r+1]] for r of rows, with their offsets."""
    sizes = (at[1:] - at[:-1])[rows] if len(rows) else np.zeros(0, np.int64)
    out_at = np.concatenate([[0], np.cumsum(sizes)])
    shift = (at[:-1][rows] - out_at[:-1]) if len(rows) else sizes
    place = np.repeat(shift, sizes)
    place += np.arange(len(place))
    return values[place], out_at
