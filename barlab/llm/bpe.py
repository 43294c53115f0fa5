"""Token ids of a lower-casing word BPE, by one library call for each distinct word.

Words are found and hashed in numpy over a slice of rows; a word that this
worker has met before is a table look-up, the others go to the tokenizer
together. Texts with characters whose classes are not tabled here, or with
the strings of special tokens, go to the tokenizer whole.
"""

from __future__ import annotations

import os
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from barlab.llm.kernels import Seen, hash_ranges, ranges, slices, text_buffers

_SPACE, _LETTER, _NUMBER, _SYMBOL, _OTHER = range(5)
_TABLED = 0x2100
_PLAIN = (*range(0x0, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x205F), *range(0x20A0, 0x20C0))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    kind = np.full(_TABLED + 1, _OTHER, np.uint8)
    lower = np.arange(_TABLED + 1, dtype=np.uint32)
    for c in _PLAIN:
        group = unicodedata.category(chr(c))[0]
        kind[c] = _LETTER if group == "L" else _NUMBER if group == "N" else _SYMBOL
        small = chr(c).lower()
        if len(small) == 1:
            lower[c] = ord(small)
        else:
            kind[c] = _OTHER
    kind[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = _SPACE
    kind[0xAD] = kind[0x00] = _OTHER
    return kind, lower


_KIND, _LOWER = _tables()



def _words(codes: np.ndarray, kind: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased codes of the given kinds; ``cuts``: rows' first codes and the end."""
    edge = np.zeros(len(codes) + 1, bool)
    edge[cuts] = True
    change = np.concatenate(([True], (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER))) | edge[:-1]
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(codes))
    real = kind[starts] != _SPACE
    starts, ends = starts[real], ends[real]
    quote = (codes[starts] == 0x27) & (ends - starts == 1)
    at = np.flatnonzero(quote[:-1])
    if len(at):
        at = at[(starts[at + 1] == ends[at]) & ~edge[ends[at]] & (kind[ends[at]] == _LETTER)]
        size = ends[at + 1] - starts[at + 1]
        one = codes[starts[at + 1]]
        two = codes[np.minimum(starts[at + 1] + 1, len(codes) - 1)]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = (size > 1) & (((two == ord("e")) & np.isin(one, [ord("r"), ord("v")])) | ((one == ord("l")) & (two == ord("l"))))
        take = np.where(short, 1, np.where(long, 2, 0))
        ends[at] += take
        starts[at + 1] += take
        real = ends > starts
        starts, ends = starts[real], ends[real]
    return starts, ends


class WordBpe:
    """A worker's tokenizer with the ids of the words that it has met."""

    def __init__(self, path: str, word_bits: int = 20):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.whole.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        names = self.whole.get_vocab()
        self.last = np.zeros(max(names.values()) + 1, bool)
        self.last[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.special = [x.content.lower().encode() for x in self.whole.get_added_tokens_decoder().values()]
        self.word_bits = word_bits
        self._forget()

    def _forget(self) -> None:
        self.known = Seen(self.word_bits)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Ids of new words; they go to the tokenizer as lines of words."""
        found, per = [], 4000
        lines = []
        for a in range(0, len(starts), per):
            size = (ends - starts)[a : a + per] + 1
            flat = codes[np.minimum(ranges(starts[a : a + per], size), len(codes) - 1)]
            flat[np.cumsum(size) - 1] = 0x20
            lines.append(flat.astype("<u4").tobytes().decode("utf-32-le"))
        for x in self.plain.encode_batch_fast(lines, add_special_tokens=False):
            found.append(np.array(x.ids, np.uint32))
        ids = np.concatenate(found)
        stops = np.flatnonzero(self.last[ids]) + 1
        if len(stops) != len(starts):
            raise ValueError("the tokenizer cut the words in another way")
        first = np.concatenate(([0], stops[:-1])) + len(self.pool)
        self.known.add(hashes)
        self.first = np.concatenate((self.first, first))
        self.size = np.concatenate((self.size, np.diff(np.concatenate(([0], stops)))))
        self.pool = np.concatenate((self.pool, ids))

    def encode(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text; a null text has none."""
        data, offsets = text_buffers(column)
        out: list[np.ndarray] = []
        for a, b in slices(offsets):
            out += self._encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        return out

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        raw, n = data.tobytes(), len(offsets) - 1
        heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        cuts = heads[offsets]
        codes = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), "<u4")
        kept = np.minimum(codes, _TABLED)
        odd = np.zeros(n, bool)
        kind = _KIND[kept]
        strange = np.flatnonzero(kind == _OTHER)
        odd[np.searchsorted(cuts, strange, "right") - 1] = True
        low = raw.lower()
        for name in self.special:
            if name in low:
                odd |= np.array([name in low[x:y] for x, y in zip(offsets[:-1], offsets[1:], strict=True)])
        codes = _LOWER[kept]
        starts, ends = _words(codes, kind, cuts) if len(codes) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        rows = np.searchsorted(cuts, starts, "right") - 1
        if odd.any():
            fine = ~odd[rows]
            starts, ends, rows = starts[fine], ends[fine], rows[fine]
        hashes, where, place = np.unique(hash_ranges(codes, starts, ends), return_index=True, return_inverse=True)
        if self.known.count + len(hashes) > (1 << self.word_bits) // 2:
            self._forget()
        index = self.known.find(hashes)
        new = np.flatnonzero(index < 0)
        if len(new):
            index[new] = self.known.count + np.arange(len(new))
            self._learn(hashes[new], codes, starts[where[new]], ends[where[new]])
        word = index[place]
        size = self.size[word]
        ids = self.pool[ranges(self.first[word], size)]
        ends_at = np.cumsum(np.bincount(rows, weights=size, minlength=n).astype(np.int64)) if len(rows) else np.zeros(n, np.int64)
        out = np.split(ids, ends_at[:-1])
        for i in np.flatnonzero(odd):
            text = raw[offsets[i] : offsets[i + 1]].decode("utf-8")
            out[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return out


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)
