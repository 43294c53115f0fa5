"""SentencePiece encoding and decoding by a batched numpy Viterbi.

The model is of the BPE kind: its segmentation is not the one with the best
sum of scores but what greedy merging leaves. A segmentation is that result
exactly if each two neighbouring pieces, merged alone, stay the two pieces,
because the merges inside a pair of pieces do not depend on what lies around
them. So the Viterbi takes pairs that are not stable as impossible: at each
end position it probes the hashes of all substrings in the sorted piece keys,
takes the longest candidate that is stable with its predecessor's last piece
(no other is), and stores the piece as backpointer. Words of equal length
advance together; lengths over a few dozen are rounded up, and a very long
unit advances in blocks that overlap, side by side.

Whether a pair is stable follows from how its pieces are merged themselves:
going back through the merges at the two edges that meet, no piece across the
border may come before the merge that ended the state in which it could.

Texts are cut into units that no piece crosses: a run of spaces with the
characters up to the next space, and each character that no piece contains.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F, types as T

from barlab.llm.kernels import Seen, hash_ranges, mix, ranges, slices, text_buffers

BAR = 0x2581
_B = np.uint64(0xD6E8FEB86659FD93)
_BACK = np.uint64(pow(int(_B), -1, 1 << 64))
_NONE = np.int32(1 << 30)
_START = -2
_NO_CODE = 0x110000
JUMP_BITS = 18
MASK_BITS = 20
#: Units up to the first are taken at their length, up to the second at a rounded length, longer ones in blocks.
EXACT, BLOCK = 24, 1024


def _letter(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) + np.uint64(0x5851F42D4C957F2D))


class Pieces:
    """A model's pieces, and what this worker knows of pairs and units."""

    def __init__(self, path: str, unit_bits: int = 22):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.unit_bits, self.real = unit_bits, n
        self.bytes_from = next((i for i in range(n) if model.is_byte(i)), -1)
        text = {i: np.array([ord(c) for c in names[i]], np.int64) for i in plain}
        whole = {names[i] for i in plain if len(names[i]) == 1}
        extra = sorted({c for i in plain for c in names[i]} - whole)
        text |= {n + k: np.array([ord(c)], np.int64) for k, c in enumerate(extra)}
        self.text = text
        self.longest = max((len(x) for x in text.values()), default=1)
        known = np.zeros(max((int(x.max()) for x in text.values()), default=0) + 2, bool)
        for x in text.values():
            known[x] = True
        self.known_code = known
        score = {i: model.get_score(i) for i in plain}
        rank = {i: k for k, i in enumerate(sorted(plain, key=lambda i: (-score[i], i)))}
        ids = np.array(list(text), np.int64)
        keys = np.array([self._key(text[i]) for i in ids.tolist()], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        head = (self.keys >> np.uint64(64 - JUMP_BITS)).astype(np.int64)
        self.jump = np.searchsorted(head, np.arange(1 << JUMP_BITS))
        self.jump_most = int(np.bincount(head).max())
        self.rank = np.array([rank.get(i, _NONE) for i in self.ids.tolist()], np.int32)
        self.place = np.full(n + len(extra), -1, np.int64)
        self.place[self.ids] = np.arange(len(self.ids))
        # bytes of each id for decoding
        parts = [b""] * (n + len(extra))
        for i in plain:
            parts[i] = names[i].replace("▁", " ").encode()
        for i in range(n):
            if model.is_byte(i):
                parts[i] = bytes([int(names[i][3:5], 16)])
        self.part_size = np.array([len(p) for p in parts], np.int64)
        self.part_first = np.cumsum(self.part_size) - self.part_size
        self.part_data = np.frombuffer(b"".join(parts), np.uint8)
        self.mask = np.zeros(1 << MASK_BITS, bool)
        self.mask[(self.keys >> np.uint64(64 - MASK_BITS)).astype(np.int64)] = True
        self.letters = np.array([len(text[i]) for i in self.ids.tolist()], np.int64)
        self.power, self.inverse = (np.multiply.accumulate(np.array([1, *[x] * (2 * BLOCK)], np.uint64)) for x in (_B, _BACK))
        self._trees(text)
        self._forget()

    @staticmethod
    def _key(codes: np.ndarray) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for t in _letter(codes)[::-1]:
                h = t + _B * h
        return h

    def _trees(self, text: dict[int, np.ndarray]) -> None:
        """Which pieces greedy merging builds from their own letters, and their last merge: parts, and its rank (-1 for one letter)."""
        n = len(self.ids)
        self.sure, cut = np.zeros(n, bool), np.zeros(n, np.int64)
        for a in range(0, n, 8000):
            self.sure[a : a + 8000], cut[a : a + 8000] = self._merged([text[i] for i in self.ids[a : a + 8000].tolist()], None)
        self.born = np.where(self.letters > 1, self.rank, -1).astype(np.int64)
        self.lead, self.tail = np.zeros(n, np.int64), np.zeros(n, np.int64)
        many = np.flatnonzero(self.sure & (self.letters > 1))
        ends = np.cumsum(self.letters[many])
        flat = _letter(np.concatenate([text[i] for i in self.ids[many].tolist()] or [np.zeros(0, np.int64)]))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(flat * self.power[ranges(np.zeros(len(many), np.int64), self.letters[many])])))
        first = ends - self.letters[many]
        self.lead[many] = self._find(sums[first + cut[many]] - sums[first])
        self.tail[many] = self._find((sums[ends] - sums[first + cut[many]]) * self.inverse[cut[many]])
        # merges in the order of their ranks; other pieces are merged in full
        self.plain = self.sure.copy()
        for w in np.argsort(self.letters, kind="stable").tolist():
            if self.letters[w] > 1 and self.sure[w]:
                a, b = self.lead[w], self.tail[w]
                self.plain[w] = self.plain[a] and self.plain[b] and self.born[w] >= max(self.born[a], self.born[b])
        self.full: dict[int, bool] = {}

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Index of each key among the sorted ones, or -1: most others are told by their leading bits, the rest go from the first key with them on."""
        out = np.full(len(h), -1, np.int64)
        some = np.flatnonzero(self.mask[(h >> np.uint64(64 - MASK_BITS)).astype(np.int64)])
        h = h[some]
        at = self.jump[(h >> np.uint64(64 - JUMP_BITS)).astype(np.int64)]
        for _ in range(self.jump_most):
            at = at + (self.keys[np.minimum(at, len(self.keys) - 1)] < h)
        at = np.minimum(at, len(self.keys) - 1)
        out[some] = np.where(self.keys[at] == h, at, -1)
        return out

    def _merged(self, strings: list[np.ndarray], middle: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Whether greedy merging leaves each string whole, or cut at ``middle`` only, and where the last merge was."""
        n = len(strings)
        size = np.array([len(s) for s in strings])
        wide = int(size.max())
        codes = np.zeros((n, wide), np.int64)
        codes[np.arange(wide) < size[:, None]] = np.concatenate(strings)
        letters = _letter(codes)
        most = min(self.longest, wide)
        rank = np.full((n, wide + 1, most + 1), _NONE, np.int32)
        for end in range(1, wide + 1):
            h = np.zeros(n, np.uint64)
            for k in range(1, min(most, end) + 1):
                h = letters[:, end - k] + _B * h
                if k > 1:
                    at = self._find(h)
                    rank[:, end - k, k] = np.where((at >= 0) & (end <= size), self.rank[at], _NONE)
        cut = np.arange(wide + 1)[None, :] <= size[:, None]
        place = np.broadcast_to(np.arange(wide + 1), cut.shape)
        live, closed = np.arange(n), np.zeros(n, np.int64)
        while len(live):
            c, p = cut[live], place[live]
            before = np.maximum.accumulate(np.where(c, p, 0), axis=1)
            before = np.concatenate((np.zeros((len(live), 1), np.int64), before[:, :-1]), axis=1)
            after = np.minimum.accumulate(np.where(c, p, wide + 1)[:, ::-1], axis=1)[:, ::-1]
            after = np.concatenate((after[:, 1:], np.full((len(live), 1), wide + 1)), axis=1)
            span = after - before
            ok = c & (p > 0) & (p < size[live][:, None]) & (span <= most)
            cost = np.where(ok, rank[live[:, None], before, np.minimum(span, most)], _NONE)
            best = cost.argmin(axis=1)
            hit = cost[np.arange(len(live)), best] < _NONE
            cut[live[hit], best[hit]] = False
            closed[live[hit]] = best[hit]
            live = live[hit]
        inner = cut.sum(axis=1) - 2
        if middle is None:
            return inner == 0, closed
        return (inner == 1) & cut[np.arange(n), middle], closed

    def stable(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces (indices of keys) survives its own merging."""
        out = self.sure[left] & self.sure[right]
        plain = self.plain[left] & self.plain[right]
        odd = np.flatnonzero(out & ~plain)
        if len(odd):
            out[odd] = self._in_full(left[odd] * len(self.keys) + right[odd])
        todo = np.flatnonzero(out & plain)
        a, b, limit = left[todo], right[todo], np.full(len(todo), _NONE - 1, np.int64)
        while len(todo):
            size = self.letters[a]
            at = self._find(self.keys[a] + self.power[size] * self.keys[b])
            across = np.where(at >= 0, self.rank[at], _NONE)
            bad = across <= limit
            out[todo[bad]] = False
            one, two = self.born[a], self.born[b]
            on = np.flatnonzero(~bad & ((one >= 0) | (two >= 0)))
            todo, a, b, one, two = todo[on], a[on], b[on], one[on], two[on]
            later = two >= one  # of merges of one rank the left one comes first
            limit = np.where(later, two, one - 1)
            a, b = np.where(later, a, self.tail[a]), np.where(later, self.lead[b], b)
        return out

    def _in_full(self, pair: np.ndarray) -> np.ndarray:
        """The same by merging, for pieces whose own merges are not in the order of their ranks; answers are kept (there are few such pairs)."""
        unique, place = np.unique(pair, return_inverse=True)
        new = np.array([p for p in unique.tolist() if p not in self.full], np.int64)
        if len(self.full) + len(new) > 1 << 18:
            self.full, new = {}, unique
        for a in range(0, len(new), 8000):
            some = new[a : a + 8000]
            one = [self.text[i] for i in self.ids[some // len(self.keys)].tolist()]
            two = [self.text[i] for i in self.ids[some % len(self.keys)].tolist()]
            good, _ = self._merged([np.concatenate(x) for x in zip(one, two, strict=True)], np.array([len(x) for x in one]))
            self.full.update(zip(some.tolist(), good.tolist(), strict=True))
        return np.array([self.full[p] for p in unique.tolist()], bool)[place]

    def advance(self, codes: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece (index of its key) that ends at each position, and its length, for words of equal length.

        ``codes``: a column for each word, ``state``: what ends at their first
        positions; ``_START`` where a word starts. Positions come first.
        """
        wide, n = codes.shape
        sums = np.zeros((wide + 1, n), np.uint64)
        np.cumsum(_letter(codes) * self.power[:wide, None], axis=0, out=sums[1:])
        last, back = np.full((wide + 1, n), -1, np.int32), np.zeros((wide + 1, n), np.int16)
        last[: len(state)] = state
        for end in range(len(state), wide + 1):
            low = max(0, end - self.longest)
            h = (sums[end] - sums[low:end]) * self.inverse[low:end, None]
            found = self._find(h.ravel()).reshape(h.shape)
            found[last[low:end] == -1] = -1
            word = np.flatnonzero((found >= 0).any(axis=0))
            while len(word):
                start = (found[:, word] >= 0).argmax(axis=0)  # the longest candidate left
                at, before = found[start, word], last[low + start, word].astype(np.int64)
                good = np.where(before == _START, self.sure[at], False)
                inner = np.flatnonzero(before >= 0)
                good[inner] = self.stable(before[inner], at[inner])
                last[end, word[good]], back[end, word[good]] = at[good], end - low - start[good]
                found[start[~good], word[~good]] = -1
                word = word[~good]
                word = word[(found[:, word] >= 0).any(axis=0)]
        return last, back

    def viterbi(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (columns of code points, of the given sizes), one word after the other, and their number per word."""
        n = codes.shape[1]
        last, back = self.advance(codes, np.full((1, n), _START, np.int32))
        return self._trace(last, back, size)

    def _trace(self, last: np.ndarray, back: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place, word, steps = size.copy(), np.arange(len(size)), []
        while len(word):
            steps.append((word, self.ids[last[place[word], word]]))
            place[word] -= back[place[word], word]
            word = word[place[word] > 0]
        counts = np.bincount(np.concatenate([w for w, _ in steps]), minlength=len(size))
        ends = np.cumsum(counts)
        ids = np.empty(int(ends[-1]), np.int64)
        for t, (w, found) in enumerate(steps):
            ids[ends[w] - 1 - t] = found
        return ids, counts

    def long(self, codes: np.ndarray) -> np.ndarray:
        """Ids of one long unit: its blocks advance side by side.

        A block starts early, as if the unit began there. Once it agrees with
        the block before on as many positions as a piece is long, it agrees
        for good; a block that does not is taken again from that one's end.
        """
        n, most = len(codes), self.longest
        early = max(4 * most, BLOCK // 8)
        blocks = -(-n // BLOCK)
        at = np.arange(blocks) * BLOCK - early + np.arange(BLOCK + early)[:, None]
        at[:, 0] += early
        own = np.where(at < n, codes[np.minimum(at, n - 1)], _NO_CODE)
        last, back = self.advance(own, np.full((1, blocks), _START, np.int32))
        # positions of the unit: the first block has no early part
        ends, lengths = np.full(blocks * BLOCK + 1, -1, np.int32), np.zeros(blocks * BLOCK + 1, np.int16)
        ends[: BLOCK + 1], lengths[: BLOCK + 1] = last[: BLOCK + 1, 0], back[: BLOCK + 1, 0]
        for b in range(1, blocks):
            ends[b * BLOCK + 1 : (b + 1) * BLOCK + 1] = last[early + 1 :, b]
            lengths[b * BLOCK + 1 : (b + 1) * BLOCK + 1] = back[early + 1 :, b]
        state = np.arange(1, blocks) * BLOCK + np.arange(1 - most, 1)[:, None]
        given = last[early + 1 - most : early + 1, 1:].copy()
        while True:
            true = ends[state]
            again = np.flatnonzero((true != given).any(axis=0))
            if not len(again):
                break
            given[:, again] = true[:, again]
            place = (again + 1) * BLOCK - most + 1 + np.arange(BLOCK + most - 1)[:, None]
            redo = np.where(place < n, codes[np.minimum(place, n - 1)], _NO_CODE)
            found, length = self.advance(redo, given[:, again])
            for k, b in enumerate((again + 1).tolist()):
                ends[b * BLOCK + 1 : (b + 1) * BLOCK + 1] = found[most:, k]
                lengths[b * BLOCK + 1 : (b + 1) * BLOCK + 1] = length[most:, k]
        out, end = [], n
        while end > 0:
            out.append(ends[end])
            end -= int(lengths[end])
        return self.ids[np.array(out[::-1], np.int64)]

    def _forget(self) -> None:
        self.units = Seen(self.unit_bits)
        self.first = np.zeros(0, np.int32)
        self.size = np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.int32)

    def _spell(self, ids: np.ndarray) -> np.ndarray:
        """Characters without a piece of their own become bytes."""
        if len(ids) and ids.max() >= self.real:
            return np.concatenate([self._as_bytes(int(self.text[i][0])) if i >= self.real else np.array([i]) for i in ids.tolist()])
        return ids

    def _as_bytes(self, code: int) -> np.ndarray:
        return np.frombuffer(chr(code).encode(), np.uint8).astype(np.int64) + self.bytes_from

    def _learn(self, hashes: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        size = ends - starts
        odd = ~self.known_code[np.minimum(codes[starts], len(self.known_code) - 1)]
        first, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        pools, top = [self.pool], len(self.pool)
        for w in np.flatnonzero(odd | (size > BLOCK)).tolist():
            ids = self._as_bytes(int(codes[starts[w]])) if odd[w] else self._spell(self.long(codes[starts[w] : ends[w]].astype(np.int64)))
            pools.append(ids)
            first[w], count[w], top = top, len(ids), top + len(ids)
        short = np.flatnonzero(~odd & (size <= BLOCK))
        step = np.where(size > EXACT, 1 << np.maximum(np.floor(np.log2(np.maximum(size, 1))).astype(np.int64) - 2, 0), 1)
        width = -(-size // step) * step
        for wide in np.unique(width[short]).tolist():
            own = short[width[short] == wide]
            per = max(1, (1 << 17) // wide)
            for a in range(0, len(own), per):
                some = own[a : a + per]
                at = starts[some] + np.arange(wide)[:, None]
                inside = np.arange(wide)[:, None] < size[some]
                ids, counts = self.viterbi(np.where(inside, codes[np.minimum(at, len(codes) - 1)], _NO_CODE), size[some])
                if ids.max() >= self.real:
                    parts = [self._spell(x) for x in np.split(ids, np.cumsum(counts)[:-1])]
                    ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
                pools.append(ids)
                first[some], count[some], top = top + np.cumsum(counts) - counts, counts, top + len(ids)
        self.units.add(hashes)
        add = lambda old, new: np.concatenate((old, new.astype(np.int32)))
        self.first, self.size, self.pool = add(self.first, first), add(self.size, count), np.concatenate([x.astype(np.int32) for x in pools])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one row after the other, and their number per row."""
        n = len(offsets) - 1
        heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        size = np.diff(heads[offsets])
        lead = (size > 0).astype(np.int64)
        total = size + lead
        starts_of = np.cumsum(total) - total
        codes = np.full(int(total.sum()), BAR, np.uint32)
        if not len(codes):
            return np.zeros(0, np.int64), np.zeros(n, np.int64)
        codes[ranges(starts_of + lead, size)] = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
        codes[codes == 0x20] = BAR
        bar = codes == BAR
        odd = ~self.known_code[np.minimum(codes, len(self.known_code) - 1)]
        begin = np.zeros(len(codes), bool)
        begin[starts_of[size > 0]] = True
        begin[1:] |= (bar[1:] & ~bar[:-1]) | odd[1:] | odd[:-1]
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(codes))
        rows = np.searchsorted(starts_of + total, starts, "right")
        found = hash_ranges(np.minimum(codes, 65535), starts, ends)
        if codes.max() > 65535:
            found += hash_ranges(codes >> 16, starts, ends) + hash_ranges(codes & 65535, starts, ends)
        hashes, where, place = np.unique(found, return_index=True, return_inverse=True)
        if self.units.count + len(hashes) > (1 << self.unit_bits) // 2:
            self._forget()
        index = self.units.find(hashes)
        new = np.flatnonzero(index < 0)
        if len(new):
            index[new] = self.units.count + np.arange(len(new))
            self._learn(hashes[new], codes, starts[where[new]], ends[where[new]])
        unit = index[place]
        sizes = self.size[unit].astype(np.int64)
        return self.pool[ranges(self.first[unit].astype(np.int64), sizes)], np.bincount(rows, weights=sizes, minlength=n).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of rows of ids; the space that encoding puts in front of a text goes."""
        size = self.part_size[ids]
        data = self.part_data[ranges(self.part_first[ids], size)].tobytes()
        ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            text = data[a:b].decode("utf-8", "replace")
            out.append(text[1:] if text[:1] == " " else text)
        return out


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def encode(docs: DataFrame, *, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array of int).

    A null or empty text has no ids. Rows are independent: nulls and repeats
    in the id stay, other columns are ignored, an empty table gives no rows.
    """
    path = model or default_model()
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = pieces(path)
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in slices(offsets, 1 << 20):
                ids, counts = machine.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                bounds = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, *, model: str | None = None, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the ids' text in the column ``text_col``, replaced if there.

    Null ids give an empty text. Rows are independent, repeats and all other
    columns stay; an empty table gives no rows.
    """
    path = model or default_model()
    rest = encoded.drop(text_col)
    names = [*rest.columns, text_col]
    schema = T.StructType([*rest.schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = pieces(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                lists = part.column(part.schema.get_field_index(ids_col))
                counts = np.array([x or 0 for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(machine.decode(ids, counts), pa.string())], names)

    return rest.mapInArrow(run, schema)
