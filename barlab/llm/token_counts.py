"""Word-piece lengths by a linear longest-match automaton.

The vocabulary's trie gets failure links: where a state has no edge for the
next byte, the longest-match pieces that this settles are popped, and the
matching goes on from the failure state. A state keeps only how many pieces
its link pops, so a text's length comes from sums, and no piece is built.
All distinct words of a slice of rows walk through the automaton together.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barlab.llm.kernels import Words, word_slices


def byte_level_letters() -> dict[str, int]:
    """Letter -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest for 256 and on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file; words begin with a space."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {x["content"] for x in model.get("added_tokens", ())}
    letters = byte_level_letters()
    return [bytes(letters[c] for c in piece) for piece in model["model"]["vocab"] if piece not in special]


#: Bytes of a word that are read one after the other; a longer word is read in blocks of as many. EARLY: bytes before a block from which its first state is guessed.
LONG, EARLY = 4096, 128


class Automaton:
    """Greedy longest match from the left, over any pieces that include each byte occurring in a word."""

    def __init__(self, pieces: list[bytes]):
        edges: list[dict[int, int]] = [{}]
        ends: list[bool] = [False]
        parent, letter = [0], [0]
        for piece in pieces:
            at = 0
            for b in piece:
                to = edges[at].get(b)
                if to is None:
                    to = len(edges)
                    edges[at][b] = to
                    edges.append({})
                    ends.append(False)
                    parent.append(at)
                    letter.append(b)
                at = to
            ends[at] = bool(piece) or ends[at]
        n = len(edges)
        #: fail: where matching goes on, -1: nowhere; pops: pieces settled on the way; rest: pieces of what has been read when the word ends here, -1: none fit
        fail, pops, rest = [-1] * n, [0] * n, [-1] * n
        rest[0] = 0
        level = list(edges[0].values())
        while level:
            deeper: list[int] = []
            for v in level:
                deeper.extend(edges[v].values())
                if ends[v]:
                    fail[v], pops[v] = 0, 1
                else:
                    u, c = parent[v], letter[v]
                    z, k = fail[u], pops[u]
                    while z >= 0 and c not in edges[z]:
                        k += pops[z]
                        z = fail[z]
                    if z >= 0:
                        fail[v], pops[v] = edges[z][c], k
                if fail[v] >= 0 and rest[fail[v]] >= 0:
                    rest[v] = pops[v] + rest[fail[v]]
            level = deeper
        keys = np.array([v * 256 + c for v, e in enumerate(edges) for c in e], np.int64)
        to = np.array([t for e in edges for t in e.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]
        self.fail, self.pops, self.rest = (np.array(x, np.int64) for x in (fail, pops, rest))

    def lengths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: int | None = 0x20) -> np.ndarray:
        """Pieces of each range of bytes, after the byte ``lead`` if given; 1 (an unknown word) where none fit."""
        out = np.ones(len(starts), np.int64)
        long = ends - starts > LONG
        for i in np.flatnonzero(long).tolist():
            out[i] = self._long(data, int(starts[i]), int(ends[i]), lead)
        short = np.flatnonzero(~long)
        out[short] = self._total(*self._advance(data, starts[short], ends[short], self._entry(len(short), lead)))
        return out

    def _entry(self, n: int, lead: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """state, count and lost of n words of which only ``lead`` has been read."""
        state, count, lost = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        if lead is not None:
            self._step(state, count, lost, np.full(n, lead, np.int64))
        return state, count, lost

    def _total(self, state: np.ndarray, count: np.ndarray, lost: np.ndarray) -> np.ndarray:
        tail = self.rest[state]
        return np.where(lost | (tail < 0), 1, count + tail)

    def _advance(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, entry: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """state, count and lost after reading each range from its entry."""
        order = np.argsort(starts - ends, kind="stable")  # longest first
        starts, size = starts[order], (ends - starts)[order]
        state, count, lost = (x[order] for x in entry)
        for t in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size, -t, "left"))
            self._step(state[:live], count[:live], lost[:live], data[starts[:live] + t].astype(np.int64))
        out = np.empty_like(state), np.empty_like(count), np.empty_like(lost)
        for x, value in zip(out, (state, count, lost), strict=True):
            x[order] = value
        return out

    def _long(self, data: np.ndarray, start: int, end: int, lead: int | None) -> int:
        """Pieces of one long word: its blocks are read side by side, each from the state that the bytes before it leave from scratch; a block whose state was another is read again."""
        begin = np.arange(start, end, LONG)
        stop = np.minimum(begin + LONG, end)
        state, count, lost = self._entry(1, lead)
        guess, _, astray = self._advance(data, np.maximum(begin - EARLY, start), begin, self._entry(len(begin), None))
        guess[astray] = 0
        guess[0] = state[0]
        found = self._advance(data, begin, stop, (guess, np.zeros(len(begin), np.int64), np.zeros(len(begin), bool)))
        for k in range(len(begin)):
            if guess[k] == state[0]:
                own = tuple(x[k : k + 1] for x in found)
            else:
                own = self._advance(data, begin[k : k + 1], stop[k : k + 1], (state, np.zeros(1, np.int64), np.zeros(1, bool)))
            state, count, lost = own[0].copy(), count + own[1], lost | own[2]
        return int(self._total(state, count, lost)[0])

    def _step(self, state: np.ndarray, count: np.ndarray, lost: np.ndarray, letter: np.ndarray) -> None:
        todo = np.flatnonzero(~lost)
        while len(todo):
            key = state[todo] * 256 + letter[todo]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            state[todo[hit]] = self.to[at[hit]]
            todo = todo[~hit]
            back = self.fail[state[todo]]
            stuck = back < 0
            lost[todo[stuck]] = True
            todo, back = todo[~stuck], back[~stuck]
            count[todo] += self.pops[state[todo]]
            state[todo] = back


@lru_cache(maxsize=4)
def automaton(path: str) -> Automaton:
    return Automaton(vocabulary(path))


def word_lengths(words: Words, machine: Automaton) -> np.ndarray:
    """Pieces of each word; equal words walk once."""
    _, first, place = np.unique(words.hashes(), return_index=True, return_inverse=True)
    return machine.lengths(words.data, words.starts[first], words.ends[first])[place]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_counts(docs: DataFrame, *, vocabulary_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_tokens.

    Words are runs of characters outside space and 09-0D; a word's pieces are
    the greedy longest matches of the vocabulary from the left over a space
    and the word's bytes; a word that no pieces fit counts as one token. A
    null or empty text has 0 of both; nulls in the id stay, repeated rows count
    alike; other columns are ignored; an empty table gives no rows. A long word
    is read in blocks side by side; where the state at a block's start was
    guessed wrongly (a word built so that matches never end) that block is read
    again, and such a word takes a step a byte, in bounded memory.
    """
    path = vocabulary_path or default_vocabulary()
    kind = dict(docs.dtypes)[id_col]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(path)
        for batch in batches:
            for a, b, words in word_slices(batch.column(1), lower=False):
                tokens = np.bincount(words.rows, weights=word_lengths(words, machine), minlength=b - a).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words.counts), pa.array(tokens)], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(count, f"doc_id {kind}, n_words long, n_tokens long")
