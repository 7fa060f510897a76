"""Token counts by byte-level pair merging on ragged arrays (operator 13).

The vocabulary file (``tokenizers`` JSON: byte-level BPE without normaliser, prefix space or
post-processor) gives the merges and the special tokens; it is only read, never copied.  A
text is cut at special tokens (one token each, as the library does by default), what is left
into pre-tokens.  The different pre-tokens that a task meets for the first time are held
together as one ragged array of symbols; each round finds the lowest-ranked adjacent pair of
every sequence and merges all its occurrences in all sequences at once, left to right where
they overlap.  A merged symbol only takes part in pairs of a higher rank, so a round equals
that many single merges.  Sequences without a pair leave the array; what survives is counted.

Memory: counts of short pre-tokens are remembered up to ``REMEMBERED`` bytes for one task;
pre-tokens are merged in lots of ``LOT`` bytes, or one pre-token if that alone is longer.

Cases: a null or empty text has no bytes and no tokens; very long texts are read whole, a
pre-token of any length is merged whole; rows are counted one by one, so repeated rows and null
ids stay; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from oddsmith.llm.common import texts

#: Fixed value: how byte-level vocabularies of this kind cut a text.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: From here on there are code points that were given a meaning at different times, see ``Vocabulary.cut``.
FAR = regex.compile("[\u0558-\U0010ffff]")
REMEMBERED, LOT, SHORT, NONE = 32 << 20, 1 << 20, 64, np.int32(2**31 - 1)


def byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if visible, else the next free one from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids = spec["model"]["vocab"]
        self.path, self.first = path, np.array([ids[c] for c in byte_characters()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([ids[a] << 32 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.splitter = None

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)

    def surviving(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols left of each (non-empty) sequence after all merges."""
        out = np.zeros(len(sequences), np.int64)
        size = np.fromiter(map(len, sequences), np.int64, len(sequences))
        owner = np.arange(len(sequences))
        symbol = self.first[np.frombuffer(b"".join(sequences), np.uint8)]
        rank = np.full(len(symbol), NONE, np.int32)
        rank[:-1] = self.pair_ranks(symbol[:-1], symbol[1:])
        rank[np.cumsum(size) - 1] = NONE  # no pair across sequences
        while len(owner):
            lowest = np.minimum.reduceat(rank, np.cumsum(size) - size)
            done = lowest == NONE
            if done.any():
                out[owner[done]] = size[done]
                stay = np.repeat(~done, size)
                symbol, rank, owner, size, lowest = symbol[stay], rank[stay], owner[~done], size[~done], lowest[~done]
                if not len(owner):
                    break
            hits = np.flatnonzero(rank == np.repeat(lowest, size))
            fresh = np.ones(len(hits), bool)  # a hit next to the one before (three or more equal symbols): every second counts
            fresh[1:] = hits[1:] != hits[:-1] + 1
            if not fresh.all():
                run = np.flatnonzero(fresh)
                hits = hits[(np.arange(len(hits)) - np.repeat(run, np.diff(run, append=len(hits)))) % 2 == 0]
            symbol[hits] = self.merged[rank[hits]]
            rank[hits] = rank[hits + 1]  # NONE if the second symbol was a sequence's last
            keep = np.ones(len(symbol), bool)
            keep[hits + 1] = False
            ends = np.cumsum(size)
            size -= np.bincount(np.searchsorted(ends, hits, "right"), minlength=len(size))
            hits -= np.arange(len(hits))
            symbol, rank = symbol[keep], rank[keep]
            last = np.cumsum(size) - 1
            touched = np.concatenate([hits, hits[hits > 0] - 1])
            touched = touched[touched < len(symbol) - 1]
            rank[touched] = self.pair_ranks(symbol[touched], symbol[touched + 1])
            rank[last] = NONE
        return out

    def cut(self, text: str) -> list[str]:
        """Pre-tokens.  Code points without a meaning in some Unicode version are left to the library's own splitter."""
        if FAR.search(text) and any(unicodedata.category(c) == "Cn" for c in set(text)):
            if self.splitter is None:
                from tokenizers import Tokenizer

                self.splitter = Tokenizer.from_file(self.path).pre_tokenizer
            return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]
        return SPLIT.findall(text)


class Counts:
    """Remembers the tokens of pre-tokens; forgotten as a whole at ``REMEMBERED`` bytes (about 120 an entry besides the text)."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.held, self.known = vocabulary, 0, {}

    def of(self, batch: list[str]) -> list[int]:
        """Tokens of each text."""
        if self.held > REMEMBERED:
            self.known.clear()
            self.held = 0
        special, cut = self.vocabulary.special, self.vocabulary.cut
        parts = [special.split(text) if special else [text] for text in batch]
        cuts = [cut(p[0]) if len(p) == 1 else [w for part in p for w in cut(part)] for p in parts]
        unseen = self.learn(set().union(*(set(words).difference(self.known) for words in cuts)))
        if unseen:
            return [len(p) - 1 + sum(unseen[w] if w in unseen else self.known[w] for w in words) for p, words in zip(parts, cuts)]
        return [len(p) - 1 + sum(map(self.known.__getitem__, words)) for p, words in zip(parts, cuts)]

    def learn(self, new: set[str]) -> dict[str, int]:
        """Counts new pre-tokens; those of over ``SHORT`` characters are returned instead of remembered."""
        once: dict[str, int] = {}
        lot, size = [], 0
        for w in chain(new, [None]):
            if lot and (w is None or size >= LOT):
                for x, n in zip(lot, self.vocabulary.surviving([x.encode() for x in lot]).tolist()):
                    if len(x) > SHORT:
                        once[x] = n
                    else:
                        self.known[x] = n
                        self.held += len(x) + 120
                lot, size = [], 0
            if w is not None:
                lot.append(w)
                size += len(w)
        return once


def lots(sizes: list[int], most: int = 4 * LOT) -> Iterator[slice]:
    """Consecutive rows of together ``most`` bytes, or one row if that is longer."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens) of every row; no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in batches:
            data = batch.column("data")
            n_bytes = [len(x.as_buffer()) for x in data]
            counts = counts or Counts(Vocabulary(vocabulary))
            n_tokens = [n for rows in lots(n_bytes) for n in counts.of([x.as_buffer().to_pybytes().decode() for x in data[rows]])]
            over = [n > limit for n in n_tokens]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(over, pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return token_counts(docs, vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
