"""Operator 7 - token counts by rank-synchronous array merging.

The pre-tokens of a batch lie end to end in one ragged numpy array of symbol ids.  In each round every sequence
finds the lowest rank among its adjacent pairs, and all sequences apply their own lowest-rank pair at once; a
sequence without a known pair is finished, and its surviving symbols are counted.  A count depends on the
pre-token alone, so each distinct one is merged once for a block and remembered in a memo bounded in bytes.

Defined cases: null and empty texts count 0 tokens and 0 bytes; a very long text is a block of its own, counted whole; special strings inside a text count as the library
counts them, one token each; repeated rows are counted again; an empty table gives no rows; further columns are
ignored.  Texts with pre-token classes that the simple pattern doesn't know (see ``bpe_encode.PLAIN``) are split by
the library's own pre-tokenizer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralis.llm.bpe_encode import PLAIN, SPLIT, byte_alphabet, cuttable
from muralis.llm.common import blocks, text_buffer

_NONE = np.iinfo(np.int32).max


class MergeTable:
    """Merge rules as sorted pair keys: ``rank`` and ``merged symbol`` by binary search."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.base = int(max(vocab.values())) + 1
        key = left * self.base + right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int32), made[order]
        self.byte_ids = np.array([vocab[c] for c in byte_alphabet()], np.int32)
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), self.made[at]


def merge_counts(raw: np.ndarray, offsets: np.ndarray, rules: MergeTable) -> np.ndarray:
    """Surviving symbols of each byte sequence ``raw[offsets[i]:offsets[i+1]]``."""
    sizes = np.diff(offsets)
    counts = sizes.astype(np.int64).copy()
    sym = rules.byte_ids[raw]
    seq = np.repeat(np.arange(len(sizes)), sizes)
    while len(sym) > 1:
        same = seq[1:] == seq[:-1]
        rank, made = rules.find(sym[:-1], sym[1:])
        rank[~same] = _NONE
        rank = np.append(rank, _NONE)  # a rank for each symbol: of the pair that it begins
        heads = np.flatnonzero(np.append(True, ~same))
        best = np.minimum.reduceat(rank, heads)
        lengths = np.diff(np.append(heads, len(sym)))
        counts[seq[heads]] = lengths
        live = best != _NONE
        if not live.any():
            break
        chosen = (rank == np.repeat(best, lengths)) & np.repeat(live, lengths)
        at = np.flatnonzero(chosen)
        # of overlapping equal pairs, as in "aaa", every second one counts, from the left
        run = np.flatnonzero(np.append(True, np.diff(at) != 1))
        nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
        at = at[nth % 2 == 0]
        sym[at] = made[at]
        keep = np.repeat(live, lengths)
        keep[at + 1] = False
        sym, seq = sym[keep], seq[keep]
        if len(sym):
            ends = np.flatnonzero(np.append(seq[1:] != seq[:-1], True))
            counts[seq[ends]] = np.diff(np.append(-1, ends))
    return counts


class Counter:
    """Counts with a memo of pieces and one of pre-tokens.  Between blocks, keys of more than ``LONGEST`` characters
    go, and memos that have taken ``room`` bytes are emptied."""

    LONGEST, ENTRY = 64, 200  # an entry's own bytes: two objects and a slot of the table

    def __init__(self, path: str, room: int = 96 << 20):
        from tokenizers import Tokenizer

        self.rules, self.room, self.left = MergeTable(path), room, room
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.special = re.compile("|".join(map(re.escape, self.rules.specials)) or r"(?!)")
        self.pieces: dict[str, int] = {}
        self.tokens: dict[str, int] = {}

    def _split(self, piece: str) -> list[str]:
        if PLAIN.match(piece, piece[:1] == " "):
            return SPLIT.findall(piece)
        return [piece[a:b] for _, (a, b) in self.pre.pre_tokenize_str(piece)] if piece else []

    def _learn(self, pieces: set[str]) -> None:
        parts = {p: self._split(p) for p in pieces}
        new = [t for t in set().union(*parts.values()) if t not in self.tokens] if parts else []
        if new:
            raw, at = text_buffer(pa.array(new, pa.large_string()))
            self.tokens.update(zip(new, merge_counts(raw, at, self.rules).tolist(), strict=True))
        self.pieces.update((p, sum(map(self.tokens.__getitem__, ts))) for p, ts in parts.items())
        self.fresh = ((self.tokens, new), (self.pieces, pieces))

    def _trim(self) -> None:
        for memo, keys in self.fresh:
            for key in keys:
                if len(key) > self.LONGEST:
                    del memo[key]
                else:
                    self.left -= self.ENTRY + 4 * len(key)
        if self.left < 0:
            self.pieces, self.tokens, self.left = {}, {}, self.room

    def count(self, texts: list[str | None]) -> list[int]:
        cut: list[list[str]] = []
        extra = []
        for text in texts:
            spans, n = [text or ""], 0
            if any(s in spans[0] for s in self.rules.specials):
                n = len(self.special.findall(text))
                spans = self.special.split(text)
            out: list[str] = []
            for span in spans:
                if cuttable(span):
                    head, *rest = span.split(" ")
                    out.append(head)
                    out += [" " + x for x in rest]
                else:
                    out.append(span)
            cut.append(out)
            extra.append(n)
        self._learn({p for p in set().union(*cut) if p not in self.pieces})
        counts = [sum(map(self.pieces.__getitem__, ps)) + n for ps, n in zip(cut, extra, strict=True)]
        self._trim()
        return counts


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, block_bytes: int = 1 << 20) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for each row of ``docs(doc_id, text)``, in blocks of about
    ``block_bytes`` of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _counters:
            _counters[tokenizer] = Counter(tokenizer)
        counter = _counters[tokenizer]
        for batch in batches:
            counts: list[int] = []
            for block in blocks(batch, 1, block_bytes):
                counts += counter.count(block.column(1).to_pylist())
            _, at = text_buffer(batch.column(1))
            n = np.array(counts, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
