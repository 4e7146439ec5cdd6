"""Operator 6 - secret scans over a trigram inverted index.

From each rule's parsed regular expression a Boolean query of trigrams is derived: an AND of ORs of literal runs that
every match must hold.  The texts of a block are indexed by those trigrams (postings: the documents of the block),
postings are intersected and united as the query says, and only candidates are searched with the regular expression.
A rule without mandatory trigrams scans all texts of the block.  The index holds lower-cased bytes; so it serves
rules of either case and only widens the candidates of case-sensitive ones.

The blocks are those in which Arrow hands texts to a worker; postings live as long as their block, so memory is
bounded by it and nothing is shuffled.  ``postings`` returns them as rows, for an index that is kept.

Defined cases: null and empty texts have no spans; a very long text is searched whole; repeated rows are each reported; spans of one start come in the
rules' order; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _parser as sre  # the parse tree of the standard library

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muralis.llm.common import text_buffer


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    accept: Callable[[re.Match], bool] = lambda m: True


#: The contract's rules, then widely published key formats (fixed values).
BASE_RULES = (
    Rule("assign", r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 12),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 18),
    Rule("hex", r"[0-9a-f]+", lambda m: m.end() - m.start() >= 16),
)
MORE_RULES = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("chat", r"xox[baprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
)
#: Runs shorter than the rule's least length can't be accepted: the same matches, found without stopping at each.
_FASTER = {r"[0-9a-f]+": r"[0-9a-f]{16,}"}

Query = tuple  # ("all",) | ("tri", code) | ("and", parts) | ("or", parts)
_ALL: Query = ("all",)


def _and(parts: list[Query]) -> Query:
    parts = [p for p in dict.fromkeys(parts) if p != _ALL]
    return _ALL if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return _ALL if not parts or _ALL in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def trigrams(text: str) -> set[int]:
    b = text.encode()
    return {b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)}


def _of_strings(strings: set[str]) -> Query:
    return _or([_and([("tri", t) for t in sorted(trigrams(s))]) for s in sorted(strings)])


def trigram_query(pattern: str, most: int = 64) -> Query:
    """The query that every match of ``pattern`` satisfies; ``("all",)`` if it has no mandatory trigram.  Characters
    that the index can't fold as the rule does give none: those beyond ASCII, and under a Unicode ``(?i)`` the
    letters with a partner beyond ASCII."""

    def one(code: int, flags: int) -> set[str] | None:
        partners = "iks" if flags & re.IGNORECASE and not flags & re.ASCII else ""
        c = chr(code).lower()
        return None if code > 127 or c in partners else {c}

    def node(op, arg, flags: int) -> tuple[set[str] | None, Query]:
        """(the finite set of strings it matches, or None; a query that holds in any case)"""
        name = str(op)
        if name == "LITERAL":
            return one(arg, flags), _ALL
        if name == "IN":
            chars: set[str] = set()
            for kind, x in arg:
                codes = [x] if str(kind) == "LITERAL" else range(x[0], x[1] + 1) if str(kind) == "RANGE" and x[1] - x[0] < 8 else None
                found = [one(c, flags) for c in codes] if codes is not None else [None]
                if None in found:
                    return None, _ALL
                chars = chars.union(*found)
            return (chars, _ALL) if len(chars) <= 8 else (None, _ALL)
        if name == "SUBPATTERN":
            return run(arg[3], (flags | arg[1]) & ~arg[2])
        if name == "BRANCH":
            each = [run(x, flags) for x in arg[1]]
            if all(s is not None for s, _ in each) and len(out := set().union(*(s for s, _ in each))) <= most:
                return out, _ALL
            return None, _or([_of_strings(s) if s is not None else q for s, q in each])
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, greatest, child = arg
            strings, query = run(child, flags)
            if strings is not None and greatest == 1:
                return (strings | {""} if least == 0 else strings), _ALL
            if strings is not None and least == greatest and len(strings) == 1:
                return {next(iter(strings)) * least}, _ALL
            if least == 0:
                return None, _ALL
            return None, (_of_strings(strings) if strings is not None else query)
        if name == "AT":
            return {""}, _ALL
        return None, _ALL

    def run(items, flags: int) -> tuple[set[str] | None, Query]:
        now: set[str] = {""}
        parts: list[Query] = []
        exact = True
        for op, arg in items:
            strings, query = node(op, arg, flags)
            if strings is not None and len(now) * len(strings) <= most:
                now = {a + b for a in now for b in strings}
                continue
            exact = False
            parts += [_of_strings(now), query]
            now = strings if strings is not None else {""}
        if exact:
            return now, _ALL
        return None, _and([*parts, _of_strings(now)])

    parsed = sre.parse(pattern)
    strings, query = run(parsed, parsed.state.flags)
    return query if strings is None else _of_strings(strings)


def _codes(query: Query) -> set[int]:
    if query[0] == "tri":
        return {query[1]}
    return set().union(*map(_codes, query[1])) if query[0] in ("and", "or") else set()


class BlockIndex:
    """Postings of the wanted trigrams in a block of texts, as one Boolean column of documents for each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, wanted: np.ndarray, slot: np.ndarray, chunk: int = 4 << 20):
        n = len(offsets) - 1
        self.n, self.wanted = n, {int(c): i for i, c in enumerate(wanted)}
        self.held = np.zeros((len(wanted), n), bool)
        for a in range(0, max(len(raw) - 2, 0), chunk):
            part = raw[a : a + chunk + 2]
            low = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.uint32)
            found = slot[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
            at = np.flatnonzero(found)
            doc = np.searchsorted(offsets, at + a, "right") - 1
            inside = at + a + 3 <= offsets[doc + 1]
            self.held[found[at[inside]] - 1, doc[inside]] = True

    def ask(self, query: Query) -> np.ndarray:
        if query[0] == "all":
            return np.ones(self.n, bool)
        if query[0] == "tri":
            return self.held[self.wanted[query[1]]]
        parts = [self.ask(q) for q in query[1]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, trigram_query(r.pattern), re.compile(_FASTER.get(r.pattern, r.pattern))) for r in rules]
        self.wanted = np.array(sorted(set().union(*(_codes(q) for _, q, _ in self.rules))), np.int64)
        self.slot = np.zeros(1 << 24, np.uint8 if len(self.wanted) < 256 else np.uint16)
        self.slot[self.wanted] = np.arange(1, len(self.wanted) + 1)

    def block(self, texts: pa.Array) -> Iterator[list[tuple[int, int, int]]]:
        """Spans ``(start, rule number, end)`` of each text of a block, sorted."""
        index = BlockIndex(*text_buffer(texts), self.wanted, self.slot)
        candidates = [index.ask(q) for _, q, _ in self.rules]
        for i, text in enumerate(texts.to_pylist()):
            out = []
            for k, (rule, _, search) in enumerate(self.rules):
                if candidates[k][i] and text:
                    out += [(m.start(), k, m.end()) for m in search.finditer(text) if rule.accept(m)]
            out.sort()
            yield out


def _written(spans, rules) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def secrets(docs: DataFrame, base: tuple[Rule, ...] = BASE_RULES, more: tuple[Rule, ...] = MORE_RULES, block: int = 1024) -> DataFrame:
    """``(doc_id, n_<base kind>..., base_sha256, n_more, spans)`` for each row of ``docs(doc_id, text)``."""
    rules, n = (*base, *more), len(base)
    names = ["doc_id", *(f"n_{r.kind}" for r in base), "base_sha256", "n_more", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                cols: list[list] = [[] for _ in names[1:]]
                for spans in scanner.block(part.column(1)):
                    own = [s for s in spans if s[1] < n]
                    kinds = [s[1] for s in own]
                    row = (*map(kinds.count, range(n)), hashlib.sha256(_written(own, rules).encode()).hexdigest(), len(spans) - len(own), _written(spans, rules))
                    for col, x in zip(cols, row, strict=True):
                        col.append(x)
                types = [*[pa.int64()] * n, pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    kinds = ", ".join(f"n_{r.kind} long" for r in base)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, {kinds}, base_sha256 string, n_more long, spans string")


def postings(docs: DataFrame, patterns: list[str], block: int = 1024) -> DataFrame:
    """The index itself: ``(trigram, doc_ids)``, a row for each block and wanted trigram that occurs in it."""
    wanted = np.array(sorted(set().union(*(_codes(trigram_query(p)) for p in patterns))), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot = np.zeros(1 << 24, np.uint16)
        slot[wanted] = np.arange(1, len(wanted) + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                index = BlockIndex(*text_buffer(part.column(1)), wanted, slot)
                ids = np.array(part.column(0).to_pylist(), object)
                rows = [(int(c).to_bytes(3, "big"), ids[index.held[i]].tolist()) for c, i in index.wanted.items() if index.held[i].any()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], ["trigram", "doc_ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "trigram binary, doc_ids array<long>")
