"""Secret scans over a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must
contain (from its parse tree: literals are joined while few, alternatives become OR, the trigrams of one
literal become AND). Texts are indexed by slice: postings of the trigrams that occur in any query map to
the slice's documents. A rule's candidates are the result of intersecting and uniting postings; only
candidates are scanned with the rule itself. Rules without mandatory trigrams (runs of hex digits) scan
every text. The index lives with the documents, so nothing is shuffled.

Index and queries fold A-Z to a-z. Matching runs on UTF-8 bytes; all classes are ASCII, and offsets are
turned into code points. Defined cases: null and empty texts have no spans; long texts are searched whole.
"""

from __future__ import annotations

import hashlib
import re
import re._constants as rc
import re._parser as rp
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mutascope.llm import text as X

FIELDS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0       # group whose length counts
    at_least: int = 1    # shorter matches are dropped


# The three base kinds, then well-known public token formats.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", at_least=20),
    Rule("hex", r"[0-9a-f]+", at_least=24),
)
EXTRA = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("bearer", r"authorization[\"']?\x20*[:=]\x20*[\"']?bearer\x20+[A-Za-z0-9._~+/-]{16,}", True),
)

ALL = ("all",)
LIMIT = 64  # literals kept apart in one query part


def _literal_query(strings: set[str]):
    """Every match contains one of the strings; each needs all its trigrams."""
    parts = []
    for s in strings:
        grams = {s[i:i + 3] for i in range(len(s) - 2)}
        if not grams:
            return ALL
        parts.append(("and", frozenset(grams)))
    return ("or", tuple(sorted(parts, key=str)))


def _both(a, b):
    return b if a == ALL else a if b == ALL else ("both", (a, b))


def _walk(tree) -> tuple[set[str] | None, tuple]:
    """(all strings the tree can match, if few; a query that every match satisfies)."""
    exact: set[str] | None = {""}
    whole, query = True, ALL
    for op, arg in tree:
        one, asked = _node(op, arg)
        query = _both(query, asked)
        if one is not None and exact is not None and len(exact) * len(one) <= LIMIT:
            exact = {a + b for a, b in product(exact, one)}
        else:
            query, whole = _both(query, _literal_query(exact)), False
            exact = one if one is not None else {""}
    return (exact, query) if whole else (None, _both(query, _literal_query(exact)))


def _node(op, arg) -> tuple[set[str] | None, tuple]:
    if op is rc.LITERAL:
        return {chr(arg).lower()}, ALL
    if op is rc.SUBPATTERN:
        return _walk(arg[-1])
    if op is rc.BRANCH:
        found = [_walk(t) for t in arg[1]]
        if all(e is not None for e, _ in found) and sum(len(e) for e, _ in found) <= LIMIT:
            return set().union(*(e for e, _ in found)), ALL
        parts = [_literal_query(e) if e is not None else q for e, q in found]
        return None, ALL if ALL in parts else ("or", tuple(parts))
    if op is rc.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is rc.LITERAL:
                chars.add(chr(value).lower())
            elif kind is rc.RANGE:
                chars.update(chr(c).lower() for c in range(value[0], value[1] + 1))
            else:
                return None, ALL
        return (chars, ALL) if len(chars) <= 8 else (None, ALL)
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
        low, high, body = arg
        exact, query = _walk(body)
        if high == 1 and low == 0 and exact is not None:
            return exact | {""}, ALL
        if low == 0:
            return None, ALL
        if exact is not None and low == high and len(exact) ** low <= LIMIT:
            return {"".join(p) for p in product(exact, repeat=low)}, ALL
        return None, query if exact is None else _literal_query(exact)
    return None, ALL


def trigram_query(pattern: str):
    """Boolean trigram query of a pattern (``ALL``: it has no mandatory trigram)."""
    exact, query = _walk(rp.parse(pattern))
    return _literal_query(exact) if exact is not None else query


def grams_of(query) -> set[str]:
    if query == ALL:
        return set()
    if query[0] == "and":
        return set(query[1])
    return set().union(*(grams_of(q) for q in query[1]))


class Scanner:
    """Compiled rules and the numbers of the trigrams that their queries name."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.regex = [re.compile(r.pattern.encode(), re.IGNORECASE if r.ignore_case else 0) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.grams = sorted(set().union(*map(grams_of, self.queries)))
        self.number = {g: i for i, g in enumerate(self.grams)}
        self.table = np.zeros(1 << 24, np.uint16)
        for g, i in self.number.items():
            a, b, c = g.encode("latin-1")
            self.table[a << 16 | b << 8 | c] = i + 1

    def index(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Postings of a slice as one bit row per trigram: which documents contain it."""
        n = len(off) - 1
        postings = np.zeros((len(self.grams), n), bool)
        if len(raw) >= 3:
            low = X.LOWER[raw].astype(np.uint32)
            number = self.table[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
            at = np.flatnonzero(number)
            doc = np.searchsorted(off, at, side="right") - 1
            inside = at + 3 <= off[doc + 1]
            postings[number[at[inside]] - 1, doc[inside]] = True
        return postings

    def candidates(self, query, postings: np.ndarray) -> np.ndarray:
        if query == ALL:
            return np.ones(postings.shape[1], bool)
        if query[0] == "and":
            return np.logical_and.reduce([postings[self.number[g]] for g in query[1]])
        rows = [self.candidates(q, postings) for q in query[1]]
        return (np.logical_or if query[0] == "or" else np.logical_and).reduce(rows)

    def scan(self, col: pa.Array) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) in code points of each text, in order."""
        raw, off = X.buffers(col)
        postings, data = self.index(raw, off), raw.tobytes()
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(off) - 1)]
        bounds = off.tolist()
        for k, rule in enumerate(self.rules):
            for d in np.flatnonzero(self.candidates(self.queries[k], postings)).tolist():
                lo = bounds[d]
                if self.queries[k] == ALL and rule.pattern == r"[0-9a-f]+":
                    continue
                for m in self.regex[k].finditer(data[lo:bounds[d + 1]]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.at_least:
                        found[d].append((m.start(), k, m.end()))
            if self.queries[k] == ALL and rule.pattern == r"[0-9a-f]+":
                for a, b, d in zip(*_hex_runs(raw, off, rule.at_least)):
                    found[d].append((a - bounds[d], k, b - bounds[d]))
        for d, rows in enumerate(found):
            if rows:
                rows.sort()
                text = raw[off[d]:off[d + 1]]
                if (text >= 128).any():
                    point = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
                    found[d] = [(int(point[a]), k, int(point[b])) for a, k, b in rows]
        return found


HEX = np.zeros(256, bool)
HEX[48:58] = HEX[97:103] = True


def _hex_runs(raw: np.ndarray, off: np.ndarray, at_least: int):
    """The full scan of the hex rule: maximal runs over the whole slice at once."""
    starts, ends, doc = X.segments(raw, off, HEX)
    long = ends - starts >= at_least
    return starts[long].tolist(), ends[long].tolist(), doc[long].tolist()


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _scanners:
        _scanners[rules] = Scanner(rules)
    return _scanners[rules]


def find(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``secrets``: array of (kind, start, end) per row, by start, then rule order."""
    def compute():
        s = scanner(rules)
        return lambda part: [[[{"kind": s.rules[k].kind, "start": a, "end": b} for a, k, b in rows]
                              for rows in s.scan(part.column("text"))]]

    return X.map_rows(docs, list(keep), "secrets array<struct<kind:string,start:int,end:int>>", compute)


def digest(docs: DataFrame, extra: tuple[Rule, ...] = EXTRA) -> DataFrame:
    """Counts per base kind, digest of base spans, and all spans as text."""
    def compute():
        s = scanner(BASE + extra)

        def work(part: pa.RecordBatch) -> list:
            rows = s.scan(part.column("text"))
            name = [r.kind for r in s.rules]
            base = [",".join(f"{name[k]}:{a}:{b}" for a, k, b in r if k < len(BASE)) for r in rows]
            return [*[[sum(x[1] == k for x in r) for r in rows] for k in range(len(BASE))],
                    [hashlib.sha256(b.encode()).hexdigest() for b in base],
                    [",".join(f"{name[k]}:{a}:{b}" for a, k, b in r) for r in rows]]
        return work

    return X.map_rows(docs, ["doc_id"], FIELDS, compute)


def masked(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA, mask: str = "<SECRET>") -> DataFrame:
    """``doc_id`` and ``text`` with every found span replaced; overlapping spans are merged first."""
    def compute():
        s = scanner(rules)

        def clean(text: str | None, rows) -> str | None:
            if text is None or not rows:
                return text
            out, at = [], 0
            for a, _, b in rows:
                if a >= at:
                    out += [text[at:a], mask]
                at = max(at, b)
            return "".join(out) + text[at:]

        return lambda part: [[clean(t, r) for t, r in zip(part.column("text").to_pylist(), s.scan(part.column("text")))]]

    return X.map_rows(docs, ["doc_id"], "masked string", compute).withColumnRenamed("masked", "text")


__all__ = ["Rule", "BASE", "EXTRA", "Scanner", "find", "digest", "masked", "trigram_query"]
