"""BPE encoding and decoding by speculation and verification.

For all new distinct words at once a greedy longest match over the vocabulary (one automaton) proposes tokens. A
proposal is the true BPE result exactly if each token is what its own string merges to and each adjacent pair
of tokens stays as it is when the two are merged together; a merge that crosses any boundary would
show in that pair. All pairs are tested in whole arrays, by undoing the merges at the boundary; only words with a
failing pair go through exact merging, many words a round.

Normalisation and word splitting follow the tokenizer file: special tokens are cut out of the raw
text, then NFC, lower case, and the split pattern. Texts with characters above U+024F use the
tokenizers library's own normaliser and pre-tokenizer, whose Unicode tables may differ from
Python's; the merging is done here for all texts.

Defined cases: a null text is empty; an empty text has no tokens (digests of empty strings, decoded
text empty); very long texts and words are handled whole; repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from mutascope.llm import text as X

SHORT, NEVER = 40, 1 << 30
STOP = "\u0100"  # the end of a word, beyond all byte characters
GROUP = 20_000  # words proposed and verified at once
FIELDS = "n_tokens long, ids_sha256 string, decoded_sha256 string"
CACHE = 120_000  # words remembered by a Python worker (about 200 bytes each), which later stages of its executor live with


def vocabulary_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _byte_chars() -> list[str]:
    """The printable stand-in for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b], spare = chr(spare), spare + 1
    return [table[b] for b in range(256)]


class Coder:
    """Encoder and decoder for a word-end BPE file of the tokenizers library."""

    def __init__(self, path: str, cache: int = CACHE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self._library = path, None
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"]
        self.ranks = {tuple(m): i for i, m in enumerate(spec["model"]["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        by_id = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.names = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.bytes = _byte_chars()
        self.token_ok = np.zeros(len(self.names), np.int8)  # 0 unknown, 1 stays, 2 does not
        self._tables()
        self.known: dict[str, bytes] = {}  # ids of words seen, as little-endian 32-bit integers
        self.older: dict[str, bytes] = {}  # the generation before
        self.cache = cache
        self.speculated = self.failed = 0

    @property
    def library(self):
        """The tokenizers library's object, for normalising and splitting texts beyond the fast path."""
        if self._library is None:
            from tokenizers import Tokenizer
            self._library = Tokenizer.from_file(self.path)
        return self._library

    # ---- words -------------------------------------------------------------------------------
    def split(self, text: str) -> list[str]:
        """Words of the text in order; a special token stands as itself."""
        if self.cut and "<|" in text and self.cut.search(text):
            out = []
            for i, piece in enumerate(self.cut.split(text)):
                out.extend([piece] if i % 2 else self._plain(piece))
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii() or max(text) < "ɐ":
            return self.words.findall(unicodedata.normalize("NFC", text).lower())
        normal = self.library.normalizer.normalize_str(text)
        back = {c: b for b, c in enumerate(self.bytes)}
        return [bytes(back[c] for c in w).decode("utf-8") for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def symbols(self, word: str) -> list[str]:
        s = list(word) if word.isascii() and word.isprintable() else [self.bytes[b] for b in word.encode("utf-8")]
        s[-1] += self.end
        return s

    # ---- exact merging -----------------------------------------------------------------------
    def merge(self, symbols: list[str]) -> list[str]:
        """Apply the lowest-ranked merge, leftmost first, until none is left."""
        if len(symbols) <= SHORT:
            return self._merge_short(symbols)
        n = len(symbols)
        sym: list[str | None] = list(symbols)
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1)
                if (r := self.ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = a + b, None
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for left, right in ((prv[i], i), (i, nxt[i])):
                if left >= 0 and right >= 0 and (r := self.ranks.get((sym[left], sym[right]))) is not None:
                    heapq.heappush(heap, (r, left, sym[left], sym[right]))
        return [s for s in sym if s is not None]

    def _merge_short(self, symbols: list[str]) -> list[str]:
        """The same for few symbols, without a heap."""
        parts, get = list(symbols), self.ranks.get
        ranks = [get(pair, NEVER) for pair in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == NEVER:
                break
            i = ranks.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), NEVER)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), NEVER)
        return parts

    def _parts(self, token: str) -> list[str]:
        """The starting symbols of a token's string."""
        if token.endswith(self.end) and len(token) > len(self.end):
            body = list(token[:-len(self.end)])
            body[-1] += self.end
            return body
        return list(token)

    # ---- speculation ---------------------------------------------------------------------------
    def _tables(self) -> None:
        """Merge tables as arrays over token ids, and one automaton of all tokens. Tokens are written as raw bytes (one
        character each), the word end as ``STOP``."""
        import ahocorasick
        back = {c: chr(b) for b, c in enumerate(self.bytes)}

        def raw(token: str) -> str:
            body, end = (token[:-len(self.end)], STOP) if token.endswith(self.end) and len(token) > len(self.end) else (token, "")
            return "".join(back.get(c, "") for c in body) + end

        n = len(self.names)
        self.size = np.zeros(n, np.int64)  # characters of a token, the word end included
        self.first = np.full((2, 256), -1, np.int64)  # token of a byte inside a word and at its end
        self.matcher = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            plain = raw(token)
            self.size[i] = len(plain)
            self.matcher.add_word(plain, i)
            if len(plain.rstrip(STOP)) == 1:
                self.first[int(plain.endswith(STOP)), ord(plain[0])] = i
        self.matcher.make_automaton()
        self.rank = np.full(n, -1, np.int64)  # of the merge that makes a token; -1: a single byte
        self.left, self.right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        made = np.zeros(len(self.ranks), np.int64)
        codes = np.zeros(len(self.ranks), np.int64)
        for (x, y), r in self.ranks.items():
            t = self.vocab[x + y]
            made[r], codes[r] = t, self.vocab[x] << 32 | self.vocab[y]
            self.left[t], self.right[t] = self.vocab[x], self.vocab[y]
            self.token_ok[t] = 2 if self.rank[t] >= 0 else 0  # two merges with one result are left to exact merging
            self.rank[t] = r
        self.made = np.append(made, -1)
        self.order = np.argsort(codes)
        self.codes = codes[self.order]
        joined = self.rank >= 0
        early = joined & ((self.rank[self.left] >= self.rank) | (self.rank[self.right] >= self.rank))
        self.token_ok[early] = 2

    def _merge_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of two tokens, ``NEVER`` if there is none (or a token is -1)."""
        code = left << 32 | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.codes[at] == code), self.order[at], NEVER)

    def _stays(self, tokens: np.ndarray) -> np.ndarray:
        for t in np.unique(tokens[self.token_ok[tokens] == 0]):
            name = self.names[int(t)]
            self.token_ok[t] = 1 if self.merge(self._parts(name)) == [name] else 2
        return self.token_ok[tokens] == 1

    def _compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether adjacent tokens stay apart when their letters are merged together.

        Merging is undone from the boundary outwards, latest merge first. At each point the two tokens at the
        boundary would have joined if their merge comes before the one that was undone last: strictly before
        it on the left, where the tie goes to the pair further left, or not after it on the right.
        """
        ok = np.ones(len(left), bool)
        at, l, r = np.arange(len(left)), left.astype(np.int64), right.astype(np.int64)
        limit = np.full(len(left), NEVER, np.int64)
        while len(at):
            joins = self._merge_rank(l, r) < limit
            ok[at[joins]] = False
            a, b = self.rank[l], self.rank[r]
            go = ~joins & ((a >= 0) | (b >= 0))
            at, l, r, a, b = at[go], l[go], r[go], a[go], b[go]
            undo = a > b
            limit = np.where(undo, a, b + 1)
            l, r = np.where(undo, self.right[l], l), np.where(undo, r, self.left[r])
        return ok

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greedy longest match over all words at once: tokens, the word of each, and per word whether it is covered."""
        plain = [w if w.isascii() else w.encode("utf-8").decode("latin-1") for w in words]
        joined = STOP.join(plain) + STOP
        ends = np.cumsum([len(w) + 1 for w in plain])
        found = np.array(list(self.matcher.iter_long(joined)), np.int64).reshape(-1, 2)
        last, tokens = found[:, 0] + 1, found[:, 1]
        of = np.searchsorted(ends, last)
        covered = np.bincount(of, self.size[tokens], len(words)) == np.diff(ends, prepend=0)
        starts = last - self.size[tokens]
        gap = np.flatnonzero(starts != np.concatenate([[0], last[:-1]]))
        covered[of[gap]] = False
        return tokens, of, covered

    # ---- exact merging of many words ---------------------------------------------------------------
    def merge_all(self, words: list[str]) -> list[np.ndarray]:
        """``merge`` for many words: every round applies the lowest merge of each word still open."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(words)
        raw = [w.encode("utf-8") for w in words]
        short = [i for i, w in enumerate(raw) if len(w) <= SHORT]
        for i in set(range(len(raw))).difference(short):
            out[i] = np.array([self.vocab[x] for x in self.merge(self.symbols(words[i])) if x in self.vocab], np.int64)
        if not short:
            return out
        sizes = np.array([len(raw[i]) for i in short])
        inside = np.arange(sizes.max()) < sizes[:, None]
        sym = np.full(inside.shape, -1, np.int64)
        sym[inside] = self.first[0, np.frombuffer(b"".join([raw[i] for i in short]), np.uint8)]
        rows = np.arange(len(short))
        sym[rows, sizes - 1] = self.first[1, np.array([raw[i][-1] for i in short])]
        sym = np.concatenate([sym, np.full((len(short), 1), -1)], axis=1)
        rank = self._merge_rank(sym[:, :-1], sym[:, 1:])
        while len(rows):
            at = rank.argmin(1)
            line = np.arange(len(rows))
            low = rank[line, at]
            for k in np.flatnonzero(low == NEVER):
                out[short[rows[k]]] = sym[k][sym[k] >= 0]
            go = low < NEVER
            sym, rank, at, low, rows, line = sym[go], rank[go], at[go], low[go], rows[go], line[:int(go.sum())]
            if not len(rows):
                break
            cols = np.arange(sym.shape[1] - 1)
            shift = cols + (cols > at[:, None])
            sym = np.take_along_axis(sym, np.concatenate([shift, np.full((len(rows), 1), sym.shape[1] - 1)], axis=1), 1)
            sym[line, at] = self.made[low]
            rank = np.take_along_axis(rank, np.minimum(shift, rank.shape[1] - 1), 1)
            rank[:, -1] = NEVER
            rank[line, at] = self._merge_rank(sym[line, at], sym[line, at + 1])
            before = np.maximum(at - 1, 0)
            rank[line, before] = np.where(at > 0, self._merge_rank(sym[line, before], sym[line, before + 1]), rank[line, before])
        return out

    def learn(self, words: list[str]) -> None:
        """Encode new distinct words into the cache: propose, verify all pairs at once, repair failures."""
        plain = [w for w in words if w and w not in self.special]
        for first in range(0, len(plain), GROUP):
            self._learn(plain[first:first + GROUP])
        for w in words:
            if w in self.special:
                self.known[w] = pack("<I", self.special[w])

    def _learn(self, words: list[str]) -> None:
        tokens, of, good = self.propose(words)
        good[of[~self._stays(tokens)]] = False
        inner = np.flatnonzero((of[1:] == of[:-1]) & good[of[1:]])
        good[of[inner[~self._compatible(tokens[inner], tokens[inner + 1])]]] = False
        ids = tokens.astype("<u4").tobytes()
        ends = 4 * np.searchsorted(of, np.arange(len(words)), side="right")
        bad = np.flatnonzero(~good).tolist()
        self.speculated += len(words)
        self.failed += len(bad)
        first = 0
        for w, last in zip(words, ends.tolist()):
            self.known[w] = ids[first:last]
            first = last
        for i, repaired in zip(bad, self.merge_all([words[i] for i in bad])):
            self.known[words[i]] = repaired.astype("<u4").tobytes()

    def encode_slice(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """(ids as little-endian 32-bit integers, decoded text) of each text."""
        split = [self.split(t) for t in texts]
        distinct = set().union(*split) if split else set()
        if 2 * len(self.known) > self.cache:
            self.known, self.older = {}, self.known
        new = []
        for w in distinct.difference(self.known):  # words in use move to the young generation
            found = self.older.get(w)
            if found is None:
                new.append(w)
            else:
                self.known[w] = found
        if new:
            self.learn(new)
        known, names, out = self.known, self.names, []
        for words in split:
            ids = b"".join([known[w] for w in words])
            out.append((ids, " ".join([names[t] for t in memoryview(ids).cast("I")])))
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_slice([text or ""])[0][0], "<u4")

    def decode(self, ids) -> str:
        """Token strings with one space between them; the file names no decoder."""
        return " ".join(self.names[i] for i in map(int, ids) if i < len(self.names))


def coder(path: str) -> Coder:
    """The worker's coder for a vocabulary file, kept for its next tasks."""
    return X.tool("bpe", path, lambda: Coder(path))


def encode(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Token count and digests of ids and decoded text of each row, plus the ``keep`` columns."""
    path = path or vocabulary_file()

    def compute():
        c = coder(path)

        def work(part: pa.RecordBatch) -> list:
            rows = c.encode_slice([t or "" for t in part.column("text").to_pylist()])
            return [[len(ids) // 4 for ids, _ in rows], [hashlib.sha256(ids).hexdigest() for ids, _ in rows],
                    [hashlib.sha256(s.encode()).hexdigest() for _, s in rows]]
        return work

    return X.map_rows(docs, list(keep), FIELDS, compute)


def encode_ids(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The token ids themselves (``ids array<int>``) before the columns of ``encode``."""
    path = path or vocabulary_file()

    def compute():
        c = coder(path)

        def work(part: pa.RecordBatch) -> list:
            rows = c.encode_slice([t or "" for t in part.column("text").to_pylist()])
            sizes = np.array([len(ids) // 4 for ids, _ in rows])
            flat = np.frombuffer(b"".join([ids for ids, _ in rows]), "<i4")
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int32()))
            return [ids, pa.array(sizes, pa.int64()), [hashlib.sha256(i).hexdigest() for i, _ in rows],
                    [hashlib.sha256(s.encode()).hexdigest() for _, s in rows]]
        return work

    return X.map_rows(docs, list(keep), "ids array<int>, " + FIELDS, compute)


def decode_ids(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """``text`` of each row's ``ids`` (null ids: empty text), beside the other columns."""
    path = path or vocabulary_file()
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    @F.pandas_udf(T.StringType())
    def text_of(ids):
        c = coder(path)
        return ids.map(lambda x: "" if x is None else c.decode(x))

    return tokens.withColumn("text", text_of("ids"))
