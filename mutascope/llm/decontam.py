"""Benchmark decontamination with one Aho-Corasick automaton over word sequences.

Benchmark items and documents are normalised alike (A-Z to a-z, words of ASCII letters, digits and
non-ASCII characters). A window is ``width`` words of an item (or the whole item, if shorter). Every window of a long
item holds one of the item's blocks of half a window that start at multiples of their length, so the automaton's
patterns are those blocks and the short items: a tenth of the states that all windows would take. Its symbols are
the digits of word numbers, each digit place with an alphabet of its own, so that matches begin and end at words
and no state has over ``RADIX`` successors. A run of words outside the benchmark is one reset symbol. Each document is
scanned once; the windows around a block found in it are looked up by fingerprint in the sorted table of all windows,
and word numbers lead back to code points of the original text. Windows, their items and the lookups are NumPy arrays.

The benchmark is read in shards of at most ``shard_bytes`` of text. One shard (the usual case) means one
automaton and one pass; a larger benchmark adds one mapping step per shard in the same stage, each
with its own bounded broadcast. Documents are never shuffled.

Defined cases: null or empty texts have no words and no hits; items without words are no patterns;
items with equal ids count once, a null id reads ``null``; an empty benchmark hits nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mutascope.llm import text as X

WIDTH = 10
SHARD_BYTES = 8 << 20
RADIX = 64


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, off = X.buffers(texts)
    starts, ends, doc = X.segments(raw, off, X.ALNUM)
    return X.fingerprints(raw, starts, ends, X.LOWER), doc, starts, ends


def _spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... below each of ``counts``, one after the other."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


class Automaton:
    """Blocks, short items and windows of one benchmark shard. Word number 0 is any word outside the shard."""

    def __init__(self, items: list[tuple[str, str | None]], width: int = WIDTH):
        self.width, self.block = width, (width + 1) // 2
        self.names, owner_name = np.unique(np.array([i for i, _ in items], object), return_inverse=True)
        h, doc, _, _ = _words(pa.array([t for _, t in items], pa.string()))
        self.vocab = np.unique(h)
        ids = np.searchsorted(self.vocab, h) + 1
        self.places = 1
        while RADIX ** self.places <= len(self.vocab):
            self.places += 1
        counts = np.bincount(doc, minlength=len(items))
        begin = np.cumsum(counts) - counts
        long = np.flatnonzero(counts >= width)

        # windows of long items, numbered by sorted fingerprint
        places = counts[long] - width + 1
        prints = self._prints(h, np.repeat(begin[long], places) + _spread(places))
        self.windows, number = np.unique(prints, return_inverse=True)
        window_of, item_of = [number], [np.repeat(owner_name[long], places)]

        self.search = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.sizes, self.is_block, self.short = [], [], []
        next_window = len(self.windows)
        parts = counts[long] // self.block
        blocks = np.repeat(begin[long], parts) + _spread(parts) * self.block
        for size in np.unique(np.append(counts[(counts > 0) & (counts < width)], self.block if len(long) else 0)).tolist():
            whole = np.flatnonzero(counts == size) if 0 < size < width else np.zeros(0, int)
            starts = np.concatenate([begin[whole], blocks]) if size == self.block else begin[whole]
            if not len(starts):
                continue
            rows, which = np.unique(ids[starts[:, None] + np.arange(size)], axis=0, return_inverse=True)
            which = which.ravel()
            found, index = np.unique(which[:len(whole)], return_inverse=True)
            short = np.full(len(rows), -1)
            short[found] = next_window + np.arange(len(found))
            window_of.append(next_window + index)
            item_of.append(owner_name[whole])
            next_window += len(found)
            is_block = np.zeros(len(rows), bool)
            is_block[which[len(whole):]] = True
            base, text = sum(map(len, self.sizes)), self._string(rows.ravel())[0]
            step = size * self.places
            for k in range(len(rows)):
                self.search.add_word(text[k * step:(k + 1) * step], base + k)
            self.sizes.append(np.full(len(rows), size))
            self.is_block.append(is_block)
            self.short.append(short)
        self.any = bool(self.sizes)
        if self.any:
            self.search.make_automaton()
            self.sizes, self.is_block, self.short = map(np.concatenate, (self.sizes, self.is_block, self.short))
        pairs = np.unique(np.concatenate(window_of).astype(np.int64) * max(len(self.names), 1) + np.concatenate(item_of))
        self.items = (pairs % max(len(self.names), 1)).astype(np.int32)
        self.offsets = np.searchsorted(pairs, np.arange(next_window + 1) * max(len(self.names), 1))

    def _prints(self, h: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Fingerprints of the windows at ``starts``."""
        out = np.zeros(len(starts), X.U)
        for k in range(self.width):
            out = X.mix(out * X.U(0xD6E8FEB86659FD93) + h[starts + k])
        return out

    def _string(self, ids: np.ndarray) -> tuple[str, np.ndarray]:
        """The digits of word numbers as characters, and the index in ``ids`` of each character."""
        place = np.arange(self.places)
        digits = ids[:, None] // RADIX ** place % RADIX + place * RADIX + 1
        digits[ids == 0] = 0
        used = (ids != 0)[:, None] | (place == 0)
        index = np.broadcast_to(np.arange(len(ids))[:, None], used.shape)[used]
        return digits[used].astype(np.uint32).tobytes().decode("utf-32-le"), index

    def scan(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words per text; the texts and numbers of hit words; texts and items of occurring windows (both sorted, each once)."""
        h, doc, _, _ = _words(texts)
        counts = np.bincount(doc, minlength=len(texts))
        none = np.zeros(0, int)
        if not self.any or not len(h):
            return counts, none, none, none, none
        at = np.searchsorted(self.vocab, h)
        at[at == len(self.vocab)] = 0
        ids = np.where(self.vocab[at] == h, at + 1, 0)
        edges = np.concatenate([[0], np.cumsum(counts)])
        # one pass over the slice; a 0 between documents keeps patterns inside them
        ids, word = np.insert(ids, edges[1:-1], 0), np.insert(np.arange(len(ids)), edges[1:-1], -1)
        kept = ids != 0
        kept[0] = True
        kept[1:] |= ids[:-1] != 0
        text, index = self._string(ids[kept])
        found = np.fromiter((x for pair in self.search.iter(text) for x in pair), np.int64).reshape(-1, 2)
        if not len(found):
            return counts, none, none, none, none
        ends, pattern = word[kept][index[found[:, 0]]], found[:, 1]

        whole = self.short[pattern] >= 0
        first, last, window = [ends[whole] - self.sizes[pattern[whole]] + 1], [ends[whole]], [self.short[pattern[whole]]]
        near = ends[self.is_block[pattern] & (self.sizes[pattern] == self.block)]
        starts = np.unique(near[:, None] - self.block + 1 - np.arange(self.width - self.block + 1))
        owner = doc[np.maximum(starts, 0)]
        starts = starts[(starts >= edges[owner]) & (starts + self.width <= edges[owner + 1])]
        if len(starts) and len(self.windows):
            prints = self._prints(h, starts)
            at = np.minimum(np.searchsorted(self.windows, prints), len(self.windows) - 1)
            same = self.windows[at] == prints
            first.append(starts[same])
            last.append(starts[same] + self.width - 1)
            window.append(at[same])
        first, last, window = map(np.concatenate, (first, last, window))

        depth = np.zeros(len(h) + 1, np.int64)
        np.add.at(depth, first, 1)
        np.add.at(depth, last + 1, -1)
        hit = np.flatnonzero(np.cumsum(depth[:-1]) > 0)
        occurring = np.unique(doc[first].astype(np.int64) * len(self.offsets) + window)
        texts_of, window = occurring // len(self.offsets), occurring % len(self.offsets)
        many = self.offsets[window + 1] - self.offsets[window]
        pairs = np.unique(np.repeat(texts_of, many) * len(self.names) + self.items[np.repeat(self.offsets[window], many) + _spread(many)])
        return counts, doc[hit], hit - edges[doc[hit]], pairs // len(self.names), pairs % len(self.names)


def _shards(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark's items in lists of at most ``limit`` bytes; one list is on the driver at a time."""
    rows = (benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("i"), F.col("text").alias("t"))
            .where(F.col("t").isNotNull()))
    total = rows.agg(F.sum(F.octet_length("t")).alias("b")).first().b or 0
    parts = int(total // limit) + 1
    for k in range(parts):
        part = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k)
        yield [(r.i, r.t) for r in part.toLocalIterator()]


def occurrences(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), width: int = WIDTH,
                shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Per row: the ``keep`` columns, ``n_words``, ``hit_words`` (sorted numbers of hit words) and
    ``items`` (distinct ids of items with an occurring window, sorted as strings)."""
    sc = docs.sparkSession.sparkContext
    out, first = docs, True
    carried = list(dict.fromkeys([*keep, "text"]))
    for items in _shards(benchmark, shard_bytes):
        shared, name = sc.broadcast(items), uuid.uuid4().hex

        def compute(shared=shared, name=name, first=first):
            automaton = _automaton(shared, name, width)

            def work(part: pa.RecordBatch) -> list:
                n = part.num_rows
                counts, text, words, owner, item = automaton.scan(part.column("text"))
                words = np.split(words, np.searchsorted(text, np.arange(1, n)))
                names = np.split(automaton.names[item], np.searchsorted(owner, np.arange(1, n)))
                if first:
                    return [counts, words[:n], [x.tolist() for x in names[:n]]]
                old = part.column("hit_words").to_pylist(), part.column("items").to_pylist()
                return [counts, [np.union1d(x, w).astype(np.int32) for x, w in zip(old[0], words)],
                        [sorted({*x, *w}) for x, w in zip(old[1], names)]]
            return work

        out = _step(out, carried, first, compute)
        first = False
    return out.select(*keep, "n_words", "hit_words", "items")


def _step(df: DataFrame, carried: list[str], first: bool, compute) -> DataFrame:
    fields = "n_words long, hit_words array<int>, items array<string>"
    if first:
        return X.map_rows(df.select(*carried), carried, fields, compute)
    renamed = df.select(*carried, F.col("hit_words").alias("_w"), F.col("items").alias("_i"))

    def again():
        work = compute()
        return lambda part: work(pa.RecordBatch.from_arrays(
            [part.column("text"), part.column("_w"), part.column("_i")], names=["text", "hit_words", "items"]))

    return X.map_rows(renamed, [*carried, "_w", "_i"], fields, again).drop("_w", "_i")


KEPT = 2  # automata a Python worker keeps, so that chained shards of one query do not rebuild in turn


def _automaton(shared, name: str, width: int) -> Automaton:
    """Built once per Python worker, by the shard's own name."""
    return X.tool("decontam", name, lambda: Automaton(shared.value, width), KEPT)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The digest per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    found = occurrences(docs, benchmark, **options)
    return found.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"),
                        F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
                        (F.size("hit_words") > 0).alias("contaminated"))


def hit_spans(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Contaminated rows with ``spans``: code-point ranges of the original text, one per run of hit words."""
    found = occurrences(docs, benchmark, keep=("doc_id", "text"), **options).where(F.size("hit_words") > 0)

    def compute():
        def spans(text: str, words: list[int]) -> list[dict]:
            _, _, starts, ends = _words(pa.array([text]))
            raw = text.encode()
            point = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
            out: list[list[int]] = []
            for w in words:
                if out and out[-1][2] == w - 1:
                    out[-1][1:] = [int(point[ends[w]]), w]
                else:
                    out.append([int(point[starts[w]]), int(point[ends[w]]), w])
            return [{"start": a, "end": b} for a, b, _ in out]

        return lambda part: [[spans(t, w) for t, w in zip(part.column("text").to_pylist(),
                                                          part.column("hit_words").to_pylist())]]

    return X.map_rows(found, ["doc_id", "hit_words"], "spans array<struct<start:int,end:int>>", compute).drop("hit_words")


def keep_clean(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """The documents without any hit, with all their columns."""
    rows, back = X.hidden(docs, "text")
    found = occurrences(rows, benchmark, keep=tuple(rows.columns), width=width)
    return found.where(F.size("hit_words") == 0).select(*back)
