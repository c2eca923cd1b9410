"""Document probability under a unigram subword model, summed over all segmentations.

The pieces are those of an existing subword vocabulary. Their unigram scores come from the training
documents: distinct training words are counted, each is cut by the vocabulary's own tokenizer, and a piece's
score is the log of its (smoothed) share of all pieces and document ends. A word's probability is the sum
over every path through its lattice of pieces, by forward recursion in log space; a text's is the product
over its words and one end. Characters that are no piece are spelled with the byte pieces.

The base score is an add-0.1 unigram model over words. Counts and word probabilities are worked out once
per distinct word and joined, not collected: words that make up at least 1/HOT of all training tokens (at most
HOT words, by definition) are broadcast, all other words of a document are joined to the table by shuffle. No
training document makes such a key hot; a word that is frequent only in held-out documents could be, which
the skew split of the join covers.

Defined cases: null and empty texts consist of one end; no training documents give N = V = 0; a null
doc_id counts as the empty text in the fold rule; rows with equal ids are scored separately; words of any
length are handled whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mutascope.llm import text as X

HOT = 300_000
ALPHA = 0.1       # added to every piece count
END = ""          # the end token in count tables; words are never empty
MARK = "▁"   # word beginning in the vocabulary


def vocabulary_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0


def _words(col: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a slice (A-Z folded), flat, and the number in each text."""
    raw, off = X.buffers(col)
    starts, ends, doc = X.segments(raw, off, X.NOT_SPACE)
    sizes = ends - starts
    keep = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(starts) else np.zeros(0, np.int64)
    data = X.LOWER[raw[keep]]
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))
    return flat, np.bincount(doc, minlength=len(off) - 1)


def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c) of every token of every document, where c counts training documents only (0: held out only).
    Slices are counted before the shuffle."""
    marked = docs.select("text", held_out().alias("held"))

    def count(batches):
        for batch in batches:
            for part in X.slices(batch, size=8 * X.SLICE):
                held = part.column("held").to_numpy(zero_copy_only=False).astype(bool)
                for weight, rows in ((1, np.flatnonzero(~held)), (0, np.flatnonzero(held))):
                    words, _ = _words(part.column("text").take(pa.array(rows)))
                    found = pc.value_counts(words)
                    n = pa.array(found.field("counts").to_numpy(zero_copy_only=False) * weight, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [pa.concat_arrays([found.field("values").cast(pa.string()), pa.array([END])]),
                         pa.concat_arrays([n, pa.array([len(rows) * weight], pa.int64())])], names=["token", "c"])
            X.tidy()

    return marked.mapInArrow(count, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def piece_counts(counts: DataFrame, path: str) -> DataFrame:
    """(piece number, count) from cutting each distinct training word once; at most one row per piece."""
    def cut(batches):
        sp = _processor(path)
        total = np.zeros(sp.get_piece_size(), np.int64)
        for batch in batches:
            pieces = sp.encode(batch.column("token").to_pylist())
            sizes = np.array([len(p) for p in pieces])
            if sizes.sum():
                np.add.at(total, np.concatenate([np.array(p, np.int64) for p in pieces if p]),
                          np.repeat(batch.column("c").to_numpy(), sizes))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "c"])

    words = counts.where((F.col("token") != END) & (F.col("c") > 0))
    return words.mapInArrow(cut, "piece int, c long").groupBy("piece").agg(F.sum("c").alias("c"))


_processors: dict[str, object] = {}


def _processor(path: str):
    if path not in _processors:
        import sentencepiece
        _processors[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _processors[path]


class Model:
    """Piece scores (natural logs) and the forward recursion."""

    def __init__(self, scores: dict[str, float], byte_scores: list[float], end: float):
        self.scores, self.bytes, self.end = scores, byte_scores, end
        self.reach: dict[str, int] = {}  # longest piece with the same first two characters
        for piece in scores:
            self.reach[piece[:2]] = max(self.reach.get(piece[:2], 0), len(piece))

    @classmethod
    def trained(cls, counts: dict[int, int], ends: int, path: str, alpha: float = ALPHA) -> "Model":
        sp = _processor(path)
        usable = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i))]
        total = sum(counts.get(i, 0) + alpha for i in usable) + ends + alpha
        log = {i: math.log((counts.get(i, 0) + alpha) / total) for i in usable}
        scores = {sp.id_to_piece(i): log[i] for i in usable if not sp.is_byte(i)}
        spelled = {int(sp.id_to_piece(i)[3:5], 16): log[i] for i in usable if sp.is_byte(i)}
        return cls(scores, [spelled.get(b, math.log(alpha / total)) for b in range(256)], math.log((ends + alpha) / total))

    def word(self, word: str) -> float:
        """Log of the summed probability of all segmentations of one word."""
        s, scores, reach = MARK + word, self.scores, self.reach
        n = len(s)
        best: list[list[float]] = [[] for _ in range(n + 1)]
        best[0] = [0.0]
        exp, log = math.exp, math.log
        for i in range(n):
            arcs = best[i]
            if len(arcs) == 1:
                here = arcs[0]
            else:
                top = max(arcs)
                here = top + log(sum([exp(a - top) for a in arcs]))
            best[i] = []
            one = scores.get(s[i])
            best[i + 1].append(here + (one if one is not None else sum(self.bytes[b] for b in s[i].encode())))
            for j in range(i + 2, min(n, i + reach.get(s[i:i + 2], 0)) + 1):
                piece = scores.get(s[i:j])
                if piece is not None:
                    best[j].append(here + piece)
        top = max(best[n])
        return top + log(sum([exp(a - top) for a in best[n]]))


def train(counts: DataFrame, path: str) -> tuple[Model, int, int]:
    """The model, N (training tokens) and V (distinct training tokens).

    What reaches the driver is one row per vocabulary piece (its size is fixed by the vocabulary) and one
    row of totals.
    """
    total = counts.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    pieces = {r.piece: r.c for r in piece_counts(counts, path).collect()}
    ends = counts.where(F.col("token") == END).agg(F.sum("c").alias("c")).first().c or 0
    return Model.trained(pieces, ends, path), int(total.n or 0), int(total.v)


def scored_tokens(counts: DataFrame, model: Model) -> DataFrame:
    """``counts`` with ``lattice``, each token's log probability: every distinct token is segmented once."""
    shared = counts.sparkSession.sparkContext.broadcast(model)

    def work(part: pa.RecordBatch) -> list:
        m = shared.value
        return [[m.word(w) if w != END else m.end for w in part.column("token").to_pylist()]]

    return X.map_rows(counts, ["token", "c"], "lattice double", lambda: work, column="token")


def score(docs: DataFrame, path: str | None = None, hot: int = HOT) -> DataFrame:
    """Base and lattice log10 probabilities of every row."""
    path = path or vocabulary_file()
    spark = docs.sparkSession
    counts = X.written(token_counts(docs), "counts")
    model, n, v = train(counts, path)
    tokens = X.written(scored_tokens(counts, model), "tokens")
    often = (F.col("c") * hot >= n) & (F.col("c") > 0) | (F.col("token") == END)
    frequent = {r.token: (r.c, r.lattice) for r in tokens.where(often).toLocalIterator()}
    shared = spark.sparkContext.broadcast((frequent, model.end))
    divisor = math.log10(n + 0.1 * (v + 1))

    def compute():
        frequent, end = shared.value
        end_count = frequent.get(END, (0, end))[0]
        none = (0, 0.0)

        def work(part: pa.RecordBatch) -> list:
            flat, sizes = _words(part.column("text"))
            coded = flat.dictionary_encode()
            found = [frequent.get(w, none) for w in coded.dictionary.to_pylist()]
            index = coded.indices.to_numpy()
            c = np.array([x[0] for x in found], np.int64)
            lattice = np.array([x[1] for x in found], float)
            logs = np.where(c > 0, np.log10(c + 0.1), 0.0)
            owner = np.repeat(np.arange(len(sizes)), sizes)

            def by_text(values: np.ndarray) -> np.ndarray:
                return np.bincount(owner, weights=values, minlength=len(sizes))

            rare = c[index] == 0
            rest = np.bincount(owner[rare], minlength=len(sizes))
            names = coded.dictionary.cast(pa.string()).take(pa.array(index[rare]))
            return [pa.array(sizes + 1, pa.int64()), pa.array(sizes - rest + (end_count > 0), pa.int64()),
                    pa.array(by_text(logs[index]) + math.log10(end_count + 0.1)), pa.array(by_text(lattice[index]) + end),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rest)]), pa.int32()), names)]
        return work

    fields = "n_tokens long, hot_known long, hot_logs double, hot_lattice double, rare array<string>"
    rows = X.map_rows(docs.select("doc_id", "text"), ["doc_id"], fields, compute, size=4 * X.SLICE)
    rows = X.written(rows.withColumn("row", F.monotonically_increasing_id()), "scored")
    rare = rows.select("row", F.explode("rare").alias("token"))
    few = tokens.where(~often)
    gained = (rare.join(few, "token").groupBy("row")
              .agg(F.count_if(F.col("c") > 0).alias("more"), F.sum(F.log10(F.col("c") + 0.1)).alias("logs"),
                   F.sum("lattice").alias("lattice")))
    out = rows.drop("rare").join(gained, "row", "left")

    def plus(column: str, extra: str, zero):
        return F.col(column) + F.coalesce(extra, F.lit(zero))

    return out.select("doc_id", held_out().alias("held_out"), "n_tokens",
                      plus("hot_known", "more", 0).cast(T.LongType()).alias("n_known"),
                      F.lit(n).cast(T.LongType()).alias("train_tokens"),
                      (plus("hot_logs", "logs", 0.0) - F.col("n_tokens") * divisor).alias("base_score"),
                      (plus("hot_lattice", "lattice", 0.0) / math.log(10)).alias("score"))
