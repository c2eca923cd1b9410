"""Embedding job: pluggable encoders run in Arrow batches, resumable store.

An encoder turns a list of sequences into per-token representations
``[B, T, D]`` (first token = start marker, then L residues, then end/padding)
and is mean-pooled over residue tokens 1..L only. Encoders run inside
``mapInPandas``: one Python worker per task, the encoder is built once per
worker and fed sub-batches of ``batch_size`` sequences sorted by length.

Built-in encoders (stand-ins; no protein language model ships here):
* ``ResidueScaleEncoder`` - one-hot residue identity + hydropathy per token;
* ``KmerHashEncoder``    - hashed k-mer identity per token (k-mer counts).
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from mutascope.functions.residues import ALPHABET, KYTE_DOOLITTLE, MAX_RESIDUES

SENTINEL = 1.0e6        # value of marker/padding tokens; must never reach a pooled vector
_CODE = np.zeros(256, dtype=np.int64)     # 0 = non-standard
_CODE[np.frombuffer(ALPHABET.encode(), dtype=np.uint8)] = np.arange(1, len(ALPHABET) + 1)


def _codes(seq: str) -> np.ndarray:
    """Residue codes through a byte table; characters beyond one byte are non-standard."""
    points = np.frombuffer(seq.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < 256, _CODE[points & 0xFF], 0)


def pool_tokens(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Masked mean over token positions 1..L of each row (float32 out)."""
    b, t, _ = tokens.shape
    pos = np.arange(t)[None, :]
    mask = (pos >= 1) & (pos <= lengths[:, None])
    summed = np.einsum("btd,bt->bd", tokens.astype(np.float64), mask.astype(np.float64))
    denom = np.maximum(lengths, 1)[:, None].astype(np.float64)
    return (summed / denom).astype(np.float32)


@dataclass(frozen=True)
class ResidueScaleEncoder:
    """Token = one-hot of the 20 residues (zeros if non-standard) + hydropathy."""

    name: str = "residue_scale"

    @property
    def dim(self) -> int:
        return len(ALPHABET) + 1

    def tokens(self, seqs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.array([len(s) for s in seqs], dtype=np.int64)
        t = int(lengths.max(initial=0)) + 2
        out = np.full((len(seqs), t, self.dim), SENTINEL, dtype=np.float32)
        kd = np.array([0.0] + [KYTE_DOOLITTLE[a] for a in ALPHABET], dtype=np.float32)
        for i, s in enumerate(seqs):
            c = _codes(s)
            body = np.zeros((len(s), self.dim), dtype=np.float32)
            std = c > 0
            body[np.nonzero(std)[0], c[std] - 1] = 1.0
            body[:, -1] = kd[c]
            out[i, 1:len(s) + 1] = body
        return out, lengths

    def encode(self, seqs: list[str]) -> np.ndarray:
        tok, lengths = self.tokens(seqs)
        return pool_tokens(tok, lengths)


@dataclass(frozen=True)
class KmerHashEncoder:
    """Token i = one-hot bucket of the k-mer starting at residue i (i <= L-k+1).

    bucket = sum_j code(residue_{i+j}) * 21^j mod dim, code 1..20 (0 if
    non-standard). Pooling counts each k-mer once: value = count / (L-k+1).
    """

    k: int = 3
    dim: int = 64
    name: str = "kmer_hash"

    def buckets(self, seq: str) -> np.ndarray:
        c = _codes(seq)
        n = len(c) - self.k + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64)
        h = np.zeros(n, dtype=np.int64)
        for j in range(self.k):
            h = h + c[j:j + n] * (21 ** j)
        return h % self.dim

    def encode(self, seqs: list[str]) -> np.ndarray:
        out = np.zeros((len(seqs), self.dim), dtype=np.float32)
        for i, s in enumerate(seqs):
            b = self.buckets(s)
            if len(b):
                out[i] = (np.bincount(b, minlength=self.dim) / float(len(b))).astype(np.float32)
        return out


_ENCODERS: dict[str, object] = {}


def worker_encoder(encoder):
    """An encoder as it is; or, from a factory (any callable without ``encode``), one built once per Python
    worker and kept under the factory's name, so that heavy weights are loaded there and not pickled per task."""
    if hasattr(encoder, "encode"):
        return encoder
    name = f"{encoder.__module__}.{encoder.__qualname__}"
    if name not in _ENCODERS:
        _ENCODERS[name] = encoder()
    return _ENCODERS[name]


def sub_batches(lengths: list[int], batch_size: int, batch_tokens: int | None) -> list[tuple[int, int]]:
    """Ranges of consecutive sequences for one encoder call."""
    if batch_tokens is None:
        return [(i, min(i + batch_size, len(lengths))) for i in range(0, len(lengths), batch_size)]
    out, first, longest = [], 0, 0
    for i, n in enumerate(lengths):
        if i > first and (i - first + 1) * (max(longest, n) + 2) > batch_tokens:
            out.append((first, i))
            first, longest = i, 0
        longest = max(longest, n)
    return out + [(first, len(lengths))] if lengths else out


def embed(df: DataFrame, encoder, id_col: str = "protein_id", seq_col: str = "sequence",
          batch_size: int = 8, max_len: int | None = MAX_RESIDUES,
          carry: list[str] | None = None, batch_tokens: int | None = None) -> DataFrame:
    """``(id, embedding array<float>)`` for every row, in Arrow batches.

    The encoder gets ``batch_size`` sequences at a time or, with ``batch_tokens``, as many as fit that many
    padded tokens (one at least), so short sequences fill a batch as well as long ones. Sequences longer than ``max_len`` are truncated (filter them first for the
    skip policy). Catalyst cannot push filters through the Python map, so
    callers order cheap filters before this step.
    """
    def run(batches):
        enc = worker_encoder(encoder)
        for pdf in batches:
            seqs = [s if max_len is None else s[:max_len] for s in pdf[seq_col].fillna("").tolist()]
            vecs = []
            for i, j in sub_batches([len(x) for x in seqs], batch_size, batch_tokens):
                vecs.extend(enc.encode(seqs[i:j]))
            import pandas as pd
            out = {"id": pdf[id_col].astype(str).values, "embedding": [v.tolist() for v in vecs]}
            for c in carry or []:
                out[c] = pdf[c].values
            yield pd.DataFrame(out)

    types = dict(df.dtypes)
    schema = "id string, embedding array<float>" + "".join(f", {c} {types[c]}" for c in carry or [])
    return df.select(id_col, seq_col, *(carry or [])).mapInPandas(run, schema)


def mean_pool(df: DataFrame, tokens_col: str, length_col: str, out: str = "embedding") -> DataFrame:
    """Spark-side masked mean pool of ``array<array<float>>`` tokens over 1..L."""
    body = F.slice(F.col(tokens_col), 2, F.col(length_col))
    dim = F.size(F.element_at(F.col(tokens_col), 1))
    zero = F.array_repeat(F.lit(0.0), dim)
    summed = F.aggregate(body, zero, lambda acc, t: F.zip_with(acc, t, lambda a, b: a + b))
    n = F.greatest(F.col(length_col), F.lit(1)).cast("double")
    return df.withColumn(out, F.transform(summed, lambda v: (v / n).cast("float")))


def group_mean(df: DataFrame, group: str, vec_col: str) -> DataFrame:
    """Element-wise mean vector per group, long form ``(group, dim, mean)``.

    posexplode + grouped ``avg`` aggregates partially; no group is collected.
    """
    return (df.select(group, F.posexplode(vec_col).alias("dim", "v"))
              .groupBy(group, "dim").agg(F.avg(F.col("v").cast("double")).alias("mean")))


def stored_ids(spark, store: str, id_col: str = "id", split: str | None = None) -> DataFrame:
    """Ids (and splits, if ``split`` names the column) already in the store; empty if there is no store yet.

    Only a missing path, or one without a data file yet, counts as an empty store; any other failure is raised.
    """
    keys = {"_done": F.col(id_col)} | ({"_done_split": F.col(split).cast("string")} if split else {})
    try:
        stored = spark.read.parquet(store)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], ", ".join(f"{k} string" for k in keys))
    return stored.select(*[c.alias(k) for k, c in keys.items()]).distinct()


def pending(df: DataFrame, done: DataFrame, id_col: str, split_col: str | None = None) -> DataFrame:
    """Rows whose id (in its split, if given) is not stored yet (anti-join)."""
    same = F.col(id_col).cast("string") == F.col("_done")
    if split_col:
        same = same & (F.col(split_col).cast("string") == F.col("_done_split"))
    return df.join(done, same, "left_anti")


PART_RESIDUES = 1 << 26  # residues that one task of an embedding job reads at most, longest sequences aside
BLOOM_BLOCKS = 1 << 18  # 64 bytes each: 16 MB, whatever the store holds


def _bloom_block(*keys: str) -> F.Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BLOOM_BLOCKS)).cast("int")


def _bloom_bit(j: int, *keys: str) -> F.Column:
    """The bit of word ``j``: one of 64."""
    return F.expr(f"shiftleft(1L, cast(pmod(xxhash64({', '.join(keys)}, {j + 1}), 64) AS int))")


def bloom(ids: DataFrame, *keys: str) -> DataFrame:
    """Split-block Bloom filter of the keys: at most ``BLOOM_BLOCKS`` rows of eight 64-bit words, one bit a key in each word."""
    return ids.groupBy(_bloom_block(*keys).alias("_block")).agg(
        *[F.bit_or(_bloom_bit(j, *keys)).alias(f"_w{j}") for j in range(8)])


def merge_bloom(parts: DataFrame) -> DataFrame:
    return parts.groupBy("_block").agg(*[F.bit_or(f"_w{j}").alias(f"_w{j}") for j in range(8)])


def pending_bloom(df: DataFrame, done: DataFrame, filt: DataFrame, id_col: str, split_col: str | None = None) -> DataFrame:
    """``pending`` that shuffles possible hits only: rows whose bits are not all set in ``filt`` are surely not stored and stay
    where they are; the others take the exact anti-join. ``filt`` covers all of ``done`` and has a bounded size, so it is broadcast."""
    keys = ["_k0"] + (["_k1"] if split_col else [])
    keyed = df.withColumn("_k0", F.col(id_col).cast("string"))
    if split_col:
        keyed = keyed.withColumn("_k1", F.col(split_col).cast("string"))
    bits = [_bloom_bit(j, *keys) for j in range(8)]
    hit = F.lit(True)
    for j, bit in enumerate(bits):
        hit = hit & (F.col(f"_w{j}").bitwiseAND(bit) != 0)
    tested = (keyed.withColumn("_block", _bloom_block(*keys)).join(F.broadcast(filt), "_block", "left")
              .withColumn("_maybe", F.coalesce(hit, F.lit(False))).select(*df.columns, "_maybe"))
    new = tested.where(~F.col("_maybe")).drop("_maybe")
    return new.unionByName(pending(tested.where("_maybe").drop("_maybe"), done, id_col, split_col))


def _read_bloom(spark, store: str) -> DataFrame | None:
    try:
        return merge_bloom(spark.read.parquet(f"{store}/_bloom"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def by_cost(df: DataFrame, len_col: str, id_col: str, parts: int, sizes: dict[int, int]) -> DataFrame:
    """Rows in ``parts`` partitions of equal cost (squared padded length) and similar length, sorted by length.

    ``sizes`` counts the rows of each length. Lengths are laid end to end by their cost; a row's place is spread over its
    length's stretch by a hash of its id, so one very common length fills as many partitions as its cost asks for."""
    if not sizes:  # no rows: an empty frame, else one task would read all of the input to find none
        return df.where(F.lit(False))
    lengths = sorted(sizes)
    cost = np.array([sizes[n] * float(n + 2) ** 2 for n in lengths])
    end = np.cumsum(cost) / cost.sum() * parts
    start = np.concatenate([[0.0], end[:-1]])
    at = F.array_position(F.array(*map(F.lit, lengths)), F.col(len_col)).cast("int")
    begin, stop = (F.element_at(F.array(*[F.lit(float(x)) for x in edge]), at) for edge in (start, end))
    spread = F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) / F.lit(float(1 << 20))
    part = F.least(F.floor(begin + spread * (stop - begin)), F.lit(parts - 1)).cast("int")
    return df.repartitionById(parts, part).sortWithinPartitions(len_col, id_col)


def embed_job(df: DataFrame, encoder, store: str, id_col: str = "protein_id",
              seq_col: str = "sequence", max_len: int = MAX_RESIDUES, batch_size: int = 8,
              partitions: int | None = None, split_col: str | None = None,
              batch_tokens: int | None = 8 * (MAX_RESIDUES + 2)) -> dict:
    """Resumable embedding of a table into a Parquet store; returns a run report.

    pending (Bloom filter, then anti-join of possible hits) -> length cap (skip) -> partitions of
    equal cost, sorted by length (homogeneous batches) -> encode -> append.
    Re-running adds nothing; a failed run leaves whole files only, and the
    next run embeds what is missing. With ``split_col`` all splits run in one
    job and the store is partitioned by split.

    The filter lies in ``store/_bloom`` (a folder that readers of the store skip). Ids are added to it before their rows are
    written, so it always covers the store; a store without one gets it from its ids.
    """
    spark = df.sparkSession
    t0 = time.time()
    extra = [F.col(split_col).alias("split")] if split_col else []
    base = df.select(F.col(id_col).alias("_id"), F.col(seq_col).alias("_seq"), *extra) \
             .withColumn("_len", F.length("_seq"))
    counts = base.agg(F.count(F.lit(1)).alias("total")).first()
    split = "split" if split_col else None
    done, filt = stored_ids(spark, store, split=split), _read_bloom(spark, store)
    keys = ["_done"] + (["_done_split"] if split else [])
    if filt is None and not done.isEmpty():  # a store of an earlier version
        bloom(done, *keys).write.mode("append").parquet(f"{store}/_bloom")
        filt = _read_bloom(spark, store)
    todo = pending(base, done, "_id", split) if filt is None else pending_bloom(base, done, filt, "_id", split)
    kept = todo.where(F.col("_len") <= max_len)
    # counted before the write (afterwards the store already holds these ids); at most max_len + 3 rows reach the driver
    found = todo.groupBy(F.least("_len", F.lit(max_len + 1)).alias("n")).agg(F.count(F.lit(1)).alias("rows")).collect()
    skipped = sum(r.rows for r in found if r.n is not None and r.n > max_len)
    stats = {"pending": sum(r.rows for r in found), "skipped": skipped}
    sizes = {r.n: r.rows for r in found if r.n is not None and r.n <= max_len}
    n_parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(n * k for n, k in sizes.items()) // PART_RESIDUES))
    ordered = by_cost(kept, "_len", "_id", n_parts, sizes)
    names = kept.select(F.col("_id").cast("string").alias("_done"), *([F.col("split").cast("string").alias("_done_split")] if split else []))
    bloom(names, *keys).write.mode("append").parquet(f"{store}/_bloom")
    obs = Observation("embed_job")
    emb = embed(ordered, encoder, "_id", "_seq", batch_size, max_len, carry=["split"] if split_col else [], batch_tokens=batch_tokens)
    emb = emb.observe(obs, F.count(F.lit(1)).alias("embedded"))
    writer = emb.write.mode("append")
    if split_col:
        writer = writer.partitionBy("split")
    writer.parquet(store)
    embedded = obs.get["embedded"]
    stored = spark.read.parquet(store).count()
    secs = max(time.time() - t0, 1e-9)
    return {"total": counts["total"], "already_done": counts["total"] - stats["pending"],
            "skipped": stats["skipped"],
            "pct_skipped": 100.0 * stats["skipped"] / counts["total"] if counts["total"] else 0.0,
            "embedded": embedded, "stored": stored, "seq_per_sec": embedded / secs}
