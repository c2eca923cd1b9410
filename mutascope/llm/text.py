"""Text helpers shared by the operators: Arrow batches in, NumPy word tables out.

A batch of texts is one UTF-8 byte buffer plus offsets. Words are found, lower-cased and
fingerprinted with whole-array NumPy steps, so cost does not depend on word or document
counts. Fingerprints are 64-bit (polynomial over the bytes, then mixed); two different words
of one corpus share one with a probability of about ``n**2 / 2**65``.

Null texts are empty texts everywhere. Batches are cut into slices of about ``SLICE`` bytes, so
memory is bounded by a slice or by the longest single document. Spark sends batches of at most about ``BATCH`` bytes:
each is held several times over (Arrow vectors and a send buffer in the executor, two batches in the worker).
A worker outlives its task; it keeps the tools (automata, vocabularies) of its present task only.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mutascope.session import ensure_checkpoint_dir

SLICE = 1 << 20
BATCH = 8 << 20  # bytes of a batch sent to a Python worker, where the session does not set it
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"  # Spark's own default is 64 MB
MARKS = 1 << 28  # bits of the largest broadcast bitmap (32 MB)
U = np.uint64

#: word characters as byte tables: everything but ASCII white space / ASCII letters, digits and all non-ASCII
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
NOT_NEWLINE = np.ones(256, bool)
NOT_NEWLINE[10] = False
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}
_libc = ctypes.CDLL(None)
_tools: dict[str, dict] = {}  # by kind and key
_asked: set[str] = set()  # kinds that the present task asked for


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, SLICE + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, U)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=U)
    return _powers["up"][:n], _powers["down"]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and len(off) else np.zeros(0, np.uint8)
    return raw, off - off[0]


def segments(raw: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes in ``table`` that do not cross a document: starts, ends, document index."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = table[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def fingerprints(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray = SAME) -> np.ndarray:
    """64-bit fingerprints of the byte ranges, after folding bytes with ``fold``."""
    up, down = _power(len(raw))
    total = np.zeros(len(raw) + 1, U)
    np.cumsum((fold[raw].astype(U) + U(1)) * up, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def windows(h: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all runs of ``width`` words inside one document, and where they start."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:n] == doc[width - 1:])
    out = np.zeros(len(at), U)
    for k in range(width):
        out = mix(out * U(0xD6E8FEB86659FD93) + h[at + k])
    return out, at


def keyed(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Fingerprints made distinct by document, so one sort finds repeats inside documents."""
    return mix(h ^ mix(doc.astype(U) + U(1)))


def tidy() -> None:
    """Give freed memory back to the system: Arrow's and malloc's pools would keep it for the worker's life, which
    later stages of the same executor have to live with."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc, "malloc_trim", None)
    if trim is not None:
        trim(0)


def tool(kind: str, key: str, build: Callable[[], object], most: int = 1) -> object:
    """What ``build`` gives, built once per Python worker; of each kind the ``most`` last built are kept."""
    _asked.add(kind)
    mine = _tools.setdefault(kind, {})
    if key not in mine:
        while len(mine) >= most:
            mine.pop(next(iter(mine)))
        mine[key] = build()
    return mine[key]


def prepared(compute: Callable[[], Compute]) -> Compute:
    """The function of a task. Tools of earlier tasks that this one did not ask for are let go."""
    _asked.clear()
    work = compute()
    if _tools.keys() - _asked:
        for kind in _tools.keys() - _asked:
            del _tools[kind]
        gc.collect()
        tidy()
    return work


def in_batches(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` with batches of ``BATCH`` bytes, or of what the session sets itself."""
    conf = df.sparkSession.conf
    if BATCH_CONF not in conf.getAll:
        conf.set(BATCH_CONF, str(BATCH))
    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, column: str = "text", size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Row slices of about ``size`` text bytes, of one row at least."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total, first = np.cumsum(lengths), 0
    while first < batch.num_rows:
        done = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, done + size, side="right")))
        yield batch.slice(first, last - first)
        first = last


Compute = Callable[[pa.RecordBatch], list]


def map_rows(df: DataFrame, keep: list[str], fields: str, compute: Callable[[], Compute],
             column: str = "text", size: int = SLICE) -> DataFrame:
    """One output row per input row: the ``keep`` columns and the ones that ``compute()`` gives.

    ``fields`` is a DDL string. ``compute`` is called once per task and returns the function that
    turns a slice into a list of Arrow arrays or Python lists. Columns of ``df`` that are not named
    are neither read nor passed on, so their names cannot clash.
    """
    new = T._parse_datatype_string(fields)
    kept = T.StructType([df.schema[c] for c in keep])
    schema = T.StructType(kept.fields + new.fields)
    need = list(dict.fromkeys([*keep, column]))
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema, prefers_large_types=False)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = prepared(compute)
        for batch in batches:
            for part in slices(batch, column, size):
                cols = [part.column(c) for c in keep] + work(part)
                yield pa.RecordBatch.from_arrays(
                    [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, arrow)],
                    schema=arrow)
            tidy()

    return in_batches(df.select(*need), run, schema)


def hidden(df: DataFrame, *needed: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with all but the ``needed`` columns under neutral names, and the columns that undo it. Stages that
    pass whole rows on use it, so that no extra column can clash with a name of their own."""
    alias = {c: c if c in needed else f"_c{i}" for i, c in enumerate(df.columns)}
    return (df.select(*[F.col(f"`{c}`").alias(a) for c, a in alias.items()]),
            [F.col(a).alias(c) for c, a in alias.items()])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder for a written table."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: later steps neither repeat the work nor depend on executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """A written table (its rows are counted) with a broadcast hint if it holds at most ``rows`` rows, else as it
    is (shuffle join)."""
    return F.broadcast(df) if df.count() <= rows else df


def _marked(df: DataFrame, keys: DataFrame, on: list[str], n: int) -> DataFrame:
    """``df`` with ``_may``: false only where the ``on`` columns are not among the ``n`` keys. Each key sets one bit of a
    broadcast bitmap of 16 bits a key, in pieces of 4 KB."""
    place = F.pmod(F.xxhash64(*on), F.lit(min(16 * n, MARKS)))
    piece, bit = F.shiftright(place, 15).alias("_piece"), place.bitwiseAND(F.lit(32767))
    marks = keys.select(piece, bit.alias("_bit")).groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_marks"))
    byte = F.conv(F.hex(F.substring("_marks", F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    hit = F.getbit(byte, bit.bitwiseAND(F.lit(7)).cast("int")) == 1
    for c in on:
        hit = hit & F.col(c).isNotNull()
    return (df.select("*", piece).join(F.broadcast(written(marks, "marks")), "_piece", "left")
            .select(*df.columns, F.coalesce(hit, F.lit(False)).alias("_may")))


def looked_up(df: DataFrame, table: DataFrame, on: list[str], rows: int) -> DataFrame:
    """Left join of ``df`` with a written table of unique ``on`` values. At most ``rows`` rows are broadcast; of a larger
    table a bitmap is, and only rows of ``df`` that may have a partner are shuffled: the others' long columns stay."""
    n = table.count()
    if n <= rows:
        return df.join(F.broadcast(table), on, "left").select(*df.columns, *[c for c in table.columns if c not in on])
    more = [f for f in table.schema if f.name not in on]
    seen = _marked(df, table, on, n)
    met = seen.where("_may").drop("_may").join(table, on, "left").select(*df.columns, *[f.name for f in more])
    return met.union(seen.where("not _may").select(*df.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in more]))


def found(df: DataFrame, keys: DataFrame, on: list[str], rows: int, present: bool = True) -> DataFrame:
    """Rows of ``df`` whose ``on`` columns are (or are not) in ``keys``, a written table of unique keys."""
    hit = looked_up(df, keys.select(*on, F.lit(True).alias("_hit")), on, rows)
    return hit.where(F.col("_hit").isNotNull() if present else F.col("_hit").isNull()).drop("_hit")


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
