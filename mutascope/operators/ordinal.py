"""Global ordinals, prefix sums, exact order statistics and average ranks.

A global ``row_number()`` over a window without (or with very few) partition
keys runs in one task. Instead rows get an ordered ``bucket`` that is a pure
function of the row -- literal cut points, or the leading digits of a hash --
so every read of the frame, and every recomputation after a lost executor,
puts a row in the same bucket:

1. running sums inside each (group, bucket): one hash exchange;
2. totals per (group, bucket): at most buckets x groups rows, whose exclusive
   running sums are each bucket's offset;
3. a null-safe join adds the offsets (rows of a NULL group stay). Adaptive
   execution broadcasts the offsets when their measured size is small.

Ties never meet in one task: ranks and quantiles work on distinct values with
their counts, which are aggregated before the shuffle.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64       # ordered buckets per group; raise it with the data
ACCURACY = 10_000  # of the approximate quantiles that serve as cut points
DIRECT = 50_000    # rows whose values may reach the driver in a selection
GRID = 500         # cells a bracket is cut into
OFFSETS = 100_000  # rows of bucket offsets that may be broadcast
SALTS = 1000       # parts that rows with a known rank are dealt into


def cut_points(df: DataFrame, cols: Sequence[str], buckets: int = BUCKETS) -> tuple[int, dict[str, list[float]]]:
    """Row count and, per column, at most ``buckets - 1`` approximate quantiles, from one aggregate.

    Their error changes how even the buckets are, never a result.
    """
    shares = [k / buckets for k in range(1, buckets)]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(F.col(c).cast("double"), shares, ACCURACY).alias(f"c{i}")
                                                 for i, c in enumerate(cols)]).first()
    return row.n, {c: sorted({float(x) for x in row[f"c{i}"] or [] if x is not None and not math.isnan(x)})
                   for i, c in enumerate(cols)}


def cut_bucket(col: str, cuts: Sequence[float]) -> Column:
    """How many of the cut points are not above the value (-1 for NULL), by bisection over literals."""
    if not cuts:
        return F.lit(0)
    v = F.col(col).cast("double")

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v < F.lit(cuts[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return F.when(v.isNull(), F.lit(-1)).otherwise(search(0, len(cuts)))


def value_bucket(df: DataFrame, col: str, buckets: int = BUCKETS) -> Column:
    """Bucket number of ``col``, from cut points read once."""
    return cut_bucket(col, cut_points(df, [col], buckets)[1][col])


def hex_bucket(col: str, buckets: int = BUCKETS) -> Column:
    """Bucket number of an evenly spread hexadecimal text (md5), in text order."""
    head = F.conv(F.substring(col, 1, 8), 16, 10).cast("double")
    return F.floor(head * F.lit(buckets / 4294967296.0)).cast("int")


def _null_safe(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``on`` where NULL equals NULL; the right side's key columns are dropped."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") for c in on], *[c for c in right.columns if c not in on])
    cond = None
    for c in on:
        one = F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        cond = one if cond is None else cond & one
    return left.join(renamed, cond, how).drop(*[f"_r_{c}" for c in on])


def with_prefix_sum(df: DataFrame, order: Sequence[str], weight: str, group: Sequence[str] = (),
                    name: str = "before", bucket: Column | None = None) -> DataFrame:
    """Exclusive running sum of ``weight`` within group, in ``order`` (unique rows).

    ``bucket`` must not decrease along ``order``; by default it is cut from the
    first (numeric) order column.
    """
    group, order = list(group), list(order)
    rows = df.withColumn("_bucket", value_bucket(df, order[0]) if bucket is None else bucket)
    keys = [*group, "_bucket"]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    totals = rows.groupBy(*keys).agg(F.sum(weight).alias("_total"))
    # without a group this window holds one row per bucket
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    out = _null_safe(local, offsets, keys)
    return out.select(*df.columns, (F.col("_offset") + F.col("_local")).alias(name))


def with_ordinal(df: DataFrame, order: Sequence[str], group: Sequence[str] = (),
                 name: str = "ordinal", bucket: Column | None = None) -> DataFrame:
    """1-based position of each row within its group under ``order`` (unique rows)."""
    counted = with_prefix_sum(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", group, "_before", bucket)
    return counted.select(*df.columns, (F.col("_before") + 1).alias(name))


def rank_targets(n: int, qs: Sequence[float], method: str) -> dict[float, list[int]]:
    """0-based ranks each quantile needs."""
    out = {}
    for q in qs:
        h = (n - 1) * q
        if method == "nearest":
            out[q] = [int(math.floor(h + 0.5))]          # half away from zero (h >= 0)
        elif method == "linear":
            out[q] = sorted({int(math.floor(h)), int(math.ceil(h))})
        else:
            raise ValueError(f"unknown quantile method {method}")
    return out


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], method: str = "linear",
                    more: Sequence[Column] = ()) -> dict:
    """Exact quantiles of a column (NULLs ignored): ``linear`` or ``nearest``.

    Selection in narrow passes, without a shuffle of values or a window. The first pass counts the rows and brackets
    every quantile by a sketch (error at most ``1 / ACCURACY``); while the brackets hold more than ``DIRECT`` rows, a
    pass counts them exactly and brackets again inside; the last one counts the distinct values inside and the rows between
    the brackets. At most ``DIRECT`` rows' values reach the driver, ties as one. ``more`` aggregates over the same
    rows come with the first pass, under the key of their place.
    """
    rows = df.where(F.col(col).isNotNull())
    v, off, ends = F.col(col), 2.0 / ACCURACY, [f"_m{i}" for i in range(len(more))]
    shares = sorted({min(max(q + d, 0.0), 1.0) for q in qs for d in (-off, off)})
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(v, shares, ACCURACY).alias("c"),
                     *[m.alias(e) for m, e in zip(more, ends)]).first()
    out = {i: first[e] for i, e in enumerate(ends)}
    if not first.n:
        return out | {q: None for q in qs}
    targets = rank_targets(first.n, qs, method)
    wanted = sorted({r for rs in targets.values() for r in rs})
    at = dict(zip(shares, first.c))
    brackets = _merged([(at[min(max(q - off, 0.0), 1.0)], at[min(max(q + off, 0.0), 1.0)]) for q in qs])
    expected = 2 * off * first.n * len(brackets)
    while expected > DIRECT:
        grid = [k / GRID for k in range(GRID + 1)]
        inside = [v.between(F.lit(lo), F.lit(hi)) for lo, hi in brackets]
        row = rows.agg(*[x for i, (lo, _) in enumerate(brackets) for x in (
            F.count_if(v < F.lit(lo)).alias(f"b{i}"), F.count_if(inside[i]).alias(f"n{i}"),
            F.percentile_approx(F.when(inside[i], v), grid, ACCURACY).alias(f"g{i}"))]).first()
        tighter, expected = [], 0
        for i, (lo, hi) in enumerate(brackets):
            below, held, cells = row[f"b{i}"], row[f"n{i}"], row[f"g{i}"]
            for r in wanted:
                if below <= r < below + held:
                    share = (r - below) / held
                    place = (max(math.floor((share - off) * GRID), 0), min(math.ceil((share + off) * GRID), GRID))
                    tighter.append((cells[place[0]], cells[place[1]]))
                    expected += 0 if cells[place[0]] == cells[place[1]] else held * (place[1] - place[0]) / GRID
        if len(tighter) < len(wanted) or _merged(tighter) == brackets:
            break
        brackets = _merged(tighter)
    found = _selected(rows, v, brackets, wanted)
    if len(found) < len(wanted):  # beyond the sketch's promise: count all distinct values
        found = _selected(rows, v, [(rows.agg(F.min(v)).first()[0], rows.agg(F.max(v)).first()[0])], wanted)
    for q in qs:
        lo, hi = found[targets[q][0]], found[targets[q][-1]]
        h = (first.n - 1) * q
        out[q] = lo if method == "nearest" else lo + (h - math.floor(h)) * (hi - lo)
    return out


def _merged(brackets: list[tuple]) -> list[tuple]:
    """Disjoint ascending brackets with the same cover."""
    out: list[tuple] = []
    for lo, hi in sorted(brackets):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _selected(rows: DataFrame, v: Column, brackets: list[tuple], wanted: list[int]) -> dict:
    """The values at the 0-based ranks that lie in a bracket: one aggregate over (gap or bracket, value)."""
    gap, value = F.lit(0), F.lit(None)
    for lo, hi in brackets:
        gap = gap + F.when(v > F.lit(hi), 1).otherwise(0)
        value = F.when(v.between(F.lit(lo), F.lit(hi)), v).otherwise(value)
    counts = rows.groupBy(gap.alias("gap"), value.alias("value")).agg(F.count(F.lit(1)).alias("n")).collect()
    out, before, ranks = {}, 0, list(wanted)
    for r in sorted(counts, key=lambda r: (r["gap"], r["value"] is not None, r["value"] if r["value"] is not None else 0)):
        while ranks and ranks[0] < before + r["n"]:
            if r["value"] is not None:
                out[ranks[0]] = r["value"]
            ranks.pop(0)
        before += r["n"]
    return out


def rank_table(df: DataFrame, value: str, by: Sequence[str] = (), name: str = "rank",
               bucket: Column | None = None) -> DataFrame:
    """Distinct ``(by..., value)`` with the average rank of ``value`` in its group and its count ``{name}_n``.

    Ties share the mean of their positions: rank = values before + (count + 1) / 2,
    from a distributed prefix sum over the distinct values and their counts.
    """
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_cnt"))
    ranked = with_prefix_sum(counts, [value], "_cnt", by, name="_below", bucket=bucket)
    return ranked.select(*by, value, (F.col("_below") + (F.col("_cnt") + 1) / 2.0).alias(name),
                         F.col("_cnt").alias(f"{name}_n"))


def with_rank(df: DataFrame, ranked: DataFrame, value: str, by: Sequence[str], name: str, hot: int = 1000,
              n: int | None = None) -> DataFrame:
    """Rows of ``df`` (``n`` of them) with their rank from ``rank_table``.

    A (group, value) that holds at least 1/``hot`` of all rows would be a hot
    join key. There are at most ``hot`` of them, so their ranks are broadcast;
    the others are joined by shuffle, where rows that have their rank already
    are dealt out by a salt and meet nothing.
    """
    keys = [*by, value]
    n = df.count() if n is None else n
    often = ranked.where(F.col(f"{name}_n") * hot >= n).select(*keys, name)
    rest = ranked.where(F.col(f"{name}_n") * hot < n).select(*keys, F.col(name).alias("_rest"), F.lit(0).alias("_salt"))
    marked = _null_safe(df, F.broadcast(often), keys, "left")
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(hot)).cast("int") + 1
    marked = marked.withColumn("_salt", F.when(F.col(name).isNull(), 0).otherwise(spread))
    joined = _null_safe(marked, rest, [*keys, "_salt"], "left")
    return joined.withColumn(name, F.coalesce(name, "_rest")).drop("_rest", "_salt")


def _with_rank_bucket(df: DataFrame, value: str, cuts: Sequence[float]) -> DataFrame:
    """``_v`` (the value; -0.0 and 0.0 are one) and its ordered ``_bucket``, in which each cut point has one of its own: a
    common value is a cut point, so a bucket holds one value or at most about the rows between two neighbouring cut points."""
    from pyspark.ml.feature import Bucketizer
    df = df.withColumn("_v", F.col(value) + F.lit(0.0))
    cuts = sorted({c + 0.0 for c in cuts if math.isfinite(c)})
    if not cuts:
        return df.withColumn("_bucket", F.lit(0))
    found = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_v", outputCol="_place", handleInvalid="keep").transform(df)
    bucket = F.col("_place").cast("int") * 2 + F.when(F.col("_v").isin(cuts), 0).otherwise(1)
    return found.withColumn("_bucket", bucket).drop("_place")


def rank_offsets(df: DataFrame, value: str, by: Sequence[str], cuts: Sequence[float]) -> DataFrame:
    """Per (group, bucket): its rows, the rows of the group before it, and whether it holds several values."""
    from mutascope.session import materialize
    by = list(by)
    totals = _with_rank_bucket(df, value, cuts).groupBy(*by, "_bucket").agg(
        F.count(F.lit(1)).alias("_total"), (F.min("_v") < F.max("_v")).alias("_several"))
    earlier = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(totals.withColumn("_offset", F.coalesce(F.sum("_total").over(earlier), F.lit(0))))
    return F.broadcast(offsets) if offsets.count() <= OFFSETS else offsets


def with_average_rank(df: DataFrame, offsets: DataFrame, value: str, by: Sequence[str], name: str, cuts: Sequence[float]) -> DataFrame:
    """Rows with the average rank of ``value`` (a double, not NULL) in their group, by one exchange and no join of rows.

    ``offsets`` and ``cuts`` are those of ``rank_offsets``. All rows of a bucket of one value tie, so their rank follows from
    the offset and they are dealt out by a salt; the others are ranked within their bucket.
    """
    by = list(by)
    marked = _null_safe(_with_rank_bucket(df, value, cuts), offsets, [*by, "_bucket"])
    marked = marked.withColumn(
        "_salt", F.when(F.col("_several"), F.lit(0)).otherwise(F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)) + 1))
    keys = [*by, "_bucket", "_salt"]
    ranked = marked.withColumn("_at", F.rank().over(Window.partitionBy(*keys).orderBy("_v"))).withColumn(
        "_ties", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_v")))
    inside = F.when(F.col("_several"), F.col("_at") - 1 + (F.col("_ties") + 1) / 2.0).otherwise((F.col("_total") + 1) / 2.0)
    return ranked.select(*df.columns, (F.col("_offset") + inside).alias(name))
