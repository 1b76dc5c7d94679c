"""Order-dependent operators that never gather one key in one task.

A window over a whole key sends that key to a single task. Here every key is
cut into slices that follow the order (an hour of a trace, a band of a score);
windows run inside (key, slice), and one summary row per slice carries counts
and last values across slice borders. A key holding a third of all rows is
spread over its slices, the summaries are small, and the results equal those
of the plain window. Where it is known which keys hold many rows, the others
take the plain window, in one exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F


def _cols(names: Sequence[str]) -> list[Column]:
    return [F.col(n) for n in names]


def sequence(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_expr: Column,
             index: str = "idx", previous: dict[str, str] | None = None,
             first: dict[str, str] | None = None) -> DataFrame:
    """Add ``index`` (from 0), ``previous[new] = lag(column)`` and ``first[new] = first value`` per key in order.

    ``slice_expr`` must not decrease along ``order``.
    """
    previous, first = previous or {}, first or {}
    base = df.withColumn("_slice", slice_expr)
    part = [*keys, "_slice"]
    w = Window.partitionBy(*part).orderBy(*order)
    local = base.withColumn("_rn", F.row_number().over(w))
    for new, src in previous.items():
        local = local.withColumn(new, F.lag(src).over(w))
    carried = F.max_by(F.struct(*[F.col(s).alias(f"c{i}") for i, s in enumerate(dict.fromkeys(previous.values()))],
                                F.lit(1).alias("one")), F.struct(*_cols(order)))
    heads = [F.min_by(s, F.struct(*_cols(order))).alias(f"_f{i}") for i, s in enumerate(first.values())]
    summary = base.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"), carried.alias("_last"), *heads)
    across = Window.partitionBy(*keys).orderBy("_slice")
    summary = summary.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s2"),
        *[F.first(f"_f{i}").over(across).alias(new) for i, new in enumerate(first)],
        F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.lag("_last").over(across).alias("_carry"))
    cond = F.col("_slice") == F.col("_s2")
    for i, k in enumerate(keys):
        cond = cond & (F.col(k) == F.col(f"_k{i}"))
    out = local.join(summary, cond, "inner").withColumn(index, (F.col("_base") + F.col("_rn") - 1).cast("long"))
    slots = {s: f"c{i}" for i, s in enumerate(dict.fromkeys(previous.values()))}
    for new, src in previous.items():
        out = out.withColumn(new, F.when(F.col("_rn") > 1, F.col(new)).otherwise(F.col("_carry").getField(slots[src])))
    return out.drop("_slice", "_s2", "_rn", "_base", "_carry", *[f"_k{i}" for i in range(len(keys))])


def sequence_by_size(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_expr: Column, large: DataFrame | None, index: str = "idx",
                     previous: dict[str, str] | None = None, first: dict[str, str] | None = None) -> DataFrame:
    """``sequence`` with slices only for the keys in ``large``, whose rows are too many for one window; None says that there are none."""
    w = Window.partitionBy(*keys).orderBy(*order)

    def whole(part: DataFrame) -> DataFrame:
        return part.select("*", *[F.lag(src).over(w).alias(new) for new, src in (previous or {}).items()],
                           *[F.first(src).over(w).alias(new) for new, src in (first or {}).items()], (F.row_number().over(w) - 1).cast("long").alias(index))

    if large is None:
        return whole(df)
    sliced = sequence(df.join(large, list(keys), "left_semi"), keys, order, slice_expr, index, previous, first)
    return whole(df.join(large, list(keys), "left_anti")).unionByName(sliced)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], slice_expr: Column,
            sums: dict[str, str], inclusive: bool = True) -> DataFrame:
    """Add ``sums[new] = sum(column)`` over all rows of the key up to this one."""
    base = df.withColumn("_slice", slice_expr)
    part = [*keys, "_slice"]
    w = Window.partitionBy(*part).orderBy(*order)
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    local = base
    for new, src in sums.items():
        local = local.withColumn(new, F.coalesce(F.sum(src).over(frame), F.lit(0)))
    summary = base.groupBy(*part).agg(*[F.sum(s).alias(f"_t{i}") for i, s in enumerate(sums.values())])
    across = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))).orderBy("_slice")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_slice").alias("_s2"),
        *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))])
    cond = F.col("_slice") == F.col("_s2")
    for i, k in enumerate(keys):
        cond = cond & (F.col(k) == F.col(f"_k{i}"))
    out = local.join(summary, cond, "inner")
    for i, new in enumerate(sums):
        out = out.withColumn(new, F.col(new) + F.col(f"_b{i}"))
    return out.drop("_slice", "_s2", *[f"_k{i}" for i in range(len(keys))], *[f"_b{i}" for i in range(len(sums))])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                  keep: Sequence[str] | None = None) -> DataFrame:
    """First row per key by ``order``: an aggregate with map-side combine, not a window."""
    keep = [c for c in (keep or df.columns) if c not in keys]
    ranked = F.min_by(F.struct(*keep), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(ranked.alias("_row")).select(*keys, *[F.col("_row")[c].alias(c) for c in keep])


def hash_order(seed: int, *cols: str) -> Column:
    """Deterministic shuffle key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


BAND_ROWS = 100_000  # distinct values that a band may hold
MOST_BANDS = 256


def with_band(df: DataFrame, value: str, bands: int | None = None) -> DataFrame:
    """Add ``_band``, the number of the band of ``value``, which doesn't decrease with it; nulls come first.

    Unless ``bands`` says how many, there is one band for every ``BAND_ROWS`` distinct values, ``MOST_BANDS`` at most. Edges are approximate
    quantiles of the distinct values, found by binary search, so bands fill evenly wherever the values crowd.
    """
    if bands is None:
        bands = min(MOST_BANDS, -(-df.agg(F.approx_count_distinct(value)).first()[0] // BAND_ROWS))
    if bands <= 1:
        return df.withColumn("_band", F.lit(0.0))
    steps = [i / bands for i in range(1, bands)]
    edges = df.select(F.col(value).cast("double").alias("v")).distinct().agg(F.percentile_approx("v", steps, 10 * bands)).first()[0]
    cuts = [float("-inf"), *sorted(set(edges)), float("inf")]
    out = Bucketizer(splits=cuts, inputCol="_v", outputCol="_band", handleInvalid="keep").transform(df.withColumn("_v", F.col(value).cast("double")))
    return out.withColumn("_band", F.when(F.col("_v").isNull(), -1.0).otherwise(F.col("_band"))).drop("_v")


def exact_percentiles(df: DataFrame, value: str, probs: dict[str, float], bands: int | None = None) -> DataFrame:
    """Percentiles with linear interpolation as one row, by ranking distinct values in bands."""
    counts = df.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = running(with_band(counts, "v", bands), [], ["v"], F.col("_band"), {"upto": "n"})
    total = counts.agg(F.sum("n").alias("total"))
    ranked = ranked.withColumn("total", total.scalar())
    aggs = []
    for name, p in probs.items():
        pos = (F.col("total") - 1) * F.lit(p)
        for tag, at in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            inside = (F.col("upto") > at) & (F.col("upto") - F.col("n") <= at)
            aggs.append(F.max(F.when(inside, F.col("v"))).alias(f"{name}_{tag}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"{name}_frac"))
    row = ranked.agg(*aggs)
    return row.select(*[(F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_frac")).alias(n)
                        for n in probs])
