"""Per-series operators: ordinal index, linear resampling, gap filling,
segment pairing, column-wise last-non-null and per-point arg-max.

Skew: a series may hold a large share of all rows. No operator here needs a
whole series in one task:

* the ordinal is a distributed prefix count: rows are numbered inside (series,
  part of its order) and shifted by the row counts of the earlier parts. Parts
  are equal shares of the rows in (series, order) order; or, given
  ``bucket=(order column, width)``, buckets of the leading order column, which
  saves the pass that finds equal shares;
* neighbours (next sample, next point) are equi-joins on (series, index ± 1);
* gap filling runs per (series, run of positions) with the nearest known values
  of the neighbouring runs carried in from a small per-bucket aggregate.

``bounded=True`` asks for a plain window per series instead, for series whose
size is bounded by construction (samples of one lap).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pitwall.session import materialize, parts_for

FILL_ROWS = 4096        # positions of a series in one window of gap_fill_linear
TASK_ROWS = 500_000     # rows that one task of seq_index sorts, if their number is given


def seq_index(df: DataFrame, by: Sequence[str], order: Sequence[Column], name: str = "idx",
              start: int = 1, bucket: tuple[str, float] | None = None, length: str | None = None,
              bounded: bool = False, rows: int | None = None) -> DataFrame:
    """Ordinal of each row inside its series (``cumcount() + start``), and its
    number of rows as column ``length`` if named.

    No series is sorted in one task: rows are numbered inside (series, part)
    and shifted by the row counts of the earlier parts of the series (a small
    aggregate plus a window over parts, of which a series has at most as many
    as there are partitions or buckets). Without ``bucket`` the parts are equal
    shares: the rows are range-partitioned by (series, order) and written once
    with their partition number, so that recomputed tasks number alike; rows
    that tie in the whole order share a part. With ``bucket=(column, width)``
    — ``column`` the leading, ascending order column (time in seconds or
    numeric width) — a part is a bucket, a pure function of the row.
    ``bounded`` series get a plain window. With ``rows``, about how many rows
    there are, tables too large for the session's shuffle partitions are dealt
    over more, so that no task's sort grows with the table.
    """
    if bounded:
        w = Window.partitionBy(*by).orderBy(*order)
        out = df.withColumn(name, F.row_number().over(w).cast("long") + F.lit(start - 1))
        return out.withColumn(length, F.count(F.lit(1)).over(Window.partitionBy(*by))) if length else out
    d = equal_parts(df, by, order) if bucket is None else with_bucket(df, bucket)
    # one key of series and part (nulls in it are equal), so that the join finds the rows dealt as the window left them
    d = d.withColumn("_part", F.struct(*by, "_sb"))
    parts = parts_for(df.sparkSession, rows, TASK_ROWS)
    dealt = d.repartition(parts, "_part") if parts else d
    local = dealt.withColumn("_lrn", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = d.groupBy(*by, "_sb").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*by).orderBy(F.col("_sb").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    extra = [F.sum("_cnt").over(Window.partitionBy(*by)).alias(length)] if length else []
    offs = offs.select(F.struct(*by, "_sb").alias("_part"), "_off", *extra)
    out = local.join(offs, "_part", "inner")
    out = out.withColumn(name, (F.col("_off") + F.col("_lrn") + F.lit(start - 1)).cast("long"))
    # columns in the order of the input
    return out.select(*dict.fromkeys([*df.columns, *([length] if length else []), name]))


def equal_parts(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows with the number (``_sb``) of their share in (series, order) order, written once."""
    sorted_shares = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by], *order)
    return materialize(sorted_shares.withColumn("_sb", F.spark_partition_id()), "shares")


def with_bucket(df: DataFrame, bucket: tuple[str, float]) -> DataFrame:
    from pitwall.operators.joins import bucket_of
    col, width = bucket
    return df.withColumn("_sb", bucket_of(F.col(col), df.schema[col].dataType, width))


def resample_linear(samples: DataFrame, by: Sequence[str], order: Sequence[Column], value: str,
                    n: int | str, null_as: float = 0.0, point: str = "point",
                    bucket: tuple[str, float] | None = None) -> DataFrame:
    """Resample each series to ``n`` points spread evenly over its sample index.

    Same arithmetic as ``np.interp(np.linspace(0, len-1, n), np.arange(len), y)``:
    grid position ``p = i * ((len-1)/(n-1))`` (last point exactly ``len-1``),
    ``y = (y[j+1]-y[j]) * (p-j) + y[j]`` with ``j = floor(p)``. Null values
    count as ``null_as``. ``n`` may be a column (constant inside a series).
    Every sample meets its right neighbour on (series, index) and emits the
    grid points between the two, so the input is indexed once and no series
    is gathered in one place.
    """
    if isinstance(n, int) and n < 1:
        raise ValueError("n must be >= 1")
    s = seq_index(samples, by, order, "_j", 0, bucket=bucket, length="_len")
    y = F.coalesce(F.col(value).cast("double"), F.lit(float(null_as)))
    nc = (F.col(n) if isinstance(n, str) else F.lit(n)).cast("long")
    sides = F.array(F.struct(F.col("_j").alias("j"), y.alias("y"), F.lit(None).cast("double").alias("y1")),
                    F.struct((F.col("_j") - 1).alias("j"), F.lit(None).cast("double").alias("y"), y.alias("y1")))
    pairs = (s.select(*by, nc.alias("_n"), "_len", F.explode(sides).alias("_s"))
             .groupBy(*by, F.col("_s.j").alias("_j"))
             .agg(F.max("_s.y").alias("_y"), F.max("_s.y1").alias("_y1"), F.max("_n").alias("_n"),
                  F.max("_len").alias("_len"))
             .where((F.col("_j") >= 0) & (F.col("_n") >= 1)))
    nn, ln, j = F.col("_n"), F.col("_len"), F.col("_j")
    step = (ln - 1).cast("double") / F.nullif((nn - 1).cast("double"), F.lit(0.0))

    def position(i):
        return (F.when(nn == 1, F.lit(0.0)).when(i == nn - 1, (ln - 1).cast("double"))
                .otherwise(i.cast("double") * step))
    # candidates around [j, j + 1), then exactly those whose position falls into it
    first = F.when((nn == 1) | (ln == 1), F.lit(0)).otherwise(F.floor(j / step) - 1)
    last = F.when((nn == 1) | (ln == 1), nn - 1).otherwise(F.ceil((j + 1) / step) + 1)
    span = F.sequence(F.greatest(first.cast("long"), F.lit(0).cast("long")), F.least(last.cast("long"), nn - 1))
    near = F.greatest(first.cast("long"), F.lit(0).cast("long")) <= F.least(last.cast("long"), nn - 1)
    grid = F.when(near, F.filter(span, lambda i: F.floor(position(i)) == j))
    out = pairs.withColumn(point, F.explode(grid)).withColumn(point, F.col(point).cast("int"))
    frac = position(F.col(point)) - j
    filled = F.when((frac == 0) | F.col("_y1").isNull(), F.col("_y")).otherwise(
        (F.col("_y1") - F.col("_y")) * frac + F.col("_y"))
    return out.select(*by, point, filled.alias(value))


def gap_fill_linear(df: DataFrame, by: Sequence[str], order: Sequence[Column],
                    cols: Sequence[str], drop_unfilled: bool = True,
                    bucket: tuple[str, float] | None = None) -> DataFrame:
    """Fill nulls by linear interpolation over the row position (pandas
    ``interpolate()`` defaults): leading nulls stay null, trailing nulls take
    the last value; rows still null are dropped when ``drop_unfilled``.
    Windows run over FILL_ROWS positions of a series, whatever its length."""
    idx = "_gi"
    out = seq_index(df, by, order, idx, 0, bucket=bucket)
    out = out.withColumn("_gb", F.floor(F.col(idx) / FILL_ROWS))
    part = [*by, "_gb"]
    back = Window.partitionBy(*part).orderBy(idx).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fwd = Window.partitionBy(*part).orderBy(idx).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    def known(c):
        return F.when(F.col(c).isNotNull(), F.struct(F.col(idx).alias("i"), F.col(c).cast("double").alias("v")))

    # nearest known values of earlier / later buckets of the same series, all columns in one aggregate and join
    per = out.groupBy(*part).agg(*[f(known(c)).alias(f"_{tag}{k}") for k, c in enumerate(cols)
                                   for tag, f in (("l", F.max), ("f", F.min))])
    wb = Window.partitionBy(*by).orderBy(F.col("_gb").asc_nulls_first())
    carry = per.select(*[F.col(x).alias(f"_c_{x}") for x in part], *[
        x for k in range(len(cols)) for x in (
            F.last(f"_l{k}", ignorenulls=True).over(wb.rowsBetween(Window.unboundedPreceding, -1)).alias(f"_cp{k}"),
            F.first(f"_f{k}", ignorenulls=True).over(wb.rowsBetween(1, Window.unboundedFollowing)).alias(f"_cn{k}"))])
    cond = reduce(lambda a, b: a & b, [out[x].eqNullSafe(carry[f"_c_{x}"]) for x in part])
    out = out.join(carry, cond, "left").drop(*[f"_c_{x}" for x in part])
    near = []
    for k, c in enumerate(cols):
        prev, nxt = F.last(known(c), ignorenulls=True).over(back), F.first(known(c), ignorenulls=True).over(fwd)
        prev, nxt = F.coalesce(prev, F.col(f"_cp{k}")), F.coalesce(nxt, F.col(f"_cn{k}"))
        near += [prev.alias(f"_p{k}"), nxt.alias(f"_n{k}")]
    out = out.select("*", *near)
    for k, c in enumerate(cols):
        p, q = f"_p{k}", f"_n{k}"
        slope = (F.col(f"{q}.v") - F.col(f"{p}.v")) / (F.col(f"{q}.i") - F.col(f"{p}.i")).cast("double")
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.col(c).cast("double"))
                             .when(F.col(p).isNull(), F.lit(None))
                             .when(F.col(q).isNull(), F.col(f"{p}.v"))
                             .otherwise(slope * (F.col(idx) - F.col(f"{p}.i")).cast("double") + F.col(f"{p}.v")))
    out = out.drop(*[f"_{t}{k}" for k in range(len(cols)) for t in ("p", "n", "cp", "cn")])
    if drop_unfilled:
        out = out.dropna(subset=list(cols))
    return out.drop(idx, "_gb")


def segments(df: DataFrame, by: Sequence[str], idx: str, x: str, y: str) -> DataFrame:
    """Pair every point with the next one of its series (``idx + 1``): (x, y) → (x2, y2)."""
    nxt = df.select(*[F.col(b).alias(f"_n_{b}") for b in by], (F.col(idx) - 1).alias("_n_idx"),
                    F.col(x).alias(f"{x}2"), F.col(y).alias(f"{y}2"))
    cond = reduce(lambda a, b: a & b, [df[b].eqNullSafe(nxt[f"_n_{b}"]) for b in by]) & (df[idx] == nxt["_n_idx"])
    return df.join(nxt, cond, "inner").drop(*[f"_n_{b}" for b in by], "_n_idx")


def last_non_null(df: DataFrame, by: Sequence[str], order: Column, cols: Sequence[str]) -> DataFrame:
    """Per group, the last non-null value of every column independently
    (pandas ``groupby().last()``), with ``order`` a total order inside the group.
    An aggregate with map-side partial aggregation: skew-safe."""
    return df.groupBy(*by).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in cols])


def argmax_per_point(df: DataFrame, point: Sequence[str], value: str, series_order: Sequence[Column]) -> DataFrame:
    """Row with the largest ``value`` at each point; the first series wins ties."""
    w = Window.partitionBy(*point).orderBy(F.col(value).desc_nulls_last(), *series_order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
