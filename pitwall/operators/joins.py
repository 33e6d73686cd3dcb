"""Join operators: star enrichment, range joins, adjacent-interval and as-of joins.

Range and as-of joins never fall back to a nested-loop or cartesian plan.
Range joins are rewritten into equi-joins on (keys, bucket): an interval is
exploded over the buckets it covers and a point lands in exactly one bucket,
so a key that holds a large share of the rows is still spread over as many
shuffle partitions as it has buckets. As-of joins cut a key's time into equal
shares of rows.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (DataType, DoubleType, IntegralType, TimestampNTZType, TimestampType)

from pitwall.operators.dedupe import keep_first
from pitwall.session import materialize, parts_for

_EPOCH_NTZ = _dt.datetime(1970, 1, 1)


# --------------------------------------------------------------------------- helpers
def _is_time(t: DataType) -> bool:
    return isinstance(t, (TimestampType, TimestampNTZType))


def epoch_micros(c: Column, dtype: DataType) -> Column:
    """Microseconds since 1970-01-01; time-zone free for TIMESTAMP_NTZ."""
    if isinstance(dtype, TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit(_EPOCH_NTZ).cast("timestamp_ntz"), c)
    if isinstance(dtype, TimestampType):
        return F.unix_micros(c)
    return c


def bucket_of(c: Column, dtype: DataType, width: float) -> Column:
    """Monotone bucket id of a point. Monotone is all correctness needs: if
    lo <= p <= hi then bucket(lo) <= bucket(p) <= bucket(hi)."""
    if _is_time(dtype):
        return F.floor(epoch_micros(c, dtype) / F.lit(int(width * 1_000_000)))
    if isinstance(dtype, IntegralType) and width == 1:
        return c.cast("long")
    return F.floor(c / F.lit(width))


def _default_width(dtype: DataType, width: float | None) -> float:
    if width is not None:
        return width
    if _is_time(dtype):
        return 60.0
    if isinstance(dtype, IntegralType):
        return 1
    raise ValueError("a bucket width is required for fractional range keys")


def _check_collisions(left: DataFrame, right_cols: Sequence[str], on: Sequence[str]) -> None:
    clash = (set(left.columns) & set(right_cols)) - set(on)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}; rename before joining")


# --------------------------------------------------------------------------- equi joins
def enrich(fact: DataFrame, dim: DataFrame, on: Sequence[str],
           cols: Mapping[str, str] | Sequence[str], how: str = "left") -> DataFrame:
    """Star-schema lookup: fact ⟕ dim on a composite key, picking a few attributes.

    No broadcast hint: AQE measures the dimension at runtime and broadcasts
    it only under spark.sql.autoBroadcastJoinThreshold, else sort-merges.
    """
    mapping = dict(cols) if isinstance(cols, Mapping) else {c: c for c in cols}
    d = dim.select(*[F.col(k) for k in on], *[F.col(src).alias(out) for out, src in mapping.items()])
    return fact.join(d, list(on), how)


def enrich_roles(fact: DataFrame, dim: DataFrame, dim_key: str,
                 roles: Mapping[str, Mapping[str, str]], on: Sequence[str] = (),
                 how: str = "left") -> DataFrame:
    """Role-playing dimension: the same dim joined once per fact role column.

    ``roles`` maps a fact column (holding a ``dim_key`` value) to
    ``{output_name: dim_column}``.
    """
    out = fact
    for fact_col, mapping in roles.items():
        d = dim.select(*[F.col(k) for k in on], F.col(dim_key).alias(fact_col),
                       *[F.col(src).alias(dst) for dst, src in mapping.items()])
        out = out.join(d, [*on, fact_col], how)
    return out


def anti(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is absent from ``other`` (LEFT JOIN … IS NULL)."""
    return df.join(other.select(*on), list(on), "left_anti")


def semi(df: DataFrame, other: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is present in ``other``."""
    return df.join(other.select(*on), list(on), "left_semi")


# --------------------------------------------------------------------------- range joins
LEVEL_BITS = 4          # a level's buckets are 16 times as wide as those of the level below
MOST_BUCKETS = 64       # an interval is exploded over this many buckets of its level, plus one at most
TASK_ROWS = 1_000_000   # exploded rows that one task of a range join sorts, if the number of points is given


def _level(lo: Column, hi: Column) -> Column:
    """Bucket level of an interval of buckets lo..hi: 0 up to MOST_BUCKETS, so wide ones stay bounded."""
    span = (hi - lo + 1).cast("double") / MOST_BUCKETS
    return F.when((lo > hi) | (span <= 1), F.lit(0)).otherwise(
        F.ceil(F.log2(span) / LEVEL_BITS).cast("int"))


def _explode_buckets(intervals: DataFrame, lo: str, hi: str, dtype: DataType,
                     width: float, outer: bool) -> DataFrame:
    """Each interval once per bucket that it covers on the level of its length."""
    blo = bucket_of(F.col(lo), dtype, width).cast("long")
    bhi = bucket_of(F.col(hi), dtype, width).cast("long")
    df = intervals.withColumn("_lvl", F.coalesce(_level(blo, bhi), F.lit(0)))
    # level * LEVEL_BITS as a shift per row: the levels of a long are few
    shift = lambda c: reduce(lambda a, k: F.when(F.col("_lvl") == k, F.shiftright(c, k * LEVEL_BITS)).otherwise(a),
                             range(1, 64 // LEVEL_BITS), c)
    seq = F.when(blo <= bhi, F.sequence(shift(blo), shift(bhi)))
    return df.withColumn("_bkt", (F.explode_outer if outer else F.explode)(seq))


def _levels(intervals: DataFrame, lo: str, hi: str, width: float) -> tuple[list[int], int]:
    """Levels that any interval has (level 0 always, a handful at most) and about how many rows the exploded
    intervals are: one pass over the intervals."""
    itype = intervals.schema[lo].dataType
    b = intervals.select(bucket_of(F.col(lo), itype, width).cast("long").alias("lo"),
                         bucket_of(F.col(hi), itype, width).cast("long").alias("hi")).withColumn("l", _level(F.col("lo"), F.col("hi")))
    each = F.when(F.col("lo") <= F.col("hi"),
                  1 + (F.col("hi").cast("double") - F.col("lo")) / F.pow(F.lit(2.0 ** LEVEL_BITS), F.col("l")))
    r = b.agg(F.collect_set("l").alias("l"), F.sum(each).alias("rows")).first()
    return sorted({0, *r["l"]}), int(r["rows"] or 0)


def _point_buckets(points: DataFrame, point: str, dtype: DataType, width: float, levels: Sequence[int]) -> DataFrame:
    """Each point once per level."""
    b = bucket_of(F.col(point), dtype, width).cast("long")
    if len(levels) == 1:
        return points.withColumn("_lvl", F.lit(0)).withColumn("_bkt", b)
    out = points.withColumn("_lvl", F.explode(F.array(*[F.lit(k) for k in levels])))
    return out.withColumn("_bkt", reduce(lambda a, k: F.when(F.col("_lvl") == k, F.shiftright(b, k * LEVEL_BITS))
                                         .otherwise(a), range(1, 64 // LEVEL_BITS), b))


def range_join(points: DataFrame, intervals: DataFrame, on: Sequence[str], point: str,
               lo: str, hi: str, how: str = "left", width: float | None = None,
               first_by: Sequence[Column] | None = None,
               point_key: Sequence[str] | None = None, hi_inclusive: bool = True,
               rows: int | None = None) -> DataFrame:
    """Points joined to every interval with ``lo <= point <= hi`` (closed) and equal keys.

    ``how`` is ``left`` (unmatched points kept with null interval columns) or
    ``inner``. With ``first_by`` only the first matching interval per point
    (identified by ``point_key``, default ``on + [point]``) is kept. Long and
    open-ended intervals go to levels of wider buckets, so no interval
    becomes more than MOST_BUCKETS + 1 rows. With ``rows``, about how many
    points there are, tables too large for the session's shuffle partitions
    are dealt over more, so that no task's sort grows with the tables.
    """
    if how not in ("left", "inner"):
        raise ValueError("how must be 'left' or 'inner'")
    ptype = points.schema[point].dataType
    width = _default_width(ptype, width)
    icols = [c for c in intervals.columns if c not in on]
    _check_collisions(points, icols, on)
    levels, exploded = _levels(intervals, lo, hi, width)
    p = _point_buckets(points, point, ptype, width, levels)
    # an exploded side is estimated at its pre-explode size: never broadcast it on that guess
    i = _explode_buckets(intervals, lo, hi, intervals.schema[lo].dataType, width, False)
    parts = rows and parts_for(points.sparkSession, rows * len(levels) + exploded, TASK_ROWS)
    if parts:
        dealt = [*on, *(["_lvl"] if len(levels) > 1 else []), "_bkt"]
        p, i = p.repartition(parts, *dealt), i.repartition(parts, *dealt)
    p, i = p.alias("_p"), i.hint("merge").alias("_i")
    cond = [F.col(f"_p.{k}") == F.col(f"_i.{k}") for k in on]
    upper = (F.col(f"_p.{point}") <= F.col(f"_i.{hi}")) if hi_inclusive else \
        (F.col(f"_p.{point}") < F.col(f"_i.{hi}"))
    cond += [F.col("_p._lvl") == F.col("_i._lvl"), F.col("_p._bkt") == F.col("_i._bkt"),
             F.col(f"_p.{point}") >= F.col(f"_i.{lo}"), upper]
    # a point is there once per level: of one level, or where one match is kept, the outer join keeps it by itself
    kept = how if len(levels) == 1 or first_by is not None else "inner"
    out = p.join(i, cond, kept).select(*[F.col(f"_p.{c}").alias(c) for c in points.columns], F.col("_p._bkt").alias("_bkt"),
                                       F.col("_p._lvl").alias("_lvl"),
                                       *[F.col(f"_i.{c}").alias(c) for c in icols], F.col("_i._bkt").isNull().alias("_none"))
    if first_by is not None:
        key = list(point_key or [*on, point])
        first = [F.col("_none"), *first_by]         # any match goes before none
        if len(levels) == 1 and {*on, point} <= set(key):
            # rows of a point are in one bucket, and the join has dealt them by it: no further shuffle
            key = [*on, "_bkt", *[k for k in key if k not in on]]
            return keep_first(out, key, first).drop("_none", "_bkt", "_lvl")
        if len(levels) > 1:     # a point without a match stays on one level
            out = out.where(~F.col("_none") | (F.col("_lvl") == levels[0]))
        if parts:               # each level's first match, where the join has dealt it; then the levels meet
            out = keep_first(out, [*dealt, *[k for k in key if k not in dealt]], first).repartition(parts, *key)
        return keep_first(out, key, first).drop("_none", "_bkt", "_lvl")
    out = out.drop("_none", "_bkt", "_lvl")
    if how == "inner" or len(levels) == 1:
        return out
    keys = [*on, point]         # whether a point has a match depends on these alone
    seen = out.select(*[F.col(k).alias(f"_m_{k}") for k in keys]).distinct()
    missing = points.join(seen, reduce(lambda a, b: a & b, [points[k] == seen[f"_m_{k}"] for k in keys]), "left_anti")
    return out.unionByName(missing.select("*", *[F.lit(None).cast(intervals.schema[c].dataType).alias(c) for c in icols]))


def range_agg(intervals: DataFrame, points: DataFrame, on: Sequence[str], point: str,
              lo: str, hi: str, aggs: Sequence[Column], width: float | None = None,
              group_cols: Sequence[str] | None = None) -> DataFrame:
    """Aggregate the points inside each interval; empty intervals survive
    (count 0, null min/avg), as with ``intervals LEFT JOIN points … GROUP BY``."""
    ptype = points.schema[point].dataType
    width = _default_width(ptype, width)
    pcols = [c for c in points.columns if c not in on]
    _check_collisions(intervals, pcols, on)
    i = _explode_buckets(intervals, lo, hi, intervals.schema[lo].dataType, width, True).hint("merge").alias("_i")
    p = _point_buckets(points, point, ptype, width, _levels(intervals, lo, hi, width)[0]).alias("_p")
    cond = [F.col(f"_i.{k}") == F.col(f"_p.{k}") for k in on]
    cond += [F.col("_i._lvl") == F.col("_p._lvl"), F.col("_i._bkt") == F.col("_p._bkt"),
             F.col(f"_p.{point}") >= F.col(f"_i.{lo}"),
             F.col(f"_p.{point}") <= F.col(f"_i.{hi}")]
    joined = i.join(p, cond, "left").select(*[F.col(f"_i.{c}").alias(c) for c in intervals.columns],
                                            *[F.col(f"_p.{c}").alias(c) for c in pcols])
    return joined.groupBy(*(group_cols or intervals.columns)).agg(*aggs)


def adjacent_join(events: DataFrame, intervals: DataFrame, on: Sequence[str], point: str,
                  lo: str, hi: str, before: Mapping[str, str], after: Mapping[str, str]) -> DataFrame:
    """The interval ending at ``point`` (before) and the one starting at
    ``point + 1`` (after), both as left equi-joins."""
    b = intervals.select(*on, F.col(hi).alias(point), *[F.col(s).alias(d) for d, s in before.items()])
    a = intervals.select(*on, (F.col(lo) - 1).alias(point), *[F.col(s).alias(d) for d, s in after.items()])
    return events.join(b, [*on, point], "left").join(a, [*on, point], "left")


def overlap_free(intervals: DataFrame, on: Sequence[str], lo: str, hi: str, width: float) -> bool:
    """Whether the intervals of each key share end points at most (one job over the intervals alone).

    Each interval meets the next one of its key by ordinal. Intervals that hold no point are not counted.
    """
    from pitwall.operators.timeseries import seq_index
    iv = _holding(intervals, lo, hi).select(*on, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"))
    iv = seq_index(iv, on, [F.col("_lo"), F.col("_hi")], "_i", bucket=("_lo", 64 * width))
    after = iv.select(*on, (F.col("_i") - 1).alias("_i"), F.col("_lo").alias("_next"))
    return iv.join(after, [*on, "_i"]).where(F.col("_next") < F.col("_hi")).isEmpty()


def _holding(intervals: DataFrame, lo: str, hi: str) -> DataFrame:
    return intervals.where(F.col(lo) <= F.col(hi))


def locate(points: DataFrame, intervals: DataFrame, on: Sequence[str], ts: str, lo: str,
           hi: str, order: Sequence[Column], point_key: Sequence[str] | None = None,
           width: float | None = None, disjoint: bool | None = None) -> DataFrame:
    """Point-in-interval lookup: each point gets the first (by ``order``)
    closed interval containing it; points in no interval are dropped.

    Where the intervals of a key share end points at most (``disjoint``; None
    asks ``overlap_free``), a point's interval is the latest that starts at or
    before it, if it reaches that far: one as-of join, without exploding
    intervals over buckets. Otherwise it is a range join. Points must be
    distinct by ``point_key`` (default ``on + [ts]``).
    """
    width = _default_width(points.schema[ts].dataType, width)
    icols = [c for c in intervals.columns if c not in on]
    _check_collisions(points, icols, on)
    iv = materialize(_holding(intervals, lo, hi), "intervals")      # read several times below
    if disjoint is None:
        disjoint = overlap_free(iv, on, lo, hi, width)
    if not disjoint:
        return range_join(points, iv, on, ts, lo, hi, how="inner", width=width,
                          first_by=order, point_key=point_key)
    # several intervals may hold a shared end point: the first one by order owns it
    ends = keep_first(iv.withColumn("_end", F.explode(F.array(lo, hi))), [*on, "_end"], order)
    owner = ends.select(*on, F.col("_end").alias("_lo"), F.struct(*icols).alias("_own"))
    starts = iv.select(*on, F.col(lo).alias("_lo"), F.col(hi).alias("_hi"), F.struct(*icols).alias("_iv")) \
        .join(owner, [*on, "_lo"])
    met = asof_join(points, starts.select(*on, "_lo", "_hi", "_iv", "_own"), on, ts, "_lo")
    found = F.when(F.col(ts) == F.col("_lo"), F.col("_own")).when(F.col(ts) <= F.col("_hi"), F.col("_iv"))
    return met.withColumn("_f", found).where(F.col("_f").isNotNull()).select(
        *points.columns, *[F.col(f"_f.`{c}`").alias(c) for c in icols])


# --------------------------------------------------------------------------- as-of join
def asof_parts(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str, right_ts: str,
               bucket_seconds: float | None = None) -> DataFrame:
    """(on, _t, _k, _p, _sb): distinct instants of both sides (left: ``_k`` 1; right: 0, with its largest row
    ``_p``) with the part ``_sb`` of their key's time that they are in.

    Parts are equal shares of all instants in (key, time) order, so that a key
    however dense is spread; or buckets of ``bucket_seconds`` (key units for
    numeric keys).
    """
    from pitwall.operators.timeseries import equal_parts
    lt, rt = left.schema[left_ts].dataType, right.schema[right_ts].dataType
    common = lt if _is_time(lt) or lt == rt else DoubleType()
    known = lambda df, ts: df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in [*on, ts]]))
    payload = F.struct(*[c for c in right.columns if c not in on])
    R = known(right, right_ts).groupBy(*on, F.col(right_ts).cast(common).alias("_t")).agg(F.max(payload).alias("_p"))
    L = known(left, left_ts).select(*on, F.col(left_ts).cast(common).alias("_t")).distinct()
    both = R.select(*on, "_t", F.lit(0).alias("_k"), "_p").unionByName(
        L.select(*on, "_t", F.lit(1).alias("_k"), F.lit(None).cast(R.schema["_p"].dataType).alias("_p")))
    if bucket_seconds is None:
        return equal_parts(both, on, [F.col("_t"), F.col("_k")])
    return both.withColumn("_sb", bucket_of(F.col("_t"), common, bucket_seconds))


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_ts: str,
              right_ts: str, tolerance: float | None = None,
              bucket_seconds: float | None = None) -> DataFrame:
    """Backward as-of LEFT join: every left row gets the latest right row
    with equal keys and ``right_ts <= left_ts``; no match gives nulls.

    Plan: the distinct instants of both sides are cut into parts per key
    (``asof_parts``); one window per (keys, part) finds each left instant's
    latest right row, and the last one of earlier parts is carried in by a
    small aggregate plus a window over parts. Left rows then meet their
    instant's match by key and time, so they are not dragged through a sort.
    Among right rows with equal time the largest row wins, so results are
    stable. NULL keys or times never match.
    """
    rcols = [c for c in right.columns if c not in on]
    _check_collisions(left, rcols, on)
    lt, rt = left.schema[left_ts].dataType, right.schema[right_ts].dataType
    if _is_time(lt) != _is_time(rt):
        raise ValueError("as-of keys must both be timestamps or both numeric")
    d = asof_parts(left, right, on, left_ts, right_ts, bucket_seconds)
    common = d.schema["_t"].dataType
    last_of = d.groupBy(*on, "_sb").agg(F.max_by("_p", F.when(F.col("_k") == 0, F.col("_t"))).alias("_c"))
    earlier = Window.partitionBy(*on).orderBy("_sb").rowsBetween(Window.unboundedPreceding, -1)
    carry = last_of.withColumn("_c", F.last("_c", ignorenulls=True).over(earlier)).where(F.col("_c").isNotNull())
    so_far = (Window.partitionBy(*on, "_sb").orderBy("_t", "_k")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    m = (d.withColumn("_m", F.last("_p", ignorenulls=True).over(so_far)).where(F.col("_k") == 1)
         .join(carry, [*on, "_sb"], "left").withColumn("_m", F.coalesce("_m", "_c"))
         .where(F.col("_m").isNotNull()))
    if tolerance is not None:
        gap = (epoch_micros(F.col("_t"), common) - epoch_micros(F.col(f"_m.`{right_ts}`").cast(common), common)
               if _is_time(lt) else F.col("_t") - F.col(f"_m.`{right_ts}`"))
        m = m.where(gap <= F.lit(tolerance * 1_000_000 if _is_time(lt) else tolerance))
    m = m.select(*[F.col(c).alias(f"_k_{c}") for c in on], F.col("_t").alias("_k_t"), "_m")
    cond = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_k_{c}") for c in on],
                  F.col(left_ts).cast(common) == F.col("_k_t"))
    return left.join(m, cond, "left").select(*left.columns, *[F.col(f"_m.`{c}`").alias(c) for c in rcols])
