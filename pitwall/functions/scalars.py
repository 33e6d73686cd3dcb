"""Scalar business rules as built-in column expressions.

All stay inside whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the source system's output strings.
DASH = "—"
ARROW_UP = "↑"
ARROW_DOWN = "↓"
STATUS_COMPLETED = "COMPLETED"
STATUS_CANCELLED = "CANCELLED"
STATUS_UPCOMING = "UPCOMING"
CLASS_DSQ, CLASS_DNS, CLASS_DNF, CLASS_OK = "DSQ", "DNS", "DNF", "Classified"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def classify_result(is_dsq, is_dns, is_dnf, finish_position, laps_completed) -> Column:
    """DSQ > DNS > DNF > implicit DNF (no position, laps run) > implicit DNS > Classified."""
    return (F.when(_c(is_dsq) == F.lit(True), CLASS_DSQ)
            .when(_c(is_dns) == F.lit(True), CLASS_DNS)
            .when(_c(is_dnf) == F.lit(True), CLASS_DNF)
            .when(_c(finish_position).isNull() & (F.coalesce(_c(laps_completed), F.lit(0)) > 0), CLASS_DNF)
            .when(_c(finish_position).isNull(), CLASS_DNS)
            .otherwise(CLASS_OK))


def positions_gained(finish, grid, session_type=None, only_type: str = "Race") -> Column:
    """F8: finish - grid (negative = places gained); optionally only for one session type."""
    d = _c(finish) - _c(grid)
    return d if session_type is None else F.when(_c(session_type) == F.lit(only_type), d)


def tyre_age_on_lap(lap_number, lap_start, age_at_start) -> Column:
    """F9."""
    return _c(lap_number) - _c(lap_start) + _c(age_at_start)


def add_seconds(ts, seconds, whole_seconds: bool = False) -> Column:
    """timestamp + fractional seconds, exact to the microsecond.

    ``whole_seconds=True`` rounds the offset to whole seconds first.
    """
    s = _c(seconds)
    if whole_seconds:
        return F.timestamp_add("SECOND", F.round(s).cast("long"), _c(ts))
    return _c(ts) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), s.cast("decimal(18,6)"))


def normalise(c) -> Column:
    """upper(trim(x)) with NULL → ''."""
    return F.upper(F.trim(F.coalesce(_c(c), F.lit(""))))


def format_laptime(seconds) -> Column:
    """``m:ss.mmm``; NULL → dash."""
    s = _c(seconds)
    m = F.floor(s / 60).cast("int")
    return F.when(s.isNull(), F.lit(DASH)).otherwise(F.format_string("%d:%06.3f", m, s - m * 60))


def format_delta(x, digits: int = 3) -> Column:
    """signed fixed-point text; NULL → dash."""
    return F.when(_c(x).isNull(), F.lit(DASH)).otherwise(F.format_string(f"%+.{digits}f", _c(x)))


def trend_arrow(gained) -> Column:
    """↑ n for places gained (negative), ↓ n for places lost, dash otherwise."""
    g = _c(gained)
    n = F.abs(g.cast("int")).cast("string")
    return (F.when(g < 0, F.concat(F.lit(ARROW_UP + " "), n))
            .when(g > 0, F.concat(F.lit(ARROW_DOWN + " "), n))
            .otherwise(F.lit(DASH)))


def race_status(winner, start_at, as_of) -> Column:
    """F16: COMPLETED with a winner, CANCELLED when started without one, else UPCOMING."""
    return (F.when(_c(winner).isNotNull(), STATUS_COMPLETED)
            .when(_c(start_at).isNotNull() & (_c(start_at) <= (as_of if isinstance(as_of, Column) else F.lit(as_of))),
                  STATUS_CANCELLED)
            .otherwise(STATUS_UPCOMING))


def driver_label(position, acronym) -> Column:
    """``P{pos} {acr}`` or the acronym alone."""
    return F.when(_c(position).isNotNull(),
                  F.concat(F.lit("P"), _c(position).cast("int").cast("string"), F.lit(" "), _c(acronym))
                  ).otherwise(_c(acronym))


def lap_span(length, lap_start, lap_end) -> Column:
    """``len (start–end)``; unknown parts shown as '?'."""
    q = lambda c: F.coalesce(_c(c).cast("int").cast("string"), F.lit("?"))
    return F.when(_c(lap_end).isNotNull(),
                  F.concat(q(length), F.lit(" ("), q(lap_start), F.lit("–"), q(lap_end), F.lit(")"))
                  ).otherwise(F.coalesce(_c(length).cast("int").cast("string"), F.lit(DASH)))


def format_date(ts, pattern: str = "MMM dd, yyyy", missing: str = "TBD") -> Column:
    """F18."""
    return F.coalesce(F.date_format(_c(ts), pattern), F.lit(missing))


def rotate2d(x, y, angle_deg) -> tuple[Column, Column]:
    """rotate by ``-angle`` degrees."""
    r = F.radians(-_c(angle_deg)) if not isinstance(angle_deg, (int, float)) else F.lit(math.radians(-angle_deg))
    return (_c(x) * F.cos(r) - _c(y) * F.sin(r), _c(x) * F.sin(r) + _c(y) * F.cos(r))


def points_int(points) -> Column:
    """integer points, NULL or non-positive → 0."""
    p = _c(points)
    return F.when(p.isNotNull() & (p > 0), p.cast("int")).otherwise(F.lit(0))


def int_or_dash(x) -> Column:
    """integer text or dash."""
    return F.coalesce(_c(x).cast("int").cast("string"), F.lit(DASH))


def title_label(name: str) -> str:
    """P14 default: snake_case → Title Case."""
    return " ".join(w.capitalize() for w in name.split("_"))


def relabel(df, labels: dict[str, str] | None = None):
    """Rename columns for display — explicit label, else Title Case."""
    labels = labels or {}
    return df.withColumnsRenamed({c: labels.get(c, title_label(c)) for c in df.columns})
