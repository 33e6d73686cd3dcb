"""Reusable relational and time-series operators (pure DataFrame composition)."""

from pitwall.operators.dedupe import keep_first, latest_per_key, row_hash
from pitwall.operators.joins import (adjacent_join, anti, asof_join, enrich, enrich_roles,
                                     locate, range_agg, range_join, semi)
from pitwall.operators.timeseries import (argmax_per_point, gap_fill_linear, last_non_null,
                                          resample_linear, segments, seq_index)

__all__ = [
    "latest_per_key", "keep_first", "row_hash",
    "enrich", "enrich_roles", "range_join", "range_agg", "adjacent_join", "asof_join",
    "locate", "anti", "semi",
    "seq_index", "resample_linear", "gap_fill_linear", "segments", "last_non_null",
    "argmax_per_point",
]
