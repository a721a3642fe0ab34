"""Reusable DataFrame operators shared by the reports."""

from storelens.operators.densify import densify, fill_gaps, pct_change  # noqa: F401
from storelens.operators.distinct import (  # noqa: F401
    distinct_counts, distinct_state, merge_distinct, state_counts)
from storelens.operators.joins import (  # noqa: F401
    BLOOM_SETTINGS, fits_broadcast, heavy_keys, join_dim, semi_join, split_join)
from storelens.operators.quantiles import (  # noqa: F401
    bin_of_edges, boxplot_stats, edges_from_ranks, lower_median, qcut_rank, qcut_value,
    quantile_edges, rank_bin)
from storelens.operators.ranking import class_rank, group_rank, range_tagged, top_k  # noqa: F401
from storelens.operators.selection import bracketed_quantiles, select_ranks  # noqa: F401
