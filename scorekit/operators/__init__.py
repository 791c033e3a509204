"""DataFrame operators that hold up under skewed groups."""

from .positions import (  # noqa: F401
    group_positions,
    ntile_of,
    ntile_within,
    order_exprs,
    rank_all,
    rank_within,
    ranks_within,
    row_positions,
)
from .selection import (  # noqa: F401
    at_or_before,
    median_of,
    middle,
    rows_at,
    tile_ends,
    tile_of,
    with_cuts,
)
from .skew import hot_keys, skew_join  # noqa: F401
from .stats import group_median, group_stats, median_table, topk_within  # noqa: F401
