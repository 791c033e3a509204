"""Column-level helpers: every function returns a ``pyspark.sql.Column``."""

from .numeric import (  # noqa: F401
    bayesian_score,
    exact_avg,
    exact_sum,
    minmax,
    nullsafe_div,
    rank_score,
    round_half_away,
    weighted,
)
from .segment import bucket_desc, bucket_range, field_position  # noqa: F401
