from meterlab.functions.calendar import (
    add_calendar,
    block_start,
    epoch_seconds,
    season_of,
    temporada_of,
    trunc_to,
    weekday_monday,
)
from meterlab.functions.moments import (
    joint_corr,
    mean_strict,
    null_if_nan,
    percentile,
    zscore_over,
)

__all__ = [
    "add_calendar", "block_start", "epoch_seconds", "season_of", "temporada_of",
    "trunc_to", "weekday_monday", "joint_corr", "mean_strict", "null_if_nan",
    "percentile", "zscore_over",
]
