"""Levels, grains, windows, lags and budgets: the values that plans are generated from."""

from __future__ import annotations

from dataclasses import dataclass, field

DIMS = ("item_id", "dept_id", "cat_id", "store_id", "state_id")
GRAINS = ("daily", "weekly")
TOTAL = "TOTAL"


@dataclass(frozen=True)
class Level:
    """A set of dimensions to aggregate by. split_by names the columns that its datasets are partitioned by when written."""

    id: int
    name: str
    dims: tuple[str, ...]
    split_by: tuple[str, ...] = ()
    filters: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def label(self, grain: str) -> str:
        return f"level_{self.id:02d}_{grain}_{self.name}"


LEVELS = (
    Level(1, "total", ()),
    Level(2, "state", ("state_id",)),
    Level(3, "cat", ("cat_id",)),
    Level(4, "dept", ("dept_id", "cat_id")),
    Level(5, "state_cat", ("cat_id", "state_id")),
    Level(6, "store", ("store_id", "state_id")),
    Level(7, "state_dept", ("dept_id", "cat_id", "state_id")),
    Level(8, "store_cat", ("cat_id", "store_id", "state_id")),
    Level(9, "store_dept", ("dept_id", "cat_id", "store_id", "state_id")),
    Level(10, "item", ("dept_id", "cat_id", "item_id"), ("dept_id",)),
    Level(11, "item_state", ("dept_id", "cat_id", "item_id", "state_id"), ("state_id", "dept_id")),
    Level(12, "item_store", ("dept_id", "cat_id", "item_id", "store_id", "state_id"), ("store_id", "dept_id")),
)
BY_ID = {x.id: x for x in LEVELS}
BY_NAME = {x.name: x for x in LEVELS}

# --- fixed values -------------------------------------------------------------------------------------------------------------
PRICE_LAG = {"daily": 7, "weekly": 1}
PERIOD_DAYS = {"daily": 1, "weekly": 7}
SEASON = {"daily": 7, "weekly": 52}
NAIVE_SEASONS = {"daily": (1, 7, 28, 364), "weekly": (1, 4, 52)}
AVERAGE_WINDOWS = {"daily": (7, 14, 21, 28, 35), "weekly": (2, 3, 4, 6, 8)}
BLOCK = {"daily": 28, "weekly": 4}  # periods that one forecast covers, in validation and test
VALID_BLOCKS = 13
LAGS = {"daily": (*range(1, 29), 35, 42, 56, 91, 182, 364), "weekly": (1, 2, 3, 4, 8, 13, 17, 22, 26, 39, 52)}
#: By lag: widths of rolling statistics, a pair of widths for momentum, expanding mean, (season, count) of seasonal means.
TRANSFORMS = {
    "daily": {
        1: {"rolling": (7, 14, 21, 35), "momentum": (7, 35)},
        **{k: {"rolling": (7, 14)} for k in range(2, 8)},
        28: {"rolling": (7, 28, 91), "momentum": (7, 28)},
        91: {"rolling": (28, 91), "expanding": True},
        364: {"rolling": (28, 91), "seasonal": ((7, 8), (364, 2))},
    },
    "weekly": {
        1: {"rolling": (4, 13)},
        4: {"rolling": (4, 13, 26), "momentum": (4, 13)},
        13: {"rolling": (13, 26), "expanding": True},
        52: {"rolling": (4, 13)},
    },
}
EVENT_TYPES = {"Sporting": 1, "Cultural": 2, "National": 3, "Religious": 4}
TRACKED_EVENTS = ("Thanksgiving", "NewYear")
CLOSING_EVENTS = ("Christmas",)
CLOSURE_DAYS = 7
ENCODING_ROWS = 28
PRIOR_ROWS = 10
STOCKOUT_DAYS = 7
ADI_CUT, CV2_CUT = 1.32, 0.49
TWEEDIE_POWER = 1.5
TWEEDIE_LEVELS = (12,)
# ------------------------------------------------------------------------------------------------------------------------------

#: The names of the columns that a model may see beside the lag families.
EXOGENOUS = (
    "avg_sell_price", "price_change", "price_vs_mean", "has_event", "has_event_2", "snap",
    "year", "month", "day", "dayofweek", "weekofyear", "is_weekend",
    "price_vs_max", "days_since_release", "event_type_1_enc", "event_type_2_enc", "days_since_event", "days_to_event",
    "quarter", "is_month_start", "is_month_end", "dow_sin", "dow_cos", "month_sin", "month_cos", "doy_sin", "doy_cos",
    "price_volatility", "days_since_thanksgiving", "days_to_thanksgiving", "days_since_newyear", "days_to_newyear",
    "zero_streak", "pct_zero_28", "pct_zero_90", "adi_expanding", "cv2_90", "is_likely_stockout",
)


@dataclass(frozen=True)
class Profile:
    """What a training run does and may spend."""

    name: str
    baseline: bool  # classical forecasts beside the naive ones
    selection: bool  # permutation importance and backward elimination
    explain: bool  # importances of the final model
    search: bool
    bench_trees: int
    trials: int
    seconds: int
    search_trees: int
    folds: int
    final_trees: int
    permutation_rows: int = 15_000
    permutation_repeats: int = 5
    batch: int = 16
    tolerance: float = 0.02


# The budgets of the four profiles.
PROFILES = {
    "fast": Profile("fast", False, False, False, False, 500, 100, 180, 500, 1, 1_000),
    "moderate": Profile("moderate", False, False, False, True, 1_500, 200, 300, 1_500, 3, 5_000),
    "efficient": Profile("efficient", True, True, True, True, 800, 300, 600, 800, 1, 1_500),
    "optimized": Profile("optimized", True, True, True, True, 1_500, 500, 600, 1_500, 3, 5_000),
}
