"""Settings of the library, as frozen dataclasses, and the fixed domain values."""

from __future__ import annotations

from dataclasses import dataclass, field

# Indicator names in table order.
PIXEL_INDICATORS = ("ndvi", "lst", "vpd", "eto", "pr")
INDICATORS = PIXEL_INDICATORS + ("water_deficit",)


@dataclass(frozen=True)
class Season:
    """Growing season, 1 May to 31 October: 184 days, 27 weeks, the last of two days."""

    first_month: int = 5
    first_day: int = 1
    last_month: int = 10
    last_day: int = 31
    weeks: int = 27


@dataclass(frozen=True)
class StressWeights:
    """Weights of the index parts. Parts that are missing drop out and the rest renormalise."""

    deficit: float = 0.40
    rain: float = 0.35
    demand: float = 0.25
    surface_heat: float = 0.60
    dry_air: float = 0.40
    air_vpd: float = 0.50
    air_eto: float = 0.50
    water: float = 0.40
    heat: float = 0.30
    vegetation: float = 0.20
    atmosphere: float = 0.10


@dataclass(frozen=True)
class ForecastCoefficients:
    """Fixed values of the linear yield model, in bushels per acre."""

    baseline: float = 198.7
    heat_days: float = -1.2
    water_deficit: float = -0.8
    precip: float = 0.15
    ndvi_avg: float = 45.0
    ndvi_min: float = -15.0
    floor: float = 50.0
    ceiling: float = 300.0


# Fixed values: (exclusive upper week, uncertainty); the last entry has no upper week.
UNCERTAINTY_STEPS = {
    "linear": ((22, 15.0), (30, 12.0), (36, 8.32), (None, 5.0)),
    "tree": ((22, 12.0), (30, 8.0), (36, 6.5), (None, 4.0)),
}

# Accepted range per column, both ends allowed.
VALUE_RANGES = {
    "ndvi_mean": (0.0, 1.0),
    "ndvi_std": (0.0, 0.5),
    "lst_mean": (-50.0, 60.0),
    "lst_std": (0.0, 20.0),
    "vpd_mean": (0.0, 5.0),
    "eto_mean": (0.0, 15.0),
    "pr_mean": (0.0, 200.0),
    "water_deficit_mean": (-200.0, 15.0),
}

# Season week -> stage hint; weeks in between have none.
WEEK_HINTS = {
    7: "V2-V3 (Early vegetative)",
    10: "V10 (Mid vegetative)",
    13: "R1 (Silking - Pollination start)",
    14: "R2 (Blister)",
    15: "R3 (Milk)",
    16: "R4 (Dough)",
    18: "R5 (Dent)",
    20: "R6 (Black layer)",
    22: "R7 (Maturity)",
    26: "R7 (Mature - Harvest ready)",
}

# Growth windows by season week, both ends included.
GROWTH_WINDOWS = (
    (1, 4, "planting"),
    (5, 9, "vegetative growth"),
    (10, 12, "pollination"),
    (13, 20, "grain fill"),
    (21, 26, "maturation"),
)

# Cumulative heat units (degrees F) at which a stage is reached, [low, high).
HEAT_UNIT_STAGES = (
    ("VE", 100.0, 120.0),
    ("V6", 450.0, 500.0),
    ("V12", 800.0, 900.0),
    ("VT", 1100.0, 1200.0),
    ("R1", 1200.0, 1350.0),
    ("R6", 2400.0, 2800.0),
)

# Fixed values of the health score: value at the two ends of a band and the score there.
HEALTH_BANDS = {
    "ndvi": ((-1.0, 0.30, 0.0, 29.0), (0.30, 0.45, 30.0, 49.0), (0.45, 0.60, 50.0, 69.0),
             (0.60, 0.75, 70.0, 89.0), (0.75, 1.0, 90.0, 100.0)),
    "lst": ((0.0, 25.0, 100.0, 90.0), (25.0, 30.0, 89.0, 70.0), (30.0, 35.0, 69.0, 50.0),
            (35.0, 40.0, 49.0, 30.0), (40.0, 60.0, 29.0, 0.0)),
    "vpd": ((0.0, 1.0, 100.0, 90.0), (1.0, 1.5, 89.0, 70.0), (1.5, 2.0, 69.0, 50.0),
            (2.0, 2.5, 49.0, 30.0), (2.5, 5.0, 29.0, 0.0)),
    "water": ((-50.0, 0.0, 100.0, 90.0), (0.0, 10.0, 89.0, 70.0), (10.0, 25.0, 69.0, 50.0),
              (25.0, 40.0, 49.0, 30.0), (40.0, 80.0, 29.0, 0.0)),
}

# Fixed values: (last week, ndvi, lst, vpd, water) weights of the health score by growth stage.
HEALTH_WEIGHTS = (
    (8, 0.30, 0.20, 0.20, 0.30),
    (14, 0.25, 0.30, 0.20, 0.25),
    (22, 0.35, 0.15, 0.15, 0.35),
)


@dataclass(frozen=True)
class Chunking:
    """Text windows: size and overlap in characters."""

    size: int = 1000
    overlap: int = 200

    def __post_init__(self) -> None:
        # A cut may fall one character after the half window; the next start must lie further on.
        if self.size <= self.overlap or self.size // 2 + 2 <= self.overlap:
            raise ValueError("overlap too large for this chunk size: windows would not advance")


@dataclass(frozen=True)
class PromptLayout:
    """Prompt text pieces and the context limit in characters."""

    separator: str = "\n\n---\n\n"
    limit: int = 3000
    marker: str = "\n... (truncated)"


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75


@dataclass(frozen=True)
class TreeGrid:
    """Hyperparameter grid of the boosted trees."""

    depths: tuple[int, ...] = (3, 5)
    rates: tuple[float, ...] = (0.01, 0.1)
    rounds: tuple[int, ...] = (100,)
    subsample: float = 0.9
    seed: int = 42


SEASON = Season()
STRESS_WEIGHTS = StressWeights()
FORECAST = ForecastCoefficients()
CHUNKING = Chunking()
PROMPT = PromptLayout()
