"""Options of the three kernels, checked when they are made."""

from __future__ import annotations

import enum
import math
from dataclasses import dataclass, replace

from .errors import InvalidInput

STANDARD_MISSING = (-999.25, -999.0, 999.25)
MAX_POINTS, MAX_CELLS, MAX_MEMORY_MB = 200_000, 50_000_000, 512.0
INT32_MAX, UINT64 = 2**31 - 1, 2**64


def require(ok: bool, what: str) -> None:
    if not ok:
        raise InvalidInput(what)


def positive(x: float) -> bool:
    return math.isfinite(x) and x > 0


def whole(x: object, least: int) -> bool:
    try:
        return int(x) == x and x >= least  # type: ignore[call-overload,operator]
    except (TypeError, ValueError, OverflowError):
        return False


class CellModel(enum.Enum):
    """How a value inside a cell follows from its corners: bilinear, or by two triangles along one of the diagonals."""

    BILINEAR = "bilinear"
    BOTTOM_LEFT_TO_TOP_RIGHT = "bl_tr"
    BOTTOM_RIGHT_TO_TOP_LEFT = "br_tl"


class Correlation(enum.Enum):
    GAUSSIAN = "gaussian"
    EXPONENTIAL = "exponential"
    SPHERICAL = "spherical"


class Trend(enum.Enum):
    PLANE = "plane"
    CONSTANT = "constant"
    INPUT_SURFACE = "input_surface"


@dataclass(frozen=True)
class LogOptions:
    """Cleaning, resampling and normalising of curves."""

    step: float | None = None
    missing_values: tuple[float, ...] = STANDARD_MISSING
    max_interpolation_gap: float | None = None
    interpolate_all_gaps: bool = False
    clip_percentiles: tuple[float, float] | None = None
    max_resampled_points: int = MAX_POINTS

    def __post_init__(self) -> None:
        require(self.step is None or positive(self.step), "step must be finite and positive")
        require(all(math.isfinite(x) for x in self.missing_values), "missing values must be finite")
        require(not (self.interpolate_all_gaps and self.max_interpolation_gap is not None), "give either max_interpolation_gap or interpolate_all_gaps")
        require(self.max_interpolation_gap is None or positive(self.max_interpolation_gap), "max_interpolation_gap must be finite and positive")
        require(whole(self.max_resampled_points, 2), "max_resampled_points must be a whole number of at least 2")
        if self.clip_percentiles is not None:
            require(len(self.clip_percentiles) == 2, "clip_percentiles takes two bounds")
            low, high = self.clip_percentiles
            require(math.isfinite(low) and math.isfinite(high) and 0 <= low < high <= 100, "clip_percentiles must satisfy 0 <= low < high <= 100")

    def with_step(self, step: float) -> LogOptions:
        return replace(self, step=step)


@dataclass(frozen=True)
class WarpOptions:
    """Dynamic time warping. The defaults are those of a single alignment; correlations penalise warps and limit runs."""

    window: float = 0.10
    warp_penalty: float = 0.0
    max_warp_run: int | None = None
    max_dtw_cells: int = MAX_CELLS
    max_memory_mb: float = MAX_MEMORY_MB

    def __post_init__(self) -> None:
        require(math.isfinite(self.window) and 0 <= self.window <= 1, "window must be from 0 to 1")
        require(math.isfinite(self.warp_penalty) and self.warp_penalty >= 0, "warp_penalty must be finite and not negative")
        require(self.max_warp_run is None or whole(self.max_warp_run, 1), "max_warp_run must be a whole number of at least 1, or None")
        require(whole(self.max_dtw_cells, 1), "max_dtw_cells must be a whole number of at least 1")
        require(positive(self.max_memory_mb), "max_memory_mb must be finite and positive")


CORRELATE = WarpOptions(warp_penalty=0.05, max_warp_run=25)


@dataclass(frozen=True)
class Surface:
    """Bounds and node counts; node iy * nx + ix lies at (minx + ix dx, miny + iy dy)."""

    minx: float
    maxx: float
    miny: float
    maxy: float
    nx: int
    ny: int

    def __post_init__(self) -> None:
        require(whole(self.nx, 2) and whole(self.ny, 2), "a surface needs two nodes or more on each axis")
        bounds = (self.minx, self.maxx, self.miny, self.maxy)
        require(all(math.isfinite(x) for x in bounds) and self.minx < self.maxx and self.miny < self.maxy, "bounds must be finite and increasing")
        require(self.nx * self.ny < 2**63, "too many nodes")

    @property
    def dx(self) -> float:
        return (self.maxx - self.minx) / (self.nx - 1)

    @property
    def dy(self) -> float:
        return (self.maxy - self.miny) / (self.ny - 1)


@dataclass(frozen=True)
class ConvergentOptions:
    """Minimum-curvature gridding."""

    max_levels: int = 0
    coarsest: int = 17
    max_iterations: int = 1500
    relative_tolerance: float = 1e-9
    smoothness: float = 1.0
    cells: CellModel = CellModel.BOTTOM_RIGHT_TO_TOP_LEFT
    data_weight: float = 1e3
    regularization: float = 1e-10
    ignore_outside: bool = False
    hard: bool = True
    max_constraint_iterations: int = 30
    penalty_growth: float = 5.0
    point_tolerance: float = 1e-9

    def __post_init__(self) -> None:
        require(whole(self.max_levels, 0), "max_levels must be a whole number, 0 for all")
        require(whole(self.coarsest, 2), "the coarsest grid needs two nodes or more")
        require(whole(self.max_iterations, 1), "max_iterations must be at least 1")
        for name in ("relative_tolerance", "smoothness", "data_weight", "regularization", "point_tolerance"):
            require(positive(getattr(self, name)), f"{name} must be finite and positive")
        require(not self.hard or whole(self.max_constraint_iterations, 1), "max_constraint_iterations must be at least 1")
        require(math.isfinite(self.penalty_growth) and self.penalty_growth >= 1, "penalty_growth must be finite and at least 1")
        require(isinstance(self.cells, CellModel), "unknown cell model")


@dataclass(frozen=True)
class GaussianOptions:
    """Conditional Gaussian realisations. A range of 0 is a fifth of the extent, a variance of 0 is estimated."""

    cells: CellModel = CellModel.BOTTOM_RIGHT_TO_TOP_LEFT
    correlation: Correlation = Correlation.GAUSSIAN
    trend: Trend = Trend.PLANE
    major_range: float = 0.0
    minor_range: float = 0.0
    azimuth_degrees: float = 0.0
    structured_variance: float = 0.0
    nugget: float = 0.0
    padding: int = 2
    max_expansions: int = 3
    seed: int = 1
    hard: bool = True
    max_conditioning_iterations: int = 3000
    max_refinements: int = 3
    conditioning_tolerance: float = 1e-10
    ignore_outside: bool = False

    def __post_init__(self) -> None:
        for name in ("major_range", "minor_range", "structured_variance", "nugget"):
            x = getattr(self, name)
            require(math.isfinite(x) and x >= 0, f"{name} must be finite and not negative")
        require(math.isfinite(self.azimuth_degrees), "azimuth_degrees must be finite")
        require(whole(self.padding, 2), "padding must be a whole number of at least 2")
        require(whole(self.max_expansions, 1), "max_expansions must be at least 1")
        require(whole(self.seed, 0) and self.seed < UINT64, "seed must fit 64 bits")
        require(not self.hard or (whole(self.max_conditioning_iterations, 1) and whole(self.max_refinements, 1)), "iteration limits must be at least 1")
        require(positive(self.conditioning_tolerance), "conditioning_tolerance must be finite and positive")
        require(isinstance(self.cells, CellModel) and isinstance(self.correlation, Correlation) and isinstance(self.trend, Trend), "unknown model")
