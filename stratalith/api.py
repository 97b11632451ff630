"""The engine's functions in one place."""

from .functions.udtfs import register
from .kernels.convergent import interpolate as interpolate_arrays
from .kernels.gaussian import interpolate as simulate_arrays
from .kernels.grids import evaluate
from .kernels.warping import Alignment, align
from .operators.geometry import evaluate_surface, map_columns, map_nodes, map_surfaces
from .options import CORRELATE, CellModel, ConvergentOptions, Correlation, GaussianOptions, LogOptions, Surface, Trend, WarpOptions
from .plans.correlation import correlate, correlate_prepared, read_log
from .plans.surfaces import interpolate_convergent, nodes_of, simulate_gaussian
from .session import local_session, ship
from .sources.csv_logs import read_curve, read_curves, write_one_csv


def dtw(a, b, window: float = 0.10, **options):
    """Path and normalized cost of one alignment."""
    r = align(a, b, WarpOptions(window=window, **options))
    return r.path, r.normalized_cost


dtw_details = align

__all__ = [
    "CORRELATE", "Alignment", "CellModel", "ConvergentOptions", "Correlation", "GaussianOptions", "LogOptions", "Surface", "Trend", "WarpOptions", "align", "correlate",
    "correlate_prepared", "dtw", "dtw_details", "evaluate", "evaluate_surface", "interpolate_arrays", "interpolate_convergent", "local_session", "map_columns", "map_nodes", "map_surfaces", "nodes_of",
    "read_curve", "read_curves", "read_log", "register", "ship", "simulate_arrays", "simulate_gaussian", "write_one_csv",
]
