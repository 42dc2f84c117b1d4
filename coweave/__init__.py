"""Sparse item-item recommendation on Spark: co-occurrence, non-negative elastic-net weights, ranking, metrics."""

from . import metrics
from .estimator import SLIM, NotFittedError
from .functions.shared import release, scope, ship
from .operators.fit import ConvergenceWarning, fit, fit_with_diagnostics
from .operators.score import predict, recommend

__version__ = "0.1.0"

__all__ = [
    "SLIM",
    "ConvergenceWarning",
    "NotFittedError",
    "__version__",
    "fit",
    "fit_with_diagnostics",
    "metrics",
    "predict",
    "recommend",
    "release",
    "scope",
    "ship",
]
