"""Errors of the engine, each also of the built-in kind that callers expect."""

from __future__ import annotations


class InvalidInput(ValueError):
    """Bad options, bounds or data."""


class OutOfRange(InvalidInput):
    """A point outside the surface, or in a cell that is not active."""


class Overflow(ArithmeticError):
    """A size or statistic that does not fit."""


class Unsatisfied(RuntimeError):
    """Constraints that the solver could not meet, or a covariance that has no spectrum."""


class ResourceLimit(MemoryError):
    """More points, cells or memory than a limit allows."""


STATUS = {InvalidInput: "invalid_input", OutOfRange: "out_of_range", Overflow: "overflow", Unsatisfied: "unsatisfied", ResourceLimit: "resource_limit", FloatingPointError: "overflow"}


def status_of(error: Exception) -> str:
    return next((name for kind, name in sorted(STATUS.items(), key=lambda x: -len(x[0].__mro__)) if isinstance(error, kind)), "error")
