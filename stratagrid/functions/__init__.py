"""Column functions: dates, wind, temperature, rounding and keys."""

from .scalar import *  # noqa: F403
