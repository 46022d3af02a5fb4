"""Column functions. Missing values are NULL throughout; see null_nan for sources that hold NaN."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of a degree of latitude on a sphere, by the radius in use.
EARTH_RADIUS_M = 6_371_000.0


def null_nan(c: Column) -> Column:
    """NULL for NaN, so that aggregates skip it and comparisons with it aren't true."""
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """True for values that are neither NULL, NaN nor infinite."""
    return F.coalesce(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), F.lit(False))


def quantised(c: Column, steps: float = 1e4) -> Column:
    """Nearest 1/steps with the cut off the ties, so that two engines agree on it."""
    return (F.floor(c * F.lit(float(steps)) + F.lit(0.5137)).cast("double")) / F.lit(float(steps))


def season_month(t: Column) -> Column:
    return F.month(t)


def clipped_doy(t: Column) -> Column:
    """Day of the year; 366 counts as 365."""
    return F.least(F.dayofyear(t), F.lit(365))


def harmonic(t: Column, period: float, kind: str) -> Column:
    """sin or cos of the day of the year over a period in days: 365.25 for annual, 182.625 for semi-annual."""
    angle = F.lit(2.0) * F.pi() * F.dayofyear(t) / F.lit(float(period))
    return F.sin(angle) if kind == "sin" else F.cos(angle)


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def wind_direction(part: Column, speed: Column, eps: float = 1e-6) -> Column:
    """A component's share of the speed: of u the cosine, of v the sine."""
    return part / (speed + F.lit(eps))


def wind_chill(celsius: Column, metres_per_second: Column) -> Column:
    """Wind chill in degrees Celsius."""
    power = F.pow(metres_per_second * F.lit(3.6), F.lit(0.16))
    return F.lit(13.12) + F.lit(0.6215) * celsius - F.lit(11.37) * power + F.lit(0.3965) * celsius * power


def advection(u: Column, v: Column, dx: Column, dy: Column, latitude: Column) -> Column:
    """Change of a field by transport per second; dx and dy are its slopes per degree."""
    degree = F.lit(EARTH_RADIUS_M) * F.pi() / F.lit(180.0)
    return -(u * dx / (degree * F.cos(F.radians(latitude))) + v * dy / degree)


def packed_u8(c: Column) -> Column:
    """Half-even rounding into 0 to 254; NULL stays."""
    return F.rint(F.least(F.greatest(c, F.lit(0.0)), F.lit(254.0))).cast("short")


def coordinate_key(c: Column, steps: int = 100) -> Column:
    """Coordinate as an integer number of 1/steps, half-even; a tie is one of the coordinate, not of its rounded product."""
    product = c * F.lit(float(steps))
    half = F.floor(product) + F.lit(0.5)
    beside = c - half / F.lit(float(steps))
    return F.when((beside == 0) | (product == half), F.rint(half + F.signum(beside) / 4)).otherwise(F.rint(product)).cast("int")


def grid_cell(c: Column, per_unit: int = 4) -> Column:
    """Nearest multiple of 1/per_unit, half-even."""
    return F.rint(c * per_unit) / per_unit


def to_number(c: Column) -> Column:
    """Text as a number, NULL where it isn't one."""
    return c.try_cast("double")


def year_month_of(file_name: Column) -> tuple[Column, Column]:
    """Year and month of names that contain _YYYY_MM_."""
    found = lambda k: F.regexp_extract(file_name, r"_(\d{4})_(\d{2})_", k)
    number = lambda c: F.when(c != "", c).cast("int")
    return number(found(1)), number(found(2))


def unit_of(name: Column) -> Column:
    """Unit that a variable's name suggests."""
    low = F.lower(name)
    return (
        F.when(low.contains("temperature") | low.isin("t2m", "d2m", "stl1"), "K").when(low.contains("humidity"), "kg/kg")
        .when(low.contains("wind") | low.isin("u10", "v10", "fg10", "i10fg"), "m/s").when(low.contains("geopotential"), "m²/s²").otherwise("")
    )


def shown(c: Column, digits: int = 4) -> Column:
    """Fixed number of digits; `-` for NULL."""
    return F.when(c.isNull(), "-").otherwise(F.format_string(f"%.{digits}f", c))


def plan_key(config: dict) -> str:
    """Digest of a configuration, the same for equal ones."""
    return hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()
