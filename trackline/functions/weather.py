"""Unit conversions, wind labels and wind vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Conversion factors and labels that results must agree with.
MPH_TO_KPH = 1.609
INHG_TO_MBAR = 36.86
INCH_TO_METRE = 0.0254
SPEED_BANDS = ["00-05 mph", "05-10 mph", "10-15 mph", "15-20 mph", "20+ mph"]
SPEED_LIMITS = [5, 10, 15, 20]
COMPASS_8 = [
    "North", "North East", "East", "South East", "South", "South West", "West", "North West",
]
COMPASS_16 = [
    "North", "North-Northeast", "Northeast", "East-Northeast",
    "East", "East-Southeast", "Southeast", "South-Southeast",
    "South", "South-Southwest", "Southwest", "West-Southwest",
    "West", "West-Northwest", "Northwest", "North-Northwest",
]


def celsius(fahrenheit: Column) -> Column:
    return (fahrenheit - 32) * 5 / 9


def kph(mph: Column, factor: float = MPH_TO_KPH) -> Column:
    return mph * F.lit(factor)


def millibar(inches: Column, factor: float = INHG_TO_MBAR) -> Column:
    return inches * F.lit(factor)


def metres(inches: Column) -> Column:
    """Exact to a tenth of a millimetre."""
    return (inches * F.lit(INCH_TO_METRE).cast("decimal(5,4)")).cast("decimal(18,4)")


def normal_degrees(degrees: Column) -> Column:
    """A full turn and zero both mean north; other values stay as they are."""
    return F.when(degrees == 360, F.lit(0.0)).otherwise(degrees)


def speed_band(mph: Column) -> Column:
    """Five bands, each with its lower limit included; NULL stays NULL."""
    band = F.when(mph.isNull(), F.lit(None).cast("string"))
    for limit, label in zip(SPEED_LIMITS, SPEED_BANDS):
        band = band.when(mph < limit, label)
    return band.otherwise(SPEED_BANDS[-1])


def band_order(band: Column) -> Column:
    """Position of a band label in the fixed band list, from 0."""
    return F.array_position(F.array(*[F.lit(b) for b in SPEED_BANDS]), band) - 1


def compass_label(degrees: Column) -> Column:
    """Eight-point label, each centred on its direction; outside [0, 360) only north catches."""
    label = F.when((degrees >= 337.5) | (degrees < 22.5), COMPASS_8[0])
    for i, name in enumerate(COMPASS_8[1:], start=1):
        label = label.when((degrees >= 45 * i - 22.5) & (degrees < 45 * i + 22.5), name)
    return label


def rose_index(degrees: Column) -> Column:
    """One of 16 bins that start, rather than centre, on their direction: bin 0 is [0, 22.5)."""
    return F.floor((degrees % 360) / 22.5).cast("bigint")


def rose_label(index: Column) -> Column:
    """Label of a rose bin; NULL outside the 16 bins."""
    names = F.array(*[F.lit(n) for n in COMPASS_16])
    return F.when(index.between(0, len(COMPASS_16) - 1), F.get(names, index.cast("int")))


def wind_vector(degrees: Column, speed: Column) -> dict[str, Column]:
    """Direction the air moves to, its map arrow rotation, and the east and north components."""
    flow = (degrees + 180) % 360
    return {
        "flow_direction_degrees": flow,
        "arrow_rotation": 90 - flow,
        "u_component_mph": F.sin(F.radians(flow)) * speed,
        "v_component_mph": F.cos(F.radians(flow)) * speed,
    }
