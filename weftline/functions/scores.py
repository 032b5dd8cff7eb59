"""Numeric columns: similarity scores, bins, classes, distances, dates."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Upper limits of distance classes in km.
DISTANCE_CLASSES = (500, 1000, 2000, 3000, 4000, 5000, 10000, 20000)
#: Day 0 of relative dates; days of a time bin; largest distance of linked days.
START_DATE, BIN_DAYS, DATE_WINDOW = "2020-01-01", 12, 5
#: Labels from least to most alike, "Other" left out.
LABELS = ("VERY DISSIMILAR", "SOMEWHAT DISSIMILAR", "SOMEWHAT SIMILAR", "VERY SIMILAR")
EARTH_KM = 6371.0088


def normalised(score: Column, kind: str = "positive") -> Column:
    """A score of 1 to 4 (1: most alike) on the scale of a cosine."""
    return (4 - score) / 3 if kind == "positive" else (5 - 2 * score) / 3


def denormalised(cosine: Column, kind: str = "positive") -> Column:
    return 4 - 3 * cosine if kind == "positive" else (5 - 3 * cosine) / 2


def clamped(score: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(F.lit(4.0), score))


def flipped(score: Column) -> Column:
    return 5 - score


def display(score: Column, base: float) -> Column:
    """The weight a similarity is drawn with."""
    return F.pow(F.lit(float(base)), 1 / (score + 0.1))


def relative_day(date: Column) -> Column:
    return F.abs(F.datediff(date, F.lit(START_DATE).cast("date")))


def week_of_month(date: Column) -> Column:
    """Weeks start on Mondays; the month's first days are week 1."""
    monday = lambda d: F.floor((F.dayofyear(d) + 6 - F.weekday(d)) / 7)
    return (monday(date) - monday(F.trunc(date, "month")) + 1).cast("int")


def time_bin(day1: Column, day2: Column, width: int = BIN_DAYS) -> Column:
    """The bin of a pair's mean day, halves to the even bin."""
    return F.bround((day1 + day2) / 2 / width).cast("int")


def month_bin(day: Column) -> Column:
    return F.floor(day / 30).cast("int")


def index_class(value: Column, kind: str = "democracy") -> Column:
    return F.ceil(value * 2.5) / 2.5 if kind == "democracy" else F.ceil(value / 5) * 5


def first_at_least(value: Column, limits: tuple[float, ...] = DISTANCE_CLASSES) -> Column:
    """The number of the first limit that isn't below the value; their count if none is."""
    out = F.lit(len(limits))
    for i in range(len(limits) - 1, -1, -1):
        out = F.when(value <= limits[i], i).otherwise(out)
    return F.when(value.isNotNull(), out)


def label_ordinal(label: Column) -> Column:
    """A label's place from 1; null for any other."""
    place = F.array_position(F.array(*(F.lit(x) for x in LABELS)), F.upper(label))
    return F.when(place > 0, place).cast("int")


def date_decay(days: Column, decay: float) -> Column:
    return F.pow(F.lit(decay), F.abs(days))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(a))


def geodesic_km(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """Inverse Vincenty on WGS-84; for the few distinct place pairs, not for rows."""
    a, f = 6378.137, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat1, lat2))
    dl = math.radians(lon2 - lon1)
    lam = dl
    for _ in range(200):
        s = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        if s == 0:
            return 0.0
        c = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sigma = math.atan2(s, c)
        alpha = math.cos(u1) * math.cos(u2) * math.sin(lam) / s
        cos2 = 1 - alpha**2
        mid = c - 2 * math.sin(u1) * math.sin(u2) / cos2 if cos2 else 0.0
        k = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
        last, lam = lam, dl + (1 - k) * f * alpha * (sigma + k * s * (mid + k * c * (2 * mid**2 - 1)))
        if abs(lam - last) < 1e-12:
            break
    u = cos2 * (a**2 - b**2) / b**2
    big_a = 1 + u / 16384 * (4096 + u * (u * (320 - 175 * u) - 768))
    big_b = u / 1024 * (256 + u * (u * (74 - 47 * u) - 128))
    delta = big_b * s * (mid + big_b / 4 * (c * (2 * mid**2 - 1) - big_b / 6 * mid * (4 * s**2 - 3) * (4 * mid**2 - 3)))
    return b * big_a * (sigma - delta)


def geodesic(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """``geodesic_km`` of columns, in Arrow batches; for tables of distinct places."""

    @F.pandas_udf("double")
    def km(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([geodesic_km(*x) for x in zip(a, b, c, d, strict=True)], dtype="float64")

    return km(lat1, lon1, lat2, lon2)
