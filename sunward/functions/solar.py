"""Closed-form solar position (published low-precision series) as columns."""

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..config import Site
from . import clock


def _angle(ts: Column) -> Column:
    """Fraction of the year in radians."""
    hours = F.hour(ts) + F.minute(ts) / 60.0 + F.second(ts) / 3600.0
    return F.lit(2 * math.pi / 365.0) * (F.dayofyear(ts) - 1 + (hours - 12.0) / 24.0)


def equation_of_time(g: Column) -> Column:
    """Minutes."""
    return 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g)
                     - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))


def declination(g: Column) -> Column:
    """Radians."""
    return (0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g)
            + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g))


def refraction(elevation: Column) -> Column:
    """Atmospheric refraction in degrees for a true elevation in degrees."""
    e, t = elevation, F.tan(F.radians(elevation))
    high = 58.1 / t - 0.07 / F.pow(t, F.lit(3.0)) + 0.000086 / F.pow(t, F.lit(5.0))
    low = 1735.0 + e * (-518.2 + e * (103.4 + e * (-12.79 + e * 0.711)))
    arc = F.when(e > 85, F.lit(0.0)).when(e > 5, high).when(e > -0.575, low).otherwise(-20.774 / t)
    return arc / 3600.0


def with_geometry(df: DataFrame, site: Site, ts: str = "ts", offset: Column | None = None) -> DataFrame:
    """Apparent zenith/elevation, azimuth, incidence angle, solar and clock phase.

    Labels that name no single instant have NULL geometry. ``offset`` replaces
    the civil UTC offset, for testing another clock hypothesis.
    """
    t = F.col(ts)
    utc = clock.utc_offset_hours(t, site.standard_offset) if offset is None else offset
    df = df.withColumn("__g", _angle(t)).withColumn("__u", utc.cast("double"))
    g = F.col("__g")
    minutes = F.hour(t) * 60.0 + F.minute(t) + F.second(t) / 60.0
    solar = minutes + equation_of_time(g) + 4.0 * site.longitude - 60.0 * F.col("__u")
    df = df.withColumn("__h", F.radians(solar / 4.0 - 180.0)).withColumn("__d", declination(g))
    la, h, d = math.radians(site.latitude), F.col("__h"), F.col("__d")
    cosz = math.sin(la) * F.sin(d) + math.cos(la) * F.cos(d) * F.cos(h)
    df = df.withColumn("__e", 90.0 - F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosz)))))
    az = F.degrees(F.atan2(F.sin(h), F.cos(h) * math.sin(la) - F.tan(d) * math.cos(la))) + 180.0
    known = F.col("__u").isNotNull()
    df = df.withColumn("solar_elevation_deg", F.when(known, F.col("__e") + refraction(F.col("__e"))))
    df = df.withColumn("solar_zenith_deg", 90.0 - F.col("solar_elevation_deg"))
    df = df.withColumn("solar_azimuth_deg", F.when(known, az))
    z, tilt = F.radians("solar_zenith_deg"), math.radians(site.tilt)
    toward = F.cos(F.radians(F.col("solar_azimuth_deg") - site.azimuth))
    cosi = F.cos(z) * math.cos(tilt) + F.sin(z) * math.sin(tilt) * toward
    # least/greatest skip NULL, so unresolved labels are excluded first.
    df = df.withColumn("aoi_deg", F.when(known, F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosi))))))
    phase = F.when(F.col("solar_elevation_deg") > 0, F.when(F.col("solar_azimuth_deg") < 180, "AM").otherwise("PM"))
    df = df.withColumn("solar_phase", phase).withColumn("clock_phase", F.when(F.hour(t) < 12, "AM").otherwise("PM"))
    return df.withColumn("diagnostic_clock_valid", known).drop("__g", "__u", "__h", "__d", "__e")


def elevation(df: DataFrame, site: Site, out: str, ts: str = "ts") -> DataFrame:
    """Only the apparent elevation, under a chosen name."""
    keep = df.columns
    return with_geometry(df, site, ts).select(*keep, F.col("solar_elevation_deg").alias(out))
