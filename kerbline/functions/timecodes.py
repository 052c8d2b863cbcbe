"""Time codes: camera file names, UTC and GPS time. Times are microseconds since 1970 as longs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: GPS time starts on 1980-01-06 and is ahead of UTC by 18 leap seconds; a week.
GPS_EPOCH, LEAP, WEEK = 315_964_800_000_000, 18_000_000, 604_800_000_000


def gps_micros(us: Column) -> Column:
    return us + F.lit(LEAP) - F.lit(GPS_EPOCH)


def gps_week(us: Column) -> Column:
    return F.floor(gps_micros(us) / WEEK).cast("long")


def gps_week_micros(us: Column) -> Column:
    return F.pmod(gps_micros(us), F.lit(WEEK))


def utc_micros(week: Column, week_micros: Column) -> Column:
    return week * F.lit(WEEK) + week_micros + F.lit(GPS_EPOCH) - F.lit(LEAP)


def filename_part(image: str, key: str) -> Column:
    """A part of ``name{key-value;...}.jpg``; null where it is absent. Values may hold dashes."""
    inside = F.regexp_extract(F.col(image), r"\{([^}]*)\}", 1)
    parts = F.filter(F.split(inside, ";"), lambda p: p.startswith(f"{key}-"))
    return F.substring(F.get(parts, F.lit(0)), F.lit(len(key) + 2), F.length(inside))


def filename_utc_micros(image: str) -> Column:
    """The instant in a name's utc part, to the millisecond; null where it does not parse."""
    at = F.try_to_timestamp(filename_part(image, "utc"), F.lit("yyyyMMdd_HH-mm-ss-SSS"))
    # Through the local date and time, so that the session's time zone does not matter.
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at.cast("timestamp_ntz"))


def seconds_of_day(image: str) -> Column:
    """Seconds since midnight from ``_HH-mm-ss``; 0 where the name does not have it."""
    part = lambda i: F.regexp_extract(F.col(image), r"_(\d{2})-(\d{2})-(\d{2})", i).try_cast("int")
    return F.coalesce(part(1) * 3600 + part(2) * 60 + part(3), F.lit(0))


def pass_of(image: str, split: int) -> Column:
    return F.when(seconds_of_day(image) < split, "pass1").otherwise("pass2")


def sync_records(images: DataFrame, image: str = "image", exif: str = "exif_us", use_name: bool = True) -> DataFrame:
    """Adds utc_us, gps_week and sow_us: the instant in the file's name, else that of its Exif data (microseconds,
    null if there is none); images without any go."""
    at = F.coalesce(filename_utc_micros(image), F.col(exif)) if use_name else F.col(exif)
    timed = images.withColumn("utc_us", at).where("utc_us IS NOT NULL")
    return timed.withColumn("gps_week", gps_week(F.col("utc_us"))).withColumn("sow_us", gps_week_micros(F.col("utc_us")))
