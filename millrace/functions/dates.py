"""Dates: Column to Column; the moment "now" is always an argument."""

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = (
    "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "yyyy.MM.dd", "yyyyMMdd", "yyyy-MM-dd",
    "yyyy-MM-dd'T'HH:mm:ss.SSS", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm:ss", "yyyy.MM.dd HH:mm", "yyyy-MM", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "d MMM yyyy", "MM/dd/yyyy",
)


def parse_datetime(x: Column) -> Column:
    """A timestamp from any of FORMATS, UTC unless it says otherwise."""
    return F.coalesce(*(F.try_to_timestamp(x, F.lit(f)) for f in FORMATS))


def kst_converted(ts: Column) -> Column:
    """ISO text of a UTC moment in Korean time."""
    return F.concat(F.date_format(F.from_utc_timestamp(ts, "Asia/Seoul"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))


def kst_labelled(ts: Column) -> Column:
    """ISO text of a zoneless time that already is Korean."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def hours_since(ts: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0.0), (epoch_seconds(as_of) - epoch_seconds(ts)) / 3600)


def relative_hours(x: Column) -> Column:
    """Hours of "5분 전", "3시간 전", "2일 전", "1주 전"; 0 for "방금", null for anything else."""
    n = F.nullif(F.regexp_extract(x, "[0-9]+", 0), F.lit("")).cast("double")
    return F.when(x.contains("방금"), F.lit(0.0)).when(x.contains("분 전"), n / 60).when(x.contains("시간 전"), n).when(x.contains("일 전"), n * 24).when(x.contains("주 전"), n * 168)
