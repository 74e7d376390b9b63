"""Calendar and atomic time."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# First days after a leap second, from 1993 on.
LEAPS = (date(1993, 7, 1), date(1994, 7, 1), date(1996, 1, 1), date(1997, 7, 1), date(1999, 1, 1), date(2006, 1, 1), date(2009, 1, 1), date(2012, 7, 1), date(2015, 7, 1), date(2017, 1, 1))
EPOCH = int(datetime(1993, 1, 1, tzinfo=UTC).timestamp())


def packed_hour(ts: Column) -> Column:
    """yyyymmddhh as a number."""
    return F.year(ts) * 1000000 + F.month(ts) * 10000 + F.dayofmonth(ts) * 100 + F.hour(ts)


def from_packed_hour(packed: Column) -> Column:
    part = lambda over, base: (F.floor(packed / over) % base).cast("int")
    return F.make_timestamp(part(1000000, 10000), part(10000, 100), part(100, 100), part(1, 100), F.lit(0), F.lit(0))


def formatted(ts: Column) -> dict[str, Column]:
    """A time as ``plain`` (yyyy-mm-dd hh:mm:ss), ``packed`` (yyyymmddhhmmss), ``stamp`` (yyyymmdd-hhmmss.000) and ``grads`` (hhZddmonyyyy, or hh:mmZddmonyyyy)."""
    return {
        "plain": F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), "packed": F.date_format(ts, "yyyyMMddHHmmss"),
        "stamp": F.concat(F.date_format(ts, "yyyyMMdd-HHmmss"), F.lit(".000")), "grads": F.concat(F.when(F.minute(ts) == 0, F.date_format(ts, "HH")).otherwise(F.date_format(ts, "HH:mm")), F.lit("Z"), F.lower(F.date_format(ts, "ddMMMyyyy"))),
    }


def boundary_times(time: Column, length: int, cycle: int, step: int, reference: Column, single_file: bool = False) -> dict[str, Column]:
    """Boundary files of a forecast from ``time`` over ``length`` seconds: when the parent run and the first boundary step began, steps
    skipped and taken from a file, and the files' times. All times are seconds; the parent starts every ``cycle`` seconds with one at ``reference`` and writes every ``step``."""
    if cycle % step:
        raise ValueError("a parent cycle must be a whole number of steps")
    parent = reference + F.floor((time - reference) / cycle) * cycle
    skip = F.floor((time - parent) / step)
    first = parent + skip * step
    steps = F.lit((length - 1) // step + 2)
    late = (first != time) & (first + (steps - 1) * step < time + length)
    total = steps + skip + F.when(late, 1).otherwise(0)
    per_file = total if single_file else F.lit(cycle // step)
    files = F.greatest(F.ceil(total / per_file), F.lit(1))
    times = F.transform(F.sequence(F.lit(0).cast("long"), files - 1), lambda k: parent + k * cycle)
    return {"parent_start": parent, "first_step": first, "skipped": skip, "steps": F.when(files == 1, total).otherwise(per_file), "files": files, "times": times}


def month_days(ts: Column) -> Column:
    return F.dayofmonth(F.last_day(ts))


def _since_epoch(day: date) -> int:
    return int(datetime(day.year, day.month, day.day, tzinfo=UTC).timestamp()) - EPOCH


def utc_to_tai(seconds: Column, leaps: Sequence[date] = LEAPS) -> Column:
    """Atomic seconds since 1993 of Unix seconds: leap seconds so far are added."""
    since = seconds - EPOCH
    out = since
    for day in leaps:
        out = out + F.when(since >= _since_epoch(day), 1).otherwise(0)
    return out


def tai_to_utc(tai: Column, leaps: Sequence[date] = LEAPS) -> tuple[Column, Column]:
    """(Unix seconds, second of the minute); within a leap second the first is a second early and the other is 60 or more."""
    out, second = tai, F.lit(None).cast("double")
    for k, day in enumerate(leaps):
        leap = _since_epoch(day) + k  # the leap second itself, on the atomic scale
        out = out - F.when(F.floor(tai) >= leap, 1).otherwise(0)
        second = F.when(F.floor(tai) == leap, 60.0 + tai - F.floor(tai)).otherwise(second)
    return out + EPOCH, F.coalesce(second, F.pmod(out, F.lit(60)).cast("double"))
