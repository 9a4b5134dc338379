"""Timestamps are parsed by fields, never inferred; the result is whole microseconds since 1970."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = r"^(\d{4})-(\d{2})-(\d{2})[ T](\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,6}))?$"
NUMERIC = r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(?:\.(\d{1,6}))?$"


def parse_timestamp(token: Column, kind: str = "iso") -> Column:
    """Microseconds, or NULL for anything of another shape or with a field out of range.

    A fraction has one to six digits and is read as text (``.05`` is 50 000 microseconds); more
    digits are refused, not rounded.
    """
    shape = {"iso": ISO, "numeric": NUMERIC}[kind]
    t = F.trim(token)
    part = lambda k: F.regexp_extract(t, shape, k)
    number = lambda k: part(k).try_cast("int")
    day = F.concat_ws("-", part(1), part(2), part(3)).try_cast("date")
    inside = (number(4) < 24) & (number(5) < 60) & (number(6) < 60)
    seconds = number(4) * 3600 + number(5) * 60 + number(6)
    micros = F.unix_date(day).cast("long") * 86_400_000_000 + seconds.cast("long") * 1_000_000 + F.rpad(part(7), 6, "0").try_cast("long")
    return F.when(t.rlike(shape) & inside, micros)
