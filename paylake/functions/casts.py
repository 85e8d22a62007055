"""From text to typed columns. Null stays null; text that does not parse becomes 0 (numbers) or null (dates, times)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UINT64_MAX = (1 << 64) - 1


def _unless_null(v: Column, out: Column) -> Column:
    return F.when(v.isNotNull(), out)


def big_int(v: Column) -> Column:
    """Unsigned 64-bit prefix of digits; 0 if there is none or it is too large."""
    n = F.regexp_extract(v, r"^[0-9]+", 0).try_cast("decimal(38,0)")
    return _unless_null(v, F.when(n <= F.lit(str(UINT64_MAX)).cast("decimal(20,0)"), n).otherwise(F.lit(0)).cast("decimal(20,0)"))


def _signed(v: Column, kind: str) -> Column:
    return _unless_null(v, F.coalesce(F.regexp_extract(v, r"^-?[0-9]+", 0).try_cast(kind), F.lit(0).cast(kind)))


def int32(v: Column) -> Column:
    return _signed(v, "int")


def int16(v: Column) -> Column:
    return _signed(v, "smallint")


def date(v: Column) -> Column:
    """Year, month and day at fixed places; impossible dates are null."""
    return F.concat_ws("-", F.substring(v, 1, 4), F.substring(v, 6, 2), F.substring(v, 9, 2)).try_cast("date")


def timestamp(v: Column) -> Column:
    """ISO date and time, milliseconds kept, offset subtracted; UTC without one. Needs a UTC session."""
    at = F.substring(v, 1, 19)
    fraction = F.regexp_extract(v, r"^.{19}\.([0-9]+)", 1)
    zone = F.regexp_extract(v, r"^.{19}(?:\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$", 1)
    ok = v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$")
    text = F.concat(at, F.lit("."), F.rpad(F.substring(fraction, 1, 3), 3, "0"), F.when(zone == "", "Z").otherwise(zone))
    return F.when(ok, text.try_cast("timestamp"))


def amount(v: Column) -> Column:
    """Unsigned with five decimal places; more are cut off, not rounded."""
    whole = F.regexp_extract(v, r"^([0-9]+)", 1)
    fraction = F.rpad(F.substring(F.regexp_extract(v, r"^[0-9]*\.([0-9]*)", 1), 1, 5), 5, "0")
    ok = v.rlike(r"^(?:[0-9]|\.[0-9])")
    n = F.concat(F.when(whole == "", "0").otherwise(whole), F.lit("."), fraction).try_cast("decimal(18,5)")
    # most are within the range and need one look
    plain = v.rlike(r"^[0-9]{1,13}(?:\.[0-9]{1,5})?\z")
    return _unless_null(v, F.coalesce(F.when(plain, v.try_cast("decimal(18,5)")).when(ok, n), F.lit(0).cast("decimal(18,5)")))


def amount_text(v: Column) -> Column:
    """An amount with exactly five decimal places."""
    return v.cast("decimal(18,5)").cast("string")


def id_text(v: Column) -> Column:
    """Base 10; an empty text for negative ids."""
    return F.when(v >= 0, v.cast("string")).when(v < 0, F.lit(""))


CASTS = {"str": lambda v: v, "big_int": big_int, "int": int32, "small_int": int16, "date": date, "ts": timestamp, "amount": amount}
