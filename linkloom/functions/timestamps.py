"""Moments written as ISO-8601 text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: date, clock time, fraction, offset; the offset may be missing and then means UTC
_ISO = (
    r"^\s*(\d{4})-(\d{2})-(\d{2})[Tt ]([01]\d|2[0-3]):([0-5]\d)(?::([0-5]\d)(?:[.,](\d{1,9}))?)?"
    r"\s*(?:[Zz]|([+-])(0\d|1[0-8]):?([0-5]\d)?)?\s*$"
)


def moment_micros(text: Column) -> Column:
    """Microseconds since 1970 UTC of an ISO-8601 text, null where the text names no real moment.

    Blank or ``T`` between date and time, 0 to 9 digits of a second (finer than a microsecond is cut),
    ``Z``, ``+hh:mm``, ``+hhmm``, ``+hh`` or no offset. Impossible days (February 30) and times give null,
    as do dates without a time.
    """
    part = lambda i: F.regexp_extract(text, _ISO, i)
    number = lambda i: F.when(part(i) == "", F.lit(0)).otherwise(part(i).cast("int"))
    second = F.concat(F.when(part(6) == "", F.lit("0")).otherwise(part(6)), F.lit("."), F.rpad(F.substring(part(7), 1, 6), 6, "0"))
    local = F.try_make_timestamp(part(1).cast("int"), part(2).cast("int"), part(3).cast("int"), part(4).cast("int"), part(5).cast("int"), second.cast("decimal(8,6)"), F.lit("UTC"))
    offset = (number(9) * 60 + number(10)) * F.when(part(8) == "-", F.lit(-60)).otherwise(F.lit(60))
    return F.when(text.rlike(_ISO), F.unix_micros(local) - offset.cast("bigint") * F.lit(1_000_000).cast("bigint"))
