"""Identifiers: normal forms, paths, digests and overload suffixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: fixed values: the characters that count as white space
BLANKS = " \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def outer_trim(value: Column) -> Column:
    """Without white space of any kind at either end; only the ends are looked at."""
    return F.btrim(value, F.lit(BLANKS))


def symbol_id(value: Column) -> Column:
    """Normal form of a symbol id: outer blanks removed, ``\\`` as ``/``, empty as null; letter case counts."""
    text = F.replace(outer_trim(value), F.lit("\\"), F.lit("/"))
    return F.when(text != "", text)


def requirement_id(value: Column) -> Column:
    """Normal form of a requirement id: outer blanks removed, upper case, empty as null."""
    text = F.upper(outer_trim(value))
    return F.when(text != "", text)


def canonical_space(value: Column) -> Column:
    """Runs of white space as one blank, outer white space removed, null as empty."""
    return F.coalesce(F.trim(F.regexp_replace(value, r"(?U)\s+", " ")), F.lit(""))


def digest(value: Column, length: int) -> Column:
    """The first ``length`` hex digits of SHA-256."""
    return F.substring(F.sha2(value, 256), 1, length)


def posix_path(value: Column) -> Column:
    return F.translate(value, "\\", "/")


def symbol_path(value: Column) -> Column:
    """The path inside a symbol id, null where the id has none."""
    path = F.regexp_extract(value, r"^[^:]+:([^#]*)#", 1)
    return F.when(path != "", path)


def base_symbol_id(path: Column, qualified: Column, kind: Column, language: str = "ts") -> Column:
    """``language:path#qualified:kind``; an absolute path is an error when the row is evaluated."""
    clean = posix_path(path)
    made = F.concat(F.lit(f"{language}:"), clean, F.lit("#"), qualified, F.lit(":"), kind)
    return F.when(clean.rlike(r"^([A-Za-z]:/|/)"), F.raise_error(F.concat(F.lit("absolute path: "), clean)).cast("string")).otherwise(made)
