"""Text of XML documents and accounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\r"


def trim(v: Column) -> Column:
    return F.btrim(v, F.lit(BLANKS))


def ltrim(v: Column) -> Column:
    return F.ltrim(v, F.lit(BLANKS))


def rtrim(v: Column) -> Column:
    return F.rtrim(v, F.lit(BLANKS))


def escape(v: Column) -> Column:
    """For attribute values and text."""
    for c, name in (("&", "&amp;"), ('"', "&quot;"), ("'", "&apos;"), ("<", "&lt;"), (">", "&gt;")):
        v = F.replace(v, F.lit(c), F.lit(name))
    return v


def qname(fragment: Column) -> Column:
    """The name in a fragment's first tag."""
    return F.regexp_extract(fragment, r"^\s*<([^\s/>]+)", 1)


def element(name: str, *content: Column, attributes: str = "") -> Column:
    """An element around columns, which are not escaped here."""
    return F.concat(F.lit(f"<{name}{attributes}>"), *content, F.lit(f"</{name.split()[0]}>"))


def iso_date(v: Column) -> Column:
    return F.date_format(v, "yyyy-MM-dd")


def iso_time(v: Column) -> Column:
    return F.date_format(v, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
