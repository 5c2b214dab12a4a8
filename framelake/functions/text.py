"""Fixed-width text fields as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(record: Column, start: int, width: int) -> Column:
    """A field of a binary record (start from 0) as text; NUL is a space."""
    return F.translate(F.decode(F.substring(record, start + 1, width), "ISO-8859-1"), "\0", " ")


def parse_int(text: Column, strict: bool = True) -> Column:
    """An integer; blank is 0. Text that isn't one is null (status 103), or 0 if not strict."""
    t = F.trim(text)
    n = F.when(t == "", 0).when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int"))
    return n if strict else F.coalesce(n, F.lit(0))


def parse_float(text: Column) -> Column:
    """A float; blank is 0; the longest start that is a number counts; other characters than [0-9 +-eE.] give null."""
    n = F.regexp_extract(F.trim(text), r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", 0)
    return F.when(text.rlike(r"^[0-9 +\-eE.]*$"), F.coalesce(F.nullif(n, F.lit("")).try_cast("double"), F.lit(0.0)))


def parse_text(text: Column) -> Column:
    """Printable text, else null."""
    return F.when(text.rlike(r"^[\x20-\x7E]*$"), text)


def is_little_endian(code: Column) -> Column:
    """T4: NUL, space, U and Q are little, all others big."""
    return code.isin("\0", " ", "U", "Q")


def render_int(value: Column, width: int) -> Column:
    """T5: right-aligned; null if it doesn't fit."""
    t = F.lpad(value.cast("string"), width, " ")
    return F.when(F.length(value.cast("string")) <= width, t)


def render_float(value: Column) -> Column:
    """T5: twelve characters, six decimals; null if it doesn't fit."""
    t = F.format_string("%12f", value.cast("double"))
    return F.when(F.length(t) <= 12, t)


def padded_name(name: Column, width: int = 5) -> Column:
    """Cut or padded to a width."""
    return F.rpad(F.substring(name, 1, width), width, " ")


def plain_name(name: Column) -> Column:
    """Up to the first space."""
    return F.substring_index(name, " ", 1)
