"""Auxiliary data: the catalogue in a header and where its payloads are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import dims

#: Bytes of an entry besides its description; of a payload's length.
ENTRY, LENGTH = 48, 8


def data_bytes(aux: Column) -> Column:
    """Bytes that the payloads of one image may take: size and length of each entry with data."""
    return F.aggregate(aux, F.lit(0).cast("long"), lambda n, a: n + F.when(a["max_size"] > 0, a["max_size"] + LENGTH).otherwise(0))


def data_records(aux: Column, bytes_rec: Column) -> Column:
    return F.ceil(data_bytes(aux) / bytes_rec).cast("int")


def data_offset(aux: Column, number: Column) -> Column:
    """Position of an entry's payload in the image's auxiliary data; payloads of entries before it come first."""
    return data_bytes(F.slice(aux, 1, number))


def catalogue_bytes(aux: Column) -> Column:
    return F.aggregate(aux, F.lit(LENGTH).cast("long"), lambda n, a: n + ENTRY + F.coalesce(F.octet_length(a["description"]), F.lit(0)))


def entry_number(name: Column) -> Column:
    """Q14: the first entry of that name (16 characters count), -1 if none has it."""
    cut = F.rtrim(F.substring(name, 1, 16))
    return F.coalesce(F.array_position(F.transform("aux", lambda a: F.rtrim(a["name"])), cut), F.lit(0)).cast("int") - 1


def entry(number: Column) -> tuple[Column, Column]:
    """Q14: the entry, and 205 if there is none."""
    return F.get(F.col("aux"), number), F.when((number < 0) | (number >= F.size("aux")), 205).otherwise(0)


def add_aux(df: DataFrame, name: Column, max_size: Column, description: Column | None = None) -> DataFrame:
    """aux_id is the new entry's number, -1 for a name that is there already or a catalogue beyond 16 KiB."""
    cut = F.substring(name, 1, 16)
    made = F.struct(cut.alias("name"), max_size.cast("int").alias("max_size"), (F.lit(b"") if description is None else description).cast("binary").alias("description"))
    more = F.array_append("aux", made)
    fine = (entry_number(name) < 0) & (catalogue_bytes(more) <= dims.AUX_BYTES)
    return df.withColumns({"aux": F.when(fine, more).otherwise(F.col("aux")), "aux_id": F.when(fine, F.size("aux")).otherwise(-1), "nr_aux_data_recs": data_records(F.when(fine, more).otherwise(F.col("aux")), F.col("bytes_rec")), "status": F.lit(0)})


def remove_aux(df: DataFrame, number: Column) -> DataFrame:
    """205 if there is no such entry; later entries move up."""
    fine = (number >= 0) & (number < F.size("aux"))
    less = F.when(fine, F.filter("aux", lambda a, i: i != number)).otherwise(F.col("aux"))
    return df.withColumns({"aux": less, "nr_aux_data_recs": data_records(less, F.col("bytes_rec")), "status": F.when(fine, 0).otherwise(205)})


def payload_status(size: Column, max_size: Column) -> Column:
    """228 for a payload that is too long."""
    return F.when(size > max_size, 228).otherwise(0)
