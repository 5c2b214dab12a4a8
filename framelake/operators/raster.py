"""Planes, lines and samples: components, crops, frames and fields."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.functions import dims
from framelake.functions.samples import bits_of


def modes(spark) -> DataFrame:
    return spark.createDataFrame(dims.component_modes(), "color_format int, mode string, comps array<int>, mode_status int")


def select_components(planes: DataFrame, mode: str) -> DataFrame:
    """Planes (with color_format and comp) that a reading mode gives. A row whose format doesn't allow the mode is kept once an image, without data, with status."""
    table = F.broadcast(modes(planes.sparkSession).filter(F.col("mode") == mode).drop("mode"))
    j = planes.join(table, "color_format")
    fits = F.array_contains("comps", F.col("comp")) | ((F.col("mode_status") != 0) & (F.col("comp") == 0))
    return j.filter(fits).withColumn("status", F.col("mode_status")).drop("comps", "mode_status")


def requested_size(width: Column, height: Column, pss: Column, lss: Column, many: Column) -> tuple[Column, Column]:
    """Size of a component for a requested picture size."""
    from framelake.operators.headers import whole_div

    return whole_div(width, pss) * many, whole_div(height, lss)


def crop_samples(samples: DataFrame, width: Column | int, height: Column | int) -> DataFrame:
    """Samples (x, y) of the top left corner."""
    return samples.filter((F.col("x") < width) & (F.col("y") < height))


def split_lines(samples: DataFrame) -> DataFrame:
    """Field (1: even lines) and y in the field of each line y of a frame."""
    return samples.withColumns({"field": (F.col("y") % 2 + 1).cast("int"), "y": F.expr("cast(y div 2 as int)")})


def weave_lines(samples: DataFrame) -> DataFrame:
    """R2: the line in the frame of each line y of a field; field 1 has the even ones."""
    return samples.withColumn("y", (2 * F.col("y") + F.col("field") - 1).cast("int")).drop("field")


def samples_of(df: DataFrame, array: str, width: int, keep: tuple[str, ...]) -> DataFrame:
    """A row for each element of a row-major array: x, y, value."""
    e = df.select(*keep, F.posexplode(array).alias("_p", "value"))
    return e.select(*keep, (F.col("_p") % width).cast("int").alias("x"), F.expr(f"cast(_p div {width} as int)").alias("y"), "value")


def plane_of(samples: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The inverse: one row-major array `values` for each key. A plane is bounded by its size, so a group is."""
    g = samples.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("y", "x", "value"))).alias("_l"))
    return g.select(*keys, F.transform("_l", lambda s: s["value"]).alias("values"))


def demultiplex(samples: DataFrame) -> DataFrame:
    """Of a U/V component, U is every first and V every second sample."""
    return samples.withColumns({"comp_name": F.when(F.col("x") % 2 == 0, "U").otherwise("V"), "x": F.expr("cast(x div 2 as int)")})


# --- whole planes, on Arrow batches ------------------------------------------------------------------------------------


def _samples(data: bytes, fmt: str, little: bool) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if fmt == "B*8 " else "<u2" if little else ">u2").astype(np.uint16)


def read_planes(planes: DataFrame, mem_fmt: str = "AF") -> DataFrame:
    """M1 on whole planes (S6): data becomes little-endian 16-bit memory samples, `bits` their width."""
    bits_of("B*8 ", mem_fmt)

    @F.pandas_udf("binary")
    def convert(data: pd.Series, fmt: pd.Series, little: pd.Series) -> pd.Series:
        def one(d, f, e):
            if d is None:
                return None
            file, mem = bits_of(f, mem_fmt)
            s = _samples(d, f, e).astype(np.uint32) & ((1 << file) - 1)
            s = s << (mem - file) if mem > file else s >> (file - mem)
            return (s & (0xFF if mem_fmt == "16_LSB" else 0xFFFF)).astype("<u2").tobytes()

        return pd.Series([one(*x) for x in zip(data, fmt, little, strict=True)])

    bits = F.lit(dims.MEMORY_FORMATS[mem_fmt]) if dims.MEMORY_FORMATS[mem_fmt] else F.coalesce(*[F.when(F.col("data_fmt") == k, v) for k, v in dims.DATA_FORMATS.items()])
    return planes.withColumns({"data": convert("data", "data_fmt", "little_endian"), "bits": bits})


def write_planes(planes: DataFrame, mem_fmt: str = "AF") -> DataFrame:
    """M2 on whole planes (S7): data (little-endian 16-bit memory samples) becomes the file's bytes, in its byte order."""
    if mem_fmt == "16_LSB":
        raise ValueError("820: illegal memory data format")

    @F.pandas_udf("binary")
    def convert(data: pd.Series, fmt: pd.Series, little: pd.Series) -> pd.Series:
        def one(d, f, e):
            if d is None:
                return None
            file, mem = bits_of(f, mem_fmt)
            s = np.frombuffer(d, "<u2").astype(np.uint32) & ((1 << mem) - 1)
            s = s << (file - mem) if file > mem else s >> (mem - file)
            return s.astype(np.uint8 if f == "B*8 " else "<u2" if e else ">u2").tobytes()

        return pd.Series([one(*x) for x in zip(data, fmt, little, strict=True)])

    return planes.withColumn("data", convert("data", "data_fmt", "little_endian"))


def crop_planes(planes: DataFrame, width: int, height: int) -> DataFrame:
    """R4 on whole planes: the smaller of both sizes, from the top left."""

    @F.pandas_udf("binary")
    def cut(data: pd.Series, w: pd.Series, h: pd.Series, fmt: pd.Series) -> pd.Series:
        one = lambda d, w, h, f: np.frombuffer(d, np.uint8).reshape(h, w, -1)[:height, :width].tobytes() if d and w * h else b""
        return pd.Series([one(*x) for x in zip(data, w, h, fmt, strict=True)])

    return planes.withColumn("data", cut("data", "width", "height", "data_fmt")).withColumns({"width": F.least("width", F.lit(width)), "height": F.least("height", F.lit(height))})


def weave_planes(fields: DataFrame) -> DataFrame:
    """R2 on planes (path, frame, field, comp, width, height, data...): one plane for each frame and component; lines of field 1 first.

    A frame with one field alone is that field's lines.
    """
    cols = [c for c in fields.columns if c not in ("field", "data", "image_no", "height")]
    of = lambda k, c: F.first(F.when(F.col("field") == k, F.col(c)), ignorenulls=True)

    @F.pandas_udf("binary")
    def woven(a: pd.Series, b: pd.Series, ha: pd.Series, hb: pd.Series) -> pd.Series:
        def one(a, b, ha, hb):
            if a is None or b is None:
                return a if b is None else b
            n = len(a) // max(1, int(ha)) if len(a) else len(b) // max(1, int(hb))
            rows = np.concatenate([np.frombuffer(x, np.uint8).reshape(int(h), n) for x, h in ((a, ha), (b, hb))])
            return rows[np.argsort(np.concatenate([2 * np.arange(int(ha)), 2 * np.arange(int(hb)) + 1]), kind="stable")].tobytes()

        return pd.Series([one(*x) for x in zip(a, b, ha, hb, strict=True)])

    g = fields.groupBy(*cols).agg(of(1, "data").alias("_a"), of(2, "data").alias("_b"), of(1, "height").alias("_ha"), of(2, "height").alias("_hb"))
    height = (F.coalesce("_ha", F.lit(0)) + F.coalesce("_hb", F.lit(0))).cast("int")
    return g.select(*cols, height.alias("height"), woven("_a", "_b", F.coalesce("_ha", F.lit(0)), F.coalesce("_hb", F.lit(0))).alias("data"))


def split_planes(frames: DataFrame) -> DataFrame:
    """R3 on planes: two fields of each frame."""

    @F.pandas_udf("binary")
    def half(data: pd.Series, height: pd.Series, field: pd.Series) -> pd.Series:
        one = lambda d, h, k: None if d is None else np.frombuffer(d, np.uint8).reshape(max(1, h), -1)[k - 1 :: 2].tobytes()
        return pd.Series([one(*x) for x in zip(data, height, field, strict=True)])

    f = frames.withColumn("field", F.explode(F.array(F.lit(1), F.lit(2))))
    return f.withColumns({"data": half("data", "height", "field"), "height": F.floor((F.col("height") + 2 - F.col("field")) / 2).cast("int")})
