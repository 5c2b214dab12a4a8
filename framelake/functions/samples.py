"""Sample conversions as columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions.dims import DATA_FORMATS, MEMORY_FORMATS


def bits_of(file_fmt: str, mem_fmt: str = "AF") -> tuple[int, int]:
    """M4: bits of a sample in the file and in memory; raises ValueError with the status code."""
    if mem_fmt not in MEMORY_FORMATS:
        raise ValueError("820: illegal memory data format")
    if file_fmt not in DATA_FORMATS:
        raise ValueError("800: illegal file data format")
    f = DATA_FORMATS[file_fmt]
    return f, MEMORY_FORMATS[mem_fmt] or f


def _mask(bits: int) -> int:
    return (1 << bits) - 1


def read_bits(sample: Column, file_fmt: str, mem_fmt: str) -> Column:
    """M1: a file's sample in a memory format: mask, shift, and for 16_LSB the low byte. Always masked."""
    f, m = bits_of(file_fmt, mem_fmt)
    s = sample.bitwiseAND(F.lit(_mask(f)))
    s = F.shiftleft(s, m - f) if m > f else F.shiftright(s, f - m)
    return s.bitwiseAND(F.lit(0xFF if mem_fmt == "16_LSB" else 0xFFFF))


def write_bits(sample: Column, file_fmt: str, mem_fmt: str) -> Column:
    """M2: a memory sample in the file's format. AF masks by the file's bits; 16_LSB can't be written (820)."""
    if mem_fmt == "16_LSB":
        raise ValueError("820: illegal memory data format")
    f, m = bits_of(file_fmt, mem_fmt)
    s = sample.bitwiseAND(F.lit(_mask(m)))
    s = F.shiftleft(s, f - m) if f > m else F.shiftright(s, m - f)
    return s.bitwiseAND(F.lit(0xFF if f == 8 else 0xFFFF))


def no_conversion(file_fmt: str, mem_fmt: str, little_endian: bool, host_little: bool = True) -> bool:
    """M5: may the bytes pass as they are?"""
    f, m = bits_of(file_fmt, mem_fmt)
    return f == m and mem_fmt != "16_LSB" and f in (8, 16) and (f == 8 or little_endian == host_little)


def swap_bytes(sample: Column) -> Column:
    """M3: a 16-bit sample in the other byte order."""
    return F.shiftleft(sample.bitwiseAND(F.lit(255)), 8).bitwiseOR(F.shiftright(sample, 8).bitwiseAND(F.lit(255)))


def join_bytes(first: Column, second: Column, little_endian: bool = True) -> Column:
    """M3: a 16-bit sample of two bytes."""
    return first + second * 256 if little_endian else first * 256 + second


def half_to_float(half: Column) -> Column:
    """M6: value of a 16-bit float code, as double."""
    sign = F.when(F.shiftright(half, 15).bitwiseAND(F.lit(1)) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    e, m = F.shiftright(half, 10).bitwiseAND(F.lit(31)), half.bitwiseAND(F.lit(1023))
    finite = F.when(e == 0, m * F.lit(2.0**-24)).otherwise((m / F.lit(1024.0) + 1.0) * F.pow(F.lit(2.0), e - 15))
    return F.when((e == 31) & (m > 0), F.lit(float("nan"))).otherwise(sign * F.when(e == 31, F.lit(float("inf"))).otherwise(finite))


def half_codes(values: np.ndarray) -> np.ndarray:
    """M7 on arrays: codes of floats. Rounds half up in magnitude; below 2**-24 is zero; a NaN keeps its payload, never 0."""
    u = np.ascontiguousarray(values, np.float32).view(np.uint32).astype(np.int64)
    sign, exp, man = u >> 16 & 0x8000, u >> 23 & 255, u & 0x7FFFFF
    e = exp - 112
    normal = man + 0x1000
    carry = normal >> 23 & 1
    big = e + carry
    normal = np.where(carry == 1, 0, normal)
    out = np.where(big > 30, 0x7C00, big << 10 | normal >> 13)
    small = ((man | 0x800000) >> np.clip(1 - e, 0, 31)) + 0x1000 >> 13
    out = np.where(e <= 0, np.where(e < -9, 0, small), out)
    payload = np.where(man >> 13 == 0, 1, man >> 13)
    out = np.where(exp == 255, np.where(man == 0, 0x7C00, 0x7C00 | payload), out)
    return (sign | np.where((exp == 0) & (man == 0), 0, out)).astype(np.uint16)


def float_to_half(value: Column) -> Column:
    """M7 as a column; a NaN has the code 0x7E00."""
    x = F.abs(value.cast("float").cast("double"))
    two = lambda e: F.pow(F.lit(2.0), e)
    near = F.floor(F.log2(x))
    e = F.when(x >= two(near + 1), near + 1).when(x < two(near), near - 1).otherwise(near)
    normal = (e + 15) * 1024 + F.floor((x / two(e) - 1) * 1024 + 0.5)
    code = F.when(x < 2.0**-24, 0).when(x < 2.0**-14, F.floor(x * 2.0**24 + 0.5)).when(x >= 65536.0, 0x7C00).otherwise(F.least(normal, F.lit(0x7C00)))
    negative = F.when(value == 0, value.cast("string").startswith("-")).otherwise(value < 0)  # a zero's sign is in its text only
    return F.when(F.isnan(value), 0x7E00).when(value.isNotNull(), F.when(negative, code + 0x8000).otherwise(code)).cast("int")


def read_gain(raw: Column, offset: Column | float, gain: Column | float, kind: str = "double") -> Column:
    """M8: (raw - offset) / gain; integer kinds add 0.5 and truncate toward zero. kind: double, float, long, ulong, int, uint, short, ushort, char, uchar."""
    x = (raw.cast("double") - offset) / gain
    if kind in ("double", "float"):
        return x.cast(kind)
    target = {"long": "bigint", "ulong": "decimal(20,0)", "int": "int", "uint": "bigint", "short": "smallint", "ushort": "int", "char": "tinyint", "uchar": "smallint"}[kind]
    whole = x + F.lit(0.5)
    return F.when(whole < 0, F.ceil(whole)).otherwise(F.floor(whole)).cast(target)


def write_gain(value: Column, offset: Column | float, gain: Column | float, file_fmt: str = "I*2 ") -> Column:
    """M9: code of a value: value * gain + offset, rounded by + 0.5 and truncation, kept within the format's codes; R*2 is a half float."""
    if file_fmt == "R*2 ":
        return float_to_half((value * gain + offset).cast("float"))
    x = F.floor(value.cast("double") * gain + offset + F.lit(0.5))
    return F.least(F.greatest(x, F.lit(0)), F.lit(_mask(bits_of(file_fmt)[0]))).cast("int")


def hdr_gain(file_fmt: str) -> float:
    """Gain of float planes: largest code, 1 for half floats."""
    return 1.0 if file_fmt == "R*2 " else float(_mask(bits_of(file_fmt)[0]))


def hdr_read(raw: Column, file_fmt: str) -> Column:
    """Sample of a 4:4:4, RGB or XYZ component as float between 0 and 1."""
    return half_to_float(raw) if file_fmt == "R*2 " else raw.cast("double") / F.lit(hdr_gain(file_fmt))


def hdr_write(value: Column, file_fmt: str) -> Column:
    """The code of such a float."""
    return write_gain(value, F.lit(0.0), F.lit(hdr_gain(file_fmt)), file_fmt)


def gcd(a: Column, b: Column, steps: int = 48) -> Column:
    """Euclid's algorithm; 1 if either is 0 or less. 48 steps do for 32 bits."""
    first = F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.when(s["y"] != 0, s["x"] % s["y"]).otherwise(0).cast("long").alias("y")))
    return F.when((a <= 0) | (b <= 0), F.lit(1).cast("long")).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step, lambda s: s["x"]))


def largest_decimal(width: int) -> int:
    """The largest number that a field of so many characters holds."""
    return 10**width - 1


def add_offset(hi: Column, lo: Column, more: Column) -> tuple[Column, Column]:
    """A 64-bit position kept in two halves, and more; the halves of the sum."""
    total = hi.cast("long") * F.lit(2**32) + lo.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)) + more
    return F.shiftright(total, 32), total.bitwiseAND(F.lit(0xFFFFFFFF))
