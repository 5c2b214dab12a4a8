"""Size algebra of a file: columns, and the same on numbers for planning."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that a task reads, about.
PARTITION_BYTES = 128 << 20


def component_bytes(pix_line: Column, lin_image: Column, data_fmt: Column) -> Column:
    return pix_line.cast("long") * lin_image * F.when(data_fmt == "B*8 ", 1).otherwise(2)


def image_bytes(comp: Column, aux_records: Column, bytes_rec: Column) -> Column:
    planes = F.aggregate(comp, F.lit(0).cast("long"), lambda n, c: n + component_bytes(c["pix_line"], c["lin_image"], c["data_fmt"]))
    return aux_records.cast("long") * bytes_rec + planes


def header_bytes(nr_fd_recs: Column, nr_compon: Column, bytes_rec: Column) -> Column:
    return (2 + nr_fd_recs + 2 * nr_compon).cast("long") * bytes_rec


def offset(image_no: Column, number: Column, comp: Column, aux_records: Column, bytes_rec: Column, head: Column) -> Column:
    """Position of a component (from 0) of an image (from 1)."""
    before = F.aggregate(F.slice(comp, 1, number), F.lit(0).cast("long"), lambda n, c: n + component_bytes(c["pix_line"], c["lin_image"], c["data_fmt"]))
    return head + (image_no - 1) * image_bytes(comp, aux_records, bytes_rec) + aux_records.cast("long") * bytes_rec + before


def image_number(frame: Column, field: Column, interlaced: Column) -> Column:
    """Number of the image that is a frame, or a field of one."""
    return F.when(interlaced, 2 * (frame - 1) + field).otherwise(frame)


class Layout:
    """The same for one header (a mapping with the fields of `sequences`)."""

    def __init__(self, h: Mapping):
        self.planes = [c["pix_line"] * c["lin_image"] * (1 if c["data_fmt"] == "B*8 " else 2) for c in h["comp"]]
        self.aux = h["nr_aux_data_recs"] * h["bytes_rec"]
        self.head = (2 + h["nr_fd_recs"] + 2 * len(h["comp"])) * h["bytes_rec"]
        self.image = self.aux + sum(self.planes)

    def at(self, image_no: int, comp: int = -1) -> int:
        """Position of an image's auxiliary data (-1) or of a component."""
        start = self.head + (image_no - 1) * self.image
        return start if comp < 0 else start + self.aux + sum(self.planes[:comp])

    def images(self, size: int) -> int:
        """Whole images in a file of so many bytes."""
        return max(0, (size - self.head) // self.image) if self.image else 0

    def ranges(self, first: int, last: int, parallel: int = 1, wanted: int = 0) -> list[tuple[int, int]]:
        """Image ranges (both ends included) of PARTITION_BYTES or less, at least `parallel` if there are so many images."""
        n = last - first + 1
        if n <= 0:
            return []
        step = wanted or max(1, min(PARTITION_BYTES // max(1, self.image), -(-n // max(1, parallel))))
        return [(a, min(last, a + step - 1)) for a in range(first, last + 1, step)]
