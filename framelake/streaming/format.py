"""Sequence files as streams: images as they are appended, and a sink that writes forward."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSourceStreamArrowWriter, DataSourceStreamReader
from pyspark.sql.types import StructType

from framelake.plans.layout import Layout
from framelake.sources import codec
from framelake.sources.format import Done, Range, _batches, _rows, check_access, _same, count_images, placed, read_header


class SequenceStreamReader(DataSourceStreamReader):
    """The offset is the number of images read; it only rises. An image that isn't complete yet is left for later.

    Ranges of images are read by the executors, as in the batch source.
    """

    def __init__(self, schema: StructType, options: dict):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.options = {k.lower(): v for k, v in options.items()}
        self.path = self.options["path"].removeprefix("file://")
        self.level = self.options.get("level", "plane")
        self.arrow = to_arrow_schema(schema)

    def initialOffset(self) -> dict:
        return {"image_no": int(self.options.get("startingimage", 1)) - 1}

    def latestOffset(self) -> dict:
        first = self.initialOffset()["image_no"]
        if not os.path.exists(self.path):
            return {"image_no": first}
        return {"image_no": max(first, Layout(read_header(self.path)).images(os.path.getsize(self.path)))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        h = read_header(self.path)
        check_access(h, self.options)
        every = tuple(range(len(h["comp"])))
        ranges = Layout(h).ranges(start["image_no"] + 1, end["image_no"], int(self.options.get("parallelism", 8)), int(self.options.get("imagesperpartition", 0)))
        return [Range(self.path, h, a, b, every) for a, b in ranges] or [Range(self.path, h, 1, 0, every)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        yield from _batches(_rows(partition, self.level, self.options), self.arrow, self.level)


class SequenceStreamWriter(DataSourceStreamArrowWriter):
    """Appends images in any order within a batch; gaps read as zeros. A header once written stays: another one for the same file is refused (116). Failures fail the batch."""

    def __init__(self, options: dict):
        import ast

        o = {k.lower(): v for k, v in options.items()}
        self.path = o["path"].removeprefix("file://")
        self.header = codec.normalised(ast.literal_eval(o["header"]))
        self.lay = Layout(self.header)
        if not os.path.exists(self.path):
            with open(self.path, "wb") as f:
                f.write(codec.render_header(self.header))
        elif not _same(read_header(self.path), self.header):
            raise codec.FormatError(116)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        highest = 0
        with open(self.path, "r+b") as f:
            for image, at, raw in placed(iterator, self.header, self.lay):
                highest = max(highest, image)
                f.seek(at)
                f.write(raw)
        return Done(highest)

    def commit(self, messages, batchId: int) -> None:
        count_images(self.path, max([0, *(m.highest for m in messages if m)]))

    def abort(self, messages, batchId: int) -> None:
        """What a failed batch wrote is written again, at the same places, when it is run again."""
