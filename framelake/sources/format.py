"""The data source `rasterseq`: sequence files as tables, and tables as sequence files.

Levels (option level): header, plane (default), line, sample, aux. Files are split by image ranges, and small files share a task. Filters on
image_no, frame, field, comp and com_code prune what is read where pushdown is asked for; the options components and images always do.
Paths with a scheme are read through Arrow's file systems; other paths, and all that are written, are on a file system
that all executors have mounted.
"""

from __future__ import annotations

import glob
import os
import shutil
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from framelake.functions.samples import bits_of
from framelake.plans.layout import PARTITION_BYTES, Layout
from framelake.sources import codec
from framelake.sources.codec import FormatError

PLANE = "path string, image_no int, frame int, field int, comp int, com_code string, width int, height int, data_fmt string, little_endian boolean, data binary"
LEVELS = {
    "plane": PLANE,
    "line": "path string, image_no int, frame int, field int, comp int, com_code string, y int, data_fmt string, little_endian boolean, data binary",
    "sample": "path string, image_no int, frame int, field int, comp int, com_code string, y int, x int, value int",
    "aux": "path string, image_no int, frame int, field int, aux_id int, name string, size int, data binary",
}
#: Bytes of payload in an Arrow batch, about.
BATCH_BYTES = 8 << 20


class Range(InputPartition):
    """What a task reads: images first to last of each path. Without a header, the task reads that itself, and all images of the file."""

    def __init__(self, path: str, header: dict | None = None, first: int = 1, last: int = 0, comps: tuple[int, ...] = (), more: tuple[str, ...] = ()):
        self.path, self.header, self.first, self.last, self.comps, self.more = path, header, first, last, comps, more


def _remote(path: str):
    """Arrow's file system and the path in it, for a path with a scheme; else None."""
    if "://" not in path:
        return None
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def opened(path: str, buffer_kb: int = 0) -> BinaryIO:
    if (far := _remote(path)) is not None:
        return far[0].open_input_file(far[1])
    return open(path, "rb", buffering=buffer_kb * 1024 if buffer_kb > 0 else -1)


def _files(options: dict) -> list[tuple[str, int]]:
    """Paths and sizes of one file, a pattern, or a folder; names that start with . or _ are left out."""
    path = options.get("path", "").removeprefix("file://")
    if (far := _remote(path)) is not None:
        from pyarrow import fs

        info = far[0].get_file_info(far[1])
        found = far[0].get_file_info(fs.FileSelector(far[1])) if info.type == fs.FileType.Directory else [info]
        scheme = path[: len(path) - len(far[1])]
        return sorted((scheme + i.path, i.size or 0) for i in found if i.type != fs.FileType.Directory and not i.base_name.startswith((".", "_")))
    found = sorted(glob.glob(os.path.join(path, "*"))) if os.path.isdir(path) else sorted(glob.glob(path)) or [path]
    with ThreadPoolExecutor(32) as pool:
        sizes = pool.map(lambda p: os.path.getsize(p) if os.path.isfile(p) else 0, found)
        return [(p, n) for p, n in zip(found, sizes, strict=True) if not os.path.basename(p).startswith((".", "_"))]


def read_header(path: str, buffer_kb: int = 0) -> dict:
    try:
        with opened(path, buffer_kb) as f:
            return codec.parse_header(f.read, path)
    except OSError as e:
        raise FormatError(100, str(e)) from e


def check_access(h: dict, options: dict) -> None:
    """May the file be read so? Options access (multiplexed, planar), fields (true) and components."""
    from framelake.sources.codec import color_of

    color, kind = color_of(h), options.get("access", "component")
    by_field = options.get("fields", "false").lower() == "true"
    if kind == "multiplexed" and color not in ((0, 1, 2) if by_field else (0, 1, 2, 7)):
        raise FormatError(242)
    if kind == "planar" and color not in (0, 3, 4, 5, 6, 8):
        raise FormatError(243)
    if by_field and h["interlace"] != 2:
        raise FormatError(210)
    for k in filter(None, options.get("components", "").split(",")):
        if not 0 <= int(k) < len(h["comp"]):
            raise FormatError(218)


def _position(h: dict, image: int) -> tuple[int, int]:
    return ((image + 1) // 2, 2 - image % 2) if h["interlace"] == 2 else (image, 0)


def _rows(part: Range, level: str, options: dict) -> Iterator[dict]:
    """Rows of a range of images; only the wanted components are read, width and height cut them from the top left."""
    lay = Layout(h := part.header)
    mem = options.get("memformat", "")
    wide, high = int(options.get("width", 0)), int(options.get("height", 0))
    with opened(part.path, int(options.get("bufferkb", 0))) as f:
        for image in range(part.first, part.last + 1):
            frame, field = _position(h, image)
            key = {"path": part.path, "image_no": image, "frame": frame, "field": field}
            if level == "aux":
                f.seek(lay.at(image))
                raw = f.read(lay.aux)
                for i, (at, most) in enumerate(codec.aux_slots(h["aux"])):
                    if at >= 0:
                        said = raw[at : at + 8].replace(b"\0", b" ").strip()
                        n = min(int(said) if said.isdigit() else 0, most)
                        yield key | {"aux_id": i, "name": h["aux"][i]["name"], "size": n, "data": raw[at + 8 : at + 8 + n]}
                continue
            for k in part.comps:
                c = h["comp"][k]
                f.seek(lay.at(image, k))
                raw = f.read(lay.planes[k])
                if len(raw) < lay.planes[k]:
                    raise FormatError(111, f"image {image} of {part.path}")
                each = 1 if c["data_fmt"] == "B*8 " else 2
                a = np.frombuffer(raw, np.uint8).reshape(c["lin_image"], c["pix_line"] * each)
                a = a[: high or None, : wide * each or None]
                base = key | {"comp": k, "com_code": c["com_code"], "data_fmt": c["data_fmt"], "little_endian": h["little_endian"]}
                if level == "plane":
                    yield base | {"width": a.shape[1] // each, "height": a.shape[0], "data": a.tobytes()}
                elif level == "line":
                    yield from (base | {"y": y, "data": line.tobytes()} for y, line in enumerate(a))
                else:
                    s = np.ascontiguousarray(a).view(np.uint8 if each == 1 else "<u2" if h["little_endian"] else ">u2").astype(np.int64)
                    if mem:
                        file, m = bits_of(c["data_fmt"], mem)
                        s = s & ((1 << file) - 1)
                        s = (s << (m - file) if m > file else s >> (file - m)) & (0xFF if mem == "16_LSB" else 0xFFFF)
                    yield base | {"samples": s}


def _constant(value, kind: pa.DataType, n: int) -> pa.Array:
    return pa.nulls(n, kind) if value is None else pa.repeat(pa.scalar(value, kind), n)


def _batches(rows: Iterator[dict], schema: pa.Schema, level: str) -> Iterator[pa.RecordBatch]:
    """Batches of about BATCH_BYTES; the samples of small planes share a batch, those of a large one are cut by lines."""
    held: list[dict] = []
    size = 0

    def out() -> pa.RecordBatch:
        if level != "sample":
            return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in held], f.type) for f in schema], schema=schema)
        shapes = [r["samples"].shape for r in held]
        made = {
            "value": np.concatenate([r["samples"].ravel() for r in held]), "x": np.concatenate([np.tile(np.arange(w, dtype=np.int32), h) for h, w in shapes]),
            "y": np.concatenate([np.repeat(np.arange(r["top"], r["top"] + h, dtype=np.int32), w) for r, (h, w) in zip(held, shapes, strict=True)]),
        }
        same = lambda f: pa.concat_arrays([_constant(r[f.name], f.type, r["samples"].size) for r in held])
        return pa.RecordBatch.from_arrays([pa.array(made[f.name]) if f.name in made else same(f) for f in schema], schema=schema)

    for r in rows:
        parts = [r]
        if level == "sample":
            s = r["samples"].astype(np.int32)
            lines = max(1, (1 << 18) // max(1, s.shape[1]))
            parts = [r | {"samples": s[top : top + lines], "top": top} for top in range(0, len(s), lines)]
        for x in parts:
            held.append(x)
            size += 32 * x["samples"].size if level == "sample" else len(x.get("data") or b"") + 64
            if size >= BATCH_BYTES:
                yield out()
                held, size = [], 0
    if held:
        yield out()


class SequenceReader(DataSourceReader):
    """Plans image ranges; each task opens its file, seeks and reads."""

    def __init__(self, schema: StructType, options: dict):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.options = {k.lower(): v for k, v in options.items()}
        self.level = self.options.get("level", "plane")
        self.arrow = to_arrow_schema(schema)
        self.limits: dict[str, list] = {}

    def _wanted(self, name: str, value) -> bool:
        tests = {"=": lambda a, b: a == b, "in": lambda a, b: a in b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
        return all(tests[op](value, x) for op, x in self.limits.get(name, ()))

    def _comps(self, h: dict) -> tuple[int, ...]:
        asked = self.options.get("components")
        return tuple(k for k, c in enumerate(h["comp"]) if (not asked or str(k) in asked.split(",")) and self._wanted("comp", k) and self._wanted("com_code", c["com_code"]))

    def _runs(self, h: dict, size: int) -> list[tuple[int, int]]:
        """Runs of images of a file that are wanted."""
        first, last = 1, Layout(h).images(size)
        if self.options.get("images"):
            a, _, b = self.options["images"].partition("-")
            first, last = max(first, int(a)), min(last, int(b or a))
        if not self.limits:
            return [(first, last)] if last >= first else []
        runs: list[tuple[int, int]] = []
        for n in range(first, last + 1):
            if self._wanted("image_no", n) and self._wanted("frame", _position(h, n)[0]) and self._wanted("field", _position(h, n)[1]):
                if runs and runs[-1][1] == n - 1:
                    runs[-1] = (runs[-1][0], n)
                else:
                    runs.append((n, n))
        return runs

    def _header(self, path: str) -> dict | None:
        """A file's header, if it is one of the format and may be read so; None for another one, where such files are passed over."""
        try:
            h = read_header(path, int(self.options.get("bufferkb", 0)))
            check_access(h, self.options)
            return h
        except FormatError:
            if self.options.get("mode", "FAILFAST").upper() == "PERMISSIVE":
                return None
            raise

    def partitions(self) -> list[InputPartition]:
        """Where there are fewer files than tasks, or files that are large, the driver reads their headers and plans image ranges; the many small
        files of a folder are dealt to tasks by their size alone."""
        files, tasks = _files(self.options), int(self.options.get("parallelism", 8))
        out: list[InputPartition] = []
        small: list[tuple[str, int]] = []
        for p, n in files:
            if self.level == "header" or (len(files) >= tasks and n <= PARTITION_BYTES):
                small.append((p, n))
            elif (h := self._header(p)) is not None:
                for a, b in self._runs(h, n):
                    out += [Range(p, h, x, y, self._comps(h)) for x, y in Layout(h).ranges(a, b, tasks, int(self.options.get("imagesperpartition", 0)))]
        each = 1 << 16 if self.level == "header" else PARTITION_BYTES  # a header is read alone, whatever the size of its file
        weights = [1024 if self.level == "header" else n for _, n in small]
        step = max(1, min(each, -(-sum(weights) // tasks)))
        group: list[str] = []
        held = 0
        for (p, _), n in zip(small, weights, strict=True):
            group.append(p)
            held += n
            if held >= step:
                out.append(Range("", more=tuple(group)))
                group, held = [], 0
        return out + [Range("", more=tuple(group))] * bool(group) or [Range("")]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if self.level == "header":
            rows = []
            for path in partition.more:
                try:
                    h = read_header(path)
                except FormatError as e:
                    if self.options.get("mode", "PERMISSIVE").upper() == "FAILFAST":
                        raise
                    h = {"path": path, "status": e.status}
                rows.append({k: h.get(k) for k in self.arrow.names})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=self.arrow)
            return
        yield from _batches(self._every(partition), self.arrow, self.level)

    def _every(self, partition: Range) -> Iterator[dict]:
        if partition.path:
            yield from _rows(partition, self.level, self.options)
        for path in partition.more:
            if (h := self._header(path)) is not None:
                with opened(path) as f:
                    size = f.seek(0, os.SEEK_END)
                for a, b in self._runs(h, size):
                    yield from _rows(Range(path, h, a, b, self._comps(h)), self.level, self.options)


class FilteringReader(SequenceReader):
    """The reader where the session allows pushdown; a reader that has pushFilters can't be loaded otherwise."""

    def pushFilters(self, filters):
        names = {EqualTo: "=", In: "in", LessThan: "<", LessThanOrEqual: "<=", GreaterThan: ">", GreaterThanOrEqual: ">="}
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if type(f) in names and column in ("image_no", "frame", "field", "comp", "com_code") and self.level != "header" and (self.level != "aux" or not column.startswith("com")):
                self.limits.setdefault(column, []).append((names[type(f)], f.value))
            else:
                yield f


class Done(WriterCommitMessage):
    def __init__(self, highest: int):
        self.highest = highest


def place(h: dict, lay: Layout, image: int, comp: int | None, aux_id: int | None, data: bytes) -> tuple[int, bytes]:
    """Where a plane (comp) or a payload (aux_id) of an image goes, and its bytes there; none for a payload of an entry without data."""
    if image < 1:
        raise FormatError(112, f"image {image}")
    if comp is not None:
        if not 0 <= comp < len(lay.planes):
            raise FormatError(219)
        if len(data) != lay.planes[comp]:
            raise FormatError(502, f"{len(data)} bytes for component {comp}")
        return lay.at(image, comp), data
    slots = codec.aux_slots(h["aux"])
    if aux_id is None or not 0 <= aux_id < len(slots):
        raise FormatError(205)
    at, most = slots[aux_id]
    if len(data) > most:
        raise FormatError(228)
    return (lay.at(image) + at, f"{len(data):8d}".encode() + data) if at >= 0 else (0, b"")


def placed(batches: Iterator[pa.RecordBatch], h: dict, lay: Layout) -> Iterator[tuple[int, int, bytes]]:
    """Image, position and bytes of each row of Arrow batches (image_no, comp or aux_id, data)."""
    for b in batches:
        column = lambda name: b.column(name).to_pylist() if name in b.schema.names else [None] * b.num_rows  # noqa: E731,B023
        data = b.column("data")
        for i, (image, comp, aux_id) in enumerate(zip(column("image_no"), column("comp"), column("aux_id"), strict=True)):
            raw = data[i].as_buffer() if data[i].is_valid else b""
            at, raw = place(h, lay, image, comp, aux_id, raw if comp is not None else bytes(raw))
            if len(raw):
                yield image, at, raw


class SequenceWriter(DataSourceArrowWriter):
    """Tasks write their images at their places: the same bytes at the same place if a task runs again.

    Overwrite writes to a file beside, which takes the place of the old one at commit. Append needs the file's own header (else 230), or makes the
    file if there is none; before a task changes bytes that were there, it keeps them in a file beside, and a job that fails puts these
    back and cuts the file to its old size. So a job that fails leaves what was there.
    """

    def __init__(self, options: dict, overwrite: bool = True):
        import ast

        o = {k.lower(): v for k, v in options.items()}
        self.path = o["path"].removeprefix("file://")
        if _remote(self.path) is not None:
            raise FormatError(101, "files are written to mounted file systems only")
        self.buffer = int(o.get("bufferkb", 0)) * 1024 or -1
        self.header = codec.normalised(ast.literal_eval(o["header"]))
        self.lay = Layout(self.header)
        self.append = (not overwrite or o.get("append", "false").lower() == "true") and os.path.exists(self.path)
        folder, name = os.path.split(os.path.abspath(self.path))
        self.beside = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
        self.size = 0
        if self.append:
            if not _same(read_header(self.path), self.header):
                raise FormatError(230)
            self.size = os.path.getsize(self.path)
        elif not os.access(folder, os.W_OK):
            raise FormatError(101, self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Done:
        from pyspark import TaskContext

        highest, context = 0, TaskContext.get()
        if not self.append:
            with os.fdopen(os.open(self.beside, os.O_RDWR | os.O_CREAT, 0o644), "r+b", buffering=self.buffer) as f:
                for image, at, raw in placed(iterator, self.header, self.lay):
                    highest = max(highest, image)
                    f.seek(at)
                    f.write(raw)
            return Done(highest)
        os.makedirs(self.beside, exist_ok=True)
        kept = f"{self.beside}/{context.attemptNumber():06d}-{context.taskAttemptId()}"
        with open(self.path, "r+b", buffering=0) as f, open(kept, "wb", buffering=0) as old:
            for image, at, raw in placed(iterator, self.header, self.lay):
                highest = max(highest, image)
                if at < self.size:
                    f.seek(at)
                    was = f.read(min(len(raw), self.size - at))
                    old.write(at.to_bytes(8, "little") + len(was).to_bytes(8, "little") + was)
                f.seek(at)
                f.write(raw)
        return Done(highest)

    def commit(self, messages: list[Done | None]) -> None:
        if not self.append:
            with os.fdopen(os.open(self.beside, os.O_RDWR | os.O_CREAT, 0o644), "r+b") as f:
                f.write(codec.render_header(self.header))
                f.truncate(max(f.seek(0, os.SEEK_END), self.lay.head + self.header["nr_images"] * self.lay.image))
            os.replace(self.beside, self.path)
        count_images(self.path, max([0, *(m.highest for m in messages if m)]))
        shutil.rmtree(self.beside, ignore_errors=True)

    def abort(self, messages: list[Done | None]) -> None:
        if self.append:
            restore(self.path, self.beside, self.size)
        elif os.path.exists(self.beside):
            os.remove(self.beside)


def restore(path: str, beside: str, size: int) -> None:
    """Puts back what the tasks of an append kept, later attempts first, and the file's old size."""
    with open(path, "r+b") as f:
        for name in sorted(os.listdir(beside), reverse=True) if os.path.isdir(beside) else ():
            with open(f"{beside}/{name}", "rb") as old:
                found = []
                while len(head := old.read(16)) == 16:
                    was = old.read(int.from_bytes(head[8:], "little"))
                    found.append((int.from_bytes(head[:8], "little"), was))
            for at, was in reversed(found):
                f.seek(at)
                f.write(was)
        f.truncate(size)
    shutil.rmtree(beside, ignore_errors=True)


def _same(a: dict, b: dict) -> bool:
    return {k: v for k, v in a.items() if k not in ("path", "nr_images", "status")} == {k: v for k, v in b.items() if k not in ("path", "nr_images", "status")}


def count_images(path: str, written: int) -> None:
    """The number in the header becomes the larger of itself and what was written; a gap at the end is filled with zeros."""
    h = read_header(path)
    lay, n = Layout(h), max(h["nr_images"], written)
    with open(path, "r+b") as f:
        if n > h["nr_images"]:
            f.write(f"{n:7d}".encode())
        if os.path.getsize(path) < lay.head + n * lay.image:
            f.truncate(lay.head + n * lay.image)


def rewrite_header(path: str, header: dict) -> int:
    """S3: replaces the header in place if it fits the data; the status (0, 117, 225, or that of the file)."""
    try:
        old = read_header(path)
    except FormatError as e:
        return e.status
    fixed = ("nr_images", "nr_compon", "nr_fd_recs", "nr_aux_data_recs", "bytes_rec", "little_endian", "nr_aux_hdr_recs", "interlace")
    area, parts = (lambda h: h["act_lines"] * h["act_pixel"]), (lambda h: [(c["lin_image"] * c["pix_line"], c["data_fmt"]) for c in h["comp"]])
    if any(old[k] != header[k] for k in fixed) or area(old) != area(header) or parts(old) != parts(header):
        return 117
    if header["nr_fd_recs"] == 0 and header["description"]:
        return 225
    if [a["max_size"] for a in old["aux"] if a["max_size"]] != [a["max_size"] for a in header["aux"] if a["max_size"]]:
        return 117
    with open(path, "r+b") as f:
        f.write(codec.render_header(header))
    return 0


class SequenceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rasterseq"

    def _level(self) -> str:
        return {k.lower(): v for k, v in self.options.items()}.get("level", "plane")

    def schema(self) -> str:
        if self._level() == "header":
            from framelake.operators.headers import SCHEMA

            return SCHEMA
        return LEVELS[self._level()]

    def reader(self, schema: StructType) -> DataSourceReader:
        push = {k.lower(): v for k, v in self.options.items()}.get("pushdown", "false").lower() == "true"
        return (FilteringReader if push else SequenceReader)(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return SequenceWriter(dict(self.options), overwrite)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        from framelake.streaming.format import SequenceStreamReader

        return SequenceStreamReader(schema, dict(self.options))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        from framelake.streaming.format import SequenceStreamWriter

        return SequenceStreamWriter(dict(self.options))


def register(spark: SparkSession, pushdown: bool = False) -> None:
    """Makes the format known to a session, and lets filters reach it."""
    spark.dataSource.register(SequenceSource)
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, level: str = "plane", pushdown: bool = False, **options):
    """The table of a level of one file, a pattern or a folder. Options components ("0,2") and images ("3-8") prune what is read.

    With pushdown, filters on positions prune too; but Spark 4.1 keeps what one query pushed in the relation, so a DataFrame that is read with
    pushdown must serve one query only. It is off by default for that.
    """
    register(spark, pushdown)
    return spark.read.format("rasterseq").options(level=level, pushdown=str(pushdown), **{k: str(v) for k, v in options.items()}).load(path)


def write(rows, path: str, header: dict, append: bool = False, **options) -> None:
    """Writes planes (image_no, comp, data) or payloads (image_no, aux_id, data) to one file with this header.

    A file that is there is replaced, once all is written; with append, it keeps its images and these are added or change. Rows are ordered by
    image and component within a task, so that each writes forward.
    """
    register(rows.sparkSession)
    keys = [c for c in ("image_no", "comp", "aux_id") if c in rows.columns]
    h = {k: v for k, v in header.items() if k != "status"}
    out = rows.select(*keys, "data").sortWithinPartitions(*keys).write.format("rasterseq").options(header=repr(h), **{k: str(v) for k, v in options.items()})
    out.mode("append" if append else "overwrite").save(path)


def header_dict(row) -> dict:
    """A row of `sequences` as the dict that write() takes."""
    h = row.asDict(recursive=True)
    return h | {"aux": [a | {"description": bytes(a["description"] or b"")} for a in h["aux"] or []], "description": h["description"] or ""}
