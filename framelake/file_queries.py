"""Named queries that write sequence files and read them back: headers, planes, auxiliary data, frames and fields, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.operators import auxiliary, headers, raster
from framelake.registry import query, table
from framelake.sources.shared import with_folder


def _header(spark, freq: str = "60", size: str = "QCIF", color: int = 2, progressive: bool = True) -> DataFrame:
    return headers.create_header(spark.createDataFrame([("a", color, freq, size, 0, progressive, "4:3")], "path string, color int, freq string, size string, ppl int, progressive boolean, ratio string"))


# --- headers ----------------------------------------------------------------------------------------------------------


@query("SELECT n_nationkey AS number, 0 AS status, CAST(n_nationkey * 3 AS INTEGER) AS nr_images, 59.94::DOUBLE AS ima_freq, 480 AS act_lines, 720 AS act_pixel, CASE WHEN n_nationkey % 2 = 0 THEN 'little' ELSE 'big' END AS byte_order, n_name AS description, CAST([1, 2, 2, 3][CAST(n_nationkey % 4 + 1 AS INTEGER)] AS INTEGER) AS nr_compon, n_name AS aux_name, CAST(n_regionkey * 10 AS INTEGER) AS max_size FROM nation UNION ALL SELECT 1000, 103, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL")
def header_scan(spark, sf_dir):
    """A file for each nation, with a header and nothing else, and one that isn't of the format; read as a table of headers."""
    from framelake.sources import codec, format as source

    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").collect()  # 25 rows at every scale
    four = spark.range(4).select(F.col("id").cast("string").alias("path"), F.col("id").cast("int").alias("color"), *[F.lit(v).alias(k) for k, v in (("freq", "60"), ("size", "SD"), ("ppl", 0), ("progressive", False), ("ratio", "4:3"))])
    made = [source.header_dict(r) for r in sorted(headers.create_header(four).collect(), key=lambda r: r["path"])]

    def scan(folder: str) -> DataFrame:
        for r in rows:
            h = made[r["n_nationkey"] % 4] | {"nr_images": r["n_nationkey"] * 3, "little_endian": r["n_nationkey"] % 2 == 0, "description": r["n_name"], "aux": [{"name": r["n_name"], "max_size": r["n_regionkey"] * 10, "description": b"\1\2"}]}
            with open(f"{folder}/{r['n_nationkey']}.seq", "wb") as f:
                f.write(codec.render_header(h))
        with open(f"{folder}/1000.seq", "wb") as f:
            f.write(b"nothing that is a header" * 99)
        s = source.read(spark, folder, level="header")
        aux = F.get(F.col("aux"), 0)
        return s.select(F.regexp_extract("path", r"([0-9]+)\.seq", 1).cast("int").alias("number"), "status", "nr_images", "ima_freq", "act_lines", "act_pixel", F.when(F.col("little_endian"), "little").when(~F.col("little_endian"), "big").alias("byte_order"), "description", "nr_compon", aux["name"].alias("aux_name"), aux["max_size"].alias("max_size"))

    return with_folder(spark, scan)


# --- planes -----------------------------------------------------------------------------------------------------------

FRAMES = 24


def _bytes(seed, n: int):
    """n bytes (a multiple of 32): a digest, repeated."""
    return F.repeat(F.md5(seed.cast("string")), n // 32).cast("binary")


@query(f"SELECT CAST(k // 2 + 1 AS INTEGER) AS image_no, CAST(k % 2 AS INTEGER) AS comp, [921600, 460800][CAST(k % 2 + 1 AS INTEGER)] AS bytes, sha256(repeat(md5(CAST(k AS VARCHAR)), [28800, 14400][CAST(k % 2 + 1 AS INTEGER)])) AS digest FROM (SELECT event_id AS k FROM events WHERE event_id < {2 * FRAMES})")
def frames_round_trip(spark, sf_dir):
    """1280 x 720 frames in 4:2:0, each plane written from a table, read back and told by its digest."""
    from framelake.sources import format as source

    h = source.header_dict(headers.set_num_frames(_header(spark, "60", "HDp"), F.lit(FRAMES)).first())
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").filter(k < 2 * FRAMES).select(F.floor(k / 2 + 1).cast("int").alias("image_no"), (k % 2).cast("int").alias("comp"), k)
    planes = e.select("image_no", "comp", F.when(F.col("comp") == 0, _bytes(k, 921_600)).otherwise(_bytes(k, 460_800)).alias("data"))

    def trip(folder: str) -> DataFrame:
        source.write(planes, f"{folder}/a.seq", h, bufferKb=64)
        s = source.read(spark, f"{folder}/a.seq", access="multiplexed", bufferKb=64)
        return s.select("image_no", "comp", F.octet_length("data").alias("bytes"), F.sha2("data", 256).alias("digest"))

    return with_folder(spark, trip)


@query("SELECT CAST(k + 1 AS INTEGER) AS image_no, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CAST((k * 641 + x * 53 + y * 19) % 16384 >> 4 AS INTEGER) AS value FROM (SELECT n_nationkey AS k FROM nation), (SELECT unnest(range(0, 8)) AS x), (SELECT unnest(range(0, 4)) AS y)")
def big_endian_samples(spark, sf_dir):
    """14 bit samples in the other byte order, written as planes and read as 10 bit samples, cut to 8 x 4."""
    from framelake.sources import format as source

    h = headers.set_data_format(_header(spark, "60", "QCIF", 0), F.lit("B*14"))
    h = source.header_dict(h.first()) | {"nr_images": 25, "little_endian": False}
    k, at = F.col("n_nationkey"), F.expr("sequence(0, 176 * 120 - 1)")
    value = lambda p: (k * 641 + p % 176 * 53 + F.floor(p / 176) * 19) % 16384
    n = table(spark, sf_dir, "nation").select(k.alias("n_nationkey"), at.alias("at"))
    text = F.array_join(F.transform("at", lambda p: F.lpad(F.hex(value(p)), 4, "0")), "")
    planes = n.select((k + 1).cast("int").alias("image_no"), F.lit(0).alias("comp"), F.unhex(text).alias("data"))

    def trip(folder: str) -> DataFrame:
        source.write(planes, f"{folder}/a.seq", h)
        return source.read(spark, f"{folder}/a.seq", level="sample", memFormat="10", width=8, height=4).select("image_no", "x", "y", "value")

    return with_folder(spark, trip)


@query("SELECT CAST(n_nationkey + 1 AS INTEGER) AS image_no, e AS aux_id, ['name', 'twice'][e + 1] AS name, CAST(length(n_name) * (e + 1) AS INTEGER) AS size, repeat(n_name, e + 1) AS payload FROM nation, (SELECT unnest([0, 1]) AS e)")
def aux_round_trip(spark, sf_dir):
    """Payloads of two entries of each image, appended to a file of planes."""
    from framelake.sources import format as source

    h = auxiliary.add_aux(_header(spark, "60", "QCIF", 0), F.lit("name"), F.lit(40))
    h = auxiliary.add_aux(auxiliary.add_aux(h, F.lit("none"), F.lit(0)), F.lit("twice"), F.lit(60))
    h = source.header_dict(h.drop("aux_id").first())
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("int").alias("image_no"), "n_name")
    planes = n.select("image_no", F.lit(0).alias("comp"), _bytes(F.col("image_no"), 176 * 120).alias("data"))
    payloads = n.select("image_no", F.explode(F.array(F.lit(0), F.lit(2))).alias("aux_id"), "n_name")
    payloads = payloads.select("image_no", "aux_id", F.repeat("n_name", F.when(F.col("aux_id") == 0, 1).otherwise(2)).cast("binary").alias("data"))

    def trip(folder: str) -> DataFrame:
        source.write(planes, f"{folder}/a.seq", h)
        source.write(payloads, f"{folder}/a.seq", h, append=True)
        s = source.read(spark, f"{folder}/a.seq", level="aux")
        return s.select("image_no", F.when(F.col("aux_id") == 2, 1).otherwise(F.col("aux_id")).alias("aux_id"), "name", "size", F.col("data").cast("string").alias("payload"))

    return with_folder(spark, trip)


@query("SELECT CAST(n_nationkey + 1 AS INTEGER) AS image_no, sha256(repeat(md5(CAST(n_nationkey + 1 AS VARCHAR)), 660)) AS digest FROM nation")
def stream_round_trip(spark, sf_dir):
    """A file read as a stream, image by image, and written by a stream."""
    from framelake.sources import format as source

    h = source.header_dict(_header(spark, "60", "QCIF", 0).first())
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("int").alias("image_no"))
    planes = n.select("image_no", F.lit(0).alias("comp"), _bytes(F.col("image_no"), 176 * 120).alias("data"))

    def trip(folder: str) -> DataFrame:
        source.write(planes, f"{folder}/a.seq", h)
        stream = spark.readStream.format("rasterseq").option("imagesPerPartition", "7").load(f"{folder}/a.seq").select("image_no", "comp", "data")
        clean = {k: v for k, v in h.items() if k != "status"} | {"nr_images": 0}
        q = stream.writeStream.format("rasterseq").option("header", repr(clean)).option("path", f"{folder}/b.seq").option("checkpointLocation", f"{folder}/state").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return source.read(spark, f"{folder}/b.seq").select("image_no", F.sha2("data", 256).alias("digest"))

    return with_folder(spark, trip)


# --- frames and fields, as planes of 8 x 4 bytes ----------------------------------------------------------------------


def _fields(spark, sf_dir) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.expr("event_id div 2").alias("frame"), (k % 2 + 1).cast("int").alias("field"), F.lit(8).alias("width"), F.lit(4).alias("height"), F.lit("B*8 ").alias("data_fmt"), F.md5(k.cast("string")).cast("binary").alias("data"))


_DIGESTS = "SELECT event_id, event_id // 2 AS frame, md5(CAST(event_id AS VARCHAR)) AS a, md5(CAST(event_id + 1 AS VARCHAR)) AS b, event_id = max(event_id) OVER () AS alone FROM events"
_WOVEN = " || ".join(f"substr({x}, {8 * i + 1}, 8)" for i in range(4) for x in "ab")


@query(f"SELECT frame, CAST(CASE WHEN alone THEN 4 ELSE 8 END AS INTEGER) AS height, CASE WHEN alone THEN a ELSE {_WOVEN} END AS plane FROM ({_DIGESTS}) WHERE event_id % 2 = 0")
def planes_weave(spark, sf_dir):
    return raster.weave_planes(_fields(spark, sf_dir)).select("frame", "height", F.col("data").cast("string").alias("plane"))


@query("SELECT event_id, CAST(f AS INTEGER) AS field, 2 AS height, CASE f WHEN 1 THEN substr(d, 1, 8) || substr(d, 17, 8) ELSE substr(d, 9, 8) || substr(d, 25, 8) END AS plane FROM (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS d FROM events), (SELECT unnest([1, 2]) AS f)")
def planes_split(spark, sf_dir):
    frames = _fields(spark, sf_dir).select((F.col("frame") * 2 + F.col("field") - 1).alias("event_id"), "height", "data")
    return raster.split_planes(frames).select("event_id", "field", "height", F.col("data").cast("string").alias("plane"))


@query("SELECT event_id, 5 AS width, 3 AS height, substr(d, 1, 5) || substr(d, 9, 5) || substr(d, 17, 5) AS plane FROM (SELECT event_id, md5(CAST(event_id AS VARCHAR)) AS d FROM events)")
def planes_crop(spark, sf_dir):
    frames = _fields(spark, sf_dir).select((F.col("frame") * 2 + F.col("field") - 1).alias("event_id"), "width", "height", "data_fmt", "data")
    return raster.crop_planes(frames, 5, 3).select("event_id", "width", "height", F.col("data").cast("string").alias("plane"))
