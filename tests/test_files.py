"""Sequence files on disk: jobs that fail leave what was there, many files, access rules, streams that are refused."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import samples
from framelake.operators import auxiliary, headers
from framelake.plans.layout import Layout
from framelake.sources import format as source

PLANE, PAYLOAD = "image_no int, comp int, data binary", "image_no int, aux_id int, data binary"


def header(spark, color=0, freq="50", progressive=True, **fields):
    rows = [("a", color, freq, "QCIF", 0, progressive, "4:3")]
    h = headers.create_header(spark.createDataFrame(rows, "path string, color int, freq string, size string, ppl int, progressive boolean, ratio string"))
    h = auxiliary.add_aux(h, F.lit("note"), F.lit(20)).drop("aux_id")
    return source.header_dict(h.first()) | fields


@pytest.fixture
def two(spark, tmp_path):
    """A file of two images with payloads, its header and bytes."""
    h, path = header(spark), tmp_path / "two.seq"
    source.write(spark.createDataFrame([(i, 0, bytes([i]) * Layout(h).planes[0]) for i in (1, 2)], PLANE), str(path), h)
    source.write(spark.createDataFrame([(1, 0, b"abc"), (2, 0, b"d")], PAYLOAD), str(path), h, append=True)
    return path, h, path.read_bytes()


def test_failed_appends_leave_the_file(spark, two, tmp_path):
    path, h, was = two
    n = Layout(h).planes[0]
    with pytest.raises(Exception, match="228"):
        source.write(spark.createDataFrame([(1, 0, b"x" * 21)], PAYLOAD), str(path), h, append=True)
    assert path.read_bytes() == was
    rows = [(1, 0, b"\7" * n), (2, 0, b"\7" * n), (3, 0, b"\7" * n), (9, 0, b"short")]  # old images change and new ones are written before the last row fails
    with pytest.raises(Exception, match="502"):
        source.write(spark.createDataFrame(rows, PLANE).coalesce(1), str(path), h, append=True)
    assert path.read_bytes() == was
    with pytest.raises(Exception, match="230"):
        source.write(spark.createDataFrame(rows[:1], PLANE), str(path), h | {"ima_freq": 60.0}, append=True)
    assert path.read_bytes() == was and [p.name for p in tmp_path.iterdir()] == ["two.seq"]


def test_failed_overwrite_leaves_the_file(spark, two, tmp_path):
    path, h, was = two
    with pytest.raises(Exception, match="219"):
        source.write(spark.createDataFrame([(1, 0, b"\7" * Layout(h).planes[0]), (1, 5, b"")], PLANE), str(path), h)
    assert path.read_bytes() == was and [p.name for p in tmp_path.iterdir()] == ["two.seq"]


def test_save_modes(spark, two):
    path, h, was = two
    n = Layout(h).planes[0]
    rows = spark.createDataFrame([(4, 0, b"\7" * n)], PLANE)
    out = lambda mode: rows.write.format("rasterseq").options(header=repr({k: v for k, v in h.items() if k != "status"})).mode(mode).save(str(path))
    out("append")
    got = {r["image_no"]: bytes(r["data"]) for r in source.read(spark, str(path)).collect()}
    assert got == {1: b"\1" * n, 2: b"\2" * n, 3: b"\0" * n, 4: b"\7" * n} and source.read_header(str(path))["nr_images"] == 4
    assert path.read_bytes()[Layout(h).head : len(was)] == was[Layout(h).head :]
    source.write(spark.createDataFrame([(2, 0, b"\5" * n)], PLANE), str(path), h, append=True)
    assert path.read_bytes()[Layout(h).at(2, 0) :][:n] == b"\5" * n
    out("overwrite")
    assert [r["image_no"] for r in source.read(spark, str(path)).orderBy("image_no").collect()] == [1, 2, 3, 4] and source.read(spark, str(path), images="1-3").filter("data != X''").filter(F.col("data") != F.lit(b"\0" * n)).count() == 0
    source.write(rows.limit(0), str(path), h | {"nr_images": 1})
    assert source.read(spark, str(path)).count() == 1


def test_access_rules(spark, tmp_path):
    def made(name, **k):
        h = header(spark, **k)
        source.write(spark.createDataFrame([(i, c, bytes(n)) for i in (1, 2) for c, n in enumerate(Layout(h).planes)], PLANE), str(tmp_path / name), h)
        return str(tmp_path / name)

    multiplexed, planar, fields = made("m.seq", color=2), made("p.seq", color=5), made("f.seq", color=2, progressive=False)
    assert source.read(spark, multiplexed, access="multiplexed").count() == 4 and source.read(spark, planar, access="planar").count() == 6
    assert source.read(spark, fields, access="multiplexed", fields="true").count() == 4
    for path, options, code in ((planar, {"access": "multiplexed"}, 242), (multiplexed, {"access": "planar"}, 243), (multiplexed, {"fields": "true"}, 210), (multiplexed, {"components": "0,2"}, 218)):
        with pytest.raises(Exception, match=str(code)):
            source.read(spark, path, **options).count()
    assert source.read(spark, str(tmp_path), access="planar", mode="PERMISSIVE").count() == 6


def test_many_small_files(spark, tmp_path):
    h = header(spark)
    raw = []
    for i in range(40):
        path = tmp_path / f"{i:02}.seq"
        if not raw:
            source.write(spark.createDataFrame([(k, 0, bytes([k]) * Layout(h).planes[0]) for k in (1, 2, 3)], PLANE), str(path), h)
            raw.append(path.read_bytes())
        path.write_bytes(raw[0])
    (tmp_path / "_left_out").write_bytes(b"x")
    planes = source.read(spark, str(tmp_path))
    assert planes.rdd.getNumPartitions() <= 12 and planes.count() == 120
    assert source.read(spark, str(tmp_path), images="2-3", pushdown=True).filter("image_no = 3").count() == 40
    heads = source.read(spark, str(tmp_path), level="header")
    assert heads.rdd.getNumPartitions() <= 12 and heads.filter("status = 0 AND nr_images = 3").count() == 40
    assert source.read(spark, str(tmp_path), level="sample", images="1").agg(F.sum("value")).first()[0] == 40 * Layout(h).planes[0]
    assert source.read(spark, f"file://{tmp_path}/0*.seq").count() == 30


def test_a_stream_keeps_its_header(spark, two, tmp_path):
    path, h, _ = two
    source.register(spark)
    clean = {k: v for k, v in h.items() if k != "status"}
    for k, freq in enumerate((50.0, 60.0)):
        rows = spark.readStream.format("rasterseq").load(str(path)).select("image_no", "comp", "data")
        q = rows.writeStream.format("rasterseq").option("header", repr(clean | {"ima_freq": freq, "nr_images": 0})).option("path", str(tmp_path / "out.seq")).option("checkpointLocation", str(tmp_path / f"c{k}")).start()
        if k:
            with pytest.raises(Exception, match="116"):
                q.processAllAvailable()
        else:
            q.processAllAvailable()
        q.stop()


def test_native_half_codes(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=3000) * 2.0 ** rng.integers(-30, 20, 3000), 2.0 ** np.arange(-30, 20), 2.0 ** np.arange(-30, 20) * (1 - 2.0**-24), [0.0, -0.0, 65504.0, 65519.9, 65520.0, -1e9, np.inf, -np.inf]]).astype(np.float32)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v float")
    got = [r["h"] for r in df.orderBy("i").select(samples.float_to_half(F.col("v")).alias("h")).collect()]
    assert got == samples.half_codes(x).astype(int).tolist()
    odd = spark.createDataFrame([(float("nan"),), (None,)], "v float").select(samples.float_to_half(F.col("v"))).collect()
    assert [r[0] for r in odd] == [0x7E00, None]
