"""Golden bytes, round trips and status codes of the raster engine."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from framelake.functions import dims, samples
from framelake.operators import auxiliary, headers, raster
from framelake.plans.layout import Layout
from framelake.sources import codec
from framelake.sources import format as source


def requests(spark, rows):
    return spark.createDataFrame(rows, "path string, color int, freq string, size string, ppl int, progressive boolean, ratio string")


@pytest.fixture(scope="module")
def hdp(spark):
    h = headers.set_num_frames(headers.create_header(requests(spark, [("a", 2, "60", "HDp", 0, True, "4:3")])), F.lit(500))
    return source.header_dict(h.first())


def test_golden_header(hdp):
    raw = codec.render_header(hdp)
    lay = Layout(hdp)
    assert (len(raw), lay.head, lay.image, lay.at(1, 1)) == (21504, 21504, 1_382_400, 21504 + 921_600)
    assert lay.head + 500 * lay.image == 691_221_504
    records = [raw[i : i + 512] for i in range(0, len(raw), 512)]
    assert records[0][:60] == b"    500    2   36    0VIDEO                        512U   32"
    assert records[1][:60] == b"   59.940000   44.955000   74.250000   720  1280 1    4    3"
    assert not any(records[2]) and records[6][:8] == b"       8"
    assert [records[k][:n] for k, n in ((38, 16), (39, 17), (40, 16), (41, 17))] == [b"   720  1280B*8 ", b" 1 1 1 0 0 0Y    ", b"   360  1280B*8 ", b" 1 2 2 0 0 0U/V  "]


def test_header_bytes_round_trip(hdp):
    h = {**hdp, "description": "a\nb", "aux": [{"name": "x", "max_size": 5, "description": b"\1\2"}, {"name": "y", "max_size": 0, "description": b""}]}
    back = codec.normalised(h)
    assert {k: v for k, v in back.items() if k != "status"} == {k: v for k, v in h.items() if k != "status"}
    for cut in (0, 59, 700, 3000, 21000):
        with pytest.raises(codec.FormatError) as e:
            codec.parse_header(io.BytesIO(codec.render_header(h)[:cut]).read)
        assert e.value.status == 103


def test_half_floats(spark):
    codes = np.array([c for c in range(31745)] + [c | 0x8000 for c in range(31745)], np.uint16)
    assert np.array_equal(samples.half_codes(codes.view(np.float16).astype(np.float32)), codes)
    assert samples.half_codes(np.array([65504.0, -65536.0, 0.0123, 1 + 2.0**-11, np.nan], np.float32)).tolist() == [0x7BFF, 0xFC00, 0x224C, 0x3C01, 0x7E00]
    got = spark.createDataFrame([(0xD140,), (0x7C00,), (1,)], "h int").select(samples.half_to_float(F.col("h"))).collect()
    assert [r[0] for r in got] == [-42.0, float("inf"), 2.0**-24]


def test_bits(spark):
    df = spark.range(0, 65536, 37).select(F.col("id").cast("int").alias("s"))
    for fmt, mem in ((f, m) for f in ("B*8 ", "B*10", "B*14", "I*2 ") for m in ("8", "12", "16", "AF")):
        file, m = samples.bits_of(fmt, mem)
        read = samples.read_bits(F.col("s"), fmt, mem)
        want = F.expr(f"(s & {2**file - 1}) * {2 ** max(0, m - file)} div {2 ** max(0, file - m)}")
        assert df.filter(read != want).count() == 0
        if m >= file:
            assert df.filter(samples.write_bits(read, fmt, mem) != F.col("s").bitwiseAND(F.lit(2**file - 1))).count() == 0
    with pytest.raises(ValueError, match="820"):
        samples.write_bits(F.col("s"), "B*8 ", "16_LSB")


def test_gain_truncates_toward_zero(spark):
    df = spark.createDataFrame([(0,), (10,), (255,)], "r int")
    assert [r[0] for r in df.select(samples.read_gain(F.col("r"), F.lit(11.0), F.lit(1.0), "int")).collect()] == [-10, 0, 244]
    assert [r[0] for r in df.select(samples.write_gain(F.col("r"), F.lit(-5.0), F.lit(10.0), "B*8 ")).collect()] == [0, 95, 255]


def test_creation(spark):
    rows = [("ok", 0, "50", "SD", 0, False, "auto"), ("700", 0, "50", "HDp", 0, True, "4:3"), ("701", 0, "60", "HDp", 0, False, "4:3"), ("702", 0, "60", "HDi", 0, True, "4:3"), ("703", 7, "25", "SD", 0, False, "4:3"), ("400", 0, "75", "SD", 0, False, "4:3"), ("710", 0, "50", "SD", 100, False, "4:3"), ("600", 0, "50", "SD", 0, False, "x"), ("stream", 7, "25", "SD", 864, True, "auto"), ("stream0", 7, "25", "SD", 0, True, "auto")]
    got = {r["path"]: r for r in headers.create_header(requests(spark, rows)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {k: int(k) if k.isdigit() else 0 for k in got}
    sd = got["ok"]
    assert (sd["act_lines"], sd["act_pixel"], sd["interlace"], sd["lin_freq"], sd["pix_freq"], sd["comp"][0]["lin_image"]) == (576, 720, 2, 15.625, 13.5, 288)
    assert (got["stream"]["h_pp_size"], got["stream0"]["h_pp_size"]) == (16, 4)
    checked = headers.check_header(headers.create_header(requests(spark, [(str(c), c, "50", "SD", 0, c == 7 or c == 6, "auto") if c != 7 else ("7", 7, "25", "SD", 0, True, "auto") for c in range(9)])))
    assert {int(r["path"]): (r["color_format"], r["status"]) for r in checked.collect()} == {c: (c, 0) for c in range(9)}


def test_statuses(spark):
    base = headers.create_header(requests(spark, [("a", 6, "50", "SD", 0, True, "4:3")]))
    c = lambda **k: F.transform("comp", lambda x, i: headers.replaced(x, **{n: F.when(i == 0, v).otherwise(x[n]) for n, v in k.items()}))
    cases = {
        199: {"nr_images": F.lit(10_000_000)}, 200: {"nr_compon": F.lit(129)}, 229: {"nr_aux_hdr_recs": F.lit(33)}, 500: {"act_lines": F.lit(1_000_000)}, 501: {"interlace": F.lit(3)}, 502: {"comp": c(lin_image=F.lit(-1))},
        204: {"comp": c(tem_sbsmpl=F.lit(2))}, 206: {"comp": c(lin_sbsmpl=F.lit(100))}, 207: {"comp": c(pix_sbsmpl=F.lit(100))}, 503: {"comp": c(pix_phshft=F.lit(100))}, 222: {"comp": c(lin_image=F.lit(5))}, 300: {"comp": c(com_code=F.lit("Q    "))}, 800: {"comp": c(data_fmt=F.lit("C*3 "))}, 810: {"comp": c(data_fmt=F.lit("B*10"))},
    }
    for code, change in cases.items():
        assert headers.check_header(base.withColumns(change)).first()["status"] == code
    with pytest.raises(Exception, match="501"):
        headers.check_header(base.withColumns(cases[501]), strict=True).collect()
    assert set(dims.STATUS) >= set(cases)


def test_components(spark):
    h = headers.create_header(requests(spark, [("a", 2, "50", "SD", 0, False, "4:3")]))
    h = headers.add_component(h)
    assert h.first()["comp_id"] == 2
    h = headers.set_component(h, F.lit(2), F.lit("alpha7"), F.lit("B*8 "), F.lit(2), F.lit(2))
    assert h.first()["comp"][2].asDict() | {} == {**h.first()["comp"][2].asDict(), "com_code": "alpha", "lin_image": 144, "pix_line": 360}
    assert headers.check_header(h).first()["status"] == 0
    assert h.select(headers.component_number(F.lit("alpha"))).first()[0] == 2
    assert headers.set_component(h, F.lit(2), F.lit("a"), F.lit("B*8 "), F.lit(7), F.lit(1)).first()["status"] == 227
    assert headers.set_component(h, F.lit(5), F.lit("a"), F.lit("B*8 "), F.lit(1), F.lit(1)).first()["status"] == 201
    assert headers.remove_extra_components(h).first()["nr_compon"] == 2
    assert headers.remove_component(h, F.lit(0)).first()["comp"][0]["com_code"] == "U/V  "
    assert headers.set_color_format(h, F.lit(5)).first()["nr_compon"] == 3
    assert headers.set_data_format(h, F.lit("R*2 ")).first()["status"] == 800
    assert headers.set_defined_size(h, F.lit("HDi"), F.lit(0)).first()["act_lines"] == 1152
    assert headers.set_defined_frequency(h, F.lit("60")).first()["act_lines"] == 480
    assert headers.set_frequencies(h, F.lit(1.0), F.lit(-1.0), F.lit(1.0)).first()["status"] == 420
    assert headers.set_description(h, F.lit("x" * 2048)).first()["status"] == 225
    assert "interlace" in headers.printed(h).first()["text"]


def test_aux_catalogue(spark):
    h = headers.create_header(requests(spark, [("a", 0, "50", "SD", 0, False, "4:3")]))
    h = auxiliary.add_aux(auxiliary.add_aux(h, F.lit("time"), F.lit(500)), F.lit("note"), F.lit(10))
    r = h.first()
    assert (r["aux_id"], r["nr_aux_data_recs"]) == (1, 2)
    assert auxiliary.add_aux(h, F.lit("time"), F.lit(1)).first()["aux_id"] == -1
    assert h.select(auxiliary.data_offset(F.col("aux"), F.lit(1)), auxiliary.entry_number(F.lit("note"))).first()[:] == (508, 1)
    assert auxiliary.remove_aux(h, F.lit(0)).first()["nr_aux_data_recs"] == 1
    assert auxiliary.remove_aux(h, F.lit(9)).first()["status"] == 205


@pytest.mark.parametrize(("color", "fmt", "little", "progressive"), [(2, "B*8 ", True, True), (6, "I*2 ", False, True), (5, "B*10", True, False), (8, "R*2 ", False, True)])
def test_file_round_trip(spark, tmp_path, color, fmt, little, progressive):
    h = headers.set_data_format(headers.create_header(requests(spark, [("a", color, "50", "QCIF", 0, progressive, "4:3")])), F.lit(fmt))
    h = source.header_dict(headers.set_num_frames(h, F.lit(3)).first()) | {"little_endian": little}
    rng, lay = np.random.default_rng(1), Layout(h)
    rows = [(i, c, rng.bytes(n)) for i in range(1, h["nr_images"] + 1) for c, n in enumerate(lay.planes)]
    path = str(tmp_path / "f.seq")
    source.write(spark.createDataFrame(rows, "image_no int, comp int, data binary").repartition(3), path, h)
    got = source.read(spark, path)
    assert {(r["image_no"], r["comp"]): bytes(r["data"]) for r in got.collect()} == {(i, c): d for i, c, d in rows}
    one = source.read(spark, path, pushdown=True).filter("image_no = 2 AND comp = 0")
    assert [bytes(r["data"]) for r in one.collect()] == [rows[len(lay.planes)][2]]
    assert source.read(spark, path, images="2-2", components="0").count() == 1
    head = source.read(spark, path, level="header").first()
    assert head["status"] == 0 and head["comp"][0]["data_fmt"] == fmt
    each = 1 if fmt == "B*8 " else 2
    n = source.read(spark, path, level="sample", components="0").count()
    assert n == h["nr_images"] * lay.planes[0] // each
    kept = raster.write_planes(raster.read_planes(got), "AF") if fmt in ("B*8 ", "I*2 ") else got
    assert {(r["image_no"], r["comp"]): bytes(r["data"]) for r in kept.collect()} == {(i, c): d for i, c, d in rows}
    if not progressive:
        woven = raster.weave_planes(got)
        back = raster.split_planes(woven)
        assert {(r["frame"], r["field"], r["comp"]): bytes(r["data"]) for r in back.collect()} == {(r["frame"], r["field"], r["comp"]): bytes(r["data"]) for r in got.collect()}
    assert source.rewrite_header(path, h | {"ima_freq": 60.0, "description": "new"}) == 0
    assert source.rewrite_header(path, h | {"nr_images": 1}) == 117
    assert source.read_header(path)["description"] == "new"


def test_aux_payloads_and_stream(spark, tmp_path):
    h = auxiliary.add_aux(headers.create_header(requests(spark, [("a", 0, "50", "QCIF", 0, True, "4:3")])), F.lit("note"), F.lit(20))
    h = source.header_dict(h.drop("aux_id").first())
    path = str(tmp_path / "s.seq")
    source.write(spark.createDataFrame([(i, 0, bytes([i]) * Layout(h).planes[0]) for i in (1, 2)], "image_no int, comp int, data binary"), path, h)
    source.write(spark.createDataFrame([(1, 0, b"abc"), (2, 0, b"")], "image_no int, aux_id int, data binary"), path, h | {"nr_images": 2}, append=True)
    assert source.read_header(path)["nr_images"] == 2
    assert [(r["image_no"], r["size"], bytes(r["data"])) for r in source.read(spark, path, level="aux").orderBy("image_no").collect()] == [(1, 3, b"abc"), (2, 0, b"")]
    with pytest.raises(Exception, match="228"):
        source.write(spark.createDataFrame([(1, 0, b"x" * 21)], "image_no int, aux_id int, data binary"), path, h | {"nr_images": 2}, append=True)


def test_streams(spark, tmp_path):
    source.register(spark)
    h = source.header_dict(headers.create_header(requests(spark, [("a", 0, "50", "QCIF", 0, True, "4:3")])).first()) | {"nr_images": 3}
    n = Layout(h).planes[0]
    path, out = str(tmp_path / "in.seq"), str(tmp_path / "out.seq")
    source.write(spark.createDataFrame([(i, 0, bytes([i]) * n) for i in (1, 2, 3)], "image_no int, comp int, data binary"), path, h)
    stream = spark.readStream.format("rasterseq").option("imagesPerPartition", "2").load(path).select("image_no", "comp", "data")
    clean = {k: v for k, v in h.items() if k != "status"} | {"nr_images": 0}
    q = stream.writeStream.format("rasterseq").option("header", repr(clean)).option("path", out).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert source.read_header(out)["nr_images"] == 3
    assert [bytes(r["data"])[0] for r in source.read(spark, out).orderBy("image_no").collect()] == [1, 2, 3]
