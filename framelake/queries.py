"""Named queries over the driver's tables, with their SQL: samples, header fields, planes. More are in header_queries and file_queries.

Embeddings serve as 8 x 8 images (vec_id: image number), prices and event values as raw sample codes, event_id as the address of a
sample, numbers of orders, parts and customers as header fields, n_chars as sizes of auxiliary data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake import registry
from framelake.functions import samples, text
from framelake.operators import auxiliary, headers, raster
from framelake.plans import layout
from framelake.registry import query as _query
from framelake.registry import table as _t
from framelake.sources.shared import with_folder


# --- samples ----------------------------------------------------------------------------------------------------------

_PRICE = "SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(trunc(l_extendedprice) AS BIGINT) AS s FROM lineitem"


def _prices(spark, sf_dir, out: Column) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem").withColumn("s", F.col("l_extendedprice").cast("long"))
    return li.select("l_orderkey", "l_linenumber", "l_extendedprice", out.alias("sample"))


def _bits(name: str, file: str, mem: str, sql: str, reading: bool = True):
    f = samples.read_bits if reading else samples.write_bits

    def query(spark, sf_dir):
        return _prices(spark, sf_dir, f(F.col("s"), file, mem))

    query.__name__ = name
    _query(f"SELECT l_orderkey, l_linenumber, l_extendedprice, {sql} AS sample FROM ({_PRICE})")(query)


_bits("bitdepth_read", "B*10", "8", "(s & 1023) >> 2")
_bits("bitdepth_expand", "B*8 ", "16", "(s & 255) << 8")
_bits("bitdepth_lsb", "B*10", "16_LSB", "((s & 1023) << 6) & 255")
_bits("bitdepth_read_14_12", "B*14", "12", "(s & 16383) >> 2")
_bits("bitdepth_as_file", "B*12", "AF", "s & 4095")
_bits("bitdepth_write", "B*10", "16", "(s & 65535) >> 6", False)
_bits("bitdepth_write_up", "B*14", "10", "(s & 1023) << 4", False)


@_query(f"SELECT l_orderkey, l_linenumber, l_extendedprice, ((s & 255) << 8) | ((s >> 8) & 255) AS sample FROM ({_PRICE})")
def endian_swap(spark, sf_dir):
    return _prices(spark, sf_dir, samples.swap_bytes(F.col("s")))


_HALF_SQL = "CASE WHEN e = 31 AND m > 0 THEN 'NaN'::DOUBLE WHEN e = 31 THEN g * 'Infinity'::DOUBLE WHEN e = 0 THEN g * (m * pow(2.0, -24)) ELSE g * ((m / 1024.0::DOUBLE + 1.0) * pow(2.0, e - 15)) END"


@_query(f"SELECT event_id, {_HALF_SQL} AS value FROM (SELECT event_id, CASE WHEN (h >> 15) & 1 = 1 THEN -1.0::DOUBLE ELSE 1.0 END AS g, (h >> 10) & 31 AS e, h & 1023 AS m FROM (SELECT event_id, event_id * 7919 % 65536 AS h FROM events))")
def half_decode(spark, sf_dir):
    h = F.col("event_id") * 7919 % 65536
    return _t(spark, sf_dir, "events").select("event_id", samples.half_to_float(h).alias("value"))


@_query("SELECT event_id, CASE WHEN e = 31 AND m > 0 THEN 'NaN' WHEN e = 31 THEN 'infinite' ELSE 'finite' END AS kind FROM (SELECT event_id, (h >> 10) & 31 AS e, h & 1023 AS m FROM (SELECT event_id, event_id * 7919 % 65536 AS h FROM events))")
def half_kinds(spark, sf_dir):
    v = samples.half_to_float(F.col("event_id") * 7919 % 65536)
    kind = F.when(F.isnan(v), "NaN").when(F.abs(v) == float("inf"), "infinite").otherwise("finite")
    return _t(spark, sf_dir, "events").select("event_id", kind.alias("kind"))


# values of all magnitudes and both signs, zeros, infinities and NaN
_FLOATS_SQL = "SELECT event_id, CASE WHEN event_id % 97 = 0 THEN 'Infinity'::DOUBLE WHEN event_id % 101 = 0 THEN '-Infinity'::DOUBLE WHEN event_id % 103 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 107 = 0 THEN 0.0 ELSE CAST(CAST((value - 100) * pow(2.0, event_id % 48 - 36) AS FLOAT) AS DOUBLE) END AS v FROM events"


@_query(f"""SELECT event_id, CAST(CASE WHEN isnan(v) THEN 32256 ELSE CASE WHEN v < 0 THEN 32768 ELSE 0 END + CASE WHEN x < pow(2.0, -24) THEN 0 WHEN x < pow(2.0, -14) THEN floor(x * 16777216 + 0.5) WHEN x >= 65536 THEN 31744
    ELSE least(31744, (floor(log2(x)) + 15) * 1024 + floor((x / pow(2.0, floor(log2(x))) - 1) * 1024 + 0.5)) END END AS INTEGER) AS code FROM (SELECT event_id, v, CASE WHEN v = 0 OR isnan(v) THEN 1e-30 ELSE abs(v) END AS x FROM ({_FLOATS_SQL}))""")
def half_encode(spark, sf_dir):
    k = F.col("event_id")
    finite = ((F.col("value") - 100) * F.pow(F.lit(2.0), k % 48 - 36)).cast("float").cast("double")
    v = F.when(k % 97 == 0, float("inf")).when(k % 101 == 0, float("-inf")).when(k % 103 == 0, float("nan")).when(k % 107 == 0, 0.0).otherwise(finite)
    return _t(spark, sf_dir, "events").select("event_id", samples.float_to_half(v).alias("code"))


@_query("SELECT event_id, 0 AS status FROM events")
def float_check(spark, sf_dir):
    """850 where a code doesn't survive being decoded and encoded (a NaN is any NaN)."""
    h = (F.col("event_id") * 7919 % 65536).cast("int")
    same = samples.float_to_half(samples.half_to_float(h)) == F.when(h.bitwiseAND(F.lit(0x7FFF)) > 0x7C00, 0x7E00).otherwise(h)
    return _t(spark, sf_dir, "events").select("event_id", F.when(same, 0).otherwise(850).alias("status"))


@_query("SELECT event_id, CAST(trunc((CAST(trunc(value * 10) AS INTEGER) - 128) / 4.0::DOUBLE + 0.5) AS INTEGER) AS sample FROM events")
def gain_offset_read(spark, sf_dir):
    raw = (F.col("value") * 10).cast("int")
    return _t(spark, sf_dir, "events").select("event_id", samples.read_gain(raw, F.lit(128), F.lit(4.0), "int").alias("sample"))


@_query("SELECT event_id, (CAST(trunc(value) AS DOUBLE) - 16.0) / 219.0 AS sample FROM events")
def gain_offset_float(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", samples.read_gain(F.col("value").cast("int"), F.lit(16.0), F.lit(219.0)).alias("sample"))


@_query("SELECT event_id, CAST(least(greatest(floor(value * 3.0 - 100.0 + 0.5), 0), 1023) AS INTEGER) AS code FROM events")
def gain_offset_write(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", samples.write_gain(F.col("value"), F.lit(-100.0), F.lit(3.0), "B*10").alias("code"))


@_query(f"SELECT l_orderkey, l_linenumber, l_extendedprice, (s & 4095) / 4095.0::DOUBLE AS sample FROM ({_PRICE})")
def hdr_normalise(spark, sf_dir):
    return _prices(spark, sf_dir, samples.hdr_read(F.col("s").bitwiseAND(F.lit(4095)), "B*12"))


@_query("SELECT vec_id, CAST(p - 1 AS INTEGER) AS pos, CAST(least(greatest(floor(CAST(embedding[p] AS DOUBLE) * 1023.0 + 0.0 + 0.5), 0), 1023) AS INTEGER) AS code FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings)")
def hdr_quantise(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return e.select("vec_id", "pos", samples.hdr_write(F.col("v").cast("double"), "B*10").alias("code"))


@_query("SELECT o_orderkey, (p >> 32) AS hi, p & 4294967295 AS lo FROM (SELECT o_orderkey, o_custkey * 4294967296 + o_orderkey + 5000000000 AS p FROM orders)")
def offset_halves(spark, sf_dir):
    hi, lo = samples.add_offset(F.col("o_custkey"), F.col("o_orderkey"), F.lit(5_000_000_000))
    return _t(spark, sf_dir, "orders").select("o_orderkey", hi.alias("hi"), lo.alias("lo"))


# --- header fields ----------------------------------------------------------------------------------------------------


@_query("SELECT p_partkey, CAST(w // gcd(w, h) AS BIGINT) AS h_pp, CAST(h // gcd(w, h) AS BIGINT) AS v_pp FROM (SELECT p_partkey, CAST(trunc(p_retailprice) AS BIGINT) AS w, CAST(p_size AS BIGINT) * 12 AS h FROM part)")
def aspect_reduce(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").cast("long").alias("w"), (F.col("p_size").cast("long") * 12).alias("h"))
    g = samples.gcd(F.col("w"), F.col("h"))
    return p.withColumn("g", g).select("p_partkey", F.expr("w div g").alias("h_pp"), F.expr("h div g").alias("v_pp"))


_FREQ_SQL = "CASE CAST(floor(100 * ({}) + 0.5) AS INTEGER) WHEN 5000 THEN '50' WHEN 5994 THEN '60' WHEN 6000 THEN 'REAL_60' WHEN 2500 THEN '25' WHEN 2398 THEN '24' WHEN 2400 THEN 'REAL_24' WHEN 2997 THEN '30' WHEN 3000 THEN 'REAL_30' WHEN 7500 THEN '75' WHEN 8991 THEN '90' WHEN 9000 THEN 'REAL_90' WHEN 10000 THEN '100' WHEN 11988 THEN '120' WHEN 12000 THEN 'REAL_120' ELSE 'UNKNOWN' END"
# every event near one of the classes, or at none of them
_HZ_SQL = "CASE WHEN event_id % 3 = 0 THEN value / 4 ELSE [50.0, 59.94, 60, 25, 23.976, 24, 29.97, 30, 75, 89.91, 90, 100, 119.88, 120][CAST(event_id % 14 + 1 AS INTEGER)]::DOUBLE + CASE WHEN event_id % 3 = 1 THEN 0.004 ELSE 0.0 END END"


@_query(f"SELECT event_id, {_FREQ_SQL.format(_HZ_SQL)} AS freq FROM events")
def freq_class(spark, sf_dir):
    k = F.col("event_id")
    near = _array([50.0, 59.94, 60.0, 25.0, 23.976, 24.0, 29.97, 30.0, 75.0, 89.91, 90.0, 100.0, 119.88, 120.0], k % 14) + F.when(k % 3 == 1, 0.004).otherwise(0.0)
    return _t(spark, sf_dir, "events").select("event_id", headers.frequency_class(F.when(k % 3 == 0, F.col("value") / 4).otherwise(near)).alias("freq"))


_LINES_SQL = "[120, 144, 240, 288, 480, 576, 720, 1080, 1152, 525, 625, 99][CAST(o_orderkey % 12 + 1 AS INTEGER)]"
_SIZE_SQL = "CASE WHEN st THEN CASE WHEN n IN (525, 625) THEN 'SD' ELSE 'UNKNOWN' END WHEN n IN (120, 144) THEN 'QCIF' WHEN n IN (240, 288) THEN 'CIF' WHEN n IN (480, 576) THEN 'SD' WHEN n IN (1080, 1152) THEN 'HDi' WHEN n = 720 THEN 'HDp' ELSE 'UNKNOWN' END"


def _array(values, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


@_query(f"SELECT o_orderkey, {_SIZE_SQL} AS size FROM (SELECT o_orderkey, {_LINES_SQL} AS n, o_custkey % 2 = 1 AS st FROM orders)")
def size_class(spark, sf_dir):
    n = _array([120, 144, 240, 288, 480, 576, 720, 1080, 1152, 525, 625, 99], F.col("o_orderkey") % 12)
    return _t(spark, sf_dir, "orders").select("o_orderkey", headers.size_class(n, F.col("o_custkey") % 2 == 1).alias("size"))


_H, _V = "[4, 16, 720, 5, 0][CAST(o_orderkey % 5 + 1 AS INTEGER)]", "[3, 9, 576, 4, 1][CAST(o_orderkey % 5 + 1 AS INTEGER)]"


@_query(f"SELECT o_orderkey, CASE WHEN h = 4 AND v = 3 THEN '4:3' WHEN h = 16 AND v = 9 THEN '16:9' WHEN abs(720.0::DOUBLE / nullif(h, 0) - 576.0::DOUBLE / nullif(v, 0)) < 0.001 THEN 'w:h' ELSE 'UNKNOWN' END AS aspect FROM (SELECT o_orderkey, {_H} AS h, {_V} AS v FROM orders)")
def aspect_class(spark, sf_dir):
    at = F.col("o_orderkey") % 5
    out = headers.aspect_class(_array([4, 16, 720, 5, 0], at), _array([3, 9, 576, 4, 1], at), F.lit(720.0), F.lit(576.0))
    return _t(spark, sf_dir, "orders").select("o_orderkey", out.alias("aspect"))


_REQUEST = {
    "color": ("o_orderkey % 9", "INTEGER"), "freq": ("['50','60','REAL_60','25','24','REAL_24','30','REAL_30','75'][CAST(o_custkey % 9 + 1 AS INTEGER)]", "VARCHAR"), "size": ("['QCIF','CIF','SD','HDp','HDi'][CAST(o_orderkey // 9 % 5 + 1 AS INTEGER)]", "VARCHAR"),
    "ppl": ("[0,176,352,720,1280,1920,864,100][CAST(o_orderkey // 45 % 8 + 1 AS INTEGER)]", "INTEGER"), "progressive": ("o_custkey // 9 % 2 = 1", "BOOLEAN"), "ratio": ("['4:3','16:9','w:h','auto'][CAST(o_orderkey // 360 % 4 + 1 AS INTEGER)]", "VARCHAR"),
}


def _requests(spark, sf_dir) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = _t(spark, sf_dir, "orders")
    return o.select(
        k.alias("path"), (k % 9).cast("int").alias("color"), _array(["50", "60", "REAL_60", "25", "24", "REAL_24", "30", "REAL_30", "75"], c % 9).alias("freq"), _array(["QCIF", "CIF", "SD", "HDp", "HDi"], F.expr("o_orderkey div 9") % 5).alias("size"),
        _array([0, 176, 352, 720, 1280, 1920, 864, 100], F.expr("o_orderkey div 45") % 8).alias("ppl"), (F.expr("o_custkey div 9") % 2 == 1).alias("progressive"), _array(["4:3", "16:9", "w:h", "auto"], F.expr("o_orderkey div 360") % 4).alias("ratio"),
    )


# the standard rasters: lines and line frequency (kHz) by size for 50, 59.94 and 60 Hz families, and pixel frequency (MHz) by width; 0 asks for the first
_RASTER_SQL = """z(rz, n50, n60, k50, k60, kx) AS (VALUES ('QCIF', 144, 120, 15.625, 15.734264, 15.75), ('CIF', 288, 240, 15.625, 15.734264, 15.75), ('SD', 576, 480, 15.625, 15.734264, 15.75), ('HDp', NULL, 720, NULL, 22.4775, 22.5), ('HDi', 1152, 1080, 31.25, 33.71625, 33.75)),
fr(rf, fam) AS (VALUES ('50', 5), ('25', 5), ('60', 6), ('24', 6), ('30', 6), ('REAL_60', 0), ('REAL_24', 0), ('REAL_30', 0)),
px(pz, fifty, ask, w, mhz) AS (VALUES ('QCIF', NULL, 0, 176, 13.5), ('QCIF', NULL, 176, 176, 13.5), ('QCIF', NULL, 180, 180, 13.5), ('CIF', NULL, 0, 352, 13.5), ('CIF', NULL, 352, 352, 13.5), ('CIF', NULL, 360, 360, 13.5),
    ('SD', NULL, 0, 720, 13.5), ('SD', NULL, 512, 512, 9.6), ('SD', NULL, 640, 640, 12.0), ('SD', NULL, 704, 704, 13.5), ('SD', NULL, 720, 720, 13.5), ('SD', NULL, 848, 848, 16.0), ('SD', NULL, 960, 960, 18.0), ('SD', NULL, 1024, 1024, 19.2), ('SD', NULL, 1280, 1280, 24.0), ('SD', NULL, 1440, 1440, 27.0),
    ('HDp', NULL, 0, 1280, 37.125), ('HDp', NULL, 960, 960, 27.84375), ('HDp', NULL, 1024, 1024, 29.7), ('HDp', NULL, 1280, 1280, 37.125), ('HDp', NULL, 1440, 1440, 41.765625), ('HDp', NULL, 1920, 1920, 55.6875),
    ('HDi', true, 0, 1440, 54.0), ('HDi', true, 960, 960, 36.0), ('HDi', true, 1024, 1024, 38.4), ('HDi', true, 1280, 1280, 48.0), ('HDi', true, 1440, 1440, 54.0), ('HDi', true, 1920, 1920, 72.0),
    ('HDi', false, 0, 1920, 74.25), ('HDi', false, 960, 960, 37.125), ('HDi', false, 1024, 1024, 39.6), ('HDi', false, 1280, 1280, 49.5), ('HDi', false, 1440, 1440, 55.6875), ('HDi', false, 1920, 1920, 74.25)),
st(rf, ask, w, n, khz, mhz) AS (VALUES ('25', 0, 864, 625, 15.625, 13.5), ('25', 864, 864, 625, 15.625, 13.5), ('25', 1024, 1024, 625, 15.625, 16.0), ('25', 1152, 1152, 625, 15.625, 18.0), ('30', 0, 858, 525, 15.734264, 13.5), ('30', 858, 858, 525, 15.734264, 13.5), ('30', 1144, 1144, 525, 15.734264, 18.0)),
r AS (SELECT false AS st, rf, rz, ask, w, CASE fam WHEN 5 THEN n50 ELSE n60 END AS n, CAST(CASE fam WHEN 5 THEN k50 WHEN 6 THEN k60 ELSE kx END AS DOUBLE) AS khz, CAST(mhz AS DOUBLE) AS mhz FROM z, fr, px WHERE rz = pz AND coalesce(fifty = (fam = 5), true) AND CASE fam WHEN 5 THEN n50 ELSE n60 END IS NOT NULL
    UNION ALL SELECT true, rf, 'SD', ask, w, n, CAST(khz AS DOUBLE), CAST(mhz AS DOUBLE) FROM st)"""


_REQUESTS_SQL = "SELECT o_orderkey AS path, " + ", ".join(f"CAST({v} AS {t}) AS {k}" for k, (v, t) in _REQUEST.items()) + " FROM orders"
_CREATE_SQL = f"""
WITH {_RASTER_SQL}, q AS ({_REQUESTS_SQL}),
j AS (SELECT q.*, r.*, color = 7 AS stream FROM q LEFT JOIN r ON (color = 7) = st AND freq = rf AND size = rz AND ppl = ask),
s AS (SELECT *, CASE WHEN stream AND NOT progressive THEN 703 WHEN size = 'HDi' AND progressive THEN 702 WHEN size = 'HDp' AND NOT progressive THEN 701 WHEN size = 'HDp' AND freq IN ('50', '25') THEN 700
    WHEN stream AND freq NOT IN ('25', '30') THEN 400 WHEN freq NOT IN ('50', '60', 'REAL_60', '25', '24', 'REAL_24', '30', 'REAL_30') THEN 400 WHEN stream AND size <> 'SD' THEN 500 WHEN w IS NULL THEN 710 ELSE 0 END AS status,
    CASE WHEN freq IN ('24', '25', '30', 'REAL_24', 'REAL_30') AND NOT stream THEN 0.0::DOUBLE WHEN progressive AND NOT stream THEN 2.0 ELSE 1.0 END AS f,
    CASE WHEN stream THEN ppl > 720 WHEN size IN ('HDp', 'HDi') THEN true WHEN size = 'SD' THEN ppl > 720 WHEN size = 'CIF' THEN ppl > 352 ELSE ppl > 176 END AS wide FROM j)
SELECT path, CAST(status AS INTEGER) AS status, w AS act_pixel, n AS act_lines, coalesce(khz, 0) * f AS lin_freq, coalesce(mhz, 0) * f AS pix_freq,
    CAST(CASE ratio WHEN '4:3' THEN 4 WHEN '16:9' THEN 16 WHEN 'w:h' THEN w // gcd(w, n) ELSE CASE WHEN wide THEN 16 ELSE 4 END END AS INTEGER) AS h_pp_size,
    CAST(CASE ratio WHEN '4:3' THEN 3 WHEN '16:9' THEN 9 WHEN 'w:h' THEN n // gcd(w, n) ELSE CASE WHEN wide THEN 9 ELSE 3 END END AS INTEGER) AS v_pp_size, CAST(CASE WHEN progressive OR stream THEN 1 ELSE 2 END AS INTEGER) AS interlace FROM s"""


@_query(_CREATE_SQL)
def raster_lookup(spark, sf_dir):
    h = headers.create_header(_requests(spark, sf_dir))
    return h.select("path", "status", "act_pixel", "act_lines", "lin_freq", "pix_freq", "h_pp_size", "v_pp_size", "interlace")


_CREATION_SQL = f"""SELECT path, CAST(CASE WHEN color = 7 AND NOT progressive THEN 703 WHEN size = 'HDi' AND progressive THEN 702 WHEN size = 'HDp' AND NOT progressive THEN 701 WHEN size = 'HDp' AND freq IN ('50', '25') THEN 700 ELSE 0 END AS INTEGER) AS status FROM ({_REQUESTS_SQL})"""


@_query(_CREATION_SQL)
def creation_status(spark, sf_dir):
    q = _requests(spark, sf_dir)
    return q.select("path", headers.creation_status(F.col("size"), F.col("freq"), F.col("progressive"), F.col("color")).alias("status"))


def _made(spark, sf_dir) -> DataFrame:
    """Headers with 4:2:0 components whose fields come from customer: some sizes don't fit."""
    c = _t(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("int")
    base = c.select(F.col("c_custkey").cast("string").alias("path"), F.lit(2).alias("color"), F.lit(50.0).alias("f"), F.lit(15.625).alias("l"), F.lit(13.5).alias("p"), (k % 7 * 16 + 576).alias("n"), (k % 5 * 8 + 720).alias("w"), (k % 2 + 1).alias("i"), F.lit(4).alias("h"), F.lit(3).alias("v"))
    made = headers.free_header(base, "color", "f", "l", "p", "n", "w", "i", "h", "v")
    k = F.col("path").cast("int")
    comp = F.transform("comp", lambda x, i: headers.replaced(x, pix_line=F.when((k % 11 == 3) & (i == 0), x["pix_line"] + 2).when((k % 13 == 5) & (i == 1), x["pix_line"] - 2).otherwise(x["pix_line"]), lin_image=F.when((k % 17 == 4) & (i == 1), x["lin_image"] + 1).otherwise(x["lin_image"]), data_fmt=F.when((k % 19 == 6) & (i == 1), "B*10").when(k % 23 == 7, "R*2 ").otherwise("B*8 ")))
    return made.withColumns({"comp": comp, "nr_images": (k % 100 * 3).cast("int")})


_MADE_SQL = """SELECT CAST(k AS VARCHAR) AS path, k, CAST(k % 100 * 3 AS INTEGER) AS nr_images, i, w, n, 15.625::DOUBLE AS lin_freq, CASE WHEN k % 11 = 3 THEN w + 2 ELSE w END AS w0, n // i AS n0, CASE WHEN k % 13 = 5 THEN w - 2 ELSE w END AS w1, CASE WHEN k % 17 = 4 THEN n // 2 // i + 1 ELSE n // 2 // i END AS n1,
    CASE WHEN k % 23 = 7 THEN 2 ELSE 1 END AS b0, CASE WHEN k % 19 = 6 OR k % 23 = 7 THEN 2 ELSE 1 END AS b1
    FROM (SELECT CAST(c_custkey AS INTEGER) AS k, c_custkey % 7 * 16 + 576 AS n, c_custkey % 5 * 8 + 720 AS w, c_custkey % 2 + 1 AS i FROM customer)"""


_CHECK_SQL = f"""SELECT path, CASE WHEN w0 <> w THEN 9 WHEN w1 = w THEN 2 ELSE 0 END AS color_format,
    CASE WHEN w0 <> w THEN 300 WHEN w1 = w AND n1 * 2 * i <> n THEN 221 WHEN w1 <> w AND ((w1 * 2) % w <> 0 OR n1 * 2 * i <> n) THEN 226 WHEN k % 23 = 7 AND NOT (k % 19 = 6 AND false) THEN 800 WHEN w1 = w AND k % 19 = 6 THEN 810 ELSE 0 END AS status FROM ({_MADE_SQL})"""


@_query(_CHECK_SQL)
def header_status(spark, sf_dir):
    return headers.check_header(_made(spark, sf_dir)).select("path", "color_format", "status")


_BASIC_SQL = """SELECT o_orderkey, CAST(CASE WHEN i NOT BETWEEN 0 AND 2 THEN 501 WHEN w > 999999 OR w < 0 THEN 500 WHEN a * 512 > 16384 THEN 229 WHEN n > 9999999 THEN 199 ELSE 0 END AS INTEGER) AS status
    FROM (SELECT o_orderkey, o_custkey % 4 AS i, CAST(trunc(o_totalprice) AS BIGINT) * 3 AS w, o_orderkey % 40 AS a, o_orderkey * 1000 AS n FROM orders)"""


@_query(_BASIC_SQL)
def basic_status(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    h = o.select("o_orderkey", (F.col("o_custkey") % 4).alias("interlace"), (F.col("o_totalprice").cast("long") * 3).alias("act_pixel"), F.lit(576).alias("act_lines"), (F.col("o_orderkey") % 40).alias("nr_aux_hdr_recs"), F.lit(512).alias("bytes_rec"), F.lit(0).alias("nr_compon"), (F.col("o_orderkey") * 1000).alias("nr_images"), F.array().cast(f"array<{headers.COMPONENT}>").alias("comp"))
    return h.select("o_orderkey", headers.basic_status().cast("int").alias("status"))


_COLOR_CASES = [(1, 1, 1), (2, 1, 2), (2, 2, 2), (2, 1, 1), (2, 2, 1)]


@_query("""SELECT c_custkey, CASE WHEN a = 'S' THEN 7 WHEN a = 'R' THEN CASE WHEN p = 1 AND l = 1 THEN 6 ELSE 9 END WHEN p = 1 AND l = 1 AND m = 1 THEN 3 WHEN p = 2 AND l = 1 AND m = 1 THEN 4 WHEN p = 2 AND l = 2 AND m = 1 THEN 5 ELSE 0 END AS color_format
    FROM (SELECT c_custkey, ['Y', 'R', 'S'][CAST(c_custkey // 5 % 3 + 1 AS INTEGER)] AS a, [1, 2, 2, 2, 2][CAST(c_custkey % 5 + 1 AS INTEGER)] AS p, [1, 1, 2, 1, 2][CAST(c_custkey % 5 + 1 AS INTEGER)] AS l, [1, 2, 2, 1, 1][CAST(c_custkey % 5 + 1 AS INTEGER)] AS m FROM customer)""")
def color_infer(spark, sf_dir):
    k = F.col("c_custkey")
    at = F.expr("c_custkey div 5") % 3
    p, l, m = (_array([c[i] for c in _COLOR_CASES], k % 5) for i in range(3))
    first = headers.component(_array(["Y    ", "R    ", "S    "], at), "B*8 ", F.lit(576), F.lit(720), F.lit(1), F.lit(1))
    others = [headers.component(_array(names, at), "B*8 ", F.lit(576), (720 * m / p).cast("int"), p, l) for names in (["U    ", "G    ", "G    "], ["V    ", "B    ", "B    "])]
    c = _t(spark, sf_dir, "customer").select("c_custkey", F.array(first, *others).alias("comp"))
    return c.select("c_custkey", headers.color_of(F.col("comp"), F.lit(720)).alias("color_format"))


def _short(df: DataFrame) -> DataFrame:
    c = lambda k: F.get(F.col("comp"), k)
    return df.select("path", "nr_images", "interlace", "lin_freq", "act_pixel", "act_lines", c(0)["lin_image"].alias("lines_0"), c(1)["lin_image"].alias("lines_1"), c(0)["pix_line"].alias("pixels_0"), c(1)["pix_line"].alias("pixels_1"), "status")


def _short_sql(**changes: str) -> str:
    own = {"nr_images": "nr_images", "interlace": "CAST(i AS INTEGER)", "lin_freq": "lin_freq", "act_pixel": "CAST(w AS INTEGER)", "act_lines": "CAST(n AS INTEGER)", "lines_0": "CAST(n0 AS INTEGER)", "lines_1": "CAST(n1 AS INTEGER)", "pixels_0": "CAST(w0 AS INTEGER)", "pixels_1": "CAST(w1 AS INTEGER)", "status": "0"} | changes
    return "SELECT path, " + ", ".join(f"{v} AS {k}" for k, v in own.items()) + f" FROM ({_MADE_SQL})"


_COLOR_SQL = "(CASE WHEN w0 <> w THEN 9 WHEN w1 = w THEN 2 ELSE 0 END)"


@_query(_short_sql(nr_images="CAST(CASE WHEN i = 2 THEN nr_images // 2 ELSE nr_images END AS INTEGER)", interlace="1", lin_freq="CASE WHEN i = 2 THEN lin_freq * 2 ELSE lin_freq END", lines_0=f"CAST(CASE WHEN i = 2 AND {_COLOR_SQL} <> 9 THEN n0 * 2 ELSE n0 END AS INTEGER)", lines_1=f"CAST(CASE WHEN i = 2 AND {_COLOR_SQL} = 2 THEN n1 * 2 ELSE n1 END AS INTEGER)"))
def mod_progressive(spark, sf_dir):
    return _short(headers.to_progressive(_made(spark, sf_dir)))


@_query(_short_sql(nr_images="CAST(CASE WHEN i = 1 THEN nr_images * 2 ELSE nr_images END AS INTEGER)", interlace="2", lin_freq="CASE WHEN i = 1 THEN lin_freq * 0.5 ELSE lin_freq END", lines_0=f"CAST(CASE WHEN i = 1 AND {_COLOR_SQL} <> 9 THEN n0 // 2 ELSE n0 END AS INTEGER)", lines_1=f"CAST(CASE WHEN i = 1 AND {_COLOR_SQL} = 2 THEN n1 // 2 ELSE n1 END AS INTEGER)"))
def mod_interlaced(spark, sf_dir):
    return _short(headers.to_interlaced(_made(spark, sf_dir)))


@_query(_short_sql(nr_images="CAST(nr_images * 2 AS INTEGER)", lin_freq="lin_freq * 2"))
def mod_double_rate(spark, sf_dir):
    return _short(headers.to_double_rate(_made(spark, sf_dir)))


@_query(_short_sql(nr_images="CAST(trunc(nr_images * 1.5::DOUBLE) AS INTEGER)", lin_freq="lin_freq * 1.5"))
def mod_one_and_half_rate(spark, sf_dir):
    return _short(headers.to_one_and_half_rate(_made(spark, sf_dir)))


@_query(_short_sql(act_pixel="352", act_lines="288", pixels_0="CAST(352 // nullif(w // w0, 0) AS INTEGER)", pixels_1="CAST(352 // nullif(w // w1, 0) AS INTEGER)", lines_0="CAST(288 // (n // n0) AS INTEGER)", lines_1="CAST(288 // (n // n1) AS INTEGER)"))
def mod_image_size(spark, sf_dir):
    return _short(headers.set_image_size(_made(spark, sf_dir), F.lit(352), F.lit(288)))


@_query(_short_sql(nr_images="CAST(25 * i AS INTEGER)"))
def mod_num_frames(spark, sf_dir):
    return _short(headers.set_num_frames(_made(spark, sf_dir), F.lit(25)))


@_query(f"SELECT path, CAST((2 + 36 + 4) * 512 AS BIGINT) AS header_bytes, CAST(w0 * n0 * b0 + w1 * n1 * b1 AS BIGINT) AS image_bytes, CAST(21504 + nr_images * (w0 * n0 * b0 + w1 * n1 * b1) AS BIGINT) AS file_bytes FROM ({_MADE_SQL})")
def size_algebra(spark, sf_dir):
    return headers.sizes(_made(spark, sf_dir)).select("path", "header_bytes", "image_bytes", "file_bytes")


@_query(f"SELECT path, CAST(c AS INTEGER) AS comp, CAST(21504 + 2 * (w0 * n0 * b0 + w1 * n1 * b1) + CASE WHEN c = 1 THEN w0 * n0 * b0 ELSE 0 END AS BIGINT) AS position FROM ({_MADE_SQL}), (SELECT unnest([0, 1]) AS c)")
def comp_offset(spark, sf_dir):
    h = headers.sizes(_made(spark, sf_dir)).withColumn("number", F.explode(F.array(F.lit(0), F.lit(1))))
    return h.select("path", F.col("number").alias("comp"), layout.offset(F.lit(3), F.col("number"), F.col("comp"), F.col("nr_aux_data_recs"), F.col("bytes_rec"), F.col("header_bytes")).alias("position"))


@_query(f"SELECT path, CASE WHEN x % 11 = 3 THEN 117 WHEN x % 23 = 7 THEN 117 ELSE 0 END AS status FROM (SELECT path, k AS x FROM ({_MADE_SQL}))")
def rewrite_compat(spark, sf_dir):
    old = _made(spark, sf_dir)
    k = F.col("path").cast("int")
    comp = F.transform("comp", lambda c: headers.replaced(c, data_fmt=F.when(k % 23 == 7, "B*8 ").otherwise(c["data_fmt"]), com_code=F.lit("void ")))
    new = old.withColumns({"comp": comp, "act_lines": F.when(k % 11 == 3, F.col("act_lines") + 1).otherwise(F.col("act_lines")), "ima_freq": F.lit(60.0)})
    return headers.rewrite_status(old, new)


_STATUS_SQL = (
    "(0, 'success'), (100, 'cannot open the file for reading'), (101, 'cannot create the file'), (102, 'cannot open the file for changes'), (103, 'not a file of this format'), (110, 'write error'), (111, 'read error'), (112, 'seek error'), (113, 'backward seek on a stream')"
    ", (115, 'write past the announced images on a stream'), (116, 'a header on a stream cannot be rewritten'), (117, 'new header does not fit the data in the file'), (199, 'image count too large'), (200, 'component count too large'), (201, 'no such component')"
    ", (202, 'image header records are not allowed'), (203, 'illegal record length'), (204, 'illegal temporal subsampling'), (205, 'no such auxiliary entry'), (206, 'illegal line subsampling'), (207, 'illegal pixel subsampling'), (210, 'needs an interlaced file')"
    ", (211, 'chrominance asked of a luminance-only file'), (212, 'R, G or B asked of a luminance-only file'), (213, 'separate U or V asked of a multiplexed file'), (214, 'R, G or B asked of a Y, U, V file'), (215, 'chrominance asked of an R, G, B file'), (216, 'chrominance asked of a stream file')"
    ", (217, 'R, G or B asked of a stream file'), (218, 'no such component to read'), (219, 'no such component to write'), (220, 'luminance component has a wrong size'), (221, 'chrominance component has a wrong size'), (222, 'R, G, B component has a wrong size'), (223, 'stream component has a wrong size')"
    ", (224, 'X, Y, Z component has a wrong size'), (225, 'description too long'), (226, 'extra component has a wrong size'), (227, 'picture size is no multiple of the subsampling'), (228, 'auxiliary data too long'), (229, 'auxiliary headers too long'), (230, 'header differs from that in the file')"
    ", (242, 'colour format does not suit multiplexed access'), (243, 'colour format does not suit planar access'), (300, 'illegal colour format'), (400, 'illegal image frequency'), (410, 'image frequency cannot be changed so'), (420, 'negative frequency'), (500, 'illegal picture size')"
    ", (501, 'illegal interlace factor'), (502, 'illegal component size'), (503, 'illegal phase shift'), (600, 'illegal aspect ratio'), (700, 'size and frequency do not go together'), (701, 'size cannot be interlaced'), (702, 'size cannot be progressive'), (703, 'stream format cannot be interlaced')"
    ", (710, 'illegal number of pixels in a line'), (800, 'illegal file data format'), (810, 'components differ in data format'), (820, 'illegal memory data format'), (830, 'unknown file sample type'), (840, 'unknown memory sample type'), (850, 'floats are not IEEE 754 here'), (900, 'out of memory')"
)


@_query(f"SELECT o_orderkey, s AS status, t AS message FROM (SELECT o_orderkey, CAST(o_orderkey % 1000 AS INTEGER) AS s FROM orders) LEFT JOIN (VALUES {_STATUS_SQL}) v(k, t) ON s = k")
def status_text(spark, sf_dir):
    s = (F.col("o_orderkey") % 1000).cast("int")
    return _t(spark, sf_dir, "orders").select("o_orderkey", s.alias("status"), headers.error_text(s).alias("message"))


# an amount of 100,000 or more is wider than its field, so its record is null
_RECORD_SQL = "SELECT o_orderkey, o_totalprice, o_orderpriority, CASE WHEN length(printf('%12f', o_totalprice)) <= 12 THEN lpad(CAST(o_orderkey % 10000000 AS VARCHAR), 7, ' ') || printf('%12f', o_totalprice) || rpad(left(o_orderpriority, 5), 5, ' ') END AS record FROM orders"


@_query(f"SELECT o_orderkey, record FROM ({_RECORD_SQL})")
def header_render(spark, sf_dir):
    r = F.concat(text.render_int(F.col("o_orderkey") % 10_000_000, 7), text.render_float(F.col("o_totalprice")), text.padded_name(F.col("o_orderpriority")))
    return _t(spark, sf_dir, "orders").select("o_orderkey", r.alias("record"))


@_query(f"SELECT o_orderkey, CASE WHEN record IS NOT NULL THEN CAST(o_orderkey % 10000000 AS INTEGER) END AS number, CASE WHEN record IS NOT NULL THEN CAST(printf('%12f', o_totalprice) AS DOUBLE) END AS amount, CASE WHEN record IS NOT NULL THEN rpad(left(o_orderpriority, 5), 5, ' ') END AS name FROM ({_RECORD_SQL})")
def header_parse(spark, sf_dir):
    raw = F.col("record").cast("binary")
    return header_render(spark, sf_dir).select("o_orderkey", text.parse_int(text.field(raw, 0, 7)).alias("number"), text.parse_float(text.field(raw, 7, 12)).alias("amount"), text.parse_text(text.field(raw, 19, 5)).alias("name"))


@_query("SELECT source, CAST(sum(a) AS BIGINT) AS bytes, CAST(ceil(sum(a) / 512.0) AS INTEGER) AS records FROM (SELECT source, CASE WHEN m > 0 THEN m + 8 ELSE 0 END AS a FROM (SELECT source, max(n_chars) % 500 AS m FROM documents GROUP BY source, lang)) GROUP BY source")
def aux_layout(spark, sf_dir):
    per = _t(spark, sf_dir, "documents").groupBy("source", "lang").agg((F.max("n_chars") % 500).cast("int").alias("max_size"))
    a = per.groupBy("source").agg(F.array_sort(F.collect_list(F.struct(F.col("lang").alias("name"), "max_size", F.lit(b"").alias("description")))).alias("aux"))
    return a.select("source", auxiliary.data_bytes(F.col("aux")).alias("bytes"), auxiliary.data_records(F.col("aux"), F.lit(512)).alias("records"))


@_query("SELECT source, lang, CAST(coalesce(sum(CASE WHEN m > 0 THEN m + 8 ELSE 0 END) OVER (PARTITION BY source ORDER BY lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS position FROM (SELECT source, lang, max(n_chars) % 500 AS m FROM documents GROUP BY source, lang)")
def aux_offsets(spark, sf_dir):
    per = _t(spark, sf_dir, "documents").groupBy("source", "lang").agg((F.max("n_chars") % 500).cast("int").alias("max_size"))
    a = per.groupBy("source").agg(F.array_sort(F.collect_list(F.struct(F.col("lang").alias("name"), "max_size", F.lit(b"").alias("description")))).alias("aux"))
    e = a.select("source", "aux", F.posexplode("aux").alias("k", "e"))
    return e.select("source", F.col("e.name").alias("lang"), auxiliary.data_offset(F.col("aux"), F.col("k")).alias("position"))


@_query("SELECT doc_id, CASE WHEN n_chars > 1000 THEN 228 ELSE 0 END AS status FROM documents")
def aux_limits(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", auxiliary.payload_status(F.col("n_chars"), F.lit(1000)).alias("status"))


# --- planes -----------------------------------------------------------------------------------------------------------


@_query("SELECT event_id, CAST(2 * (f - 1) + d AS BIGINT) AS image_no, x, y, d AS field FROM (SELECT event_id, event_id // 256 + 1 AS f, CAST(event_id % 256 // 16 % 2 + 1 AS INTEGER) AS d, CAST(event_id % 16 AS INTEGER) AS x, CAST(event_id % 256 // 16 // 2 AS INTEGER) AS y FROM events)")
def field_address(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.expr("event_id div 256 + 1").alias("frame"), (F.col("event_id") % 16).cast("int").alias("x"), F.expr("cast(event_id % 256 div 16 as int)").alias("y"))
    e = raster.split_lines(e)
    return e.select("event_id", layout.image_number(F.col("frame"), F.col("field"), F.lit(True)).alias("image_no"), "x", "y", "field")


_SAMPLES_SQL = "SELECT vec_id, CAST((p - 1) % 8 AS INTEGER) AS x, CAST((p - 1) // 8 AS INTEGER) AS y, CAST(embedding[p] AS DOUBLE) AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM embeddings)"


def _image_samples(spark, sf_dir) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("a"))
    return raster.samples_of(e, "a", 8, ("vec_id",))


@_query(f"SELECT vec_id, x, CAST(y // 2 AS INTEGER) AS y, CAST(y % 2 + 1 AS INTEGER) AS field, value FROM ({_SAMPLES_SQL})")
def split(spark, sf_dir):
    return raster.split_lines(_image_samples(spark, sf_dir))


@_query("SELECT CAST(vec_id // 2 AS BIGINT) AS frame, x, CAST(2 * y + vec_id % 2 AS INTEGER) AS y, value FROM (" + _SAMPLES_SQL + ")")
def weave(spark, sf_dir):
    s = _image_samples(spark, sf_dir).select(F.expr("vec_id div 2").alias("frame"), (F.col("vec_id") % 2 + 1).alias("field"), "x", "y", "value")
    return raster.weave_lines(s)


@_query(f"SELECT * FROM ({_SAMPLES_SQL}) WHERE x < 5 AND y < 3")
def crop(spark, sf_dir):
    return raster.crop_samples(_image_samples(spark, sf_dir), 5, 3)


@_query(f"SELECT vec_id, CAST(x // 2 AS INTEGER) AS x, y, CASE WHEN x % 2 = 0 THEN 'U' ELSE 'V' END AS comp_name, value FROM ({_SAMPLES_SQL})")
def uv_demux(spark, sf_dir):
    return raster.demultiplex(_image_samples(spark, sf_dir))


def _planes(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 9).cast("int").alias("color_format"), (F.col("event_id") % 3).cast("int").alias("comp"))


# colour formats in five kinds (luminance; multiplexed; planar; RGB and XYZ; stream): components that a mode gives, or the status
_KINDS_SQL = "CASE WHEN c = 0 THEN 1 WHEN c IN (1, 2) THEN 2 WHEN c IN (3, 4, 5) THEN 3 WHEN c IN (6, 8) THEN 4 ELSE 5 END"
_MODE_SQL = {
    "ALL": "[211], [0, 1], [0, 1, 2], [0, 1, 2], [0]", "Y": "[0], [0], [0], [0, 1, 2], [0]", "UV": "[211], [1], [1, 2], [215], [216]", "U": "[211], [213], [1], [215], [216]",
    "V": "[211], [213], [2], [215], [216]", "R": "[212], [214], [214], [0], [217]", "G": "[212], [214], [214], [1], [217]", "B": "[212], [214], [214], [2], [217]",
}


def _mode_query(mode: str, kinds: str) -> None:
    def query(spark, sf_dir):
        return raster.select_components(_planes(spark, sf_dir), mode).select("event_id", "color_format", "comp", "status")

    query.__name__ = f"project_{mode.lower()}"
    planes = "SELECT event_id, CAST(user_id % 9 AS INTEGER) AS c, CAST(event_id % 3 AS INTEGER) AS comp FROM events"
    _query(f"SELECT event_id, c AS color_format, comp, CAST(CASE WHEN k[1] > 200 THEN k[1] ELSE 0 END AS INTEGER) AS status FROM (SELECT *, [{kinds}][{_KINDS_SQL}] AS k FROM ({planes})) WHERE list_contains(k, comp) OR (k[1] > 200 AND comp = 0)")(query)


for _m, _k in _MODE_SQL.items():
    _mode_query(_m, _k)


# --- files ------------------------------------------------------------------------------------------------------------


def _image_header(spark, n: int, little: bool = True) -> dict:
    from framelake.sources import format as source

    one = spark.createDataFrame([(0, 50.0, 0.0, 0.0, 8, 8, 1, 1, 1)], "color int, f double, l double, p double, n int, w int, i int, h int, v int")
    h = headers.set_data_format(headers.free_header(one, "color", "f", "l", "p", "n", "w", "i", "h", "v"), F.lit("B*10"))
    return source.header_dict(h.first()) | {"nr_images": n, "little_endian": little}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantises the embeddings to 10 bits, writes them as one sequence file, reads it back as samples and describes each image."""
    from framelake.sources import format as source

    e = _t(spark, sf_dir, "embeddings")
    codes = F.transform("embedding", lambda v: F.floor(F.least(F.greatest((v.cast("double") + 1) * 511.5, F.lit(0.0)), F.lit(1023.0)) + 0.5).cast("int"))
    hexes = F.array_join(F.transform(codes, lambda v: F.concat(F.lpad(F.hex(v % 256), 2, "0"), F.lpad(F.hex(F.floor(v / 256)), 2, "0"))), "")
    planes = e.select((F.col("vec_id") + 1).cast("int").alias("image_no"), F.lit(0).alias("comp"), F.unhex(hexes).alias("data"))

    def described(folder: str) -> DataFrame:
        source.write(planes, f"{folder}/images.seq", _image_header(spark, e.count()))
        s = source.read(spark, f"{folder}/images.seq", level="sample", memFormat="8")
        per = s.groupBy("image_no").agg(F.count("*").alias("samples"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))
        return per.select((F.col("image_no") - 1).cast("long").alias("vec_id"), "samples", "total", "least", "most")

    return with_folder(spark, described)


@_query("""SELECT vec_id, count(*) AS samples, CAST(sum(s) AS BIGINT) AS total, CAST(min(s) AS INTEGER) AS least, CAST(max(s) AS INTEGER) AS most FROM
    (SELECT vec_id, CAST(floor(least(greatest((CAST(unnest(embedding) AS DOUBLE) + 1) * 511.5, 0), 1023) + 0.5) AS BIGINT) >> 2 AS s FROM embeddings) GROUP BY vec_id""")
def file_round_trip(spark, sf_dir):
    return flagship(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from framelake import file_queries, header_queries  # noqa: F401  (they register theirs)

    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(registry.SQL)
