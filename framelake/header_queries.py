"""Named queries of header creation, changes, getters and checks, over headers made of customers and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from framelake.functions import samples, text
from framelake.operators import auxiliary, headers, raster
from framelake.queries import _COLOR_SQL, _FREQ_SQL, _MADE_SQL, _REQUESTS_SQL, _array, _made, _requests
from framelake.registry import query, table


def _k():
    """The number that a made header's path is."""
    return F.col("path").cast("int")


def _part(n: int, field: str):
    return F.get(F.col("comp"), n)[field]


def _pick(values: str, at: str) -> str:
    return f"[{values}][CAST({at} + 1 AS INTEGER)]"


# --- creation ---------------------------------------------------------------------------------------------------------

_SIMPLE_SQL = f"""SELECT path, status, CASE WHEN status = 0 THEN CASE WHEN color = 7 THEN CASE freq WHEN '25' THEN 864 ELSE 858 END ELSE 720 END END AS act_pixel,
    CASE WHEN status = 0 THEN CASE WHEN color = 7 THEN CASE freq WHEN '25' THEN 625 ELSE 525 END WHEN freq IN ('50', '25') THEN 576 ELSE 480 END END AS act_lines, CASE WHEN color = 7 THEN 1 ELSE 2 END AS interlace,
    CASE WHEN status = 0 THEN CASE WHEN color = 7 THEN CASE freq WHEN '25' THEN 15.625::DOUBLE ELSE 15.734264 END WHEN freq IN ('24', '25', '30', 'REAL_24', 'REAL_30') THEN 0.0 WHEN freq = '50' THEN 15.625 WHEN freq = '60' THEN 15.734264 ELSE 15.75 END END AS lin_freq,
    [1, 2, 2, 3, 3, 3, 3, 1, 3][color + 1] AS nr_compon, 4 AS h_pp_size, 3 AS v_pp_size FROM (SELECT *, CASE WHEN freq = '75' OR (color = 7 AND freq NOT IN ('25', '30')) THEN 400 ELSE 0 END AS status FROM ({_REQUESTS_SQL}))"""


@query(_SIMPLE_SQL)
def create_simple(spark, sf_dir):
    h = headers.create_simple_header(_requests(spark, sf_dir).select("path", "color", "freq"))
    fine = lambda c: F.when(F.col("status") == 0, F.col(c)).alias(c)
    return h.select("path", "status", fine("act_pixel"), fine("act_lines"), "interlace", fine("lin_freq"), "nr_compon", "h_pp_size", "v_pp_size")


@query(f"SELECT path, CASE WHEN c = 9 THEN 300 WHEN l < 0 THEN 0 WHEN c = 7 AND l = 0 THEN 223 WHEN l >= parts THEN 0 WHEN c = 6 THEN 222 WHEN c = 8 THEN 224 WHEN l = 0 THEN 220 ELSE 221 END AS status FROM (SELECT path, k % 10 AS c, k // 10 % 4 - 1 AS l, [1, 2, 2, 3, 3, 3, 3, 1, 3, 0][k % 10 + 1] AS parts FROM ({_MADE_SQL}))")
def size_status(spark, sf_dir):
    """Headers of all colour formats, of some of which a component has a line too many."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("path"), (F.col("c_custkey") % 10).alias("color"), *[F.lit(v).alias(n) for n, v in (("f", 50.0), ("l", 15.625), ("p", 13.5), ("n", 576), ("w", 720), ("i", 2), ("h", 4), ("v", 3))])
    h = headers.free_header(c, "color", "f", "l", "p", "n", "w", "i", "h", "v")
    comp = F.transform("comp", lambda x, i: headers.replaced(x, lin_image=x["lin_image"] + F.when(i == F.floor(_k() / 10) % 4 - 1, 1).otherwise(0)))
    return headers.check_header(h.withColumn("comp", comp)).select("path", "status")


@query(f"SELECT path, CAST(CASE k % 9 WHEN 1 THEN 199 WHEN 2 THEN 200 WHEN 3 THEN 229 WHEN 4 THEN 500 WHEN 5 THEN 501 WHEN 6 THEN 502 WHEN 7 THEN [204, 206, 207, 503][CAST(k // 9 % 4 + 1 AS INTEGER)] WHEN 8 THEN 500 ELSE 0 END AS INTEGER) AS status FROM ({_MADE_SQL})")
def range_status(spark, sf_dir):
    """Every code of the range checks, alone and where several fail."""
    at, odd = _k() % 9, F.floor(_k() / 9) % 4
    alter = lambda n, v, c: F.when((at == 7) & (odd == n), v).otherwise(c)
    comp = F.transform("comp", lambda c, i: headers.replaced(c, tem_sbsmpl=alter(0, 2, c["tem_sbsmpl"]), lin_sbsmpl=alter(1, 100, c["lin_sbsmpl"]), pix_sbsmpl=alter(2, -1, c["pix_sbsmpl"]), pix_phshft=alter(3, 100, c["pix_phshft"]), lin_image=F.when((at == 6) & (i == 1), -1).otherwise(c["lin_image"])))
    change = {"nr_images": F.when(at.isin(1, 8), 10_000_000).otherwise(F.col("nr_images")), "nr_compon": F.when(at == 2, 129).otherwise(F.col("nr_compon")), "nr_aux_hdr_recs": F.when(at == 3, 33).otherwise(F.col("nr_aux_hdr_recs")), "act_lines": F.when(at.isin(4, 8), 1_000_000).otherwise(F.col("act_lines")), "interlace": F.when(at == 5, 3).otherwise(F.col("interlace"))}
    return _made(spark, sf_dir).withColumns({"comp": comp, **change}).select("path", headers.basic_status().cast("int").alias("status"))


# --- changes ----------------------------------------------------------------------------------------------------------

_NEW_SQL = f"SELECT *, {_COLOR_SQL} AS old_, k % 10 AS new_ FROM ({_MADE_SQL})"


@query(f"""SELECT path, CASE WHEN old_ <> new_ AND new_ = 9 THEN 300 ELSE 0 END AS status, CAST(CASE WHEN new_ = old_ OR new_ = 9 THEN 2 ELSE [1, 2, 2, 3, 3, 3, 3, 1, 3][new_ + 1] END AS INTEGER) AS nr_compon,
    CAST(CASE WHEN new_ = old_ OR new_ = 9 THEN n1 WHEN new_ IN (0, 7) THEN NULL WHEN new_ IN (2, 5) THEN n // 2 // i ELSE n // i END AS INTEGER) AS lines_1, CAST(CASE WHEN new_ = old_ OR new_ = 9 THEN w1 WHEN new_ IN (0, 7) THEN NULL WHEN new_ IN (4, 5) THEN w // 2 ELSE w END AS INTEGER) AS pixels_1 FROM ({_NEW_SQL})""")
def mod_color_format(spark, sf_dir):
    h = headers.set_color_format(_made(spark, sf_dir), _k() % 10)
    return h.select("path", "status", "nr_compon", _part(1, "lin_image").alias("lines_1"), _part(1, "pix_line").alias("pixels_1"))


@query(f"SELECT path, CASE r WHEN 'x' THEN 600 ELSE 0 END AS status, CAST(CASE r WHEN '16:9' THEN 16 WHEN 'w:h' THEN w // gcd(w, n) ELSE 4 END AS INTEGER) AS h_pp_size, CAST(CASE r WHEN '16:9' THEN 9 WHEN 'w:h' THEN n // gcd(w, n) ELSE 3 END AS INTEGER) AS v_pp_size FROM (SELECT *, ['4:3', '16:9', 'w:h', 'x'][k % 4 + 1] AS r FROM ({_MADE_SQL}))")
def mod_aspect_ratio(spark, sf_dir):
    h = headers.set_aspect_ratio(_made(spark, sf_dir), _array(["4:3", "16:9", "w:h", "x"], _k() % 4))
    return h.select("path", "status", "h_pp_size", "v_pp_size")


@query(f"""SELECT path, CAST(status AS INTEGER) AS status, CAST(CASE WHEN status > 0 THEN w ELSE [176, 352, 720, 1440, 0][k % 5 + 1] END AS INTEGER) AS act_pixel, CAST(CASE WHEN status > 0 THEN n ELSE [144, 288, 576, 1152, 0][k % 5 + 1] END AS INTEGER) AS act_lines, CAST(CASE WHEN status > 0 THEN nr_images ELSE nr_images // i * i END AS INTEGER) AS nr_images
    FROM (SELECT *, CASE WHEN k % 5 = 3 AND i = 1 THEN 702 WHEN k % 5 = 4 AND i = 2 THEN 701 WHEN k % 5 = 4 THEN 700 WHEN {_COLOR_SQL} = 9 THEN 300 ELSE 0 END AS status FROM ({_MADE_SQL}))""")
def mod_defined_size(spark, sf_dir):
    h = headers.set_defined_size(_made(spark, sf_dir), _array(["QCIF", "CIF", "SD", "HDi", "HDp"], _k() % 5), F.lit(0))
    return h.select("path", "status", "act_pixel", "act_lines", "nr_images")


@query(f"SELECT path, CASE WHEN k % 7 = 0 THEN 420 ELSE 0 END AS status, CASE WHEN k % 7 = 0 THEN 50.0::DOUBLE ELSE k % 7 - 1.0 END AS ima_freq, CASE WHEN k % 7 = 0 THEN 15.625::DOUBLE ELSE 2.5 END AS lin_freq FROM ({_MADE_SQL})")
def mod_all_freqs(spark, sf_dir):
    return headers.set_frequencies(_made(spark, sf_dir), _k() % 7 - 1.0, F.lit(2.5), F.lit(3.0)).select("path", "status", "ima_freq", "lin_freq")


_FREQS = ["50", "60", "REAL_60", "25", "24", "REAL_24", "30", "REAL_30", "75"]


@query(f"""SELECT path, CAST(status AS INTEGER) AS status, CASE WHEN status > 0 THEN 50.0 ELSE {_pick('50.0, 59.94, 60, 25, 23.976, 24, 29.97, 30', 'least(k % 9, 7)')}::DOUBLE END AS ima_freq, CAST(CASE WHEN status > 0 OR k % 9 IN (0, 3) THEN n ELSE 480 END AS INTEGER) AS act_lines
    FROM (SELECT *, CASE WHEN k % 9 = 8 THEN 400 WHEN n <> 576 THEN 500 WHEN w <> 720 THEN 710 WHEN {_COLOR_SQL} = 9 THEN 300 ELSE 0 END AS status FROM ({_MADE_SQL}))""")
def mod_defined_freq(spark, sf_dir):
    h = headers.set_defined_frequency(_made(spark, sf_dir), _array(_FREQS, _k() % 9))
    return h.select("path", "status", "ima_freq", "act_lines")


_FMT_SQL = f"""SELECT *, ['B*8 ', 'B*10', 'I*2 ', 'R*2 ', 'X   '][k % 5 + 1] AS fmt, CASE WHEN k % 23 = 7 THEN 'R*2 ' ELSE 'B*8 ' END AS f0, CASE WHEN k % 19 = 6 THEN 'B*10' WHEN k % 23 = 7 THEN 'R*2 ' ELSE 'B*8 ' END AS f1, CASE WHEN {_COLOR_SQL} = 9 THEN 300 WHEN k % 5 > 2 THEN 800 ELSE 0 END AS status FROM ({_MADE_SQL})"""


@query(f"SELECT path, status, CASE WHEN status = 0 THEN fmt ELSE f0 END AS fmt_0, CASE WHEN status = 0 AND {_COLOR_SQL} = 2 THEN fmt ELSE f1 END AS fmt_1 FROM ({_FMT_SQL})")
def mod_data_format(spark, sf_dir):
    h = headers.set_data_format(_made(spark, sf_dir), _array(["B*8 ", "B*10", "I*2 ", "R*2 ", "X   "], _k() % 5))
    return h.select("path", "status", _part(0, "data_fmt").alias("fmt_0"), _part(1, "data_fmt").alias("fmt_1"))


@query(f"SELECT path, CASE WHEN k * 37 % 4096 >= 2048 THEN 225 ELSE 0 END AS status, CASE WHEN k * 37 % 4096 >= 2048 THEN '' ELSE repeat('x', k * 37 % 4096) END AS description FROM ({_MADE_SQL})")
def mod_description(spark, sf_dir):
    return headers.set_description(_made(spark, sf_dir), F.repeat(F.lit("x"), _k() * 37 % 4096)).select("path", "status", "description")


@query(f"SELECT path, 2 AS comp_id, 3 AS nr_compon, 'void ' AS name, CAST(n // i AS INTEGER) AS lines, CAST(w AS INTEGER) AS pixels FROM ({_MADE_SQL})")
def mod_add_component(spark, sf_dir):
    return headers.add_component(_made(spark, sf_dir)).select("path", "comp_id", "nr_compon", _part(2, "com_code").alias("name"), _part(2, "lin_image").alias("lines"), _part(2, "pix_line").alias("pixels"))


_SET_SQL = f"""SELECT *, CASE WHEN k % 13 = 0 THEN 800 WHEN w % (k % 3 + 1) <> 0 OR n % (k % 2 + 1) <> 0 THEN 227 WHEN k % 4 IN (0, 3) THEN 201 ELSE 0 END AS status FROM ({_MADE_SQL})"""


@query(f"""SELECT path, status, CASE WHEN status = 0 AND k % 4 = 1 THEN 'alpha' ELSE 'Y    ' END AS name_0, CASE WHEN status = 0 AND k % 4 = 2 THEN 'alpha' ELSE 'U/V  ' END AS name_1, CAST(CASE WHEN status = 0 AND k % 4 = 2 THEN 2 * w // (k % 3 + 1) ELSE w1 END AS INTEGER) AS pixels_1,
    CAST(CASE WHEN status = 0 AND k % 4 = 2 THEN n // (k % 2 + 1) // i ELSE n1 END AS INTEGER) AS lines_1 FROM ({_SET_SQL})""")
def mod_set_component(spark, sf_dir):
    h = headers.set_component(_made(spark, sf_dir), _k() % 4 - 1, F.lit("alphabet"), F.when(_k() % 13 == 0, "X").otherwise("B*8 "), _k() % 3 + 1, _k() % 2 + 1, F.lit(2))
    return h.select("path", "status", _part(0, "com_code").alias("name_0"), _part(1, "com_code").alias("name_1"), _part(1, "pix_line").alias("pixels_1"), _part(1, "lin_image").alias("lines_1"))


@query(f"SELECT path, CASE WHEN k % 5 > 2 THEN 201 ELSE 0 END AS status, CAST(CASE WHEN k % 5 IN (1, 2) THEN 1 ELSE 2 END AS INTEGER) AS nr_compon, CASE k % 5 WHEN 1 THEN 'U/V  ' ELSE 'Y    ' END AS name_0 FROM ({_MADE_SQL})")
def mod_rm_component(spark, sf_dir):
    h = headers.remove_component(_made(spark, sf_dir), _k() % 5 - 1)
    return h.select("path", "status", "nr_compon", _part(0, "com_code").alias("name_0"))


@query(f"SELECT path, CASE WHEN c = 9 THEN 300 ELSE 0 END AS status, CAST(CASE c WHEN 9 THEN 3 WHEN 2 THEN 2 ELSE 1 END AS INTEGER) AS nr_compon FROM (SELECT path, {_COLOR_SQL} AS c FROM ({_MADE_SQL}))")
def mod_rm_extras(spark, sf_dir):
    return headers.remove_extra_components(headers.add_component(_made(spark, sf_dir))).select("path", "status", "nr_compon")


_LANGS = "SELECT source, lang, max(n_chars) % 500 AS m FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source, lang"


def _catalogue(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("source IS NOT NULL AND lang IS NOT NULL")
    per = d.groupBy("source", "lang").agg((F.max("n_chars") % 500).cast("int").alias("max_size"))
    return per.groupBy("source").agg(F.array_sort(F.collect_list(F.struct(F.col("lang").alias("name"), "max_size", F.lit(b"").alias("description")))).alias("aux"))


@query(f"SELECT source, CAST(CASE WHEN a THEN c + 1 ELSE c END AS INTEGER) AS entries, CAST(CASE WHEN a THEN c ELSE -1 END AS INTEGER) AS aux_id, CAST(ceil((s + CASE WHEN a THEN 108 ELSE 0 END) / 512) AS INTEGER) AS records FROM (SELECT source, count(*) AS c, sum(CASE WHEN m > 0 THEN m + 8 ELSE 0 END) AS s, length(source) % 2 = 0 AS a FROM ({_LANGS}) GROUP BY source)")
def aux_add(spark, sf_dir):
    """A new entry for sources whose name has an even length; the others ask for one that is there."""
    a = _catalogue(spark, sf_dir).withColumn("bytes_rec", F.lit(512))
    name = F.when(F.length("source") % 2 == 0, F.lit("a name beyond sixteen characters")).otherwise(F.col("aux")[0]["name"])
    return auxiliary.add_aux(a, name, F.lit(100)).select("source", F.size("aux").alias("entries"), "aux_id", F.col("nr_aux_data_recs").alias("records"))


@query(f"SELECT source, CASE WHEN k < c THEN 0 ELSE 205 END AS status, CAST(CASE WHEN k < c THEN c - 1 ELSE c END AS INTEGER) AS entries, CAST(ceil(s / 512) AS INTEGER) AS records FROM (SELECT source, any_value(length(source)) % 6 AS k, count(*) AS c, sum(CASE WHEN m > 0 AND pos <> length(source) % 6 THEN m + 8 ELSE 0 END) AS s FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lang) - 1 AS pos FROM ({_LANGS})) GROUP BY source)")
def aux_remove(spark, sf_dir):
    a = _catalogue(spark, sf_dir).withColumn("bytes_rec", F.lit(512))
    return auxiliary.remove_aux(a, F.length("source") % 6).select("source", "status", F.size("aux").alias("entries"), F.col("nr_aux_data_recs").alias("records"))


@query(f"SELECT source, CAST(coalesce(min(CASE WHEN lang = 'fr' THEN pos END), -1) AS INTEGER) AS number, max(CASE WHEN pos = 1 THEN lang END) AS second, CASE WHEN count(*) > 1 THEN 0 ELSE 205 END AS status FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY lang) - 1 AS pos FROM ({_LANGS})) GROUP BY source")
def aux_entries(spark, sf_dir):
    a = _catalogue(spark, sf_dir)
    entry, status = auxiliary.entry(F.lit(1))
    return a.select("source", auxiliary.entry_number(F.lit("fr  ")).alias("number"), entry["name"].alias("second"), status.alias("status"))


# --- getters ----------------------------------------------------------------------------------------------------------


@query(f"SELECT path, CAST(nr_images // i AS INTEGER) AS frames, i = 2 AS interlaced, i = 1 AS progressive FROM ({_MADE_SQL})")
def get_frames(spark, sf_dir):
    return _made(spark, sf_dir).select("path", headers.num_frames().alias("frames"), headers.is_interlaced().alias("interlaced"), headers.is_progressive().alias("progressive"))


@query(f"SELECT path, CAST(w AS INTEGER) AS width, CAST(n AS INTEGER) AS height, CAST([w0, w1, NULL][k % 3 + 1] AS INTEGER) AS comp_width, CAST([n0, n1, NULL][k % 3 + 1] AS INTEGER) AS comp_height, CASE WHEN k % 3 = 2 THEN 201 ELSE 0 END AS status FROM ({_MADE_SQL})")
def get_sizes(spark, sf_dir):
    (w, h), (cw, ch, status) = headers.frame_size(), headers.buffer_size(_k() % 3)
    return _made(spark, sf_dir).select("path", w.alias("width"), h.alias("height"), cw.alias("comp_width"), ch.alias("comp_height"), status.alias("status"))


@query(f"SELECT path, f0 AS fmt, nr_images, 50.0::DOUBLE AS ima_freq, 15.625::DOUBLE AS lin_freq, 13.5::DOUBLE AS pix_freq, '' AS description, 2 AS count FROM ({_FMT_SQL})")
def get_fields(spark, sf_dir):
    return _made(spark, sf_dir).select("path", headers.data_format().alias("fmt"), "nr_images", "ima_freq", "lin_freq", "pix_freq", "description", F.col("nr_compon").alias("count"))


@query(f"SELECT path, CAST(c AS INTEGER) AS number, ['Y', 'U/V'][c + 1] AS name, [f0, f1][c + 1] AS data_fmt, [1, 2][c + 1] AS pix_sbsmpl, [1, 2][c + 1] AS lin_sbsmpl, CAST([w0 // w, w1 * 2 // w][c + 1] AS INTEGER) AS multiplex FROM ({_FMT_SQL}), (SELECT unnest([0, 1]) AS c)")
def get_components(spark, sf_dir):
    return headers.components(_made(spark, sf_dir))


@query(f"SELECT path, CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE -1 END AS number FROM ({_MADE_SQL})")
def component_by_name(spark, sf_dir):
    return _made(spark, sf_dir).select("path", headers.component_number(_array(["Y", "U/V  x", "U"], _k() % 3)).alias("number"))


_LABELS = (("nr_images", "number of images"), ("2", "number of components"), ("36", "number of file description records"), ("0", "number of auxiliary data records"), ("'VIDEO                    '", "application type"), ("512", "bytes per record"), ("1", "little endian"), ("32", "number of auxiliary header records"), ("'50.000000'", "image frequency"), ("'15.625000'", "line frequency"), ("'13.500000'", "pixel frequency"), ("n", "active lines"), ("w", "active pixels"), ("i", "interlace factor"), ("4", "horizontal proportional picture size"), ("3", "vertical proportional picture size"))
_PART_LABELS = (("n{0}", "lines per image"), ("w{0}", "pixels per line"), ("f{0}", "data format"), ("1", "temporal subsampling"), ("1 + {0}", "line subsampling"), ("1 + {0}", "pixel subsampling"), ("0", "temporal phase shift"), ("0", "line phase shift"), ("0", "pixel phase shift"), ("['Y    ', 'U/V  '][1 + {0}]", "component code"))
_TEXT_SQL = " || chr(10) || ".join(["'GLOBAL'", *[f"rpad('{t}', 36, ' ') || ' : ' || {v}" for v, t in _LABELS], *[x for k in (0, 1) for x in (f"'COMPONENT {k}'", *[f"rpad('{t}', 20, ' ') || ' : ' || ({v.format(k)})" for v, t in _PART_LABELS])]])


@query(f"SELECT path, {_TEXT_SQL} AS text, 0 AS status FROM ({_FMT_SQL})")
def header_text(spark, sf_dir):
    return headers.printed(_made(spark, sf_dir))


# --- checks and small rules -------------------------------------------------------------------------------------------

_COLORS_SQL = "SELECT o_orderkey, CAST(o_orderkey % 10 AS INTEGER) AS c, CAST(o_custkey % 2 + 1 AS INTEGER) AS i FROM orders"


@query(f"""SELECT o_orderkey, CAST(CASE WHEN c IN (0, 1, 2, 7) THEN 0 ELSE 242 END AS INTEGER) AS multiplexed_frame, CAST(CASE WHEN c NOT IN (0, 1, 2) THEN 242 WHEN i = 1 THEN 210 ELSE 0 END AS INTEGER) AS multiplexed_field, CAST(CASE WHEN c IN (0, 3, 4, 5, 6, 8) THEN 0 ELSE 243 END AS INTEGER) AS planar_frame,
    CAST(CASE WHEN c NOT IN (0, 3, 4, 5, 6, 8) THEN 243 WHEN i = 1 THEN 210 ELSE 0 END AS INTEGER) AS planar_field, 0 AS component_frame, CAST(CASE WHEN i = 1 THEN 210 ELSE 0 END AS INTEGER) AS component_field FROM ({_COLORS_SQL})""")
def access(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 10).alias("c"), (F.col("o_custkey") % 2 + 1).alias("i"))
    return o.select("o_orderkey", *[headers.access_status(F.col("c"), F.col("i"), kind, field).cast("int").alias(f"{kind}_{'field' if field else 'frame'}") for kind in ("multiplexed", "planar", "component") for field in (False, True)])


@query("SELECT o_orderkey, CASE WHEN n NOT BETWEEN 0 AND 2 THEN 218 ELSE 0 END AS reading, CASE WHEN n NOT BETWEEN 0 AND 2 THEN 219 ELSE 0 END AS writing FROM (SELECT o_orderkey, o_orderkey % 6 - 1 AS n FROM orders)")
def component_id(spark, sf_dir):
    n = F.col("o_orderkey") % 6 - 1
    return table(spark, sf_dir, "orders").select("o_orderkey", headers.component_id_status(n, F.lit(3)).alias("reading"), headers.component_id_status(n, F.lit(3), writing=True).alias("writing"))


@query("SELECT o_orderkey, CAST(w // p * m AS INTEGER) AS width, CAST(h // l AS INTEGER) AS height FROM (SELECT o_orderkey, o_orderkey % 2000 AS w, o_custkey % 1100 AS h, o_orderkey % 2 + 1 AS p, o_custkey % 2 + 1 AS l, o_orderkey // 2 % 2 + 1 AS m FROM orders)")
def requested_sizes(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    w, h = raster.requested_size(k % 2000, c % 1100, k % 2 + 1, c % 2 + 1, (F.floor(k / 2) % 2 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", w.alias("width"), h.alias("height"))


@query("SELECT event_id, list_contains([0, 32, 85, 81], event_id % 128) AS little FROM events")
def endian_codes(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.is_little_endian(F.char(F.col("event_id") % 128)).alias("little"))


_FILE, _MEMORY = ["B*8 ", "B*10", "B*12", "B*14", "I*2 ", "R*2 "], ["8", "10", "12", "14", "16", "16_LSB", "AF"]


@query("SELECT event_id, CASE WHEN f = 0 THEN m IN (0, 6) WHEN f IN (4, 5) THEN m IN (4, 6) AND little ELSE false END AS plain FROM (SELECT event_id, event_id % 6 AS f, event_id // 6 % 7 AS m, event_id // 42 % 2 = 0 AS little FROM events)")
def fast_path(spark, sf_dir):
    """May the bytes of a plane pass unchanged? For every file format, memory format and byte order."""
    k = F.col("event_id")
    at = (k % 6, F.floor(k / 6) % 7, F.floor(k / 42) % 2 == 0)
    out = F.lit(None).cast("boolean")
    for f, file in enumerate(_FILE):
        for m, mem in enumerate(_MEMORY):
            for little in (True, False):
                out = F.when((at[0] == f) & (at[1] == m) & (at[2] == little), samples.no_conversion(file, mem, little)).otherwise(out)
    return table(spark, sf_dir, "events").select("event_id", out.alias("plain"))


@query("SELECT o_orderkey, [9, 99, 99999, 999999, 9999999][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS largest, o_custkey * 500 <= [9, 99, 99999, 999999, 9999999][CAST(o_orderkey % 5 + 1 AS INTEGER)] AS fits FROM orders")
def field_limits(spark, sf_dir):
    most = _array([samples.largest_decimal(n) for n in (1, 2, 5, 6, 7)], F.col("o_orderkey") % 5)
    return table(spark, sf_dir, "orders").select("o_orderkey", most.alias("largest"), (F.col("o_custkey") * 500 <= most).alias("fits"))


@query(r"""SELECT o_orderkey, CASE WHEN trim(f) = '' THEN 0 WHEN regexp_full_match(trim(f), '[+-]?[0-9]+') THEN CAST(trim(f) AS INTEGER) END AS number, CASE WHEN trim(f) = '' OR regexp_full_match(trim(f), '[+-]?[0-9]+') THEN 0 ELSE 103 END AS status
    FROM (SELECT o_orderkey, CASE CAST(o_orderkey % 6 AS INTEGER) WHEN 0 THEN '       ' WHEN 1 THEN '   ' || o_custkey WHEN 2 THEN ' -12   ' WHEN 3 THEN '  1 2  ' WHEN 4 THEN left(o_orderpriority, 7) ELSE '   +7' END AS f FROM orders)""")
def text_syntax(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    f = F.when(k == 0, "       ").when(k == 1, F.concat(F.lit("   "), F.col("o_custkey").cast("string"))).when(k == 2, " -12   ").when(k == 3, "  1 2  ").when(k == 4, F.substring("o_orderpriority", 1, 7)).otherwise("   +7")
    n = text.parse_int(F.col("f"))
    return table(spark, sf_dir, "orders").select("o_orderkey", f.alias("f")).select("o_orderkey", n.alias("number"), F.when(n.isNull(), 103).otherwise(0).alias("status"))


@query(f"SELECT path, {_FREQ_SQL.format('ima_freq')} AS freq, CASE WHEN n IN (576) THEN 'SD' ELSE 'UNKNOWN' END AS size, '4:3' AS aspect FROM (SELECT *, 50.0::DOUBLE + k % 3 * 4.97 AS ima_freq FROM ({_MADE_SQL}))")
def get_classes(spark, sf_dir):
    h = _made(spark, sf_dir).withColumn("ima_freq", F.lit(50.0) + _k() % 3 * 4.97)
    return h.select("path", headers.frequency_class(F.col("ima_freq")).alias("freq"), headers.size_class().alias("size"), headers.aspect_class().alias("aspect"))
