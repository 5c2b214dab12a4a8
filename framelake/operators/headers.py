"""Header creation, changes, getters and validation on the table `sequences`.

A header is a row. Operators take and return DataFrames and never raise on data: what fails is told by
the column `status` (0: fine; see dims.STATUS), and a row that fails is left as it was.
With strict=True, strictly() turns a status into an error when the row is computed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions import dims
from framelake.functions.samples import gcd
from framelake.functions.text import padded_name, plain_name
from framelake.plans import layout

COMPONENT = "struct<lin_image:int,pix_line:int,data_fmt:string,tem_sbsmpl:int,lin_sbsmpl:int,pix_sbsmpl:int,tem_phshft:int,lin_phshft:int,pix_phshft:int,com_code:string>"
AUX = "struct<name:string,max_size:int,description:binary>"
SCHEMA = (
    "path string, nr_images int, nr_compon int, nr_fd_recs int, nr_aux_data_recs int, appl_type string, bytes_rec int, little_endian boolean, nr_aux_hdr_recs int, ima_freq double, lin_freq double, pix_freq double, "
    f"act_lines int, act_pixel int, interlace int, h_pp_size int, v_pp_size int, comp array<{COMPONENT}>, description string, aux array<{AUX}>, status int"
)


def whole_div(a: Column, b: Column | int) -> Column:
    """Integer quotient toward zero; null for a zero divisor."""
    b = b if isinstance(b, Column) else F.lit(b)
    return F.try_divide(a.cast("double"), b.cast("double")).cast("long").cast("int")


def component(name: str | Column, fmt: str | Column, lines: Column, pixels: Column, pss: Column, lss: Column) -> Column:
    zero = F.lit(0)
    fields = {"lin_image": lines, "pix_line": pixels, "data_fmt": fmt if isinstance(fmt, Column) else F.lit(fmt), "tem_sbsmpl": F.lit(1), "lin_sbsmpl": lss, "pix_sbsmpl": pss, "tem_phshft": zero, "lin_phshft": zero, "pix_phshft": zero, "com_code": name if isinstance(name, Column) else F.lit(name.ljust(5))}
    return F.struct(*[c.cast("string" if k in ("data_fmt", "com_code") else "int").alias(k) for k, c in fields.items()])


_FIELDS = dict(x.split(":") for x in COMPONENT[len("struct<") : -1].split(","))


def replaced(c: Column, **fields: Column) -> Column:
    """A component with some fields replaced."""
    return F.struct(*[(fields[k].cast(t) if k in fields else c[k]).alias(k) for k, t in _FIELDS.items()])


def strictly(df: DataFrame) -> DataFrame:
    """The same rows; a row with a status other than 0 raises when it is computed."""
    said = F.concat(F.col("status").cast("string"), F.lit(": "), F.coalesce(error_text(F.col("status")), F.lit("unknown status")))
    return df.withColumn("status", F.when(F.coalesce("status", F.lit(0)) == 0, F.lit(0)).otherwise(F.raise_error(said).cast("int")))


def _guarded(df: DataFrame, status: Column, changes: dict[str, Column]) -> DataFrame:
    """Applies changes where status is 0, all from the old row; status becomes the new status."""
    df = df.withColumn("_s", status)
    return df.withColumns({k: F.when(F.col("_s") == 0, v).otherwise(F.col(k)) for k, v in changes.items()} | {"status": F.col("_s")}).drop("_s")


# --- colour formats and validation ------------------------------------------------------------------------------------


def _color_parts(color: int) -> Column:
    return F.array(*[F.struct(F.lit(n.ljust(5)).alias("name"), F.lit(p).alias("p"), F.lit(l).alias("l"), F.lit(m).alias("m")) for n, p, l, m in dims.COLORS[color][1]])


def parts_of(color: Column) -> Column:
    """Name, subsampling (p, l) and multiplex (m) of the components of a colour format; null for one that there isn't. A constant table."""
    return F.get(F.array(*[_color_parts(k) for k in sorted(dims.COLORS)]), F.when(color.between(0, max(dims.COLORS)), color).cast("int"))


def color_of(comp: Column, act_pixel: Column) -> Column:
    """The last colour format whose components all match by name, subsampling and width; 9 if none does."""
    patterns = F.array(*[F.struct(F.lit(k).alias("color"), _color_parts(k).alias("parts")) for k in dims.MATCHED])

    def fits(pattern: Column) -> Column:
        n = F.size(pattern["parts"])
        same = lambda a, c: (F.rpad(c["com_code"], 5, " ") == a["name"]) & (c["pix_sbsmpl"] == a["p"]) & (c["lin_sbsmpl"] == a["l"]) & (c["pix_line"] * c["pix_sbsmpl"] == act_pixel * a["m"])
        return (F.size(comp) >= n) & F.forall(F.zip_with(pattern["parts"], F.slice(comp, 1, n), same), lambda x: F.coalesce(x, F.lit(False)))

    found = F.transform(F.filter(patterns, fits), lambda p: p["color"])
    return F.coalesce(F.element_at(F.concat(F.array(F.lit(dims.UNKNOWN_COLOR)), found), -1), F.lit(dims.UNKNOWN_COLOR))


def _first(*stages: tuple[Column, int]) -> Column:
    """Status of the first condition that holds, else 0."""
    out = F.lit(0)
    for fails, code in reversed(stages):
        out = F.when(fails, code).otherwise(out)
    return out


def basic_status() -> Column:
    """Ranges. Within the global block the last test wins; components are looked at in order up to the first that fails."""
    between = lambda c, a, b: (c >= a) & (c <= b)
    big, col = 999_999, F.col
    global_ = _first(
        (~between(col("interlace"), 0, 2), 501), (~between(col("act_pixel"), 0, big) | ~between(col("act_lines"), 0, big), 500), (col("nr_aux_hdr_recs").cast("long") * col("bytes_rec") > dims.AUX_BYTES, 229),
        (~between(col("nr_compon"), 0, dims.MAX_COMPONENTS), 200), (~between(col("nr_images"), 0, dims.MAX_IMAGES), 199),
    )
    one = lambda c: _first(
        (~between(c["tem_phshft"], 0, 99) | ~between(c["lin_phshft"], 0, 99) | ~between(c["pix_phshft"], 0, 99), 503), (~between(c["pix_sbsmpl"], 0, 99), 207), (~between(c["lin_sbsmpl"], 0, 99), 206), (c["tem_sbsmpl"] != 1, 204),
        (~between(c["lin_image"], 0, big) | ~between(c["pix_line"], 0, big), 502),
    )
    parts = F.coalesce(F.get(F.filter(F.transform("comp", one), lambda s: s != 0), 0), F.lit(0))
    return F.when(global_ != 0, global_).otherwise(parts)


def size_status(color: Column) -> Column:
    """C4: sizes of the first component or all of RGB and XYZ, then chrominance, then extra components (but for padding)."""
    w, h, i = F.col("act_pixel"), F.col("act_lines"), F.col("interlace")
    c = lambda k: F.get(F.col("comp"), k)
    full = lambda k: (c(k)["pix_line"] == w) & (c(k)["lin_image"] * i == h)
    sub = lambda k, many=1: (c(k)["pix_line"] * c(k)["pix_sbsmpl"] == w * many) & (c(k)["lin_image"] * c(k)["lin_sbsmpl"] * i == h)
    extra_ok = lambda x: (F.rpad(x["com_code"], 5, " ") == "P    ") | ((x["pix_line"] * x["pix_sbsmpl"] % F.nullif(w, F.lit(0)) == 0) & (x["lin_image"] * x["lin_sbsmpl"] * i == h))
    n = standard_count(color)
    extras = F.exists(F.filter("comp", lambda x, k: k >= n), lambda x: ~F.coalesce(extra_ok(x), F.lit(False)))
    three = full(0) & full(1) & full(2)
    return _first(
        (color == dims.UNKNOWN_COLOR, 300), (color.isin(0, 1, 2, 3, 4, 5) & ~full(0), 220), ((color == 7) & ~full(0), 223), ((color == 6) & ~three, 222), ((color == 8) & ~three, 224),
        (color.isin(1, 2) & ~sub(1, 2), 221), (color.isin(3, 4, 5) & ~(sub(1) & sub(2)), 221), (extras, 226),
    )


def standard_count(color: Column) -> Column:
    """Components of a colour format; 0 for one that there isn't."""
    return F.coalesce(F.get(F.array(*[F.lit(dims.STANDARD_COMPONENTS[k]) for k in sorted(dims.COLORS)]), color.cast("int")), F.lit(0))


def format_status(color: Column) -> Column:
    """Unknown formats, or half floats outside RGB and XYZ (800), go before unequal ones (810); standard components only."""
    own = F.slice("comp", 1, F.greatest(standard_count(color), F.lit(1)))
    fmt = F.get(F.col("comp"), 0)["data_fmt"]
    return _first((~F.coalesce(fmt.isin(*dims.DATA_FORMATS), F.lit(False)) | ((fmt == "R*2 ") & ~color.isin(6, 8)), 800), (~F.forall(own, lambda c: c["data_fmt"] == fmt), 810))


def check_header(df: DataFrame, checks: bool = True, strict: bool = False) -> DataFrame:
    """Adds status and color_format. The first stage that fails counts: ranges, then (with checks) colour, sizes, data formats."""
    color = color_of(F.col("comp"), F.col("act_pixel"))
    basic = basic_status()
    df = df.withColumns({"color_format": color, "_basic": basic})
    c = F.col("color_format")
    stages = [F.col("_basic")]
    if checks:
        stages += [F.when(c == dims.UNKNOWN_COLOR, 300).otherwise(0), size_status(c), format_status(c)]
    status = F.coalesce(*[F.nullif(s, F.lit(0)) for s in stages], F.lit(0))
    df = df.withColumn("status", status.cast("int")).drop("_basic")
    return strictly(df) if strict else df


def access_status(color: Column, interlace: Column, kind: str, field: bool) -> Column:
    """May such a file be read or written by multiplexed, planar or component access, by frames or by fields?"""
    if kind == "multiplexed":
        wrong = ~color.isin(0, 1, 2) if field else ~color.isin(0, 1, 2, 7)
        code = 242
    elif kind == "planar":
        wrong, code = ~color.isin(0, 3, 4, 5, 6, 8), 243
    else:
        wrong, code = F.lit(False), 0
    return _first((wrong, code), (F.lit(field) & (interlace != 2), 210))


def component_id_status(number: Column, count: Column, writing: bool = False) -> Column:
    """Is there such a component?"""
    return F.when((number < 0) | (number >= count), 219 if writing else 218).otherwise(0)


def rewrite_status(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """S3: key, status: may the new header replace the old one in its file?

    Counts, record sizes, byte order, interlace factor, and the numbers of samples (as products) must agree; then each component's
    size and format; then a description needs records; then the sizes of auxiliary entries that have data, in order.
    """
    o, n = old.alias("o"), new.alias("n")
    same = ["nr_images", "nr_compon", "nr_fd_recs", "nr_aux_data_recs", "bytes_rec", "little_endian", "nr_aux_hdr_recs", "interlace"]
    other = F.lit(False)
    for k in same:
        other = other | ~F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}"))
    area = lambda t: F.col(f"{t}.act_lines").cast("long") * F.col(f"{t}.act_pixel")
    shape = lambda t: F.transform(F.col(f"{t}.comp"), lambda c: F.struct((c["lin_image"].cast("long") * c["pix_line"]).alias("a"), c["data_fmt"].alias("f")))
    data = lambda t: F.transform(F.filter(F.coalesce(F.col(f"{t}.aux"), F.array().cast(f"array<{AUX}>")), lambda a: a["max_size"] > 0), lambda a: a["max_size"])
    status = _first((other | (area("o") != area("n")), 117), (shape("o") != shape("n"), 117), ((F.col("n.nr_fd_recs") == 0) & (F.coalesce(F.col("n.description"), F.lit("")) != ""), 225), (data("o") != data("n"), 117))
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}")).select(F.col(f"o.{key}").alias(key), status.alias("status"))


# --- creation ---------------------------------------------------------------------------------------------------------


def built_components(color: Column, act_pixel: Column, act_lines: Column, interlace: Column, fmt: Column | str = "B*8 ") -> Column:
    """Components of a colour format: lines / subsampling / interlace factor, pixels * multiplex / subsampling."""
    return F.transform(parts_of(color), lambda a: component(a["name"], fmt, whole_div(whole_div(act_lines, a["l"]), interlace), whole_div(act_pixel * a["m"], a["p"]), a["p"], a["l"]))


def _undivided(color: Column, act_pixel: Column, act_lines: Column) -> Column:
    return F.coalesce(F.exists(parts_of(color), lambda a: (act_pixel % a["p"] != 0) | (act_lines % a["l"] != 0)), F.lit(False))


def free_header(df: DataFrame, color: str, ima_freq: str, lin_freq: str, pix_freq: str, lines: str, pixels: str, interlace: str, h_pp: str, v_pp: str, status: Column | None = None, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """H3: headers from columns of df with these names; 300 for an unknown colour, 227 where subsampling doesn't divide the size."""
    col = F.col
    known = F.coalesce(col(color).isin(*dims.COLORS), F.lit(False))
    own = F.when(~known, 300).when(_undivided(col(color), col(pixels), col(lines)), 227).otherwise(0)
    status = own if status is None else F.when(status != 0, status).otherwise(own)
    comp = F.coalesce(built_components(col(color), col(pixels), col(lines), col(interlace)), F.array().cast(f"array<{COMPONENT}>"))
    fd = (dims.DESCRIPTION_BYTES + dims.AUX_BYTES) // dims.RECORD_BYTES
    new = {
        "path": col("path") if "path" in df.columns else F.lit(None).cast("string"), "nr_images": F.lit(0), "nr_compon": F.size(comp), "nr_fd_recs": F.lit(fd), "nr_aux_data_recs": F.lit(0), "appl_type": F.lit("VIDEO".ljust(25)), "bytes_rec": F.lit(dims.RECORD_BYTES), "little_endian": F.lit(True), "nr_aux_hdr_recs": F.lit(dims.AUX_BYTES // dims.RECORD_BYTES),
        "ima_freq": col(ima_freq).cast("double"), "lin_freq": col(lin_freq).cast("double"), "pix_freq": col(pix_freq).cast("double"), "act_lines": col(lines).cast("int"), "act_pixel": col(pixels).cast("int"), "interlace": col(interlace).cast("int"), "h_pp_size": col(h_pp).cast("int"), "v_pp_size": col(v_pp).cast("int"),
        "comp": comp, "description": F.lit(""), "aux": F.array().cast(f"array<{AUX}>"), "status": status.cast("int"),
    }
    return df.select(*[col(k) for k in keep if k in df.columns and k not in new], *[v.alias(k) for k, v in new.items()])


def rasters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(dims.raster_rows(), "r_stream boolean, r_freq string, r_size string, r_ask int, r_width int, r_lines int, r_khz double, r_mhz double")


def creation_status(size: Column, freq: Column, progressive: Column, color: Column) -> Column:
    """Later tests win."""
    return _first(((color == 7) & ~progressive, 703), ((size == "HDi") & progressive, 702), ((size == "HDp") & ~progressive, 701), ((size == "HDp") & freq.isin("50", "25"), 700))


def create_header(df: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """H2: a header for each row of df: color int, freq, size string, ppl int (0: default), progressive boolean, ratio string (4:3, 16:9, w:h; else automatic).

    Legality first, then the standard raster (a broadcast join to a constant table) with its corrections: film rates have no line and
    pixel frequency, progressive pictures twice the interlaced ones, streams are progressive with plain ones.
    """
    r = rasters(df.sparkSession)
    col = F.col
    stream = col("color") == 7
    joined = df.join(F.broadcast(r), (stream == col("r_stream")) & (col("freq") == col("r_freq")) & (col("size") == col("r_size")) & (col("ppl") == col("r_ask")), "left")
    legal = creation_status(col("size"), col("freq"), col("progressive"), col("color"))
    known = F.when(stream, col("freq").isin("25", "30")).otherwise(col("freq").isin(*dims.FREQUENCIES))
    sized = F.when(stream, col("size") == "SD").otherwise(col("size").isin(*dims.SIZES) & ~((col("size") == "HDp") & col("freq").isin("50", "25")))
    asked = col("ratio").isin("4:3", "16:9", "w:h", "auto")
    status = _first((legal != 0, -1), (~F.coalesce(known, F.lit(False)), 400), (~F.coalesce(sized, F.lit(False)), 500), (col("r_width").isNull(), 710), (~F.coalesce(asked, F.lit(False)), 600))
    film = col("freq").isin(*dims.FILM) & ~stream
    twice = F.when(film, 0.0).when(col("progressive") & ~stream, 2.0).otherwise(1.0)
    wide = F.when(stream, col("ppl") > 720).when(col("size").isin("HDp", "HDi"), True)
    for s, w in dims.NARROW.items():
        wide = wide.when(col("size") == s, col("ppl") > w)
    g = gcd(col("r_width"), col("_lines"))
    freq = F.coalesce(*[F.when(col("freq") == k, v) for k, v in dims.FREQUENCIES.items()])
    joined = joined.withColumns({"_legal": F.when(status == -1, legal).otherwise(status), "_lines": col("r_lines"), "_w": wide, "_ima": freq, "_lin": F.coalesce("r_khz", F.lit(0.0)) * twice, "_pix": F.coalesce("r_mhz", F.lit(0.0)) * twice, "_int": F.when(col("progressive") | stream, 1).otherwise(2)})
    h = F.when(col("ratio") == "4:3", 4).when(col("ratio") == "16:9", 16).when(col("ratio") == "w:h", whole_div(col("r_width"), g)).when(col("_w"), 16).otherwise(4)
    v = F.when(col("ratio") == "4:3", 3).when(col("ratio") == "16:9", 9).when(col("ratio") == "w:h", whole_div(col("_lines"), g)).when(col("_w"), 9).otherwise(3)
    joined = joined.withColumns({"_h": h, "_v": v})
    return free_header(joined, "color", "_ima", "_lin", "_pix", "_lines", "r_width", "_int", "_h", "_v", col("_legal"), keep)


def create_simple_header(df: DataFrame, keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """H1: SD, 4:3, interlaced (streams progressive), from color and freq."""
    more = {"size": F.lit("SD"), "ppl": F.lit(0), "progressive": F.col("color") == 7, "ratio": F.lit("4:3")}
    return create_header(df.withColumns(more), keep)


# --- changes ----------------------------------------------------------------------------------------------------------


def set_num_frames(df: DataFrame, n: Column) -> DataFrame:
    """H4."""
    return df.withColumn("nr_images", (n * F.col("interlace")).cast("int"))


def _color() -> Column:
    return color_of(F.col("comp"), F.col("act_pixel"))


def _fresh(df: DataFrame, changes: dict[str, Column], status: Column) -> DataFrame:
    """What a rebuild from the standard catalogue loses: extra components, description, auxiliary data."""
    lost = {"description": F.lit(""), "aux": F.array().cast(f"array<{AUX}>"), "nr_aux_data_recs": F.lit(0)}
    return _guarded(df, status, changes | lost)


def set_color_format(df: DataFrame, color: Column) -> DataFrame:
    """H5: rebuilds the components if the format is another one; geometry, frequencies, aspect, frames and data format stay."""
    df = df.withColumns({"_old": _color(), "_new": color})
    fmt = F.get(F.col("comp"), 0)["data_fmt"]
    comp = built_components(F.col("_new"), F.col("act_pixel"), F.col("act_lines"), F.col("interlace"), fmt)
    status = F.when(F.col("_old") == F.col("_new"), -1).when(~F.col("_new").isin(*dims.COLORS), 300).when(_undivided(F.col("_new"), F.col("act_pixel"), F.col("act_lines")), 227).otherwise(0)
    out = _fresh(df, {"comp": comp, "nr_compon": F.size(comp)}, status)
    return out.withColumn("status", F.greatest("status", F.lit(0))).drop("_old", "_new")


def set_aspect_ratio(df: DataFrame, ratio: Column) -> DataFrame:
    """H6: 4:3, 16:9, or w:h of the picture in lowest terms; else 600."""
    g = gcd(F.col("act_pixel"), F.col("act_lines"))
    pick = lambda a, b, c: F.when(ratio == "4:3", a).when(ratio == "16:9", b).otherwise(whole_div(F.col(c), g))
    return _guarded(df, F.when(ratio.isin("4:3", "16:9", "w:h"), 0).otherwise(600), {"h_pp_size": pick(4, 16, "act_pixel"), "v_pp_size": pick(3, 9, "act_lines")})


def _scan(df: DataFrame, old: int, lines, images: Column, factor: float, new: int) -> DataFrame:
    df = df.withColumn("_n", F.when(_color() == 7, 0).otherwise(standard_count(_color())))
    comp = F.transform("comp", lambda c, i: F.when(i < F.col("_n"), replaced(c, lin_image=lines(c["lin_image"]))).otherwise(c))
    is_old = F.col("interlace") == old
    out = {"comp": comp, "nr_images": images.cast("int"), "lin_freq": F.col("lin_freq") * factor, "pix_freq": F.col("pix_freq") * factor, "interlace": F.lit(new)}
    return df.withColumns({k: F.when(is_old, v).otherwise(F.col(k)) for k, v in out.items()} | {"status": F.lit(0)}).drop("_n")


def to_progressive(df: DataFrame) -> DataFrame:
    """H7: if interlaced, half the images, twice the lines of standard components and the line and pixel frequency. Streams keep their lines."""
    return _scan(df, 2, lambda n: n * 2, whole_div(F.col("nr_images"), 2), 2.0, 1)


def to_interlaced(df: DataFrame) -> DataFrame:
    """H8: the inverse; an odd line is lost."""
    return _scan(df, 1, lambda n: whole_div(n, 2), F.col("nr_images") * 2, 0.5, 2)


def _rate(df: DataFrame, factor: float) -> DataFrame:
    fine = F.when(frequency_class(F.col("ima_freq")).isin("50", "60", "REAL_60"), 0).otherwise(410)
    return _guarded(df, fine, {"nr_images": F.floor(F.col("nr_images") * F.lit(factor)).cast("int")} | {k: F.col(k) * factor for k in ("ima_freq", "lin_freq", "pix_freq")})


def to_double_rate(df: DataFrame) -> DataFrame:
    """H9: from 50, 59.94 or 60 Hz only, else 410."""
    return _rate(df, 2.0)


def to_one_and_half_rate(df: DataFrame) -> DataFrame:
    """The same by 1.5."""
    return _rate(df, 1.5)


def set_image_size(df: DataFrame, width: Column, height: Column) -> DataFrame:
    """Components keep their whole-number ratio to the picture; larger pictures lose line and pixel frequency."""
    # in a lambda, a name that the same withColumns() redefines would mean the new column: so the old size has other names
    df = df.withColumns({"_w": width.cast("int"), "_h": height.cast("int"), "_w0": F.col("act_pixel"), "_h0": F.col("act_lines")})
    comp = F.transform("comp", lambda c: replaced(c, pix_line=whole_div(F.col("_w"), whole_div(F.col("_w0"), c["pix_line"])), lin_image=whole_div(F.col("_h"), whole_div(F.col("_h0"), c["lin_image"]))))
    smaller = (F.col("_w") <= F.col("act_pixel")) & (F.col("_h") <= F.col("act_lines"))
    freq = lambda k: F.when(smaller, F.col(k)).otherwise(0.0)
    return df.withColumns({"comp": comp, "lin_freq": freq("lin_freq"), "pix_freq": freq("pix_freq"), "act_pixel": F.col("_w"), "act_lines": F.col("_h"), "status": F.lit(0)}).drop("_w", "_h", "_w0", "_h0")


def _rebuild(df: DataFrame, size: Column, ppl: Column, freq: Column) -> DataFrame:
    """A new header from the catalogue with colour, scan, aspect, frames and data format of the old one."""
    own = df.withColumns({"_old": F.struct(*df.columns), "color": _color(), "freq": freq, "size": size, "ppl": ppl, "progressive": F.col("interlace") == 1, "ratio": F.when(aspect_class().isin("4:3", "16:9", "w:h"), aspect_class()).otherwise("auto")})
    made = create_header(own, keep=("path", "_old"))
    frames, fmt, n = whole_div(F.col("_old.nr_images"), F.col("_old.interlace")), F.get(F.col("_old.comp"), 0)["data_fmt"], standard_count(color_of(F.col("comp"), F.col("act_pixel")))
    comp = F.transform("comp", lambda c, i: F.when(i < n, replaced(c, data_fmt=fmt)).otherwise(c))
    made = made.withColumns({"comp": comp, "nr_images": F.coalesce(frames * F.col("interlace"), F.lit(0)), "little_endian": F.col("_old.little_endian")})
    keep = [k for k in df.columns if k != "status"]
    return made.select(*[F.when(F.col("status") == 0, F.col(k)).otherwise(F.col(f"_old.{k}")).alias(k) if k in made.columns else F.col(f"_old.{k}").alias(k) for k in keep], "status")


def set_defined_size(df: DataFrame, size: Column, ppl: Column) -> DataFrame:
    """H12."""
    return _rebuild(df, size, ppl, frequency_class(F.col("ima_freq")))


def set_defined_frequency(df: DataFrame, freq: Column) -> DataFrame:
    """H14."""
    return _rebuild(df, size_class(), F.col("act_pixel"), freq)


def set_frequencies(df: DataFrame, image: Column, line: Column, pixel: Column) -> DataFrame:
    """None may be negative, else 420."""
    return _guarded(df, F.when((image < 0) | (line < 0) | (pixel < 0), 420).otherwise(0), {"ima_freq": image.cast("double"), "lin_freq": line.cast("double"), "pix_freq": pixel.cast("double")})


def set_data_format(df: DataFrame, fmt: Column) -> DataFrame:
    """Of the standard components; half floats for RGB and XYZ only (800); unknown colours 300."""
    df = df.withColumns({"_c": _color(), "_f": fmt})
    comp = F.transform("comp", lambda c, i: F.when(i < standard_count(F.col("_c")), replaced(c, data_fmt=F.col("_f"))).otherwise(c))
    status = F.when(F.col("_c") == dims.UNKNOWN_COLOR, 300).when(~F.coalesce(F.col("_f").isin(*dims.DATA_FORMATS), F.lit(False)) | ((F.col("_f") == "R*2 ") & ~F.col("_c").isin(6, 8)), 800).otherwise(0)
    return _guarded(df, status, {"comp": comp}).drop("_c", "_f")


def set_description(df: DataFrame, text: Column) -> DataFrame:
    """2048 bytes or more are too many (225)."""
    return _guarded(df, F.when(F.octet_length(text) >= dims.DESCRIPTION_BYTES, 225).otherwise(0), {"description": text})


def add_component(df: DataFrame) -> DataFrame:
    """Adds a full-size component without a name; comp_id is its number, -1 if there are as many as can be."""
    made = component("void", "B*8 ", whole_div(F.col("act_lines"), F.col("interlace")), F.col("act_pixel"), F.lit(1), F.lit(1))
    room = F.size("comp") < dims.MAX_COMPONENTS
    return df.withColumns({"comp": F.when(room, F.array_append("comp", made)).otherwise(F.col("comp")), "nr_compon": F.when(room, F.size("comp") + 1).otherwise(F.size("comp")), "comp_id": F.when(room, F.size("comp")).otherwise(-1), "status": F.lit(0)})


def set_component(df: DataFrame, number: Column, name: Column, fmt: Column, pss: Column, lss: Column, many: Column | None = None) -> DataFrame:
    """Name (cut or padded to 5), format, subsampling and multiplex of a component. 800 goes before 227 before 201."""
    many = F.lit(1) if many is None else many
    w, h = F.col("act_pixel"), F.col("act_lines")
    made = lambda c: replaced(c, com_code=padded_name(name), data_fmt=fmt, pix_sbsmpl=pss.cast("int"), lin_sbsmpl=lss.cast("int"), lin_image=whole_div(whole_div(h, lss), F.col("interlace")), pix_line=whole_div(many * w, pss))
    comp = F.transform("comp", lambda c, i: F.when(i == number, made(c)).otherwise(c))
    status = _first((~F.coalesce(fmt.isin(*dims.DATA_FORMATS), F.lit(False)), 800), (F.coalesce(w % F.nullif(pss, F.lit(0)) != 0, F.lit(True)) | F.coalesce(h % F.nullif(lss, F.lit(0)) != 0, F.lit(True)), 227), ((number < 0) | (number >= F.size("comp")), 201))
    return _guarded(df, status, {"comp": comp})


def remove_component(df: DataFrame, number: Column) -> DataFrame:
    """-1 does nothing; later components move up."""
    comp = F.filter("comp", lambda c, i: i != number)
    return _guarded(df, F.when((number < -1) | (number >= F.size("comp")), 201).otherwise(0), {"comp": comp, "nr_compon": F.size(comp)})


def remove_extra_components(df: DataFrame) -> DataFrame:
    """The colour format's own components stay; with an unknown format all do (300)."""
    n = standard_count(_color())
    return _guarded(df, F.when(_color() == dims.UNKNOWN_COLOR, 300).otherwise(0), {"comp": F.slice("comp", 1, n), "nr_compon": n})


# --- getters ----------------------------------------------------------------------------------------------------------


def num_frames() -> Column:
    """Q1; null without an interlace factor."""
    return whole_div(F.col("nr_images"), F.col("interlace"))


def is_interlaced() -> Column:
    return F.col("interlace") == 2


def is_progressive() -> Column:
    return F.col("interlace") == 1


def frame_size() -> tuple[Column, Column]:
    """Q2: width, height."""
    return F.col("act_pixel"), F.col("act_lines")


def buffer_size(number: Column | int) -> tuple[Column, Column, Column]:
    """Q3 and Q4: width, height, status (201) of a component's planes. Y, RGB and S planes are those of 0, U/V planes of 1."""
    number = F.lit(number) if isinstance(number, int) else number
    c = F.get(F.col("comp"), number)
    return c["pix_line"], c["lin_image"], F.when((number < 0) | (number >= F.size("comp")), 201).otherwise(0)


def _hundredths(f: Column) -> Column:
    return F.floor(f * 100 + F.lit(0.5)).cast("int")


def frequency_class(freq: Column) -> Column:
    """Q7: the first class with the same hundredths, else UNKNOWN."""
    out = F.lit("UNKNOWN")
    for name, value in reversed(dims.CLASSES.items()):
        out = F.when(_hundredths(freq) == int(100 * value + 0.5), name).otherwise(out)
    return out


def size_class(lines: Column | None = None, stream: Column | None = None) -> Column:
    """Q8: by active lines."""
    n = F.col("act_lines") if lines is None else lines
    stream = _color() == 7 if stream is None else stream
    plain = F.when(n.isin(120, 144), "QCIF").when(n.isin(240, 288), "CIF").when(n.isin(480, 576), "SD").when(n.isin(1080, 1152), "HDi").when(n == 720, "HDp").otherwise("UNKNOWN")
    return F.when(stream, F.when(n.isin(525, 625), "SD").otherwise("UNKNOWN")).otherwise(plain)


def aspect_class(h_pp: Column | None = None, v_pp: Column | None = None, width: Column | None = None, height: Column | None = None) -> Column:
    """Q9: 4:3, 16:9, w:h if the ratio of width and height agree within 0.001, else UNKNOWN."""
    h_pp, v_pp = F.col("h_pp_size") if h_pp is None else h_pp, F.col("v_pp_size") if v_pp is None else v_pp
    width, height = F.col("act_pixel") if width is None else width, F.col("act_lines") if height is None else height
    near = F.abs(width / F.nullif(h_pp.cast("double"), F.lit(0.0)) - height / F.nullif(v_pp.cast("double"), F.lit(0.0))) < 0.001
    return F.when((h_pp == 4) & (v_pp == 3), "4:3").when((h_pp == 16) & (v_pp == 9), "16:9").when(near, "w:h").otherwise("UNKNOWN")


def data_format() -> Column:
    """Q10: of the first component; UNKNOWN if it is none."""
    fmt = F.get(F.col("comp"), 0)["data_fmt"]
    return F.when(fmt.isin(*dims.DATA_FORMATS), fmt).otherwise("UNKNOWN")


def component_number(name: Column) -> Column:
    """The first component of that name, -1 if none has it."""
    return F.coalesce(F.array_position(F.transform("comp", lambda c: F.rpad(c["com_code"], 5, " ")), padded_name(name)), F.lit(0)).cast("int") - 1


def components(df: DataFrame) -> DataFrame:
    """Q12 and Q13: a row for each component: path, number, name, data_fmt, subsampling, multiplex."""
    e = df.select("path", "act_pixel", F.posexplode("comp").alias("number", "c"))
    return e.select("path", "number", plain_name(F.col("c.com_code")).alias("name"), "c.data_fmt", "c.pix_sbsmpl", "c.lin_sbsmpl", whole_div(F.col("c.pix_line") * F.col("c.pix_sbsmpl"), F.col("act_pixel")).alias("multiplex"))


def error_text(status: Column) -> Column:
    """Q15: text of a status; null for one that there isn't."""
    table = F.create_map(*[F.lit(x) for k, v in dims.STATUS.items() for x in (k, v)])
    return F.try_element_at(table, status)


# fixed values: labels of a printed header
_PRINTED = {
    "nr_images": "number of images", "nr_compon": "number of components", "nr_fd_recs": "number of file description records", "nr_aux_data_recs": "number of auxiliary data records", "appl_type": "application type", "bytes_rec": "bytes per record", "little_endian": "little endian", "nr_aux_hdr_recs": "number of auxiliary header records",
    "ima_freq": "image frequency", "lin_freq": "line frequency", "pix_freq": "pixel frequency", "act_lines": "active lines", "act_pixel": "active pixels", "interlace": "interlace factor", "h_pp_size": "horizontal proportional picture size", "v_pp_size": "vertical proportional picture size",
}
_PRINTED_PART = {"lin_image": "lines per image", "pix_line": "pixels per line", "data_fmt": "data format", "tem_sbsmpl": "temporal subsampling", "lin_sbsmpl": "line subsampling", "pix_sbsmpl": "pixel subsampling", "tem_phshft": "temporal phase shift", "lin_phshft": "line phase shift", "pix_phshft": "pixel phase shift", "com_code": "component code"}


def printed(df: DataFrame) -> DataFrame:
    """Path, status and the header as lines of text: a section of what holds for the file, and one for each component (200 if there are too many)."""

    def line(label: str, width: int, v: Column, name: str) -> Column:
        shown = F.format_string("%f", v) if name.endswith("_freq") else v.cast("int").cast("string") if name == "little_endian" else v.cast("string")
        return F.concat(F.lit(f"{label.ljust(width)} : "), F.coalesce(shown, F.lit("")))

    flat = [line(label, 36, F.col(k), k) for k, label in _PRINTED.items()]
    parts = F.transform("comp", lambda c, i: F.concat_ws("\n", F.concat(F.lit("COMPONENT "), i.cast("string")), *[line(label, 20, c[k], k) for k, label in _PRINTED_PART.items()]))
    fine = F.col("nr_compon") <= dims.MAX_COMPONENTS
    text = F.concat_ws("\n", F.lit("GLOBAL"), *flat, F.when(fine & (F.size("comp") > 0), F.array_join(parts, "\n")))
    return df.select("path", text.alias("text"), F.when(fine, 0).otherwise(200).alias("status"))


def copy_header(df: DataFrame, checks: bool = True) -> DataFrame:
    """The headers as they are, with the status that check_header() gives."""
    return check_header(df, checks).drop("color_format")


def sizes(df: DataFrame) -> DataFrame:
    """Adds header_bytes, image_bytes and file_bytes."""
    out = df.withColumns({"header_bytes": layout.header_bytes(F.col("nr_fd_recs"), F.col("nr_compon"), F.col("bytes_rec")), "image_bytes": layout.image_bytes(F.col("comp"), F.col("nr_aux_data_recs"), F.col("bytes_rec"))})
    return out.withColumn("file_bytes", F.col("header_bytes") + F.col("nr_images") * F.col("image_bytes"))
