"""WARC archives: writing, and reading by boundary-chain verification (operator 6)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framelake.llm.common import checkpointed, lookup, shared_dir, with_first
from framelake.sources.shared import remove

MAGIC = "WARC/1."
#: Payloads below this many bytes are never revisits.
LEAST_BYTES = 100
#: Bytes of a payload that is put together at most.
LARGEST = 1 << 30


def _uuid(name: Column) -> Column:
    h = F.md5(name)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def archive_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """_id (text), _url, _html, record_type, refers_to: what write_archives() writes.

    Of records with equal payloads of LEAST_BYTES or more that with the smallest page_id is the response (null is the largest; of
    repeated rows, all with that page_id are), others revisit it. Payloads don't shuffle, but for their digests, unless
    the table of repeated digests is too large to broadcast.
    """
    p = pages.select(F.col(page_id).alias("_id"), F.regexp_replace(F.coalesce(F.col(url), F.lit("")), r"[\r\n]", "%0A").alias("_url"), F.coalesce(F.col(html), F.lit("")).alias("_html"))
    p = p.withColumn("_digest", F.sha2(F.col("_html").cast("binary"), 256))
    big = F.octet_length("_html") >= LEAST_BYTES
    keys = checkpointed(p.filter(big).select("_id", F.col("_id").isNull().alias("_null"), "_digest"))
    twice = with_first(keys, "_digest", ("_null", "_id")).filter("group_size > 1")
    twice = checkpointed(twice.groupBy("_digest").agg(F.first(F.col("keep._id")).alias("_first"), F.first("group_size").alias("_n")))
    out = lookup(p, twice, "_digest", "_n", keys.count())
    again = big & F.col("_n").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first"))
    return out.select(F.col("_id").cast("string").alias("_id"), "_url", "_html", "_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("_first").cast("string")).alias("refers_to"))


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", gzip: bool = False) -> None:
    """Writes WARC 1.1 files to `path`, one a partition, through Spark's own text writer; so any store that it knows will do.

    A revisit has no block; the length of its full payload is in WARC-Payload-Length. With gzip, files are compressed as a whole.
    """
    field = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))
    again = F.col("record_type") == "revisit"
    block = F.when(again, F.lit("")).otherwise(F.col("_html"))
    text = F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", F.col("record_type")), field("WARC-Record-ID", _uuid(F.concat_ws(" ", F.coalesce("_id", F.lit("null")), "_url", "_digest"))), field("WARC-Date", F.lit(date)), field("WARC-Target-URI", F.col("_url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("_digest"))), field("WARC-Payload-Length", F.octet_length("_html").cast("string")), field("WARC-Profile", F.when(again, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        field("X-Page-Id", F.col("_id")), field("X-Refers-To-Page-Id", F.col("refers_to")), F.lit("Content-Type: text/html; charset=utf-8\r\n"), F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n"),
    )
    records.select(text.alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip" if gzip else "none").text(path)


def _header(name: str, header: Column) -> Column:
    return F.nullif(F.regexp_extract(header, rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC 1.0 and 1.1 files: file, position, page_id (text), record_type, payload_bytes, payload_digest, refers_to.

    See scan_archives(), which also tells how far each file could be followed.
    """
    return scan_archives(spark, path)[0]


def scan_archives(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records as read_archives() gives them, and a row for each file: file, bytes, reached, records, complete.

    Tasks read ranges of files and split them at every magic, also such as payloads hold. Each piece is a candidate with its position
    (prefix sums of the lengths) and, from its header, the position of its successor. Candidates of a range that follow each other
    directly are one step; over these, pointer jumping from position 0 of each file finds what is reachable, and only
    that is a record. A payload with magic inside is put together from its pieces. No window is longer than a range, or than a file has ranges.
    A chain that breaks (a damaged length, a file cut short) ends its file's records there; the file's row then has reached < bytes and is
    not complete. An empty file gives no record and no row. Files that end in .gz, one member or one a record, are read as what they
    hold (a task each, as gzip can't be split), and positions and bytes are of that. Payloads beyond LARGEST bytes, which no value can hold, are
    records with a null digest.
    """
    lines = lambda: spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.col("_metadata.file_size").alias("_bytes"), F.monotonically_increasing_id().alias("_row"), "value")
    head = F.substring_index("value", "\r\n\r\n", 1)
    body = F.expr("substring(cast(value AS binary), cast(_head AS int) + 5, cast(_content AS int))")
    c = lines().withColumns({"_h": head, "_len": F.octet_length("value").cast("long")})
    c = c.withColumns({"_head": F.octet_length("_h").cast("long"), "_content": F.expr("try_cast(nullif(regexp_extract(_h, '(?i)\\r\\nContent-Length:[ \\t]*([0-9]+)[ \\t]*(?:\\r\\n|$)', 1), '') AS bigint)")})
    valid = (F.col("_head") < F.col("_len")) & F.col("_h").rlike(r"\A[0-9]\r\n") & F.col("_content").isNotNull()
    whole = F.col("_head") + 4 + F.col("_content") <= F.col("_len")
    fields = {"page_id": "X-Page-Id", "record_type": "WARC-Type", "_said": "WARC-Payload-Digest", "_full": "WARC-Payload-Length", "refers_to": "X-Refers-To-Page-Id"}
    c = c.select("file", "_block", "_bytes", "_row", "_len", "_head", F.when(valid, F.col("_content")).alias("_content"), F.when(valid & whole, F.sha2(body, 256)).alias("_digest"), *[F.when(valid, _header(h, F.col("_h"))).alias(n) for n, h in fields.items()])
    every = _places(checkpointed(c))
    every = checkpointed(every.withColumn("_next", F.col("_at") + len(MAGIC) + F.col("_head") + 4 + F.col("_content") + 4))
    placed = every.filter("_at >= 0")
    found = checkpointed(_reachable(placed))
    torn = checkpointed(found.filter(f"_digest IS NULL AND _content <= {LARGEST}").select("file", "_at", F.struct(F.col("_at").alias("_start"), "_next", "_head", "_content").alias("_t")))
    if not torn.isEmpty():
        pieces = _places(lines().withColumn("_len", F.octet_length("value").cast("long"))).filter("_at >= 0").select("file", F.col("_at").alias("_piece"), "value")
        # a piece belongs to the last torn record at or before it: carried within ranges, and over them by each range's last one
        member = checkpointed(placed.select("file", "_block", "_at").join(torn, ["file", "_at"], "left"))
        last = member.groupBy("file", "_block").agg(F.max_by("_t", F.when(F.col("_t").isNotNull(), F.col("_at"))).alias("_l"))
        before = last.withColumn("_l", F.last("_l", ignorenulls=True).over(Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)))
        own = F.last("_t", ignorenulls=True).over(Window.partitionBy("file", "_block").orderBy("_at"))
        member = member.withColumn("_t", own).join(before, ["file", "_block"]).select("file", F.col("_at").alias("_piece"), F.coalesce("_t", "_l").alias("_t"))
        member = checkpointed(member.select("file", "_piece", "_t.*").filter("_start IS NOT NULL AND _piece < _next"))
        parts = member.join(pieces, ["file", "_piece"]).groupBy("file", "_start", "_head", "_content").agg(F.array_sort(F.collect_list(F.struct("_piece", "value"))).alias("_parts"))
        text = F.array_join(F.transform("_parts", lambda x: x["value"]), MAGIC)
        made = parts.withColumn("value", text).select("file", F.col("_start").alias("_at"), F.sha2(body, 256).alias("_made"))
        found = found.join(made, ["file", "_at"], "left").withColumn("_digest", F.coalesce("_digest", "_made"))
    again = F.lower("record_type") == "revisit"
    records = found.select("file", F.col("_at").alias("position"), "page_id", "record_type", F.when(again & F.col("_full").isNotNull(), F.expr("try_cast(_full AS bigint)")).otherwise(F.col("_content")).alias("payload_bytes"), F.when(again & F.col("_said").isNotNull(), F.regexp_replace("_said", "^sha256:", "")).otherwise(F.col("_digest")).alias("payload_digest"), "refers_to")
    size = F.when(F.lower("file").endswith(".gz"), F.sum(F.col("_len") + len(MAGIC)) - len(MAGIC)).otherwise(F.first("_bytes"))
    per = every.groupBy("file").agg(size.alias("bytes")).join(found.groupBy("file").agg(F.max("_next").alias("_to"), F.count("_next").alias("_n")), "file", "left")
    reached = F.coalesce(F.least("_to", "bytes"), F.lit(0))
    return records, per.select("file", "bytes", reached.alias("reached"), F.coalesce("_n", F.lit(0)).alias("records"), (F.col("_to").eqNullSafe(F.col("bytes"))).alias("complete"))


def _places(pieces: DataFrame) -> DataFrame:
    """Adds _at, the position of the magic before each piece; that of the piece before the first magic is below 0."""
    per = pieces.groupBy("file", "_block").agg(F.sum(F.col("_len") + len(MAGIC)).alias("_sum"))
    blocks = Window.partitionBy("file").orderBy("_block")
    per = per.select("file", "_block", (F.sum("_sum").over(blocks) - F.col("_sum")).alias("_base"))
    inner = Window.partitionBy("file", "_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = pieces.withColumn("_upto", F.sum(F.col("_len") + len(MAGIC)).over(inner))
    return upto.join(checkpointed(per), ["file", "_block"]).withColumn("_at", F.col("_base") + F.col("_upto") - F.col("_len") - 2 * len(MAGIC)).drop("_base", "_upto")


def _reachable(c: DataFrame) -> DataFrame:
    """The candidates with a valid header that a chain of successors from position 0 of their file reaches.

    A run, within one range of a file, ends at a candidate whose successor is not the next one there, and starts anew where any other successor
    leads. So a run is entered at its first candidate alone, and only runs (_run: the first one's position) are jumped over.
    """
    here = Window.partitionBy("file", "_block").orderBy("_at")
    c = c.withColumn("_follows", F.lag("_next").over(here).eqNullSafe(F.col("_at")))
    c = checkpointed(c.withColumn("_direct", F.lead("_at").over(here).eqNullSafe(F.col("_next"))))
    aims = c.filter("NOT _direct AND _next IS NOT NULL").select("file", F.col("_next").alias("_at"), F.lit(True).alias("_aim")).distinct()
    c = c.join(aims, ["file", "_at"], "left")
    c = checkpointed(c.withColumn("_run", F.last(F.when(~F.col("_follows") | F.col("_aim").isNotNull(), F.col("_at")), ignorenulls=True).over(here)))
    runs = checkpointed(c.groupBy("file", "_run").agg(F.max_by("_next", "_at").alias("_to")))
    jump = checkpointed(runs.join(runs.select("file", F.col("_run").alias("_to")), ["file", "_to"]).select("file", "_run", F.col("_to").alias("_then")))
    seen = checkpointed(runs.filter("_run = 0").select("file", "_run"))
    n = seen.count()
    while True:
        more = seen.join(jump, ["file", "_run"]).select("file", F.col("_then").alias("_run"))
        seen = checkpointed(seen.unionByName(more).distinct())
        m = seen.count()
        if m == n:
            break
        n = m
        jump = checkpointed(jump.join(jump.select("file", F.col("_run").alias("_then"), F.col("_then").alias("_far")), ["file", "_then"]).select("file", "_run", F.col("_far").alias("_then")))
    return c.filter("_next IS NOT NULL").join(seen, ["file", "_run"]).drop("_run", "_aim", "_follows", "_direct")


def archive_round_trip(pages: DataFrame, folder: str | None = None, keep: bool = False) -> DataFrame:
    """Writes the pages to archives and reads these back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload; null urls and ids are left out of a header and read as null; repeated pages give a record
    each; an empty table gives none. The archives are in the shared folder and go afterwards, unless `folder` or keep says otherwise.
    """
    spark = pages.sparkSession
    path = folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(archive_records(pages), path)
    kind = pages.schema["page_id"].dataType.simpleString()
    out, files = scan_archives(spark, path)
    if not files.filter("NOT complete").isEmpty():
        raise RuntimeError(f"{path}: a chain of records broke")
    out = checkpointed(out.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")))
    if not keep and not folder:
        remove(spark, path)
    return out
