"""Mixing sources to target weights, by prefix sums over hash-random keys (operator 4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.common import checkpointed, lookup, n_words, prefixed

#: Documents in one key range of a source, about.
RANGE_ROWS = 2048


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, at_most: float = 2.0) -> DataFrame:
    """Adds `target` to sizes (_by: struct of null and source; source_size: one row a source).

    Sources in the order of _by weigh as `weights`, repeating; share * all sizes is dealt by weight, no source gets more than
    at_most times its size, and what is above goes to the others by weight. Solved at once: in the order of
    cap / weight a source is capped if its cap is no more than its part of what those before it left. Both orders are distributed sorts with
    prefix sums, so there may be any number of sources.
    """
    n = sizes.count()
    s = prefixed(sizes, ["_by"], {"_at": F.lit(1)}, n)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("_at", F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(at_most))
    s = s.withColumn("_w", w).withColumns({"_cap": cap, "_k": cap / F.col("_w")})
    s = prefixed(s, ["_k", "_by"], {"_b": F.col("_cap"), "_wb": F.col("_w")}, n)
    whole = s.agg(F.sum("source_size").alias("n"), F.sum("_w").alias("w")).first()
    every, weight = float(share) * (whole["n"] or 0), whole["w"] or 1.0
    s = checkpointed(s.withColumn("_full", F.col("_cap") <= F.col("_w") * (F.lit(every) - F.col("_b")) / (F.lit(weight) - F.col("_wb"))))
    rest = s.agg(F.sum(F.when(F.col("_full"), F.col("_cap"))).alias("full"), F.sum(F.when(~F.col("_full"), F.col("_w"))).alias("free")).first()
    part = F.col("_w") * F.lit(every - (rest["full"] or 0.0)) / F.lit(rest["free"] or 1.0)
    return s.withColumn("target", F.when(F.col("_full"), F.col("_cap")).otherwise(part)).drop("_at", "_w", "_cap", "_k", "_b", "_wb", "_full")


def _placed(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """Adds to the documents what places them: _by (is the source null, and the source), _size, _key, _id (ids of any type, as text)."""
    id_ = F.col(doc_id).cast("string")
    key = F.md5(F.coalesce(id_, F.concat(F.lit("null "), F.coalesce(F.col(text), F.lit("")))))
    by = F.struct(F.col(source).isNull().alias("n"), F.coalesce(F.col(source), F.lit("")).alias("s"))
    return docs.withColumns({"_by": by, "_size": n_words(F.col(text)), "_key": key, "_id": F.coalesce(id_, F.lit(""))})


def _range(n: str) -> Column:
    """The key range among so many that a source of n documents has; 15 hex digits are 60 bits, dealt in equal widths."""
    part = F.conv(F.substring("_key", 1, 15), 16, 10).cast("double") / F.lit(2.0**60)
    return F.floor(part * F.ceil(F.col(n) / RANGE_ROWS)).cast("long")


def _span(sums: DataFrame, goals: DataFrame, at: str) -> DataFrame:
    """Of each source's sums (_by, `at`, _sum) the one in which _rest of goals (_by, _rest) ends, and _left, what it still gives."""
    upto = Window.partitionBy("_by").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    s = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(upto), F.lit(0))).join(goals, "_by")
    return checkpointed(s.filter("_before <= _rest AND _rest < _before + _sum").select("_by", at, (F.col("_rest") - F.col("_before")).alias("_left")))


def cuts(placed: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, at_most: float = 2.0) -> DataFrame:
    """One row per source: its size, target, whole epochs and the place where the last epoch ends.

    Key ranges of about RANGE_ROWS documents are summed. Groups of ranges, as many as a group has ranges, are added up in order, then the
    ranges of the one group of each source in which its budget ends, then the documents of one range: so a window has about the square root of
    the number of ranges. The place is (_at: that range, _cut: key, id and size of the document there, _part: words it
    still gives, _tied: how many rows are alike in these three).
    """
    per = checkpointed(placed.groupBy("_by").agg(F.sum("_size").alias("source_size"), F.count("*").alias("_n")))
    total = per.agg(F.sum("_n")).first()[0] or 0
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = targets(per, weights, share, at_most).withColumn("_epochs", epochs)
    goals = checkpointed(goals.withColumn("_rest", F.floor("target").cast("long") - F.col("_epochs") * F.col("source_size")))
    group = F.floor(F.col("_r") / F.ceil(F.sqrt(F.ceil(F.col("_n") / RANGE_ROWS)))).cast("long")
    sums = lookup(placed, per.select("_by", "_n"), "_by", "_n", total).groupBy("_by", "_n", _range("_n").alias("_r")).agg(F.sum("_size").alias("_sum"))
    sums = checkpointed(sums.select("_by", "_r", "_sum", group.alias("_g")))
    groups = _span(sums.groupBy("_by", "_g").agg(F.sum("_sum").alias("_sum")), goals.select("_by", "_rest"), "_g")
    inner = sums.join(groups.select("_by", "_g"), ["_by", "_g"])
    ends = _span(inner.select("_by", "_r", "_sum"), groups.select("_by", F.col("_left").alias("_rest")), "_r").withColumnRenamed("_r", "_at")
    ends = checkpointed(ends.join(per.select("_by", "_n"), "_by"))
    inside = lookup(placed, ends, "_by", "_n", total).filter(_range("_n") == F.col("_at")).groupBy("_by", "_at", "_left", F.struct("_key", "_id", "_size").alias("_cut")).agg(F.sum("_size").alias("_sum"), F.count("*").alias("_tied"))
    upto = Window.partitionBy("_by").orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_part", F.col("_left") - F.coalesce(F.sum("_sum").over(upto), F.lit(0))).filter("_part >= 0 AND _part < _sum")
    return checkpointed(goals.join(inside.select("_by", "_at", "_cut", "_part", "_tied"), "_by", "left"))


def _taken(placed: DataFrame, cut: DataFrame) -> DataFrame:
    """Adds source_size, target and _taken (words)."""
    rows = lookup(placed, cut, "_by", "_n", int(cut.agg(F.sum("_n")).first()[0] or 0))
    here, own = _range("_n"), F.struct("_key", "_id", "_size")
    last = F.when(F.col("_at").isNull(), 0).when(here != F.col("_at"), F.when(here < F.col("_at"), F.col("_size")).otherwise(0))
    last = last.when(own == F.col("_cut"), F.floor(F.col("_part") / F.col("_tied"))).when(own < F.col("_cut"), F.col("_size")).otherwise(0)
    return rows.withColumn("_taken", (F.col("_epochs") * F.col("_size") + last).cast("long"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, at_most: float = 2.0) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    size is the number of words. Each source is in the order of the MD5 of doc_id (a key that is as good as random, and the same in
    every run; ids may be of any type). Whole epochs are taken as long as they fit in the target; the rest is a cut of the order at the
    exact number of words (the target without its fraction), so one document a source may be taken in part.
    Null: a null source is a source of its own, the last; a null text has size 0; a null doc_id is keyed by its text. Repeated rows
    at the cut share what is left evenly, rounded down. Sources without words have target 0. An empty table gives none.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
    rows = checkpointed(_placed(rows, "doc_id", "text", "source").drop("text", "source"))
    out = _taken(rows, cuts(rows, weights, share, at_most))
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", "target", F.col("_taken").alias("taken"))


def mixed_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, at_most: float = 2.0) -> DataFrame:
    """The mix itself: each document as often as it is taken, the last copy cut after its words where the budget ends.

    Rows have the columns of docs. A document of which no word is taken goes, but for those without words, which
    stay once. n_chars, where there is such a column, is that of the new text. Texts don't shuffle.
    """
    cols = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("_all"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
    placed = _placed(held, "doc_id", "text", "source")
    small = checkpointed(placed.select("_by", "_size", "_key", "_id"))
    rows = _taken(placed, cuts(small, weights, share, at_most))
    odd = F.col("_taken") % F.greatest("_size", F.lit(1))
    copies = F.when(F.col("_size") == 0, 1).otherwise(F.ceil(F.col("_taken") / F.col("_size"))).cast("int")
    rows = rows.withColumn("_copies", copies).filter("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    rows = rows.withColumn("_words", F.when(F.col("_copy") == F.col("_copies"), F.nullif(odd, F.lit(0))).cast("int"))
    whole = F.col(f"_all.`{text}`")
    ends = F.split(whole, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # after each word
    rows = rows.withColumn("_text", F.when(F.col("_words").isNull(), whole).otherwise(F.array_join(F.slice(ends, 1, F.coalesce("_words", F.lit(0))), "")))

    def column(c: str) -> Column:
        if c == text:
            return F.col("_text")
        return F.when(F.col("_words").isNull(), F.col("_all.n_chars")).otherwise(F.length("_text")) if c == "n_chars" else F.col(f"_all.`{c}`")

    return rows.select(*[column(c).alias(c) for c in cols])
