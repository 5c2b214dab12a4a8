"""What several operators share: checkpoints, size-checked lookups, bounded tile
joins and connected components.

Nothing here gathers rows in proportion to the input on the driver or in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.sources.shared import kept as checkpointed
from framelake.sources.shared import shared_dir as shared_dir

#: White space of every text contract here: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
#: Rows up to which a lookup table is broadcast; beyond it is shuffled.
BROADCAST_ROWS = 50_000
#: A key with this share of the rows or more is hot; so at most HOT_SHARE**-1 keys are.
HOT_SHARE = 1 / 2000


def one_space(text: Column) -> Column:
    """The text with each run of white space made one space; null is empty.

    A single space needs no replacement, so the pattern leaves it out: far fewer matches, the same text.
    """
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def n_words(text: Column) -> Column:
    """Number of words (runs without white space); null counts as empty."""
    t = F.trim(one_space(text))
    return F.when(t == "", 0).otherwise(F.octet_length(t) - F.octet_length(F.replace(t, F.lit(" "), F.lit(""))) + 1).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lookup(left: DataFrame, right: DataFrame, key: str, rows: str | None = None, total: int = 0) -> DataFrame:
    """left, outer-joined to right on one column that is unique in right.

    A small right side (counted, so give it checkpointed) is broadcast. A larger one is shuffled, but for
    its hot keys: `rows` names the column with the number of left rows of each key, `total` is the
    number of all; at most 1 / HOT_SHARE keys can be hot, so these are broadcast and their left
    rows are not shuffled. left is read twice then; give it checkpointed if it is costly.
    """
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, "left")
    if rows is None:
        return left.join(right, key, "left")
    is_hot = F.col(rows) >= F.lit(max(1.0, total * HOT_SHARE))
    hot = F.broadcast(right.filter(is_hot))
    rest = left.join(hot.select(key), key, "left_anti")
    return left.join(hot, key).unionByName(rest.join(right.filter(~is_hot), key, "left"))


def without_places(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs, with whatever columns it has, but for those at the places (_place: monotonically_increasing_id) in gone.

    gone should be checkpointed; docs must be a table that reads the same twice (a file or a checkpoint).
    """
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), F.monotonically_increasing_id().alias("_place"))
    small = gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return held.join(F.broadcast(gone) if small else gone, "_place", "left_anti").select("_all.*")


def prefixed(rows: DataFrame, order: Sequence[str], sums: dict[str, Column], n: int) -> DataFrame:
    """Adds for each name in sums the sum over all rows before (0 for the first) in an order that has no ties. n: number of rows.

    Rows are sorted by ranges of BROADCAST_ROWS; within these a window sums, and one over the ranges' totals gives what is before each.
    """
    p = checkpointed(rows.repartitionByRange(-(-n // BROADCAST_ROWS) or 1, *order).withColumn("_p", F.spark_partition_id()))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = p.groupBy("_p").agg(*[F.sum(c).alias(f"_{k}") for k, c in sums.items()])
    base = per.select("_p", *[before(f"_{k}", Window.orderBy("_p")).alias(f"_{k}") for k in sums])
    out = p.withColumns({k: before(c, Window.partitionBy("_p").orderBy(*order)) for k, c in sums.items()}).join(F.broadcast(base), "_p")
    return out.withColumns({k: F.col(k) + F.col(f"_{k}") for k in sums}).drop("_p", *[f"_{k}" for k in sums])


def least_hashed(df: DataFrame, key: str, k: int) -> DataFrame:
    """The k rows with the smallest hashes of key (all, if there are fewer). df should be checkpointed: it is read up to three times.

    Rows beyond a bound of the hash that about 1.2 k rows are below go first, so what meets in the last task grows with k and not with the table.
    """
    n, h = df.count(), F.xxhash64(key)
    if n <= k:
        return df
    bound = int(-(2**63) + 2**64 * min(1.0, (1.2 * k + 100) / n))
    some = df.filter(h < F.lit(min(bound, 2**63 - 1)))
    return (some if some.count() >= k else df).orderBy(h, key).limit(k)


def tiles(residents: DataFrame, probes: DataFrame, size: int, compare: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """compare(residents, probes) over every cell, in tiles of about `size` rows a side.

    Both frames have the same columns, among them `cell` (long) and `tag` (long, spreads rows over tiles).
    The number of cells must be bounded, whatever the input: their counts go to the driver
    and are broadcast. A cell beyond `size` is cut into several tiles, and each pair of tiles is one
    group, so no task holds more than about 2 * size rows at once, however hot its cell.
    """
    count = lambda df, name: df.groupBy("cell").agg(F.count("*").alias(name))
    cells = checkpointed(count(residents, "n").join(count(probes, "m"), "cell"))
    cells = F.broadcast(cells.select("cell", F.ceil(F.col("n") / size).cast("int").alias("_n"), F.ceil(F.col("m") / size).cast("int").alias("_m")))
    cols = residents.columns
    own, other = F.pmod(F.xxhash64("tag"), F.col("_n")), F.pmod(F.xxhash64("tag", F.lit(1)), F.col("_m"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = residents.join(cells, "cell").select(*cols, F.lit(True).alias("_r"), own.cast("int").alias("_i"), every("_m").alias("_j"))
    b = probes.select(*cols).join(cells, "cell").select(*cols, F.lit(False).alias("_r"), every("_n").alias("_i"), other.cast("int").alias("_j"))

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        mask = rows["_r"].to_numpy(bool)
        return compare(rows[mask], rows[~mask])

    return a.unionByName(b).groupBy("cell", "_i", "_j").applyInPandas(one, schema)


def forest(n: int, u: np.ndarray, v: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest index of each index's component, given pairs; continues from `label`."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while not np.array_equal(new[new], new):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def stars(ids: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    """Pairs that link each component: its smallest id with every other, as few as can be."""
    order = np.lexsort((ids, label))
    ids, label = ids[order], label[order]
    first = np.searchsorted(label, label)
    pairs = pd.DataFrame({"a": ids[first], "b": ids})
    return pairs[pairs["a"] != pairs["b"]]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node that each node of links (a, b: long) reaches.

    Alternating large-star and small-star steps (each node's neighbours move to its smallest one),
    which need about log(n) rounds, and none where every component is a star already. Every step aggregates a minimum per node, with
    partial sums before the shuffle, and joins it to the links, where Spark splits a hot node's rows at run time.
    A null end or an empty table gives no rows.
    """
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), F.col("a").isNotNull().alias("_x"), F.col("b").isNotNull().alias("_y"))
    e = checkpointed(e.filter("_x AND _y AND u <> v").select("u", "v").distinct())

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = both.join(low, "u").filter(F.col("v") > F.col("u") if large else F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            moved = moved.unionByName(low.select("u", F.col("m").alias("v")))
        return checkpointed(moved.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def settled(edges: DataFrame) -> bool:
        """Has every node one smaller neighbour, which has none?"""
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down")))
        per = ends.groupBy("node").agg(F.sum("down").alias("down"), F.min("down").alias("least"))
        return per.filter("down > 1 OR (down = 1 AND least = 0)").isEmpty()

    for _ in range(rounds):
        if settled(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        e = star(star(e, True), False)
    raise RuntimeError(f"components didn't settle in {rounds} rounds")


def hot_keys(df: DataFrame, key: str, slices: int = 32, tracked: int = 2048, reported: int = 128) -> DataFrame:
    """Distinct values of a string column that may be frequent, at most slices * reported.

    Each of `slices` hash classes of keys keeps a frequent-items sketch (the Misra-Gries family: counters that are
    decremented together), built in part before the shuffle. Of the keys with more than 3.5 / tracked of their slice's rows, which
    the sketch never misses, each slice gives the `reported` most frequent; so a key that isn't given has less than
    1 / reported of its slice's rows.
    """
    one = df.filter(F.col(key).isNotNull()).groupBy(F.pmod(F.xxhash64(key), F.lit(slices)).alias("_s"))
    top = one.agg(F.expr(f"approx_top_k(`{key}`, {reported}, {tracked})").alias("_t"))
    return top.select(F.explode("_t.item").alias(key))


def with_first(rows: DataFrame, digest: str, order: Sequence[str]) -> DataFrame:
    """Adds keep (struct of `order`: the group's smallest) and group_size to each row, for groups of equal digests.

    The heavy-hitter split: frequent digests come from hot_keys(); exact winners and counts of those, verified by
    one aggregation over all rows, are broadcast (their number is bounded), so rows of frequent
    digests never shuffle. The rest is shuffled by digest; none of its groups is large.
    rows should be checkpointed: it is read three times.
    """
    first = F.struct(*order)
    some = rows.join(F.broadcast(hot_keys(rows, digest)), digest).groupBy(digest)
    winners = checkpointed(some.agg(F.min(first).alias("keep"), F.count("*").alias("group_size")).filter("group_size > 1"))
    hot = rows.join(F.broadcast(winners), digest)
    w = Window.partitionBy(digest)
    rest = rows.join(F.broadcast(winners.select(digest)), digest, "left_anti")
    return hot.unionByName(rest.withColumns({"keep": F.min(first).over(w), "group_size": F.count("*").over(w)}))
