"""SimHash near-duplicates by tiled exact comparison (operator 10), and near-copies by the exact similarity of their shingles."""

from __future__ import annotations

import bisect
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import checkpointed, components, forest, lookup, stars, tiles, without_places

#: Permutations of the sketch that estimates similarity.
SKETCH = 128
#: Pairs of fingerprints that are compared at once.
PAIRS = 1_000_000
#: Tiles that wide_links() makes at least, and the fewest and the most rows of a tile.
PARTS, LEAST, MOST = 16, 1024, 262_144
#: The chance that either prefilter of near_dedup() misses a pair of exactly the similarity asked for.
MISSED = 1e-6
#: Candidates whose shingles are verified at once (a tile of them), the mean of a cell, and the most cells.
VERIFIED, CELL, CELLS = 512, 256, 65_536


def shingle_hashes(text: bytes, k: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of k words, repeats included; of the whole sequence if there are fewer; none without words.

    A-Z are lower-cased and words joined by one space, so that every shingle is a slice.
    """
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([h(joined, seed)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin = np.concatenate([[0], ends[:-1] + 1])[: len(words) - k + 1].tolist()
    return np.array([h(joined[a:b], seed) for a, b in zip(begin, ends[k - 1 :].tolist(), strict=True)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """64 bits; one is 1 if it is set in over half the hashes. Zero without any."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[at : at + 65536]).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


_rng = np.random.default_rng(20)
_A, _B = (_rng.integers(1, 2**32, SKETCH, dtype=np.uint64) | np.uint64(1)).astype(np.uint32), _rng.integers(0, 2**32, SKETCH, dtype=np.uint64).astype(np.uint32)


def sketch(hashes: np.ndarray) -> bytes:
    """A byte for each of SKETCH MinHash permutations; equal bytes estimate the Jaccard similarity of two sets."""
    low = np.full(SKETCH, 2**32 - 1, np.uint32)
    h = np.unique((hashes ^ (hashes >> np.uint64(32))).astype(np.uint32))
    for at in range(0, len(h), 2048):
        np.minimum(low, (h[at : at + 2048, None] * _A + _B).min(axis=0), out=low)
    return (low * np.uint32(2654435761) >> np.uint32(24)).astype(np.uint8).tobytes()


def reached(n: int, p: float, missed: float) -> int:
    """As many of n trials, each of chance p, as succeed at least, but for a chance of `missed` at most."""
    below = 0.0
    for k in range(n + 1):
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > missed:
            return k
    return n


def fingerprints(docs: DataFrame, k: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _row, fp (long; the bits as signed). Whole texts, no shuffle."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = [t.encode(errors="surrogatepass") for t in b["text"]]
            yield b[["_id", "_row"]].assign(fp=np.array([simhash(shingle_hashes(t, k, seed)) for t in raw], np.uint64).view(np.int64))

    return _made(docs, make, "fp long", doc_id, text)


def sketches(docs: DataFrame, k: int = 5, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, _row, same (a digest of the set of shingles), sketch, fp (long: the lowest bits of 64 MinHashes). Whole texts, no shuffle."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.encode(errors="surrogatepass"), k, seed)) for t in b["text"]]
            made = [sketch(h) for h in sets]
            bits = np.frombuffer(b"".join(made), np.uint8).reshape(-1, SKETCH)[:, :64] & 1
            fp = np.packbits(bits, axis=1, bitorder="little").view("<i8")[:, 0]
            yield b[["_id", "_row"]].assign(same=[xxhash.xxh3_128_digest(h.tobytes()) for h in sets], sketch=made, fp=fp)

    return _made(docs, make, "same binary, sketch binary, fp long", doc_id, text)


def _made(docs: DataFrame, make, schema: str, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("string").alias("_id"), F.monotonically_increasing_id().alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = rows.mapInPandas(make, "_id string, _row long, " + schema)
    return out.withColumn("_id", F.col("_id").cast(docs.schema[doc_id].dataType))


def _cell(fp: F.Column, masks: list[int], width: int) -> F.Column:
    """Population counts of the blocks of bits, each divided by width, as one number of base 64."""
    out = F.lit(0).cast("long")
    for m in masks:
        out = out * 64 + F.floor(F.bit_count(fp.bitwiseAND(F.lit(m - 2**64 if m >= 2**63 else m))) / width) + 1
    return out.cast("long")


def _linked(own: tuple, other: tuple, radius: int, least: int) -> pd.DataFrame:
    """Stars of what two tiles link. A tile: numbers, fingerprints and sketches (None if least is 0), by population count."""
    (ids, a, sa), (more, b, sb) = own, other
    pa, pb = np.bitwise_count(a).astype(np.int64), np.bitwise_count(b).astype(np.int64)
    names, at = np.unique(np.concatenate([ids, more]), return_inverse=True)
    left, right, label = at[: len(a)], at[len(a) :], np.arange(len(names))
    i = 0
    while i < len(a):
        step = max(1, min(512, PAIRS // max(1, len(b))))
        lo, hi = np.searchsorted(pb, pa[i] - radius), np.searchsorted(pb, pa[min(i + step, len(pa)) - 1] + radius, side="right")
        x, y = np.nonzero(np.bitwise_count(a[i : i + step, None] ^ b[None, lo:hi]) <= radius)
        u, v = i + x, lo + y
        i += step
        new = label[left[u]] != label[right[v]]  # pairs that are linked already need no look
        u, v = u[new], v[new]
        for j in range(0, len(u), 65536):
            c, d = u[j : j + 65536], v[j : j + 65536]
            if least:
                same = (sa[c] == sb[d]).sum(axis=1) >= least
                c, d = c[same], d[same]
            if len(c):
                label = forest(len(names), left[c], right[d], label)
    return stars(names, label)


def wide_links(points: DataFrame, radius: int, least: int = 0) -> DataFrame:
    """As links(), for a radius at which cells would not tell fingerprints apart. With `least`, points has `sketch` too, and a
    pair also needs so many equal bytes of it.

    Fingerprints are put in the order of their population counts (a histogram of 65 counts is all that the driver sees) and cut into
    tiles, PARTS of them or as many as keep a tile at MOST rows. A tile is one row, packed, so a pair of tiles costs two rows to
    shuffle; pairs whose population counts differ beyond the radius are not made.
    """
    seen = {r["ones"]: r["n"] for r in points.groupBy(F.bit_count("fp").alias("ones")).agg(F.count("*").alias("n")).collect()}
    starts = [0, *itertools.accumulate(seen.get(p, 0) for p in range(65))]
    n = starts[65]
    size = min(MOST, max(LEAST, -(-n // PARTS)))
    ones = (F.bit_count("fp") + 1).cast("int")
    start, count = F.array(*[F.lit(x) for x in starts[:65]])[ones - 1], F.array(*[F.lit(seen.get(p, 0)) for p in range(65)])[ones - 1]
    place = start + F.pmod(F.xxhash64("node"), F.lit(2**20)) / F.lit(float(2**20)) * count
    rows = points.withColumn("tile", F.floor(place / size).cast("int"))

    def ones_at(position: int) -> int:
        return bisect.bisect_right(starts, min(position, n - 1)) - 1

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        fp, tile = rows["fp"].to_numpy(np.int64), int(rows["tile"].iloc[0])
        order = np.argsort(np.bitwise_count(fp.view(np.uint64)), kind="stable")
        first = starts[max(0, ones_at(tile * size) - radius)] // size
        last = -(-starts[min(65, ones_at((tile + 1) * size - 1) + radius + 1)] // size) - 1
        out = {"tile": tile, "first": min(first, tile), "last": max(last, tile), "tags": rows["node"].to_numpy(np.int64)[order].tobytes(), "fps": fp[order].tobytes()}
        if least:
            sketches = rows["sketch"].to_numpy()
            out["sketches"] = b"".join(sketches[order])
        return pd.DataFrame([out])

    blobs = ["tags", "fps", *["sketches"] * bool(least)]
    cut = checkpointed(rows.groupBy("tile").applyInPandas(packed, "tile int, first int, last int, " + ", ".join(f"{x} binary" for x in blobs)))
    tile = F.col("tile")
    pairs = cut.select(tile.alias("i"), F.explode(F.sequence("tile", "last")).alias("j"), "tile", *blobs)
    pairs = pairs.unionByName(cut.filter("first < tile").select(F.explode(F.sequence(F.col("first"), tile - 1)).alias("i"), tile.alias("j"), "tile", *blobs))

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        at = {r.tile: (np.frombuffer(r.tags, np.int64), np.frombuffer(r.fps, np.uint64), np.frombuffer(r.sketches, np.uint8).reshape(-1, SKETCH) if least else None) for r in rows.itertuples()}
        if key[0] not in at or key[1] not in at:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)  # a tile that got no rows
        return _linked(at[key[0]], at[key[1]], radius, least)

    return pairs.groupBy("i", "j").applyInPandas(compare, "a long, b long")


def links(points: DataFrame, radius: int = 3, blocks: int = 3, width: int = 1, size: int = 4096) -> DataFrame:
    """Pairs (a, b) of node that connect the same nodes as all pairs within `radius` differing bits do.

    points: node (long, unique), fp (long).
    Fingerprints are dealt into cells by the population counts of `blocks` parts of the 64 bits, in steps of `width`: within the radius,
    these counts differ by no more than it in sum, so other pairs of cells are skipped, and each cell meets its neighbours
    only. Within a cell, tiles of numpy compare all with all by exclusive-or and bit count, and skip where whole
    population counts differ too much. A tile gives a star per component, never all pairs of a group; nothing is lost by
    that, as every pair is compared somewhere.
    """
    bits = [range(i * 64 // blocks, (i + 1) * 64 // blocks) for i in range(blocks)]
    masks = [sum(1 << b for b in part) for part in bits]
    near = lambda d: max(0, (abs(d) - 1) * width + 1) if d else 0
    reach = [d for d in range(-radius, radius + 1) if near(d) <= radius]
    steps = [s for s in itertools.product(reach, repeat=blocks) if sum(map(near, s)) <= radius and s >= (0,) * blocks]
    deltas = []
    for s in steps:
        n = 0
        for d in s:
            n = n * 64 + d
        deltas.append(n)
    cols = [F.col("node").alias("tag"), "fp"]
    cell = _cell(F.col("fp"), masks, width)
    residents = points.select(cell.alias("cell"), *cols)
    probes = points.select(F.explode(F.transform(F.array(*[F.lit(d).cast("long") for d in deltas]), lambda d: cell + d)).alias("cell"), *cols)

    def compare(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for x in (own, other):
            fp = x["fp"].to_numpy(np.int64).view(np.uint64)
            order = np.argsort(np.bitwise_count(fp), kind="stable")
            sides.append((x["tag"].to_numpy(np.int64)[order], fp[order], None))
        return _linked(*sides, radius, 0)

    return tiles(residents, probes, size, compare, "a long, b long")


def simhash_components(docs: DataFrame, k: int = 3, radius: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, kept.

    Documents link whose fingerprints of k-word shingles differ in `radius` bits or fewer. component_id is the smallest doc_id that
    is reached, its own included; kept marks one row of each component (the first with that id).
    Equal fingerprints are one node, so copies cost no comparison; their rows are joined by a lookup
    that broadcasts hot fingerprints only. Null and empty texts have fingerprint zero and link as any other; null ids come last, and
    a component of null ids alone has a null component_id. An empty table gives none; other columns are not read.
    """
    rows = checkpointed(fingerprints(docs, k, doc_id=doc_id, text=text))
    nodes = _nodes(rows, "fp")
    find = wide_links if radius > 6 else links
    out = _named(rows, nodes, components(checkpointed(find(nodes.select("node", "fp"), radius))), "fp")
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return out.select(F.col("_id").alias("doc_id"), digits.alias("fingerprint"), F.col("_best._id").alias("component_id"), (F.col("_best._row") == F.col("_row")).alias("kept"), "_row")


def _nodes(rows: DataFrame, key: str, *more: str) -> DataFrame:
    """A row for each key: its first document, how many it has, and node, the smallest row number in it (unique, whatever the ids are)."""
    first = F.min(F.struct(F.col("_id").isNull().alias("_null"), "_id", "_row"))
    return checkpointed(rows.groupBy(key, *more).agg(first.alias("_first"), F.min("_row").alias("node"), F.count("*").alias("_n")))


def _named(rows: DataFrame, nodes: DataFrame, label: DataFrame, key: str) -> DataFrame:
    """Adds _best, the first document of its component, to each row. label: node, root."""
    label = checkpointed(label.join(nodes.select("node", "_first"), "node"))
    best = label.groupBy("root").agg(F.min("_first").alias("_best"))
    label = checkpointed(label.join(checkpointed(best), "root").select("node", "_best"))
    named = nodes.join(label, "node", "left").select(key, F.coalesce("_best", "_first").alias("_best"), "_n")
    return lookup(rows, checkpointed(named), key, "_n", rows.count())


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity."""
    few, many = sorted((len(a), len(b)))
    if not many or few / many < similarity:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (few + many - both) >= similarity


def verified_links(docs: DataFrame, label: DataFrame, similarity: float, similar: int, least: int, text: str = "text") -> DataFrame:
    """Pairs (a, b) of node that connect the same nodes as all pairs within a root that have that similarity do.

    label: node (a row's place in docs) and root, of candidates only; the texts of these are read again and made sorted sets of
    shingle hashes, of 64 bits. Roots are dealt into cells; a cell of over VERIFIED nodes is cut into tiles, and each pair of
    tiles is one group, so a task holds no more than two tiles, however many candidates a root has. Pairs of a root with fewer
    than `least` equal bytes of the sketch, and pairs that are linked already, need no look.
    """

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.encode(errors="surrogatepass"), similar)) for t in b["text"]]
            yield b[["node", "root"]].assign(sketch=[sketch(h) for h in sets], shingles=[h.tobytes() for h in sets])

    n = label.count()
    texts = docs.select(F.monotonically_increasing_id().alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(label) if n <= 50_000 else label, "node").select("node", "root", "text")
    rows = rows.mapInPandas(make, "node long, root long, sketch binary, shingles binary")
    rows = checkpointed(rows.withColumn("cell", F.pmod(F.xxhash64("root"), F.lit(min(CELLS, -(-n // CELL) or 1)))))
    cells = checkpointed(rows.groupBy("cell").agg(F.ceil(F.count("*") / VERIFIED).cast("int").alias("_t")))
    rows = rows.join(F.broadcast(cells), "cell").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("_t")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_t") - 1)))

    def verify(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["root", "node"])
        ids, root, tile = (rows[c].to_numpy(np.int64) for c in ("node", "root", "tile"))
        made = np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, SKETCH)
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        ends, label = np.searchsorted(root, root, side="right"), np.arange(len(ids))
        across = tile[0] != tile[-1] or len(np.unique(tile)) > 1  # pairs within a tile are looked at where it meets itself
        for u in range(len(ids)):
            v = np.arange(u + 1, ends[u])
            if across:
                v = v[tile[v] != tile[u]]
            for w in v[(made[v] == made[u]).sum(axis=1) >= least].tolist():
                if label[u] != label[w] and _alike(sets[u], sets[w], similarity):
                    low, high = sorted((label[u], label[w]))
                    label[label == high] = low
        return stars(ids, label)

    return rows.groupBy("cell", F.least("tile", "_o").alias("i"), F.greatest("tile", "_o").alias("j")).applyInPandas(verify, "a long, b long")


def near_dedup(docs: DataFrame, similarity: float = 0.8, similar: int = 5) -> DataFrame:
    """The documents without near-copies: the first of each component stays. Documents link whose sets of `similar`-word shingles
    have a Jaccard similarity of `similarity` or more.

    Equal sets are one node. Candidates come from two prefilters, the lowest bits of 64 MinHashes and the bytes of 128, each so wide that
    it misses a pair with a chance of MISSED at most; within what they connect, every candidate pair is verified on the sets themselves.
    Rows are told by their place in docs, so docs must be a table that reads the same twice (a file or a checkpoint).
    """
    radius, least = 64 - reached(64, (1 + similarity) / 2, MISSED), reached(SKETCH, similarity + (1 - similarity) / 256, MISSED)
    rows = checkpointed(sketches(docs, similar))
    nodes = _nodes(rows, "same", "sketch", "fp")
    maybe = checkpointed(components(checkpointed(wide_links(nodes.select("node", "fp", "sketch"), radius, least))))
    label = components(checkpointed(verified_links(docs, maybe, similarity, similar, least)))
    out = _named(rows.select("_id", "_row", "same"), nodes, label, "same")
    drop = checkpointed(out.filter(F.col("_best._row") != F.col("_row")).select(F.col("_row").alias("_place")))
    return without_places(docs, drop)
