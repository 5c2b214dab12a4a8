"""Packing token streams into sequences by dynamic programming (operator 8)."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.tokens import byte_bpe

#: Token ids that a task holds before it decides on them.
HELD = 2_000_000


def window_cuts(ends: list[int], penalties: list[int], size: int = 1024) -> list[int]:
    """The cheapest cuts of a stream [0, ends[-1]) at some of the rising positions `ends`, in windows of at most `size`.

    A window costs its padding (size - length) and the penalty of the cut at its end (none at the last). The cost
    up to position j is min(f[i] + ends[i] over ends[j] - size <= ends[i] < ends[j]) + size - ends[j] + penalty, so a monotone queue of
    f[i] + ends[i] gives each in constant time. No two neighbours in `ends` may be further apart than `size`.
    Ties: the longest window. Returns the chosen positions, the last included.
    """
    pos, back = [0, *ends], [0] * (len(ends) + 1)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # f + position, position, index
    last = len(ends)
    for j in range(1, last + 1):
        e = pos[j]
        least = e - size
        while queue[0][1] < least:
            queue.popleft()
        best = queue[0]
        back[j] = best[2]
        if j < last:
            g = best[0] + size + penalties[j - 1]  # f[j] + e
            while queue and queue[-1][0] > g:
                queue.pop()
            queue.append((g, e, j))
    cuts = []
    while last:
        cuts.append(pos[last])
        last = back[last]
    return cuts[::-1]


def _boundaries(ids: np.ndarray, doc_ends: np.ndarray, stops: np.ndarray, size: int, penalty: int, torn: int) -> tuple[list[int], list[int]]:
    """Positions where the stream may be cut and what that costs: 0 at a document's end, `penalty` after a sentence,
    `torn` where a longer stretch has neither and is cut at every size // 8 tokens."""
    at = np.flatnonzero(stops[ids]) + 1
    cost = np.zeros(len(ids) + 1, np.int32)
    cost[at] = penalty
    cost[doc_ends] = -1
    at = np.flatnonzero(cost)
    at = at[at > 0]
    gap = np.diff(at, prepend=0)
    step = max(1, size // 8)
    if (gap > step).any():
        more = [np.arange(e - g + step, e, step) for e, g in zip(at[gap > step].tolist(), gap[gap > step].tolist(), strict=True)]
        more = np.concatenate(more)
        cost[more] = torn
        at = np.union1d(at, more)
    c = cost[at]
    return at.tolist(), np.where(c < 0, 0, c).tolist()


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", size: int = 1024, end_id: int = 0, penalty: int = 4, torn: int = 24, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds ids.

    A document is its token ids and end_id. The documents of a partition, in their order, are one stream; it is cut in
    windows of at most `size` at document or sentence ends, so that padding plus penalties (of cuts in a document) is
    least. A window is a sequence. The last of a partition has lengths that need no padding: powers of two.
    Nothing shuffles; a task holds about HELD ids, decides all but the last window and goes on from there. sequence_id is the
    partition's number * 2**40 and up.
    Null or empty texts have end_id alone; one text longer than HELD is still one document; repeated rows and null ids are
    documents of their own; an empty table gives no rows; other columns are not read.
    """
    columns = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        bpe = byte_bpe(tokenizer)
        stops = _sentence_ends(tokenizer)
        sequence = TaskContext.get().partitionId() << 40
        ids = np.zeros(0, np.uint32)
        names: list = []  # of the documents in ids
        whole: list[int] = []  # their tokens
        first = 0  # tokens of names[0] that went out already
        held: list[np.ndarray] = []

        def out(last: bool) -> pd.DataFrame | None:
            nonlocal ids, names, whole, first, sequence, held
            ids = np.concatenate([ids, *held]) if held else ids
            held = []
            if not len(ids):
                return None
            own = np.array(whole, np.int64)
            ends = np.cumsum(own) - first
            pos, cost = _boundaries(ids, ends, stops, size, penalty, torn)
            cuts = window_cuts(pos, cost, size)
            if last:
                tail = cuts.pop() - (cuts[-1] if cuts else 0)
                at = cuts[-1] if cuts else 0
                for bit in range(size.bit_length() - 1, -1, -1):  # the tail as powers of two
                    if tail >> bit & 1:
                        at += 1 << bit
                        cuts.append(at)
            else:
                cuts = cuts[:-2] if len(cuts) > 2 else []
            if not cuts:
                return None
            edges = np.union1d(np.array(cuts), ends[ends <= cuts[-1]])
            begin = np.concatenate([[0], edges[:-1]])
            doc = np.searchsorted(ends, begin, side="right")
            seq = np.searchsorted(np.array(cuts), begin, side="right")
            seq_begin = np.concatenate([[0], cuts])[seq]
            raw = memoryview(ids.astype("<u4", copy=False).tobytes())
            piece = pd.DataFrame({
                "doc_id": [names[d] for d in doc], "start": begin - (ends - own)[doc], "length": edges - begin,
                "ids_crc32": [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), edges.tolist(), strict=True)],
                "doc_tokens": own[doc], "sequence_id": sequence + seq, "offset": begin - seq_begin,
            })
            if with_ids:
                piece["ids"] = [ids[a:b].astype(np.int64) for a, b in zip(begin.tolist(), edges.tolist(), strict=True)]
            sequence += len(cuts)
            cut = cuts[-1]
            done = int(np.searchsorted(ends, cut, side="right"))
            rest = ends[done:] - cut
            first = int(own[done] - rest[0]) if done < len(own) else 0
            ids, names, whole = ids[cut:], names[done:], whole[done:]
            return piece

        n = 0
        for b in batches:
            for name, t in zip(b["doc_id"], b["text"], strict=True):
                x = np.append(bpe.ids(t), np.uint32(end_id))
                names.append(name)
                whole.append(len(x))
                held.append(x)
                n += len(x)
                if n >= HELD:
                    n = 0
                    if (piece := out(False)) is not None:
                        yield piece
        if (piece := out(True)) is not None:
            yield piece

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    got = rows.mapInPandas(packed, f"doc_id string, {columns}" + ", ids array<long>" * with_ids)
    return got.withColumn("doc_id", F.col("doc_id").cast(kind))


def _sentence_ends(tokenizer: str) -> np.ndarray:
    """For each token id: does it end a sentence (. ! ? at its end, or a line break in it)?"""
    bpe = byte_bpe(tokenizer)
    raw = [bpe.bpe.decode_single_token_bytes(i) for i in range(bpe.size)]
    return np.array([t.rstrip(b"\"')]").endswith((b".", b"!", b"?")) or b"\n" in t for t in raw])
