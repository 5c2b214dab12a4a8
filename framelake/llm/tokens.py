"""Token counts with a whole-token shortcut (operator 9), and token ids."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens of which a worker remembers the count before it forgets all.
REMEMBERED = 400_000


@functools.cache
def _file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """A byte-level BPE of a tokenizers .json file, with the merges done by tiktoken.

    That a merge's id is its rank is checked; so both libraries merge alike. Special strings in a text are special
    tokens, as the file's library has it by default. Unicode versions differ between libraries: a character that the split here takes for
    another kind than the file's library does (seen once for each character) sends its text's split, and no more, to that library.
    """

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers.pre_tokenizers import ByteLevel

        spec = json.load(open(path))
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or spec["post_processor"] or not plain:
            raise ValueError(f"{path}: not a plain byte-level BPE")
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in k): v for k, v in model["vocab"].items() if k not in self.special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(model["vocab"]["".join(m)] != 256 + i for i, m in enumerate(pairs)):
            raise ValueError(f"{path}: ids aren't in the order of merges")
        # ' and letters; letters; numbers; the rest; white space, of which the last stays with the next word
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.bpe = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.split = regex.compile(pattern).findall
        self.slow_split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.made: dict[str, list[int]] = {}
        self.same: set[str] = set()
        self.odd: set[str] = set()
        self.latin = not self._odd(set(map(chr, range(256))))
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.size = len(ranks) + len(self.special)
        self.whole = self._whole(ranks)
        self.count: dict[str, int] = dict.fromkeys(self.whole, 1)

    def _whole(self, ranks: dict[bytes, int]) -> set[str]:
        """The proof: vocabulary strings that are one pre-token and that the merges do reach, as one token."""
        texts = {}
        for raw, i in ranks.items():
            try:
                texts[raw.decode()] = i
            except UnicodeDecodeError:
                continue
        return {t for t, i in texts.items() if self.bpe._encode_single_piece(t) == [i] and self.split(t) == [t]}

    def _odd(self, chars: set[str]) -> bool:
        """Is one of these of another kind for the file's library? Letters join an a, numbers a 1, white space a tab, the rest an exclamation mark."""
        for c in chars - self.same - self.odd:
            alike = all(len(self.split(x + c)) == len(self.slow_split(x + c)) for x in "a1!\t")
            (self.same if alike else self.odd).add(c)
        return not self.odd.isdisjoint(chars)

    def parts(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings, as the file's library splits it."""
        if not self._plain(text) and self._odd(set(text)):
            return [text[a:b] for _, (a, b) in self.slow_split(text)]
        return self.split(text)

    def _plain(self, text: str) -> bool:
        if not self.latin:
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def ids(self, text: str) -> np.ndarray:
        """Token ids (uint32) of the whole text."""
        special = self.specials is not None and self.specials.search(text) is not None
        if not self._plain(text):  # that library's own split knows a third version
            out: list[int] = []
            at, made = 0, self.made
            if len(made) > REMEMBERED:
                made = self.made = {}
            for m in [*(self.specials.finditer(text) if special else ()), None]:
                for p in self.parts(text[at : m.start() if m else len(text)]):
                    if p not in made:
                        made[p] = self.bpe._encode_single_piece(p)
                    out += made[p]
                if m:
                    out.append(self.special[m[0]])
                    at = m.end()
            return np.array(out, np.uint32)
        if special:
            return np.array(self.bpe.encode(text, allowed_special="all"), np.uint32)
        return self.bpe.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)

    def n(self, text: str) -> int:
        """Number of tokens: pre-tokens that are whole tokens count one, only the others are merged."""
        if self.specials is not None and self.specials.search(text):
            return len(self.specials.findall(text)) + sum(self.n(t) for t in self.specials.split(text))
        known = self.count
        parts = self.parts(text)
        try:
            return sum([known[p] for p in parts])
        except KeyError:
            pass
        if len(known) > len(self.whole) + REMEMBERED:
            known = self.count = dict.fromkeys(self.whole, 1)
        encode = self.bpe._encode_single_piece
        for p in parts:
            if p not in known:
                known[p] = len(encode(p))
        return sum([known[p] for p in parts])


@functools.cache
def byte_bpe(name: str) -> ByteBpe:
    """The tokenizer, once per Python worker. name: of a file in the tokenizer folder, or a path."""
    return ByteBpe(name if "/" in name else _file(name))


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Whole texts, without added tokens; a null text counts as empty: 0 bytes, 0 tokens. Rows stay where they are: no
    shuffle. Repeated rows and null ids give a row each; an empty table gives none; other columns are not read.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = byte_bpe(tokenizer).n
        for b in batches:
            tokens = np.fromiter(map(n, b["text"]), np.int64, len(b))
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "n_tokens": tokens, "over_limit": tokens > limit})

    t = F.coalesce(F.col(text), F.lit(""))
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), t.alias("text"), F.octet_length(t).cast("long").alias("n_bytes"))
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        return rows.mapInPandas(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return _exact_ids(rows, count, kind, "n_bytes long, n_tokens long, over_limit boolean")


def _exact_ids(rows: DataFrame, f, kind: str, rest: str) -> DataFrame:
    """mapInPandas with integer ids that may be null: pandas would make them floats, so they travel as text if null."""
    s = rows.withColumn("doc_id", F.col("doc_id").cast("string"))
    return s.mapInPandas(f, f"doc_id string, {rest}").withColumn("doc_id", F.col("doc_id").cast(kind))
