"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text (operator 1)."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import checkpointed, least_hashed

#: Labelled documents that a model is learned from at most: those with the smallest hashes of their ids.
LABELLED = 20_000
#: Chance of a pattern (or exception) that is chosen by accident, over all that are looked at.
ACCIDENT = 0.05
#: Phrases in which a match does not count, besides those that are learned.
EXCEPTIONS = ("trash can", "trash bin", "trash collection", "clown fish", "stupid question", "idiot proof", "scum bucket")

_LOOKS = {
    "a": "аαɑａᴀаӑ", "b": "вƅьβ", "c": "сϲⅽᴄ", "d": "ԁⅾɗ", "e": "еεҽєᴇ", "f": "ғϝ", "g": "ɡցɢ", "h": "һհн", "i": "іιıɩӏⅰɪ", "j": "јϳ", "k": "κкᴋ", "l": "ⅼʟƖ", "m": "мⅿᴍ", "n": "ոռɴ",
    "o": "оοօσᴏ", "p": "рρᴘ", "q": "ԛզ", "r": "гʀᴦ", "s": "ѕꜱʂ", "t": "тτᴛ", "u": "υսᴜ", "v": "νѵᴠⅴ", "w": "ԝшωᴡ", "x": "хχⅹ", "y": "уγүʏ", "z": "ᴢʐ",
}
#: Characters that look like a letter, then fullwidth ones; soft hyphens and characters without width go.
HOMOGLYPHS = {ord(c): k for k, v in _LOOKS.items() for c in v} | {0xFF01 + i: chr(0x21 + i) for i in range(94)} | dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
_PLAIN = dict(zip("àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ", "aaaaaaceeeeiiiinoooooouuuuyy", strict=True))
#: Lower case, without accents; l and i are one letter, as 1 may stand for either.
_LATIN = bytes(ord(_PLAIN.get(c, c).replace("l", "i")) if len(c := chr(i).lower()) == 1 and ord(c) < 256 else i for i in range(256))
_DIGITS = str.maketrans("0134567892@$!|", "oieasgtbgzasii")
_STANDS = re.compile(r"(?<=[^\W\d_])[0-9]+|[0-9]+(?=[^\W\d_])|(?<![^\W_])[@$](?=[^\W\d_])|(?<=[^\W_])[@$!|](?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")
_NEXT, _BEFORE = re.compile(r" ([^\W\d_]+)"), re.compile(r"(?<![^\W\d_])([^\W\d_]+) \Z")


def fold(text: str) -> str:
    """Lower-case text with homoglyphs, accents and digits or signs inside words replaced by the letters they stand for."""
    try:
        raw = text.encode("latin-1")
        text = raw.replace(b"\xad", b"").translate(_LATIN).decode("latin-1")
    except UnicodeEncodeError:
        text = text.translate(HOMOGLYPHS).lower().translate(HOMOGLYPHS)
        text = "".join(_PLAIN.get(c, c) for c in text).replace("l", "i")
    return _STANDS.sub(lambda m: m[0].translate(_DIGITS), text)


@dataclass(frozen=True)
class Model:
    """lexicon: (pattern, weight); a pattern that ends in * matches the starts of longer words, others whole words. bias, slopes: of the score."""

    lexicon: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...]
    bias: float
    slopes: tuple[float, float]


class Matcher:
    """One automaton over the folded lexicon and exception phrases."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.automaton = model, ahocorasick.Automaton()
        entries: dict[str, list[tuple[bool, float]]] = {}
        for pattern, weight in model.lexicon:
            entries.setdefault(pattern.rstrip("*"), []).append((pattern.endswith("*"), weight))
        for phrase in model.exceptions:
            entries.setdefault(fold(phrase), []).append((False, -1.0))
        for text, ways in entries.items():
            self.automaton.add_word(text, (len(text), tuple(ways)))
        if entries:
            self.automaton.make_automaton()
        self.empty = not entries

    def matches(self, text: str) -> tuple[dict[int, tuple[float, int]], list[tuple[int, int]]]:
        """Of a folded text: start to (weight, last place) of what matches, and the exception phrases (start, last place) in it.

        A pattern with a star matches the start of a longer word, another a whole word. Of the patterns that match at one start the heaviest
        counts. Phrases match whole words.
        """
        hits: dict[int, tuple[float, int]] = {}
        free: list[tuple[int, int]] = []
        if self.empty:
            return hits, free
        last = len(text) - 1
        for end, (n, ways) in self.automaton.iter(text):
            start = end - n + 1
            if start and text[start - 1].isalpha():
                continue
            whole = end == last or not text[end + 1].isalpha()
            for starts, weight in ways:
                if weight < 0:
                    if whole:
                        free.append((start, end))
                elif starts != whole and weight > hits.get(start, (0, 0))[0]:
                    hits[start] = (weight, end)
        return hits, free

    def weight(self, text: str) -> tuple[float, int]:
        """Sum of the weights of what matches outside exception phrases, and the number of matches."""
        hits, free = self.matches(text)
        if free:
            hits = {s: x for s, x in hits.items() if not any(a <= s <= b for a, b in free)}
        return sum(w for w, _ in hits.values()), len(hits)

    def features(self, text: str) -> tuple[float, float]:
        """The weight of the matches, and that by length (per hundred words), both as logarithms."""
        w, _ = self.weight(fold(text))
        if not w:
            return 0.0, 0.0
        return float(np.log1p(w)), float(np.log1p(100 * w / (text.count(" ") + text.count("\n") + 1)))

    def score(self, text: str) -> float:
        a, b = self.features(text)
        return float(1 / (1 + np.exp(-(self.model.bias + self.model.slopes[0] * a + self.model.slopes[1] * b))))


@functools.lru_cache(4)
def matcher(model: Model) -> Matcher:
    return Matcher(model)


def _patterns(words: Sequence[str], shortest: int = 4, longest: int = 10) -> set[str]:
    """Whole words of two letters or more, and starts of longer words."""
    out = {w for w in words if len(w) > 1}
    for w in words:
        out.update(w[:n] + "*" for n in range(shortest, min(longest, len(w) - 1) + 1))
    return out


def _surprise(hits: Column, n: Column, rate: float) -> Column:
    """At least so many hits of n at this rate have a chance of exp(-_surprise) or less (Chernoff); 0 where hits are no more than the rate says."""
    share = hits / n
    part = lambda x, y: F.when(x > 0, x * F.log(x / F.lit(y))).otherwise(0.0)
    return F.when(share > rate, n * (part(share, rate) + part(1 - share, 1 - rate))).otherwise(0.0)


def _choose(counts: pd.DataFrame, toxic: int, clean: int, least: float) -> list[tuple[str, float]]:
    """Patterns with their log-odds; of those that start alike the shortest that is as good as any that it covers."""
    w = np.log((counts["bad"] + 0.5) / (toxic + 1)) - np.log((counts["n"] - counts["bad"] + 0.5) / (clean + 1))
    good = {p: float(x) for p, x in zip(counts["pattern"], w, strict=True) if x >= least}
    chosen: dict[str, float] = {}
    for p in sorted(good, key=lambda p: (len(p.rstrip("*")), not p.endswith("*"), p)):
        stem = p.rstrip("*")
        before = [chosen[stem[:n] + "*"] for n in range(3, len(stem) + 1) if stem[:n] + "*" in chosen]
        if not before or good[p] > max(before) + 1.5:
            chosen[p] = good[p]
    return sorted(chosen.items())


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED, least: float = 2.5, exceptions: Sequence[str] = EXCEPTIONS) -> Model:
    """A model from labels (doc_id, toxic): at most `most` labelled documents, those with the smallest hashes of their ids.

    The lexicon: words and starts of words whose log-odds are `least` or more and whose share of toxic documents is beyond chance (ACCIDENT,
    over all patterns that there are). Documents with equal sets of words count once. Exceptions, besides those given: phrases of a match and the
    word before or after it that are in clean documents far more often than the match is, by the same rule. A logistic
    regression on the same documents then turns sum and density of matched weights into a probability. Nothing depends on
    the partitioning. Texts of labelled documents are read once and kept in the shared folder.
    Null labels and ids don't count; an id with several labels is toxic if one says so, and with several rows each is a document. Without
    toxic labels every score is 0.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = checkpointed(least_hashed(checkpointed(known), "doc_id", most))
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    sample = checkpointed(sample.select("text", "toxic"))

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"], "words": ["\n".join(sorted(set(_WORD.findall(fold(t))))) for t in b["text"]]})

    rows = checkpointed(sample.mapInPandas(words, "toxic int, words string").distinct())
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    nothing = Model((), (), -700.0, (0.0, 0.0))
    if not toxic:
        return nothing
    rate = toxic / (toxic + clean)

    def toxic_ones(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _counted(((1, _patterns(x.split("\n"))) for b in batches for x in b["words"]), "pattern")

    found = _summed(rows.filter("toxic = 1").mapInPandas(toxic_ones, "pattern string, n long, bad long"), "pattern")
    beyond = np.log(max(1, found.count()) / ACCIDENT)
    # with fewer toxic documents than that, a pattern isn't beyond chance even if no clean one has it
    maybe = frozenset(r["pattern"] for r in found.filter(F.col("bad") * F.lit(-np.log(rate)) >= beyond).select("pattern").collect()) if clean else frozenset()
    if clean and not maybe:
        return nothing

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _counted(((y, _patterns(x.split("\n")) & maybe) for b in batches for y, x in zip(b["toxic"], b["words"], strict=True)), "pattern")

    per = _summed(rows.mapInPandas(counts, "pattern string, n long, bad long"), "pattern") if clean else found
    per = per.filter((F.col("bad") * clean > (F.col("n") - F.col("bad")) * toxic * 8) & (_surprise(F.col("bad"), F.col("n"), rate) >= beyond)) if clean else per.filter("bad > 1")
    lexicon = tuple(_choose(per.toPandas(), toxic, clean, least))
    if not lexicon:
        return nothing
    model = Model(lexicon, tuple(exceptions), 0.0, (1.0, 1.0))

    def phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _counted(((y, _around(matcher(model), fold(t))) for b in batches for y, t in zip(b["toxic"], b["text"], strict=True)), "phrase")

    if clean:
        per = _summed(sample.mapInPandas(phrases, "phrase string, n long, bad long"), "phrase")
        matched = per.filter("phrase LIKE '%* *%'").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).first()
        if matched["n"] and matched["bad"]:
            good = F.col("n") - F.col("bad")
            beyond = np.log(per.count() / ACCIDENT)
            per = per.filter("phrase NOT LIKE '%* *%'").filter((good >= 4 * F.col("bad")) & (_surprise(good, F.col("n"), 1 - matched["bad"] / matched["n"]) >= beyond))
            model = Model(lexicon, (*exceptions, *sorted(r["phrase"] for r in per.collect())), 0.0, (1.0, 1.0))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = matcher(model).features
        for b in batches:
            x = np.array([f(t) for t in b["text"]], np.float64).reshape(-1, 2)
            yield pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "toxic": b["toxic"]})

    x = sample.mapInPandas(features, "a double, b double, toxic int").toPandas().sort_values(["a", "b", "toxic"])
    bias, *slopes = _fit(x[["a", "b"]].to_numpy(), x["toxic"].to_numpy(np.float64))
    return Model(model.lexicon, model.exceptions, float(bias), tuple(map(float, slopes)))


def _around(m: Matcher, text: str) -> set[str]:
    """Phrases of a match and a word beside it, on one line; and `* *` if there is any match (its count is that of documents with one)."""
    hits, free = m.matches(text)
    out = {"* *"} if hits else set()
    for start in hits:
        if any(a <= start <= b for a, b in free):
            continue
        own = _WORD.match(text, start)
        after = _NEXT.match(text, own.end())
        before = _BEFORE.search(text[max(0, start - 64) : start])
        if after:
            out.add(f"{own[0]} {after[1]}")
        if before:
            out.add(f"{before[1]} {own[0]}")
    return out


def _counted(rows: Iterator[tuple[int, set[str]]], name: str) -> Iterator[pd.DataFrame]:
    """For each string the number of rows and of toxic rows that have it; no frame where there are no rows."""
    n: Counter = Counter()
    bad: Counter = Counter()
    for y, found in rows:
        n.update(found)
        if y:
            bad.update(found)
    if n:
        yield pd.DataFrame({name: list(n), "n": list(n.values()), "bad": [bad[p] for p in n]})


def _summed(counted: DataFrame, name: str) -> DataFrame:
    return checkpointed(counted.groupBy(name).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))


def score_toxicity(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, score (0 to 1), predicted (1 if score >= 0.5). Whole texts, no shuffle.

    Only the text is an input of the score. Null and empty texts have the score of a text without matches; repeated rows and null
    ids give a row each; an empty table gives none; other columns are not read.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = matcher(model).score
        for b in batches:
            s = np.array([score(t) for t in b["text"]], np.float64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": s, "predicted": (s >= 0.5).astype(np.int32)})

    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = rows.mapInPandas(judge, "doc_id string, score double, predicted int")
    return out.withColumn("doc_id", F.col("doc_id").cast(docs.schema[doc_id].dataType))


def held_out(doc_id: Column) -> Column:
    """Is this row kept from learning? crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents that the model doesn't reject, with all their columns. Only texts go to Python: a row keeps its place."""
    flagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    @F.pandas_udf("boolean")
    def fine(texts: pd.Series) -> pd.Series:
        score = matcher(model).score
        return pd.Series([score(t) < 0.5 for t in texts])

    return flagged.filter(fine("_text")).select("_all.*")
