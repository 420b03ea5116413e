"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text and normalised by length.

Folding lower-cases, maps look-alike letters of other scripts and digits or signs inside words to Latin letters, and
turns everything between words into one blank. The lexicon (whole words, and beginnings of longer words) and its
exception phrases are learned from labelled documents; a logistic curve over matched weight and length gives the score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import spread

from .common import mapped, table, tidied, unit_hash, wider, written

#: Letters of other scripts that look like the Latin letter, and signs used for letters.
HOMOGLYPHS = {
    "a": "аαａ", "b": "ьｂ", "c": "сϲｃ", "d": "ԁｄ", "e": "еεｅ", "g": "ɡｇ", "h": "һｈ", "i": "іιıｉ", "j": "јｊ",
    "k": "кκｋ", "l": "ӏｌ", "m": "мｍ", "n": "ոｎ", "o": "оοօｏ", "p": "рρｐ", "r": "гｒ", "s": "ѕｓ", "t": "тτｔ",
    "u": "υսｕ", "v": "νѵｖ", "w": "ѡｗ", "x": "хχｘ", "y": "уγｙ", "z": "ᴢｚ",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
INVISIBLE = "​‌‍⁠﻿­"

_LETTERS = {ord(v): k for k, vs in HOMOGLYPHS.items() for v in vs} | {ord(c): None for c in INVISIBLE}
_FOREIGN = re.compile("[" + "".join("".join(v) for v in HOMOGLYPHS.values()) + INVISIBLE + "]")
_SIGNS = str.maketrans(SIGNS)
_SIGNED = re.compile(r"[013457@$!|8]{1,3}(?=[^\W\d_])")
_GAP = re.compile(r"[\W\d_]+")


def fold(text: str) -> str:
    """Folded words of a text, one blank before, between and after; a text without letters is one blank."""
    t = text.lower()
    if not t.isascii() and _FOREIGN.search(t):
        t = t.translate(_LETTERS)
    t = _SIGNED.sub(lambda m: m[0].translate(_SIGNS), t)
    return _GAP.sub(" ", f" {t} ")


@dataclass
class Lexicon:
    """Weights by whole word and by beginning (of a longer word), exception phrases, and the score's coefficients."""

    words: dict[str, float]
    stems: dict[str, float]
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, ...] = (-4.0, 1.0, 0.0)
    _matcher: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return self.__dict__ | {"_matcher": None}

    def matcher(self):
        import ahocorasick

        if self._matcher is None:
            self._matcher = ahocorasick.Automaton()
            entries: dict[str, list] = {}
            for w, v in self.words.items():
                entries.setdefault(f" {w} ", []).append(("word", v))
            for w, v in self.stems.items():
                entries.setdefault(f" {w}", []).append(("stem", v))
            for w in self.exceptions:
                entries.setdefault(f" {w} ", []).append(("except", 0.0))
            for key, kinds in entries.items():
                self._matcher.add_word(key, (len(key), kinds))
            if entries:
                self._matcher.make_automaton()
        return self._matcher if len(self._matcher) else None

    def matched(self, folded: str) -> float:
        """Sum over words of the heaviest entry that matches them, words inside an exception phrase left out."""
        auto, best, spared = self.matcher(), {}, []
        if auto is None:
            return 0.0
        for end, (n, kinds) in auto.iter(folded):
            start = end - n + 1
            for kind, weight in kinds:
                if kind == "except":
                    spared.append((start, end))
                elif kind == "word" or folded[end + 1] != " ":
                    best[start] = max(best.get(start, 0.0), weight)
        for a, b in spared:
            at = a
            while 0 <= at < b:
                best.pop(at, None)
                at = folded.find(" ", at + 1)
        return sum(best.values())

    def features(self, text: str | None) -> tuple[float, float]:
        """Matched weight and number of words."""
        folded = fold(text or "")
        return self.matched(folded), float(folded.count(" ") - 1)

    def score(self, matched, words):
        return 1 / (1 + np.exp(-np.clip(shape(matched, words) @ np.array(self.curve), -30, 30)))


def shape(matched, words) -> np.ndarray:
    """What the curve weighs: one, the logarithm of the matched weight, and of that weight per hundred words."""
    m, n = np.asarray(matched, dtype=float), np.asarray(words, dtype=float)
    return np.stack([np.ones_like(m), np.log1p(m), np.log1p(100 * m / (n + 20))], axis=-1)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, toxic, clean): documents with the word, summed by batch."""
    for batch in batches:
        sums = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sums[0 if toxic else 1].update(set(fold(text or "").split()))
        words = list(sums[0] | sums[1])
        columns = [pa.array(words, pa.string()), *(pa.array([s[w] for w in words], pa.int64()) for s in sums)]
        yield pa.RecordBatch.from_arrays(columns, ["word", "toxic", "clean"])


def fit(
    labelled: DataFrame, text: str = "text", toxic: str = "toxic", support: int = 5, ratio: float = 8.0, most: int = 12_000,
    weight: str | None = None,
) -> Lexicon:
    """A lexicon from labelled rows, of which at most about ``most`` are used (by hash, half of them toxic where there
    are as many); rows with a null label are left out. Without toxic or clean rows the lexicon is empty. A row counts for
    the curve as ``weight`` labelled rows, so that sampling by class does not move the score.

    An entry stands in at least ``support`` toxic documents and is at least ``ratio`` times likelier there. A beginning
    counts longer words only and needs three of them. Words that a beginning would match although clean texts have
    them as often become exceptions. All entries come to the driver; their number is bounded by the ``most`` rows used.
    Repeated rows count as often as they stand, empty tables give an empty lexicon.
    """
    rows = labelled.select(F.col(text).alias("text"), (F.col(toxic) > 0).alias("toxic"), (F.col(weight) if weight else F.lit(1.0)).alias("weight")).where("toxic is not null")
    rows = written(rows)
    counted = rows.groupBy("toxic").agg(F.count("*").alias("n"), F.sum("weight").alias("all")).collect()
    sizes, whole = ({bool(r["toxic"]): r[c] for r in counted} for c in ("n", "all"))
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        return Lexicon({}, {}, curve=(4.0 if n1 else -4.0, 0.0, 0.0))
    share = {True: min(1.0, most / 2 / n1), False: min(1.0, most / 2 / n0)}
    if min(share.values()) < 1:
        keep = F.when(F.col("toxic"), share[True]).otherwise(share[False])
        rows = rows.where(unit_hash("fit", F.xxhash64("text")) < keep)
    words = rows.mapInArrow(tidied(_counts), "word string, toxic long, clean long")
    words = written(words.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    total = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    t_all, c_all = total.get(True, 0) + 1.0, total.get(False, 0) + 1.0
    odds = F.log(((F.col("toxic") + 0.5) / t_all) / ((F.col("clean") + 0.5) / c_all))

    def sure(df: DataFrame) -> DataFrame:
        return df.where(F.col("toxic") >= support).withColumn("weight", odds).where(F.col("weight") >= math.log(ratio))

    lexicon = {r["word"]: r["weight"] for r in sure(words.where("length(word) > 2")).select("word", "weight").collect()}
    parts = words.select("word", "toxic", "clean", F.explode(F.sequence(F.lit(4), F.lit(8))).alias("n")).where("length(word) > n")
    parts = parts.withColumn("stem", F.expr("substring(word, 1, n)"))
    stems = parts.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count_if(F.col("toxic") > 0).alias("kinds"))
    heads = written(sure(stems.where("kinds >= 3")).select("stem", "weight"))
    beginnings = {r["stem"]: r["weight"] for r in heads.collect()}
    known = parts.where((F.col("clean") >= support) & (odds <= math.log(2))).join(heads, "stem", "left_semi")
    spared = {r["word"] for r in known.select("word").distinct().collect()}
    found = Lexicon(lexicon, beginnings, frozenset(spared - set(lexicon)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [found.features(t) for t in batch.column(0).to_pylist()]
            columns = [pa.array([p[i] for p in pairs], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], ["matched", "words", "toxic"])

    sample = rows.mapInArrow(tidied(features), "matched double, words double, toxic boolean").toPandas()
    sample = sample.sort_values(["matched", "words", "toxic"])
    y = sample["toxic"].to_numpy(dtype=float)
    weight = np.where(y > 0, whole[True] / max(y.sum(), 1), whole[False] / max((1 - y).sum(), 1))
    found.curve = _logistic(shape(sample["matched"], sample["words"]), y, weight)
    return found


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Newton steps for a weighted logistic regression with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def with_score(docs: DataFrame, lexicon: Lexicon, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1, computed in place row by row; null and empty texts score as no words, repeated
    rows alike, a column of the same name is replaced and all others stay; an empty table gives an empty one."""
    docs = docs.drop(score)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [lexicon.features(v.as_py()) for v in batch.column(batch.schema.get_field_index(text))]
            values = lexicon.score([p[0] for p in pairs], [p[1] for p in pairs]) if pairs else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, score])

    return mapped(docs, run, wider(docs.schema, **{score: "double"}))


def held_out() -> F.Column:
    """Documents that learning never sees: crc32 of the id as text divisible by five (a null id as the word null)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, bound: int = 12_000) -> DataFrame:
    """(text, toxic, weight) of labelled documents outside the held-out fifth; the weight says for how many of its class a
    taken one stands.

    ``bound`` limits how many labelled ids are taken, half of them toxic where there are as many: a hash threshold
    from the labels' counts. An id with several labels counts as the largest. Their ids are then few enough, at any size of the input, to be sent to every task.
    """
    labels = labels.where(~held_out() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r[0]: r[1] for r in labels.groupBy((F.col("toxic") > 0)).count().collect()}
    share = {k: min(1.0, bound / 2 / max(n, 1)) for k, n in sizes.items()}
    keep = F.when(F.col("toxic") > 0, share.get(True, 1.0)).otherwise(share.get(False, 1.0))
    chosen = labels.where(unit_hash("label", F.col("doc_id")) < keep).withColumn("weight", 1 / keep)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "toxic", "weight")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document, learned without the held-out fifth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = fit(training_rows(docs, table(spark, sf_dir, "labels")), weight="weight")
    scored = with_score(spread(docs), lexicon)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
