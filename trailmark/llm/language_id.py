"""Language ID by rank-order profiles.

A profile is a ranked list of the most frequent n-grams (1 to 3 letters, words framed by a blank).  A document's
own ranked list is compared to each language's by out-of-place distance: how far each of its n-grams stands from
its place in the profile, the full length for one that isn't there.  Profiles are counted over all training rows;
each task adds up its own counts, so what is shuffled is at most its distinct n-grams per language.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.llm.common import trimmed


def _letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


def ngram_counts(text: str, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams and how often each occurs.

    An n-gram is a number: 21 bits a code point, blank is 0, and the length follows from the leading one.  Runs
    of anything but letters are one blank.  Without a letter there are no n-grams.
    """
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kept = letters[points]
    if not kept.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    symbols = np.where(kept, points, 0).astype(np.int64)
    symbols = symbols[(symbols > 0) | np.concatenate(([True], symbols[:-1] > 0))]
    twos = (symbols[:-1] << 21) | symbols[1:]
    threes = (twos[:-1] << 21) | symbols[2:]
    middle = symbols[1:-1] > 0
    grams = np.concatenate((symbols[symbols > 0], twos | (1 << 62), threes[middle] | (1 << 61)))
    grams.sort()
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    return grams[first], np.diff(np.concatenate((first, [len(grams)])))


def ranked(grams: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The most frequent first, ties by the n-gram's number."""
    return grams[np.argsort(-counts, kind="stable")[:length]]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, counts = np.concatenate([g for g, _ in parts]), np.concatenate([c for _, c in parts])
    distinct, at = np.unique(grams, return_inverse=True)
    return distinct, np.bincount(at, weights=counts).astype(np.int64)


def count_profiles(labelled: DataFrame, most: int = 2_000_000) -> DataFrame:
    """``lang, gram, n`` over all rows of ``labelled`` (text, lang); a task holds at most ``most`` counts at a time."""

    def rows(totals: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, parts in totals.items():
            grams, counts = _merged(parts)
            for at in range(0, len(grams), 50_000):
                g, n = grams[at : at + 50_000], counts[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = _letter_table()
        totals: dict[str, list] = {}
        held = 0
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = ngram_counts(text or "", letters)
                totals.setdefault(lang, []).append(part)
                held += len(part[0])
                if held > most:
                    totals = {x: [_merged(parts)] for x, parts in totals.items()}
                    held = sum(len(parts[0][0]) for parts in totals.values())
                    if held > most // 2:
                        yield from rows(totals)
                        totals, held = {}, 0
        yield from rows(totals)

    return labelled.select("text", "lang").mapInArrow(trimmed(count), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn_profiles(labelled: DataFrame, length: int = 300, max_languages: int = 1000) -> dict[str, list[int]]:
    """lang -> its ``length`` most frequent n-grams, ranked; what reaches the driver is bounded by both limits."""
    counts = count_profiles(labelled)
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= length).select("lang", "rank", "gram")
    rows = top.limit(length * max_languages + 1).collect()
    if len(rows) > length * max_languages:
        raise ValueError(f"more than {max_languages} languages")
    profiles: dict[str, list[int]] = {}
    for row in sorted(rows):
        profiles.setdefault(row["lang"], []).append(row["gram"])
    return profiles


class Profiles:
    """All profiles as one sorted table, for one look-up per document."""

    def __init__(self, profiles: dict[str, list[int]], length: int):
        self.langs, self.length = sorted(profiles), length
        self.grams = np.unique(np.array([g for p in profiles.values() for g in p], dtype=np.int64))
        self.ranks = np.full((len(self.langs), len(self.grams) + 1), -1, dtype=np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.grams, profiles[lang])] = np.arange(len(profiles[lang]))
        self.letters = _letter_table()

    def predict(self, text: str | None) -> tuple[str, float]:
        """The nearest language, ties to the first by name, and how near: 1 minus distance over the largest there is."""
        own = ranked(*ngram_counts(text or "", self.letters), self.length)
        if not len(own) or not self.langs:
            return "und", 0.0
        at = np.searchsorted(self.grams, own)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != own)] = len(self.grams)
        ranks = self.ranks[:, at]
        places = np.arange(len(own))
        distance = np.where(ranks < 0, self.length, np.abs(ranks - places)).sum(axis=1)
        best = int(distance.argmin())
        return self.langs[best], float(1 - distance[best] / (self.length * len(own)))


def identify(docs: DataFrame, profiles: dict[str, list[int]], length: int = 300) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` appended, by text alone.

    Null texts and texts without a letter are ``und`` with score 0, and so is everything where no profile was
    learned.  Very long texts are read whole.  Repeated rows get equal predictions; an empty table gives an
    empty one.  Columns of the input that are called like the two appended ones are replaced.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    frame = docs.select(*kept)
    at = kept.index("text")
    schema = T.StructType([*frame.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Profiles(profiles, length)
        for batch in batches:
            found = [table.predict(t) for t in batch.column(at).to_pylist()]
            columns = [*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score"])

    return frame.mapInArrow(trimmed(predict), schema)
