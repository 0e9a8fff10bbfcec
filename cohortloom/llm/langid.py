"""Language identification by rank-order profiles: a text's most frequent character n-grams against those of each language.

A profile is the list of a language's most frequent n-grams, most frequent first. A text is compared by the out-of-place
distance: for each of its own most frequent n-grams, how far its rank is from its rank in the profile, and the profile's
length where the profile lacks it. The nearest profile names the language.

Learning counts the n-grams of all learning rows per language: each task hands on one row per language and n-gram it has met,
Spark adds them up and keeps the first ones of each language. What reaches the driver are the profiles, whose size is fixed
by `length` and the number of languages (checked against `most_languages`).
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cohortloom.llm.common import cut

UNDETERMINED = "und"
NO_LETTER = re.compile(r"[\W\d_]+")


def grams(text: str, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the text's words as integers, and their counts. Words are lower case and stand between spaces; no n-gram crosses more than one of these."""
    flat = " " + NO_LETTER.sub(" ", text.lower()).strip() + " "
    if len(flat) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.frombuffer(flat.encode("utf-32-le"), "<u4").astype(np.int64)
    space = c == 32
    found = []
    for n in orders:
        k = len(c) - n + 1
        if k <= 0:
            continue
        code, inner = c[:k].copy(), np.zeros(k, bool)
        for at in range(1, n):
            code = (code << 21) | c[at : at + k]
            if at < n - 1:
                inner |= space[at : at + k]
        inner |= space[:k] if n == 1 else False
        found.append(code[~inner])
    return np.unique(np.concatenate(found), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The most frequent codes, most frequent first; equal counts by code."""
    if len(codes) > length:
        floor = np.partition(counts, len(counts) - length)[len(counts) - length]
        codes, counts = codes[counts >= floor], counts[counts >= floor]
    return codes[np.lexsort((codes, -counts))][:length]


@dataclass(frozen=True)
class Profiles:
    """languages, sorted; per language its profile; of the same n-grams a sorted table of ranks."""

    languages: list[str]
    codes: np.ndarray
    ranks: np.ndarray
    orders: tuple[int, ...]
    length: int

    def nearest(self, text: str | None) -> tuple[str, float]:
        """Language and score in 0 to 1: how much nearer than the largest possible distance the nearest profile is."""
        codes, counts = grams(text or "", self.orders)
        if not len(codes) or not self.languages:
            return UNDETERMINED, 0.0
        own = ranked(codes, counts, self.length)
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        rank = np.where((self.codes[at] == own)[:, None], self.ranks[at], self.length)
        gap = np.where(rank < self.length, np.abs(rank - np.arange(len(own))[:, None]), self.length).sum(axis=0)
        best = int(np.argmin(gap))
        return self.languages[best], float(1 - gap[best] / (self.length * len(own)))


def learn(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", orders: tuple[int, ...] = (1, 2, 3), length: int = 400, most_languages: int = 1000) -> Profiles:
    """Profiles of every non-null language of the rows; n-grams of up to three characters (21 bits each).

    Null texts and texts without letters teach nothing. Orders over 3 do not fit the integer and are refused, as are more
    languages than `most_languages`: the profiles are held by every worker.
    """
    if max(orders) > 3:
        raise ValueError("n-grams of at most 3 characters")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counter in found.items():
                codes, counts = zip(*counter.items(), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes)), pa.array(codes, pa.int64()), pa.array(counts, pa.int64())], ["lang", "gram", "n"])
            found.clear()

        for batch in cut(batches, 2000):
            by: dict[str, list[str]] = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by[lang].append(text)
            for lang, some in by.items():
                codes, counts = grams(" ".join(some), orders)
                if len(codes):
                    found[lang].update(dict(zip(codes.tolist(), counts.tolist(), strict=True)))
            held = sum(map(len, found.values()))
            if held > 1_000_000:
                yield from out()
        yield from out()

    counted = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna().mapInArrow(count, "lang string, gram long, n long")
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # a plain limit on the row number: each task hands on no more than `length` of a language
    first = total.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("place") <= length)
    kept = first.select("lang", "gram", (F.col("place") - 1).alias("rank")).limit(length * (most_languages + 1)).collect()  # one more language than allowed shows
    languages = sorted({r.lang for r in kept})
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    codes = np.array(sorted({r.gram for r in kept}), np.int64)
    ranks = np.full((len(codes), len(languages)), length, np.int64)
    row, column = {int(c): k for k, c in enumerate(codes)}, {x: k for k, x in enumerate(languages)}
    for r in kept:
        ranks[row[r.gram], column[r.lang]] = r.rank
    return Profiles(languages, codes, ranks, orders, length)


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score. `und` with score 0 where the text is null or has no letter, or nothing was learned.

    Whole texts count. Repeated rows and null ids stay as they are; other columns are ignored; an empty table gives an empty
    result. Equal distances go to the language that sorts first.
    """
    names = [id_col, "lang_pred", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            found = [profiles.nearest(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, profiles: Profiles, least: float, text_col: str = "text") -> DataFrame:
    """The rows whose text has a language with at least this score, all columns as they are."""

    @F.pandas_udf("boolean")
    def fits(column):
        return column.map(lambda t: (found := profiles.nearest(t))[0] != UNDETERMINED and found[1] >= least, na_action=None).astype(bool)

    return docs.filter(fits(F.col(text_col)))
