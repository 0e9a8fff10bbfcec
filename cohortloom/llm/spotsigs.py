"""Document fingerprints by SpotSigs: chains of content words that follow common words.

Each occurrence of a common word (an anchor) starts a chain with the next content words behind it; the set of a text's chains
is its fingerprint. A text without a chain uses every word as an anchor, then its words, then itself. Two fingerprints are
compared by the Jaccard coefficient of their sets, which cannot exceed the smaller size over the larger: sets are partitioned
by size, and what the sizes rule out is not compared.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.bpe import Memory
from cohortloom.llm.common import cut, mixed, parts

#: Common words of four languages.
ANCHORS = frozenset(
    "a an and are as at be been by for from had has have he her his in is it not of on or she that the their they this to was were which with "
    "au avec ce ces dans de des du elle en est et il la le les ne ou par pas pour que qui sa se ses son sur un une "
    "als auch auf aus bei das dem den der des die ein eine er es für hat im ist mit nach nicht sich sie sind und von war zu zum zur "
    "al con del el ella era es esta fue las lo los más no o para pero por su sus una y".split()
)
WORD = re.compile(r"\w+")
CHAIN = 2
P, Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _word(word: str) -> int:
    """Its hash, whose lowest bit says whether it is an anchor."""
    h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
    return h | 1 if word in ANCHORS else h & ~1


WORDS = Memory(_word, most=200_000)


def signatures(text: str) -> np.ndarray:
    """Sorted distinct 32-bit hashes of the text's chains; empty for an empty text only."""
    words = WORD.findall(text.lower())
    h = np.fromiter(map(WORDS.__getitem__, words), np.uint64, len(words))
    anchor = (h & np.uint64(1)).astype(bool)
    content = h[~anchor]
    chains = _chains(h[anchor], np.cumsum(~anchor)[anchor], content)
    if not len(chains):
        chains = _chains(h, np.arange(1, len(h) + 1), h)
    if not len(chains):
        chains = mixed(h) if len(h) else np.array([xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))] if text else [], np.uint64)
    return np.unique((chains >> np.uint64(32)).astype(np.uint32))


def _chains(anchors: np.ndarray, following: np.ndarray, content: np.ndarray) -> np.ndarray:
    """following: place in `content` of the first word behind each anchor."""
    fits = following + CHAIN <= len(content)
    at, value = following[fits], anchors[fits]
    for k in range(CHAIN):
        value = mixed(value * P + content[at + k] * Q + np.uint64(k))
    return value


def fingerprint(found: np.ndarray) -> str:
    return base64.b64encode(found.astype("<u4").tobytes()).decode()


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard coefficient; 0 without a comparison where the sizes already rule out more than `least`. Two empty sets are alike."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small / large <= least:
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (small + large - common)


def edited_text(text: str, after: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of `after`."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one that follows by descending id (after the last the first; equal ids follow by a hash of their
    texts; null ids come last). A null text counts as empty. Repeated rows stay; other columns are ignored; an empty table
    gives an empty result. Ids must be whole numbers.

    Rows are dealt into ranges of ids between quantiles of the whole table, one shuffle; each range also gets the first row
    of the range that follows it, so each finds its successors alone. What reaches the driver is one id per range.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    n = parts(spark)
    cuts = rows.select(F.percentile_approx("id", [k / n for k in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    place = F.when(F.col("id").isNull(), -1).otherwise(F.size(F.filter(F.lit(cuts) if cuts else F.array().cast("array<long>"), lambda c: c <= F.col("id"))))
    ranged = rows.withColumn("range", place)
    firsts = [(r["range"], r["first"]) for r in ranged.groupBy("range").agg(F.max("id").alias("first")).orderBy(F.desc("range")).collect()]
    if not firsts:
        return spark.createDataFrame([], schema)
    # the first row of each range also ends the range before it, by descending id; the very first one ends the last range
    before = [r for r, _ in firsts[-1:] + firsts[:-1]]
    targets = [-1] * (n + 2)
    for (r, _), goes_to in zip(firsts, before, strict=True):
        targets[r + 1] = goes_to
    known = [f for _, f in firsts if f is not None]
    is_first = F.col("id").isin(known) if known else F.lit(False)
    if any(f is None for _, f in firsts):
        is_first = is_first | F.col("id").isNull()
    ends = ranged.filter(is_first).withColumn("range", F.get(F.lit(targets), F.col("range") + 1)).withColumn("end", F.lit(True))
    both = ranged.withColumn("end", F.lit(False)).unionByName(ends)
    dealt = both.repartition(n, "range").sortWithinPartitions(F.desc("range"), "end", F.desc_nulls_last("id"), F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, kinds = None, [], None

        def made() -> pa.RecordBatch:
            types = [kinds, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in cut(batches, 256):
            kinds = batch.schema.field(0).type
            for key, text, range_, end in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                own = signatures(text)
                if held is not None and held[3] == range_:
                    edited = edited_text(held[1], text)
                    changed = signatures(edited)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((held[0], len(held[1]), digest, fingerprint(held[2]), fingerprint(changed), likeness(held[2], changed), likeness(held[2], own)))
                held = None if end else (key, text, own, range_)
            if out:
                yield made()
        if out:
            yield made()

    return dealt.select("id", "text", "range", "end").mapInArrow(run, schema)
