"""Near-duplicate groups by MinHash: one permutation, optimal densification, banded buckets, star-shaped candidate links.

A document's distinct word shingles are hashed once; the hash range is cut into bins and each bin keeps its smallest hash. An
empty bin takes the value of the first filled bin in its own fixed random order. Bins are grouped into bands; documents that
agree in all bins of a band meet in a bucket. Documents of equal sets are merged first, so that only different ones meet.

Within a bucket the documents are not paired: the one that meets most others over all its buckets is the centre, and each
other one is compared with it, on the full sets. Among copies of one text that is a copy with few edits, the one most of the
others are linked with. What is not linked with its centre meets again around a new centre, `rounds` times. Then the documents
of buckets that still hold several groups are joined across groups by their rarest shingles, which finds every link between
them. So a pair is missed only if it shares no bucket: with 48 bands of 5 rows a pair at the threshold of 0.75 shares 11 on
average, and none with a chance of 2 in a million.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import cut, mixed, texts
from cohortloom.llm.components import components

BANDS, ROWS, SHINGLE = 48, 5, 5
#: Sets whose sizes differ by less than this factor are in one block.
BLOCK = 1.05


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of `size` words; of the whole, if it has fewer words; none without words.

    Words are what stands between ASCII white space, with A-Z lower-cased.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(words))
    runs = len(words) - n + 1
    v = np.full(runs, n, np.uint64)
    for k in range(n):
        v = (v + h[k : k + runs]) * np.uint64(0x9E3779B97F4A7C15)
    return np.unique(mixed(v))


@functools.lru_cache(maxsize=4)
def _order(bins: int) -> np.ndarray:
    """rank[i, j]: how late bin i asks bin j for a value when it is empty; itself first."""
    drawn = np.random.default_rng(20_240_601).random((bins, bins))
    drawn[np.diag_indices(bins)] = -1
    return drawn.argsort(axis=1).argsort(axis=1).astype(np.int16)


def buckets(hashes: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit bucket per band, of a non-empty sorted set of hashes."""
    bins = bands * rows
    at = ((hashes >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    filled, first = np.unique(at, return_index=True)
    filled = filled.astype(np.int64)
    value = mixed(hashes[first])
    signature = np.zeros(bins, np.uint64)
    signature[filled] = value
    if len(filled) < bins:
        empty = np.ones(bins, bool)
        empty[filled] = False
        signature[empty] = value[_order(bins)[np.ix_(np.flatnonzero(empty), filled)].argmin(axis=1)]
    band = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        band = mixed((band + signature.reshape(bands, rows)[:, k]) * np.uint64(0x9E3779B97F4A7C15))
    return band


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row: id, n_shingles, a 128-bit digest of the set in two longs, and its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches):
            sets = [shingles(t, size) for t in texts(batch.column(1))]
            digests = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "<i8") for s in sets]).reshape(-1, 2)
            found = [buckets(s, bands, rows).view(np.int64) if len(s) else np.empty(0, np.int64) for s in sets]
            values = [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests[:, 0]), pa.array(digests[:, 1]), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(values, ["id", "n_shingles", "d1", "d2", "buckets"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_shingles long, d1 long, d2 long, buckets array<long>")


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, text) rows to (id, grams): the full set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, 128):
            sets = [shingles(t, size).view(np.int64) for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "grams"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, grams array<long>")


def confirmed(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have at least `percent` of their union in common."""
    left = grams.select(F.col("id").alias("b"), F.col("grams").alias("of_b"))
    right = grams.select(F.col("id").alias("a"), F.col("grams").alias("of_a"))
    small, large = F.least(F.size("of_a"), F.size("of_b")), F.greatest(F.size("of_a"), F.size("of_b"))
    both = pairs.join(left, "b").join(right, "a").filter(small * 100 >= large * percent)
    common = both.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).cast("long").alias("n"), (F.size("of_a") + F.size("of_b")).cast("long").alias("m"))
    return common.filter(F.col("n") * 100 >= (F.col("m") - F.col("n")) * percent).select("a", "b")


class _Links:
    """The links confirmed so far (`found`, None before the first look); no pair is compared twice."""

    def __init__(self, docs: DataFrame, written, percent: int, size: int):
        self.docs, self.written, self.percent, self.size = docs, written, percent, size
        self.found = self.grams = self.tried = None

    def confirm(self, pairs: DataFrame) -> None:
        """Compare the pairs (a, a_size, b, b_size) whose sizes allow a link on the full sets."""
        small, large = F.least("a_size", "b_size"), F.greatest("a_size", "b_size")
        pairs = pairs.filter(small * 100 >= large * self.percent).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = self.written(pairs, "pairs")
        self.read(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct())
        if self.grams is None:
            return
        found = self.written(confirmed(pairs, self.grams, self.percent), "confirmed")
        self.found = found if self.found is None else self.found.union(found)
        self.tried = pairs if self.tried is None else self.tried.union(pairs)

    def read(self, needed: DataFrame) -> None:
        """The full sets of these ids, if they have not been read yet."""
        if self.grams is not None:
            needed = needed.join(self.grams.select("id"), "id", "left_anti")
        needed = self.written(needed, "needed")
        if needed.take(1):
            more = self.written(shingle_sets(self.docs.join(needed, "id", "left_semi"), self.size), "grams")
            self.grams = more if self.grams is None else self.grams.union(more)


def _reach(n: Column, other: Column, percent: int) -> Column:
    """Shingles that sets of these sizes have in common at least, if they are linked."""
    both = F.ceil((n + other) * percent / (100 + percent) - 1e-6)
    return F.greatest(both, F.ceil(n * percent / 100 - 1e-6), F.ceil(other * percent / 100 - 1e-6))


def _rest(members: DataFrame, links: _Links, written, percent: int) -> None:
    """All links between documents of different groups that share a bucket (and whatever others are found on the way), exactly.

    Such a pair can only have shingles in common that documents of two groups hold (`bridges`). A document with too few of
    them is linked with no other group and goes; that may take bridges from others, so it is looked at again. What is left
    orders its shingles, those that are no bridges first, then the rarest, and stands under those of its first shingles of
    which a linked pair must share one: the more alike the sizes of the two, the fewer, so sizes are cut into blocks and each
    pair of blocks has its own. Members of a family of copies agree on shingles that come late in this order, so their pairs
    are not made; those that are made could still be linked by the places of the shingles they share.
    """
    groups = components(links.found, written) if links.found is not None else None
    named = members.withColumn("label", F.col("id"))
    if groups is not None:
        named = members.join(groups, members["id"] == groups["node"], "left").select(*members.columns, F.coalesce("component", "id").alias("label"))
    named = written(named, "named")
    mixed_up = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("bucket")
    left = written(named.join(mixed_up, "bucket", "left_semi").select("id", "n_shingles", "label").distinct(), "mixed")
    if not left.take(1):
        return
    links.read(left.select("id"))
    held = left.join(links.grams, "id").select("id", "label", F.col("n_shingles").alias("n"), F.explode("grams").alias("gram"))
    before = None
    while True:
        bridges = held.groupBy("gram").agg(F.count("*").alias("df"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("gram", "df")
        held = written(held.select("id", "label", "n", "gram").join(bridges, "gram"), "bridges")
        enough = held.groupBy("id").agg(F.count("*").alias("b"), F.first("n").alias("m")).filter(F.col("b") * 100 >= F.col("m") * percent).select("id", "b")
        held = held.join(enough, "id")
        now = enough.count()
        if before is not None and now * 10 > before * 9:
            break
        before = now
    if not now:
        return
    order = Window.partitionBy("id").orderBy("df", "gram")
    placed = held.withColumn("place", F.col("n") - F.col("b") + F.row_number().over(order) - 1)
    block = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(BLOCK)) + 1e-9).cast("int")
    wide = math.ceil(math.log(100 / percent) / math.log(BLOCK)) + 1
    placed = placed.filter(F.col("n") - F.col("place") >= F.ceil(F.col("n") * percent / 100 - 1e-6)).withColumn("own", block)
    placed = placed.withColumn("other", F.explode(F.sequence(F.col("own") - wide, F.col("own") + wide)))
    least = F.floor(F.pow(F.lit(BLOCK), F.col("other"))) - 1  # no set of that block is smaller
    most = F.ceil(F.pow(F.lit(BLOCK), F.col("other") + 1)) + 1
    fits = (least * percent <= F.col("n") * 100) & (most * 100 >= F.col("n") * percent)
    stand = placed.filter(fits & (F.col("n") - F.col("place") >= _reach(F.col("n"), F.greatest(least, F.lit(1)), percent)))
    stand = written(stand.select("gram", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "label", "n", "place"), "prefixes")
    a = stand.filter("own = x").select("gram", "x", "y", F.col("id").alias("a"), F.col("label").alias("a_label"), F.col("n").alias("a_size"), F.col("place").alias("a_place"))
    b = stand.filter("own = y").select("gram", "x", "y", F.col("id").alias("b"), F.col("label").alias("b_label"), F.col("n").alias("b_size"), F.col("place").alias("b_place"))
    need = _reach(F.col("a_size"), F.col("b_size"), percent)
    possible = (F.col("a_label") != F.col("b_label")) & ((F.col("x") < F.col("y")) | (F.col("a") < F.col("b"))) & (F.col("a_size") - F.col("a_place") >= need) & (F.col("b_size") - F.col("b_place") >= need)
    links.confirm(a.join(b, ["gram", "x", "y"]).filter(possible).select("a", "a_size", "b", "b_size"))


def near_duplicates(
    docs: DataFrame, written, percent: int = 75, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, rounds: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, n_shingles, component_id (the smallest id reachable over links, itself included), kept (id = component_id).

    Linked are documents whose sets have at least `percent` of their union in common. A document without words has an empty
    set and is linked with nothing. Repeated rows are one document, and so are rows of one id with different texts; a null id
    is linked with nothing, its component_id is null and it is kept. Other columns are ignored; an empty table gives an empty
    result. `written` stores what several steps read.
    """
    sketch = written(sketches(docs, id_col, text_col, size, bands, rows), "sketches")
    real = sketch.filter("id is not null and n_shingles > 0")
    group = ["n_shingles", "d1", "d2"]
    # equal sets: the smallest id stands for all; only groups of several are joined back
    heads = written(real.groupBy(*group).agg(F.min("id").alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n"), "heads")
    headed = real.select("id", *group, "buckets").join(heads, group, "left")
    met = headed.filter("head is null or head = id").select("id", "n_shingles", F.explode("buckets").alias("bucket"))

    # what meets somebody at all, and how many it meets over all its buckets
    several = met.groupBy("bucket").agg(F.count("*").alias("crowd"), F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").drop("low", "high")
    crowd = written(met.join(several, "bucket"), "crowds")
    star = written(crowd.join(crowd.groupBy("id").agg(F.sum("crowd").alias("meets")), "id").select("bucket", "id", "n_shingles", "meets"), "members")

    links = _Links(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), written, percent, size)
    members = star.select("bucket", "id", "n_shingles")
    for _ in range(rounds):
        most = F.struct("meets", "id")
        drawn = (F.max_by("id", most).alias("a"), F.max_by("n_shingles", most).alias("a_size"), F.min("id").alias("low"), F.max("id").alias("high"))
        centres = written(star.groupBy("bucket").agg(*drawn).filter("low < high").drop("low", "high"), "centres")
        if not centres.take(1):
            break
        star = written(star.join(centres, "bucket").filter("id != a"), "stars")
        links.confirm(star.select("a", "a_size", F.col("id").alias("b"), F.col("n_shingles").alias("b_size")))
        if links.found is None:
            break
        near = links.found.union(links.found.select(F.col("b").alias("a"), F.col("a").alias("b"))).select("a", F.col("b").alias("id"))
        star = star.join(near, ["a", "id"], "left_anti").select("bucket", "id", "n_shingles", "meets")
    _rest(members, links, written, percent)
    linked = links.found

    ids = sketch.select("id", *group).join(heads, group, "left").select("id", "n_shingles", F.coalesce("head", "id").alias("head"))
    if linked is not None:
        found = components(linked, written)
        ids = ids.join(found, ids["head"] == found["node"], "left").select("id", "n_shingles", F.coalesce("component", "head").alias("component_id"))
    else:
        ids = ids.withColumnRenamed("head", "component_id")
    one = F.when((F.col("n_shingles") > 0) & F.col("id").isNotNull(), F.col("component_id")).otherwise(F.col("id"))
    out = ids.select(F.col("id").alias(id_col), "n_shingles", one.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
