"""Scoring by cross-entropy difference: each document's loss per token under a model of the wanted text and under a model of
all text, over one vocabulary; the difference is its score (lower: more like the wanted text).

Both models are bigram models with the same smoothing, matched in everything but their text: counts of (word, next word) and
of words, and p(w | v) = (c(v, w) + strength * p(w)) / (c(v) + strength), p(w) = (c(w) + 1) / (N + V). The background's
counts are scaled to the target's number of tokens, so that neither is smoothed more for having seen less.

The vocabulary is every word of the corpus, and every pair of neighbours has a count of its own: both grow with the input,
so no task and no driver holds them. Texts are cut into words once and stored in blocks of about `block_tokens` tokens, as
numbers into the block's own word list. A block asks once for each word and pair it has, with its own counts; Spark brings
what was asked for to shards by hash, where the counts of all blocks are added up, and brings the answers back to the blocks.
So a pair that every document has is one number per block, not per document, and a shard's size does not depend on how
frequent its pairs are. Words are known by 64-bit hashes, pairs and words in a shard by 48 bits: with 2 million keys in a
shard one key in 10^8 shares its counts with another, however many shards there are.
"""

from __future__ import annotations

import itertools
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import cut, mixed, texts

WORD = re.compile(r"\w+|[^\w\s]")
#: The mark before and after each document; no word is a line break.
END = "\n"
def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def packed(numbers: np.ndarray, small: type) -> bytes:
    """Whole numbers from 0, most of them small: all in the type `small`, then those it does not hold in full."""
    most = np.iinfo(small).max
    low = np.minimum(numbers, most).astype(small)
    return low.tobytes() + numbers[low == most].astype(np.int64).tobytes()


def unpacked(data: bytes, n: int, small: type) -> np.ndarray:
    low = np.frombuffer(data, small, n)
    out = low.astype(np.int64)
    out[low == np.iinfo(small).max] = np.frombuffer(data[low.nbytes :], np.int64)
    return out


def blocks(rows: DataFrame, block_tokens: int) -> DataFrame:
    """Rows (id, text, wanted) as blocks: block, ids, n_tokens (end marks too), and as bytes the documents' lengths and wanted
    flags, the hashes of the block's words (the last is the end mark's) and the documents' tokens as places among them."""
    id_type = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        found: list[np.ndarray] = []
        ids: list = []
        wanted: list[bool] = []

        def out(kind: pa.DataType) -> pa.RecordBatch:
            lengths = np.array([len(t) for t in found], np.int64)
            tokens = np.concatenate(found) if found else np.empty(0, np.int32)
            words = np.fromiter(map(_hash, [*places, END]), np.uint64, len(places) + 1)
            columns = [[uuid.uuid4().int >> 65], [ids], [int(lengths.sum()) + len(ids)], [lengths.tobytes()], [np.array(wanted, np.bool_).tobytes()], [words.tobytes()], [zstandard.compress(packed(tokens, np.uint16))]]
            kinds = [pa.int64(), pa.list_(kind), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["block", "ids", "n_tokens", "lengths", "wanted", "words", "tokens"])

        size, kind = 0, None
        for batch in cut(batches):
            kind = batch.column(0).type
            for one, text, mark in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                some = WORD.findall(text.lower())
                found.append(np.fromiter(map(places.__getitem__, some), np.int32, len(some)))
                ids.append(one)
                wanted.append(mark)
                size += len(some) + 1
                if size >= block_tokens:
                    yield out(kind)
                    places = defaultdict(itertools.count().__next__)
                    found, ids, wanted, size = [], [], [], 0
        if ids:
            yield out(kind)

    schema = f"block long, ids array<{id_type.simpleString()}>, n_tokens long, lengths binary, wanted binary, words binary, tokens binary"
    return rows.select("id", "text", "wanted").mapInArrow(run, schema)


class Block:
    """A block's neighbours: of each token the word before it, its document and its pair, and the keys of all pairs and words.

    A key is a shard, which is its hash's upper half scaled to their number, and the hash's lower 48 bits; `order` sorts by both.
    """

    def __init__(self, row: dict, shards: int):
        lengths, words = np.frombuffer(row["lengths"], np.int64) + 1, np.frombuffer(row["words"], np.uint64)
        self.wanted = np.frombuffer(row["wanted"], np.bool_)
        self.end = len(words) - 1
        self.docs = np.repeat(np.arange(len(lengths)), lengths)
        self.word = np.full(len(self.docs), self.end, np.int64)
        inside = np.ones(len(self.docs), bool)
        inside[np.cumsum(lengths) - 1] = False
        self.word[inside] = unpacked(zstandard.decompress(row["tokens"]), len(self.docs) - len(lengths), np.uint16)
        self.before = np.concatenate([[self.end], self.word[:-1]])
        codes, self.pair = np.unique(self.before * len(words) + self.word, return_inverse=True)
        self.pairs = len(codes)
        # pairs have even keys, words odd ones
        two = mixed(words[codes // len(words)] ^ mixed(words[codes % len(words)] + np.uint64(0x9E3779B97F4A7C15))) & ~np.uint64(1)
        hashes = np.concatenate([two, mixed(words) | np.uint64(1)])
        shard, key = (hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), hashes & np.uint64((1 << 48) - 1)
        self.order = np.lexsort((key, shard))
        self.shard, self.key = shard[self.order].astype(np.int64), key[self.order]

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """By key, in order: how often here, and how often in wanted documents."""
        marked = self.wanted[self.docs]
        both = []
        for some in (slice(None), marked):
            pairs, words = np.bincount(self.pair[some], minlength=self.pairs), np.bincount(self.word[some], minlength=self.end + 1)
            both.append(np.concatenate([pairs, words])[self.order])
        return both[0], both[1]

    def spans(self) -> list[tuple[int, slice]]:
        """The shards that have keys of the block, and where."""
        found, first = np.unique(self.shard, return_index=True)
        return [(int(k), slice(a, b)) for k, a, b in zip(found, first, [*first[1:], len(self.shard)], strict=True)]

    def within(self, cells: np.ndarray, asked: np.ndarray, width: int) -> np.ndarray:
        """Of each token: how often its own document has `asked`, where its tokens have `cells`."""
        have, counts = np.unique(self.docs * width + cells, return_counts=True)
        want = self.docs * width + asked
        at = np.minimum(np.searchsorted(have, want), len(have) - 1)
        return np.where(have[at] == want, counts[at], 0)


def asked(stored: DataFrame, shards: int) -> DataFrame:
    """Per block and shard: the keys the block has there, as steps from one to the next, with its own counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in cut(batches, 1):
            row = batch.to_pylist()[0]
            block = Block(row, shards)
            own = block.own()
            spans = block.spans()
            for at in range(0, len(spans), 1000):
                some = spans[at : at + 1000]
                steps = [np.diff(block.key[s], prepend=np.uint64(0)) for _, s in some]
                columns = [pa.array([k for k, _ in some], pa.int64()), pa.array([row["block"]] * len(some), pa.int64())]
                columns += [pa.array([x.astype(np.uint32).tobytes() for x in steps], pa.binary()), pa.array([packed(x >> np.uint64(32), np.uint8) for x in steps], pa.binary())]
                columns += [pa.array([packed(x[s], np.uint8) for _, s in some], pa.binary()) for x in own]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "block", "low", "high", "n", "n_wanted"])

    narrow = stored.select("block", "lengths", "wanted", "words", "tokens")
    return narrow.mapInArrow(run, "shard long, block long, low binary, high binary, n binary, n_wanted binary")


def _added(group: pa.Table) -> pa.Table:
    """Of one shard: what each block asked for, summed over all other blocks; the first row also has the number of distinct words."""
    rows = group.to_pylist()
    sizes = [len(r["low"]) // 4 for r in rows]
    steps = ((unpacked(r["high"], n, np.uint8) << 32) + np.frombuffer(r["low"], np.uint32) for r, n in zip(rows, sizes, strict=True))
    found, place = np.unique(np.concatenate([np.cumsum(x) for x in steps]), return_inverse=True)
    at = np.concatenate([[0], np.cumsum(sizes)])
    columns = {"block": pa.array([r["block"] for r in rows], pa.int64()), "shard": pa.array([r["shard"] for r in rows], pa.int64())}
    for name, answer in (("n", "others"), ("n_wanted", "others_wanted")):
        own = np.concatenate([unpacked(r[name], n, np.uint8) for r, n in zip(rows, sizes, strict=True)])
        others = np.bincount(place, own, len(found)).astype(np.int64)[place] - own
        columns[answer] = pa.array([packed(others[at[k] : at[k + 1]], np.uint8) for k in range(len(rows))], pa.binary())
    columns["n_words"] = pa.array([int((found & 1).sum()), *[0] * (len(rows) - 1)], pa.int64())
    return pa.table(columns)


ANSWERS = "block long, shard long, others binary, others_wanted binary, n_words long"


def _every(block: Block, answers: list[dict]) -> list[np.ndarray]:
    """Counts over all documents and over the wanted ones, in the order of the block's keys."""
    spans = block.spans()
    assert [k for k, _ in spans] == [r["shard"] for r in answers]
    out = []
    for own, name in zip(block.own(), ("others", "others_wanted"), strict=True):
        out.append(own + np.concatenate([unpacked(r[name], s.stop - s.start, np.uint8) for r, (_, s) in zip(answers, spans, strict=True)]))
    return out


def _losses(block: Block, every: np.ndarray, own: bool, scale: float, n_tokens: int, n_words: int, strength: float) -> np.ndarray:
    """Per document nats of all its tokens by counts `every` (in the order of keys), less its own: those of all documents, or of the wanted."""
    counts = np.empty(len(every), np.int64)
    counts[block.order] = every
    two, one = counts[: block.pairs], counts[block.pairs :]
    less = np.ones(len(block.wanted), bool) if own else block.wanted
    here = less[block.docs]
    tokens = n_tokens - np.where(less, np.bincount(block.docs, minlength=len(less)), 0)
    pair = two[block.pair] - here * block.within(block.pair, block.pair, block.pairs)
    word = one[block.word] - here * block.within(block.word, block.word, block.end + 1)
    context = one[block.before] - here * block.within(block.word, block.before, block.end + 1)
    alone = (word * scale + 1) / (tokens[block.docs] * scale + n_words)
    return np.bincount(block.docs, -np.log((pair * scale + strength * alone) / (context * scale + strength)), len(less))


def score(
    docs: DataFrame, wanted: DataFrame, written, strength: float = 50.0, block_tokens: int = 1_000_000, shard_keys: int = 2_000_000, most_broadcast: int = 500_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, n_tokens (words, punctuation marks and the end), loss_target, loss_background and score, their difference, per token.

    `wanted` has the ids of the documents the target model learns from; the background learns from all. A document is scored
    by counts from which its own are taken away, wherever it was counted, so it does not vouch for itself. A null or empty text
    is one token, the end. Repeated rows stay and count each; rows with a null id are never wanted; other columns are ignored;
    an empty table gives an empty result. Without wanted documents the target model is uniform. A block has at least one
    document, so a task needs room for `block_tokens` tokens or the longest text. A shard has about `shard_keys` keys at most,
    those that several blocks ask for counted each time. `written` stores the wanted ids, the blocks and the summed counts.
    """
    mark = written(wanted.select(F.col(id_col).alias("id")).dropna().distinct().withColumn("wanted", F.lit(True)), "wanted")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if mark.count() <= most_broadcast:  # a short list spares the texts a shuffle
        rows = rows.join(F.broadcast(mark), "id", "left").select("id", "text", F.coalesce("wanted", F.lit(False)).alias("wanted"))
    else:  # rows without an id match nothing and would all go to one task
        named = rows.dropna(subset=["id"]).join(mark, "id", "left").select("id", "text", F.coalesce("wanted", F.lit(False)).alias("wanted"))
        rows = named.union(rows.filter("id is null").withColumn("wanted", F.lit(False)))
    stored = written(blocks(rows, block_tokens), "blocks")
    n_all = stored.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    shards = 1 + 2 * n_all // shard_keys  # a token is a pair and a word at most
    answers = written(asked(stored, shards).groupBy("shard").applyInArrow(_added, ANSWERS), "counts")
    n_words = answers.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    n_wanted = _wanted_tokens(stored)
    scale = max(1, n_wanted) / max(1, n_all)
    names = [id_col, "n_tokens", "loss_target", "loss_background", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block = Block(row, shards)
        every = _every(block, sorted(right.to_pylist(), key=lambda r: r["shard"]))
        target = _losses(block, every[1], False, 1.0, n_wanted, n_words, strength)
        background = _losses(block, every[0], True, scale, n_all, n_words, strength)
        n = np.bincount(block.docs, minlength=len(block.wanted))
        ids = left.column("ids").combine_chunks().flatten()
        return pa.Table.from_arrays([ids, pa.array(n, pa.int64()), *(pa.array(x) for x in (target / n, background / n, target / n - background / n))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    both = stored.groupBy("block").cogroup(answers.groupBy("block"))
    return both.applyInArrow(run, f"`{id_col}` {kind}, n_tokens long, loss_target double, loss_background double, score double")


def _wanted_tokens(stored: DataFrame) -> int:
    """Tokens of the wanted documents, end marks too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int((np.frombuffer(r["lengths"], np.int64) + 1)[np.frombuffer(r["wanted"], np.bool_)].sum()) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64())], ["n"])

    return stored.select("lengths", "wanted").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
