"""Alignment of two tokenizers' tokens over one text, and how often their ids are linked in a corpus.

Both tokenizers' tokens are byte strings that make up the same text. The ends of both, merged in order, cut it into stretches; in
each lies one token of A and one of B, and every pair of tokens whose byte ranges overlap, a link, shares exactly one stretch. The
ends that both have cut both lists into groups, the smallest pieces of text that both tokenizers end.

Corpus counts are a Spark aggregation over the distinct id pairs of each text. Scoring joins them back: pairs in more than one
in `most` of all rows, which are fewer than `most` by count, are sent to the tasks; the others are joined by a shuffle, in
which no pair can be hot.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortloom.llm import bpe
from cohortloom.llm.common import cut


#: The parts of a file whose ids byte-pair merging by rank gives too.
PLAIN = {"normalizer": None, "post_processor": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}}


class Spelling:
    """A tokenizer whose tokens are byte strings: `pieces`, None where a token is no spelling of bytes."""

    pieces: list[bytes | None]

    def spells(self, ids: list[int], data: bytes) -> bool:
        """Whether the tokens' bytes make up `data`."""
        try:
            return b"".join(map(self.pieces.__getitem__, ids)) == data
        except (TypeError, IndexError):  # a control token, or one that the vocabulary lacks
            return False


class ByteLevel(Spelling):
    """A byte-level BPE file; special strings in a text are ordinary text. The text gets a space in front.

    Where the file says that its ids are those of merging by rank, and the text's characters are the same in every Unicode
    version, merging by rank gives them, without the offsets that the file's library keeps.
    """

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        parts = json.loads(self.library.to_str())
        rank = bpe.encoder(path).by_rank if all(parts[k] == v for k, v in PLAIN.items()) else None
        self.by_rank = rank.encode_ordinary if rank else None
        spelt = bpe.encoder(path).tokens
        self.pieces: list[bytes | None] = [None] * (max(spelt.values(), default=-1) + 1)
        for piece, token in spelt.items():
            self.pieces[token] = piece

    def encode(self, texts: list[str]) -> list[list[int]]:
        spaced = [" " + t for t in texts]
        slow = [k for k, t in enumerate(spaced) if not self.by_rank or not bpe.STABLE.match(t)]
        ids = {k: e.ids for k, e in zip(slow, self.library.encode_batch_fast([spaced[k] for k in slow], add_special_tokens=False), strict=True)}
        return [ids[k] if k in ids else self.by_rank(t) for k, t in enumerate(spaced)]


class Pieces(Spelling):
    """A sentencepiece model with byte fallback, which itself puts a space in front."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: list[bytes | None] = [self._bytes(k) for k in range(self.library.get_piece_size())]

    def _bytes(self, token: int) -> bytes | None:
        piece = self.library.id_to_piece(token)
        if self.library.is_byte(token):
            return bytes([int(piece[3:5], 16)])
        if self.library.is_control(token) or self.library.is_unknown(token):
            return None
        return piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.library.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=4)
def loaded(kind: type, path: str):
    """One for each worker process and file. A task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return kind(path)


def links(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places in A and in B of all overlapping pairs, in order, and after which of them a group ends.

    Between two neighbouring ends of either side lies one token of A and one of B, and each overlap is one such stretch.
    """
    size = max(ends_a[-1], ends_b[-1]) + 1
    marked_a, marked_b = np.zeros(size, bool), np.zeros(size, bool)
    marked_a[ends_a] = marked_b[ends_b] = True
    ends = np.flatnonzero(marked_a | marked_b)
    in_a, in_b = marked_a[ends], marked_b[ends]
    return in_a.cumsum() - in_a, in_b.cumsum() - in_b, in_a & in_b


BASE = 1 << 24
NOTHING = 0, 0, 0, "", np.empty(0, np.int64)


class Aligner:
    def __init__(self, left: ByteLevel, right: Pieces):
        self.left, self.right = left, right
        # each id's decimal with the mark that follows it inside a group and at the end of its side
        self.names = [f"{k}{mark}" for side, end in ((left, "|"), (right, ";")) for k in range(len(side.pieces)) for mark in (",", end)]
        self.first_b = 2 * len(left.pieces)
        self.sizes_a, self.sizes_b = (np.array([len(p or b"") for p in side.pieces], np.int64) for side in (left, right))

    def one(self, text: str, ids_a: list[int], ids_b: list[int]) -> tuple[int, int, int, str, np.ndarray]:
        """(tokens of A, of B, groups, the groups as text, a code a * BASE + b per link)."""
        data = (" " + text).encode()
        if not self.left.spells(ids_a, data) or not self.right.spells(ids_b, data):
            return NOTHING
        a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
        at_a, at_b, last = links(self.sizes_a[a].cumsum(), self.sizes_b[b].cumsum())
        to_a, to_b = at_a[last] + 1, at_b[last] + 1
        return len(a), len(b), len(to_a), self._text(a, b, to_a, to_b), a[at_a] * BASE + b[at_b]

    def _text(self, a: np.ndarray, b: np.ndarray, to_a: np.ndarray, to_b: np.ndarray) -> str:
        """In each group A's tokens and then B's: a token stands after all those of the other side's groups before its own."""
        sizes_a, sizes_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
        place_a = np.arange(len(a)) + np.repeat(to_b - sizes_b, sizes_a)
        place_b = np.arange(len(b)) + np.repeat(to_a, sizes_b)
        name_a, name_b = a * 2, b * 2
        name_a[to_a - 1] += 1
        name_b[to_b - 1] += 1
        names = np.empty(len(a) + len(b), np.int64)
        names[place_a], names[place_b] = name_a, name_b + self.first_b
        return "".join(map(self.names.__getitem__, names.tolist()))[:-1]


@functools.lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    """One for each worker process and pair of files. A task has one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Aligner(ByteLevel(path_a), Pieces(path_b))


def alignments(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, groups (`a1,a2|b1;a3|b2,b3`), n_links, and the distinct linked id pairs with their numbers:
    codes (a * BASE + b, ascending) and times.

    A is a byte-level file of `tokenizers`, B a model of `sentencepiece`; both read the text after one space, without special
    tokens. A text that is null or empty, or that a tokenizer's tokens do not spell byte for byte (a normaliser changes it), has
    no tokens: zeros, an empty text, empty lists. Repeated rows and null ids stay; texts are read whole; other columns are ignored.
    """
    names = ["id", "n_a", "n_b", "n_groups", "groups", "n_links", "codes", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = aligner(path_a, path_b)
        for batch in cut(batches, 64):
            all_texts = [t or "" for t in batch.column(1).to_pylist()]
            some = [t for t in all_texts if t]
            ids = zip(pair.left.encode(some), pair.right.encode(some), strict=True)
            out: list[list] = [[] for _ in names[1:]]
            for text in all_texts:
                n_a, n_b, n, said, linked = pair.one(text, *next(ids)) if text else NOTHING
                codes, times = np.unique(linked, return_counts=True)
                for values, value in zip(out, (n_a, n_b, n, said, len(linked), codes, times.astype(np.int32)), strict=True):
                    values.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            plain = [pa.array(v, k) for v, k in zip(out[:-2], kinds, strict=True)]
            ends = np.cumsum([0, *map(len, out[-1])]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(ends, np.concatenate(v)) for v in out[-2:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *plain, *lists], names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_a long, n_b long, n_groups long, groups string, n_links long, codes array<long>, times array<int>")


def pair_counts(found: DataFrame) -> DataFrame:
    """(code, docs, best): in how many rows of `found` the pair is linked, and whether no pair of its A id is in more."""
    counts = found.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count("*").alias("docs"))
    highest = counts.groupBy((F.col("code") / BASE).cast("long").alias("a")).agg(F.max("docs").alias("most"))
    joined = counts.withColumn("a", (F.col("code") / BASE).cast("long")).join(highest, "a")
    return joined.select("code", "docs", (F.col("docs") == F.col("most")).alias("best"))


def scored(docs: DataFrame, path_a: str, path_b: str, written, most: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A pair's count is the number of rows of the corpus that hold it linked; count_sum adds it up over the row's links, n_best
    counts the links whose pair no other pair of the same A id exceeds. Rows without tokens have zeros and an empty digest.
    """
    found = alignments(docs, path_a, path_b, id_col, text_col)
    found = found.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "alignments")
    counts = written(pair_counts(found), "pairs")
    # fewer than `most` pairs can each be in more than one in `most` of all (row, pair) cases
    cases = counts.agg(F.sum("docs")).first()[0] or 0
    many = F.col("docs") * F.lit(most) > F.lit(cases)
    heavy = F.broadcast(counts.filter(many).withColumnsRenamed({"docs": "heavy_docs", "best": "heavy_best"}))
    rare = counts.filter(~many)
    each = found.select("row", F.explode(F.arrays_zip("codes", "times")).alias("x")).select("row", F.col("x.codes").alias("code"), F.col("x.times").alias("times"))
    each = each.join(heavy, "code", "left")
    sums = [F.sum(F.col("times") * F.col("docs")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")]
    of_heavy = each.filter("heavy_docs is not null").select("row", "times", F.col("heavy_docs").alias("docs"), F.col("heavy_best").alias("best")).groupBy("row").agg(*sums)
    of_rare = each.filter("heavy_docs is null").select("row", "code", "times").join(rare, "code").groupBy("row").agg(*sums)
    total = of_heavy.unionByName(of_rare).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    zero = {"count_sum": F.coalesce("count_sum", F.lit(0)), "n_best": F.coalesce("n_best", F.lit(0))}
    out = found.select("row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(total, "row", "left").withColumns(zero)
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
