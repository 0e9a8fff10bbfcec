"""Cross-tokenizer alignment against a byte-by-byte version, and edge cases."""

from __future__ import annotations

import collections
import hashlib
import sys

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortloom.llm import align
from cohortloom.llm.common import ship, table, written
from cohortloom.llm.queries import PIECES, QUERIES, TOKENIZER

SCHEMA = "doc_id long, text string, codes int, times string, row int, id string, code long, docs int, best string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="module")
def libraries():
    left = Tokenizer.from_file(TOKENIZER)
    left.encode_special_tokens = True
    return left, sentencepiece.SentencePieceProcessor(model_file=PIECES)


VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
HIDDEN = [b for b in range(256) if b not in VISIBLE]


def byte_of(char):
    return ord(char) if ord(char) in VISIBLE else HIDDEN[ord(char) - 256]


def plain(libraries, text):
    """(ids of A, of B, groups as (list, list), links) by comparing every byte's owner."""
    left, right = libraries
    if not text:
        return None
    enc = left.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(byte_of(c) for c in t)) for i, t in zip(enc.ids, enc.tokens)]
    b = []
    for i in right.encode(text):
        piece = right.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if right.is_byte(i) else piece.replace("▁", " ").encode()))
    data = (" " + text).encode()
    if b"".join(x for _, x in a) != data or b"".join(x for _, x in b) != data:
        return None
    owner_a = [k for k, (_, x) in enumerate(a) for _ in x]
    owner_b = [k for k, (_, x) in enumerate(b) for _ in x]
    links = sorted(set(zip(owner_a, owner_b)))
    groups, one_a, one_b = [], [], []
    for at in range(len(data)):
        one_a += [owner_a[at]] * (owner_a[at] not in one_a)
        one_b += [owner_b[at]] * (owner_b[at] not in one_b)
        if at + 1 == len(data) or (owner_a[at + 1] != owner_a[at] and owner_b[at + 1] != owner_b[at]):
            groups.append(",".join(str(a[k][0]) for k in one_a) + "|" + ",".join(str(b[k][0]) for k in one_b))
            one_a, one_b = [], []
    return len(a), len(b), groups, [(a[x][0], b[y][0]) for x, y in links]


def expected(libraries, rows):
    found = [(i, plain(libraries, t)) for i, t in rows]
    docs = collections.Counter(pair for _, x in found if x for pair in set(x[3]))
    most = collections.defaultdict(int)
    for (a, _), n in docs.items():
        most[a] = max(most[a], n)
    out = []
    for i, x in found:
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = x
            digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
            out.append((i, n_a, n_b, len(groups), len(links), sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links), digest))
    return sorted(out, key=str)


def test_query_equals_a_byte_by_byte_version(spark, libraries):
    rows = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").collect()]
    got = QUERIES["op12_alignment"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    want = expected(libraries, rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sum(w[1] > 0 for w in want) > 0.5 * len(want)


@pytest.mark.parametrize("most", [4, 1000])
def test_edge_cases_whatever_is_sent_to_the_tasks(spark, libraries, most):
    texts = [None, "", " ", "a", "a", "<|endoftext|> <s></s> <unk>", "ﬁne é Å", "wörld ☃ 東京 \U0001f600", "tab\there\n\n\nthere", "▁ mark", "  two  spaces ", "\x00\x01", "internationalisation " * 800, "x" * 500]
    rows = [(k, t, 1, "t", 2, "i", 3, 4, "b") for k, t in enumerate(texts)] + [(3, "a", 1, "t", 2, "i", 3, 4, "b"), (None, "a b c", 1, "t", 2, "i", 3, 4, "b")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = align.scored(docs, TOKENIZER, PIECES, written, most)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(libraries, [(r[0], r[1]) for r in rows])


def test_no_rows(spark):
    assert align.scored(spark.createDataFrame([], SCHEMA), TOKENIZER, PIECES, written).count() == 0


def test_groups_and_pairs_are_returned(spark, libraries):
    docs = spark.createDataFrame([(1, "Hello wörld, hello there")], "doc_id long, text string")
    row = align.alignments(docs, TOKENIZER, PIECES).first()
    _, _, groups, links = plain(libraries, "Hello wörld, hello there")
    counted = collections.Counter(a * align.BASE + b for a, b in links)
    assert row.groups == ";".join(groups) and dict(zip(row.codes, row.times)) == counted


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeiou nrst<>|\n\t"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_random_texts(libraries, text):
    pair = align.aligner(TOKENIZER, PIECES)
    if not text:
        return
    n_a, n_b, n, said, links = pair.one(text, pair.left.encode([text])[0], pair.right.encode([text])[0])
    want = plain(libraries, text)
    if want is None:
        assert (n_a, n_b, n, said, len(links)) == (0, 0, 0, "", 0)
    else:
        assert (n_a, n_b, said) == (want[0], want[1], ";".join(want[2])) and n == len(want[2])
        assert sorted(links.tolist()) == sorted(a * align.BASE + b for a, b in want[3])


def test_links_are_found_in_whole_columns():
    pair = align.aligner(TOKENIZER, PIECES)

    def calls(text):
        ids = pair.left.encode([text])[0], pair.right.encode([text])[0]
        seen = []
        sys.setprofile(lambda frame, event, arg: seen.append(frame.f_code.co_filename == align.__file__) if event == "call" else None)
        try:
            links = pair.one(text, *ids)[4]
        finally:
            sys.setprofile(None)
        return sum(seen), len(links)

    some, many = calls("unbelievableness bioluminescence " * 20), calls("unbelievableness bioluminescence " * 400)
    assert many[1] > 15 * some[1] and many[0] == some[0]


def test_counts_sent_to_the_tasks_stay_under_the_bound(spark):
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    counts = align.pair_counts(align.alignments(rows, TOKENIZER, PIECES)).collect()
    cases = sum(r.docs for r in counts)
    assert sum(r.docs * 7 > cases for r in counts) < 7 and any(r.docs == 300 and r.best for r in counts)
