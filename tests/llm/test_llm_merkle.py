"""The Merkle manifest against a plain tree, and edge cases."""

from __future__ import annotations

import collections
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from cohortloom.llm import merkle
from cohortloom.llm.common import ship, table, written
from cohortloom.llm.queries import QUERIES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, total int, by string, node string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """The root and, per leaf, (digit, run) from the leaf upwards."""
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [nodes[k : k + 3] for k in range(0, len(nodes), 3)]
        for k, run in enumerate(runs):
            for digit in range(len(run)):
                for i in under[3 * k + digit]:
                    paths[i].append((digit, run))
        under = [sum(under[k : k + 3], []) for k in range(0, len(under), 3)]
        nodes = [digest(*run) for run in runs]
    return nodes[0], paths


def low(value):
    return (value is not None, value if value is not None else 0)


def plain_manifest(rows, changed):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r["source"]].append((low(r["doc_id"]), leaf_of(r, r["text"]), leaf_of(r, changed(r)), r["doc_id"]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[1] for x in sorted(groups[s], key=lambda x: x[:2])]) for s in names}
    root, above = plain_tree([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        for (_, leaf, again, doc_id), path in zip(sorted(groups[s], key=lambda x: x[:2]), trees[s][1], strict=True):
            siblings, node = [], again
            for digit, run in path + up:
                siblings += run[:digit] + run[digit + 1 :]
                node = digest(*run[:digit], node, *run[digit + 1 :])
            out.append((doc_id, leaf, trees[s][0], root, digest(*siblings), node, node == root))
    return sorted(out, key=lambda x: (low(x[0]), x[1:]))


def without_breaks(row):
    even = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0
    return row["text"].replace("\n", "") if even and row["text"] is not None else row["text"]


def broken():
    return F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(2)) == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))


def check(frame, got):
    expected = plain_manifest([r.asDict() for r in frame.collect()], without_breaks)
    assert sorted((tuple(r) for r in got.collect()), key=lambda x: (low(x[0]), x[1:])) == expected


def test_query_equals_a_plain_tree(spark):
    check(table(spark, "/root/testdata/sf0.001", "documents"), QUERIES["op13_merkle_manifest"](spark, "/root/testdata/sf0.001"))


def test_nulls_repeats_long_texts_and_clashing_names(spark):
    texts = [None, "", "a\nb", "ü\n\n" * 3, "x\n" * 500_000, "same", "same"]
    rows = [(k, s, None if k % 2 else "en", k, t, "z", 1, "b", "n") for k, t in enumerate(texts) for s in (None, "", "s", "š")]
    rows += [(3, "s", "en", 3, "other", "z", 1, "b", "n"), (3, "s", "en", 3, "other", "z", 1, "b", "n"), (None, None, None, None, None, None, None, None, None), (None, "s", "en", 1, "p\nq", "z", 1, "b", "n")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    check(docs, merkle.verified_manifest(docs, written, broken()))


def test_groups_of_few_leaves_and_one_leaf_in_all(spark):
    sizes = [1, 2, 3, 4, 9, 10, 27, 28]
    docs = spark.createDataFrame([(k, f"s{n}", "en", k, f"t\n{k}", "z", 1, "b", "n") for n in sizes for k in range(n)], SCHEMA)
    check(docs, merkle.verified_manifest(docs, written, broken()))
    one = docs.filter("source = 's1'")
    check(one, merkle.verified_manifest(one, written, broken()))


def test_a_group_of_many_blocks(spark):
    ids = spark.range(2_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).when(F.col("id") % 3 > 0, "hot").alias("source"))
    docs = ids.withColumns({"lang": F.lit("en"), "n_chars": F.lit(1), "text": F.concat(F.lit("t\n"), F.col("doc_id").cast("string"))})
    check(docs, merkle.verified_manifest(docs, written, broken()))


def test_no_rows(spark):
    docs = spark.createDataFrame([], SCHEMA)
    got = merkle.verified_manifest(docs, written, broken())
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] and got.count() == 0


def test_records_lead_from_the_root_to_every_leaf():
    leaves = [digest(str(k)) for k in range(100)]
    root, records = merkle.grown(leaves, merkle.height(100))
    expected, paths = plain_tree(leaves)
    assert root == expected
    for place, leaf in enumerate(leaves):
        node, path = merkle.way_down(root, dict(records), place, merkle.height(100))
        assert node == leaf and path == [str(digit) + "".join(run[:digit] + run[digit + 1 :]) for digit, run in paths[place]]


def test_paths_are_returned_whole(spark):
    rows = spark.range(50).select(F.lit("s").alias("source"), F.col("id").alias("doc_id"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    got = merkle.proofs(rows, written).orderBy("doc_id").collect()
    _, paths = plain_tree([digest(str(k)) for k in range(50)])
    assert [r.path for r in got] == [[str(d) + "".join(run[:d] + run[d + 1 :]) for d, run in p] for p in paths]
