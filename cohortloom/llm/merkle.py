"""A Merkle manifest of a dataset: per group a tree over its rows, over the groups a tree of their roots, and for every row the proof.

Every node is the SHA-256, in lowercase hex, of its children's digests as text; a run of three makes a node, and the last run of
a level may be shorter. A tree is as high as its number of leaves asks for; a lone leaf is its own root.

The tree is cut into blocks of up to 3 ** HEIGHT leaves. A block is built in one task from its leaves and stored as records,
digest to children, under the digest of its root; the roots of a tier of blocks are the leaves of the next one. A group of any
size is thus dealt over as many tasks as it has blocks, and 30 million rows need three tiers.

Requests go down from the root: at each record the next digit of the rank selects the child to go on with, the children not
selected are collected, and the segments of the path are reversed, so that a proof reads from the leaf to the root. All leaves
under a block share the way to it, so a tier's requests are one per block, joined with the stored records by place and digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ARITY, HEIGHT = 3, 6
BLOCK = ARITY**HEIGHT
RECORDS = "array<struct<digest:string,children:array<string>>>"


def digest(*values: Column) -> Column:
    """Of the values, each as `-` if null, else its bytes in UTF-8, a colon and itself; integers are decimal."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def of_children(children: Sequence[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def ranked(df: DataFrame, by: str, order: Sequence[str], written) -> DataFrame:
    """Adds `rank` (from 0) in the order of `order` among the rows of one `by`, and `total`, their number. Nulls come first.

    Rows are sorted over all tasks and numbered where they lie; only counts per (group, task) are added up, so a group may hold
    any share of the rows.
    """
    keys = [F.col(c).asc_nulls_first() for c in [by, *order]]
    lain = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the lower 33 bits of the id count the rows of a task, the upper ones are the task
    lain = written(lain.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)), "ranked")
    spans = lain.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_p")).agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy("_by")
    before = F.sum("_n").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("_by", "_p", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_move"), F.sum("_n").over(group).alias("total"))
    joined = lain.join(spans, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    return joined.select(*df.columns, (F.col("_id") + F.col("_move")).alias("rank"), "total")


def height(total: int) -> int:
    levels, reach = 0, 1
    while reach < total:
        levels, reach = levels + 1, reach * ARITY
    return levels


def grown(leaves: Sequence[str], levels: int) -> tuple[str, list[tuple[str, list[str]]]]:
    """The root of the leaves after so many levels, and its records."""
    records, level = [], list(leaves)
    for _ in range(levels):
        runs = [level[k : k + ARITY] for k in range(0, len(level), ARITY)]
        level = [of_children(run) for run in runs]
        records += zip(level, runs, strict=True)
    return level[0], records


def way_down(root: str, records: dict[str, list[str]], place: int, levels: int) -> tuple[str, list[str]]:
    """From the root to the leaf at `place`: the leaf's digest, and per level, from the leaf upwards, its digit and the others of its run."""
    node, segments = root, []
    for k in reversed(range(levels)):
        digit = place // ARITY**k % ARITY
        run = records[node]
        segments.append(str(digit) + "".join(run[:digit] + run[digit + 1 :]))
        node = run[digit]
    return node, segments[::-1]


def _tier(nodes: DataFrame, by: str, carried: Sequence[str], written) -> DataFrame:
    """One row per block of nodes (by, rank, total, node and the carried columns): its place, its root, its records, what it carries."""
    members = F.sort_array(F.collect_list(F.struct("rank", "node", *carried)))
    blocks = nodes.groupBy(by, F.floor(F.col("rank") / BLOCK).alias("block"), "total").agg(members.alias("members"))
    kind = nodes.schema[by].dataType.simpleString()
    inner = blocks.schema["members"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                levels = min(HEIGHT, height(one.column(2)[0].as_py()))
                root, records = grown(one.column(3).flatten().field("node").to_pylist(), levels)
                stored = pa.array([[{"digest": d, "children": c} for d, c in records]], pa.list_(pa.struct([("digest", pa.string()), ("children", pa.list_(pa.string()))])))
                yield pa.RecordBatch.from_arrays([*one.columns, pa.array([levels], pa.int32()), pa.array([root]), stored], ["by", "block", "total", "members", "levels", "root", "records"])

    return written(blocks.select(F.col(by).alias("by"), "block", "total", "members").mapInArrow(run, f"by {kind}, block long, total long, members {inner}, levels int, root string, records {RECORDS}"), "records")


def _tiers(nodes: DataFrame, by: str, carried: Sequence[str], written) -> list[DataFrame]:
    """From the leaves up, until no group has more than one block."""
    tiers = [_tier(nodes, by, carried, written)]
    while (tiers[-1].agg(F.max(F.col("total"))).first()[0] or 0) > BLOCK:
        up = tiers[-1].select("by", F.col("block").alias("rank"), F.ceil(F.col("total") / BLOCK).cast("long").alias("total"), F.col("root").alias("node"))
        tiers.append(_tier(up, "by", [], written))
    return tiers


def _descend(requests: DataFrame, tier: DataFrame) -> DataFrame:
    """Requests (r_by, r_block, r_node, r_above) for blocks to one row per member: by, rank, node, path, what the block carries and r_keep of the request."""
    same = F.col("by").eqNullSafe(F.col("r_by")) & (F.col("block") == F.col("r_block")) & (F.col("root") == F.col("r_node"))
    kind = tier.schema["by"].dataType.simpleString()
    member = tier.schema["members"].dataType.elementType.simpleString()
    keep = requests.schema["r_keep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                one = batch.slice(k, 1)
                members = one.column(1).flatten()
                levels, root, above = one.column(2)[0].as_py(), one.column(3)[0].as_py(), one.column(5)[0].as_py()
                records = {r["digest"]: r["children"] for r in one.column(4)[0].as_py()}
                paths = [way_down(root, records, place, levels)[1] + above for place in range(len(members))]
                same = pa.array([0] * len(members))
                yield pa.RecordBatch.from_arrays([one.column(0).take(same), members, pa.array(paths, pa.list_(pa.string())), one.column(6).take(same)], ["by", "member", "path", "r_keep"])

    joined = tier.join(requests, same).select("by", "members", "levels", "root", "records", "r_above", "r_keep")
    return joined.mapInArrow(run, f"by {kind}, member {member}, path array<string>, r_keep {keep}")


def _all_ways(tiers: list[DataFrame], requests: DataFrame) -> DataFrame:
    for tier in tiers[:0:-1]:
        down = _descend(requests, tier)
        requests = down.select(F.col("by").alias("r_by"), F.col("member.rank").alias("r_block"), F.col("member.node").alias("r_node"), F.col("path").alias("r_above"), "r_keep")
    return _descend(requests, tiers[0])


def proofs(rows: DataFrame, written: Callable[[DataFrame, str], DataFrame], group: str = "source", order: Sequence[str] = ("doc_id",), leaf: str = "leaf") -> DataFrame:
    """Per row of `rows`: all its columns, subroot (of its group), root, and path: one text per level from the leaf to the root, which is
    the row's digit there and the digests of the others of its run, from left to right.

    Leaves ascend by `order`, then by digest; nulls come first. Groups are ordered by name, the null one first. Repeated rows are
    leaves of their own. No rows give no proofs. `written` stores the leaves in order and the records of each tier.
    """
    nodes = ranked(rows, group, [*order, leaf], written).withColumn("node", F.col(leaf))
    below = _tiers(nodes, group, [c for c in rows.columns if c != group], written)
    ranks = below[-1].select(F.col("by").alias("name"), F.col("root").alias("node")).withColumn("all", F.lit(0))
    above = _tiers(ranked(ranks, "all", ["name"], written), "all", ["name"], written)

    def asked(frame: DataFrame, by: str, node: str, path: Column, keep: Column) -> DataFrame:
        return frame.select(F.col(by).alias("r_by"), F.lit(0).cast("long").alias("r_block"), F.col(node).alias("r_node"), path.alias("r_above"), keep.alias("r_keep"))

    tops = _all_ways(above, asked(above[-1], "by", "root", F.array().cast("array<string>"), F.col("root")))
    tops = tops.select(F.col("member.name").alias("name"), F.col("member.node").alias("subroot"), "path", F.col("r_keep").alias("root"))
    ways = _all_ways(below, asked(tops, "name", "subroot", F.col("path"), F.struct("subroot", "root")))
    own = [F.col("by").alias(c) if c == group else F.col(f"member.{c}").alias(c) for c in rows.columns]
    return ways.select(*own, "r_keep.subroot", "r_keep.root", "path")


def siblings_digest(path: Column) -> Column:
    """Of all siblings of a path, from the leaf to the root."""
    return F.sha2(F.array_join(F.transform(path, lambda level: F.substr(level, F.lit(2))), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of a path give."""

    def up(node: Column, level: Column) -> Column:
        left = 64 * F.substr(level, F.lit(1), F.lit(1)).cast("int")
        return F.sha2(F.concat(F.substr(level, F.lit(2), left), node, F.substr(level, left + 2)), 256)

    return F.aggregate(path, leaf, up)


def verified_manifest(docs: DataFrame, written, tampered: Column, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", group: str = "source", text_col: str = "text") -> DataFrame:
    """Per row of `docs`: id, leaf, subroot, root, proof_sha256, and what comes of the original proof when the text has become
    `tampered`: folded_root and verified (it is the root).

    A leaf is the digest of `fields`. Null fields count as `-`, an empty text as `0:`; texts of any length are read whole, once.
    Other columns are ignored. Repeated rows each are a leaf; rows of one id are ordered by their digests.
    """
    with_text = {f: F.col(f) for f in fields}
    leaves = docs.select(
        F.col(group).alias("group"), F.col(id_col).alias("id"), digest(*with_text.values()).alias("leaf"), digest(*(with_text | {text_col: tampered}).values()).alias("changed")
    )
    leaves = written(leaves.withColumn("changed", F.when(F.col("changed") != F.col("leaf"), F.col("changed"))), "leaves")
    proved = proofs(leaves, written, "group", ["id"])
    again = folded(F.coalesce("changed", "leaf"), F.col("path"))
    out = proved.select(F.col("id").alias(id_col), "leaf", "subroot", "root", siblings_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
