"""A Merkle manifest of a dataset: a digest of each row, a root of each group and one root of all, with each row's proof.

A row's leaf digests its fields. Leaves of a group, in order, become parents by runs of ``fanout``, level by level, until one
is left; the groups' roots, in order of the group, become the dataset's root alike. A level is a window partitioned by the group and
the parent's number: the ordered list of its whole frame is the parent's preimage and has each node's siblings. Of a parent's
rows only the first carries its digest on, so parents come once to the next level.

``BLOCK`` consecutive leaves share a partition, in which as many levels are made as it holds, after one shuffle; the blocks' roots are the next
round's leaves, so 10 billion rows take four rounds, and no window has more than ``BLOCK`` rows. Leaves are numbered by ranges of group and order:
a place in its range plus what stands in earlier ranges. First only roots are made, upwards; then the levels of each block are made again, with siblings, and
joined to the path above the block, so paths of all rows are never written.

Null fields are digested as ``-``, long texts whole. A null group is a group of its own, before all others; a null in the order comes first, and rows of
one place are put in order of their leaves, so repeated rows are leaves each. An empty table gives no rows and no root. Other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tamarisk.llm.common import shuffle_parts, stored

#: Leaves at most that a round takes to one block's root.
BLOCK = 1024
#: Leaves dealt to a partition.
PER_PART = 200_000
HEX = 64

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<pos:int,siblings:string>>"


def field(value: Column) -> Column:
    """A value with its length in bytes, or ``-`` for null: no two rows of fields have one preimage."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _group_key(group: str) -> Column:
    """Not null, and in the group's order: null, then the bytes of its text."""
    return F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))


def _numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` (``g, k, leaf, u, ...``) with ``i``, a leaf's place in its group, and ``n``, the group's leaves; ``u`` only spreads equal rows."""
    parts = shuffle_parts(leaves.sparkSession, leaves.count(), PER_PART)
    order = ("g", "k", "leaf", "u")
    ranged = leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = stored(ranged.withColumn("_m", F.monotonically_increasing_id()), "ranged").withColumn("_r", F.shiftright("_m", 33))
    ranges = ranged.groupBy("g", "_r").agg(F.count("*").alias("_c"), F.min("_m").alias("_first"))
    of = Window.partitionBy("g")
    ahead = F.coalesce(F.sum("_c").over(of.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("g", "_r", (ahead - F.col("_first")).alias("_shift"), F.sum("_c").over(of).alias("n"))
    return ranged.join(ranges, ["g", "_r"]).select(*leaves.drop("u").columns, (F.col("_m") + F.col("_shift")).alias("i"), "n")


def _size(fanout: int, most: int) -> int:
    """Leaves of a block: a power of ``fanout`` that holds the largest group's ``most``, or else the greatest up to ``BLOCK``; one level at least."""
    size = fanout
    while size < most and size * fanout <= BLOCK:
        size *= fanout
    return size


def _siblings(run: Column, own: Column) -> Column:
    return F.array_join(F.filter(run, lambda x, place: place != own), "")


def _levels(nodes: DataFrame, fanout: int, size: int, paths: bool) -> DataFrame:
    """``nodes`` (``g, i, n, leaf, ...``) dealt by blocks, with ``block``, ``top`` (the block's root, in its first row) and, with ``paths``, ``path`` inside the block."""
    parts = shuffle_parts(nodes.sparkSession, nodes.count(), PER_PART)
    rows = nodes.withColumn("block", F.expr(f"i div {size}")).repartition(parts, "g", "block").withColumn("top", F.col("leaf"))
    steps, below = [], 1
    while below < size:
        above = below * fanout
        run = Window.partitionBy("g", "block", F.expr(f"i div {above}")).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("_run", F.collect_list("top").over(run))
        goes_on, pos = F.col("n") > below, F.expr(f"cast(i div {below} % {fanout} as int)")
        if paths:
            rows = rows.withColumn(f"_s{below}", F.when(goes_on, F.struct(pos.alias("pos"), _siblings(F.col("_run"), pos).alias("siblings"))))
            steps.append(f"_s{below}")
        first = F.when(F.col("i") % above == 0, F.sha2(F.array_join("_run", ""), 256))
        rows = rows.withColumn("top", F.when(goes_on, first).otherwise(F.col("top"))).drop("_run")
        below = above
    return rows.withColumn("path", F.filter(F.array(*steps), lambda s: s.isNotNull())).drop("top", *steps) if paths else rows


def _rounds(nodes: DataFrame, fanout: int) -> list[tuple[DataFrame, int]]:
    """``nodes``, then each round's roots of blocks, the last with one row a group, all written; each with the size of its blocks."""
    most, out = nodes.agg(F.max("n")).first()[0] or 0, []
    while True:
        size = _size(fanout, most)
        out.append((nodes, size))
        tops = _levels(nodes.select("g", "i", "n", "leaf"), fanout, size, False).where(f"i % {size} = 0")
        nodes = stored(tops.select("g", F.col("block").alias("i"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), F.col("top").alias("leaf")), "blocks")
        if most <= size:
            return [*out, (nodes, 1)]
        most = -(-most // size)


def _paths(rounds: list[tuple[DataFrame, int]], fanout: int, over: DataFrame | None) -> DataFrame:
    """The first round's rows with ``path, subroot, root``; ``over`` (``g, over, root``) is what stands above the groups, or nothing."""
    above = rounds[-1][0].select("g", F.col("i").alias("block"), F.col("leaf").alias("subroot"))
    if over is None:
        above = above.withColumn("above", F.array().cast(STEP)).withColumn("root", F.col("subroot"))
    else:
        above = above.join(over, "g").withColumnRenamed("over", "above")
    for k in range(len(rounds) - 2, -1, -1):
        rows = _levels(rounds[k][0], fanout, rounds[k][1], True).join(above, ["g", "block"]).withColumn("path", F.concat("path", "above")).drop("above", "block")
        above = rows.select("g", F.col("i").alias("block"), F.col("path").alias("above"), "subroot", "root") if k else rows
    return above


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", fanout: int = 2, carry: Mapping[str, Column] | None = None) -> DataFrame:
    """``order, group, leaf, path, subroot, root`` and the columns of ``carry`` of every row.

    ``path`` has, level by level from the leaf to the dataset's root, a node's place in its run and its siblings' digests from left to right.
    """
    if fanout < 2:
        raise ValueError("fanout must be at least 2")
    carry = dict(carry or {})
    own = [F.col(order).alias("k"), _group_key(group).alias("g"), leaf_of([F.col(c) for c in fields]).alias("leaf"), F.monotonically_increasing_id().alias("u")]
    leaves = stored(docs.select(*own, F.col(group).alias("x_"), *[v.alias(f"x_{name}") for name, v in carry.items()]), "leaves")
    rounds = _rounds(stored(_numbered(leaves), "nodes"), fanout)
    groups = rounds[-1][0].select(F.lit("").alias("g"), F.col("g").alias("k"), "leaf", F.lit(0).alias("u"))
    over = _paths(_rounds(stored(_numbered(groups), "groups"), fanout), fanout, None)
    over = over.select(F.col("k").alias("g"), F.col("path").alias("over"), "root")
    rows = _paths(rounds, fanout, over)
    return rows.select(F.col("k").alias(order), F.col("x_").alias(group), "leaf", "path", "subroot", "root", *[F.col(f"x_{name}").alias(name) for name in carry])


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings make: equal to the dataset's root if the leaf is what it was."""
    def step(node: Column, s: Column) -> Column:
        before = s["pos"] * HEX
        return F.sha2(F.concat(F.substring(s["siblings"], F.lit(1), before), node, F.substring(s["siblings"], before + 1, F.length(s["siblings"]))), 256)

    return F.aggregate(path, leaf, step)


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda s: s["siblings"]), ""), 256)


def changes(docs: DataFrame, made: DataFrame, fields: Sequence[str] = FIELDS, key: str = "doc_id") -> DataFrame:
    """``key, state`` of the rows of ``docs`` against an earlier ``manifest``: ``same``, ``changed`` (its leaf doesn't fold to the root), ``added`` or ``missing``.

    Keys are unique on both sides; rows without a key are ``added`` or ``missing``.
    """
    now = docs.select(F.col(key).alias("k"), leaf_of([F.col(c) for c in fields]).alias("now"))
    then = made.select(F.col(key).alias("t"), "path", "root")
    both = now.join(then, F.col("k") == F.col("t"), "full_outer")
    state = (
        F.when(F.col("root").isNull(), "added").when(F.col("now").isNull(), "missing")
        .when(folded(F.col("now"), F.col("path")) == F.col("root"), "same").otherwise("changed")
    )
    return both.select(F.coalesce("k", "t").alias(key), state.alias("state"))


def tampered_count(key: str = "doc_id", count: str = "n_chars", fields: Sequence[str] = FIELDS, each: int = 7) -> Column:
    """The leaf of a row whose ``count`` was raised by 1, where ``each`` divides the crc32 of the key's digits; null elsewhere."""
    raised = (F.col(count).cast("decimal(20,0)") + 1).cast("string")
    hit = F.crc32(F.col(key).cast("string").cast("binary")) % each == 0
    return F.when(hit, leaf_of([raised if c == count else F.col(c) for c in fields]))


def audited(docs: DataFrame) -> DataFrame:
    """The columns of ``op12``: each row's proof, and whether it holds after some rows were tampered with."""
    rows = manifest(docs, carry={"tampered": tampered_count()})
    rows = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    return rows.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
