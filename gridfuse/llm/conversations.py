"""The prefix trie of rebuilt conversations, from whole sequences.

1. Turns are digested where they lie; after that only digests and lengths move.  Each
   conversation is rebuilt from the first turns of the conversation that it shares them
   with, and its own later turns.
2. Identical rebuilt conversations collapse into one weighted sequence, which goes on
   under its smallest id.  Their ids make the end list, read once, as a sorted stream.
3. A node is a prefix, known by its depth and the sum of digests of (place, turn).
   Sequences that are proper prefixes of others are dropped by an anti-join; the rest
   are the leaves.
4. The smallest id among a node's members owns the node.  A sequence owns all its nodes
   from some depth on, so each distinct turn text counts once, in the sequence that owns
   it, and one weighted sum over the prefixes of the sequences gives every column.

Running sums follow a range partitioning by (conversation, place) and are completed by
the totals of the ranges before, so a conversation of any length spreads over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridfuse.llm.common import Workspace

#: A conversation shares up to SHARED - 1 turns with the first id of its FAMILY.
FAMILY, SHARED = 100, 6
#: Prefix keys: sums of four 32-bit parts of a digest per turn.
PARTS = ["k1", "k2", "k3", "k4"]
RESULT = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
    "ends_sha256",
]


def turn_digests(turns: DataFrame) -> DataFrame:
    """(conv, turn, digest, chars) of every row with an id; null role and text are empty."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    named = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.md5(named.cast("binary")).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )


def running(
    rows: DataFrame, key: str, order: list[Column], sums: dict[str, Column], tables: Workspace
) -> DataFrame:
    """rows with running sums per key, this row included, in the given order.

    Ranges of (key, order) are summed for themselves and completed by the totals of the
    ranges before, of which a key has more than one only where it is large.
    """
    ranged = tables.written(
        rows.repartitionByRange(key, *order).withColumn("range", F.spark_partition_id())
    )
    within = Window.partitionBy("range", key).orderBy(*order)
    within = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(key).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("range", key).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    before = totals.select(
        "range", key, *[F.sum(n).over(earlier).alias(f"{n}_before") for n in sums]
    ).where(" or ".join(f"{n}_before is not null" for n in sums))
    own = ranged.select("*", *[F.sum(c).over(within).alias(n) for n, c in sums.items()])
    joined = own.join(before, ["range", key], "left")
    whole = {n: F.col(n) + F.coalesce(f"{n}_before", F.lit(0)) for n in sums}
    return joined.withColumns(whole).drop("range", *[f"{n}_before" for n in sums])


def rebuilt(turns: DataFrame, tables: Workspace) -> tuple[DataFrame, DataFrame]:
    """(conv) of every conversation, and (conv, place, digest, chars) of its rebuilt turns."""
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    placed = tables.written(running(turn_digests(turns), "conv", order, {"at": F.lit(1)}, tables))
    share = F.crc32(F.col("conv").cast("string").cast("binary")) % SHARED
    convs = placed.groupBy("conv").agg(F.count("*").alias("own")).withColumn("shared", share)
    convs = convs.withColumn("first", F.col("conv") - F.col("conv") % FAMILY)
    lengths = convs.select(F.col("conv").alias("first"), F.col("own").alias("there"))
    convs = convs.join(lengths, "first", "left").withColumn(
        "taken", F.least("shared", F.coalesce("there", F.lit(0)))
    )
    convs = tables.written(convs.select("conv", "first", "shared", "taken"))
    heads = placed.where(F.col("at") < SHARED).select(
        F.col("conv").alias("first"), F.col("at").alias("place"), "digest", "chars"
    )
    # Fewer than 2 * FAMILY ids have one first conversation, and at most SHARED - 1 of its turns.
    shared = heads.join(convs, "first").where("place <= shared")
    own = placed.join(convs.select("conv", "shared", "taken"), "conv").where("at > shared")
    own = own.withColumn("place", F.col("at") - F.col("shared") + F.col("taken"))
    columns = ["conv", "place", "digest", "chars"]
    return convs.select("conv"), shared.select(*columns).unionByName(own.select(*columns))


def key_parts() -> dict[str, Column]:
    """Four numbers below 2**32 from the place and the digest of a turn."""
    mixed = F.md5(F.concat(F.col("place").cast("string"), F.lit(":"), "digest").cast("binary"))
    return {
        name: F.conv(F.substring(mixed, 8 * at + 1, 8), 16, 10).cast("long")
        for at, name in enumerate(PARTS)
    }


def node_key(depth: Column, parts) -> Column:
    return F.md5(F.concat_ws(",", depth.cast("string"), *[p.cast("string") for p in parts]).cast("binary"))


def sequences(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv, depth, chars, key): each conversation with its sequence's key."""
    whole = turns.groupBy("conv").agg(
        F.count("*").alias("depth"), F.sum("chars").alias("chars"), *[F.sum(p).alias(p) for p in PARTS]
    )
    filled = convs.join(whole, "conv", "left").na.fill(0, ["depth", "chars", *PARTS])
    return filled.select(
        "conv", "depth", "chars", node_key(F.col("depth"), map(F.col, PARTS)).alias("key")
    )


def end_digests(members: DataFrame) -> DataFrame:
    """(id, ends): digest of the ascending ids ``conv`` of each group ``id``.

    Ids are sorted over all tasks and written out in runs; then one row per group and
    batch is streamed through the digest, so no list is held as a whole.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, convs = (batch.column(c).to_numpy() for c in ("id", "conv"))
            cuts = [0, *((ids[1:] != ids[:-1]).nonzero()[0] + 1).tolist(), len(ids)]
            runs = [(a, b) for a, b in zip(cuts, cuts[1:]) if a < b]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[a] for a, _ in runs], pa.int64()),
                    pa.array([convs[a] for a, _ in runs], pa.int64()),
                    pa.array([",".join(map(str, convs[a:b].tolist())) for a, b in runs], pa.string()),
                ],
                names=["id", "first", "part"],
            )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            done = []
            for group, part in zip(batch.column("id").to_pylist(), batch.column("part").to_pylist()):
                if group != last:
                    if last is not None:
                        done.append((last, digest.hexdigest()))
                    last, digest = group, sha256(part.encode())
                else:
                    digest.update(b"," + part.encode())
            yield _ends(done)
        if last is not None:
            yield _ends([(last, digest.hexdigest())])

    ordered = members.select("id", "conv").repartitionByRange("id", "conv")
    runs = ordered.sortWithinPartitions("id", "conv").mapInArrow(listed, "id long, first long, part string")
    by_group = runs.repartition("id").sortWithinPartitions("id", "first")
    return by_group.mapInArrow(digests, "id long, ends string")


def _ends(rows) -> pa.RecordBatch:
    ids, digests = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(digests, pa.string())], names=["id", "ends"]
    )


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The columns of ``RESULT``, a row per node.

    Turns are ordered by ``turn``, null first, and equal turns by the digest of role and
    text; a null role or text is empty.  Rows that repeat another in all columns are turns
    of their own.  Rows with a null ``conv_id`` belong to no conversation.  A table without
    conversations gives no rows; other columns are ignored.
    """
    tables = Workspace(turns.sparkSession)
    convs, rows = rebuilt(turns, tables)
    rows = tables.written(rows.withColumns(key_parts()))
    each = tables.written(sequences(convs, rows))
    groups = tables.written(
        each.groupBy("key").agg(
            F.min("conv").alias("id"),
            F.count("*").alias("weight"),
            F.first("depth").alias("length"),
            F.first("chars").alias("total"),
        )
    )
    # The prefixes of one conversation of each group; what stands before a turn is its parent.
    of_groups = rows.join(groups.select(F.col("id").alias("conv"), "id"), "conv").drop("conv")
    sums = {**{f"s{p}": F.col(p) for p in PARTS}, "until": F.col("chars")}
    summed = running(of_groups, "id", [F.col("place")], sums, tables)
    prefixes = tables.written(
        summed.select(
            "id",
            F.col("place").alias("depth"),
            node_key(F.col("place"), [F.col(f"s{p}") for p in PARTS]).alias("key"),
            node_key(F.col("place") - 1, [F.col(f"s{p}") - F.col(p) for p in PARTS]).alias("above"),
            (F.col("until") - F.col("chars")).alias("before"),
        )
    )
    leaves = groups.join(prefixes.select(F.col("above").alias("key")).distinct(), "key", "left_anti")
    # Written, so that a common prefix is a skewed side that a join can split.
    owners = tables.written(prefixes.groupBy("key").agg(F.min("id").alias("owner")))
    owned = (
        prefixes.select("key", "id", "depth", "before")
        .join(owners, "key")
        .groupBy("id")
        .agg(
            F.min(F.when(F.col("owner") == F.col("id"), F.col("depth"))).alias("from"),
            F.min(F.when(F.col("owner") == F.col("id"), F.col("before"))).alias("spared"),
            F.max(F.when(F.col("owner") != F.col("id"), F.struct("depth", "owner"))).alias("joint"),
        )
    )
    info = tables.written(
        groups.join(owned, "id", "left")
        .join(leaves.select("id", F.lit(1).alias("leaf")), "id", "left")
        .select(
            "id",
            "weight",
            "length",
            "total",
            F.coalesce("leaf", F.lit(0)).alias("leaf"),
            # A sequence that owns no node of its path counts no text of its own.
            F.coalesce("from", F.col("length") + 1).alias("from"),
            F.coalesce("spared", "total").alias("spared"),
            F.col("joint.owner").alias("joint"),
        )
    )

    def metrics(before: Column, depth: Column) -> list[Column]:
        owner = F.col("from") <= depth
        # Turn texts of this depth and below: in each member, and once per node.
        text = F.col("weight") * (F.col("total") - before)
        once = F.col("total") - F.greatest(before, F.col("spared"))
        child = (F.col("length") > depth) & (F.col("from") <= depth + 1)
        return [
            F.min("id").alias("conv_id"),
            F.max(F.when(owner & (F.col("from") < depth), F.col("id")).when(owner, F.col("joint"))).alias("up"),
            F.sum("weight").alias("n_convs"),
            F.sum(child.cast("long")).alias("n_children"),
            F.sum("leaf").cast("long").alias("n_leaves"),
            F.sum(text - once).alias("saved_tokens"),
            F.max(F.when(F.col("length") == depth, F.col("id"))).alias("end"),
        ]

    depth = F.col("depth")
    nodes = prefixes.join(info, "id").groupBy("key", "depth").agg(*metrics(F.col("before"), depth))
    root = info.agg(*metrics(F.lit(0), F.lit(0))).where("n_convs > 0")
    root = root.withColumn("depth", F.lit(0).cast("long"))
    # Nodes of depth 1 share only the root, which the smallest id of all owns.
    top = info.agg(F.min("id")).first()[0]
    nodes = nodes.drop("key").withColumn("up", F.coalesce("up", F.lit(top).cast("long")))
    every = nodes.unionByName(root.withColumn("up", F.lit(None).cast("long")))
    several = groups.where("weight > 1").select("key", "id")
    ends = end_digests(each.join(several, "key")).select(F.col("id").alias("end"), "ends")
    alone = F.sha2(F.coalesce(F.col("end").cast("string"), F.lit("")).cast("binary"), 256)
    return (
        every.join(ends, "end", "left")
        .withColumn("ends_sha256", F.coalesce("ends", alone))
        .withColumn("parent_conv_id", F.col("up"))
        .select(*RESULT)
    )
