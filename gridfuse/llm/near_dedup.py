"""Near duplicates by MinHash with tensored banding, confirmed on whole shingle sets.

A document is its set of distinct five-word shingles.  Equal sets form a class, and
only the smallest document of a class goes on.  Two small collections of ``TABLES``
partial keys, each from ``ROWS`` minhashes, stand for TABLES * TABLES hash tables: the
key of table (i, j) combines partial key i of the first collection with j of the
second.  So 2 * TABLES * ROWS minhashes do the work of TABLES**2 * 2 * ROWS.  With 10
and 2, 40 in place of 400, a pair at similarity 0.75 misses all tables with probability
0.0005, at 0.8 with 0.00007.  The second half is only combined for documents
that share a first half with another.

Within a table's bucket every document is compared with the smallest.  Components of the
confirmed links follow.  Buckets that still hold several components, mostly short
documents with a passage in common, are dealt anew: two sets at the threshold share one
of their rarest shingles (a quarter of the set, and one more), so the members of such
buckets meet by those, which leaves nothing out.  There only pairs across
components are compared whose sizes and places allow the threshold: at once in small
buckets, some leaders against all in larger ones, round by round until no bucket holds two
components that have not met.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfuse.llm.bits import bit_set, some_rows
from gridfuse.llm.common import Workspace, map_rows
from gridfuse.llm.components import component_stars
from gridfuse.llm.words import WHITE, distinct_sets, find_words, mix, shingles, text_chunks, word_bytes

WIDTH, PERCENT = 5, 75
TABLES, ROWS = 10, 2
#: Buckets of a shared rare shingle up to ``SMALL`` members are finished at once; in larger
#: ones ``LEADERS`` members meet all others in a round.
SMALL, LEADERS = 4096, 256
#: Members of a bucket that meet its one row, or its leaders, in one group.
PART = 512
SIGNATURES = "doc_id long, n long, set_key binary, first array<long>, second array<long>"

_random = np.random.default_rng(20)
_FACTORS = _random.integers(1 << 62, size=2 * TABLES * ROWS, dtype=np.uint64) * 2 + 1
_SHIFTS = _random.integers(1 << 63, size=2 * TABLES * ROWS, dtype=np.uint64)
_INSIDE = word_bytes(bytes(WHITE))


def partial_keys(hashes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each set (hashes from its begin on) the 2 * TABLES partial keys."""
    keys = np.zeros((len(begins), 2 * TABLES), np.uint64)
    for k in range(2 * TABLES * ROWS):
        least = np.minimum.reduceat(hashes * _FACTORS[k] + _SHIFTS[k], begins)
        keys[:, k // ROWS] = mix(keys[:, k // ROWS] + least)
    return keys


def chunk_sets(column: pa.Array):
    """(number of texts, hashes, owners) of runs of texts; sets sorted by owner."""
    for first, last, data, offsets in text_chunks(column):
        words = find_words(data, offsets, _INSIDE)
        yield last - first, *distinct_sets(*shingles(words, WIDTH))


def signatures(docs: DataFrame) -> DataFrame:
    """Size and digest of each document's set, and its partial keys; null without words."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, digests, keys = [], [], []
        for n, hashes, owners in chunk_sets(batch.column("text")):
            counts = np.bincount(owners, minlength=n)
            ends = np.cumsum(counts)
            full = np.flatnonzero(counts)
            own = partial_keys(hashes, (ends - counts)[full]) if len(full) else None
            row_of = {int(text): k for k, text in enumerate(full)}
            for text in range(n):
                part = hashes[ends[text] - counts[text] : ends[text]]
                sizes.append(int(counts[text]))
                digests.append(blake2b(part.tobytes(), digest_size=16).digest() if len(part) else None)
                keys.append(own[row_of[text]].view(np.int64) if len(part) else None)
        halves = [
            pa.array([None if k is None else k[part] for k in keys], pa.list_(pa.int64()))
            for part in (slice(0, TABLES), slice(TABLES, 2 * TABLES))
        ]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.binary()),
                *halves,
            ],
            names=["doc_id", "n", "set_key", "first", "second"],
        )

    return map_rows(docs.select("doc_id", "text"), rows, SIGNATURES, sliced=True)


def in_parts(members: DataFrame, count: str) -> DataFrame:
    """Each member in one ``part`` of its bucket, by id; ``count`` names the bucket's size."""
    return members.withColumn("part", F.expr(f"pmod(xxhash64(id), ({count} - 1) div {PART} + 1)"))


def for_parts(rows: DataFrame, count: str) -> DataFrame:
    """Each row once for every ``part`` of its bucket, so that a large one spreads over tasks."""
    return rows.withColumn("part", F.expr(f"explode(sequence(0L, ({count} - 1) div {PART}))"))


def bucket_members(classes: DataFrame) -> DataFrame:
    """(key, id, n, size) of every bucket with two classes or more, without repeated buckets;
    ``size`` is the number of its members."""
    halves = classes.select("id", "n", "second", F.posexplode("first").alias("i", "half"))
    shared = halves.groupBy("i", "half").agg(F.count("*").alias("c")).where("c > 1")
    table = F.expr(
        f"explode(transform(sequence(0, {TABLES - 1}), j -> xxhash64(i, half, j, second[j])))"
    )
    members = halves.join(shared, ["i", "half"], "left_semi").select(table.alias("key"), "id", "n")
    # Buckets with the same members, as tables of one pair of documents have: one stays.
    buckets = (
        members.groupBy("key")
        .agg(
            F.count("*").alias("c"),
            F.min("id").alias("low"),
            F.max("id").alias("high"),
            F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("mark"),
        )
        .where("c > 1")
        .groupBy("c", "low", "high", "mark")
        .agg(F.min("key").alias("key"))
        .select("key", F.col("c").alias("size"))
    )
    return members.join(buckets, "key")


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough; ``texts`` has (id, text)."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        sides = []
        for name in ("text_u", "text_v"):
            sets = []
            for n, hashes, owners in chunk_sets(batch.column(name)):
                sets += np.split(hashes, np.cumsum(np.bincount(owners, minlength=n))[:-1])
            sides.append(sets)
        linked = []
        for one, other in zip(*sides):
            both = len(np.intersect1d(one, other, assume_unique=True))
            linked.append(100 * both >= PERCENT * (len(one) + len(other) - both) and both > 0)
        return batch.select(["u", "v"]).filter(pa.array(linked, pa.bool_()))

    sided = pairs.join(texts.select(F.col("id").alias("v"), F.col("text").alias("text_v")), "v")
    sided = sided.join(texts.select(F.col("id").alias("u"), F.col("text").alias("text_u")), "u")
    return map_rows(sided, rows, "u long, v long", sliced=True)


def near_size(one: str, other: str) -> str:
    return f"100 * least({one}, {other}) >= {PERCENT} * greatest({one}, {other})"


def prefix_members(texts: DataFrame, tables: Workspace) -> DataFrame:
    """(key, id, n, place, size): the rarest shingles of each set, enough that two sets that
    are similar enough share one; ``place`` counts from 1 in the order of rarity, ``size``
    the sets that have the shingle, among their rarest or not."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = []
        for n, hashes, owners in chunk_sets(batch.column("text")):
            ends = np.cumsum(np.bincount(owners, minlength=n))[:-1]
            lists += np.split(hashes.view(np.int64), ends)
        return pa.RecordBatch.from_arrays(
            [batch.column("id"), pa.array(lists, pa.list_(pa.int64()))], names=["id", "keys"]
        )

    sets = map_rows(texts, rows, "id long, keys array<long>", sliced=True)
    held = sets.select("id", F.size("keys").alias("n"), F.explode("keys").alias("key"))
    # Written, so that a common shingle is a skewed side that a join can split.
    counts = tables.written(held.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"))
    rarity = Window.partitionBy("id").orderBy(F.col("size").asc_nulls_first(), "key")
    placed = held.join(counts, "key", "left").withColumn("place", F.row_number().over(rarity))
    needed = F.expr(f"place <= n - ceil({PERCENT} * n / 100) + 1")
    return placed.where(needed).where("size > 1").select("key", "id", "n", "place", "size")


def still_open(members: DataFrame, stars: DataFrame) -> DataFrame:
    """Members of buckets that hold several components, with their ``root``, the number ``c``
    of the bucket's members and its smallest root ``low``."""
    roots = stars.select(F.col("u").alias("id"), F.col("v").alias("root"))
    rooted = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    buckets = (
        rooted.groupBy("key", "size")
        .agg(F.count("*").alias("c"), F.min("root").alias("low"), F.max("root").alias("high"))
        .where("low < high")
    )
    buckets = for_parts(buckets, "size").select("key", "part", "c", "low")
    return in_parts(rooted, "size").join(buckets, ["key", "part"]).drop("part")


def leaders(members: DataFrame) -> DataFrame:
    """The LEADERS smallest ids of each bucket.  The filter on the number goes before the
    exchange, so a bucket of any size sends that many rows of each task."""
    turn = Window.partitionBy("key").orderBy("id")
    numbered = members.withColumn("turn", F.row_number().over(turn))
    return numbered.where(F.col("turn") <= LEADERS).drop("turn")


def pairs_between(first: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct (u, v) of one bucket and two components that may be similar enough: by size,
    and by what can follow the shingle that they share."""
    named = (F.col(c).alias(f"{c}_u") for c in ("id", "n", "place", "root"))
    left = for_parts(first, "c").select("key", "part", *named)
    right = in_parts(members, "c").select("key", "part", "id", "n", "place", "root", "low")
    follow = "1 + least(n - place, n_u - place_u)"
    return (
        left.join(right, ["key", "part"])
        .where("root_u <> root and (id_u < id or root = low)")
        .where(near_size("n", "n_u"))
        .where(f"{100 + PERCENT} * ({follow}) >= {PERCENT} * (n + n_u)")
        .select(F.least("id_u", "id").alias("u"), F.greatest("id_u", "id").alias("v"))
        .distinct()
    )


def set_links(members: DataFrame, texts: DataFrame, tables: Workspace) -> DataFrame:
    """Stars (u, v) of the components of all confirmed links between classes."""
    leader = members.groupBy("key", "size").agg(F.min(F.struct("id", "n")).alias("leader"))
    leader = for_parts(leader, "size").select("key", "part", "leader")
    led = in_parts(members, "size").join(leader, ["key", "part"]).where("id <> leader.id")
    pairs = led.where(near_size("n", "leader.n"))
    pairs = pairs.select(F.col("leader.id").alias("u"), F.col("id").alias("v")).distinct()
    tried = tables.written(pairs)
    stars = component_stars(confirmed(tried, texts), tables)
    wanted = tables.written(still_open(led.select("key", "id", "n", "size"), stars).select("id").distinct())
    rest = tables.written(prefix_members(texts.join(wanted, "id", "left_semi"), tables))
    while True:
        rest = tables.written(still_open(rest, stars))
        if rest.isEmpty():
            return stars
        small, large = rest.where(F.col("c") <= SMALL), rest.where(F.col("c") > SMALL)
        # One side of a pair is not in the component of the smallest root.
        fresh = pairs_between(small.where("root <> low"), small)
        last = large.isEmpty()
        if not last:
            first = tables.written(leaders(large))
            fresh = fresh.unionByName(pairs_between(first, large)).distinct()
        fresh = tables.written(fresh.join(tried, ["u", "v"], "left_anti"))
        tried = tried.unionByName(fresh)
        stars = component_stars(confirmed(fresh, texts).unionByName(stars), tables)
        if last:
            return stars
        # Leaders have met all of their bucket.
        rest = large.join(first, ["key", "id"], "left_anti").drop("root", "c", "low")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Texts without words, and null texts, have no shingles and are linked with nothing:
    they are their own component and kept.  A text with fewer words than a shingle is
    one shingle.  Rows that repeat an id and text stay equal rows; ids are meant to be
    unique, and where one has several texts, any of them stands for its links.  A row
    with a null id takes part in no group; its component is null and it is kept.  An
    empty table gives no rows; other columns are ignored.
    """
    tables = Workspace(docs.sparkSession)
    found = tables.written(signatures(docs))
    classes = (
        found.where("n > 0 and doc_id is not null")
        .groupBy("set_key")
        .agg(
            F.min("doc_id").alias("id"),
            F.count("*").alias("copies"),
            F.first("n").alias("n"),
            F.first("first").alias("first"),
            F.first("second").alias("second"),
        )
    )
    members = tables.written(bucket_members(classes))
    wanted = members.select(F.col("id").alias("doc_id")).distinct()
    texts = tables.written(
        some_rows(docs.select(F.col("doc_id").cast("long"), "text"), bit_set(wanted, "doc_id"))
        .where("text is not null")
        .join(wanted, "doc_id", "left_semi")
        .groupBy(F.col("doc_id").alias("id"))
        .agg(F.first("text").alias("text"))
    )
    stars = set_links(members, texts, tables)
    linked = stars.select(F.col("u").alias("id"), F.col("v").alias("root"))
    roots = classes.select("set_key", "id", "copies").join(linked, "id", "left")
    roots = roots.where("copies > 1 or root is not null")
    # Written, so that documents of one set are a skewed side that a join can split.
    roots = tables.written(roots.select("set_key", F.coalesce("root", "id").alias("root")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "doc_id"))
    placed = found.select("doc_id", "n", "set_key").join(roots, "set_key", "left")
    placed = placed.withColumn("component_id", component)
    return placed.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )
