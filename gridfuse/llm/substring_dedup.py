"""Repeated passages across documents, by fixed blocks as anchors.

1. *Index and probe.*  The index has the non-overlapping blocks of ``BLOCK`` words of every
   document, for each content those of the smallest id.  Every rolling window of BLOCK words
   probes it; a hit is a block of a document with a smaller id.  A repeated window of
   ``LENGTH`` words is at least 2 * BLOCK - 1 words long, so in the earlier document it
   contains a whole block, wherever it lies in the later one: no repeat is missed.
2. *Extend.*  Around the hits, and around the blocks they hit, every window of LENGTH words
   is compared once more, whole, with the smallest id that has it.  Windows that follow each
   other make the maximal exact repeats.

Both steps are one exchange of packed runs.  Windows meet in a bucket chosen by the least
hash of the strings of a few words inside them, so neighbouring windows mostly travel
together: per window 4 bytes of hash (8 in the second step), per run its document and place.
A bucket's share of the text has a fixed mean size, so their number grows with the corpus.

What many documents share is reduced where it lies: of equal windows of a group of documents
(some ``GROUP`` bytes) only one goes on, and the others are known to be shared.  In the first
step that makes them candidates, in the second repeats.  So a passage that fills a third of
the corpus sends a row per group, not per document, and no pairs are formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfuse.llm.bits import bit_set, some_rows
from gridfuse.llm.common import Workspace, map_rows
from gridfuse.llm.words import PIECE, WHITE, find_words, mix, powers, text_chunks, word_bytes

LENGTH, BLOCK = 50, 25
#: Words of the strings that choose a bucket, in windows of BLOCK words.
GRAM = 6
#: Bytes of text whose windows are compared before they are sent, and of a bucket's share.
GROUP, SHARE = 1 << 23, 1 << 25
BLOCKS, PROBES, SHARED = range(3)
PACKED = "bucket int, kind int, hashes binary, ids binary, rows binary, places binary, lens binary"
SPANS = "row long, place int, run int"
_INSIDE = word_bytes(bytes(WHITE))
_LETTERS = np.arange(256, dtype=np.uint8)


# Windows


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` words, some of which cross documents."""
    size = max(0, len(words) - width + 1)
    found = np.zeros(size, np.uint64)
    up, down = powers(PIECE)
    step = PIECE - width
    for begin in range(0, size, step):
        part = words[begin : begin + step + width - 1]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        own = len(part) - width + 1
        found[begin : begin + own] = (sums[width:] - sums[:own]) * down[:own]
    return mix(found)


def least_within(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbouring values; doubling what is compared."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = np.minimum(values[:-step], values[step:])
        done += step
    return values


@dataclass
class Group:
    """Documents that are compared with each other before anything is sent."""

    ids: np.ndarray  # by which documents are ordered
    rows: np.ndarray  # by which rows are known
    words: np.ndarray  # hashes
    bounds: np.ndarray  # where the words of each document begin, and the end

    def windows(self, width: int, gram: int):
        """(hash, key, document, place) of every window within a document.  Equal windows
        have equal keys, and neighbouring ones mostly too."""
        texts = np.repeat(np.arange(len(self.ids), dtype=np.int32), np.diff(self.bounds))
        hashes = window_hashes(self.words, width)
        if not len(hashes):
            empty = np.zeros(0, np.int64)
            return hashes, hashes, empty, empty
        keys = least_within(window_hashes(self.words, gram), width - gram + 1)
        at = np.flatnonzero(texts[: len(hashes)] == texts[width - 1 :])
        own = texts[at]
        return hashes[at], mix(keys[at]), own, at - self.bounds[own]

    def ranks(self) -> np.ndarray:
        return np.unique(self.ids, return_inverse=True)[1].astype(np.int32)


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Group, list]]:
    """The documents of the batches in groups of about GROUP bytes, and their last columns."""
    for batch in batches:
        ids, rows = (batch.column(c).to_numpy() for c in ("id", "row"))
        first, size, words, bounds = 0, 0, [], [np.zeros(1, np.int64)]
        for _, last, data, offsets in text_chunks(batch.column("text")):
            found = find_words(data, offsets, _INSIDE, _LETTERS)
            words.append(found.hashes)
            bounds.append(found.bounds[1:] + bounds[-1][-1])
            size += len(data)
            if size >= GROUP or last == len(ids):
                own = slice(first, last)
                yield Group(ids[own], rows[own], np.concatenate(words), np.concatenate(bounds)), [
                    batch.column(c).slice(first, last - first) for c in batch.schema.names[3:]
                ]
                first, size, words, bounds = last, 0, [], [np.zeros(1, np.int64)]


def equal_groups(hashes: np.ndarray, ranks: np.ndarray):
    """For each window the least and the greatest rank among equal windows."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    sizes = np.diff(np.append(heads, len(order)))
    least, greatest = np.empty_like(ranks), np.empty_like(ranks)
    least[order] = np.repeat(np.minimum.reduceat(ranks[order], heads), sizes)
    greatest[order] = np.repeat(np.maximum.reduceat(ranks[order], heads), sizes)
    return least, greatest


# Packed runs


def _indexes(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after another."""
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(lens.sum())


def packed(kind: int, buckets, hashes, own, places, group: Group) -> pa.RecordBatch | None:
    """Rows of ``PACKED``: windows in the order of document and place, dealt to buckets."""
    if not len(places):
        return None
    new = (np.diff(own) != 0) | (np.diff(places) != 1) | (np.diff(buckets) != 0)
    heads = np.flatnonzero(np.concatenate([[True], new]))
    lens = np.diff(np.append(heads, len(places)))
    order = np.argsort(buckets[heads], kind="stable")
    heads, lens = heads[order], lens[order]
    dealt = buckets[heads]
    cuts = np.flatnonzero(np.concatenate([[True], dealt[1:] != dealt[:-1]]))
    ends = np.append(cuts[1:], len(heads))
    windows = np.concatenate([[0], np.cumsum(lens)])
    if hashes is not None:
        hashes = hashes[_indexes(heads, lens)]
    columns = [
        group.ids[own[heads]].astype(np.int64),
        group.rows[own[heads]].astype(np.int64),
        places[heads].astype(np.int32),
        lens.astype(np.int32),
    ]
    blobs = [
        [b"" if hashes is None else hashes[windows[a] : windows[b]].tobytes() for a, b in zip(cuts, ends)],
        *([column[a:b].tobytes() for a, b in zip(cuts, ends)] for column in columns),
    ]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(dealt[cuts].astype(np.int32)),
            pa.array(np.full(len(cuts), kind, np.int32)),
            *(pa.array(blob, pa.binary()) for blob in blobs),
        ],
        names=[part.split()[0] for part in PACKED.split(", ")],
    )


@dataclass
class Runs:
    """One row of ``PACKED``, read again."""

    hashes: np.ndarray
    ids: np.ndarray
    rows: np.ndarray
    places: np.ndarray
    lens: np.ndarray

    @classmethod
    def read(cls, batch: pa.RecordBatch, at: int, kind) -> Runs:
        kinds = (kind, np.int64, np.int64, np.int32, np.int32)
        columns = (batch.column(k + 2)[at].as_buffer() for k in range(5))
        return cls(*(np.frombuffer(c, dtype=t) for c, t in zip(columns, kinds)))

    def windows(self):
        """(id, row, place) of each window."""
        ids, rows = np.repeat(self.ids, self.lens), np.repeat(self.rows, self.lens)
        return ids, rows, _indexes(self.places.astype(np.int64), self.lens.astype(np.int64))


def spans(parts) -> pa.RecordBatch:
    """Rows of ``SPANS`` from (rows, places, runs) arrays."""
    rows, places, runs = (np.concatenate(c) for c in zip(*parts)) if parts else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(rows, pa.int64()), pa.array(places, pa.int32()), pa.array(runs, pa.int32())],
        names=["row", "place", "run"],
    )


def _run_spans(rows, places):
    """Single windows as runs, where they follow each other."""
    new = (np.diff(rows) != 0) | (np.diff(places) != 1)
    heads = np.flatnonzero(np.concatenate([[len(rows) > 0], new]))
    return rows[heads], places[heads], np.diff(np.append(heads, len(rows)))


class _Buckets:
    """Packed rows in the order of bucket and kind: blocks first, then what probes them."""

    def __init__(self, kind):
        self.kind = kind

    def over(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = None
        for batch in batches:
            out = []
            numbers = zip(batch.column("bucket").to_pylist(), batch.column("kind").to_pylist())
            for at, (number, kind) in enumerate(numbers):
                if number != bucket:
                    if bucket is not None:
                        out += self.end()
                    bucket = number
                    self.begin()
                runs = Runs.read(batch, at, self.kind)
                if kind == SHARED:
                    out.append((runs.rows, runs.places, runs.lens))
                else:
                    out += self.add(kind, runs)
            yield spans(out)
        if bucket is not None:
            yield spans(self.end())


class _Hits(_Buckets):
    """Windows that equal a block of a smaller id, and the blocks that are hit."""

    def begin(self):
        self.parts, self.keys = [], None

    def index(self):
        if self.keys is not None:
            return
        columns = [(r.hashes, *r.windows()) for r in self.parts] or [[np.zeros(0, np.int64)] * 4]
        hashes, ids, rows, places = (np.concatenate(c) for c in zip(*columns))
        order = np.lexsort((ids, hashes))
        hashes, ids, rows, places = (c[order] for c in (hashes, ids, rows, places))
        new = np.concatenate([[len(hashes) > 0], hashes[1:] != hashes[:-1]])[: len(hashes)]
        heads = np.flatnonzero(new)
        of = np.cumsum(new) - 1
        least = ids[heads]
        kept = ids == least[of]
        self.keys, self.least = hashes[heads], least
        self.of, self.rows, self.places = of[kept], rows[kept], places[kept]
        self.hit = np.zeros(len(heads), bool)
        self.parts = []

    def add(self, kind, runs):
        if kind == BLOCKS:
            self.parts.append(runs)
            return []
        self.index()
        if not len(self.keys):
            return []
        at = np.minimum(np.searchsorted(self.keys, runs.hashes), len(self.keys) - 1)
        same = np.flatnonzero(self.keys[at] == runs.hashes)
        if not len(same):
            return []
        ids, rows, places = runs.windows()
        later = same[self.least[at[same]] < ids[same]]
        self.hit[at[later]] = True
        return [_run_spans(rows[later], places[later])]

    def end(self):
        self.index()
        used = self.hit[self.of] if len(self.of) else np.zeros(0, bool)
        return [(self.rows[used], self.places[used], np.ones(int(used.sum()), np.int64))]


class _Repeats(_Buckets):
    """Windows that also start in a document with a smaller id."""

    def begin(self):
        self.parts = []

    def add(self, kind, runs):
        self.parts.append(runs)
        return []

    def end(self):
        if not self.parts:
            return []
        columns = [(r.hashes, *r.windows()) for r in self.parts]
        hashes, ids, rows, places = (np.concatenate(c) for c in zip(*columns))
        order = np.argsort(hashes)
        ordered = hashes[order]
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        sizes = np.diff(np.append(heads, len(order)))
        least = np.empty_like(ids)
        least[order] = np.repeat(np.minimum.reduceat(ids[order], heads), sizes)
        again = ids > least
        return [_run_spans(rows[again], places[again])]


def met(rows: DataFrame, meeting: _Buckets) -> DataFrame:
    dealt = rows.repartition("bucket").sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(meeting.over, SPANS)


# The two steps


def _low(hashes: np.ndarray) -> np.ndarray:
    return hashes.astype(np.uint32)


def probes(texts: DataFrame, buckets: int) -> DataFrame:
    """Blocks and probing windows of (id, row, text) as rows of ``PACKED``."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, _ in groups(batches):
            hashes, keys, own, places = group.windows(BLOCK, GRAM)
            if not len(hashes):
                continue
            dealt = (keys % np.uint64(buckets)).astype(np.int32)
            ranks = group.ranks()[own]
            least, greatest = equal_groups(hashes, ranks)
            shared = least != greatest
            at = np.flatnonzero(places % BLOCK == 0)
            first, _ = equal_groups(hashes[at], ranks[at])
            at = at[first == ranks[at]]
            parts = [packed(BLOCKS, dealt[at], _low(hashes[at]), own[at], places[at], group)]
            # Of the windows that are shared here, one with the greatest id probes for all.
            at = np.flatnonzero(~shared | (ranks == greatest))
            parts.append(packed(PROBES, dealt[at], _low(hashes[at]), own[at], places[at], group))
            at = np.flatnonzero(shared)
            by_row = (mix(group.rows.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            parts.append(packed(SHARED, by_row[own[at]], None, own[at], places[at], group))
            yield from (part for part in parts if part is not None)

    return texts.mapInArrow(over, PACKED)


def listed(found: DataFrame) -> DataFrame:
    return found.groupBy("row").agg(
        F.collect_list("place").alias("places"), F.collect_list("run").alias("runs")
    )


def _covered(size: int, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    change = np.zeros(size + 1, np.int64)
    np.add.at(change, np.clip(starts, 0, size), 1)
    np.add.at(change, np.clip(stops, 0, size), -1)
    return np.cumsum(change)[:size] > 0


def extensions(candidates: DataFrame, buckets: int) -> DataFrame:
    """Windows of LENGTH words around the candidates of (id, row, text, places, runs)."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, (places, runs) in groups(batches):
            hashes, keys, own, at = group.windows(LENGTH, BLOCK)
            if not len(hashes):
                continue
            of = np.repeat(np.arange(len(places)), np.diff(places.offsets.to_numpy()))
            start = group.bounds[of] + places.flatten().to_numpy()
            # A window that holds the candidate begins up to LENGTH - BLOCK words before it.
            before = np.maximum(start - (LENGTH - BLOCK), group.bounds[of])
            wanted = _covered(len(group.words), before, start + runs.flatten().to_numpy())
            near = wanted[group.bounds[own] + at]
            hashes, keys, own, at = (c[near] for c in (hashes, keys, own, at))
            if not len(hashes):
                continue
            dealt = (keys % np.uint64(buckets)).astype(np.int32)
            ranks = group.ranks()[own]
            least, _ = equal_groups(hashes, ranks)
            again = ranks > least
            sent = ~again
            parts = [packed(PROBES, dealt[sent], hashes[sent], own[sent], at[sent], group)]
            by_row = (mix(group.rows.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
            parts.append(packed(SHARED, by_row[own[again]], None, own[again], at[again], group))
            yield from (part for part in parts if part is not None)

    return candidates.mapInArrow(over, PACKED)


def kept_words(repeats: DataFrame) -> DataFrame:
    """(row, n_removed, part_sha256) of (row, text, places, runs)."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        removed, digests = [], []
        for k, text in enumerate(batch.column("text")):
            words = text.as_buffer().to_pybytes().split()
            starts = batch.column("places")[k].values.to_numpy().astype(np.int64)
            stops = starts + batch.column("runs")[k].values.to_numpy() + LENGTH - 1
            gone = _covered(len(words), starts, stops)
            removed.append(int(gone.sum()))
            digests.append(sha256(b" ".join(compress(words, ~gone))).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column("row"), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
            names=["row", "n_removed", "part_sha256"],
        )

    return map_rows(repeats, rows, "row long, n_removed long, part_sha256 string")


def numbered(docs: DataFrame, tables: Workspace) -> DataFrame:
    """(id, row, text): ``row`` is the id itself, or a number of its own for every row where
    ids are repeated or missing."""
    given = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    if given.groupBy("id").count().where("count > 1 or id is null").isEmpty():
        return given.select("id", F.col("id").alias("row"), "text")
    return tables.written(given.select("id", F.monotonically_increasing_id().alias("row"), "text"))


def of_rows(texts: DataFrame, found: DataFrame, bits: np.ndarray) -> DataFrame:
    """The texts of the rows that ``found`` has, with its columns."""
    some = some_rows(texts.withColumn("doc_id", F.col("row")), bits).drop("doc_id")
    return some.join(listed(found), "row").select("id", "row", "text", "places", "runs")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for every row of docs.

    A word is removed if a window of ``LENGTH`` words that covers it also starts in a
    document with a smaller id; the rest is joined by single blanks.  Rows that share an id
    are documents of their own and none is smaller than the other.  A row with a null id
    loses nothing, and nothing is lost to it.  A null text has no words; texts shorter than
    a window lose nothing.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    tables = Workspace(spark)
    own = numbered(docs, tables)
    # Two bytes a word at least: shorter texts have no window.
    long = F.octet_length("text") >= 2 * LENGTH - 1
    texts = own.where("id is not null").where(long)
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARE + 1)
    hits = tables.written(met(probes(texts, buckets), _Hits(np.uint32)))
    candidates = of_rows(texts, hits, bit_set(hits, "row"))
    again = tables.written(met(extensions(candidates, buckets), _Repeats(np.uint64)))
    parts = kept_words(of_rows(texts, again, bit_set(again, "row")))
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    whole = own.select(
        "id",
        "row",
        F.when(plain == "", 0).otherwise(F.length(plain) - F.length(F.replace(plain, F.lit(" "))) + 1)
        .cast("long")
        .alias("n_words"),
        F.sha2(plain.cast("binary"), 256).alias("whole_sha256"),
    )
    return whole.join(parts, "row", "left").select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("part_sha256", "whole_sha256").alias("kept_sha256"),
    )
