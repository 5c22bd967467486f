"""Repeated byte strings of a threshold length, by anchors chosen from their content.

A depth-limited radix sort would order all suffixes through their first ``LENGTH`` bytes,
digit by digit; the groups left after the last digit are exactly the windows of ``LENGTH``
bytes that repeat.  These groups are found here without ordering suffixes by their leading
bytes, since every suffix would be a row of its own.

Instead the first key is chosen by content: of the ``GRAM``-byte strings in a window the
one with the least hash (the leftmost of equals) is its anchor.  Equal windows have equal
anchors at equal places, and neighbouring windows mostly share one, so suffixes travel as
runs of about 30 that share an anchor, one row each.

1. Runs meet by anchor.  A run whose whole content occurs earlier is repeated as a whole
   and done, and so is a run whose anchor no other content has, which is unique.
2. Of the rest, the edges of repeated passages, runs with one anchor meet with their
   bytes, and each of their windows is compared, LENGTH bytes deep.  Where more than
   ``LARGE`` contents share an anchor, their windows travel as rows of their own, keyed by
   anchor and content, so no task holds a large group.

A row is marked when an equal one comes before it in the order of (document, place); whatever
the size of a group, it is read as a sorted stream, and equal runs of a batch are known as
repeats before the exchange.  Contents are compared by 64-bit hashes
among rows with equal 64-bit anchor hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridfuse.llm.bits import bit_set, some_rows
from gridfuse.llm.common import Workspace, map_rows
from gridfuse.llm.words import mix, powers, text_chunks

LENGTH, GRAM, LARGE = 100, 28, 4096
ANCHORS = LENGTH - GRAM + 1  # grams in a window
PIECE = 1 << 21
RUNS = "anchor long, content long, doc_id long, place long"
OPEN = "key long, doc_id long, place long, bytes binary"
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Hashes:
    """Hashes of any parts of some bytes, from prefix sums."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return (self.sums[stops] - self.sums[starts]) * self.down[starts]


def pack(start, ahead, windows):
    """Start of a run, its anchor's distance from there, its number of windows."""
    return (start << 16) | (ahead << 8) | windows


def unpack(place):
    return place >> 16, (place >> 8) & 255, place & 255


def anchors_of_windows(grams: np.ndarray) -> np.ndarray:
    """For each window the place of its least gram; doubling the width of what is compared."""
    least = (grams >> np.uint64(32)).astype(np.uint32)
    place, width = np.arange(len(least), dtype=np.int64), 1
    while width < ANCHORS:
        step = min(width, ANCHORS - width)
        one, other = least[:-step], least[step:]
        later = other < one
        place = np.where(later, place[step:], place[:-step])
        least = np.where(later, other, one)
        width += step
    return place


def runs_of(data: np.ndarray, offsets: np.ndarray):
    """Columns of ``RUNS`` with the number of the text in place of its id, or None."""
    valid = np.zeros(len(data) + 1, np.int64)
    long = np.diff(offsets) >= LENGTH
    if not long.any():
        return None
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, offsets[1:][long] - LENGTH + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid) > 0)
    hashes = Hashes(data)
    at = np.arange(len(data) - GRAM + 1)
    grams = mix(hashes.of(at, at + GRAM))
    anchor = anchors_of_windows(grams)[starts]
    begin = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    first, last = starts[begin], starts[np.append(begin[1:], len(starts)) - 1]
    anchor = anchor[begin]
    ahead = anchor - first
    content = mix(hashes.of(first, last + LENGTH) + ahead.astype(np.uint64) * _ODD)
    text = np.searchsorted(offsets, first, "right") - 1
    place = pack(first - offsets[text], ahead, last - first + 1)
    return grams[anchor], content, text, place


def pieces(data: np.ndarray, offsets: np.ndarray):
    """Runs of texts; a single long text in parts that overlap by a window."""
    if len(offsets) > 2 or len(data) <= PIECE:
        found = runs_of(data, offsets)
        if found is not None:
            yield found
        return
    for begin in range(0, len(data) - LENGTH + 1, PIECE):
        part = data[begin : begin + PIECE + LENGTH - 1]
        found = runs_of(part, np.array([0, len(part)]))
        if found is not None:
            yield *found[:3], found[3] + (begin << 16)


def known_repeats(anchor, content, doc_id, place):
    """The same rows, those with an equal and earlier one among them marked by a negative
    place.  They are repeats for certain, so they need no group: an anchor of their own
    spreads them, and a content that fills whole tables counts once per batch."""
    key = mix(anchor + content * _ODD)
    order = np.lexsort((place, doc_id, key))
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    spread = mix(doc_id[again].view(np.uint64) * _ODD + place[again].view(np.uint64))
    anchor, place = anchor.copy(), place.copy()
    anchor[again] = spread
    place[again] = ~place[again]
    return anchor, content, doc_id, place


def suffix_runs(docs: DataFrame) -> DataFrame:
    """Rows of ``RUNS``; a negative place is the complement of that of a known repeat."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        columns = []
        for first, _, data, offsets in text_chunks(batch.column("text")):
            for anchor, content, text, place in pieces(data, offsets):
                own = ids[first + text]
                columns.append((anchor, content, own, place))
        if not columns:
            return None
        marked = known_repeats(*(np.concatenate(column) for column in zip(*columns)))
        arrays = [pa.array(column.view(np.int64)) for column in marked]
        return pa.RecordBatch.from_arrays(arrays, names=["anchor", "content", "doc_id", "place"])

    return map_rows(docs, rows, RUNS)


def first_digit(runs: DataFrame) -> DataFrame:
    """Runs that repeat an earlier one (``repeated``), and those that stay open."""
    equal = Window.partitionBy("anchor", "content").orderBy("doc_id", "place")
    group = Window.partitionBy("anchor")
    ranked = runs.withColumn("repeated", F.expr("place < 0") | (F.row_number().over(equal) > 1))
    ranked = ranked.withColumn("contents", F.sum(F.expr("if(repeated, 0, 1)")).over(group))
    return ranked.where("repeated or contents > 1").select(
        "anchor",
        "doc_id",
        F.expr("if(place < 0, ~place, place)").alias("place"),
        "repeated",
        F.expr(f"contents > {LARGE}").alias("large"),
    )


def window_keys(anchor, ahead, hashes):
    """What equal windows share: the anchor, its distance, and all bytes."""
    salted = mix(anchor.astype(np.uint64) + ahead.astype(np.uint64) * _ODD)
    return mix(hashes + salted)


def with_bytes(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """Open runs with their bytes; those of large groups window by window."""
    listed = edges.groupBy("doc_id").agg(
        F.collect_list("anchor").alias("anchors"),
        F.collect_list("place").alias("places"),
        F.collect_list("large").alias("larges"),
    )

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keys, ids, places, parts = [], [], [], []
        lists = [batch.column(c) for c in ("doc_id", "anchors", "places", "larges")]
        for k, (_, _, data, offsets) in enumerate(text_chunks(batch.column("text"), 0)):
            doc_id, anchors, own, larges = (column[k].as_py() for column in lists)
            raw = data.tobytes()
            for anchor, place, large in zip(anchors, own, larges):
                start, ahead, windows = unpack(place)
                if not large:
                    keys.append(anchor)
                    ids.append(doc_id)
                    places.append(place)
                    parts.append(raw[start : start + windows + LENGTH - 1])
                    continue
                part = Hashes(data[start : start + windows + LENGTH - 1])
                at = np.arange(windows)
                own_key = np.full(windows, anchor, np.int64)
                found = window_keys(own_key, ahead - at, part.of(at, at + LENGTH))
                keys += found.view(np.int64).tolist()
                ids += [doc_id] * windows
                places += pack(start + at, 0, 1).tolist()
                parts += [None] * windows
        if not keys:
            return None
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys, pa.int64()),
                pa.array(ids, pa.int64()),
                pa.array(places, pa.int64()),
                pa.array(parts, pa.binary()),
            ],
            names=["key", "doc_id", "place", "bytes"],
        )

    return map_rows(texts.join(listed, "doc_id"), rows, OPEN)


def repeats_among(key, place, parts: pa.Array):
    """(row, start, windows) of what repeats within groups of runs, rows in order."""
    first, ahead, windows = unpack(place)
    _, bounds, data = parts.buffers()
    offsets = np.frombuffer(bounds, np.int32)[parts.offset : parts.offset + len(parts) + 1]
    offsets = offsets.astype(np.int64)
    hashes = Hashes(np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]])
    row = np.repeat(np.arange(len(key)), windows)
    step = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = offsets[row] - offsets[0] + step
    found = window_keys(key[row], ahead[row] - step, hashes.of(at, at + LENGTH))
    order = np.argsort(found, kind="stable")
    again = np.zeros(len(row), bool)
    again[order[1:]] = found[order[1:]] == found[order[:-1]]
    hit = np.flatnonzero(again)
    if not len(hit):
        return hit, hit, hit
    begin = np.concatenate([[True], (np.diff(hit) > 1) | (row[hit[1:]] != row[hit[:-1]])])
    heads = hit[begin]
    return row[heads], first[row[heads]] + step[heads], np.diff(np.append(np.flatnonzero(begin), len(hit)))


def last_digits(opened: DataFrame) -> DataFrame:
    """(doc_id, place) of open runs, or parts of them, that repeat earlier windows."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = None, None  # rows of a group that may go on; key of the last single window
        for batch in batches:
            table = pa.Table.from_batches([batch])
            single = pa.compute.is_null(table["bytes"])
            alone, rest = table.filter(single), table.filter(pa.compute.invert(single))
            out = []
            if len(alone):
                key = alone["key"].to_numpy()
                before = np.concatenate([[key[0] - 1 if last is None else last], key[:-1]])
                out.append(alone.filter(pa.array(key == before)).select(["doc_id", "place"]))
                last = key[-1]
            if held is not None:
                rest = pa.concat_tables([held, rest])
            if len(rest):
                key = rest["key"].to_numpy()
                whole = int(np.searchsorted(key, key[-1]))
                held, rest = rest.slice(whole), rest.slice(0, whole)
                out += resolved(rest)
            for found in out:
                yield from found.to_batches()
        if held is not None:
            for found in resolved(held):
                yield from found.to_batches()

    by_key = opened.repartition("key").sortWithinPartitions("key", "doc_id", "place")
    return by_key.mapInArrow(over, "doc_id long, place long")


def resolved(rows: pa.Table) -> list[pa.Table]:
    if not len(rows):
        return []
    parts = rows["bytes"].combine_chunks()
    parts = parts.chunk(0) if isinstance(parts, pa.ChunkedArray) else parts
    ids = rows["doc_id"].to_numpy()
    row, start, windows = repeats_among(rows["key"].to_numpy(), rows["place"].to_numpy(), parts)
    return [pa.table({"doc_id": ids[row], "place": pack(start, np.int64(0), windows)})]


def removed_parts(texts: DataFrame, repeats: DataFrame) -> DataFrame:
    """Per document with repeats: removed bytes, maximal removed runs, digest of the rest."""
    listed = repeats.groupBy("doc_id").agg(F.collect_list("place").alias("places"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for k, (_, _, data, _) in enumerate(text_chunks(batch.column("text"), 0)):
            start, _, windows = unpack(batch.column("places")[k].values.to_numpy())
            change = np.zeros(len(data) + 1, np.int64)
            np.add.at(change, start, 1)
            np.add.at(change, start + windows + LENGTH - 1, -1)
            gone = np.cumsum(change)[:-1] > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            out.append((int(gone.sum()), spans, sha256(data[~gone].tobytes()).hexdigest()))
        n_removed, n_spans, digests = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(n_removed, pa.int64()),
                pa.array(n_spans, pa.int64()),
                pa.array(digests, pa.string()),
            ],
            names=["doc_id", "n_removed", "n_spans", "part_sha256"],
        )

    schema = "doc_id long, n_removed long, n_spans long, part_sha256 string"
    return map_rows(texts.join(listed, "doc_id"), rows, schema)


def numbered(docs: DataFrame, tables: Workspace) -> DataFrame:
    """docs with ``own_id``, the id as given, and a ``doc_id`` that no two rows share."""
    given = docs.select(F.col("doc_id").cast("long"), "text")
    ids = given.groupBy("doc_id").count().where("count > 1 or doc_id is null")
    if ids.isEmpty():
        return given.withColumn("own_id", F.col("doc_id"))
    ordered = given.repartitionByRange("doc_id", "text").sortWithinPartitions("doc_id", "text")
    number = F.monotonically_increasing_id()
    return tables.written(ordered.select(number.alias("doc_id"), "text", F.col("doc_id").alias("own_id")))


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs.

    A byte is removed if a string of ``LENGTH`` bytes that covers it also starts earlier: in a
    document with a smaller id, or before in the same.  Rows that share an id, or have none,
    count as documents of their own, ordered by text, null ids first.  A null text is
    empty; texts shorter than ``LENGTH`` lose nothing.  An empty table gives no rows;
    other columns are ignored.
    """
    tables = Workspace(docs.sparkSession)
    own = numbered(docs, tables)
    texts = own.select("doc_id", "text").where(F.octet_length("text") >= LENGTH)
    first = tables.written(first_digit(suffix_runs(texts)))
    edges = first.where("not repeated").select("anchor", "doc_id", "place", "large")
    opened = with_bytes(edges, some_rows(texts, bit_set(edges, "doc_id")))
    inner = last_digits(opened)
    repeats = tables.written(
        first.where("repeated").select("doc_id", "place").unionByName(inner)
    )
    parts = removed_parts(some_rows(texts, bit_set(repeats, "doc_id")), repeats)
    whole = own.select(
        "doc_id",
        "own_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("whole_sha256"),
    )
    return whole.join(parts, "doc_id", "left").select(
        F.col("own_id").alias("doc_id"),
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        F.coalesce("part_sha256", "whole_sha256").alias("kept_sha256"),
    )
