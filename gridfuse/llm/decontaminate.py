"""Benchmark passages in documents: a prefix-filtered join on rare shingles.

Every window of ``WINDOW`` consecutive words of a benchmark item (all words of a shorter
item) is a set that a document holds or not.  Its shingles of ``SHINGLE`` words are
ordered by rarity, counted over all documents.  As a window must be contained whole, its
necessary prefix is the rarest shingle alone, and a window whose rarest shingle no document
has is dropped.  Documents give up only shingles that may be such a prefix; these meet the
windows in a join on the shingle.  A match must leave room for the whole window on both
sides of the shingle, and its words are then compared one by one.

Two passes over the documents: one counts the benchmark's shingles, one finds matches.
What the passes keep is told by a bit set of a fixed size (``bits``), whatever the
benchmark's size: it only saves rows, the joins decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfuse.llm.bits import bit_set, in_set
from gridfuse.llm.common import Workspace, map_rows, slices
from gridfuse.llm.words import Words, find_words, lower_case, runs, text_chunks, word_bytes

WINDOW, SHINGLE = 13, 4
#: A document is contaminated if so many times its hit words reach its words.
TIMES = 20

_INSIDE = word_bytes(bytes([*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
WINDOWS = "item_id string, key binary, words array<string>, shingles array<long>"
FOUND = (
    "row long, doc_id long, text_key long, n_words long, "
    "places array<struct<shingle:long,place:int,before:int,words:array<string>>>"
)


def word_list(data: np.ndarray, words: Words, first: int, last: int) -> list[str]:
    raw = lower_case()[data[words.starts[first] : words.stops[last - 1]]].tobytes()
    begin = words.starts[first]
    spans = zip(words.starts[first:last] - begin, words.stops[first:last] - begin)
    return [raw[a:b].decode() for a, b in spans]


def item_windows(benchmark: DataFrame) -> DataFrame:
    """One row per window of an item, its shingles in order; none without words."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, out = batch.column("item_id").to_pylist(), []
        for first, _, data, offsets in text_chunks(batch.column("text")):
            words = find_words(data, offsets, _INSIDE)
            hashes = {size: dict(zip(*reversed(runs(words, size)))) for size in range(1, SHINGLE + 1)}
            for text, (low, high) in enumerate(zip(words.bounds[:-1], words.bounds[1:])):
                if low == high:
                    continue
                size = min(WINDOW, high - low)
                width = min(SHINGLE, size)
                own = word_list(data, words, low, high)
                for at in range(high - low - size + 1):
                    part = own[at : at + size]
                    key = blake2b(" ".join(part).encode(), digest_size=16).digest()
                    places = range(low + at, low + at + size - width + 1)
                    shingles = [int(hashes[width][k].view(np.int64)) for k in places]
                    out.append((ids[first + text], key, part, shingles))
        columns = list(zip(*out)) or [()] * 4
        kinds = (pa.string(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays(
            [pa.array(column, kind) for column, kind in zip(columns, kinds)],
            names=["item_id", "key", "words", "shingles"],
        )

    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string"), "text")
    return map_rows(items, rows, WINDOWS)


def wanted_runs(words: Words, widths: list[int], bits: np.ndarray):
    for width in widths:
        hashes, first = runs(words, width)
        keep = in_set(hashes, bits)
        yield hashes[keep], first[keep]


def shingle_counts(docs: DataFrame, widths: list[int], bits: np.ndarray) -> DataFrame:
    """(shingle, n): occurrences in all documents, summed per batch before the exchange."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.zeros(0, np.uint64)]
        for _, _, data, offsets in text_chunks(batch.column("text")):
            words = find_words(data, offsets, _INSIDE)
            found += [hashes for hashes, _ in wanted_runs(words, widths, bits)]
        hashes, counts = np.unique(np.concatenate(found), return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes.view(np.int64)), pa.array(counts.astype(np.int64))],
            names=["shingle", "n"],
        )

    partial = map_rows(docs.select("text"), rows, "shingle long, n long")
    return partial.groupBy("shingle").agg(F.sum("n").alias("n"))


def places_of(docs: DataFrame, widths: list[int], bits: np.ndarray) -> DataFrame:
    """One row per document with its words' number and the places of wanted shingles, each
    with the words around it."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        kind = pa.struct(
            [
                ("shingle", pa.int64()),
                ("place", pa.int32()),
                ("before", pa.int32()),
                ("words", pa.list_(pa.string())),
            ]
        )
        for batch in (part for whole in batches for part in slices(whole)):
            sizes: list[int] = []
            places: list[list] = []
            for first_text, last_text, data, offsets in text_chunks(batch.column("text")):
                words = find_words(data, offsets, _INSIDE)
                own: list[list] = [[] for _ in range(last_text - first_text)]
                texts = words.texts()
                for hashes, first in wanted_runs(words, widths, bits):
                    for h, at in zip(hashes.view(np.int64).tolist(), first.tolist()):
                        text = texts[at]
                        low = max(int(words.bounds[text]), at - WINDOW + 1)
                        high = min(int(words.bounds[text + 1]), at + WINDOW)
                        around = word_list(data, words, low, high)
                        own[text].append((h, at - int(words.bounds[text]), at - low, around))
                sizes += np.diff(words.bounds).tolist()
                places += own
            names = ["shingle", "place", "before", "words"]
            nested = [[dict(zip(names, p)) for p in own] for own in places]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row, row + len(sizes)), pa.int64()),
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("text_key"),
                    pa.array(sizes, pa.int64()),
                    pa.array(nested, pa.list_(kind)),
                ],
                names=["row", "doc_id", "text_key", "n_words", "places"],
            )
            row += len(sizes)

    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(over, FOUND)


def covered(spans: str) -> F.Column:
    """Words covered by an array of (start, size), sorted."""
    return F.expr(
        f"aggregate(sort_array({spans}), struct(0 as stop, 0L as hit), (a, s) -> struct("
        "greatest(a.stop, s.start + s.size) as stop, "
        "a.hit + greatest(0, s.start + s.size - greatest(a.stop, s.start)) as hit), a -> a.hit)"
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated) per row of docs.

    ``text_key`` is Spark's xxhash64 of the text, so that a row is found again by id and key.
    Null and empty texts have no words and no hits; items without words, or with a null
    text or id, have no windows.  Repeated rows and null ids of docs are kept, each judged by
    itself; repeated items count once.  Either table may be empty.  Other columns are
    ignored.
    """
    tables = Workspace(docs.sparkSession)
    windows = tables.written(item_windows(benchmark))
    owners = windows.select("key", "item_id").distinct()
    distinct = windows.groupBy("key").agg(
        F.first("words").alias("window"), F.first("shingles").alias("shingles")
    )
    parts = distinct.select("key", F.posexplode("shingles").alias("ahead", "shingle"))
    found_widths = windows.select(F.least(F.size("words"), F.lit(SHINGLE)).alias("w")).distinct()
    widths = sorted(r.w for r in found_widths.collect())  # SHINGLE numbers at most
    counts = shingle_counts(docs, widths, bit_set(parts, "shingle"))
    rarest = (
        parts.join(counts, "shingle")
        .groupBy("key")
        .agg(
            F.min(F.struct("n", "ahead", "shingle")).alias("rare"), F.count("*").alias("present")
        )
    )
    # All shingles of a window must occur somewhere, else no document has the window.
    prefixes = tables.written(
        distinct.join(rarest, "key")
        .where("present = size(shingles)")
        .select("key", "window", F.col("rare.ahead").alias("ahead"), F.col("rare.shingle").alias("shingle"))
    )
    found = tables.written(places_of(docs, widths, bit_set(prefixes, "shingle")))
    places = found.select("row", F.explode("places").alias("p")).select("row", "p.*")
    hits = tables.written(
        places.join(prefixes, "shingle")
        .where("before >= ahead and before - ahead + size(window) <= size(words)")
        .where("slice(words, before - ahead + 1, size(window)) = window")
        .select(
            "row", (F.col("place") - F.col("ahead")).alias("start"), F.size("window").alias("size"), "key"
        )
    )
    spans = (
        hits.groupBy("row")
        .agg(F.collect_set(F.struct("start", "size")).alias("spans"))
        .select("row", covered("spans").alias("n_hit"))
    )
    items = (
        hits.select("row", "key")
        .distinct()
        .join(owners, "key")
        .select("row", "item_id")
        .distinct()
        .groupBy("row")
        .agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    )
    judged = found.select("row", "doc_id", "text_key", "n_words").join(spans, "row", "left").join(items, "row", "left")
    n_hit, none = F.coalesce("n_hit", F.lit(0)), F.array().cast("array<string>")
    listed = F.coalesce("items", none)
    return judged.select(
        "row",
        "doc_id",
        "text_key",
        "n_words",
        n_hit.cast("long").alias("n_hit"),
        F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", listed).cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (TIMES * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
