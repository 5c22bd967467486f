"""Packing of tokenized documents into sequences, in order, by dynamic programming.

The documents of a partition form one stream of tokens, in the order of the table.
Cuts may fall after a document, after a sentence, or, in a sentence without an end
for a while, at a coarse grid of tokens.  With ``best[j]`` the least cost of a stream
that is cut at place j,

    best[j] = penalty[j] + min over i of (best[i] + size - (place[j] - place[i])),

where ``place[j] - place[i] <= size``.  The inner term is ``best[i] + place[i]``, less
what depends on j alone, so its minimum over the sliding range comes from a monotone
queue and the whole costs one step per place.  The stream is solved a block of some
dozens of sequences at a time; a block's last sequence stays open and begins the
next block, so padding arises at cuts and, once per partition, at the end.  That end
is padded, or split into lengths that are powers of two and need no padding,
whichever costs less.
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from gridfuse.llm.common import slices, texts_of
from gridfuse.llm.token_counts import SPACES, char_class, spelled

REMEMBERED = 600_000
#: Beyond these code points case, composition and white space need the library itself.
UNUSUAL = re.compile("[^\\t-\\r -~\\xa1-\\u012f\\u0131-\\u024f]")
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)


@cache
def word_pattern() -> re.Pattern:
    letters, numbers = char_class("L"), char_class("N")
    spaces = "".join(f"\\U{point:08x}" for point in SPACES)
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{spaces}{letters}{numbers}]+"
    )


class ChunkIds(dict):
    """Chunk without white space -> its ids as bytes; remembers what it has seen."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, chunk: str) -> bytes:
        ids = [
            token.id
            for word in word_pattern().findall(chunk)
            for token in self.model.tokenize(spelled(word))
        ]
        code = np.array(ids, "<u4").tobytes()
        if len(chunk) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = code
        return code


class WordIds:
    """The ids of a lower-casing word BPE, equal to the library's."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.chunks = ChunkIds(self.tokenizer.model)
        ends = (self.tokenizer.token_to_id(f"{mark}</w>") for mark in ".!?")
        self.sentence_ends = np.array([i for i in ends if i is not None], np.uint32)

    def ids(self, text: str) -> np.ndarray:
        if UNUSUAL.search(text) or self.special.search(text):
            code = self.tokenizer.encode(text, add_special_tokens=False).ids
            return np.array(code, "<u4")
        words = text.lower().split()
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, words)), "<u4")


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


@dataclass(frozen=True)
class Costs:
    """In tokens of padding: what a cut costs within a document, and within a sentence."""

    sentence: int = 8
    inside: int = 32
    grid: int = 16


def cut_places(ids, doc_ends, sentence_ends, size, costs):
    """Sorted places at which the stream may be cut, and the penalty of each; 0 first."""
    sentences = np.flatnonzero(np.isin(ids, sentence_ends)) + 1
    penalty = np.full(len(ids) + 1, -1, np.int64)
    penalty[sentences] = costs.sentence
    penalty[0], penalty[doc_ends] = 0, 0
    places = np.flatnonzero(penalty >= 0)
    step = min(costs.grid, size)
    gaps = np.diff(places)
    for at in np.flatnonzero(gaps > step):
        inner = np.arange(places[at] + step, places[at] + gaps[at], step)
        penalty[inner] = costs.inside
    places = np.flatnonzero(penalty >= 0)
    return places.tolist(), penalty[places].tolist()


def cheapest_cuts(places: list[int], penalty: list[int], size: int) -> list[int]:
    """The places that begin or end a sequence, first and last included."""
    key, back = [0] * len(places), [0] * len(places)
    queue: deque[int] = deque([0])
    for j in range(1, len(places)):
        place = places[j]
        while place - places[queue[0]] > size:
            queue.popleft()
        i = back[j] = queue[0]
        key[j] = own = key[i] + size + penalty[j]  # best[j] + place[j]
        while queue and key[queue[-1]] >= own:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(places) - 1
    while j:
        cuts.append(places[j])
        j = back[j]
    return [0, *cuts[::-1]]


def split_end(length: int, size: int, costs: Costs) -> list[int]:
    """Lengths of the last sequences of a partition."""
    powers = [1 << k for k in reversed(range(length.bit_length())) if length >> k & 1]
    return powers if costs.inside * (len(powers) - 1) < size - length else [length]


class Packer:
    """The open stream of one partition."""

    def __init__(self, sentence_ends, size: int, costs: Costs, block: int, sequence: int):
        self.sentence_ends, self.size, self.costs = sentence_ends, size, costs
        self.block, self.sequence = block * size, sequence
        self.docs: list[tuple] = []  # doc_id, tokens of the document, start, ids from there
        self.held = 0

    def add(self, doc_id, ids) -> list[tuple]:
        self.docs.append((doc_id, len(ids), 0, ids))
        self.held += len(ids)
        return self.solve(last=False) if self.held >= self.block else []

    def solve(self, last: bool) -> list[tuple]:
        if not self.held:
            return []
        ids = np.concatenate([doc[3] for doc in self.docs])
        ends = np.cumsum([len(doc[3]) for doc in self.docs])
        places, penalty = cut_places(ids, ends, self.sentence_ends, self.size, self.costs)
        cuts = cheapest_cuts(places, penalty, self.size)
        if last:
            lengths = split_end(cuts[-1] - cuts[-2], self.size, self.costs)
            cuts[-1:] = (cuts[-2] + np.cumsum(lengths)).tolist()
        else:
            cuts.pop()
        rows, at, begin = [], 0, 0  # the document at hand and where it begins
        for left, right in zip(cuts, cuts[1:]):
            place = left
            while place < right:
                doc_id, total, start, own = self.docs[at]
                stop = min(right, begin + len(own))
                part = own[place - begin : stop - begin]
                row = (doc_id, start + place - begin, stop - place, zlib.crc32(part.tobytes()))
                rows.append((*row, total, self.sequence, place - left))
                place = stop
                if stop == begin + len(own):
                    begin, at = stop, at + 1
            self.sequence += 1
        rest = self.docs[at:]
        if rest:
            doc_id, total, start, own = rest[0]
            used = cuts[-1] - begin
            rest[0] = (doc_id, total, start + used, own[used:])
        self.docs, self.held = rest, len(ids) - cuts[-1]
        return rows


def packed(
    docs: DataFrame,
    path: str,
    end_id: int,
    size: int = 4096,
    costs: Costs = Costs(),
    block: int = 64,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and ``end_id``; a null or empty text is ``end_id`` alone, so
    every row of docs has a piece.  Repeated rows and null ids are packed like any
    other.  A document of any length is cut, never shortened.  ``sequence_id`` is the
    number of the partition times 2**33 plus a count.  An empty table gives no rows;
    other columns are ignored.
    """
    schema = pa.schema([(part.split()[0], pa.int64()) for part in SCHEMA.split(", ")])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        first = TaskContext.get().partitionId() << 33
        packer = Packer(words.sentence_ends, size, costs, block, first)
        end = np.array([end_id], "<u4")

        def table(rows):
            columns = [pa.array(column, pa.int64()) for column in zip(*rows)]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch)):
                rows += packer.add(doc_id, np.concatenate([words.ids(text), end]))
            if rows:
                yield table(rows)
        rows = packer.solve(last=True)
        if rows:
            yield table(rows)

    return docs.select("doc_id", "text").mapInArrow(over, SCHEMA)
