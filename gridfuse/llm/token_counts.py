"""Token counts of a byte-level BPE, most of them without merging.

``whole_tokens`` proves once, on the driver, which strings of the vocabulary are a
pre-token that the tokenizer leaves as a single token.  A pre-token among them
counts 1; only the others are merged.  A text is cut into chunks at each single
space before a non-space: no pre-token crosses such a place, so the count of a
chunk does not depend on its neighbours and is remembered per worker.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from gridfuse.llm.common import map_rows, texts_of

#: Unicode's white space, as code points (fixed values).
SPACES = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
#: A space that is not followed by a non-space, or may not be.
UNEVEN = re.compile(r" (?:\s|$)")
#: Entries of the memory of a worker; it starts anew when full.
REMEMBERED = 500_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def char_class(initial: str) -> str:
    """The code points whose general category begins with ``initial``, as regex ranges."""
    ranges, start = [], None
    for point in range(sys.maxunicode + 2):
        inside = point <= sys.maxunicode and unicodedata.category(chr(point))[0] == initial
        if inside and start is None:
            start = point
        elif not inside and start is not None:
            ranges.append(f"\\U{start:08x}-\\U{point - 1:08x}")
            start = None
    return "".join(ranges)


@cache
def pre_token_pattern() -> re.Pattern:
    letters, numbers = char_class("L"), char_class("N")
    spaces = "".join(f"\\U{point:08x}" for point in SPACES)
    return re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+"
        rf"| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    )


@cache
def chunk_end() -> re.Pattern:
    return re.compile(" (?=[^" + "".join(f"\\U{point:08x}" for point in SPACES) + "])")


@cache
def byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [byte for byte in range(256) if byte not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def spelled(pre_token: str) -> str:
    return pre_token.encode().decode("latin-1").translate(byte_letters())


def whole_tokens(tokenizer: Tokenizer) -> frozenset[str]:
    """The pre-tokens that encode alone as one token; each is tried."""
    bytes_of = {letter: byte for byte, letter in byte_letters().items()}
    special = {token.content for token in tokenizer.get_added_tokens_decoder().values()}
    found = []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        if token in special or not all(letter in bytes_of for letter in token):
            continue
        try:
            text = bytes(bytes_of[letter] for letter in token).decode()
        except UnicodeDecodeError:  # a part of a character is never a pre-token
            continue
        if pre_token_pattern().findall(text) == [text]:
            found.append(text)
    encoded = tokenizer.encode_batch(found, add_special_tokens=False)
    return frozenset(text for text, code in zip(found, encoded) if len(code.ids) == 1)


class TokenCounter:
    """Counts of one worker; ``whole`` from ``whole_tokens`` of the same vocabulary."""

    def __init__(self, path: str, whole: frozenset[str]):
        tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
        self.has_special, self.model, self.whole = bool(special), tokenizer.model, whole
        self.known: dict[str, int] = {}

    def merged(self, chunk: str) -> int:
        total = 0
        for token in pre_token_pattern().findall(chunk):
            total += 1 if token in self.whole else len(self.model.tokenize(spelled(token)))
        return total

    def part(self, text: str) -> int:
        if not text:
            return 0
        plain = UNEVEN.search(text) is None
        chunks = text.split(" ") if plain else chunk_end().split(text)
        total, known = self.merged(chunks[0]), self.known
        for chunk in chunks[1:]:
            count = known.get(chunk)
            if count is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                count = self.merged(" " + chunk)
                if len(chunk) < 64:
                    known[chunk] = count
            total += count
        return total

    def count(self, text: str) -> int:
        if not self.has_special or not self.special.search(text):
            return self.part(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self.part, parts))


@cache
def counter(path: str, whole: frozenset[str]) -> TokenCounter:
    return TokenCounter(path, whole)


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs.

    A null text counts like an empty one: 0 bytes, 0 tokens.  Null ids and repeated
    rows are kept.  A text of any length is counted whole.  An empty table gives no
    rows; other columns are ignored.
    """
    whole = whole_tokens(Tokenizer.from_file(path))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, count = texts_of(batch), counter(path, whole).count
        tokens = [count(text) for text in texts]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                pa.array([len(text.encode()) for text in texts], pa.int64()),
                pa.array(tokens, pa.int64()),
                pa.array([n > limit for n in tokens], pa.bool_()),
            ],
            names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
        )

    return map_rows(docs.select("doc_id", "text"), rows, SCHEMA)
