"""Line-first cleaning: rules judge each line, failing lines go, and a document that
loses too much of its text is rejected.

A line with a word fails if

- it is navigation: at least ``SEPARATORS`` of its words are nothing but separators;
- it is cluttered: at least ``CLUTTER`` of its characters are symbols;
- it is boilerplate: phrases of ``PHRASES`` make up at least ``BOILERPLATE`` of its words, or
  it begins as placeholder text does; prose that mentions a phrase is none;
- it lacks an end: no closing mark, and fewer than ``STUB`` words;
- it repeats an earlier line of the document.

Lines without a word are neither kept nor lost.  All work is per document, so there
is no exchange.
"""

from __future__ import annotations

from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from gridfuse.llm.common import map_rows

WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"
LATER = bytes(range(0x80, 0xC0))  # bytes of a character after its first
SYMBOLS = b"#*$%&|<>"
#: Rules of the lines; shares are of words, or of the bytes of words.
SEPARATORS, CLUTTER, STUB = 0.3, 0.1, 3
SEPARATOR_WORDS = frozenset((b"|", b">", b"<", b">>", b"<<", b"-", b"\xc2\xbb", b"\xe2\x80\xa2"))
CLOSING = (b".", b"!", b"?", b'"', b"'", b")", b":", b";", b"\xe2\x80\xa6", b"\xe2\x80\x9d")
PHRASES = (
    b"all rights reserved", b"cookie policy", b"enable javascript", b"lorem ipsum",
    b"privacy policy", b"sign up for our newsletter", b"terms of use",
)
BOILERPLATE, PLACEHOLDER = 0.2, b"lorem ipsum dolor"
#: A document is kept if its lines keep this share of the bytes of its words.
KEPT_SHARE = 0.5
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
REPORT = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_lines_kept long"
)


class Judged(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    base_failed: bool
    kept: bool
    n_lines: int
    n_lines_kept: int
    text: bytes


def word_bytes(line: bytes) -> int:
    return len(line.translate(None, WHITE))


def line_passes(line: bytes, words: list[bytes]) -> bool:
    if sum(word in SEPARATOR_WORDS for word in words) >= SEPARATORS * len(words):
        return False
    size = word_bytes(line)
    if size - len(line.translate(None, WHITE + SYMBOLS)) >= CLUTTER * size:
        return False
    if len(words) < STUB and not words[-1].endswith(CLOSING):
        return False
    lower = line.lower()
    if lower.lstrip(WHITE).startswith(PLACEHOLDER):
        return False
    boilerplate = sum(lower.count(phrase) * len(phrase.split()) for phrase in PHRASES)
    return not boilerplate or boilerplate < BOILERPLATE * len(words)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of five that the text holds twice or more."""
    windows = list(zip(*(words[k:] for k in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    counts, total, covered = Counter(windows), 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + WINDOW - max(at, covered)
            covered = at + WINDOW
    return total


def judge(text: bytes) -> Judged:
    words = text.split()
    lines, seen, duplicates, passed, lost = [], set(), 0, 0, 0
    for line in text.split(b"\n"):
        own = line.split()
        if not own:
            lines.append(line)
            continue
        repeated = line in seen
        duplicates += repeated
        seen.add(line)
        if not repeated and line_passes(line, own):
            lines.append(line)
            passed += 1
        else:
            lost += word_bytes(line)
    repeats = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeats > MOST_REPEATED * len(words)
    left = word_bytes(text) - lost
    n_lines = duplicates + len(seen)
    return Judged(
        len(words),
        len(text.translate(None, WHITE + LATER)),
        len(text) - len(text.translate(None, SYMBOLS)),
        duplicates,
        repeats,
        failed,
        not failed and left >= KEPT_SHARE * (left + lost),
        n_lines,
        passed,
        b"\n".join(lines),
    )


def judged(batch: pa.RecordBatch) -> list[Judged]:
    return [judge((text or "").encode()) for text in batch.column("text").to_pylist()]


def quality_report(docs: DataFrame) -> DataFrame:
    """One row per row of docs with the counts and the verdict.

    A null or empty text has no words, so it fails.  Null ids and repeated rows are
    kept; whole texts are judged.  An empty table gives no rows; other columns are
    ignored.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = judged(batch)
        columns = [batch.column("doc_id").cast(pa.int64())]
        for k, kind in enumerate(REPORT.split(", ")[1:]):
            flag = kind.endswith("boolean")
            columns.append(pa.array([f[k] for f in found], pa.bool_() if flag else pa.int64()))
        return pa.RecordBatch.from_arrays(columns, names=[k.split()[0] for k in REPORT.split(", ")])

    return map_rows(docs.select("doc_id", "text"), rows, REPORT, sliced=True)


def clean_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, every column as it was but for the text, which
    has lost the failing lines.  Null and empty texts are rejected."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = judged(batch)
        texts = pa.array([f.text.decode() for f in found], pa.string())
        at = batch.schema.get_field_index("text")
        cleaned = batch.set_column(at, batch.schema.field(at), texts)
        return cleaned.filter(pa.array([f.kept for f in found], pa.bool_()))

    return map_rows(docs, rows, docs.schema, sliced=True)
