"""Toxicity by compression distance: two zstandard dictionaries, one more label.

``fit`` takes a bounded sample of labelled rows.  Both dictionaries are trained by
zstandard: one on ordinary texts, the other on what sets toxic texts apart, their words
with byte sequences much more frequent there than in ordinary texts.  The toxic one
continues the ordinary one, so that ordinary words cost the same under both.  The gain
of a window of text is its length compressed with the ordinary dictionary less that with
the toxic one.  The thresholds are quantiles of the gains of ordinary windows, and a
logistic function of the shares of windows above them gives the score; both are
calibrated on each half of the sample with dictionaries of the other half.

Scoring is one pass over the documents without an exchange; the model, at most 220 kB
whatever the corpus, travels with the function.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfuse.llm.common import map_rows, texts_of

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
GRAM, WINDOW, LEVEL = 6, 128, 9
#: Size of either dictionary in bytes, within which zstandard chooses its content.
DICTIONARY_BYTES = 110_000
#: A sequence is telling if so many pairs of toxic words have it, and so many times as large
#: a share of them as of the ordinary pairs.  A count, so that a small language's qualify.
LEAST_PAIRS, LEAST_ODDS = 16, 12.0
QUANTILES = (0.9, 0.97, 0.99, 0.997)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    thresholds: tuple[float, ...]
    weights: tuple[float, ...]


def windows(text: bytes) -> list[bytes]:
    """The text in pieces of whole words, of ``WINDOW`` bytes or a little more."""
    out, held, size = [], [], 0
    for word in text.split(b" "):
        held.append(word)
        size += len(word) + 1
        if size >= WINDOW:
            piece = b" ".join(held)
            cuts = range(0, len(piece), WINDOW) if len(piece) > 4 * WINDOW else [0]
            out += [piece[k : k + WINDOW] for k in cuts] if len(cuts) > 1 else [piece]
            held, size = [], 0
    if held:
        out.append(b" ".join(held))
    return out


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL,
        dict_data=dictionary,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )


class Gains:
    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary = compressor(ordinary).compress
        self.toxic = compressor(toxic + ordinary).compress

    def of(self, text: str) -> np.ndarray:
        pieces = windows(text.lower().encode())
        return np.array([len(self.ordinary(p)) - len(self.toxic(p)) for p in pieces], float)


@cache
def gains_of(model: Model) -> Gains:
    return Gains(model.ordinary, model.toxic)


def features(gains: np.ndarray, thresholds: tuple[float, ...]) -> list[float]:
    shares = [float((gains >= t).mean()) for t in thresholds]
    return [float(gains.mean()), *shares, float(min(gains.max(), 16)), 1.0]


def score_text(text: str, model: Model) -> float:
    if not model.weights:
        return 0.0
    total = np.dot(features(gains_of(model).of(text), model.thresholds), model.weights)
    return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))


def spaced(word: bytes) -> set[bytes]:
    word = b" " + word + b" "
    return {word[i : i + GRAM] for i in range(max(1, len(word) - GRAM + 1))}


def trained(samples: list[bytes]) -> bytes:
    """A zstandard dictionary, or the samples themselves where they are too few for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-DICTIONARY_BYTES:]


def word_pairs(texts: list[bytes]) -> set[tuple[bytes, bytes]]:
    """The distinct pairs of a word and the one before; so copies of a text count once."""
    pairs: set[tuple[bytes, bytes]] = set()
    for text in texts:
        words = WORD.findall(text)
        pairs.update(zip([b"", *words], words))
    return pairs


def telling_words(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """Words of toxic texts with byte sequences that ordinary texts hardly have."""
    pairs, usual = word_pairs(toxic), word_pairs(ordinary)
    words, in_toxic, in_ordinary = Counter(w for _, w in pairs), Counter(), Counter()
    for counts, of in ((in_toxic, words), (in_ordinary, Counter(w for _, w in usual))):
        for word, n in of.items():
            for gram in spaced(word):
                counts[gram] += n
    factor = (len(usual) + 1) / (len(pairs) + 1)
    telling = {
        g
        for g, n in in_toxic.items()
        if n >= LEAST_PAIRS and (n + 0.5) * factor >= LEAST_ODDS * (in_ordinary[g] + 0.5)
    }
    return {w for w in words if not telling.isdisjoint(spaced(w))}


def distinctive(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """What sets each toxic text apart: its telling words, in their order."""
    telling = telling_words(toxic, ordinary)
    kept = ([w for w in WORD.findall(text) if w in telling] for text in toxic)
    return [b" " + b" ".join(words) + b" " for words in kept if words]


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    return trained(ordinary), trained(distinctive(toxic, ordinary))


def fitted_weights(rows: np.ndarray, labels: np.ndarray, prior: float) -> np.ndarray:
    """Logistic regression, its intercept moved from the sample's odds to ``prior``'s."""
    scale = rows.std(axis=0)
    scale[scale == 0] = 1
    x, w = rows / scale, np.zeros(rows.shape[1])
    for _ in range(3000):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 0.5 * (x.T @ (p - labels) / len(labels) + 1e-4 * w)
    share = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
    w /= scale
    w[-1] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return w


def fit(
    docs: DataFrame,
    labels: DataFrame,
    per_class: int = 2000,
    longest: int = 20_000,
) -> Model:
    """A model from at most ``per_class`` rows of either label.

    ``labels`` has the rows to learn from (doc_id, toxic).  Of those with a usable text, one
    of 1 to ``longest`` bytes, the first by a hash of their id are taken, so the driver
    gets at most 2 * per_class * longest bytes.  Without usable rows of both labels the
    model scores every text 0.
    """
    usable = docs.where((F.octet_length("text") > 0) & (F.octet_length("text") <= longest))
    marked = labels.where("toxic in (0, 1) and doc_id is not null")
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marked = marked.join(usable.select("doc_id"), "doc_id", "left_semi")
    counts = {row.toxic: row["count"] for row in marked.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return Model(b"", b"", (), ())
    order = F.xxhash64("doc_id")
    chosen = [
        marked.where(F.col("toxic") == label).orderBy(order, "doc_id").limit(per_class)
        for label in (0, 1)
    ]
    # At most 2 * per_class ids: a proven bound for the broadcast.
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))
    rows = (
        usable.select("doc_id", "text")
        .join(ids, "doc_id")
        .groupBy("doc_id", "toxic")
        .agg(F.min("text").alias("text"))
        .collect()
    )
    rows.sort(key=lambda row: row.doc_id)
    texts = {y: [row.text for row in rows if row.toxic == y] for y in (0, 1)}
    return fit_texts(texts[1], texts[0], counts[1] / (counts[0] + counts[1]))


def fit_texts(toxic: list[str], ordinary: list[str], prior: float) -> Model:
    """``prior``: the share of toxic rows among all usable ones."""
    toxic, ordinary = sorted(set(toxic)), sorted(set(ordinary))
    if min(len(toxic), len(ordinary)) < 2:
        return Model(b"", b"", (), ())
    lower = {1: [t.lower().encode() for t in toxic], 0: [t.lower().encode() for t in ordinary]}
    seen: list[tuple[np.ndarray, int]] = []
    for half in (0, 1):  # each half is calibrated with dictionaries of the other
        gains = Gains(*dictionaries(lower[1][1 - half :: 2], lower[0][1 - half :: 2]))
        seen += [(gains.of(text), 1) for text in toxic[half::2]]
        seen += [(gains.of(text), 0) for text in ordinary[half::2]]
    usual = np.concatenate([g for g, y in seen if y == 0])
    thresholds = tuple(float(max(np.quantile(usual, q), 1) + k) for k, q in enumerate(QUANTILES))
    x = np.array([features(g, thresholds) for g, _ in seen])
    weights = fitted_weights(x, np.array([float(y) for _, y in seen]), prior)
    both = dictionaries(lower[1], lower[0])
    return Model(*both, thresholds, tuple(map(float, weights)))


def toxicity_scores(docs: DataFrame, model: Model, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs.

    The score depends on the text alone; a null text scores like an empty one.
    ``held_out`` is true where crc32 of the id, as text, is a multiple of ``folds`` (a
    null id: as the empty text).  Repeated rows and null ids are kept.  An empty table gives
    no rows; other columns are ignored.
    """

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = [score_text(text, model) for text in texts_of(batch)]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").cast(pa.int64()),
                batch.column("held_out"),
                pa.array(scores, pa.float64()),
                pa.array([int(s >= 0.5) for s in scores], pa.int32()),
            ],
            names=["doc_id", "held_out", "score", "predicted"],
        )

    held_out = fold(docs["doc_id"], folds) == 0
    return map_rows(docs.select("doc_id", held_out.alias("held_out"), "text"), rows, SCHEMA)


def fold(doc_id, folds: int):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
