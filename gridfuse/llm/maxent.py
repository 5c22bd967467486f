"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class of word | history) * P(word | class).  The ``TOP`` most
frequent words and the end of a text are classes of their own; any other word belongs to
one of ``SUFFIXES`` classes by its last two bytes.  Within a class a word has its share of
the training tokens, smoothed, with one place for all unknown words.  The class is
predicted by a softmax over features of the two classes before: the last (n-gram), the
one before it (skip), and both together, hashed into ``BUCKETS`` rows.  A last word that
is not a class of its own is a feature by itself too: its hash gives it one of the word
rows of its class, whose number grows with the training tokens, up to ``MOST_UNITS``.

All training text is counted: words, and how often each class follows each pair of
classes.  These counts, a table of at most CLASSES**3 rows, are a sufficient statistic of
the class model, so each distributed gradient step reads them instead of the text; at
most ``GRADIENT_TASKS`` tasks sum the gradients of their histories, blocks of rows are
added in an exchange, and the driver gets one gradient and applies the update.

Word rows are trained after that, with the class features held.  What a row needs is how
often each class follows its words and how often each class is two before: counts that
grow with the corpus until every row is full.  Rows do not meet in a history, so all steps
of a row run in the task that has its counts.

Words are known by 64-bit hashes.  The ``FREQUENT`` most frequent ones and their counts
travel to the tasks; all others meet their counts in a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridfuse.llm.common import Workspace, map_rows
from gridfuse.llm.words import WHITE, Words, find_words, lower_case, mix, text_chunks, word_bytes

TOP, SUFFIXES = 191, 64
CLASSES = TOP + SUFFIXES + 1
END_CLASS = CLASSES - 1
BUCKETS = 4096
FREQUENT = 1 << 18
STEPS, RATE, SMOOTH = 8, 0.15, 0.1
#: Tasks that sum gradients, and blocks of rows in which the sums are added.
GRADIENT_TASKS, GRADIENT_BLOCKS = 64, 16
#: Word rows: one for so many training tokens, and the bounds of their number.  Tasks hold six
#: bytes for each row and class.
TOKENS_A_UNIT, LEAST_UNITS, MOST_UNITS = 128, 1 << 10, 1 << 15
#: Steps of a word row, and the tokens that its prior, the class model, is worth.
UNIT_STEPS, UNIT_PRIOR = 12, 20.0
#: Word rows that are trained together.
UNIT_BLOCK = 256
#: Rows of the weights: bias, one class before, two before, both.
ROWS = 1 + CLASSES + CLASSES + BUCKETS
END_HASH = 0x656E64206F662074
_INSIDE = word_bytes(bytes(WHITE))
SCORED = (
    "row long, doc_id long, held_out boolean, n_tokens long, n_frequent long, log_frequent double, "
    "log_model double, rest array<struct<word:long,n:int>>"
)


@dataclass
class Vocabulary:
    """The frequent words, sorted by hash; ``cls`` is -1 where the suffix decides."""

    hashes: np.ndarray
    counts: np.ndarray
    cls: np.ndarray
    end_count: int


def suffix_classes(data: np.ndarray, words: Words) -> np.ndarray:
    lower = lower_case()[data].astype(np.uint64)
    last = lower[words.stops - 1]
    second = np.where(words.stops - words.starts > 1, lower[words.stops - 2], np.uint64(0))
    return TOP + (mix(second * np.uint64(256) + last) % np.uint64(SUFFIXES)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, cls, n) over all documents; cls by suffix.  Summed per batch before the exchange."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, suffixes = [np.array([END_HASH], np.uint64)], [np.array([END_CLASS])]
        for _, _, data, offsets in text_chunks(batch.column("text")):
            words = find_words(data, offsets, _INSIDE)
            hashes.append(words.hashes)
            suffixes.append(suffix_classes(data, words))
        found, at, n = np.unique(np.concatenate(hashes), return_index=True, return_counts=True)
        n[found == END_HASH] += batch.num_rows - 1
        return pa.RecordBatch.from_arrays(
            [
                pa.array(found.view(np.int64)),
                pa.array(np.concatenate(suffixes)[at].astype(np.int32)),
                pa.array(n.astype(np.int64)),
            ],
            names=["word", "cls", "n"],
        )

    partial = map_rows(docs.select("text"), rows, "word long, cls int, n long")
    return partial.groupBy("word").agg(F.min("cls").alias("cls"), F.sum("n").alias("n"))


def frequent_words(counts: DataFrame) -> Vocabulary:
    """At most ``FREQUENT`` rows reach the driver."""
    end = int(np.uint64(END_HASH).view(np.int64))
    ordered = counts.where(F.col("word") != end).orderBy(F.desc("n"), "word").limit(FREQUENT)
    rows = ordered.select("word", "n").toPandas()
    found = counts.where(F.col("word") == end).first()
    cls = np.full(len(rows), -1, np.int64)
    cls[: min(TOP, len(rows))] = np.arange(min(TOP, len(rows)))
    hashes = rows["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    counted = rows["n"].to_numpy(np.int64)[order]
    return Vocabulary(hashes[order], counted, cls[order], found.n if found else 0)


def classes_of(data, words: Words, vocabulary: Vocabulary):
    """(class of each word, place among the frequent words or -1)."""
    cls, place = suffix_classes(data, words), np.full(len(words.hashes), -1, np.int64)
    if len(vocabulary.hashes):
        at = np.searchsorted(vocabulary.hashes, words.hashes)
        at = np.minimum(at, len(vocabulary.hashes) - 1)
        hit = vocabulary.hashes[at] == words.hashes
        place[hit] = at[hit]
        own = vocabulary.cls[at[hit]]
        cls[hit] = np.where(own >= 0, own, cls[hit])
    return cls, place


def unit_number(tokens: int) -> int:
    """Word rows for so many training tokens: a power of two."""
    wanted = 1 << max(0, tokens // TOKENS_A_UNIT).bit_length()
    return min(max(wanted, LEAST_UNITS), MOST_UNITS)


def units_of(hashes: np.ndarray, cls: np.ndarray, units: int) -> np.ndarray:
    """The word row of each word; ``units``, a row without effect, for classes of one word."""
    each = units // SUFFIXES
    inner = (cls >= TOP) & (cls < END_CLASS)
    own = (mix(hashes) % np.uint64(each)).astype(np.int64)
    return np.where(inner, (cls - TOP) * each + own, units)


def unit_before(unit: np.ndarray, bounds: np.ndarray, units: int) -> np.ndarray:
    """The word row of the word before every word and the end of every text."""
    n, counts = len(bounds) - 1, np.diff(bounds)
    out = np.full(len(unit) + n, units, np.int64)
    # A word stands one place before its follower, and ends take a place for each text.
    out[np.arange(len(unit)) + np.repeat(np.arange(n), counts) + 1] = unit
    return out


def histories(cls: np.ndarray, bounds: np.ndarray):
    """(two before, one before, class, text) for every word and the end of every text."""
    n = len(bounds) - 1
    counts = np.diff(bounds)
    first = bounds[:-1] + np.arange(n)  # with an end after each text
    tokens = np.full(len(cls) + n, END_CLASS, np.int64)
    text = np.repeat(np.arange(n), counts + 1)
    word_at = np.arange(len(cls)) + np.repeat(np.arange(n), counts)
    tokens[word_at] = cls
    one, two = np.roll(tokens, 1), np.roll(tokens, 2)
    one[first] = END_CLASS
    two[first] = END_CLASS
    second = (first + 1)[counts > 0]
    two[second] = END_CLASS
    return two, one, tokens, text


#: The first code of the counts of word rows, behind those of histories.
UNIT_CODES = CLASSES**3


def context_counts(docs: DataFrame, vocabulary: Vocabulary, units: int) -> DataFrame:
    """(code, n): how often each class follows each pair of classes, (two, one, cls) in base
    CLASSES; behind them how often each class follows a word row, and how often each is two
    before where that row is, (row, which of both, cls)."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for _, _, data, offsets in text_chunks(batch.column("text")):
            words = find_words(data, offsets, _INSIDE)
            own = classes_of(data, words, vocabulary)[0]
            two, one, cls, _ = histories(own, words.bounds)
            unit = unit_before(units_of(words.hashes, own, units), words.bounds, units)
            inner = unit < units
            at = UNIT_CODES + unit[inner] * 2 * CLASSES
            pairs = (two * CLASSES + one) * CLASSES + cls
            every = np.concatenate([pairs, at + cls[inner], at + CLASSES + two[inner]])
            found, n = np.unique(every, return_counts=True)
            codes.append(found)
            times.append(n)
        found, at = np.unique(np.concatenate(codes), return_inverse=True)
        n = np.bincount(at, np.concatenate(times), len(found)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["code", "n"])

    partial = map_rows(docs.select("text"), rows, "code long, n long", sliced=True)
    return partial.groupBy("code").agg(F.sum("n").alias("n"))


def feature_rows(two: np.ndarray, one: np.ndarray) -> list[np.ndarray]:
    """For each history the rows of its features in the weights."""
    both = mix((two * CLASSES + one).astype(np.uint64)) % np.uint64(BUCKETS)
    return [
        np.zeros(len(one), np.int64),
        1 + one,
        1 + CLASSES + two,
        1 + 2 * CLASSES + both.astype(np.int64),
    ]


def log_softmax(weights: np.ndarray, features: list[np.ndarray]) -> np.ndarray:
    logits = sum(weights[rows] for rows in features)
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def gradient(blobs: Iterator[bytes], weights: np.ndarray) -> np.ndarray:
    """The gradient of the log likelihood of some (history, cls, n), three integers each."""
    out = np.zeros_like(weights)
    found = np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 3)
    known, at = np.unique(found[:, 0], return_inverse=True)
    for begin in range(0, len(known), 4096):
        history = known[begin : begin + 4096]
        own = (at >= begin) & (at < begin + len(history))
        seen = np.zeros((len(history), CLASSES), np.float32)
        np.add.at(seen, (at[own] - begin, found[own, 1]), found[own, 2])
        features = feature_rows(history // CLASSES, history % CLASSES)
        expected = np.exp(log_softmax(weights, features)) * seen.sum(axis=1, keepdims=True)
        for rows in features:
            np.add.at(out, rows, seen - expected)
    return out


def packed_counts(counts: DataFrame) -> DataFrame:
    """The counts as blobs of integers, dealt by history; a gradient step reads them."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("history", "cls", "n")]
        blob = np.stack([c.astype(np.int64) for c in columns], axis=1).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["counts"])

    return map_rows(counts.repartition(GRADIENT_TASKS, "history"), rows, "counts binary")


def gradient_blocks(blobs: Iterator[bytes], weights: np.ndarray) -> list[tuple[int, np.ndarray]]:
    return list(enumerate(np.array_split(gradient(blobs, weights), GRADIENT_BLOCKS)))


def trained_weights(counts: DataFrame, tables: Workspace) -> np.ndarray:
    """Gradient steps, each over all (history, cls, n); ``counts`` is a written table."""
    spark = counts.sparkSession
    last = (F.col("history") % CLASSES).alias("one")
    pairs = counts.groupBy(last, "cls").agg(F.sum("n").alias("n")).toPandas()
    weights = np.zeros((ROWS, CLASSES), np.float32)
    if not len(pairs):
        return weights
    seen = np.zeros((CLASSES, CLASSES))
    seen[pairs["one"], pairs["cls"]] = pairs["n"]
    share = (seen.sum(axis=0) + SMOOTH) / (seen.sum() + SMOOTH * CLASSES)
    weights[0] = np.log(share)
    # Start from the smoothed share of each class after each class.
    follow = (seen + 5 * share) / (seen.sum(axis=1, keepdims=True) + 5)
    weights[1 : 1 + CLASSES] = np.log(follow) - np.log(share)
    total = seen.sum()
    # The counts have at most CLASSES**3 rows, so a fixed number of tasks holds them.
    packed = tables.written(packed_counts(counts)).coalesce(GRADIENT_TASKS)
    rows = packed.rdd.map(lambda row: bytes(row.counts))
    speed = np.zeros_like(weights)
    for _ in range(STEPS):
        sent = spark.sparkContext.broadcast(weights)  # ROWS * CLASSES numbers
        parts = rows.mapPartitions(lambda part: gradient_blocks(part, sent.value))
        blocks = parts.reduceByKey(np.add, GRADIENT_BLOCKS).collectAsMap()
        step = np.concatenate([blocks[k] for k in range(GRADIENT_BLOCKS)]) / np.float32(total)
        speed += step * step
        weights = weights + np.float32(RATE) * step / np.sqrt(speed + 1e-12)
        sent.unpersist()
    return weights


def class_shares(weights: np.ndarray, one: int) -> np.ndarray:
    """P(class | two before, ``one``) of the class model, one row for each class two before."""
    two = np.arange(CLASSES)
    return np.exp(log_softmax(weights, feature_rows(two, np.full(CLASSES, one))).astype(float))


def unit_steps(seen: np.ndarray, two: np.ndarray, shares: np.ndarray):
    """(weights, normalisers) of some word rows of one class.

    ``seen``: how often each class follows a row's words; ``two``: how often each class is two
    before.  A step follows the gradient, tokens seen less tokens expected, over the larger of
    both.  The prior adds UNIT_PRIOR tokens to each row, dealt as the class model expects.
    """
    sizes = np.maximum(seen.sum(axis=1, keepdims=True), 1)
    weighed = two * (1 + UNIT_PRIOR / sizes)
    target = seen + (two @ shares) * (UNIT_PRIOR / sizes)
    weights = np.zeros_like(target)
    for _ in range(UNIT_STEPS):
        own = np.exp(weights)
        expected = own * ((weighed / (own @ shares.T)) @ shares)
        weights += (target - expected) / np.maximum(np.maximum(target, expected), 1e-12)
    weights = weights.astype(np.float16).astype(float)  # as the tasks hold them
    return weights, np.log(np.exp(weights) @ shares.T)


def trained_units(counts: DataFrame, class_weights: np.ndarray, units: int):
    """Weights (units + 1, CLASSES) of the word rows, and what each adds to the logarithm of the
    normaliser after each class two before; the last row has no effect.

    ``counts``: (code, n) from UNIT_CODES on.  A group has the UNIT_BLOCK * 2 * CLASSES counts of
    UNIT_BLOCK rows at most; blobs of at most six bytes a row and class reach the driver.
    """
    sent = counts.sparkSession.sparkContext.broadcast(class_weights)
    each = units // SUFFIXES

    def rows(table: pa.Table) -> pa.Table:
        code = table.column("code").to_numpy() - UNIT_CODES
        block = int(code[0]) // (UNIT_BLOCK * 2 * CLASSES)
        found = np.zeros(UNIT_BLOCK * 2 * CLASSES)
        found[code - block * len(found)] = table.column("n").to_numpy()
        found = found.reshape(UNIT_BLOCK, 2, CLASSES)
        cls = TOP + (block * UNIT_BLOCK + np.arange(UNIT_BLOCK)) // each
        weights, norms = (np.zeros((UNIT_BLOCK, CLASSES)) for _ in range(2))
        for one in np.unique(cls):
            own = cls == one
            shares = class_shares(sent.value, one)
            weights[own], norms[own] = unit_steps(found[own, 0], found[own, 1], shares)
        blobs = weights.astype(np.float16).tobytes(), norms.astype(np.float32).tobytes()
        return pa.table(
            {
                "block": pa.array([block], pa.int64()),
                "weights": pa.array([blobs[0]], pa.binary()),
                "norms": pa.array([blobs[1]], pa.binary()),
            }
        )

    block = F.expr(f"(code - {UNIT_CODES}) div {UNIT_BLOCK * 2 * CLASSES}")
    blobs = counts.groupBy(block.alias("dealt")).applyInArrow(
        rows, "block long, weights binary, norms binary"
    )
    out = np.zeros((units + 1, CLASSES), np.float16), np.zeros((units + 1, CLASSES), np.float32)
    for row in blobs.collect():
        at = slice(row.block * UNIT_BLOCK, (row.block + 1) * UNIT_BLOCK)
        for table, blob in zip(out, (row.weights, row.norms)):
            table[at] = np.frombuffer(bytes(blob), table.dtype).reshape(-1, CLASSES)
    return out


@dataclass
class Model:
    vocabulary: Vocabulary
    weights: np.ndarray
    #: Of the word rows, and what each adds to the normaliser after each class two before.
    unit_weights: np.ndarray
    unit_norms: np.ndarray
    #: log10 of the mass of each suffix class, for its words.
    class_mass: np.ndarray
    train_tokens: int
    base_mass: float
    _norms: np.ndarray | None = None

    def norms(self) -> np.ndarray:
        """The softmax's normaliser for every history, once per worker."""
        if self._norms is None:
            self._norms = np.zeros(CLASSES * CLASSES, np.float32)
            for begin in range(0, CLASSES * CLASSES, 4096):
                history = np.arange(begin, begin + 4096)
                features = feature_rows(history // CLASSES, history % CLASSES)
                logits = sum(self.weights[rows] for rows in features)
                top = logits.max(axis=1)
                self._norms[begin : begin + 4096] = top + np.log(
                    np.exp(logits - top[:, None]).sum(axis=1)
                )
        return self._norms

    @property
    def units(self) -> int:
        return len(self.unit_weights) - 1

    def class_logs(self, two, one, unit, cls) -> np.ndarray:
        """log10 P(class | history) of each token; ``unit``: the word row of the word before."""
        logits = sum(self.weights[rows, cls].astype(float) for rows in feature_rows(two, one))
        logits += self.unit_weights[unit, cls]
        norms = self.norms()[two * CLASSES + one] + self.unit_norms[unit, two]
        return (logits - norms) / np.log(10)


def fit(train: DataFrame, tables: Workspace) -> tuple[Model, DataFrame]:
    """The model of all texts of ``train``, and the written table (word, cls, n)."""
    counts = tables.written(word_counts(train))
    vocabulary = frequent_words(counts)
    by_class = counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    tokens, types = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in by_class:
        tokens[row.cls], types[row.cls] = row.n, row.v
    n_all, v_all = int(tokens.sum()), int(types.sum())
    # The top words leave their suffix classes.
    top = vocabulary.hashes[vocabulary.cls >= 0].view(np.int64).tolist()
    for row in counts.where(F.col("word").isin(top)).collect() if top else []:
        tokens[row.cls] -= row.n
        types[row.cls] -= 1
    units = unit_number(n_all)
    contexts = tables.written(context_counts(train, vocabulary, units))
    history, cls = F.expr(f"code div {CLASSES}"), F.col("code") % CLASSES
    of_classes = contexts.where(F.col("code") < UNIT_CODES)
    of_classes = of_classes.select(history.alias("history"), cls.alias("cls"), "n")
    weights = trained_weights(of_classes, tables)
    rows = trained_units(contexts.where(F.col("code") >= UNIT_CODES), weights, units)
    mass = np.log10(tokens + SMOOTH * (types + 1))
    base_mass = float(np.log10(n_all + SMOOTH * (v_all + 1)))
    return Model(vocabulary, weights, *rows, mass, n_all, base_mass), counts


def score_batches(docs: DataFrame, model: Model) -> DataFrame:
    """Per document what the frequent words and the classes give, and its other words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = sent.value, TaskContext.get().partitionId() << 33
        logs = np.log10(own.vocabulary.counts + SMOOTH)
        by_suffix = own.vocabulary.cls < 0
        end_log = float(np.log10(own.vocabulary.end_count + SMOOTH))
        kind = pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int32())]))
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for _, _, data, offsets in text_chunks(batch.column("text")):
                words = find_words(data, offsets, _INSIDE)
                n, counts = len(offsets) - 1, np.diff(words.bounds)
                cls, place = classes_of(data, words, own.vocabulary)
                two, one, token, text = histories(cls, words.bounds)
                unit = units_of(words.hashes, cls, own.units)
                unit = unit_before(unit, words.bounds, own.units)
                total = np.bincount(text, own.class_logs(two, one, unit, token), minlength=n)
                owner, hit = words.texts(), place >= 0
                suffix = (cls >= TOP) & (cls < END_CLASS)
                total -= np.bincount(owner[suffix], own.class_mass[cls[suffix]], minlength=n)
                inner = hit & suffix
                total += np.bincount(owner[inner], logs[place[inner]], minlength=n)
                known = np.bincount(owner[hit], logs[place[hit]], minlength=n) + end_log
                n_known = np.bincount(owner[hit], minlength=n) + (own.vocabulary.end_count > 0)
                rest_owner, rest = owner[~hit], words.hashes[~hit].view(np.int64)
                ends = np.cumsum(np.bincount(rest_owner, minlength=n))[:-1]
                for k, values in enumerate((counts + 1, n_known, known, total)):
                    columns[k] += values.tolist()
                for part in np.split(rest, ends):
                    found, times = np.unique(part, return_counts=True)
                    columns[4].append(
                        [{"word": w, "n": t} for w, t in zip(found.tolist(), times.tolist())]
                    )
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), kind)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(row, row + batch.num_rows), pa.int64()),
                    batch.column("doc_id").cast(pa.int64()),
                    batch.column("held_out"),
                    *(pa.array(c, t) for c, t in zip(columns, kinds)),
                ],
                names=[part.split()[0] for part in SCORED.split(", ")],
            )
            row += batch.num_rows

    return docs.select("doc_id", "held_out", "text").mapInArrow(over, SCORED)


def fold(doc_id, folds: int):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def text_scores(docs: DataFrame, folds: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of docs.

    Learns from rows whose fold is not 0.  A null text is empty: one token, its end.  With
    nothing to learn from, every word is unknown and N is 0.  Repeated rows and null ids (fold
    of the empty text) are kept.  An empty table gives no rows; other columns are ignored.
    """
    tables = Workspace(docs.sparkSession)
    marked = docs.select("doc_id", "text", (fold(F.col("doc_id"), folds) == 0).alias("held_out"))
    model, counts = fit(marked.where("not held_out"), tables)
    scored = tables.written(score_batches(marked, model))
    rest = scored.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.n")
    met = rest.join(counts.select("word", F.col("n").alias("c")), "word", "left")
    log = F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))
    sums = met.groupBy("row").agg(
        F.sum(F.col("n") * log).alias("log_rest"),
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known_rest"),
    )
    log_rest = F.coalesce("log_rest", F.lit(0.0))
    return scored.join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_frequent") + F.coalesce("known_rest", F.lit(0))).cast("long").alias("n_known"),
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("log_frequent") + log_rest - F.col("n_tokens") * F.lit(model.base_mass)).alias(
            "base_score"
        ),
        (F.col("log_model") + log_rest).alias("score"),
    )
