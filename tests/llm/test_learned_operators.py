"""Packing, near duplicates, models and the pipeline."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from corpus import given, odd_rows, prose, table, texts_of, words_of
from gridfuse.llm import maxent, near_dedup, packing, toxicity
from gridfuse.llm.common import Workspace, slices
from gridfuse.llm.components import component_stars

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


# Packing


def check_pieces(docs, size):
    library = Tokenizer.from_file(WORD_BPE)
    wanted = Counter()
    for row in docs.select("doc_id", "text").collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids + [2]
        wanted[row.doc_id, tuple(ids)] += 1
    by_doc = {}
    for (doc_id, ids), n in wanted.items():
        by_doc.setdefault((doc_id, len(ids)), []).append(np.array(ids, "<u4"))
    pieces = packing.packed(docs, WORD_BPE, 2, size).collect()
    covered = Counter()
    for p in pieces:
        covered[p.doc_id] += p.length
        parts = [ids[p.start : p.start + p.length] for ids in by_doc[p.doc_id, p.doc_tokens]]
        assert p.ids_crc32 in {zlib.crc32(part.tobytes()) for part in parts}
    total = Counter()
    for (doc_id, ids), n in wanted.items():
        total[doc_id] += n * len(ids)
    assert covered == total
    lengths = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == lengths.get(p.sequence_id, 0)
        lengths[p.sequence_id] = p.offset + p.length
    assert max(lengths.values(), default=0) <= size
    padded = sum(size - n for n in lengths.values() if n & (n - 1))
    return padded / max(1, sum(lengths.values()))


def test_packing_covers_every_token_once(spark):
    assert check_pieces(given(spark), 4096) < 0.05
    check_pieces(table(spark, odd_rows()), 256)
    assert packing.packed(table(spark, []), WORD_BPE, 2).count() == 0


def test_cuts_are_the_cheapest():
    rnd = random.Random(5)
    for _ in range(60):
        places = sorted(rnd.sample(range(1, 60), 14))
        places = [0, *places]
        penalty = [0, *(rnd.choice([0, 3, 9]) for _ in places[1:])]
        size = max(b - a for a, b in zip(places, places[1:])) + rnd.randint(0, 12)
        cost = dict(zip(places, penalty))

        def price(cuts):
            return sum(size - (b - a) + cost[b] for a, b in zip(cuts, cuts[1:]))

        best = {0: 0}
        for j, place in enumerate(places[1:], 1):
            best[j] = min(
                best[i] + size - (place - places[i]) + penalty[j]
                for i in range(j)
                if place - places[i] <= size
            )
        cuts = packing.cheapest_cuts(places, penalty, size)
        assert cuts[0] == 0 and cuts[-1] == places[-1]
        assert all(b - a <= size for a, b in zip(cuts, cuts[1:]))
        assert price(cuts) == best[len(places) - 1]


# Near duplicates


def sets_of(docs):
    out = {}
    for doc_id, text in docs.items():
        words = words_of(text)
        whole = [tuple(words)] if words else []
        out[doc_id] = set(zip(*(words[k:] for k in range(5)))) if len(words) >= 5 else set(whole)
    return out


def components_by_force(docs):
    sets, root = sets_of(docs), {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    low, high = sorted((find(a), find(b)))
                    root[high] = low
    return {i: (len(sets[i]), find(i), i == find(i)) for i in ids}


def near_rows(docs):
    found = near_dedup.near_duplicates(docs).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found}


def test_near_duplicates(spark):
    docs = given(spark)
    assert near_rows(docs) == components_by_force(texts_of(docs))


def edited(words, changes, seed):
    rnd = random.Random(seed)
    words = list(words)
    for _ in range(changes):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize(("small", "part"), [(1024, 512), (1024, 4), (3, 2)])
def test_documents_with_a_passage_in_common(spark, monkeypatch, small, part):
    """Chains of edits, and short documents that share most of a passage."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    monkeypatch.setattr(near_dedup, "PART", part)
    monkeypatch.setattr(near_dedup, "LEADERS", 2)
    base, passage = prose(7, 150).split(), prose(8, 20)
    texts = {k: edited(base, k % 4, k) for k in range(30)}
    text = " ".join(base)
    for k in range(30, 42):  # a chain: each is near the one before only
        text = edited(text.split(), 3, k)
        texts[k] = text
    for k in range(50, 100):
        texts[k] = f"{prose(k, 2 + k % 9)} {passage} {prose(k + 500, 1 + k % 7)}"
    docs = table(spark, sorted(texts.items(), reverse=True))
    assert near_rows(docs) == components_by_force(texts)


def test_leaders_of_a_bucket_are_chosen_before_the_exchange(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEADERS", 3)
    members = spark.range(1000).select("id", F.expr("if(id % 100 < 99, 7L, id)").alias("key"))
    first = near_dedup.leaders(members)
    assert [r.id for r in first.where("key = 7").orderBy("id").collect()] == [0, 1, 2]
    assert first.where("key <> 7").count() == 10
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("WindowGroupLimit") > plan.rindex("Exchange hashpartitioning")


def test_a_hot_bucket_meets_its_row_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PART", 100)
    members = spark.range(2050).selectExpr(
        "if(id < 2000, 7L, id) as key", "id", "5L as n", "if(id < 2000, 2000L, 1L) as size"
    )
    stars = spark.createDataFrame([(k, 0) for k in range(1, 1500)], "u long, v long")
    found = near_dedup.still_open(members, stars)
    assert found.count() == 2000 and found.where("key <> 7").isEmpty()
    assert [tuple(r) for r in found.select("c", "low").distinct().collect()] == [(2000, 0)]
    parts = near_dedup.in_parts(members, "size").groupBy("key", "part").count()
    assert parts.where("key = 7").count() == 20 and parts.agg(F.max("count")).first()[0] < 200
    each = members.where("id = 0 or id = 2049")
    assert near_dedup.for_parts(each, "size").groupBy("id").count().orderBy("id").collect() == [
        (0, 20),
        (2049, 1),
    ]


def test_near_duplicates_of_odd_rows(spark):
    rows = odd_rows()
    found = near_dedup.near_duplicates(table(spark, rows)).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, _ in rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
    own = {r.doc_id: r for r in found}
    assert own[2].component_id == 1 and not own[2].kept
    for empty in (3, 4, 5):
        assert (own[empty].n_shingles, own[empty].component_id) == (0, empty) and own[empty].kept
    assert own[6].n_shingles == 1
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0


def test_components(spark):
    rnd = random.Random(3)
    links = [(k, k + 1) for k in range(0, 40)]
    links += [(rnd.randrange(100, 160), rnd.randrange(100, 160)) for _ in range(45)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        return x if root[x] == x else find(root[x])

    for a, b in links:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    frame = spark.createDataFrame(links, "u long, v long")
    stars = {r.u: r.v for r in component_stars(frame, Workspace(spark)).collect()}
    assert stars == {k: find(k) for k in root if find(k) != k}


# Toxicity


def test_toxicity_on_held_out_texts():
    rnd = random.Random(1)
    insults = ["dumbhead", "wortless", "trashman", "stupido"]

    def text(seed, toxic):
        words = prose(seed, rnd.randint(20, 200)).split()
        if toxic:
            for _ in range(1 + len(words) // 25):
                words.insert(rnd.randrange(len(words)), rnd.choice(insults))
        return " ".join(words)

    toxic = [text(k, True) for k in range(120)]
    ordinary = [text(1000 + k, False) for k in range(400)]
    model = toxicity.fit_texts(toxic[:80], ordinary[:300], 80 / 380)
    hits = [toxicity.score_text(t, model) >= 0.5 for t in toxic[80:]]
    wrong = [toxicity.score_text(t, model) >= 0.5 for t in ordinary[300:]]
    assert sum(hits) >= 36 and sum(wrong) <= 3


def test_gains_and_thresholds_by_hand():
    """Both dictionaries come from zstandard; gains are differences of compressed lengths."""
    toxic = [f"{prose(k, 40)} dumbhead stupido {prose(k + 50, 9)} wortless" for k in range(60)]
    ordinary = [prose(2000 + k, 60) for k in range(90)]
    model = toxicity.fit_texts(toxic, ordinary, 0.4)
    low = [sorted(t.lower().encode() for t in set(texts)) for texts in (toxic, ordinary)]
    assert b"dumbhead" in model.toxic and model.ordinary == toxicity.trained(low[1])

    def length(piece, content):
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        written = zstandard.ZstdCompressor(
            level=toxicity.LEVEL, dict_data=dictionary, write_content_size=False,
            write_checksum=False, write_dict_id=False,
        ).compress(piece)
        return len(written)

    def gains(text, dictionaries):
        plain, other = dictionaries
        pieces = toxicity.windows(text.lower().encode())
        assert b" ".join(pieces) == text.lower().encode()
        return [length(p, plain) - length(p, other + plain) for p in pieces]

    for text in (toxic[0], ordinary[0], "dumbhead", ""):
        found = toxicity.Gains(model.ordinary, model.toxic).of(text).tolist()
        assert found == gains(text, (model.ordinary, model.toxic))
    usual = []
    for half in (0, 1):
        halves = [sorted(set(texts))[1 - half :: 2] for texts in (toxic, ordinary)]
        pair = toxicity.dictionaries(*([t.lower().encode() for t in texts] for texts in halves))
        usual += [g for text in sorted(set(ordinary))[half::2] for g in gains(text, pair)]
    wanted = [max(float(np.quantile(usual, q)), 1) + k for k, q in enumerate(toxicity.QUANTILES)]
    assert model.thresholds == pytest.approx(wanted)


def test_toxicity_samples_usable_rows(spark):
    """Rows without a usable text take no place in the sample, whatever their hash."""
    rows = [(i, None if i % 3 == 0 else "" if i % 3 == 1 else prose(i, 30)) for i in range(90)]
    labels = spark.createDataFrame([(i, i // 3 % 2) for i in range(90)], "doc_id long, toxic int")
    model = toxicity.fit(table(spark, rows), labels, per_class=15)
    texts = {y: [t for i, t in rows if t and i // 3 % 2 == y] for y in (0, 1)}
    assert model == toxicity.fit_texts(texts[1], texts[0], 0.5)
    assert toxicity.fit(table(spark, rows), labels, per_class=15, longest=10).weights == ()


def test_toxicity_rows(spark):
    docs = table(spark, odd_rows())
    labels = spark.createDataFrame([(1, 1, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    for marked in (labels, labels.limit(0)):
        model = toxicity.fit(docs, marked)
        rows = toxicity.toxicity_scores(docs, model).collect()
        assert len(rows) == len(odd_rows())
        for r in rows:
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
            text = "" if r.doc_id is None else str(r.doc_id)
            assert r.held_out == (zlib.crc32(text.encode()) % 5 == 0)
    assert toxicity.toxicity_scores(table(spark, []), model).count() == 0


# Language model


def counted(docs):
    tokens = {i: words_of(t) + [None] for i, t in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    counts = Counter(w for i in docs if not held[i] for w in tokens[i])
    return tokens, held, counts


@pytest.mark.parametrize("frequent", [1 << 18, 50])
def test_language_model(spark, monkeypatch, frequent):
    """The second case sends most words through the join."""
    monkeypatch.setattr(maxent, "FREQUENT", frequent)
    monkeypatch.setattr(maxent, "STEPS", 3)
    docs = given(spark)
    tokens, held, counts = counted(texts_of(docs))
    total, kinds = sum(counts.values()), len(counts)
    base = model = n_held = 0
    for r in maxent.text_scores(docs).collect():
        own = tokens[r.doc_id]
        wanted = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own)
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[r.doc_id], len(own), total)
        assert r.n_known == sum(counts[w] > 0 for w in own)
        assert r.base_score == pytest.approx(wanted, rel=1e-9)
        if r.held_out:
            base, model, n_held = base + r.base_score, model + r.score, n_held + r.n_tokens
    assert model / n_held > base / n_held + (0.1 if frequent > 50 else -0.05)


def test_language_model_sums_to_one(spark, monkeypatch):
    """Over all words of a small vocabulary, and the place for unknown ones."""
    monkeypatch.setattr(maxent, "STEPS", 2)
    train = table(spark, [(k, "red blue green red blue") for k in range(5)])
    model, _ = maxent.fit(train, Workspace(spark))
    every = np.arange(maxent.CLASSES)
    units = model.units
    for two, one, unit in ((255, 255, units), (255, 0, units), (1, 200, units), (1, 200, 150)):
        model.unit_weights[150] = np.linspace(-1, 1, 256)
        shares = maxent.class_shares(model.weights, 200)
        model.unit_norms[150] = np.log(np.exp(model.unit_weights[150].astype(float)) @ shares.T)
        logs = model.class_logs(*(np.full(256, x) for x in (two, one, unit)), every)
        assert (10**logs).sum() == pytest.approx(1, abs=1e-4)


def test_scores_by_hand(spark, monkeypatch):
    """Every token's softmax over all classes and share in its class, in plain Python."""
    monkeypatch.setattr(maxent, "STEPS", 2)
    monkeypatch.setattr(maxent, "FREQUENT", 20)
    docs = table(spark, [(k, prose(k % 7, 40 + k)) for k in range(30)] + [(90, None)])
    tokens, held, counts = counted(texts_of(docs))
    model, _ = maxent.fit(
        docs.where("crc32(cast(string(doc_id) as binary)) % 10 != 0"), Workspace(spark)
    )

    def look(word):
        data = np.frombuffer(word, np.uint8)
        found = maxent.find_words(data, np.array([0, len(data)]), maxent._INSIDE)
        cls, _ = maxent.classes_of(data, found, model.vocabulary)
        return int(cls[0]), int(maxent.units_of(found.hashes, cls, model.units)[0])

    seen = {w: look(w) for i in tokens for w in tokens[i] if w is not None}
    seen[None] = (maxent.END_CLASS, model.units)
    mass, kinds = Counter(), Counter()
    for w, n in counts.items():
        mass[seen[w][0]] += n
        kinds[seen[w][0]] += 1
    for r in maxent.text_scores(docs).collect():
        total, two, one, unit = 0.0, maxent.END_CLASS, maxent.END_CLASS, model.units
        for w in tokens[r.doc_id]:
            rows = maxent.feature_rows(np.array([two]), np.array([one]))
            logits = sum(model.weights[at].astype(float) for at in rows)[0]
            logits = logits + model.unit_weights[unit].astype(float)
            cls = seen[w][0]
            total += (logits[cls] - np.log(np.exp(logits).sum())) / math.log(10)
            if maxent.TOP <= cls < maxent.END_CLASS:
                total += math.log10((counts[w] + 0.1) / (mass[cls] + 0.1 * (kinds[cls] + 1)))
            two, (one, unit) = one, seen[w]
        assert r.score == pytest.approx(total, rel=1e-4)


def test_contexts_are_counted(spark):
    """Classes after a word row and before it, against plain Python."""
    texts = ["aa bb cc aa bb", "cc", "", "aa bb"]
    docs = table(spark, list(enumerate(texts)))
    none = maxent.Vocabulary(*(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64)), 4)
    end, units, wanted = maxent.END_CLASS, 1 << 10, Counter()
    for text in texts:
        ids = []
        for word in text.split():
            data = np.frombuffer(word.encode(), np.uint8)
            found = maxent.find_words(data, np.array([0, 2]), maxent._INSIDE)
            cls = maxent.suffix_classes(data, found)
            ids.append((int(cls[0]), int(maxent.units_of(found.hashes, cls, units)[0])))
        ids = [(end, units)] * 2 + ids + [(end, units)]
        for (two, _), (one, unit), (cls, _) in zip(ids, ids[1:], ids[2:]):
            wanted[(two * 256 + one) * 256 + cls] += 1
            if unit < units:
                wanted[256**3 + unit * 512 + cls] += 1
                wanted[256**3 + unit * 512 + 256 + two] += 1
    rows = maxent.context_counts(docs, none, units).collect()
    assert {r.code: r.n for r in rows} == wanted


def test_word_rows_learn_what_follows_them():
    """At the end of the steps, tokens seen (with the prior) are the tokens expected."""
    rnd = np.random.default_rng(1)
    shares = rnd.dirichlet(np.ones(256), 256)
    seen, two = np.zeros((2, 256)), np.zeros((2, 256))
    seen[0, [3, 7]] = 300, 100
    two[0, [5, 9, 200]] = 200, 150, 50
    weights, norms = maxent.unit_steps(seen, two, shares)
    share = np.exp(weights[0] - norms[0][:, None]) * shares
    assert share.sum(axis=1) == pytest.approx(1)
    prior = maxent.UNIT_PRIOR / 400
    expected = (two[0] * (1 + prior)) @ share
    assert expected == pytest.approx(seen[0] + prior * two[0] @ shares, rel=0.02, abs=0.02)
    assert not weights[1].any() and norms[1] == pytest.approx(0)


def test_blocks_of_gradients_add_up(spark, monkeypatch):
    """Steps over counts in many tasks are steps over all of them at once."""
    monkeypatch.setattr(maxent, "STEPS", 2)
    rows = [(h, c, 1 + (h * 7 + c) % 5) for h in range(0, 4000, 37) for c in range(0, 250, 41)]
    counts = spark.createDataFrame(rows, "history int, cls int, n long")
    several = maxent.trained_weights(counts, Workspace(spark))
    monkeypatch.setattr(maxent, "GRADIENT_TASKS", 1)
    alone = maxent.trained_weights(counts, Workspace(spark))
    assert np.allclose(several, alone, atol=1e-4)


def test_gradient_is_the_slope_of_the_likelihood():
    rnd = np.random.default_rng(4)
    weights = rnd.normal(size=(maxent.ROWS, maxent.CLASSES)).astype(np.float32) * 0.1
    counts = [(3 * 256 + 5, 7, 4), (3 * 256 + 5, 9, 2), (8 * 256 + 5, 7, 1)]

    def likelihood(w):
        total = 0.0
        for history, cls, n in counts:
            rows = maxent.feature_rows(np.array([history // 256]), np.array([history % 256]))
            total += n * maxent.log_softmax(w.astype(float), rows)[0, cls]
        return total

    slope = maxent.gradient(iter([np.array(counts, np.int64).tobytes()]), weights)
    for row, cls in ((0, 7), (1 + 5, 9), (1 + 256 + 3, 7), (1 + 256 + 8, 100)):
        step = np.zeros_like(weights, float)
        step[row, cls] = 1e-4
        change = (likelihood(weights + step) - likelihood(weights - step)) / 2e-4
        assert slope[row, cls] == pytest.approx(change, abs=1e-3)


def test_language_model_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(maxent, "STEPS", 1)
    rows = maxent.text_scores(table(spark, odd_rows())).collect()
    assert len(rows) == len(odd_rows())
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (3, 4, 5)} == {1}
    assert maxent.text_scores(table(spark, [])).count() == 0
    alone = maxent.text_scores(table(spark, [(4, "held out")])).collect()  # or learnt from itself
    assert len(alone) == 1


# Pipeline


def test_pipeline_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    tables, docs = Workspace(spark), given(spark)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = tables.written(stage(spark, docs, sf_dir))
        seen[name] = (docs, out)
        if name != "packing":
            assert out.columns == docs.columns
            assert out.where("n_chars <> length(text)").count() == 0
        docs = out
    before, after = seen["near_dedup"]
    kept = {i for i, r in components_by_force(texts_of(before)).items() if r[2]}
    assert set(texts_of(after)) == kept
    before, after = seen["decontaminate"]
    assert 0 < after.count() < before.count()
    before, after = seen["personal_data"]
    assert after.where("text like '%@mail%.example.com%'").count() == 0
    assert before.count() == after.count()
    before, after = seen["packing"]
    assert after.agg(F.countDistinct("doc_id")).first()[0] == before.count()


def test_near_dedup_keeps_every_text_of_a_repeated_id(spark):
    one, other = prose(1, 80), prose(2, 80)
    given_rows = [(1, one), (2, one), (2, other), (2, other), (3, other), (None, one), (None, one)]
    for rows in (given_rows, given_rows[:2] + given_rows[4:]):
        docs = table(spark, rows)
        kept = corpus_pipeline.near_dedup(spark, docs, "")
        assert kept.columns == docs.columns
        found = Counter((r.doc_id, r.text) for r in kept.collect())
        first = 2 if (2, other) in rows else 3
        assert found == Counter({(1, one): 1, (first, other): 1, (None, one): 2})


def test_slices_hold_every_row_once(monkeypatch):
    texts = ["x" * (k % 7) * 100 for k in range(500)] + ["y" * 50_000] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    parts = list(slices(batch, 4000))
    assert [t for part in parts for t in part.column("text").to_pylist()] == texts
    assert len(parts) > 20 and len(list(slices(batch))) == 1
    assert list(slices(batch.slice(0, 0))) == []


def test_pipeline_of_odd_rows(spark):
    sf_dir = "/root/testdata/sf0.001"
    for rows in (odd_rows(), []):
        docs = table(spark, rows)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert name == "packing" or out.columns == docs.columns
            docs = Workspace(spark).written(out)
        ids = Counter(r.doc_id for r in docs.select("doc_id").distinct().collect())
        assert (ids == Counter()) == (rows == [])
        assert not rows or (1 in ids and 2 not in ids and None in ids)
