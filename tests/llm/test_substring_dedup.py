"""Repeated passages across documents against plain Python."""

import hashlib
import random
import re

import numpy as np
import pytest

from corpus import given, odd_rows, prose, table
from gridfuse.llm import substring_dedup as S
from gridfuse.llm import words as W


def brute(rows, length=50):
    """(doc_id, n_words, n_removed, sha256) of each row."""
    texts = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    least = {}
    for i, words in texts:
        for p in range(len(words) - length + 1):
            key = tuple(words[p : p + length])
            if i is not None:
                least[key] = min(i, least.get(key, i))
    found = []
    for i, words in texts:
        gone = set()
        for p in range(len(words) - length + 1):
            if i is not None and least[tuple(words[p : p + length])] < i:
                gone.update(range(p, p + length))
        kept = b" ".join(w for p, w in enumerate(words) if p not in gone)
        found.append((i, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return found


def check(docs, rows, columns=("doc_id", "n_words", "n_removed", "kept_sha256")):
    found = S.repeated_passages(docs).select(*columns).collect()
    wanted = brute(rows)
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, wanted))
    return wanted


def shared_rows(seed, documents, passages):
    """Documents with passages in common, some short, some cut, some next to each other."""
    rnd = random.Random(seed)
    common = [prose(1000 + seed + k, rnd.randint(20, 140)).split() for k in range(passages)]
    rows = []
    for i in range(documents):
        words = prose(seed * 7919 + i, rnd.randint(0, 120)).split()
        for _ in range(rnd.randint(0, 3)):
            passage = rnd.choice(common)
            a = rnd.randint(0, len(passage) // 3)
            b = len(passage) - rnd.randint(0, len(passage) // 3)
            at = rnd.randint(0, len(words))
            words[at:at] = passage[a:b]
        rows.append((rnd.randint(0, 10**9), rnd.choice([" ", "\n", " \t "]).join(words)))
    return rows


@pytest.mark.parametrize("group", [1 << 24, 3000])
def test_passages_of_random_documents(spark, monkeypatch, group):
    monkeypatch.setattr(S, "GROUP", group)
    monkeypatch.setattr(S, "SHARE", 1 << 13)
    if group < 1 << 24:  # many groups of few documents in a batch
        chunks = S.text_chunks
        monkeypatch.setattr(S, "text_chunks", lambda column: chunks(column, 500))
    rows = shared_rows(group % 97, 120, 8)
    wanted = check(table(spark, rows).repartition(5), rows)
    assert sum(n > 0 for _, _, n, _ in wanted) > 30


def test_hot_passage_and_copies(spark):
    """A passage in a third of the documents, at any place, and a third of equal documents."""
    passage, copy = prose(5, 70), prose(6, 200)
    rows = [(i, f"{prose(i, 1 + i % 30)} {passage} {prose(i + 500, i % 7)}") for i in range(60)]
    rows += [(1000 + i, copy) for i in range(60)] + [(i - 500, prose(9000 + i, 80)) for i in range(60)]
    check(table(spark, rows).repartition(7), rows)


def test_odd_documents(spark):
    rows = odd_rows() + [(20, "w " * 5000), (21, "w " * 60), (22, "w\n" * 49), (23, "w\t" * 50)]
    check(table(spark, rows), rows)


def test_repeated_ids_are_no_smaller(spark):
    text = prose(3, 90)
    rows = [(7, text), (7, text), (7, prose(4, 60) + " " + text), (9, text), (None, text), (5, prose(4, 60))]
    check(table(spark, rows), rows)


def test_no_documents(spark):
    assert S.repeated_passages(table(spark, [])).count() == 0
    rows = [(1, None), (2, "")]
    check(table(spark, rows), rows)


def test_given_documents(spark):
    docs = given(spark)
    wanted = check(docs, [(r.doc_id, r.text) for r in docs.collect()])
    assert any(n for _, _, n, _ in wanted)


def test_a_long_text_is_hashed_in_pieces(monkeypatch):
    """Words and windows do not depend on how many bytes are summed at a time."""
    rng = np.random.default_rng(2)
    data = rng.choice(np.frombuffer(b"abC \n", np.uint8), size=5000)
    data[1000:2500] = ord("x")
    offsets = np.array([0, 900, 900, 3000, 5000])
    inside = W.word_bytes(bytes(W.WHITE))
    whole = W.find_words(data, offsets, inside)
    windows = S.window_hashes(whole.hashes, 50)
    monkeypatch.setattr(W, "PIECE", 64)
    monkeypatch.setattr(S, "PIECE", 64)
    W._powers.cache_clear()
    again = W.find_words(data, offsets, inside)
    W._powers.cache_clear()
    assert (whole.hashes == again.hashes).all() and (whole.bounds == again.bounds).all()
    assert (windows == S.window_hashes(whole.hashes, 50)).all()
