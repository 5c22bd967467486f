"""The prefix trie of conversations against plain Python."""

import hashlib
import random
import zlib

import pytest

from corpus import SF_DIR
from gridfuse.llm.conversations import RESULT, prefix_trie


def brute(rows):
    """The trie of (conv_id, turn, role, text) rows, node by node."""
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            named = f"{len(role or '')}:{role or ''}{text or ''}"
            key = (turn is not None, turn or 0, hashlib.md5(named.encode()).hexdigest())
            turns.setdefault(c, []).append((key, (role or "", text or "")))
    turns = {c: [t for _, t in sorted(own)] for c, own in turns.items()}
    whole = {}
    for c, own in turns.items():
        shared = zlib.crc32(str(c).encode()) % 6
        base = int(c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100)))
        whole[c] = tuple(turns.get(base, [])[:shared] + own[shared:])
    members = {}
    for c, path in whole.items():
        for depth in range(len(path) + 1):
            members.setdefault(path[:depth], []).append(c)
    found = []
    for node, own in members.items():
        depth, below = len(node), [u for u in members if u[: len(node)] == node]
        with_child = {u[:-1] for u in below if u}
        ends = ",".join(str(c) for c in sorted(c for c in own if len(whole[c]) == depth))
        found.append(
            (
                min(own),
                depth,
                min(members[node[:-1]]) if node else None,
                len(own),
                sum(len(u) == depth + 1 for u in below),
                sum(u not in with_child for u in below),
                sum((len(members[u]) - 1) * len(u[-1][1]) for u in below if u),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return found


def table(spark, rows):
    schema = "conv_id long, turn long, role string, text string, id long, place int, key string"
    return spark.createDataFrame([(*r, 5, 1, "k") for r in rows], schema).repartition(5)


def check(spark, rows):
    found = prefix_trie(table(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute(rows)))


@pytest.mark.parametrize("seed", range(4))
def test_tries_of_random_conversations(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(450), 60):
        for turn in range(rnd.randint(1, 9)):
            rows.append((c, turn, rnd.choice(["user", "bot"]), rnd.choice(["a", "bé", "ccc\U0001f600"])))
    check(spark, rows)


def test_copies_and_a_long_conversation(spark):
    """A third of the rows in one conversation, a third in copies of one."""
    rows = [(250, turn, "u", f"text {turn % 7}") for turn in range(400)]
    rows += [(c, turn, "u", "same") for c in range(1000, 1130) for turn in range(3)]
    rows += [(c, turn, "u", f"{c}") for c in range(300, 420) for turn in range(3)]
    check(spark, rows)


def test_odd_conversations(spark):
    rows = [
        (None, 1, "u", "nobody"), (1, None, "u", "first"), (1, 1, "u", "x"), (1, 1, "u", "x"),
        (1, 1, "a", "y"), (1, 1, None, None), (1, None, None, "z"), (2, 5, "", ""), (3, 5, None, ""),
        (-7, 0, "u", "x"), (-107, 0, "u", "x"), (100, 0, "ab", "c"), (100, 1, "a", "bc"),
        (101, 0, "u", "y" * 200_000), (102, 0, "u", "y" * 200_000), (104, 0, "u", "q"), (0, 0, "u", "q"),
    ]
    rows += [(c, 0, "u", "only turn") for c in range(200, 260)]
    check(spark, rows)


def test_turnless_conversations_are_members_of_the_root(spark):
    rows = [(c, 0, "u", "t") for c in range(601, 640)]
    found = prefix_trie(table(spark, rows)).where("depth = 0").collect()
    assert found[0].n_convs == 39
    check(spark, rows)


def test_no_conversations(spark):
    for rows in ([], [(None, 0, "u", "x")]):
        found = prefix_trie(table(spark, rows))
        assert found.columns == RESULT and found.count() == 0


def test_given_conversations(spark):
    turns = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    found = prefix_trie(turns).collect()
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in turns.collect()]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, brute(rows)))
