"""Small corpora for the tests, and plain-Python versions of the operators."""

import random
import re
from collections import Counter

SF_DIR = "/root/testdata/sf0.001"
#: Columns that operators use inside, as extra columns of the input.
CLASHING = "row long, n long, key string, id long, place long, spans string, held_out string"


def prose(seed, words):
    rnd = random.Random(seed)
    stems = ["ka", "lo", "mi", "nu", "ré", "ßo", "the", "and", "tion", "er"]
    text = []
    for at in range(words):
        word = "".join(rnd.choice(stems) for _ in range(rnd.randint(1, 4)))
        text.append(word.capitalize() + "." if at % 12 == 11 else word)
    return " ".join(text) + "."


def odd_rows():
    """(doc_id, text): nulls, empty and long texts, ties, repeated rows."""
    text = prose(1, 120)
    return [
        (1, text),
        (2, text),
        (2, text),
        (3, None),
        (4, ""),
        (5, " \n\t "),
        (6, "one two"),
        (None, text),
        (None, None),
        (7, prose(2, 60) + "\n" + prose(3, 60)),
        (8, prose(2, 60) + "\n" + prose(4, 40)),
        (9, "ab" * 30_000),
        (10, prose(5, 30_000)),
        (11, "İstanbul ΣΑΣ éte \U0001f600 naïve x \x1c y <|endoftext|> <|startoftext|>"),
        (-5, "x" * 99 + "\n" + "x" * 101),
    ]


def table(spark, rows, extra=True):
    data = [(i, t, "en", None, None if t is None else len(t)) for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(data, schema)
    if extra:
        for column in CLASHING.split(", "):
            name, kind = column.split()
            docs = docs.selectExpr("*", f"cast(null as {kind}) as {name}")
    return docs


def given(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


def texts_of(docs):
    return {row.doc_id: row.text for row in docs.select("doc_id", "text").collect()}


def lower(text):
    return re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", lower(text))


def same_rows(one, other):
    assert Counter(map(repr, one)) == Counter(map(repr, other))
