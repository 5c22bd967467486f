"""Operators with one right answer, against plain Python."""

import hashlib
import random
import re
import time
import unicodedata
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpus import given, lower, odd_rows, prose, table, texts_of
from gridfuse.llm import pii, suffix_dedup, token_counts
from gridfuse.llm.decontaminate import contamination
from gridfuse.llm.pii import masked_documents, span_report
from gridfuse.llm.quality import clean_documents, judge, quality_report
from gridfuse.llm.sharding import byte_shards

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


# Token counts


def test_token_counts_equal_the_library(spark):
    library = Tokenizer.from_file(BYTE_BPE)
    for docs in (given(spark), table(spark, odd_rows())):
        found = token_counts.token_counts(docs, BYTE_BPE).collect()
        texts = [r.text or "" for r in docs.select("text").collect()]
        wanted = Counter(
            (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for t in texts
        )
        assert Counter((r.n_bytes, r.n_tokens) for r in found) == wanted
        assert all(r.over_limit == (r.n_tokens > 1024) for r in found)


def test_every_character_is_counted_as_the_library_does():
    library = Tokenizer.from_file(BYTE_BPE)
    counter = token_counts.counter(BYTE_BPE, token_counts.whole_tokens(library))
    points = [p for p in range(0x3100) if unicodedata.category(chr(p)) not in ("Cs", "Cn")]
    points += [0x1F600, 0x4E00, 0xAC00, 0xFF11, 0xFEFF, 0x1D7CE, 0x10FFFF]
    texts = [f"ab{c}{c} {c} cd  {c}9{c}\n {c}" for c in map(chr, points)]
    codes = library.encode_batch(texts, add_special_tokens=False)
    wrong = [hex(p) for p, t, c in zip(points, texts, codes) if counter.count(t) != len(c.ids)]
    assert not wrong


def test_whole_tokens_are_single_tokens():
    library = Tokenizer.from_file(BYTE_BPE)
    whole = token_counts.whole_tokens(library)
    assert len(whole) > 40_000 and " the" in whole and "<|endoftext|>" not in whole


# Shards


def test_shards_are_contiguous_and_even(spark):
    rows = byte_shards(given(spark), shards=7).orderBy("doc_id").collect()
    shards = [r.shard for r in rows]
    assert shards == sorted(shards) and set(shards) == set(range(7))
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    texts = texts_of(given(spark))
    for shard in range(7):
        own = [r for r in rows if r.shard == shard]
        assert [r.slot for r in own] == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / 7) <= largest
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(data) + 16, zlib.crc32(data))


def test_shards_of_odd_rows(spark):
    rows = byte_shards(table(spark, odd_rows()), shards=3).collect()
    assert len(rows) == len(odd_rows())
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(
            range(sum(r.shard == shard for r in rows))
        )
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id in (3, 4)} == {(16, 0)}
    assert byte_shards(table(spark, [])).count() == 0


# Repeated bytes


def removed_by_force(texts):
    seen, out = set(), {}
    for key, text in texts:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for at in range(len(data) - 99):
            part = data[at : at + 100]
            if part in seen:
                gone[at : at + 100] = b"\x01" * 100
            seen.add(part)
        spans = len(re.findall(rb"\x01+", gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[key] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def digest_rows(found):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}


@pytest.mark.parametrize("large", [4096, 1])
def test_repeated_bytes(spark, monkeypatch, large):
    """The second case sends every window of an open group as a row of its own."""
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    docs = given(spark)
    wanted = removed_by_force(sorted(texts_of(docs).items()))
    assert digest_rows(suffix_dedup.repeated_bytes(docs).collect()) == wanted


def test_repeated_bytes_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 5000)  # long texts in pieces
    rows = [(i, t) for i, t in odd_rows() if i != 9 and i != 10]
    rows += [(9, "ab" * 8_000), (10, ("tail " * 40 + rows[0][1]) * 3)]
    found = suffix_dedup.repeated_bytes(table(spark, rows)).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    wanted = removed_by_force([((k, i), t) for k, (i, t) in enumerate(order)])
    have = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
    assert have == Counter((i, *v) for (_, i), v in wanted.items())
    assert suffix_dedup.repeated_bytes(table(spark, [])).count() == 0


# Quality


def quality_by_force(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    counts = Counter(windows)
    hit = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(5)}
    failed = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return (
        len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(hit), failed
    )


def test_quality_counts(spark):
    for docs in (given(spark), table(spark, odd_rows())):
        found = quality_report(docs).collect()
        texts = docs.select("doc_id", "text").collect()
        wanted = Counter((t.doc_id, *quality_by_force(t.text)) for t in texts)
        have = Counter(
            (r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
             r.base_failed) for r in found
        )
        assert have == wanted
        assert not any(r.kept and r.base_failed for r in found)


def test_lines_that_fail_are_removed(spark):
    good = "This sentence has enough ordinary words to be a line of prose."
    more = "Here another sentence follows, and it is ordinary prose as well."
    menu = "home | news | about | contact | login"
    rest = "\n".join(prose(k, 12) for k in range(12))
    text = f"{good}\n{menu}\n{more}\n{good}\nRead our Privacy Policy before you go on.\n{rest}"
    judged = judge(text.encode())
    assert judged.text.decode() == f"{good}\n{more}\n{rest}"
    assert judged.kept and judged.n_dup_lines == 1
    assert not judge("\n".join(f"{menu} {k}" for k in range(9)).encode()).kept
    docs = table(spark, [(1, text), (2, "a | b"), (3, None), (None, good)])
    kept = clean_documents(docs)
    assert kept.columns == docs.columns
    rows = {r.doc_id: r.text for r in kept.collect()}
    assert rows == {1: f"{good}\n{more}\n{rest}", None: good}


def test_prose_that_mentions_a_phrase_is_kept(spark):
    one = prose(1, 60) + " They read the privacy policy twice. " + prose(2, 60)
    several = "\n".join([prose(3, 40), one, prose(4, 40) + " The Terms of Use were short."])
    texts = [one, several]
    for text in texts:
        assert judge(text.encode()).kept and judge(text.encode()).text.decode() == text
    notices = ["All rights reserved.", "Privacy Policy Terms of Use Cookie Policy", "Lorem ipsum dolor " + one]
    for notice in notices:
        assert judge(f"{several}\n{notice}".encode()).text.decode() == several
    docs = table(spark, list(enumerate(texts)))
    assert {r.doc_id: r.text for r in clean_documents(docs).collect()} == dict(enumerate(texts))
    assert quality_report(docs).where("kept and n_lines = n_lines_kept").count() == 2


def test_good_documents_are_kept(spark):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    joined = quality_report(given(spark)).join(labels, "doc_id").where("not base_failed")
    assert joined.where("quality = 1 and not kept").count() == 0
    assert joined.where("quality = 0 and kept").count() <= 1


# Benchmark windows


def alnum_words(text):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def contaminated_by_force(text, items):
    words, hit, found = alnum_words(text), set(), set()
    for item, passage in items:
        own = alnum_words(passage)
        size = min(13, len(own))
        for at in range(len(own) - size + 1) if own else ():
            part = own[at : at + size]
            for k in range(len(words) - size + 1):
                if words[k : k + size] == part:
                    hit |= set(range(k, k + size))
                    found.add(str(item))
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(words), len(hit), len(found), digest, 0 < 20 * len(hit) >= len(words) > 0


def test_contamination(spark):
    passage = " ".join(f"item{k}" for k in range(30))
    rows = odd_rows()[:9] + [
        (20, "Before. " + passage.upper() + " after"),
        (21, " ".join(passage.split()[5:18])),
        (22, " ".join(passage.split()[5:17])),
        (23, "filler " * 500 + passage),
        (24, "it is short phrase indeed, a SHORT-phrase"),
    ]
    items = [(1, passage), (1, passage), (2, " ".join(passage.split()[:20])), (30, "short phrase"),
             (4, None), (5, "..."), (None, passage), (6, "the and")]
    docs = table(spark, rows)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = contamination(docs, benchmark).collect()
    valid = [x for x in items if x[0] is not None]
    wanted = Counter((i, *contaminated_by_force(t, valid)) for i, t in rows)
    have = Counter(
        (r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found
    )
    assert have == wanted
    assert contamination(table(spark, []), benchmark).count() == 0
    assert contamination(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == "ip":
        return all(int(part) <= 255 for part in text.split("."))
    if kind == "card":
        doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
        return 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def spans_by_force(text):
    return [
        f"{kind}:{m.start()}:{m.end()}"
        for kind, pattern in PATTERNS.items()
        for m in re.finditer(pattern, text or "")
        if valid(kind, m[0])
    ]


def test_base_spans(spark):
    rows = odd_rows() + [
        (30, "é a.b@c.d_x@y.zz, @no, a@b a@@b.c x@y-z.co.uk. \U0001f600 +1 (017) 555-7713 +12"),
        (31, "1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 999.1.1.1.1 1..2.3.4 00000000000000000001.2.3.4"),
        (32, "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 5 55555555555555555555 "),
        (33, "+1 +2 (3) 4.5-6 7 8 9 0 1 ++44 20 7946 0958 +4420794609581234567"),
        (34, "a" * 50_000 + " " + "9" * 50_000 + " a@" + "b." * 20_000 + "c"),
    ]
    found = span_report(table(spark, rows)).collect()
    wanted = []
    for doc_id, text in rows:
        spans = spans_by_force(text)
        counts = [sum(s.startswith(kind + ":") for s in spans) for kind in PATTERNS]
        wanted.append((doc_id, *counts, hashlib.sha256(",".join(spans).encode()).hexdigest()))
    have = [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in found]
    assert Counter(have) == Counter(wanted)
    assert span_report(table(spark, [])).count() == 0


def test_contexts_discover_identifiers(spark):
    rows = [(k, f"Wort {k}. My contact number is +49 30 1234 5{k:03d} indeed.") for k in range(30)]
    rows += [(100 + k, f"Text {k}. My contact number is 0301234-7{k:03d} indeed.") for k in range(3)]
    rows += [(200 + k, f"In 2024{k:03d} nothing of this kind was written.") for k in range(5)]
    found = {r.doc_id: r.spans for r in span_report(table(spark, rows)).collect()}
    assert all(found[100 + k] == "ctx_phone:29:41" for k in range(3)), found[100]
    assert all(found[200 + k] == "" for k in range(5))
    assert all(found[k].count(":") == 2 for k in range(30))


def test_contexts_discover_addresses_and_spaced_numbers(spark):
    rows = [(k, f"My contact number is +49 30 1234 5{k:03d} indeed.") for k in range(30)]
    rows += [(50 + k, f"Please write to name{k}@mail.example.com today.") for k in range(30)]
    texts = {
        100: ("My contact number is 0301 234 7000 indeed.", "ctx_phone:21:34"),
        101: ("My contact number is (030) 555-7713 indeed.", "ctx_phone:21:35"),
        102: ("Room 5, my contact number is 030.555.7714, ask.", "ctx_phone:29:41"),
        103: ("Please write to john.doe@localhost today.", "ctx_email:16:34"),
        104: ("Please write to jürgen@büro.", "ctx_email:16:27"),
        105: ("My contact number is 0301234-7000 0301234-700000 indeed.", "ctx_phone:21:33"),
        106: ("My contact number is john.doe@localhost indeed.", ""),
        107: ("In 0301 234 7001 nothing of john.doe@localnet.", ""),
    }
    rows += [(k, text) for k, (text, _) in texts.items()]
    found = {r.doc_id: r.spans for r in span_report(table(spark, rows)).collect()}
    assert {k: found[k] for k in texts} == {k: spans for k, (_, spans) in texts.items()}


def test_many_matches_in_one_text(spark, monkeypatch):
    """Spans and masks across the borders of blocks, and a text of sixteen thousand numbers."""
    rnd = random.Random(6)
    parts = ["a.b@c.de", "10.0.0.1", "4111 1111 1111 1111", "+49 30 123456", "x", "é", "12"]
    rows = [(k, "".join(rnd.choice(parts) + rnd.choice(["", " ", ", "]) for _ in range(60 * k))) for k in range(9)]
    for block in (1, 3, pii.BLOCK):
        monkeypatch.setattr(pii, "BLOCK", block)
        found = {r.doc_id: r for r in pii.personal_data(table(spark, rows)).collect()}
        masked = {r.doc_id: r.text for r in masked_documents(table(spark, rows)).collect()}
        for k, text in rows:
            spans = [f"{s.kind}:{s.start}:{s.stop}" for s in found[k].spans if s.order < 4]
            assert spans == spans_by_force(text)
            out, at = "", 0
            for start, stop, kind in sorted((s.start, s.stop, s.kind) for s in found[k].spans):
                if start >= at:
                    out += text[at:start] + f"[{kind.upper()}]"
                at = max(at, stop)
            assert masked[k] == out + text[at:]
    monkeypatch.undo()
    long = table(spark, [(1, " ".join(f"0301{k:06d}" for k in range(16_000)) + " 10.0.0.1" * 3000)])
    began = time.monotonic()
    row = span_report(long).first()
    assert row.n_ip == 3000 and time.monotonic() - began < 40
    assert masked_documents(long).first().text.endswith("[IP] [IP]")


def test_masking(spark):
    docs = table(spark, [(1, "é a@b.cd and 10.0.0.1."), (2, None), (2, ""), (None, "a@b.cd")])
    masked = masked_documents(docs)
    assert masked.columns == docs.columns
    rows = Counter((r.doc_id, r.text) for r in masked.collect())
    assert rows == Counter(
        [(1, "é [EMAIL] and [IP]."), (2, None), (2, ""), (None, "[EMAIL]")]
    )


def test_native_plans_have_no_python(spark):
    for df in (span_report(given(spark)), byte_shards(given(spark))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_queries_run_over_all_rows(spark):
    from gridfuse.llm.queries import QUERIES

    assert sorted(QUERIES, key=lambda q: int(q[2:].split("_")[0])) == list(
        sorted(QUERIES, key=lambda q: int(re.match(r"op(\d+)_", q)[1]))
    )
    assert {int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES} == set(range(1, 11))
    n = given(spark).count()
    for name in ("op4_token_counts", "op6_quality_rules", "op7_byte_shards", "op9_decontamination"):
        rows = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert rows.select(F.col("doc_id")).distinct().count() == n


def test_queries_equal_their_sql(spark):
    import check_oracle
    from gridfuse.llm.queries import ORACLE, QUERIES

    tables = check_oracle.open_tables("/root/testdata/sf0.001")
    for name, sql in ORACLE.items():
        args = (spark, tables, name, QUERIES[name], sql, "/root/testdata/sf0.001")
        assert check_oracle.compare(*args) is None
