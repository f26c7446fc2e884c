"""Spelling variants against plain Python over all pairs, and their SQL."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lattica.llm import spelling

from .helpers import documents, frame
from .test_audit import sql_rows


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    words, forms, near = plain_words(rows), {}, {}
    for w, n in words.items():
        close = [(-m, v) for v, m in words.items() if one_apart(w, v)]
        near[w] = len(close)
        if close and -min(close)[0] >= 2 * n:
            forms[w] = min(close)
    out = []
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root][1]
        out.append((w, forms[w][1] if w in forms else None, root, n, near[w], -forms[w][0] if w in forms else None))
    return sorted(out, key=str)


def found(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def dense(seed, n=400, size=60):
    """Words of few letters and of runs of one letter, so that most have several neighbours and chains of forms."""
    r = random.Random(seed)
    words = ["".join(r.choice("aabé") for _ in range(r.randint(4, 8))) for _ in range(50)] + ["a" * k for k in range(4, 12)] + ["aaaaab", "abbbbb", "Àbcdef", "àbcdef", "ab×cdef", "ABCDEF", "日abcde"]
    weight = [1.6 ** -(i % 17) for i in range(len(words))]
    return [(i - 20, r.choice([" ", "\n", "-7 "]).join(r.choices(words, weight, k=size))) for i in range(n)] + [(None, "abcdef " * 9), (None, None), (3, ""), (3, None), (7, "x" * 9 + " ")]


def test_words_and_forms(spark):
    for rows in ([(r[0], r[1]) for r in documents(300)], dense(1), dense(2, 900, 25)):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = found(spelling.variants(df))
        assert got == plain(rows)
    assert any(r[2] != (r[1] or r[0]) for r in got) and max(r[4] for r in got) > 5


def test_sql(spark):
    df = spark.createDataFrame(dense(4), "doc_id long, text string")
    assert sorted(sql_rows(spelling.SQL, documents=df), key=str) == found(spelling.variants(df))


def test_other_columns_and_no_rows(spark):
    rows = [(r[0], r[1]) for r in documents(150)]
    from pyspark.sql import functions as F

    clash = frame(spark, extra=True).withColumns({c: F.lit("x") for c in ("word", "n", "wid", "first", "last", "form", "root", "n_near", "best")})
    assert found(spelling.variants(clash)) == plain([(r[0], r[1]) for r in documents()])
    assert found(spelling.variants(spark.createDataFrame([], "doc_id long, text string"))) == []
    assert found(spelling.variants(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"))) == []
    assert plain(rows)


def test_parts_of_a_vocabulary_add_up(spark, monkeypatch):
    rows = dense(5, 200)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(spelling, "HELD", 7)
    assert {(r["word"], r["n"]) for r in spelling.vocabulary(df).collect()} == set(plain_words(rows).items())


@pytest.mark.parametrize("words", [["a"], ["aaaa", "ab", "ba", "aab"], ["xyzzy", "ÿÿq", "plugh"] * 50])
def test_keys_of_deletions(words):
    texts = [w.encode("latin-1") for w in words]
    key, first, last, row = spelling.deletion_keys(np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([len(t) for t in texts]))
    strings = {}
    for k, a, b, r in zip(key.tolist(), first.tolist(), last.tolist(), row.tolist(), strict=True):
        s = words[r] if a < 0 else words[r][:a] + words[r][a + 1 :]
        assert a < 0 or words[r][:b] + words[r][b + 1 :] == s
        strings.setdefault(k, set()).add(s)
    assert all(len(s) == 1 for s in strings.values())
    assert {s for x in strings.values() for s in x} == {w for w in words} | {w[:i] + w[i + 1 :] for w in words for i in range(len(w))}


def test_strings_decide_where_keys_collide():
    """Two pairs under one key: each finds its own."""
    got = sorted(spelling.neighbours([(0, 0, 1, 9, "xabcd"), (0, 0, 2, 5, "yabcd"), (4, 4, 3, 7, "pqrsx"), (-1, -1, 4, 8, "pqrs")]))
    assert got == [(1, 1, 5, "yabcd"), (2, 1, 9, "xabcd"), (3, 1, 8, "pqrs"), (4, 1, 7, "pqrsx")]


def test_very_long_words(spark):
    """Words of a hundred thousand letters, one apart, and one of a single letter throughout: rows of numbers only."""
    long = "".join(chr(97 + i * i % 23) for i in range(100_000))
    rows = [(i, " ".join([long] * 4 + [long[:500] + long[501:]] + ["z" * 60_000, "z" * 59_999 + "q"])) for i in range(100, 103)]
    assert found(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_a_changed_run_that_becomes_another_changed_run(spark):
    def hit(doc_id, run):
        return zlib.crc32(f"{doc_id}:{run}".encode()) % 97 == 0

    doc_id = next(i for i in range(1_000_000) if hit(i, "a" * 9) and hit(i, "a" * 8))
    rows = [(doc_id, " ".join(["a" * 9] * 3 + ["a" * 8] * 4 + ["a" * 7] * 5))]
    assert spelling.words_of(*rows[0]) == {b"a" * 8: 3, b"a" * 7: 9}
    assert found(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)
