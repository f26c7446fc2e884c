"""Documents with the awkward cases, and brute-force versions of the operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, fp long, key long, bucket int, size int, _bytes string, _block int, place int, row string, label int, weight double, fold int"


def documents(n: int = 120, seed: int = 5) -> list[tuple]:
    """Texts of few words with copies, near copies, shared passages, odd characters, nulls, empty and long ones, and repeated rows."""
    r = random.Random(seed)
    words = ["the", "of", "stone", "river", "Ümlaut", "naïve", "don't", "x1", "42", "日本", "quick", "brown", "fox", "jumps", "lazy", "dog's", "“quoted”", "end."]
    words += ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(300)]
    passage = " ".join(r.choice(words) for _ in range(60))
    out = []
    for i in range(n):
        text = " ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 30, 80, 200])))
        if i % 5 == 1 and out:
            text = r.choice([t for _, t, *_ in out if t] or [text])
            if i % 10 == 1:
                text = text.replace("e", "E", 1) + " tail"
        if i % 7 == 2:
            text = text[: len(text) // 2] + " " + passage + "\n\n  " + text[len(text) // 2 :]
        out.append((i * 3 % 997, text, "en", "s", len(text)))
    out += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (2002, " \t\n ", "en", "s", 4), (None, "a text whose id is null " * 10, "en", "s", 5), (2003, "word " * 30_000, "en", None, 1), (2004, "x" * 5_000, "en", "s", 1)]
    out += [(2005, "<|endoftext|> in a text, twice <|endoftext|>", "en", "s", 1), (2006, "  two  spaces \n x\t\ty ", "en", "s", 1)]
    return [*out, out[3], out[3], out[10]]


def frame(spark, rows=None, extra=False):
    rows = documents() if rows is None else rows
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        have = {c.split()[0] for c in SCHEMA.split(", ")}
        for c in EXTRA.split(", "):
            name, kind = c.split()
            if name not in have:
                df = df.withColumn(name, F.lit(None).cast(kind))
    return df
