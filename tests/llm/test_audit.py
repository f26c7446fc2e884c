"""The filter audit against plain Python and its SQL."""

import os
import tempfile
from itertools import permutations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from lattica.llm import audit

from .helpers import documents, frame

LABELS = [(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(0, 990, 2)] + [(6, None, 1), (6, 1, None), (None, 1, 1), (2002, 1, 1)]


def sql_rows(sql, **tables):
    con = duckdb.connect()
    with tempfile.TemporaryDirectory() as folder:
        for name, df in tables.items():
            df.write.parquet(os.path.join(folder, name))
            con.execute(f"create table {name} as select * from '{folder}/{name}/*.parquet'")
    return con.execute(sql).fetchall()


def fails(text):
    words = [w for w in "".join(" " if c in "\t\n\x0b\f\r" else c for c in text).split(" ") if w]
    return {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text),
    }


def plain(rows, labels):
    """rows: doc_id, text, source."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good, bad = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    known = [(s or "", i, fails(t or "") | {"E": i is not None and i > first[t or ""]}) for i, t, s in rows]
    out, total = [], {}
    for part in {k[0] for k in known}:
        own = [k for k in known if k[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                here = [k for k in left if k[2][f]]
                left = [k for k in left if not k[2][f]]
                total[part, f] = total.get((part, f), 0) + len(here)
                alone = sum(k[2][f] and sum(k[2].values()) == 1 for k in own)
                out.append((part, "".join(order), step, len(left), len(here), sum(k[2][f] for k in own) - len(here), alone, sum(k[1] in good for k in here), sum(k[1] in bad for k in here)))
    return sorted((*r, total[r[0], r[1][r[2] - 1]]) for r in out)


def tables(spark, rows, extra=False):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    if extra:
        docs = docs.withColumns({c: F.lit("x") for c in ("part", "digest", "fails", "first", "quality", "toxic", "bits", "n", "step")})
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def rows_of(n=150):
    base = [(i, t, s if k % 3 else ["x", "", None, "a b"][k % 4]) for k, (i, t, _, s, _) in enumerate(documents(n))]
    many = [(3000 + k, ("Word other %d " % (k % 7)) * (20 + k % 9) + "$" * (k % 2), "x" if k % 3 else "y") for k in range(60)]
    return [*base, *many, (5000, "　one word\x0btwo", "z"), (5001, "A" * 5 + "日" * 95, "z"), (5002, "A" * 6 + "日" * 94, "z"), (-4, "", "z")]


def test_every_order_of_every_part(spark):
    rows = rows_of()
    want = plain(rows, LABELS)
    for extra in (False, True):
        assert sorted(tuple(r) for r in audit.interactions(*tables(spark, rows, extra)).collect()) == want
    docs, labels = tables(spark, rows)
    assert sorted(sql_rows(audit.SQL, documents=docs, labels=labels)) == want


def test_many_parts_in_small_bitsets(spark, monkeypatch):
    """Parts of one document, bitsets of a few documents, counts handed on early: the sums are the same."""
    monkeypatch.setattr(audit, "ROWS", 13)
    monkeypatch.setattr(audit, "PARTS", 3)
    rows = [(i, t, f"p{(i or 0) % 11}") for i, t, _ in rows_of(60)]
    docs, labels = tables(spark, rows)
    assert sorted(tuple(r) for r in audit.interactions(docs.repartition(3), labels).collect()) == plain(rows, LABELS)


def test_tally_counts_bits():
    r = np.random.default_rng(3)
    part, bits = r.integers(0, 5, 1000), r.integers(0, 128, 1000)
    got = audit.tally(part, bits, 5)
    for k, (s, f) in enumerate(audit._CASES):
        for p in range(5):
            own = [b for b in bits[part == p].tolist() if b >> f & 1 and not b & s]
            assert got[:, k, p].tolist() == [len(own), sum(b >> 5 & 1 for b in own), sum(b >> 6 & 1 for b in own)]


def test_no_documents_and_no_labels(spark):
    docs, labels = tables(spark, rows_of(20))
    assert audit.interactions(docs.limit(0), labels).count() == 0
    assert sorted(tuple(r) for r in audit.interactions(docs, labels.limit(0)).collect()) == plain(rows_of(20), [])
    assert frame(spark).count() > 0
