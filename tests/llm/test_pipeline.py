"""Each stage of the pipeline against brute force on its own input, and the whole on awkward and on empty tables."""

from collections import Counter

import numpy as np
import pytest

from lattica.llm import quality, toxicity

from .helpers import documents, frame
from .test_operators import kept_of, plain_removed, plain_statistics

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def folder(spark, tmp_path, docs, labels):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def written(spark, df, path):
    df.write.parquet(str(path))
    return spark.read.parquet(str(path))


def test_stages(spark, tmp_path):
    r = np.random.default_rng(8)
    docs = frame(spark, extra=True)
    sf = folder(spark, tmp_path, docs, [(int(i), int(i % 9 > 0), int(r.random() < 0.05)) for i in range(0, 990)] + [(None, 0, 1)])
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality rules", "toxicity", "simhash near-duplicates", "suffix-array repeats", "packing"]
    labels = spark.read.parquet(f"{sf}/labels.parquet")

    source = spark.read.parquet(f"{sf}/documents.parquet")
    one = written(spark, steps["quality rules"](spark, source, sf), tmp_path / "1")
    assert one.columns == docs.columns
    kept = Counter(x["doc_id"] for x in quality.judge(source, quality.fit(source, labels)).filter("kept").collect())
    assert Counter(x["doc_id"] for x in one.collect()) == kept
    assert all(plain_statistics(x["text"])[0] >= 50 for x in one.collect())

    two = written(spark, steps["toxicity"](spark, one, sf), tmp_path / "2")
    assert Counter(x["doc_id"] for x in two.collect()) == Counter(x["doc_id"] for x in toxicity.judge(one, toxicity.fit(one, labels)).filter("predicted = 0").collect())

    three = written(spark, steps["simhash near-duplicates"](spark, two, sf), tmp_path / "3")
    assert Counter(x["doc_id"] for x in three.collect()) == kept_of([(x["doc_id"], x["text"]) for x in two.collect()])

    four = written(spark, steps["suffix-array repeats"](spark, three, sf), tmp_path / "4")
    rows = [(x["doc_id"] if x["doc_id"] is not None else 1 << 61, x["text"].encode()) for x in three.collect()]
    left = {i: np.frombuffer(t, dtype=np.uint8)[~gone].tobytes().decode("utf-8", "ignore") for (i, t), gone in zip(rows, plain_removed(rows))}
    assert {x["doc_id"] if x["doc_id"] is not None else 1 << 61: (x["text"], x["n_chars"]) for x in four.collect()} == {i: (t, len(t)) for i, t in left.items() if t.strip()}
    assert four.columns == docs.columns

    five = steps["packing"](spark, four, sf).collect()
    assert {x["doc_id"] for x in five} == {x["doc_id"] for x in four.collect()}
    assert Counter(x["doc_id"] for x in corpus_pipeline.run(spark, sf).collect()) == Counter(x["doc_id"] for x in five)


def test_nothing_goes_through(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, frame(spark, []), [])).count() == 0
    assert len(documents()) > 100
