"""Texts of a megabyte: without a space, of one unclosed tag after another, urls; each operator and stage in time that grows with the text alone."""

import time

import pytest

from lattica.llm import audit, bpe, gbt, media, ngrams, packing, quality, repeats, sharding, simhash, spelling, toxicity, urls, warc

from .helpers import frame

LENGTH = 1_000_000
TEXTS = ["q" * LENGTH, "日" * (LENGTH // 3), "a b " * (LENGTH // 4), "a_" * (LENGTH // 2), "!" * LENGTH, "<" * LENGTH, "a1" * (LENGTH // 2), "x" * 999_999 + "1"]


def timed(df, limit=20):
    start = time.perf_counter()
    n = len(df.collect())
    assert time.perf_counter() - start < limit
    return n


@pytest.fixture(scope="module")
def long(spark):
    df = frame(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(TEXTS)])
    timed(simhash.near_duplicates(df), 120)  # workers and code are warm from here
    return df


def model():
    return toxicity.Model({"bad": 3.0}, {"badly": 3.0}, gbt.constant(0.1), *([__import__("numpy").asarray([0.0, 1.0])] * 2))


@pytest.mark.parametrize(
    "run",
    [
        lambda d: quality.judge(d, gbt.constant(0.9)), sharding.shard_documents, simhash.near_duplicates, simhash.keep_one, lambda d: toxicity.judge(d, model()),
        bpe.round_trip, packing.pack, ngrams.score, repeats.remove_repeats, repeats.without_repeats, lambda d: quality.keep(d, gbt.constant(0.9)), lambda d: toxicity.drop(d, model()),
    ],
    ids="quality shards near_duplicates keep_one toxicity bpe packing ngrams repeats without_repeats quality_stage toxicity_stage".split(),
)
def test_documents(long, run):
    # Merging a word of a megabyte goes through a heap in Python.
    timed(run(long), 60 if run is bpe.round_trip else 20)


def test_words_archives_and_filters(spark, long):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    timed(spelling.variants(long))
    assert timed(audit.interactions(long, labels)) == 600
    pages = long.selectExpr("doc_id as page_id", "'u' as url", "text as html")
    start = time.perf_counter()
    assert timed(warc.archived(pages)) == len(TEXTS) and time.perf_counter() - start < 20


def test_labelled_long_words(spark, long):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(len(TEXTS))], "doc_id long, quality int, toxic int")
    start = time.perf_counter()
    toxicity.fit(long, labels)
    assert time.perf_counter() - start < 20


def test_pages(spark):
    html = ["<script>" * (LENGTH // 8), "<" * LENGTH, "<style>x" + "<script>y" * 100_000, "<p>" * (LENGTH // 3), "<script>a</script>" * 50_000]
    pages = spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id long, html string")
    assert timed(media.page_images(pages)) == len(html)


def test_tags():
    assert media.printed("a<b>c<script x>d<i></script>e<scripts>f<style>g</styles>h<i") == "a c e f g h<i"
    assert media.printed("<script>a<b>") == " a "


def test_urls(spark):
    rows = [(i, f"http://a.net/de/{i}") for i in range(40)] + [(i, f"http://b.com/en/{i}") for i in range(40, 80)] + [(80, "data:" + "x" * LENGTH), (81, "http://c.fr/" + "é" * LENGTH)]
    assert timed(urls.judge(spark.createDataFrame(rows, "page_id long, url string"))) == len(rows)
