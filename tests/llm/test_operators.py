"""The operators against brute force, on tables with nulls, empty and long texts, copies and repeated rows."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import bpe, gbt, media, ngrams, packing, quality, queries, repeats, sharding, simhash, splitters, toxicity, urls

from .helpers import documents, frame


@pytest.fixture(params=[False, True], ids=["plain", "extra columns"])
def docs(spark, request):
    return frame(spark, extra=request.param).repartition(3)


@pytest.fixture
def none(spark):
    return frame(spark, [])


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


# 1


def plain_statistics(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if __import__("re").search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)]


def test_statistics_of_texts():
    for _, text, *_ in [*documents(), (0, "a b c a b c a\nx\nx\n\n#|<>é é é é é", "", "", 0)]:
        assert quality.statistics((text or "").encode())[0] == plain_statistics(text or "")


def test_quality(spark, docs):
    r = np.random.default_rng(0)
    labels = labels_of(spark, [(int(i), int(r.integers(0, 2)), 0) for i in range(0, 990)] + [(None, 1, 1), (5, None, None)])
    got = quality.judge(docs, quality.fit(docs, labels)).collect()
    want = Counter((d[0], *plain_statistics(d[1] or "")) for d in documents())
    assert Counter(tuple(x[:6]) for x in got) == want
    for x in got:
        assert x["base_failed"] == (x["n_words"] < 50 or 100 * x["n_repeat_words"] > 50 * x["n_words"])
        assert not (x["base_failed"] and x["kept"])
    kept = Counter(x["doc_id"] for x in got if x["kept"])
    assert Counter(x["doc_id"] for x in quality.keep(docs, quality.fit(docs, labels)).collect()) == kept


def test_quality_without_documents_or_labels(spark, none, docs):
    assert quality.judge(none, quality.fit(none, labels_of(spark, []))).count() == 0
    assert quality.keep(docs, quality.fit(docs, labels_of(spark, []))).count() == sum(n >= 50 and 100 * a <= 50 * n for n, _, _, _, a in (plain_statistics(d[1] or "") for d in documents()))


def test_trees_learn_and_keep_to_their_constraints():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 4))
    y = (r.random(3000) < gbt.sigmoid(2 * x[:, 0] + np.sin(3 * x[:, 1]) * 2 - 1)).astype(float)
    forest = gbt.fit(x, y, [1, 0, -1, 0])
    assert ((forest.probability(x) > 0.5) == y).mean() > 0.8
    for f, sign in ((0, 1), (2, -1)):
        line = np.repeat(x[:50], 40, axis=0)
        line[:, f] = np.tile(np.linspace(-4, 4, 40), 50)
        steps = np.diff(forest.probability(line).reshape(50, 40), axis=1) * sign
        assert steps.min() >= -1e-12
    assert abs(gbt.constant(0.3).probability(x[:2]) - 0.3).max() < 1e-9
    at, to = gbt.isotonic(np.asarray([0.1, 0.2, 0.2, 0.7]), np.asarray([0, 1, 0, 1]))
    assert (np.diff(to) >= 0).all() and 0 < to[0] < to[-1] < 1


# 2


def test_shards(spark, docs, none):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    got = sharding.shard_documents(docs).collect()
    want = Counter((d[0], len((d[1] or "").encode()) + 16, zlib.crc32((d[1] or "").encode())) for d in documents())
    assert Counter((x["doc_id"], x["size"], x["text_crc32"]) for x in got) == want
    for s in {x["shard"] for x in got}:
        assert sorted(x["slot"] for x in got if x["shard"] == s) == list(range(sum(x["shard"] == s for x in got)))
    assert all(0 <= x["shard"] < 40 for x in got)
    assert sharding.shard_documents(none).count() == 0


def test_shards_are_even_when_a_third_of_the_rows_is_one_row(spark):
    rows = [(7, "same text", "en", "s", 9)] * 4000 + [(i, f"text {i}", "en", "s", 9) for i in range(8000)]
    got = sharding.shard_documents(frame(spark, rows).repartition(4)).groupBy("shard").sum("size").collect()
    sizes = [x[1] for x in got]
    assert len(sizes) == 40 and max(sizes) - min(sizes) < 0.03 * sum(sizes) / 40


def test_small_groups_of_equal_texts_stay_in_one_shard(spark):
    """Six copies of each text: whole groups in one shard, sizes within the cost that is allowed, slots without gaps."""
    rows = [(i * 6 + k, f"text {i} " * 3, "en", "s", 9) for i in range(9000) for k in range(6)]
    for own in (rows, rows + [(10**6 + i, "hot text", "en", "s", 9) for i in range(30_000)]):
        got = sharding.shard_documents(frame(spark, own).repartition(4)).collect()
        where, sizes, slots = {}, Counter(), {}
        for x in got:
            where.setdefault(x["text_crc32"], set()).add(x["shard"])
            sizes[x["shard"]] += x["size"]
            slots.setdefault(x["shard"], []).append(x["slot"])
        hot = zlib.crc32(b"hot text")
        assert all(len(s) == 1 for crc, s in where.items() if crc != hot) and (hot not in where or len(where[hot]) > 5)
        assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) < 0.03 * sum(sizes.values()) / 40
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_bounds_split_exact_weights(spark):
    r = np.random.default_rng(3)
    key, weight = np.floor(2.0 ** r.uniform(0, 60, 5000)).astype(np.int64), r.integers(1, 100, 5000)
    found = splitters.find(spark.createDataFrame([(int(a), int(b)) for a, b in zip(key, weight)], "key long, weight long"), 8, 0.01)
    for b, w, n in zip(found.bounds, found.weight, found.rows):
        assert w == weight[key < b].sum() and n == (key < b).sum()
    assert np.abs(found.weight - weight.sum() * np.arange(1, 8) / 8).max() <= 0.02 * weight.sum() / 8


# 3


def plain_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] if words else []
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(fps, radius=3):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_near_duplicates(spark, docs, none):
    rows = documents()
    fps = {d[1]: plain_fingerprint(d[1] or "") for d in rows}
    roots = plain_components(set(fps.values()))
    least = {}
    for d in rows:
        if d[0] is not None:
            k = roots[fps[d[1]]]
            least[k] = min(least.get(k, 1 << 60), d[0])
    want = Counter((d[0], f"{fps[d[1]]:016x}", least.get(roots[fps[d[1]]])) for d in rows)
    assert Counter(tuple(x) for x in simhash.near_duplicates(docs).collect()) == want
    assert simhash.near_duplicates(none).count() == 0


def plain_hashes(text, n):
    words = (text or "").encode().lower().split()
    return [xxhash.xxh64_intdigest(b" ".join(words[k : k + n]), seed=42) for k in range(max(len(words) - n + 1, 1))] if words else []


def plain_groups(texts, least=0.8):
    """Root of each different text: five-word shingles alike by 0.8, every pair compared, whatever the fingerprints are."""
    texts = sorted({t or "" for t in texts})
    sets = [set(plain_hashes(t, 5)) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if not sets[a] | sets[b] or len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least:
                root[find(a)] = find(b)
    return {t: find(i) for i, t in enumerate(texts)}


def kept_of(rows):
    """Ids that stay of (doc_id, text): the smallest of each group; a null only where there is no other."""
    roots, least = plain_groups(t for _, t in rows), {}
    for i, t in rows:
        k = roots[t or ""]
        least[k] = min(least.get(k, 1 << 60), 1 << 60 if i is None else i)
    return Counter(i if i < 1 << 60 else None for i in least.values())


def test_one_of_near_copies_stays(spark, docs, none):
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter(x["doc_id"] for x in kept.collect()) == kept_of([d[:2] for d in documents()])
    assert simhash.keep_one(none).count() == 0


@pytest.mark.parametrize("block,many", [(500, 24), (7, 24), (6, 3)])
def test_large_groups_of_near_copies_lose_no_link(spark, block, many):
    """Copies of one text with more and more words changed: alike with the text or not, and with some of each other."""
    r = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    base = [r.choice(words) for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 160):
        own = list(base)
        for _ in range(r.choice([1, 3, 5, 7, 9])):
            own[r.randrange(200)] = r.choice(words)
        rows.append((i, " ".join(own)))
    rows += [(i, " ".join(r.choice(words) for _ in range(80))) for i in range(160, 200)]
    got = {x["doc_id"]: x["root"] for x in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), block=block, many=many).collect()}
    want = plain_groups(t for _, t in rows)
    same = {(got[i], want[t]) for i, t in rows}
    assert len(same) == len({a for a, _ in same}) == len({b for _, b in same}) and 41 < len(same) < 150


def test_large_groups_are_dealt_only_where_that_leaves_less(spark):
    """2,000 scattered fingerprints are dealt and lose no pair within 7 bits; 60 texts of one fingerprint are compared whole."""
    r = random.Random(4)
    fps = [r.getrandbits(64) for _ in range(1000)]
    fps += [x ^ sum(1 << b for b in r.sample(range(64), 7)) for x in fps]
    rows = [(i, int(x), 1) for i, x in enumerate(simhash.signed(fps).tolist())] + [(2000 + i, 5, 2) for i in range(60)]
    dealt = simhash.in_blocks(spark.createDataFrame(rows, "node long, fp long, part long"), 7, 2, 4, 3).collect()
    at = {}
    for x in dealt:
        at.setdefault(x["node"], {})[x["part"], x["i"], x["j"]] = x["own"]

    def meet(a, b):
        return any({at[a][k], at[b][k]} == set(k[1:]) for k in at[a].keys() & at[b].keys())

    assert all(meet(i, i + 1000) for i in range(1000))
    assert all(meet(a, b) for a in range(2000, 2060) for b in range(2000, a))
    assert sum(x["node"] < 2000 for x in dealt) <= 2000 * 500 // 2
    assert {(x["part"]) for x in dealt if x["node"] >= 2000} == {2} and sum(x["node"] >= 2000 for x in dealt) == 60 * 15


def partition_of(roots):
    own = {}
    for i, r in roots.items():
        own.setdefault(r, set()).add(i)
    return sorted(map(sorted, own.values()))


def test_texts_of_one_fingerprint_take_one_pass(spark):
    """5,000 copies of a template with a word changed: one group by pivots, and no block of them is compared with another."""
    r = random.Random(3)
    base = [f"w{r.randrange(400)}" for _ in range(300)]
    rows = []
    for i in range(5000):
        own = list(base)
        own[100] = f"id{i}"
        rows.append((i, " ".join(own)))
    rows += [(i, " ".join(f"v{r.randrange(400)}" for _ in range(60))) for i in range(5000, 5020)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = partition_of({x["doc_id"]: x["root"] for x in simhash.groups(docs).collect()})
    assert got == [list(range(5000)), *([i] for i in range(5000, 5020))]

    known = simhash.sets(docs, docs.select(F.col("doc_id").alias("node"), F.xxhash64(F.col("text").cast("binary")).alias("digest"), F.xxhash64(F.lit(1), F.col("text").cast("binary")).alias("other"), "doc_id")).cache()
    parts = docs.filter("doc_id < 5000").select(F.col("doc_id").alias("node"), F.lit(0).cast("long").alias("fp"), F.lit(1).cast("long").alias("part"))
    left, found = simhash.around_pivots(parts, known, 0.8, 200, 400)
    assert left.count() == 0 and [x.count() for x in found] == [4999]


def test_pivots_leave_what_may_be_alike_with_others(spark):
    """A chain of texts, each alike with the next and not with the one after some more: whatever the pivot is, no link is lost."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 100])) for i in range(70)]
    want = partition_of({i: plain_groups([t for _, t in rows])[t] for i, t in rows})
    assert want == [list(range(70))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = simhash.sets(docs, docs.select(F.col("doc_id").alias("node"), F.xxhash64(F.col("text").cast("binary")).alias("digest"), F.xxhash64(F.lit(1), F.col("text").cast("binary")).alias("other"), "doc_id")).cache()
    parts = docs.select(F.col("doc_id").alias("node"), F.lit(0).cast("long").alias("fp"), F.lit(1).cast("long").alias("part"))
    left, found = simhash.around_pivots(parts, known, 0.8, 5, 10)
    stays = {x["node"] for x in left.collect()}
    links = [(x["a"], x["b"]) for f in found for x in f.collect()]
    links += [(a, a + 1) for a in range(69) if {a, a + 1} <= stays]
    root = list(range(70))
    for _ in range(70):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert set(root) == {0} and links


def test_texts_of_equal_digests_are_told_apart(spark, monkeypatch):
    """Were all digests equal, the other 64 bits tell texts apart."""
    monkeypatch.setattr(simhash, "texts_of", lambda d: d.select("doc_id", F.lit(5).cast("long").alias("digest"), F.col("text").cast("binary").alias("text")))
    r = random.Random(9)
    texts = [" ".join(f"w{r.randrange(300)}" for _ in range(60)) for _ in range(12)]
    rows = list(enumerate([*texts, texts[0], texts[5] + " tail"]))
    got = simhash.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert partition_of({x["doc_id"]: x["root"] for x in got}) == sorted([[0, 12], [5, 13], *([i] for i in range(1, 12) if i != 5)])


def test_covering_tables_in_two_parts_cover_the_wider_radius():
    r = np.random.default_rng(1)
    for level in (0, 1, 20):
        family = simhash.masks(level, 7, 2)
        assert len(family) == 30
        for _ in range(2000):
            bits = sum(1 << int(b) for b in r.choice(64, 7, replace=False))
            assert (family & np.uint64(bits) == 0).any()


def test_every_pair_within_the_radius_shares_a_bucket():
    r = np.random.default_rng(0)
    for level in (0, 1, 2):
        family = simhash.masks(level)
        for _ in range(2000):
            bits = sum(1 << int(b) for b in r.choice(64, 3, replace=False))
            assert (family & np.uint64(bits) == 0).any()


def test_crowded_buckets_lose_no_link(spark):
    """Many fingerprints within a few bits of each other, more than a task compares at once."""
    r = np.random.default_rng(4)
    base = int(r.integers(0, 1 << 62))
    fps = {base ^ sum(1 << int(b) for b in r.choice(64, r.integers(0, 6), replace=False)) for _ in range(600)} | {int(x) for x in r.integers(0, 1 << 62, 200)}
    df = spark.createDataFrame([(int(x),) for x in simhash.signed(list(fps))], "fp long")
    roots = {r["node"]: r["root"] for r in __import__("lattica.llm.components", fromlist=["stars"]).stars(simhash.links(df, most=20)).collect()}
    want = plain_components(fps)
    groups = {}
    for f in fps:
        s = int(simhash.signed([f])[0])
        groups.setdefault(want[f], set()).add(roots.get(s, s))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


# 4


def picture(seed, height=240, width=320):
    r = np.random.default_rng(seed)
    x = media.box(media.box(r.integers(0, 256, (height, width)).astype(np.float32), 2), 2)
    return ((x - x.min()) / (x.max() - x.min()) * 255).astype(np.uint8)


def test_cropped_and_edited_images_are_found(spark):
    a, b = picture(1), picture(2)
    edited = np.clip(a * 0.8 + 25, 0, 255).astype(np.uint8)
    edited[100:140, 100:160] = 0
    images = {1: a, 2: a[20:220, 40:300], 3: edited, 4: np.rot90(a).copy(), 5: b, 6: b, 7: picture(3)}
    rows = [(k, bytearray(media.write_pgm(v))) for k, v in images.items()] + [(8, None), (9, bytearray(b"no image")), (None, bytearray(media.write_pgm(b))), (7, bytearray(media.write_pgm(images[7])))]
    got = {x["page_id"]: x for x in media.copies(spark.createDataFrame(rows, "page_id long, image binary")).collect()}
    assert [got[k]["component_id"] for k in (1, 2, 3, 4)] == [1, 1, 1, 1]
    assert [got[k]["class_id"] for k in (5, 6, None)] == [5, 5, 5] and got[7]["component_id"] == 7 and got[8]["n_links"] == 0
    assert media.copies(spark.createDataFrame([], "page_id long, image binary")).count() == 0


def test_corners_do_not_depend_on_what_is_stacked():
    few = [picture(k, 100 + 7 * k, 128) for k in range(4)]
    together = media.corners(few)
    for k, image in enumerate(few):
        alone = {(round(c[1], 3), round(c[2], 3), c[5]) for c in media.corners([image])}
        assert len(alone ^ {(round(c[1], 3), round(c[2], 3), c[5]) for c in together if c[0] == k}) <= 0.1 * len(alone)


@pytest.mark.parametrize("few", [32, 0])
def test_copies_under_crowded_keys_are_linked(spark, few):
    """Two copies whose every key lies between those of images that share the descriptors but not their places."""
    r = np.random.default_rng(6)
    bits = [r.bytes(16) for _ in range(6)]
    same = r.integers(20, 900, (6, 2))
    rows = []
    for k in range(12):
        places = same if k in (5, 6) else r.integers(20, 900, (6, 2))
        rows.append((k, [n for (x, y), d in zip(places.tolist(), bits) for n in media.packed((x, y, 1.0, 0.0, d))]))
    classes = spark.createDataFrame(rows, "class_id long, corners array<long>")
    assert [(x["a"], x["b"], x["matches"]) for x in media.links(classes, few=few).collect()] == [(5, 6, 6)]


@pytest.mark.parametrize("most", [2000, 20])
def test_every_link_of_a_crowded_key_is_given(spark, most):
    """Forty copies under the same keys: all their links are given, once, not only those that hold them together."""
    r = np.random.default_rng(21)
    bits, same = [r.bytes(16) for _ in range(6)], r.integers(20, 900, (6, 2))
    rows = [(k, [n for (x, y), d in zip((same + k % 3).tolist(), bits) for n in media.packed((x, y, 1.0, 0.0, d))]) for k in range(40)]
    corners = {k: np.asarray(c).reshape(-1, media.EACH) for k, c in rows}
    pairs = [(a, b) for a in corners for b in corners if a < b]
    most_of = media.agreed([corners[a] for a, _ in pairs], [corners[b] for _, b in pairs])
    want = [(*p, int(n)) for p, n in zip(pairs, most_of) if n >= media.LEAST]
    assert len(want) == 780
    got = media.links(spark.createDataFrame(rows, "class_id long, corners array<long>"), most=most).collect()
    assert sorted((x["a"], x["b"], x["matches"]) for x in got) == want


def shuffled_bytes(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(x.stat().st_size for folder in folders for x in Path(folder.getPath()).rglob("shuffle_*.data"))


def test_tables_and_candidates_in_turns_leave_no_shuffle_behind(spark, monkeypatch):
    """The links of one turn and of several are equal; what dealing 24,000 corners to four tables shuffles (some 3 MB, all at once before) is gone after."""
    monkeypatch.setattr(media, "PAIRS", 1, raising=False)
    r = np.random.default_rng(33)
    rows = []
    for k in range(400):
        if k % 4 == 0:
            one = [(r.integers(20, 900, 2).tolist(), r.bytes(16)) for _ in range(60)]
        rows.append((k, [n for (x, y), d in one for n in media.packed((x, y, 1.0, 0.0, d))]))
    classes = spark.createDataFrame(rows, "class_id long, corners array<long>")
    before = shuffled_bytes(spark)
    got = sorted((x["a"], x["b"]) for x in media.links(classes).collect())
    assert got == [(k + i, k + j) for k in range(0, 400, 4) for i in range(4) for j in range(i + 1, 4)]
    for _ in range(50):
        if shuffled_bytes(spark) - before < 500_000:
            break
        time.sleep(0.1)
    assert shuffled_bytes(spark) - before < 500_000


def shuffled_files(spark):
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {x.name for folder in folders for x in Path(folder.getPath()).rglob("shuffle_*.data")}


def test_groups_of_near_copies_leave_no_shuffle_behind(spark):
    """The rounds of near-duplicates leave no files of their exchanges (15 before), but for the counts that tell whether stars have settled."""
    words = np.random.default_rng(8).integers(0, 10**6, (30, 60)).astype(str)
    docs = spark.createDataFrame([(k, " ".join([*words[k // 3], "end"][: 61 - k % 3])) for k in range(90)], "doc_id long, text string")
    before = shuffled_files(spark)
    got = simhash.groups(docs)
    for _ in range(50):
        if len(shuffled_files(spark) - before) < 6:
            break
        time.sleep(0.1)
    assert len(shuffled_files(spark) - before) < 6
    assert len({x["root"] for x in got.select("root").distinct().collect()}) == 30


@pytest.mark.parametrize("most", [0, 100_000])
def test_one_page_of_each_class(spark, monkeypatch, most):
    """Copies, rows that are equal throughout, an id with two images, and pages without an id: each class_id once."""
    monkeypatch.setattr(media, "REPEATED", most)
    rows = [(1, b"a", [1]), (2, b"a", [1]), (3, b"b", [3]), (4, b"c", [4]), (4, b"c", [4]), (5, b"d", [5]), (5, b"e", [5]), (None, b"f", [6]), (None, b"g", [7]), (None, b"g", [7])]
    pages = spark.createDataFrame([(i, bytearray(d), c) for i, d, c in rows], "page_id long, digest binary, corners array<long>")
    classes = pages.groupBy("digest").agg(F.min("page_id").alias("class_id"), F.count("*").alias("n"))
    assert sorted((x["class_id"], x["corners"]) for x in media.first_pages(pages, classes).collect()) == [(1, [1]), (3, [3]), (4, [4]), (5, [5])]


def test_distant_matches_count_once_one_is_found(spark):
    """One equal corner brings two images together; the other matches differ in NEAR bits and share no key."""
    r = np.random.default_rng(6)
    places = r.integers(20, 900, (6, 2)).tolist()
    one = [r.integers(0, 2, 128) for _ in range(6)]
    two = [d ^ (np.isin(np.arange(128), r.choice(128, media.NEAR, replace=False)) if k else False) for k, d in enumerate(one)]
    rows = [(k, [n for (x, y), d in zip(places, ds) for n in media.packed((x, y, 1.0, 0.0, np.packbits(d.astype(np.uint8)).tobytes()))]) for k, ds in enumerate((one, two))]
    got = media.links(spark.createDataFrame(rows, "class_id long, corners array<long>")).collect()
    assert [(x["a"], x["b"], x["matches"]) for x in got] == [(0, 1, 6)]


def test_images_of_pages_never_leave_their_task(spark, monkeypatch):
    """One Python step draws pages and finds corners (two before, with whole batches of images between them), and gives what the images themselves give."""
    seen, features = [], media.features
    monkeypatch.setattr(media, "features", lambda *a: seen.append(features(*a)) or seen[-1])
    monkeypatch.setattr(media, "AT_ONCE", 20_000)
    queries.op4_image_copies(spark, "/root/testdata/sf0.001")
    assert seen[0]._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = {tuple(x) for x in features(media.page_images(pages)).selectExpr("page_id", "hex(digest)", "hash(corners)", "size(corners)").collect()}
    assert {tuple(x) for x in seen[0].selectExpr("page_id", "hex(digest)", "hash(corners)", "size(corners)").collect()} == want
    assert len(want) == pages.count()


def test_corners_do_not_depend_on_what_stands_above():
    """Images alone and in one column have the same corners, to the last bit (places of a scale were rounded by how far down they are before)."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column("html").to_pylist()
    images = [media.read_pgm(media.page_image(x)) for x in pages[:300]]
    alone = [(k, *c[1:]) for k, x in enumerate(images) for c in media.corners([x])]
    assert sorted(media.corners(images)) == sorted(alone)


EDITS = {
    "crop": lambda x, r: x[40:200, 60:290],
    "lighter": lambda x, r: np.clip(x * 0.8 + 40, 0, 255),
    "noise": lambda x, r: np.clip(x + r.normal(0, 6, x.shape), 0, 255),
    "patch": lambda x, r: np.where((np.arange(240)[:, None] < 110) & (np.arange(320) < 140), 0, x),
    "three quarters": lambda x, r: media.shrink(media.box(x.astype(np.float32), 1), 0.75),
    "turned": lambda x, r: np.rot90(x),
}


def test_recall_for_each_kind_of_edit():
    """Forty pictures and a copy of each by each edit: nine in ten agree with their picture, and no other picture's copy does."""
    r = np.random.default_rng(9)

    def numbers(image):
        return np.asarray([n for c in media.corners([np.asarray(image).astype(np.uint8)]) for n in media.packed(c[1:])], dtype=np.int64).reshape(-1, media.EACH)

    def linked(p, q):
        return media.agreed(*([q], [p]) if len(q) < len(p) else ([p], [q]))[0] >= media.LEAST

    images = [picture(100 + k) for k in range(40)]
    whole = [numbers(x) for x in images]
    for name, edit in EDITS.items():
        copies = [numbers(edit(x, r)) for x in images]
        assert sum(linked(p, q) for p, q in zip(whole, copies)) >= 36, name
        assert not any(linked(whole[k], copies[(k + step) % 40]) for k in range(40) for step in (1, 5, 11)), name


def test_a_key_of_hundreds_of_images(spark):
    """Three hundred images share one corner, at places of their own; the copies among them are linked and nothing else."""
    r = np.random.default_rng(12)
    common, rows = r.bytes(16), []
    for k in range(300):
        if k % 3 < 2:
            own = [(r.integers(20, 900, 2).tolist(), r.bytes(16)) for _ in range(6)]
            if k % 3 == 0:
                before = own
        else:  # a copy of the image two before
            own = before
        at = r.integers(20, 900, 2).tolist()
        rows.append((k, [n for (x, y), d in [*own, (at, common)] for n in media.packed((x, y, 1.0, 0.0, d))]))
    got = media.links(spark.createDataFrame(rows, "class_id long, corners array<long>")).collect()
    assert sorted((x["a"], x["b"]) for x in got) == [(k, k + 2) for k in range(0, 300, 3)]


def test_distant_meetings_need_two_that_agree(spark):
    """Corners CLOSE + 2 bits apart under a shared key: copies are found by two that agree, unlike places by none."""
    r = np.random.default_rng(15)
    kept = set().union(*[{b for b in range(128) if m[b // 64] >> (b % 64) & 1} for m in media.masks(0)[:1]])
    free = [b for b in range(128) if b not in kept]
    one = [r.integers(0, 2, 128) for _ in range(6)]
    two = [d ^ np.isin(np.arange(128), r.choice(free, media.CLOSE + 2, replace=False)) for d in one]
    words = [[int(sum(int(b) << i for i, b in enumerate(d[h : h + 64]))) for h in (0, 64)] for d in one + two]
    bits = [np.asarray([w - (1 << 64) if w >> 63 else w for w in x], dtype="<i8").tobytes() for x in words]
    places, other = r.integers(20, 400, (6, 2)).tolist(), (r.permutation(6)[:, None] * 150 + r.integers(0, 40, (6, 2))).tolist()
    rows = [(k, [n for (x, y), d in zip(at, ds) for n in media.packed((x, y, 1.0, 0.0, d))]) for k, at, ds in ((0, places, bits[:6]), (1, places, bits[6:]), (2, other, bits[6:]))]
    got = media.links(spark.createDataFrame(rows[:2], "class_id long, corners array<long>")).collect()
    assert [(x["a"], x["b"], x["matches"]) for x in got] == [(0, 1, 6)]
    assert media.links(spark.createDataFrame([rows[0], rows[2]], "class_id long, corners array<long>")).count() == 0


def test_maps_are_read():
    assert media.read_pgm(media.write_pgm(picture(1))).shape == (240, 320)
    assert media.read_pgm(b"P5 # note\n 2 1 255\nab").tolist() == [[97, 98]]
    assert media.read_pgm(b"P5 2 2 255\nab") is None and media.read_pgm(None) is None


# 5


def test_toxicity(spark, none):
    r = np.random.default_rng(2)
    calm = [f"w{i}" for i in range(200)]
    rows, marks = [], []
    for i in range(900):
        words = [calm[int(k)] for k in r.integers(0, 200, 40)]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                words[int(r.integers(0, 40))] = ["mudhead", "slimebag", "Mudhead"][int(r.integers(0, 3))]
        rows.append((i, " ".join(words), "en", "s", 1))
        marks.append((i, 1, int(bad)))
    rows += [(3000, None, None, None, None), (3001, "", "en", "s", 0), (None, "null id", None, None, 1), rows[0], rows[0]]
    docs, labels = frame(spark, rows, extra=True), labels_of(spark, marks + [(None, 0, 1), (4, None, None)])
    model = toxicity.fit(docs, labels)
    got = {x["doc_id"]: x for x in toxicity.judge(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(900))
    assert np.mean([got[i]["predicted"] == (i % 6 == 0) for i in held]) > 0.97
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in got.values())
    assert not got[None]["held_out"] and got[3000]["score"] == got[3001]["score"]
    assert toxicity.drop(docs, model).columns == docs.columns
    assert toxicity.judge(none, toxicity.fit(none, labels_of(spark, []))).count() == 0
    assert toxicity.drop(docs, toxicity.fit(docs, labels_of(spark, []))).count() == docs.count()


def test_hidden_words_are_seen():
    look = toxicity.Lookup({"idiot": 7.0}, {})
    names = list(toxicity.FEATURES)
    of = lambda t: dict(zip(names, look.features(t.encode())))
    assert of("you 1d10t there")["hidden"] > 0 and of("you i d i o t there")["hidden"] > 0
    assert of("you idiot")["near_you"] > 0 and of("an idiot")["near_you"] == 0


# 6


def test_ids_are_those_of_the_library(docs, none):
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.vocabulary_path())
    got = {(x["doc_id"], x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in bpe.round_trip(docs).collect()}
    want = set()
    for i, text, *_ in documents():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want
    assert bpe.round_trip(none).count() == 0


def test_scanned_heaped_and_compiled_words_agree():
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.vocabulary_path())
    r = np.random.default_rng(6)
    texts = ["".join(r.choice(list("abc e  \n'sé1日\t$ ")) for _ in range(int(n))) for n in r.integers(0, 60, 400)] + ["ab" * 400, "é" * 150, " " * 90, "a  b   c\n\n d", "<|endoftext|>", "x <|endoftext|>  <|endoftext|>y"]
    own, fast = bpe.Codec(bpe.vocabulary_path()), packing.WordCodec(bpe.vocabulary_path())
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for codec in (own, fast):
        assert [np.frombuffer(x, dtype="<u4").tolist() for x in codec.encode(texts)] == want
    assert [own.decode(np.asarray(x, dtype="<u4").tobytes()) for x in want] == texts
    words = [w.encode() for w in ("abab" * 15, "thththe", "é" * 9)]
    assert own.scan(words) == [own.long(w) for w in words]


# 7


def test_urls(spark):
    pages = [(1, "https://a.com/en/1?x"), (2, "http://EXAMPLE.com/en/77"), (3, "ftp://b.net/de/1"), (4, "https://m.example.net/de/81"), (5, "https://org/es/"), (6, None), (7, "no scheme"), (8, "https://notexample.com/en/7"), (9, "x://h#f"), (10, "https://h?q/en/"), (1, "https://a.com/en/1?x"), (11, "")]
    pages += [(100 + i, f"https://{'good' if i % 2 else 'bad'}{i}.{'net/de/1' if i % 2 else 'com/en/2'}{i}") for i in range(400)] + [(900, "https://good7.fr/de/15"), (901, "https://bad8.fr/en/24")]
    got = {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in urls.judge(spark.createDataFrame(pages, "page_id long, url string")).collect()}
    assert got[1] == ("a.com", "/en/1", "com/en/", "block")
    assert got[2] == ("example.com", "/en/77", "example.com/en/7", "allow")
    assert got[3] == ("b.net", "/de/1", "net/de/", "allow")
    assert got[4] == ("m.example.net", "/de/81", "example.net/de/8", "block")
    assert got[5] == ("org", "/es/", "org/es/", "block")
    assert got[6][:3] == got[7][:3] == got[11][:3] == ("", "", None)
    assert got[8][2:] == ("com/en/", "block")
    assert got[9][:3] == ("h", "", None) and got[10][:3] == ("h", "", None)
    assert (got[900][3], got[901][3]) == ("allow", "block")
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    alone = urls.judge(spark.createDataFrame([(1, "https://x.y/z")], "page_id long, url string")).collect()
    assert [x["verdict"] for x in alone] == ["allow"]


def test_probabilities_of_the_url_models_sum_to_one(spark):
    """After any two signs, over the alphabet; checked through a model of one url against its own counts."""
    rows = spark.createDataFrame([("https://ab.ab/", "allow"), ("http://cd.cd/", "block")], "url string, kind string").withColumn("signs", urls.signs(__import__("pyspark.sql.functions", fromlist=["col"]).col("url")))
    ratios = {r["g"]: r["ratio"] for r in urls.model(rows).collect()}
    assert ratios["ab."] > 0 > ratios["cd."] and abs(ratios["^^h"]) < 0.2


# 8


def test_packing(spark, docs, none):
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.vocabulary_path())
    got = [x.asDict() for x in packing.pack(docs).collect()]
    by = {}
    for x in got:
        by.setdefault(x["sequence_id"], []).append(x)
    for k, own in by.items():
        own.sort(key=lambda x: x["offset"])
        assert [x["offset"] for x in own] == [0, *np.cumsum([x["length"] for x in own])[:-1].tolist()]
        assert sum(x["length"] for x in own) == 2048 or k == max(by)
    want, texts = Counter(), documents()
    for i, text, *_ in texts:
        ids = np.asarray([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want[(i, len(ids))] += 1
        for x in got:
            if x["doc_id"] == i and x["doc_tokens"] == len(ids) and sum(t[0] == i for t in texts) == 1:
                assert x["ids_crc32"] == zlib.crc32(ids[x["start"] : x["start"] + x["length"]].tobytes())
    pieces = Counter()
    for x in got:
        pieces[(x["doc_id"], x["doc_tokens"])] += x["length"]
    assert pieces == Counter({k: k[1] * n for k, n in want.items()})
    assert packing.pack(none).count() == 0


def test_the_curve_visits_every_cell_by_single_steps():
    side = 8
    cells = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    order = np.argsort(packing.hilbert(cells, 3))
    assert sorted(packing.hilbert(cells, 3)) == list(range(side**3))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


# 9


def test_language_model(spark, docs, none):
    rows = documents()
    train, counts = [], Counter()
    for i, text, *_ in rows:
        if i is None or zlib.crc32(str(i).encode()) % 5 != 1:
            own = (text or "").encode().lower().split() + [b""]
            train.append(own)
            counts.update(own)
    n, v = sum(counts.values()), len(counts)
    got = ngrams.score(docs).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, text, *_ in rows:
        own = (text or "").encode().lower().split() + [b""]
        base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        want[(i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(own), sum(counts[w] > 0 for w in own), n, round(base, 5))] += 1
    assert Counter((*tuple(x)[:5], round(x["base_score"], 5)) for x in got) == want
    assert all(x["score"] < 0 for x in got)
    same = {}
    for x in got:
        same.setdefault(x["doc_id"], set()).add(round(x["score"], 6))
    assert all(len(s) == 1 for s in same.values())
    assert ngrams.score(none).count() == 0


def plain_model(order):
    """Counts of n-grams and of their contexts, and the tokens with what is before them, of the texts of some parts."""
    texts = [(i, [b""] * (order - 1) + (text or "").encode().lower().split() + [b""]) for i, text, *_ in documents()]
    part = {i: -1 if i is None else zlib.crc32(str(i).encode()) % 5 for i, _ in texts}

    def counts(parts):
        found, context = Counter(), Counter()
        for i, own in texts:
            if part[i] in parts:
                for at in range(order - 1, len(own)):
                    for k in range(1, order + 1):
                        found[tuple(own[at - k + 1 : at + 1])] += 1
                        context[tuple(own[at - k + 1 : at])] += 1
        return found, context

    return texts, part, counts


def plain_q(own, at, found, context, weights, different):
    q = 1 / (different + 1)
    for k in range(1, ngrams.ORDER + 1):
        n = context[tuple(own[at - k + 1 : at])]
        bucket = 0 if k == 1 else min(n.bit_length(), ngrams.CONTEXTS - 1)
        weight = weights.of[k - 1][bucket]
        q = weight * found[tuple(own[at - k + 1 : at + 1])] / max(n, 1) + (1 - weight) * q
    return q


@pytest.mark.parametrize("segment,bucket", [(ngrams.SEGMENT, ngrams.BUCKET), (500, 900)])
def test_scores_are_those_of_the_counts(spark, docs, monkeypatch, segment, bucket):
    """The score of each text from counts made the plain way, under the weights that were learned."""
    monkeypatch.setattr(ngrams, "TOGETHER", 0)
    monkeypatch.setattr(ngrams, "LEAST_BUCKET", bucket)
    t = ngrams.train(docs, segment, bucket)
    texts, _, counts = plain_model(ngrams.ORDER)
    found, context = counts({-1, 0, 2, 3, 4})
    different = sum(len(k) == 1 for k in found)
    assert (t.totals.different, t.totals.total) == (different, context[()])
    want = Counter((i, round(sum(math.log10(plain_q(own, at, found, context, t.weights, different)) for at in range(ngrams.ORDER - 1, len(own))), 4)) for i, own in texts)
    assert Counter((x["doc_id"], round(x["score"], 4)) for x in ngrams.scored(t).collect()) == want


def test_weights_are_those_of_expectation_maximisation_on_every_token(spark, docs):
    """Gathering tokens in bins moves no weight that matters."""
    t = ngrams.train(docs)
    texts, part, counts = plain_model(ngrams.ORDER)
    found, context = counts({-1, 0, 3, 4})
    rows = []
    for i, own in texts:
        if part[i] == ngrams.KEPT_OUT:
            for at in range(ngrams.ORDER - 1, len(own)):
                n = [context[tuple(own[at - k + 1 : at])] for k in range(1, ngrams.ORDER + 1)]
                rows.append([found[tuple(own[at - k + 1 : at + 1])] / max(n[k - 1], 1) for k in range(1, ngrams.ORDER + 1)] + [min(x.bit_length(), ngrams.CONTEXTS - 1) for x in n[1:]])
    x = np.asarray(rows)
    exact = ngrams.maximised(np.ones(len(x)), list(x[:, : ngrams.ORDER].T), list(x[:, ngrams.ORDER :].T.astype(int)), sum(len(k) == 1 for k in found))
    assert t.weights.of[0] == pytest.approx(exact.of[0], abs=0.01)
    for k in range(1, ngrams.ORDER):
        often = np.bincount(x[:, ngrams.ORDER + k - 1].astype(int), minlength=ngrams.CONTEXTS) > 50
        assert often.any() and np.abs(t.weights.of[k] - exact.of[k])[often].max() < 0.02


def test_probabilities_sum_to_one(spark, docs):
    """Over all words and one for what is unknown, after any two words."""
    t = ngrams.train(docs)
    texts, _, counts = plain_model(ngrams.ORDER)
    found, context = counts({-1, 0, 2, 3, 4})
    words = [k[0] for k in found if len(k) == 1]
    for i, own in texts[:3]:
        before = own[len(own) // 2 : len(own) // 2 + ngrams.ORDER - 1]
        assert sum(plain_q([*before, w], ngrams.ORDER - 1, found, context, t.weights, len(words)) for w in [*words, b"\0unknown"]) == pytest.approx(1)


def test_copies_of_training_texts_score_apart(spark):
    r = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(r.choice(words) for _ in range(60))) for i in range(400)]
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1]
    trained = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 not in (1, 2)]
    copied = dict(zip(held[::2], trained))
    rows = [(i, rows[copied[i]][1] if i in copied else text) for i, text in rows]
    got = {x["doc_id"]: x["score"] for x in ngrams.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert min(got[i] for i in copied) > max(got[i] for i in held[1::2])


def test_arrays_are_squeezed():
    x = np.asarray([3, 5, 5, 900])
    for own in (x, x[::-1], -x, np.zeros(0, dtype=np.int64), np.asarray([0, 1 << 62, 7])):
        assert ngrams.stretch(ngrams.squeeze(own))[0].tolist() == own.tolist()


# 10


def plain_removed(rows):
    own = {}
    for i, t in rows:
        for s in range(len(t) - 49):
            own[t[s : s + 50]] = min(own.get(t[s : s + 50], 1 << 62), i)
    out = []
    for i, t in rows:
        gone = np.zeros(len(t), dtype=bool)
        for s in range(len(t) - 49):
            if own[t[s : s + 50]] < i:
                gone[s : s + 50] = True
        out.append(gone)
    return out


def test_repeats(spark, docs, none):
    texts = [(d[0] if d[0] is not None else 1 << 61, (d[1] or "").encode()) for d in documents()]
    want = Counter()
    for (i, t), gone in zip(texts, plain_removed(texts)):
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want[(i if i < 1 << 61 else None, len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()).hexdigest())] += 1
    for size in (repeats.BLOCK, 3000):
        assert Counter(tuple(x) for x in repeats.remove_repeats(docs, block_bytes=size).collect()) == want
    left = repeats.without_repeats(docs)
    assert left.columns == docs.columns
    assert sorted(x["text"] for x in left.filter("doc_id = 2001").collect()) == [""]
    assert repeats.remove_repeats(none).count() == 0 and repeats.without_repeats(none).count() == 0


def test_maximal_repeats_are_all_found():
    """Against every pair of suffixes of texts over two letters."""
    r = np.random.default_rng(9)
    for _ in range(30):
        text = "".join(r.choice(list("ab"), 60))
        order = sorted(range(len(text)), key=lambda i: text[i:])
        common = [0]
        for a, b in zip(order, order[1:]):
            n = 0
            while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
                n += 1
            common.append(n)
        left = np.asarray([ord(text[i - 1]) if i else -1 for i in order])
        got = {(text[order[a] : order[a] + n], tuple(sorted(order[a : b + 1]))): s for n, a, b, s in repeats.maximal_repeats(np.asarray(common), left, np.asarray(order), 3)}
        want = {}
        for n in range(3, len(text)):
            seen = {}
            for i in range(len(text) - n + 1):
                seen.setdefault(text[i : i + n], []).append(i)
            for word, at in seen.items():
                before, after = {text[i - 1] if i else None for i in at}, {text[i + n] if i + n < len(text) else None for i in at}
                if len(at) > 1 and len(before) > 1 and len(after) > 1:
                    want[(word, tuple(at))] = min(at)
        assert got == want
