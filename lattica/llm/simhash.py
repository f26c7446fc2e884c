"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has the majority bits of the XXH64 values of a text's three-word shingles. Bit i is
given a nonzero vector m(i) of radius + 1 bits; table v keeps the bits i with <m(i), v> = 1. The m of
`radius` differing bits never span the space, so some nonzero v is orthogonal to them all, and the
two fingerprints agree on everything that table v keeps: every pair within the radius collides.

Only different fingerprints enter the tables. A bucket of up to BUCKET of them is compared in one
task, and gives a star for each of its local components rather than its pairs. A larger bucket is
dealt out again by another covering family on top of its own key, until the parts are small enough:
each level fixes half of the bits left, and few bits left hold few different fingerprints.

near_duplicates() takes fingerprints within RADIUS for links and nothing else. keep_one(), the stage of a
pipeline, links two texts if the sets of their five-word shingles are alike by LEAST (Jaccard) at least;
fingerprints nominate, the sets decide. A text has FAMILY fingerprints there, of word pairs, which move
less under an edit; those of one kind within NEAR_BITS nominate, and so does what links them. A wider
radius takes more tables; the bits are dealt into two parts of half the radius each (of two near
fingerprints one part differs in no more), which takes 30 tables in place of 255 for each kind.

Groups of near fingerprints are found first, by stars; a group that lies within a small one of an earlier
kind is not looked at again. Only texts that are not alone in theirs give their sets. A group of more
than AROUND blocks is compared with one of its texts, its pivot: what is alike with it is linked to it,
and stays to be compared only if it may be alike with a text that isn't (distances by Jaccard obey the
triangle inequality), so a million copies of one text take one pass. What is left is compared whole in
blocks of BLOCK texts; a group of over MANY_BLOCKS blocks is dealt by covering tables before, if that at
least halves what there is to compare. So no pair of texts alike by LEAST whose fingerprints of some kind
are within NEAR_BITS is lost, none is emitted, and dealing never makes work grow. Texts are told apart by
128 bits.

Defined results: a null, empty or blank text has fingerprint zero and is linked like any other; fewer
than three words are one shingle; repeated rows are documents of one group; a null id belongs to its
group but is never its component_id unless the group has no other. keep_one() keeps the smallest id
of a group, one of rows equal in id and text, and all other columns; texts without words are alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, batch_of, cut, settled, slices, table_in_shared_folder, text_bytes
from .components import stars

RADIUS, SHINGLE, SEED, BITS = 3, 3, 42, 64
#: Different fingerprints of a bucket that one task compares.
BUCKET = 1000
#: Of keep_one: fingerprints of a text, words of their shingles and of the sets', the radius, and the sets' likeness.
FAMILY, NEAR_SHINGLE, NEAR_BITS, NEAR_PARTS, SET_SHINGLE, LEAST = 3, 2, 7, 2, 5, 0.8
#: Texts of a block of a group, blocks of a group that are compared with each other, those that it has at most without a pivot, and pivots in turn.
BLOCK, MANY_BLOCKS, AROUND, PIVOTS = 200, 24, 2, 3
#: Bytes of sets that are compared with a pivot at once.
AT_ONCE = 16 << 20
_FPS = [f"fp{k}" for k in range(FAMILY)]

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def shingles(text: bytes, n: int) -> np.ndarray:
    """Hashes of a text's shingles of n words in turn; fewer words are one shingle, no words none."""
    words = text.lower().split()  # of ASCII bytes: A to Z, and the six separators
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False)) if len(words) >= n else [b" ".join(words)]
    return np.fromiter(map(_hash, joined), dtype="<u8", count=max(len(words) - n + 1, 1))


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    return majority(shingles(text, n))


def majority(values: np.ndarray) -> int:
    """The bits that over half of the values have."""
    votes = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(values), 1 << 16):
        part = values[k : k + (1 << 16)]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(values), bitorder="little").tobytes(), "little")


def signed(values: list[int]) -> np.ndarray:
    return np.asarray(values, dtype=np.uint64).view(np.int64)


def fingerprints(documents: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, digest (of the text) and fp (the fingerprint as a signed long)."""
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(schema, [batch.column("doc_id"), batch.column("digest"), signed([fingerprint(x, n) for x in as_bytes(batch, "text")])])

    return texts_of(documents).mapInArrow(run, "doc_id long, digest long, fp long")


def texts_of(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).select("doc_id", F.xxhash64("text").alias("digest"), "text")


def family(text: bytes) -> list[int]:
    """FAMILY fingerprints of the text's word pairs: of their hashes, and of those mixed anew."""
    values = shingles(text, NEAR_SHINGLE)
    return [majority(mixed(values ^ np.uint64(k)) if k else values) for k in range(FAMILY)]


def families(documents: DataFrame) -> DataFrame:
    """doc_id, digest and other (128 bits of the text) and the fingerprints of its family."""
    names = ["doc_id", "digest", "other", *_FPS]
    schema = pa.schema([(c, pa.int64()) for c in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = zip(*map(family, as_bytes(batch, "text")), strict=True) if batch.num_rows else [[]] * FAMILY
            yield batch_of(schema, [*(batch.column(c) for c in names[:3]), *(signed(list(x)) for x in fps)])

    return told(texts_of(documents)).mapInArrow(run, ", ".join(f"{c} long" for c in names))


def told(texts: DataFrame) -> DataFrame:
    """With other: 64 more bits of the text than digest has."""
    return texts.withColumn("other", F.xxhash64(F.lit(1), "text"))


def masks(level: int, radius: int = RADIUS, parts: int = 1) -> np.ndarray:
    """The covering family of a level: for each part of the bits 2**(r + 1) - 1 masks of 64 bits, r being the radius over the parts."""
    size = 1 << (radius // parts + 1)
    order = np.random.default_rng(level).permutation(BITS)
    given, part = 1 + order // parts % (size - 1), order % parts
    return np.asarray([sum(1 << i for i in range(BITS) if part[i] == p and bin(int(given[i]) & v).count("1") % 2) for p in range(parts) for v in range(1, size)], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def deal(level: int, radius: int, parts: int = 1):
    """Rows (bucket, fp) to one row for each table of the level's family."""
    schema, family = pa.schema([("bucket", pa.int64()), ("fp", pa.int64())]), masks(level, radius, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, fp = (batch.column(c).to_numpy().view(np.uint64) for c in ("bucket", "fp"))
            with np.errstate(over="ignore"):
                for v, mask in enumerate(family):
                    key = mixed(mixed(fp & mask) + mixed(bucket ^ np.uint64(v * 64 + level + 1)))
                    yield batch_of(schema, [key.view(np.int64), fp.view(np.int64)])

    return run


def local_stars(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """(fingerprint, least of its local component) for the different fingerprints of one bucket."""
    fps = np.unique(fps)
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    least, old = near.argmax(axis=1), None
    while old is None or (least != old).any():
        old = least
        least = np.where(near, old[None, :], len(fps)).min(axis=1)
        least = least[least]
    return [(int(a), int(b)) for a, b in zip(fps.view(np.int64), fps[least].view(np.int64), strict=True) if a != b]


def compare(radius: int, most: int):
    """Sorted rows (bucket, fp) to links (bucket null) and to the rows of buckets over `most` (b null)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("bucket", pa.int64())])

    def rest(bucket: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        return batch_of(schema, [fp, pa.nulls(len(fp), pa.int64()), bucket])

    def whole(bucket: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of groups that are complete."""
        start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        size = np.diff(np.append(start, len(bucket)))
        pair = start[size == 2]
        pair = pair[np.bitwise_count(fp[pair].view(np.uint64) ^ fp[pair + 1].view(np.uint64)) <= radius]
        found = [(np.maximum(fp[pair], fp[pair + 1]), np.minimum(fp[pair], fp[pair + 1]))]
        for s, n in zip(start[size > 2], size[size > 2], strict=True):
            if n > most:
                yield rest(bucket[s : s + n], fp[s : s + n])
            elif links := local_stars(fp[s : s + n].view(np.uint64), radius):
                found.append(tuple(np.asarray(x, dtype=np.int64) for x in zip(*links, strict=True)))
        a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        yield batch_of(schema, [a, b, pa.nulls(len(a), pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, fp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        large = None
        for batch in batches:
            k, f = batch.column("bucket").to_numpy(), batch.column("fp").to_numpy()
            if large is not None:  # the rest of a bucket that is known to be too large
                n = int(np.searchsorted(k, large, side="right"))
                if n:
                    yield rest(k[:n], f[:n])
                k, f, large = k[n:], f[n:], large if n == len(k) else None
            bucket, fp = np.concatenate([bucket, k]), np.concatenate([fp, f])
            if not len(bucket):
                continue
            tail = int(np.searchsorted(bucket, bucket[-1], side="left"))
            if tail:
                yield from whole(bucket[:tail], fp[:tail])
            bucket, fp = bucket[tail:], fp[tail:]
            if len(bucket) > most:
                yield rest(bucket, fp)
                large, bucket, fp = bucket[0], bucket[:0], fp[:0]
        if len(bucket):
            yield from whole(bucket, fp)

    return run


def links(different: DataFrame, radius: int = RADIUS, most: int = BUCKET, parts: int = 1) -> DataFrame:
    """a, b: links among different fingerprints (column fp; of one bucket, where they have one) whose components are those of all pairs within the radius."""
    kind = F.col("bucket") if "bucket" in different.columns else F.lit(0)
    rows, found, level = different.select(kind.cast("long").alias("bucket"), "fp"), None, 0
    while True:
        dealt = rows.mapInArrow(deal(level, radius, parts), "bucket long, fp long")
        if level:
            dealt = dealt.distinct()
        out = settled(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(compare(radius, most), "a long, b long, bucket long").distinct())
        new = out.filter("bucket is null").select("a", "b")
        found = new if found is None else found.unionByName(new)
        rows = out.filter("bucket is not null").select("bucket", F.col("a").alias("fp"))
        level += 1
        if rows.isEmpty():
            return found
        if level > 12:
            raise RuntimeError("buckets stay too large; raise `most`")


def components(documents: DataFrame, radius: int = RADIUS, most: int = BUCKET) -> DataFrame:
    """doc_id, fp, component_id and keeper (the fp and doc_id of the one document that stands for the group)."""
    rows = cut(fingerprints(documents))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = stars(links(classes.select("fp"), radius, most))
    known = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = known.groupBy("root").agg(F.min("first").alias("component_id"), F.min(F.struct(F.col("first").isNull().alias("none"), "first", "fp")).alias("keeper"))
    named = known.join(first, "root").select("fp", "component_id", F.col("keeper.fp").alias("keeper_fp"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "keeper_fp")


def near_duplicates(documents: DataFrame) -> DataFrame:
    return components(documents).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def sets(documents: DataFrame, chosen: DataFrame) -> DataFrame:
    """node and set (sorted hashes of shingles, as bytes) of the texts of chosen (node, digest, other, doc_id of one document that has it)."""
    schema = pa.schema([("node", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(schema, [batch.column("node"), [np.unique(shingles(x, SET_SHINGLE)).tobytes() for x in as_bytes(batch, "text")]])

    texts = told(texts_of(documents))
    same = (texts["digest"] == chosen["digest"]) & (texts["other"] == chosen["other"]) & texts["doc_id"].eqNullSafe(chosen["doc_id"])
    return texts.join(chosen, same).select("node", "text").mapInArrow(run, "node long, set binary").dropDuplicates(["node"])


def in_blocks(grouped: DataFrame, radius: int, parts: int, block: int, many: int) -> DataFrame:
    """node, part, i, j, own: the blocks (of part: i and j) that a text takes part in, and which of the two it is of; from node, fp and part.

    A part of over `many` blocks is dealt by covering tables where that at least halves the rows that comparing takes, and is compared whole otherwise.
    """
    blocks = lambda n: F.ceil(n / block)
    done, level = None, 20
    while True:
        sized = grouped.join(grouped.groupBy("part").agg(blocks(F.count("*")).alias("n")), "part")
        small = sized.filter(F.col("n") <= many).select("node", "part", "n")
        done = small if done is None else done.unionByName(small)
        large = settled(sized.filter(F.col("n") > many).select(F.col("part").alias("bucket"), "fp", "node", "n"))
        if large.isEmpty():
            break
        tables = [F.xxhash64(F.lit(level), F.lit(t), "bucket", F.col("fp").bitwiseAND(F.lit(int(m)))) for t, m in enumerate(masks(level, radius, parts).view(np.int64).tolist())]
        dealt = large.groupBy("bucket", "fp").agg(F.count("*").alias("m"), F.first("n").alias("n")).withColumn("part", F.explode(F.array(*tables)))
        taken = dealt.groupBy("bucket", "n", "part").agg(F.sum("m").alias("m")).groupBy("bucket", "n").agg(F.sum("m").alias("m"), F.sum(F.col("m") * blocks(F.col("m"))).alias("rows"))
        # m has each text once for each table.
        worth = settled(taken.filter(2 * F.col("rows") <= F.col("m") / len(tables) * F.col("n")).select("bucket"))
        done = done.unionByName(large.join(worth, "bucket", "left_anti").select("node", F.col("bucket").alias("part"), "n"))
        grouped = dealt.join(worth, "bucket", "left_semi").select("bucket", "fp", "part").join(large, ["bucket", "fp"]).select("node", "fp", "part")
        level += 1
    own = F.pmod(F.xxhash64("part", "node"), F.col("n"))
    dealt = done.filter("n > 0").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return dealt.select("node", "part", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")


def alike(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarity of each of the sets with each of the others; two empty ones are equal."""
    size = [np.asarray([len(x) for x in y]) for y in (one, two)]
    value, at = np.unique(np.concatenate([*one, *two]), return_inverse=True)
    row = np.repeat(np.arange(len(one) + len(two)), np.concatenate(size))
    first = row < len(one)
    # Only shingles that both sides have count.
    both = (np.bincount(at[first], minlength=len(value)) > 0) & (np.bincount(at[~first], minlength=len(value)) > 0)
    place = np.cumsum(both) - 1
    own = both[at]
    row, at, first = row[own], place[at[own]], first[own]
    common = np.zeros((len(one), len(two)), dtype=np.float32)
    for start in range(0, int(both.sum()), 4096):
        here = (at >= start) & (at < start + 4096)
        a, b = np.zeros((len(one), 4096), dtype=np.float32), np.zeros((len(two), 4096), dtype=np.float32)
        a[row[here & first], at[here & first] - start] = 1
        b[row[here & ~first] - len(one), at[here & ~first] - start] = 1
        common += a @ b.T
    union = size[0][:, None] + size[1][None, :] - common
    return np.where(union > 0, common / np.maximum(union, 1), 1.0)


def compare_sets(least: float):
    """Rows sorted by part, i, j to the links that hold its texts together: each text with the least of its component there."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def whole(rows: list[dict]) -> list[tuple[int, int]]:
        left = [r for r in rows if r["own"] == r["i"]]
        right = [r for r in rows if r["own"] == r["j"]] if rows[0]["i"] != rows[0]["j"] else left
        if not left or not right or len(rows) < 2:
            return []
        near = alike(*([np.frombuffer(r["set"], dtype="<u8") for r in y] for y in (left, right))) >= least
        ids = np.asarray([r["node"] for r in [*left, *right]], dtype=np.int64)
        a, b = np.nonzero(near)
        b = b + len(left)
        root = ids.copy()
        while True:  # the least that is reached, until nothing changes
            old = root.copy()
            np.minimum.at(root, a, root[b])
            np.minimum.at(root, b, root[a])
            if (old == root).all():
                return list({(int(x), int(y)) for x, y in zip(ids, root, strict=True) if x != y})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[dict] = []
        for batch in batches:
            out: list[tuple[int, int]] = []
            for r in batch.to_pylist():
                if own and any(own[0][k] != r[k] for k in ("part", "i", "j")):
                    out += whole(own)
                    own = []
                own.append(r)
            if out:
                yield batch_of(schema, zip(*out, strict=True))
        if own and (out := whole(own)):
            yield batch_of(schema, zip(*out, strict=True))

    return run


def likeness():
    """Rows sorted by part, salt, the pivot first, to part, node and like: how alike with the pivot each other text is."""
    schema = pa.schema([("part", pa.int64()), ("node", pa.int64()), ("like", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, pivot = None, np.zeros(0, dtype="<u8")
        for whole in batches:
            for batch in slices(whole, "set", AT_ONCE):
                salted = np.stack([batch.column(c).to_numpy() for c in ("part", "salt")])
                start = np.flatnonzero(np.concatenate([[True], (salted[:, 1:] != salted[:, :-1]).any(axis=0)]))
                for s, e in zip(start, np.append(start[1:], batch.num_rows), strict=True):
                    own = [np.frombuffer(x, dtype="<u8") for x in batch.column("set").slice(s, e - s).to_pylist()]
                    if key != (key := tuple(salted[:, s].tolist())):
                        pivot, own, s = own[0], own[1:], s + 1
                    if own:
                        yield batch_of(schema, [*(batch.column(c).slice(s, e - s) for c in ("part", "node")), alike([pivot], own)[0]])

    return run


def around_pivots(parts: DataFrame, known: DataFrame, least: float, block: int, most: int, rounds: int = PIVOTS) -> tuple[DataFrame, list[DataFrame]]:
    """parts (node, fp, part) of which those over `most` texts keep only what links to their pivots leave open, and these links (a, b)."""
    small, found = [], []
    for turn in range(rounds):
        sized = parts.groupBy("part").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64(F.lit(turn), "node"), "node"))["node"].alias("pivot"))
        marked = settled(parts.join(sized, "part"))
        small.append(marked.filter(F.col("n") <= most).select("node", "fp", "part"))
        large = marked.filter(F.col("n") > most)
        if large.isEmpty():
            parts = None
            break
        salts = F.ceil(F.col("n") / block)
        pivots = large.filter("node = pivot").select("part", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), "node", F.lit(0).alias("place"))
        others = large.filter("node != pivot").select("part", F.pmod(F.xxhash64("node", "part"), salts).alias("salt"), "node", F.lit(1).alias("place"))
        rows = pivots.unionByName(others).join(known, "node").select("part", "salt", "place", "node", "set")
        like = rows.repartition("part", "salt").sortWithinPartitions("part", "salt", "place").mapInArrow(likeness(), "part long, node long, like double")
        like = settled(large.filter("node != pivot").join(like, ["part", "node"]))
        found.append(like.filter(F.col("like") >= least).select(F.col("node").alias("a"), F.col("pivot").alias("b")))
        # A text that is alike with the pivot can be alike with one that isn't only if the two are no further apart than 1 - least.
        closest = like.filter(F.col("like") < least).groupBy("part").agg(F.max("like").alias("closest"))
        parts = like.join(closest, "part").filter(F.col("like") <= F.col("closest") + (1 - least + 1e-9)).select("node", "fp", "part")
    left = [*small, parts] if parts is not None else small
    return reduce(DataFrame.unionByName, left), found


def nominated(texts: DataFrame, radius: int, small: int) -> DataFrame:
    """node, fp, part: the groups of near fingerprints of each kind, but for those that lie within one of an earlier kind of at most `small` texts."""
    kinds = texts.select("node", F.posexplode(F.array(*_FPS)).alias("k", "fp"))
    classes = settled(kinds.groupBy("k", "fp").agg(F.count("*").alias("n")))
    near = stars(links(classes.select(F.col("k").alias("bucket"), "fp"), radius, BUCKET, NEAR_PARTS))
    members = near.select(F.col("node").alias("fp"), "root").unionByName(near.select(F.col("root").alias("fp"), "root")).unionByName(classes.filter("n > 1").select("fp", F.col("fp").alias("root")))
    # A fingerprint of several texts has its group's root here, or else itself.
    members = members.groupBy("fp").agg(F.min(F.struct((F.col("root") == F.col("fp")).alias("own"), "root"))["root"].alias("root"))
    parts = kinds.join(members, "fp").select("node", "k", "fp", F.xxhash64("k", "root").alias("part"))
    parts = settled(parts.join(parts.groupBy("part").agg(F.count("*").alias("n")).filter("n > 1"), "part"))
    earlier = [F.max(F.when((F.col("k") == j) & (F.col("n") <= small), F.col("part"))).alias(f"p{j}") for j in range(FAMILY - 1)]
    inside = F.lit(False)
    for j in range(FAMILY - 1):
        inside |= (F.max("k") > j) & (F.count(f"p{j}") == F.count("*")) & F.coalesce(F.min(f"p{j}") == F.max(f"p{j}"), F.lit(False))
    again = parts.join(parts.groupBy("node").agg(*earlier), "node").groupBy("part").agg(inside.alias("inside")).filter("inside").select("part")
    return parts.join(again, "part", "left_anti").select("node", "fp", "part")


def groups(documents: DataFrame, radius: int = NEAR_BITS, least: float = LEAST, block: int = BLOCK, many: int = MANY_BLOCKS) -> DataFrame:
    """doc_id, digest, other and root (of the group of texts that are alike) of every document."""
    rows = table_in_shared_folder(families(documents))
    texts = rows.groupBy("digest", "other").agg(*(F.min(c).alias(c) for c in (*_FPS, "doc_id")))
    # A text's number is its digest, unless another text of the same digest has it.
    first = F.col("other") == F.min("other").over(Window.partitionBy("digest"))
    texts = settled(texts.withColumn("node", F.when(first, F.col("digest")).otherwise(F.xxhash64("digest", "other"))))
    parts = settled(nominated(texts, radius, AROUND * block))
    touched = texts.join(parts.select("node").distinct(), "node", "left_semi")
    known = settled(sets(documents, touched.select("node", "digest", "other", "doc_id")))
    parts, found = around_pivots(parts, known, least, block, AROUND * block)
    dealt = in_blocks(parts, radius, NEAR_PARTS, block, many)
    compared = dealt.join(known, "node").repartition("part", "i", "j").sortWithinPartitions("part", "i", "j").mapInArrow(compare_sets(least), "a long, b long")
    named = texts.join(stars(reduce(DataFrame.unionByName, found, compared)), "node", "left")
    return rows.select("doc_id", "digest", "other").join(named.select("digest", "other", F.coalesce("root", "node").alias("root")), ["digest", "other"])


def keep_one(documents: DataFrame) -> DataFrame:
    """The document of the smallest id of each group of texts that are alike, with all its columns; of rows equal in id and text, one."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "other")).alias("keeper")
    keepers = groups(documents).groupBy("root").agg(first).select("keeper.doc_id", "keeper.digest", "keeper.other")
    whole = F.struct(*(F.col(f"`{c}`") for c in documents.columns))
    rows = documents.select(whole.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    rows = told(rows.withColumn("digest", F.xxhash64("text"))).drop("text")
    same = rows["doc_id"].eqNullSafe(keepers["doc_id"]) & (rows["digest"] == keepers["digest"]) & (rows["other"] == keepers["other"])
    return rows.join(keepers, same, "left_semi").dropDuplicates(["doc_id", "digest", "other"]).select("row.*")
