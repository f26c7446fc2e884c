"""Copies of images, cropped or edited ones too, by local descriptors.

Corners are found on several scales (Harris response, local maxima, the strongest for each stretch of
area). A corner's direction is that of its patch's centre of brightness; 128 comparisons of blurred
brightness, turned by that direction, are its descriptor. Descriptors meet in Hamming tables: a table
keys them by a fixed choice of KEY_BITS of their bits, so that two that differ in few bits share a
key in some table. Two images are candidates if under one key they have descriptors within CLOSE of
each other, or under any keys two pairs of different corners within NEAR that agree on turn, scale and
shift: at 11 bits and more hardly one meeting in a hundred is of copies, and their number grows with
the square of the corners, so those alone send no image anywhere. Of a candidate all corners of the one are compared with all corners of the other, whatever their
keys: those within NEAR that are each other's nearest match (many corners of any two smooth images are
within NEAR, and would agree by chance). Matches of two images vote for the turn, scale and shift that would bring one onto the other;
images with LEAST matches that agree, and one more for each CHANCE of all their matches, are linked, and
linked images form components. Of two unlike pictures with 80 chance matches, four agree about once in
a thousand times, and each more is some fifty times as rare.

Two descriptors that differ in d bits share a key with probability 1 - (1 - (1 - d/128)^24)^4, about:
0.84 at 5 bits, 0.46 at 10 (CLOSE), 0.18 at 15, 0.07 at 20 (NEAR). Up to CLOSE one pair of an image's
corners is enough: four pairs at 10 bits bring two copies together with 0.91. Beyond it two are needed:
twenty pairs at 15 bits bring them together with 0.90, twenty at 20 bits with 0.41.

No key is cut. All descriptors of a key are compared with each other, those of several tables in the first
that they meet in; a key of more than ROWS descriptors is dealt into blocks, and each two blocks are a key of
their own. So what a key costs grows with the square of its descriptors, in many tasks, each of bounded memory.
The tables are dealt in turns, and candidates are compared in turns of no more pairs than there are classes
(PAIRS at least); what a turn shuffled is removed as it ends. So no exchange holds more than the corners once;
meetings themselves, which are kept, grow with the square of the images that are alike.

Images with equal bytes are one class from the start; the number of links counts the links found.

Defined results: a null image, or one that is no PGM (P5) of at most 8 bits, has no corners and is
linked to nothing but equal bytes; a null id is a page of its class that never names it; repeated rows are pages of one class.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of, cut, slices, table_in_shared_folder
from .components import stars

SCALES = (1.0, 0.75, 0.5)
#: Bits and reach of a descriptor; directions that its pattern is turned to.
TESTS, REACH, TURNS = 128, 8, 36
#: Area of the image for each corner kept on a scale.
AREA = 750
TABLES, KEY_BITS, NEAR, CLOSE, LEAST, CHANCE = 4, 24, 20, 10, 4, 40
#: Descriptors of a key that one task compares whole; comparisons held at once, and pairs given out at once.
ROWS, COMPARED, GIVEN = 2000, 1 << 20, 1 << 18
#: Descriptors of a key that are compared with other keys of as many; pairs of candidates that one turn compares at least.
FEW, PAIRS = 32, 1 << 16
#: Classes of several pages, or of one id, whose digests are broadcast at most.
REPEATED = 100_000
#: Numbers that the lowest bits of a key tell its table by.
KINDS = 8
#: Corners of an image at most.
MOST = 1 << 12
MARGIN = 12
#: Matches agree within a cell of so many points and so much of a turn.
CELL_SIZE, ANGLE = 48.0, np.pi / 6
#: Points of images worked on together: what is held of them fits into a core's cache.
AT_ONCE = 100_000


def read_pgm(data: bytes | None) -> np.ndarray | None:
    """Brightness of a binary grey map; None for anything else."""
    head = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data or b"")
    if not head:
        return None
    width, height, most = map(int, head.groups())
    if not 0 < most < 256 or len(data) - head.end() < width * height or not width * height:
        return None
    return np.frombuffer(data, dtype=np.uint8, count=width * height, offset=head.end()).reshape(height, width)


def write_pgm(image: np.ndarray) -> bytes:
    return b"P5 %d %d 255\n" % image.shape[::-1] + np.ascontiguousarray(image, dtype=np.uint8).tobytes()


def between(n: int, most: int, grow: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """For n places of a scale, which of `most` points each lies beyond and by how much: from whole numbers, so that this is the same however far down a place is."""
    at, of = (2 * np.arange(n) + 1) * grow.denominator - grow.numerator, 2 * grow.numerator
    at = np.clip(at, 0, (most - 1) * of)
    whole = np.minimum(at // of, max(most - 2, 0))
    return whole, (at - whole * of) / of


def shrink(image: np.ndarray, scale: float) -> np.ndarray:
    """By linear interpolation of the blurred image."""
    if scale == 1:
        return image
    grow = Fraction(scale).limit_denominator(64)
    height, width = (max(1, int(n * scale)) for n in image.shape)
    (i, a), (j, b) = (between(n, m, grow) for n, m in zip((height, width), image.shape, strict=True))
    a, b = a[:, None], b[None, :]
    i2, j2 = np.minimum(i + 1, image.shape[0] - 1), np.minimum(j + 1, image.shape[1] - 1)
    top = image[i][:, j] * (1 - b) + image[i][:, j2] * b
    low = image[i2][:, j] * (1 - b) + image[i2][:, j2] * b
    return top * (1 - a) + low * a


def box(x: np.ndarray, r: int) -> np.ndarray:
    """Means over squares of side 2r + 1, edges repeated; each from its own square alone."""
    wide = np.pad(x, r, mode="edge")
    n, m = x.shape
    rows = wide[:n].copy()
    for k in range(1, 2 * r + 1):
        rows += wide[k : k + n]
    out = rows[:, :m].copy()
    for k in range(1, 2 * r + 1):
        out += rows[:, k : k + m]
    out *= np.float32(1 / (2 * r + 1) ** 2)
    return out


@cache
def pattern() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Turned places of the comparisons (turn, test, point, yx), and the disc that directions are taken over."""
    draw = np.random.default_rng(404)
    points = np.clip(draw.normal(scale=REACH / 2, size=(TESTS, 2, 2)), -REACH + 1, REACH - 1)
    angle = np.arange(TURNS) * 2 * np.pi / TURNS
    turn = np.stack([np.stack([np.cos(angle), np.sin(angle)], axis=-1), np.stack([-np.sin(angle), np.cos(angle)], axis=-1)], axis=1)
    turned = np.rint(np.einsum("tij,npj->tnpi", turn, points)).astype(int)
    y, x = np.mgrid[-REACH : REACH + 1, -REACH : REACH + 1]
    disc = np.flatnonzero((x * x + y * y <= REACH * REACH).ravel())
    return turned, y.ravel()[disc], x.ravel()[disc]


def corners(images: list[np.ndarray]) -> list[tuple[int, float, float, float, float, bytes]]:
    """(which image, x, y, scale, direction, descriptor); x and y in the image's own coordinates.

    The images have one width. They are worked on as one column of pictures: what a corner looks at
    stays MARGIN from its image's edges, and heights are padded to whole numbers on every scale, so
    that a corner doesn't depend on what stands above or below.
    """
    out = []
    turned, dy, dx = pattern()
    heights = np.asarray([x.shape[0] for x in images])
    tops = np.concatenate([[0], np.cumsum(-(-heights // 4) * 4)])
    column = np.concatenate([np.pad(x, ((0, int(t) - x.shape[0]), (0, 0)), mode="edge") for x, t in zip(images, np.diff(tops), strict=True)])
    whole = box(column.astype(np.float32), 1)
    most = np.clip(heights * column.shape[1] // AREA, 6, MOST // len(SCALES))
    for scale in SCALES:
        level = shrink(whole, scale).astype(np.float32)
        if level.shape[1] <= 2 * MARGIN + 3 or level.shape[0] <= 2 * MARGIN:
            continue
        wide = np.pad(level, 1, mode="edge")
        gy, gx = wide[2:, 1:-1] - wide[:-2, 1:-1], wide[1:-1, 2:] - wide[1:-1, :-2]
        a, b, c = box(gx * gx, 2), box(gy * gy, 2), box(gx * gy, 2)
        strength = a * b - c * c - np.float32(0.05) * (a + b) ** 2
        mid = strength[1:-1, 1:-1]
        peak = mid > 16.0
        for i in (-1, 0, 1):
            for j in (-1, 0, 1):
                if i or j:
                    other = strength[1 + i : strength.shape[0] - 1 + i, 1 + j : strength.shape[1] - 1 + j]
                    peak &= (mid > other) if (i, j) > (0, 0) else (mid >= other)
        y, x = np.nonzero(peak)
        y, x = y + 1, x + 1
        own = np.searchsorted(tops * scale, y, side="right") - 1
        top = tops[own] * scale
        inside = (y - top >= MARGIN) & (y - top < heights[own] * scale - MARGIN) & (x >= MARGIN) & (x < level.shape[1] - MARGIN)
        y, x, own = y[inside], x[inside], own[inside]
        order = np.lexsort((x, y, -strength[y, x], own))
        y, x, own = y[order], x[order], own[order]
        rank = np.arange(len(own)) - np.searchsorted(own, own, side="left")
        keep = rank < most[own]
        y, x, own = y[keep], x[keep], own[keep]
        if not len(y):
            continue
        smooth = box(level, 1)
        patch = smooth[y[:, None] + dy, x[:, None] + dx]
        angle = np.arctan2((patch * dy).sum(axis=1), (patch * dx).sum(axis=1))
        at = turned[np.rint(angle * TURNS / (2 * np.pi)).astype(int) % TURNS]
        seen = smooth[y[:, None, None] + at[..., 0], x[:, None, None] + at[..., 1]]
        bits = np.packbits(seen[..., 0] < seen[..., 1], axis=1)
        px, py = x / scale, (y - tops[own] * scale) / scale
        out += [(int(i), float(u), float(v), scale, float(t), d.tobytes()) for i, u, v, t, d in zip(own, px, py, angle, bits, strict=True)]
    return out


#: Numbers that a corner takes: two of 64 comparisons each, and one of its place, scale and direction.
EACH = 3
_X, _Y, _SCALE = 1 << 37, 1 << 13, 1 << 9


def packed(corner: tuple[float, float, float, float, bytes]) -> list[int]:
    """A corner's numbers: places to half a point, directions to a 512th of a turn."""
    x, y, scale, direction, bits = corner
    at = round(2 * x) * _X + min(round(2 * y), (1 << 24) - 1) * _Y + SCALES.index(scale) * _SCALE + round(direction * 512 / (2 * np.pi)) % 512
    return [*np.frombuffer(bits, dtype="<i8").tolist(), at]


def pictured(batch: pa.RecordBatch, column: str, picture: Callable[[object], bytes | None] | None) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Runs of rows with their images, AT_ONCE bytes or one image at least: what the column holds, or what picture makes of it."""
    for part in slices(batch, column, AT_ONCE):
        start, size, images = 0, 0, []
        for x in part.column(column):
            images.append(x.as_py() if picture is None else picture(x.as_py()))
            size += len(images[-1] or b"")
            if size >= AT_ONCE:
                yield part.slice(start, len(images)), images
                start, size, images = start + len(images), 0, []
        if images:
            yield part.slice(start), images


def features(images: DataFrame, column: str = "image", picture: Callable[[object], bytes | None] | None = None) -> DataFrame:
    """page_id, digest and corners (EACH numbers for each corner) from page_id and image, or from what picture makes an image of in the task that looks for its corners."""
    schema = pa.schema([("page_id", pa.int64()), ("digest", pa.binary()), ("corners", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, data in pictured(whole, column, picture):
                by_width: dict[int, list[tuple[int, np.ndarray]]] = {}
                for i, x in enumerate(data):
                    if (image := read_pgm(x)) is not None:
                        by_width.setdefault(image.shape[1], []).append((i, image))
                found: list[list[int]] = [[] for _ in data]
                for group in by_width.values():
                    for c in corners([x for _, x in group]):
                        own = found[group[c[0]][0]]
                        if len(own) < MOST * EACH:
                            own += packed(c[1:])
                yield batch_of(schema, [batch.column("page_id"), [hashlib.sha256(x or b"").digest() for x in data], found])

    return images.select("page_id", column).mapInArrow(run, "page_id long, digest binary, corners array<long>")


def masks(level: int) -> list[list[int]]:
    """The bits of each table, as two numbers of 64 bits."""
    draw = np.random.default_rng(24 + level)
    chosen = [draw.choice(TESTS, KEY_BITS, replace=False).tolist() for _ in range(TABLES)]
    return [[sum(1 << (b % 64) for b in c if b // 64 == w) for w in range(2)] for c in chosen]


def deal(rows: DataFrame, t: int) -> DataFrame:
    """class_id, d0, d1, at dealt out by their key of table t. Keys don't travel: they are made again from the descriptor."""
    kept = [F.col(d).bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for d, m in zip(("d0", "d1"), masks(0)[t], strict=True)]
    key = F.xxhash64(F.lit(t), *kept).bitwiseAND(F.lit(-KINDS)).bitwiseOR(F.lit(t))
    return rows.repartition(key).select(key.alias("key"), F.lit(0).alias("side"), "class_id", "d0", "d1", "at")


def in_blocks(rows: DataFrame, most: int) -> DataFrame:
    """Rows of large keys (key, class_id, d0, d1, at) as rows of each two blocks of their key: any two meet in one cell.

    side: 0 where a block is compared with itself, else 1 and 2, and rows of one side are not compared.
    """
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") * 2 / most).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("class_id", "d0", "d1", "at"), F.col("blocks")).cast("int")
    cells = rows.join(sizes, "key").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).bitwiseAND(F.lit(-KINDS)).bitwiseOR(F.col("key").bitwiseAND(F.lit(KINDS - 1)))
    side = F.when(F.col("own") < F.col("other"), 1).when(F.col("own") > F.col("other"), 2).otherwise(0)
    return cells.select(cell.alias("key"), side.alias("side"), "class_id", "d0", "d1", "at").repartition("key")


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits; of signed numbers numpy would count those of the absolute value."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def votes(p: np.ndarray, q: np.ndarray) -> Iterator[np.ndarray]:
    """For pairs of corners, given as numbers of their places: rows of scale, turn and shift that bring p's image onto q's, in cells.

    Two grids, one shifted by half a cell in everything: what an edge of the one parts lies within a cell of the other.
    """
    (px, py, ps, pd), (qx, qy, qs, qd) = (((v >> 37) / 2, ((v >> 13) & ((1 << 24) - 1)) / 2, np.asarray(SCALES)[(v >> 9) & 15], (v & 511) * (2 * np.pi / 512)) for v in (p, q))
    turn, grow = np.mod(qd - pd, 2 * np.pi), ps / qs
    dx = qx - grow * (np.cos(turn) * px - np.sin(turn) * py)
    dy = qy - grow * (np.sin(turn) * px + np.cos(turn) * py)
    times = np.rint(np.log2(grow) * 2)
    for g in (0, 1):
        yield np.stack([times, np.mod(np.floor(turn / ANGLE + g / 2), round(2 * np.pi / ANGLE)), np.floor(dx / CELL_SIZE + g / 2), np.floor(dy / CELL_SIZE + g / 2)]).astype(np.int64)


_FOUND = pa.schema([(c, pa.int64()) for c in ("a", "b", "key", "d0", "d1", "at")])
_FOUND_DDL = "a long, b long, key long, d0 long, d1 long, at long"


def found_batch(**columns: np.ndarray) -> pa.RecordBatch:
    """Rows with nulls in the columns that are not given."""
    n = len(next(iter(columns.values())))
    return batch_of(_FOUND, [columns.get(c, pa.nulls(n, pa.int64())) for c in _FOUND.names])


def compare(most: int | None):
    """Sorted rows (key, side, class_id, d0, d1, at) to candidates (a < b), votes of distant pairs (a < b, key: the cell, d0 and d1: the places) and the rows of keys over `most` (a, key, d0, d1, at)."""
    tables = np.asarray(masks(0), dtype=np.uint64).view(np.int64)

    def rest(rows: np.ndarray) -> pa.RecordBatch:
        return found_batch(a=rows[2], key=rows[0], d0=rows[3], d1=rows[4], at=rows[5])

    def near(rows: np.ndarray) -> Iterator[np.ndarray]:
        """Pairs of a key's rows within NEAR."""
        n, side = rows.shape[1], rows[1]
        step = max(1, COMPARED // n)
        for at in range(0, n, step):
            some = rows[:, at : at + step]
            close = sum(differing(some[d][:, None], rows[d][None, :]) for d in (3, 4)) <= NEAR
            close &= np.arange(at, at + some.shape[1])[:, None] < np.arange(n)
            close &= (some[1][:, None] != side) | (side == 0)
            yield np.stack(np.nonzero(close)) + [[at], [0]]

    def given(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
        i, j = np.where(rows[2, i] < rows[2, j], i, j), np.where(rows[2, i] < rows[2, j], j, i)
        fresh, table = rows[2, i] != rows[2, j], rows[0, i] & (KINDS - 1)
        for t, m in enumerate(tables):  # what met in an earlier table was compared there
            fresh &= (t >= table) | (((rows[3, i] ^ rows[3, j]) & m[0] | (rows[4, i] ^ rows[4, j]) & m[1]) != 0)
        i, j = i[fresh], j[fresh]
        close = differing(rows[3, i], rows[3, j]) + differing(rows[4, i], rows[4, j]) <= CLOSE
        a, b = np.unique(rows[2][np.stack([i, j])[:, close]], axis=1)
        yield found_batch(a=a, b=b)
        i, j = i[~close], j[~close]
        for g, (times, turn, dx, dy) in enumerate(votes(rows[5, i], rows[5, j])):
            cell = (dy & ((1 << 24) - 1)) << 36 | (dx & ((1 << 24) - 1)) << 12 | turn << 6 | (times + 8) << 1 | g
            yield found_batch(a=rows[2, i], b=rows[2, j], key=cell, d0=rows[5, i], d1=rows[5, j])

    def whole(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
        size = np.diff(np.append(start, rows.shape[1]))
        found, held = [], 0
        for n in np.unique(size[(size > 1) & (size <= min(FEW, most or FEW))]):  # keys of as many rows at once
            first, second = np.triu_indices(n, 1)
            at, step = start[size == n], max(1, COMPARED // len(first))
            for k in range(0, len(at), step):
                i, j = ((at[k : k + step, None] + x).ravel() for x in (first, second))
                close = differing(rows[3, i], rows[3, j]) + differing(rows[4, i], rows[4, j]) <= NEAR
                close &= (rows[1, i] != rows[1, j]) | (rows[1, i] == 0)
                found.append(np.stack([i[close], j[close]]))
                held += found[-1].shape[1]
                if held > GIVEN:
                    yield from given(rows, *np.concatenate(found, axis=1))
                    found, held = [], 0
        more = size > min(FEW, most or FEW)
        for s, n in zip(start[more], size[more], strict=True):
            if most is not None and n > most:
                yield rest(rows[:, s : s + n])
                continue
            for pairs in near(rows[:, s : s + n]):
                found.append(pairs + s)
                held += pairs.shape[1]
                if held > GIVEN:
                    yield from given(rows, *np.concatenate(found, axis=1))
                    found, held = [], 0
        if held:
            yield from given(rows, *np.concatenate(found, axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = np.zeros((6, 0), dtype=np.int64), None
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("key", "side", "class_id", "d0", "d1", "at")])
            if large is not None:  # the rest of a key that is known to be too large
                n = int(np.searchsorted(rows[0], large, side="right"))
                if n:
                    yield rest(rows[:, :n])
                rows, large = rows[:, n:], large if n == rows.shape[1] else None
            held = np.concatenate([held, rows], axis=1)
            if not held.shape[1]:
                continue
            tail = int(np.searchsorted(held[0], held[0, -1], side="left"))
            if tail:
                yield from whole(held[:, :tail])
            held = held[:, tail:]
            if most is not None and held.shape[1] > most:
                yield rest(held)
                large, held = held[0, 0], held[:, :0]
        if held.shape[1]:
            yield from whole(held)

    return run


def candidates(classes: DataFrame, most: int) -> DataFrame:
    """Pairs (a < b) of classes."""
    i = F.explode(F.when(F.size("corners") > 0, F.sequence(F.lit(0), F.floor(F.size("corners") / EACH).cast("int") - 1)).otherwise(F.array().cast("array<int>")))
    rows = classes.select("class_id", "corners", i.alias("i"))
    rows = rows.select("class_id", F.element_at("corners", F.col("i") * EACH + 1).alias("d0"), F.element_at("corners", F.col("i") * EACH + 2).alias("d1"), F.element_at("corners", F.col("i") * EACH + 3).alias("at"))
    compared = lambda dealt, size: table_in_shared_folder(dealt.sortWithinPartitions("key").mapInArrow(compare(size), _FOUND_DDL), tidy=True)
    tables = [compared(deal(rows, t), most) for t in range(TABLES)]
    out = reduce(DataFrame.unionByName, tables)
    meetings, large = out.filter("b is not null").select("a", "b", "key", "d0", "d1"), out.filter("b is null").select("key", F.col("a").alias("class_id"), "d0", "d1", "at")
    if not large.isEmpty():
        meetings = meetings.unionByName(compared(in_blocks(large, most), None).select("a", "b", "key", "d0", "d1"))
    # A candidate's key is null; a cell counts where two corners of each image vote for it.
    agree = meetings.repartition("a", "b", "key").groupBy("a", "b", "key").agg(*[f(d).alias(f.__name__ + d) for d in ("d0", "d1") for f in (F.min, F.max)])
    return agree.filter("key is null or (mind0 < maxd0 and mind1 < maxd1)").select("a", "b").distinct()


def agreed(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """For each pair of images, given as rows of numbers of their corners: the most matches that agree on turn, scale and shift; zero where chance may do as well."""
    at = []
    for k, (p, q) in enumerate(zip(one, two, strict=True)):
        if not len(p) or not len(q):
            continue
        differ = differing(p[:, None, 0], q[None, :, 0]) + differing(p[:, None, 1], q[None, :, 1])
        i, j = np.nonzero((differ <= NEAR) & (differ == differ.min(axis=1)[:, None]) & (differ == differ.min(axis=0)))
        if len(i) >= LEAST:
            at.append(np.stack([np.full(len(i), k), i, j, p[i, 2], q[j, 2]]))
    most = np.zeros(len(one), dtype=np.int64)
    if not at:
        return most
    k, i, j, p, q = np.concatenate(at, axis=1)
    for cell in votes(p, q):
        cell = np.concatenate([k[None], cell])
        cells, own = np.unique(cell, axis=1, return_inverse=True)
        own = own.ravel()
        n = [np.bincount(np.unique(np.stack([own, x]), axis=1)[0], minlength=cells.shape[1]) for x in (i, j)]
        np.maximum.at(most, cells[0], np.minimum(*n))
    return np.where(most >= LEAST + np.bincount(k, minlength=len(one)) // CHANCE, most, 0)


def verified(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b, matches of the pairs with enough matches that agree."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("matches", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p, q = ([x.values.to_numpy().reshape(-1, EACH) for x in batch.column(c)] for c in ("p", "q"))
            turned = batch.column("turned").to_pylist()
            n = agreed([y if t else x for x, y, t in zip(p, q, turned, strict=True)], [x if t else y for x, y, t in zip(p, q, turned, strict=True)])
            keep = n >= LEAST
            yield batch_of(schema, [batch.column(c).to_numpy()[keep] for c in ("a", "b")] + [n[keep]])

    # The image of fewer corners goes to the other.
    sizes = classes.select("class_id", F.size("corners").alias("n"))
    known = pairs.join(sizes.toDF("a", "n_a"), "a").join(sizes.toDF("b", "n_b"), "b").withColumn("turned", F.col("n_b") < F.col("n_a"))
    known = known.select("a", "b", "turned", F.when(F.col("turned"), F.col("b")).otherwise(F.col("a")).alias("sent"), F.when(F.col("turned"), F.col("a")).otherwise(F.col("b")).alias("to"))
    both = known.join(classes.select(F.col("class_id").alias("sent"), F.col("corners").alias("p")), "sent").join(classes.select(F.col("class_id").alias("to"), F.col("corners").alias("q")), "to")
    return both.select("a", "b", "turned", "p", "q").mapInArrow(run, "a long, b long, matches long")


def links(classes: DataFrame, most: int = ROWS, few: int | None = None) -> DataFrame:
    """a, b (classes, a < b), matches: the most matches of the two that agree on turn, scale and shift.

    most: descriptors of a key that one task compares whole; larger keys are compared in blocks. few: of no use any more, nothing is left out however many meet.
    """
    pairs = table_in_shared_folder(candidates(classes, most), tidy=True)
    turns = -(-pairs.count() // max(PAIRS, classes.count())) or 1
    turn = F.pmod(F.xxhash64("a", "b"), F.lit(turns))
    return reduce(DataFrame.unionByName, [table_in_shared_folder(verified(pairs.filter(turn == k), classes), tidy=True) for k in range(turns)])


def first_pages(pages: DataFrame, classes: DataFrame) -> DataFrame:
    """class_id and corners: one page of each class (digest, class_id, n: its pages). Corners of a page that alone has its digest and id stay where they are, unless too many are not alone."""
    named = F.col("page_id").alias("class_id")
    again = classes.groupBy("class_id").agg(F.max("n").alias("most"), F.count("*").alias("of")).filter("most > 1 or of > 1")
    repeated = cut(classes.join(again.select("class_id"), "class_id"))
    # Rows equal throughout are told apart by nothing, so one of them is taken.
    one = lambda some, of: some.join(of.select(F.col("class_id").alias("page_id")), "page_id", "left_semi").dropDuplicates(["page_id"]).select(named, "corners")
    if repeated.count() > REPEATED:
        return one(pages, classes)
    digests = F.broadcast(repeated.select("digest"))
    lone = pages.join(digests, "digest", "left_anti").filter("page_id is not null").select(named, "corners")
    return lone.unionByName(one(pages.join(digests, "digest", "left_semi"), repeated))


def copies(images: DataFrame, column: str = "image", picture: Callable[[object], bytes | None] | None = None) -> DataFrame:
    """page_id, class_id, component_id, n_links from page_id and image, or from what picture makes an image of."""
    pages = table_in_shared_folder(features(images, column, picture))
    classes = cut(pages.groupBy("digest").agg(F.min("page_id").alias("class_id"), F.count("*").alias("n")))
    found = links(first_pages(pages, classes))
    roots = stars(found.select("a", "b"))
    ends = found.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    known = classes.join(ends, "class_id", "left").join(roots.withColumnRenamed("node", "class_id"), "class_id", "left")
    known = known.select("digest", "class_id", F.coalesce("root", "class_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return pages.select("page_id", "digest").join(known, "digest").select("page_id", "class_id", "component_id", "n_links")


COLUMNS, CELL = 64, 2


@cache
def glyphs() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 256, size=(256, CELL, CELL), dtype=np.uint8)


def draw(text: str) -> bytes:
    """The text as a grey map: COLUMNS signs a line, each byte a fixed speckle of CELL by CELL."""
    data = np.frombuffer(" ".join(text.split()).encode().ljust(1), dtype=np.uint8)
    rows = -(-len(data) // COLUMNS)
    grid = np.full(rows * COLUMNS, 32, dtype=np.uint8)
    grid[: len(data)] = data
    return write_pgm(glyphs()[grid.reshape(rows, COLUMNS)].transpose(0, 2, 1, 3).reshape(rows * CELL, COLUMNS * CELL))


_TAG = re.compile(r"<(?:(script|style)\b)?")


def printed(html: str) -> str:
    """The text with a space for each tag, and for each script or style up to its end; what is never closed is text. One pass, whatever is left open."""
    out, at, open_for = [], 0, {}
    while (tag := _TAG.search(html, at)) is not None:
        start, kind, end = tag.start(), tag.group(1), -1
        if kind and kind not in open_for:
            end = html.find(close := f"</{kind}>", tag.end())
            if end < 0:
                open_for[kind] = True
            else:
                end += len(close)
        if end < 0:
            end = html.find(">", tag.start()) + 1
            if not end:
                break
        out += [html[at:start], " "]
        at = end
    return "".join([*out, html[at:]])


def page_image(html: str | None) -> bytes:
    """A page's text as it would be printed, since the tables have no media of their own."""
    return draw(printed(html or ""))


def page_images(pages: DataFrame) -> DataFrame:
    """page_id and image of each page."""
    schema = pa.schema([("page_id", pa.int64()), ("image", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, images in pictured(batch, "html", page_image):
                yield batch_of(schema, [part.column("page_id"), images])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, image binary")


def page_copies(pages: DataFrame) -> DataFrame:
    """copies() of the images of pages (page_id, html). Images, four points a sign, are drawn where they are looked at and never leave their task."""
    return copies(pages.select(F.col("page_id").cast("long").alias("page_id"), "html"), "html", page_image)
