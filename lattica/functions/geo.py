"""Geometry in well-known binary: kind, reference system and single parts by built-in functions; geometry of several parts, and whether two share a point, by NumPy over Arrow batches."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _byte(wkb: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(wkb, at, 1)), 16, 10).cast("long")


def _order(wkb: Column, first: int, n: int) -> Column:
    """Hex digits of n bytes from `first` on, most significant byte first."""
    big = F.hex(F.substring(wkb, first, n))
    little = F.concat(*(F.hex(F.substring(wkb, first + n - 1 - i, 1)) for i in range(n)))
    return F.when(_byte(wkb, 1) == 1, little).otherwise(big)


def wkb_kind(wkb: Column) -> Column:
    """1 point, 2 line, 3 polygon, 4 to 6 their collections, 7 mixed; flags, or thousands, for a reference system or more dimensions don't matter."""
    return (F.conv(_order(wkb, 2, 4), 16, 10).cast("long").bitwiseAND(F.lit(0xFFFF)) % 1000).cast("int")


def wkb_srid(wkb: Column) -> Column:
    """The reference system where the extended form names one, else null."""
    flagged = F.conv(_order(wkb, 2, 4), 16, 10).cast("long").bitwiseAND(F.lit(0x20000000)) != 0
    return F.when(flagged, F.conv(_order(wkb, 6, 4), 16, 10).cast("int"))


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _whole(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("long")


def _number(wkb: Column, little: Column, first: Column, n: int) -> Column:
    """Hex digits of n bytes from a place on, most significant byte first."""
    return _let(F.hex(F.substring(wkb, first, F.lit(n))), lambda x: F.when(little, F.concat(*(F.substring(x, 2 * (n - 1 - i) + 1, 2) for i in range(n)))).otherwise(x))


def _real(digits: Column) -> Column:
    """A double from its 16 hex digits; null for what is no number."""

    def value(x: Column) -> Column:
        size = F.when(x["power"] == 0, x["part"] * F.pow(F.lit(2.0), F.lit(-1074.0))).otherwise((x["part"] + F.lit(1 << 52)) * F.pow(F.lit(2.0), x["power"] - 1075))
        return F.when(x["power"] < 0x7FF, F.when(x["minus"], -size).otherwise(size))

    def split(x: Column) -> Column:
        high = x["high"]
        return F.struct((F.shiftright(high, 31) == 1).alias("minus"), F.shiftright(high, 20).bitwiseAND(F.lit(0x7FF)).alias("power"), (high.bitwiseAND(F.lit(0xFFFFF)) * F.lit(1 << 32) + x["low"]).alias("part"))

    halves = _let(digits, lambda d: F.struct(_whole(F.substring(d, 1, 8)).alias("high"), _whole(F.substring(d, 9, 8)).alias("low")))
    return _let(_let(halves, split), value)


def wkb_points(wkb: Column) -> Column:
    """Array of (x, y): of a point, a line, or a polygon's outer ring; null for other kinds. A reference system and more dimensions may be there."""

    def layout(head: Column) -> Column:
        flag = lambda bit: (head.bitwiseAND(F.lit(bit)) != 0).cast("int")
        thousands = F.floor(head.bitwiseAND(F.lit(0xFFFF)) / 1000)
        more = F.greatest(flag(0x80000000) + flag(0x40000000), F.when(thousands == 3, 2).when(thousands > 0, 1).otherwise(0))
        kind = (head.bitwiseAND(F.lit(0xFFFF)) % 1000).cast("int")
        return F.struct(kind.alias("kind"), (16 + 8 * more).cast("int").alias("step"), (F.lit(6) + 4 * flag(0x20000000)).alias("start"), (_byte(wkb, 1) == 1).alias("little"))

    def points(h: Column) -> Column:
        counted = h["start"] + F.when(h["kind"] == 3, 4).otherwise(0)
        n = F.when(h["kind"] == 1, F.lit(1)).when(h["kind"] <= 3, _whole(_number(wkb, h["little"], counted, 4)).cast("int"))
        first = F.when(h["kind"] == 1, h["start"]).otherwise(counted + 4)

        def point(i: Column) -> Column:
            return _let(first + i * h["step"], lambda at: F.struct(*(_real(_number(wkb, h["little"], at + k, 8)).alias(name) for k, name in ((0, "x"), (8, "y")))))

        return _let(n, lambda m: F.when(m > 0, F.transform(F.sequence(F.lit(0), m - 1), point)))

    return _let(_let(_whole(_order(wkb, 2, 4)), layout), points)


def wkb_box(wkb: Column) -> Column:
    """west, south, east, north of what wkb_points reads."""

    def box(p: Column) -> Column:
        x, y = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
        return F.struct(F.array_min(x).alias("west"), F.array_min(y).alias("south"), F.array_max(x).alias("east"), F.array_max(y).alias("north"))

    return _let(wkb_points(wkb), box)


def in_box(x: Column, y: Column, west: float, south: float, east: float, north: float) -> Column:
    return x.between(west, east) & y.between(south, north)


def boxes_meet(a: tuple[Column, Column, Column, Column], b: tuple[Column, Column, Column, Column]) -> Column:
    """Boxes (west, south, east, north) that share a point."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


# Geometry of several parts.

_SIDES = ("west", "south", "east", "north")
_BOX = ", ".join(f"{s}: double" for s in _SIDES)
#: kind and srid of the whole, its box, and its parts, each a point (kind 1), a line (2) or a polygon (3) with its box and its rings, the outer one first; points and lines have one.
PART = f"struct<kind: int, {_BOX}, rings: array<struct<xs: array<double>, ys: array<double>>>>"
SHAPE = f"struct<kind: int, srid: int, {_BOX}, parts: array<{PART}>>"
_SIDES_PA = [(s, pa.float64()) for s in _SIDES]
_RING_PA = pa.struct([("xs", pa.list_(pa.float64())), ("ys", pa.list_(pa.float64()))])
_PART_PA = pa.struct([("kind", pa.int32()), *_SIDES_PA, ("rings", pa.list_(_RING_PA))])
_SHAPE_PA = pa.struct([("kind", pa.int32()), ("srid", pa.int32()), *_SIDES_PA, ("parts", pa.list_(_PART_PA))])


def _box(points: np.ndarray) -> dict:
    return dict(zip(_SIDES, [*points.min(axis=0).tolist(), *points.max(axis=0).tolist()], strict=True)) if len(points) else dict.fromkeys(_SIDES)


class _Walk:
    """A cursor over one geometry; each nested part has its own byte order, kind and flags, and begins where the one before ends."""

    def __init__(self, data: bytes):
        self.data, self.at, self.parts = data, 0, []

    def whole(self, order: str) -> int:
        self.at += 4
        return struct.unpack_from(order + "I", self.data, self.at - 4)[0]

    def points(self, order: str, n: int, size: int) -> np.ndarray:
        out = np.frombuffer(self.data, dtype=order + "f8", count=n * size, offset=self.at).reshape(n, size)[:, :2]
        self.at += 8 * n * size
        return out

    def geometry(self) -> tuple[int, int | None]:
        order = "<" if self.data[self.at] == 1 else ">"
        self.at += 1
        head = self.whole(order)
        thousands = (head & 0xFFFF) // 1000
        size = 2 + max(bool(head & 0x80000000) + bool(head & 0x40000000), 2 if thousands == 3 else int(thousands > 0))
        kind = (head & 0xFFFF) % 1000
        srid = self.whole(order) if head & 0x20000000 else None
        if kind == 1:
            rings = [self.points(order, 1, size)]
        elif kind == 2:
            rings = [self.points(order, self.whole(order), size)]
        elif kind == 3:
            rings = [self.points(order, self.whole(order), size) for _ in range(self.whole(order))]
        elif 4 <= kind <= 7:
            for _ in range(self.whole(order)):
                self.geometry()
            return kind, srid
        else:
            raise ValueError(f"kind {kind}")
        rings = [xy[~np.isnan(xy).any(axis=1)] for xy in rings]  # an empty point has no numbers
        if rings and len(rings[0]):
            self.parts.append((kind, [xy for xy in rings if len(xy)]))
        return kind, srid


def shape_of(data: bytes | None) -> dict | None:
    """A geometry's shape; None for what is no geometry. Empty parts are left out; bytes after the end are not looked at."""
    if data is None:
        return None
    walk = _Walk(data)
    try:
        kind, srid = walk.geometry()
    except (struct.error, ValueError, IndexError, RecursionError):
        return None
    parts = [{"kind": k, "rings": [{"xs": xy[:, 0].tolist(), "ys": xy[:, 1].tolist()} for xy in rings]} | _box(np.concatenate(rings)) for k, rings in walk.parts]
    points = np.concatenate([xy for _, rings in walk.parts for xy in rings]) if parts else np.zeros((0, 2))
    return {"kind": kind, "srid": srid, "parts": parts} | _box(points)


def wkb_shape(wkb: Column) -> Column:
    """The shape of a geometry of any kind from 1 to 7, nested parts in either byte order; null for what is no geometry."""

    @F.arrow_udf(SHAPE)
    def shape(column: pa.Array) -> pa.Array:
        return pa.array([shape_of(x) for x in column.to_pylist()], type=_SHAPE_PA)

    return shape(wkb)


def wkb_of(kind: Column, parts: Column) -> Column:
    """Well-known binary of a geometry of kind 1 to 6 from its parts: each a list of pieces (rings of a polygon, else one), each a list of numbers x, y, x, y. Null where either is."""

    def single(kind: int, pieces: list) -> bytes:
        out = struct.pack("<BI", 1, kind)
        if kind == 3:
            out += struct.pack("<I", len(pieces))
        for p in pieces:
            out += (struct.pack("<I", len(p) // 2) if kind > 1 else b"") + np.asarray(p, dtype="<f8").tobytes()
        return out

    @F.arrow_udf("binary")
    def written(kinds: pa.Array, parts: pa.Array) -> pa.Array:
        def one(kind: int | None, of: list | None) -> bytes | None:
            if kind is None or of is None:
                return None
            return single(kind, of[0]) if kind <= 3 else struct.pack("<BII", 1, kind, len(of)) + b"".join(single(kind - 3, p) for p in of)

        return pa.array([one(k, p) for k, p in zip(kinds.to_pylist(), parts.to_pylist(), strict=True)], type=pa.binary())

    return written(kind, parts)


#: Pairs of sides that are compared at once.
MOST = 1 << 16


def pieces(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Slices of neighbours whose sizes add up to `most` at most; what is larger is alone."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
        yield slice(start, end)
        start = end


def runs(first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n numbers from each first on, one run after another; before them, which run each is of."""
    of = np.repeat(np.arange(len(n)), n)
    return of, np.arange(len(of)) + (first - (np.cumsum(n) - n))[of]


class Sides:
    """Parts of shapes (as of PART, none missing) with their sides in flat columns, so that a few steps of NumPy compare many pairs of parts.

    A point, or a ring or line of one, is a side without length; a polygon's rings are closed.
    """

    def __init__(self, parts: pa.StructArray):
        column = dict(zip((f.name for f in parts.type), parts.flatten(), strict=True))
        plain = lambda c: c.to_numpy(zero_copy_only=False)
        self.kind = plain(column["kind"])
        xs, ys = column["rings"].flatten().flatten()
        x, y, n = plain(xs.flatten()), plain(ys.flatten()), plain(xs.value_lengths()).astype(np.int64)
        of_ring = np.repeat(np.arange(len(self.kind)), plain(column["rings"].value_lengths()))[n > 0]
        n = n[n > 0]
        first, last = np.cumsum(n) - n, np.cumsum(n) - 1
        to, there = np.arange(len(x)) + 1, np.ones(len(x), dtype=bool)
        to[last] = first
        # From the last point a side leads back to the first, but for lines, and rings that end where they began.
        there[last] = (n == 1) | ((self.kind[of_ring] == 3) & ((x[last] != x[first]) | (y[last] != y[first])))
        of = np.repeat(of_ring, n)
        self.n = np.bincount(of[there], minlength=len(self.kind))
        self.at = np.cumsum(self.n) - self.n
        self.x, self.y = ((c[there], c[to[there]]) for c in (x, y))
        self.low, self.high = ([f(*c) for c in (self.x, self.y)] for f in (np.minimum, np.maximum))
        begin = np.searchsorted(of, np.arange(len(self.kind)))
        self.start = x[begin], y[begin]
        self.box = [(plain(column[low]), plain(column[high])) for low, high in (("west", "east"), ("south", "north"))]
        #: Least and greatest x + y and x - y: a box turned by half a right angle.
        self.turned = [(np.minimum.reduceat(v, begin), np.maximum.reduceat(v, begin)) for v in (x + y, x - y)]

    def meet(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether parts i and j share a point, pair by pair: sides that touch, or one that lies wholly within the other. Edges belong to a polygon, holes don't."""
        out, at = np.zeros(len(i), dtype=bool), np.arange(len(i))
        for low, high in self.box[::-1] + self.turned:
            near = (low[i] <= high[j]) & (low[j] <= high[i])
            at, i, j = at[near], i[near], j[near]
        for some in pieces(self.n[i] * self.n[j], MOST):
            out[at[some]] = self._meet(i[some], j[some])
        return out

    def _meet(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """As meet: of some pairs, or of one of very many sides."""
        # A point within is found sooner than sides that touch, and mostly there is one, of the smaller part j.
        hit = (self.kind[i] == 3) & self._inside(j, i)
        left = np.flatnonzero(~hit)
        a, b = i[left], j[left]
        if len(i) == 1 and len(a):
            step = max(1, MOST // int(self.n[b[0]]))
            hit[0] = any(self._touch(self.at[a] + k, np.minimum(self.n[a] - k, step), b)[0] for k in range(0, int(self.n[a[0]]), step))
        else:
            hit[left] = self._touch(self.at[a], self.n[a], b)
        left = np.flatnonzero(~hit & (self.kind[j] == 3))
        hit[left] = self._inside(i[left], j[left])
        return hit

    def _touch(self, first: np.ndarray, n: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether one of n sides from `first` on shares a point with a side of part j."""
        pair, a = runs(first, n)
        for (low, high), w, e in zip(self.box, self.low, self.high, strict=True):
            near = (w[a] <= high[j[pair]]) & (low[j[pair]] <= e[a])
            pair, a = pair[near], a[near]
        of, b = runs(self.at[j[pair]], self.n[j[pair]])
        pair, a = pair[of], a[of]
        # Sides on one line cross by their turns wherever they are; their boxes tell.
        for low, high in zip(self.low, self.high, strict=True):
            near = (low[a] <= high[b]) & (low[b] <= high[a])
            pair, a, b = pair[near], a[near], b[near]
        near = self._across(a, b)
        pair, a, b = pair[near], a[near], b[near]
        hit = np.zeros(len(j), dtype=bool)
        hit[pair[self._across(b, a)]] = True
        return hit

    def _across(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the ends of side b lie on the line of side a, or on both hands of it."""
        x, y = self.x[0][a], self.y[0][a]
        dx, dy = self.x[1][a] - x, self.y[1][a] - y
        one, two = (dx * (self.y[end][b] - y) - dy * (self.x[end][b] - x) for end in (0, 1))
        return ((one <= 0) & (two >= 0)) | ((one >= 0) & (two <= 0))

    def _inside(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the first point of part i lies within polygon j: a ray from it crosses the sides of its rings an odd number of times."""
        pair, s = runs(self.at[j], self.n[j])
        y = self.start[1][i][pair]
        spans = (self.y[0][s] > y) != (self.y[1][s] > y)
        pair, s, y = pair[spans], s[spans], y[spans]
        x = self.start[0][i][pair]
        right = x < self.x[0][s] + (y - self.y[0][s]) * (self.x[1][s] - self.x[0][s]) / (self.y[1][s] - self.y[0][s])
        return np.bincount(pair[right], minlength=len(i)) % 2 == 1
