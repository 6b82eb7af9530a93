"""Points near other points, and the regions that contain points.

Method: polygons are triangulated by ear clipping; the triangles are distributed over a hierarchy of bounding volumes, and candidates
are tested exactly. The hierarchy is a linear quadtree over longitude and latitude: a triangle goes to the deepest level whose cells
are at least as large as its bounding box, so it touches four cells at most however large it is; a point looks up its one cell on each
level in use. Both sides meet in an equi-join on (level, column, row), which Spark shuffles, sorts and splits like any other.

The distance search uses the same join: the disc around a point lies in a box, whose two triangles come from one ear clipping of the
unit square; the great-circle distance then decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS_M = 6_378_137.0
DEEPEST = 26  # cells of 0.6 m at the equator
POLAR = 89.0  # degrees; discs beyond use one cell for each pole, as their boxes span all longitudes

Point = tuple[float, float]


def _cross(o: Point, a: Point, b: Point) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def _corners(ring: list[Point]) -> list[Point]:
    """The corners of a ring, counter-clockwise, without repeated ones; [] where it has no area."""
    pts: list[Point] = []
    for p in ring:
        if not pts or p != pts[-1]:
            pts.append(p)
    if len(pts) > 1 and pts[0] == pts[-1]:
        pts.pop()
    area = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1]))
    return pts if area > 0 else pts[::-1] if area < 0 else []


def ear_clip(ring: list[Point]) -> list[tuple[Point, Point, Point]]:
    """Counter-clockwise triangles that cover a simple polygon; repeated and collinear corners are skipped. Degenerate rings give [].

    A ring that crosses itself has no such triangles and is refused. Each corner is tested against all others at once, so the work
    grows with the square of the corners.
    """
    pts = _corners(ring)
    if len(pts) < 3:
        return []
    x, y = (np.array(c, dtype=float) for c in zip(*pts))
    left, whole = list(range(len(pts))), sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1]))
    out, i, idle = [], 0, 0
    while len(left) > 3:
        if idle > len(left):
            raise ValueError("a ring that crosses itself can't be triangulated")
        i %= len(left)
        ia, ib, ic = left[i - 1], left[i], left[(i + 1) % len(left)]
        a, b, c = pts[ia], pts[ib], pts[ic]
        turn = _cross(a, b, c)
        if turn > 0:
            rest = np.array(left)
            px, py = x[rest], y[rest]
            side = lambda o, e: (e[0] - o[0]) * (py - o[1]) - (e[1] - o[1]) * (px - o[0])
            own = ((px == a[0]) & (py == a[1])) | ((px == b[0]) & (py == b[1])) | ((px == c[0]) & (py == c[1]))
            if ((side(a, b) >= 0) & (side(b, c) >= 0) & (side(c, a) >= 0) & ~own).any():
                i, idle = i + 1, idle + 1
                continue
            out.append((a, b, c))
        elif turn < 0:
            i, idle = i + 1, idle + 1
            continue
        left.pop(i)
        i, idle = i - 1 if i else 0, 0
    a, b, c = (pts[k] for k in left)
    if _cross(a, b, c) > 0:
        out.append((a, b, c))
    covered = sum(_cross(*t) for t in out)
    if abs(covered - whole) > 1e-9 * max(1.0, abs(whole)):
        raise ValueError("a ring that crosses itself can't be triangulated")
    return out


def level_for(extent: Column) -> Column:
    """The deepest level whose cells are at least extent degrees wide."""
    return F.least(F.lit(DEEPEST), F.greatest(F.lit(0), F.floor(F.log2(F.lit(360.0) / F.greatest(extent, F.lit(1e-9)))))).cast("int")


def _cell(v: Column, low: float, level: Column) -> Column:
    return F.floor((v - F.lit(low)) * F.pow(F.lit(2.0), level) / F.lit(360.0)).cast("long")


def in_nodes(df: DataFrame, x0: str, x1: str, y0: str, y1: str, level: str) -> DataFrame:
    """df once for each cell (cx, cy) of its level that the box touches; four at most."""
    lv = F.col(level)
    cols = F.sequence(_cell(F.col(x0), -180, lv), _cell(F.col(x1), -180, lv))
    rows = F.sequence(_cell(F.col(y0), -90, lv), _cell(F.col(y1), -90, lv))
    return df.withColumn("cx", F.explode(cols)).withColumn("cy", F.explode(rows))


def usable(lat: Column, lon: Column) -> Column:
    """Whether a row has a position: neither null, NaN nor zero, and within 90 and 180 degrees."""
    ok = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & (lat != 0) & (lon != 0)
    return F.coalesce(ok & (F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = RADIUS_M) -> Column:
    """Metres between two points on a sphere (haversine); null where a coordinate is null."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2.0 * radius) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def points_within(df: DataFrame, metres: float, key: str = "ref_ord", lat: str = "latitude", lon: str = "longitude", radius: float = RADIUS_M) -> DataFrame:
    """(key_a, key_b), key_a < key_b: pairs of rows at most ``metres`` apart on the sphere.

    Rows without a usable position (see usable) are in no pair; equal positions are pairs. Works across the 180th meridian and at the
    poles. key must be unique; further columns are ignored; an empty table gives no rows.
    """
    import math

    half = math.degrees(metres / radius) * (1 + 1e-9) + 1e-12
    pts = df.filter(usable(F.col(lat), F.col(lon))).select(F.col(key).alias("k"), F.col(lat).cast("double").alias("y"), F.col(lon).cast("double").alias("x"))
    if half >= 1:
        raise ValueError("points_within is for distances under 100 km")

    def width(y: Column) -> Column:
        """Half the longitudes that a disc around latitude y spans; y is off the poles."""
        return F.degrees(F.asin(F.lit(math.sin(math.radians(half))) / F.cos(F.radians(F.least(F.abs(y), F.lit(POLAR)))))) * (1 + 1e-9)

    polar = F.abs(F.col("y")) > POLAR
    w = F.when(polar, F.lit(360.0)).otherwise(width(F.col("y")))
    discs = pts.withColumn("w", w)
    level = F.when(polar, F.lit(-1)).otherwise(level_for(2 * F.greatest(F.col("w"), F.lit(half))))
    discs = discs.withColumn("level", level)
    # one ear clipping of the unit square gives the triangles of every box
    corners = [F.array(*[F.lit(c) for p in t for c in p]) for t in ear_clip([(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)])]
    discs = discs.select("*", F.posexplode(F.array(*corners)).alias("t", "u"))
    corner = lambda i: F.get("u", F.lit(i))
    for i in range(3):
        discs = discs.withColumn(f"x{i}", F.col("x") + corner(2 * i) * F.col("w")).withColumn(f"y{i}", F.col("y") + corner(2 * i + 1) * half)
    box = {f"b{c}{n}": f(*[F.col(f"{c}{i}") for i in range(3)]) for c in "xy" for n, f in (("0", F.least), ("1", F.greatest))}
    discs = discs.withColumns(box).drop("u")
    off = in_nodes(discs.filter("level >= 0"), "bx0", "bx1", "by0", "by1", "level")
    at_pole = discs.filter("level < 0").withColumn("cx", F.lit(0).cast("long")).withColumn("cy", F.when(F.col("y") > 0, 1).otherwise(-1).cast("long"))
    tri = off.unionByName(at_pole).select("level", "cx", "cy", F.col("k").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"), "t", *[f"{c}{i}" for i in range(3) for c in "xy"])

    near = 1.0  # degrees from the 180th meridian in which a point also stands on the other side; boxes off the poles are narrower
    copies = F.when(F.col("x") > 180 - near, F.array("x", F.col("x") - 360)).when(F.col("x") < near - 180, F.array("x", F.col("x") + 360)).otherwise(F.array("x"))
    low, high = F.greatest(F.abs(F.col("y")) - 2 * half, F.lit(0.0)), F.abs(F.col("y")) + 2 * half
    lv = lambda y: level_for(2 * F.greatest(width(y), F.lit(half)))
    probes = pts.select("k", "x", "y", F.posexplode(copies).alias("copy", "px"), F.sequence(lv(high), lv(low)).alias("levels"))
    probes = probes.select("k", "x", "y", "px", F.explode("levels").alias("level"))
    probes = probes.withColumn("cx", _cell(F.col("px"), -180, F.col("level"))).withColumn("cy", _cell(F.col("y"), -90, F.col("level")))
    caps = pts.filter(F.abs("y") > POLAR - 2 * half).select("k", "x", "y", F.col("x").alias("px"), F.lit(-1).alias("level"), F.lit(0).cast("long").alias("cx"), F.when(F.col("y") > 0, 1).otherwise(-1).cast("long").alias("cy"))
    probes = probes.unionByName(caps)

    cand = tri.join(probes, ["level", "cx", "cy"]).filter("a < k")
    side = lambda i, j: (F.col(f"x{j}") - F.col(f"x{i}")) * (F.col("y") - F.col(f"y{i}")) - (F.col(f"y{j}") - F.col(f"y{i}")) * (F.col("px") - F.col(f"x{i}"))
    # a point on the edge that both triangles of a box share belongs to the first
    shared = F.when(F.col("t") == 0, F.lit(True)).otherwise((side(0, 1) > 0) & (side(1, 2) > 0) & (side(2, 0) > 0))
    inside = (side(0, 1) >= 0) & (side(1, 2) >= 0) & (side(2, 0) >= 0) & shared
    found = cand.filter(inside & (great_circle(F.col("ay"), F.col("ax"), F.col("y"), F.col("x"), radius) <= metres))
    return found.select(F.col("a").alias(f"{key}_a"), F.col("k").alias(f"{key}_b"))


RINGS = "array<array<array<struct<lon:double,lat:double>>>>"


def triangulated(regions: DataFrame, key: str = "region_id", rings: str = "rings") -> DataFrame:
    """(key, part, hole, t, x0, y0, x1, y1, x2, y2, e0, e1, e2): the triangles of each polygon's rings.

    rings: for each part of a region its outer ring, then its holes, as arrays of (longitude, latitude) structs (RINGS); an array of
    structs alone is one ring. hole: the number of the hole, 0 for the outer ring. e0: whether the edge from corner 0 to 1 lies on the
    ring, and so on. Rings may run either way and may be closed; null rings and those without area have no triangles; a ring
    that crosses itself raises ValueError.
    """
    depth = regions.schema[rings].dataType.simpleString().split("struct")[0].count("array<")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows = []
            for k, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for n, part in enumerate(parts if depth == 3 else [parts if depth == 2 else [parts]]):
                    for hole, ring in enumerate(part or []):
                        corners = [tuple(p.values()) for p in ring or [] if p and None not in p.values()]
                        around = _corners(corners)
                        edges = set(zip(around, around[1:] + around[:1]))
                        for t, tri in enumerate(ear_clip(corners)):
                            on = [_on_ring(p, q, edges) for p, q in zip(tri, tri[1:] + tri[:1])]
                            rows.append((k, n, hole, t, *[c for p in tri for c in p], *on))
            cols = list(zip(*rows)) or [()] * 13
            types = [b.schema.field(0).type, *[pa.int32()] * 3, *[pa.float64()] * 6, *[pa.bool_()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    kind = regions.schema[key].dataType.simpleString()
    schema = f"key {kind}, part int, hole int, t int, " + ", ".join(f"{c}{i} double" for i in range(3) for c in "xy") + ", e0 boolean, e1 boolean, e2 boolean"
    names = [x.split()[0] for x in schema.split(", ")]
    return regions.filter(F.col(rings).isNotNull()).select(key, rings).mapInArrow(batches, schema).withColumnRenamed("key", key)


def _on_ring(p: Point, q: Point, edges: set[tuple[Point, Point]]) -> bool:
    """Whether the edge from p to q lies on the ring: it is an edge, or holds collinear corners that were skipped."""
    if (p, q) in edges:
        return True
    return any(a == p and _cross(p, q, b) == 0 and (b[0] - p[0]) * (q[0] - p[0]) + (b[1] - p[1]) * (q[1] - p[1]) > 0 for a, b in edges)


def regions_of(points: DataFrame, regions: DataFrame, key: str = "ref_ord", lat: str = "latitude", lon: str = "longitude", region: str = "region_id", rings: str = "rings") -> DataFrame:
    """(key, region): the regions that contain each point. Regions that overlap all count; a point on a border shared by several belongs to the least of them, once.

    A point in a hole isn't contained, one on a hole's border is. Points in no region and without a usable position don't appear. key
    and region must be unique; see triangulated() for rings.
    """
    tri = triangulated(regions, region, rings)
    extent = F.greatest(F.greatest("x0", "x1", "x2") - F.least("x0", "x1", "x2"), F.greatest("y0", "y1", "y2") - F.least("y0", "y1", "y2"))
    tri = tri.withColumn("level", level_for(extent))
    levels = [r["level"] for r in tri.select("level").distinct().collect()]  # at most DEEPEST + 1
    box = {f"b{c}{n}": f(*[F.col(f"{c}{i}") for i in range(3)]) for c in "xy" for n, f in (("0", F.least), ("1", F.greatest))}
    tri = in_nodes(tri.withColumns(box), "bx0", "bx1", "by0", "by1", "level").drop(*box)
    pts = points.filter(usable(F.col(lat), F.col(lon))).select(F.col(key).alias("_k"), F.col(lat).cast("double").alias("_y"), F.col(lon).cast("double").alias("_x"))
    pts = pts.withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels]) if levels else F.array().cast("array<int>")))
    pts = pts.withColumn("cx", _cell(F.col("_x"), -180, F.col("level"))).withColumn("cy", _cell(F.col("_y"), -90, F.col("level")))
    side = lambda i, j: (F.col(f"x{j}") - F.col(f"x{i}")) * (F.col("_y") - F.col(f"y{i}")) - (F.col(f"y{j}") - F.col(f"y{i}")) * (F.col("_x") - F.col(f"x{i}"))
    hit = tri.join(pts, ["level", "cx", "cy"]).filter((side(0, 1) >= 0) & (side(1, 2) >= 0) & (side(2, 0) >= 0))
    edge = ((side(0, 1) == 0) & F.col("e0")) | ((side(1, 2) == 0) & F.col("e1")) | ((side(2, 0) == 0) & F.col("e2"))
    # a triangle's edge inside its ring is no border
    rings_ = hit.groupBy("_k", region, "part", "hole").agg(F.max(edge).alias("edge"))
    parts = rings_.groupBy("_k", region, "part").agg(F.max(F.col("hole") == 0).alias("outer"), F.max((F.col("hole") > 0) & ~F.col("edge")).alias("lost"), F.max("edge").alias("edge"))
    found = parts.filter("outer and not lost").groupBy("_k", region).agg(F.min("edge").alias("edge"))
    inside = found.filter("not edge").select("_k", region)
    border = found.filter("edge").groupBy("_k").agg(F.min(region).alias(region))
    return inside.unionByName(border).select(F.col("_k").alias(key), region)
