import math
import random

import pytest

from waypost.operators import nearby


def metres(a, b):
    y1, x1, y2, x2 = map(math.radians, (a[1], a[2], b[1], b[2]))
    return 2 * nearby.RADIUS_M * math.asin(min(1, math.sqrt(math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2)))


def test_points_within_against_brute_force(spark):
    r = random.Random(3)
    spots = [lambda: (r.choice([-1, 1]) * (90 - abs(r.gauss(0, 0.002))), r.uniform(-180, 180)), lambda: (0.001 + r.random() / 100, r.choice([-180.0, 180.0, 179.9995, -179.9995])), lambda: (89 + r.gauss(0, 0.001), 0.01 + r.gauss(0, 0.05)), lambda: (r.gauss(10, 0.005), r.gauss(10, 0.005))]
    rows = [(i, *spots[i % 4]()) for i in range(600)]
    bad = [(9001, None, 1.0), (9002, float("nan"), 1.0), (9003, 0.0, 10.0), (9004, 91.0, 1.0), (9005, 10.0, 181.0)]
    df = spark.createDataFrame(rows + bad, "ref_ord long, latitude double, longitude double")
    want = {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if metres(a, b) <= 200}
    got = [tuple(x) for x in nearby.points_within(df, 200.0).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert nearby.points_within(df.limit(0), 200.0).count() == 0


def area(t):
    (a, b), (c, d), (e, f) = t
    return abs((c - a) * (f - b) - (d - b) * (e - a)) / 2


def test_ear_clipping():
    star = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    assert abs(sum(map(area, nearby.ear_clip(star))) - 10) < 1e-9
    assert abs(sum(map(area, nearby.ear_clip(star[::-1] + [star[-1]]))) - 10) < 1e-9
    assert nearby.ear_clip([(0, 0), (1, 1)]) == [] and nearby.ear_clip([(0, 0), (1, 1), (2, 2)]) == []


def test_crossing_rings_are_refused():
    with pytest.raises(ValueError):
        nearby.ear_clip([(0, 0), (2, 2), (2, 0), (0, 2), (5, 1)])
    with pytest.raises(ValueError):
        nearby.ear_clip([(0, 0), (4, 4), (4, 0), (0, 4), (-1, 2)])


def test_big_rings():
    r = random.Random(1)
    star = [(math.cos(t) * q, math.sin(t) * q) for i in range(1500) for t in [2 * math.pi * i / 1500] for q in [1 + r.random()]]
    want = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(star, star[1:] + star[:1])) / 2
    assert abs(sum(map(area, nearby.ear_clip(star))) - want) < 1e-6


def test_regions(spark):
    ring = lambda *p: [dict(lon=float(x), lat=float(y)) for x, y in p]
    square = lambda x, y, n: ring((x, y), (x + n, y), (x + n, y + n), (x, y + n))
    rows = [(1, [[square(1, 1, 2)]]), (2, [[ring((3, 1), (5, 1), (5, 3), (4, 2), (3, 3))]]), (3, None), (4, [[square(11, 11, 6), square(12, 12, 2)], [square(21, 11, 2)]]), (5, [[square(12, 12, 5)]])]
    regions = spark.createDataFrame(rows, f"region_id int, rings {nearby.RINGS}")
    spots = [(1, 2.0, 2.0), (2, 2.0, 3.0), (3, 2.5, 4.0), (4, 1.5, 4.5), (5, None, 1.0), (6, 3.0, 3.0), (7, 13.0, 13.0), (8, 12.0, 13.0), (9, 16.0, 16.0), (10, 12.0, 22.0), (11, 11.5, 11.5), (12, 2.0, 4.0)]
    pts = spark.createDataFrame(spots, "ref_ord int, latitude double, longitude double")
    got = {tuple(r) for r in nearby.regions_of(pts, regions).collect()}
    # a shared border belongs to the least region, once; holes are outside, their borders inside; overlaps count
    assert got == {(1, 1), (2, 1), (4, 2), (6, 1), (7, 5), (8, 4), (9, 4), (9, 5), (10, 4), (11, 4), (12, 2)}
    assert nearby.regions_of(pts, regions.limit(0)).count() == 0 == nearby.regions_of(pts.limit(0), regions).count()
    one = spark.createDataFrame([(1, rows[0][1][0][0])], "region_id int, ring array<struct<lon:double,lat:double>>")
    assert {tuple(r) for r in nearby.regions_of(pts, one, rings="ring").collect()} == {(1, 1), (2, 1), (6, 1)}
