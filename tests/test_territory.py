"""Polygon-to-pixel labels against a brute-force even-odd test."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from terrapix.operators import catalog
from terrapix.operators.catalog import overlap_join
from terrapix.operators.composite import yearly_composite
from terrapix.operators.territory import Raster, presence_labels, ring_edges, study_area, valid_territories


def brute_inside(px, py, ring):
    inside = False
    for (x1, y1), (x2, y2) in zip(ring[:-1], ring[1:]):
        if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


def polygons(seed, n=6, size=20):
    rng = np.random.default_rng(seed)
    out = []
    for pid in range(n):
        cx, cy = rng.uniform(3, size - 3, 2)
        k = int(rng.integers(3, 9))
        ang = np.sort(rng.uniform(0, 2 * np.pi, k))
        rad = rng.uniform(1.0, 6.0, k)  # star-shaped, often non-convex
        pts = [(float(cx + r * np.cos(a)), float(cy + r * np.sin(a))) for a, r in zip(ang, rad)]
        out.append((pid, 2000 + pid % 3, pts + [pts[0]]))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_presence_labels_brute_force(spark, seed):
    size = 20
    polys = polygons(seed, size=size)
    terr = spark.createDataFrame([(p, y, [{"x": x, "y": yy} for x, yy in ring]) for p, y, ring in polys],
                                 "poly_id long, year int, ring array<struct<x:double,y:double>>")
    grid = spark.createDataFrame([(r * size + c, c + 0.5, r + 0.5) for r in range(size) for c in range(size)],
                                 "pixel_id int, px double, py double")
    got = {(r["year"], r["pixel_id"]): r["presence"]
           for r in presence_labels(grid, ring_edges(valid_territories(terr))).collect()}
    years = sorted({y for _, y, _ in polys})
    assert len(got) == len(years) * size * size
    for y in years:
        for r in range(size):
            for c in range(size):
                want = any(brute_inside(c + 0.5, r + 0.5, ring) for _, yy, ring in polys if yy == y)
                assert got[(y, r * size + c)] == int(want), (y, r, c)


def test_study_area_and_validity(spark):
    terr = spark.createDataFrame([(1, 2000, [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 1.0}, {"x": 1.0, "y": 4.0},
                                             {"x": 0.0, "y": 0.0}]),
                                  (2, 2001, None), (3, 2001, [{"x": 9.0, "y": 9.0}])],
                                 "poly_id long, year int, ring array<struct<x:double,y:double>>")
    v = valid_territories(terr)
    assert [r["poly_id"] for r in v.collect()] == [1]
    a = study_area(ring_edges(v), buffer_km=0.001).collect()[0]
    assert (a["x0"], a["y0"], a["x1"], a["y1"]) == (-1.0, -1.0, 5.0, 5.0)
    with pytest.raises(RuntimeError):
        valid_territories(terr.filter("poly_id = 2"))


def test_offset_north_up_raster_by_true_centres(spark):
    rng = random.Random(11)
    raster = Raster(x0=100.0, y0=900.0, dx=30.0, dy=-30.0, n_cols=12, n_rows=9)
    rings = []
    for k in range(6):
        ring = [(rng.uniform(50, 520), rng.uniform(580, 950)) for _ in range(rng.randint(3, 7))]
        rings.append((k, 2000 + k % 2, ring if k % 2 else ring + ring[:1]))  # open and closed
    rings += [(90, 2000, None), (91, 2000, []), (92, 2000, [(0.0, 0.0), (1.0, 1.0)])]
    df = spark.createDataFrame(rings, "poly_id int, year int, ring array<struct<x:double,y:double>>")
    edges = ring_edges(valid_territories(df))
    cells = [(r * 12 + c, 100 + (c + 0.5) * 30.0, 900 - (r + 0.5) * 30.0) for r in range(9) for c in range(12)]
    grid = spark.createDataFrame(cells, "pixel_id int, px double, py double")
    got = {(r["year"], r["pixel_id"]): r["presence"] for r in presence_labels(grid, edges, raster).collect()}

    def inside(px, py, ring):
        hit = False
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            if (y1 > py) != (y2 > py) and px < (x2 - x1) * (py - y1) / (y2 - y1) + x1:
                hit = not hit
        return hit

    want = {(y, i): int(any(inside(px, py, ring) for _, yy, ring in rings[:6] if yy == y))
            for y in (2000, 2001) for i, px, py in cells}
    assert got == want and 0 < sum(want.values()) < len(want)
    assert presence_labels(grid, edges.limit(0), raster).count() == 0


def overlaps(left, right):
    return sorted((i, j) for i, p, q, u, v in left for j, x0, y0, x1, y1 in right if p <= x1 and x0 <= u and q <= y1 and y0 <= v)


RECT = "id int, x0 double, y0 double, x1 double, y1 double"


@pytest.mark.parametrize("hot", [20_000, 2])
@pytest.mark.parametrize("sides", [[185_000.0], [0.0, 3e4, 5e5], [0.0, 1e-7, 0.3, 1.0, 7.0, 4096.0, 3e6]])
def test_scene_join_finds_every_pair_of_any_sizes(spark, sides, hot):
    rng = random.Random(3)

    def rects(n):
        out = []
        for i in range(n):
            x, y = rng.uniform(-1e6, 1e6), rng.choice([0.0, 1.0, rng.uniform(-1e6, 1e6)])
            out.append((i, x, y, x + rng.choice(sides), y + rng.choice(sides)))
        return out + [(n + k, 4.0 * (k % 3), 8.0, 4.0 * (k % 3) + 4.0, 12.0) for k in range(9)]  # on cell borders, repeated

    a, s = rects(40), rects(60)
    got = [(r["l_id"], r["r_id"]) for r in overlap_join(spark.createDataFrame(a, RECT), spark.createDataFrame(s, RECT), hot_cell=hot).collect()]
    assert sorted(got) == overlaps(a, s)


def test_a_large_rectangle_has_few_cells_among_small_ones(spark):
    small = spark.range(400).select(F.col("id").cast("int"), (F.col("id") % 20).cast("double").alias("x0"),
                                    F.floor(F.col("id") / 20).cast("double").alias("y0"),
                                    (F.col("id") % 20 + 0.9).alias("x1"), (F.floor(F.col("id") / 20) + 0.9).alias("y1"))
    large = spark.createDataFrame([(0, -1000.0, -1000.0, 2000.0, 2000.0)], RECT)
    lt, rt = catalog._levelled(large, "l_"), catalog._levelled(small, "r_")
    levels = catalog._levels(lt), catalog._levels(rt)
    for df, p, own, other, left in ((lt, "l_", *levels, True), (rt, "r_", *levels[::-1], False)):
        cells = catalog._cells(df, p, own, other, left)
        assert cells.groupBy(p + "id", "_m").count().agg(F.max("count")).first()[0] <= 4
    assert overlap_join(large, small).count() == 400
    both = small.unionByName(large)
    assert overlap_join(both, both).count() == 400 + 2 * 400 + 1


def test_rectangles_without_bounds_meet_nothing(spark):
    odd = spark.createDataFrame([(1, None, 0.0, 1.0, 1.0), (2, float("nan"), 0.0, 1.0, 1.0), (3, 0.0, 0.0, 1.0, 1.0)], RECT)
    assert [(r["l_id"], r["r_id"]) for r in overlap_join(odd, odd).collect()] == [(3, 3)]
    assert overlap_join(odd.limit(0), odd).count() == 0 and overlap_join(odd, odd.limit(0)).count() == 0


def test_composite_without_ndvi_still_counts_it(spark):
    obs = spark.createDataFrame([(2000, 1, 0.1, 0.5), (2000, 1, 0.3, None), (2001, 1, None, 0.2)], "year int, pixel_id int, RED double, NDVI double")
    rows = {r["year"]: (r["RED"], r["pixel_count"]) for r in
            yearly_composite(obs, bands=("RED",), as_float=False, with_metadata=False).collect()}
    assert rows == {2000: (0.2, 1.0), 2001: (None, 1.0)}


def square(x, y, side):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]


def burned(spark, parts_by_poly, n=12):
    vertex = "array<array<array<struct<x: double, y: double>>>>"
    terr = spark.createDataFrame([(i, 2000, f"/d/{i}.shp", p) for i, p in enumerate(parts_by_poly)],
                                 f"poly_id int, year int, path string, parts {vertex}")
    grid = spark.range(n * n).select(F.col("id").cast("int").alias("pixel_id"), (F.col("id") % n + 0.5).alias("px"),
                                     (F.floor(F.col("id") / n) + 0.5).alias("py"))
    from terrapix.operators.territory import part_edges, valid_parts

    rows = presence_labels(grid, part_edges(valid_parts(terr))).filter("presence = 1").collect()
    return {(r["col_idx"], r["row_idx"]) for r in rows}


def cells(x, y, side):
    return {(i, j) for i in range(x, x + side) for j in range(y, y + side)}


def test_holes_are_cut_out_of_their_own_part(spark):
    holed = [square(0.0, 0.0, 8.0), square(2.0, 2.0, 4.0)]
    assert burned(spark, [[holed]]) == cells(0, 0, 8) - cells(2, 2, 4)
    # An island in the hole is a part of its own; so is one that lies over the ring.
    assert burned(spark, [[holed, [square(3.0, 3.0, 2.0)]]]) == (cells(0, 0, 8) - cells(2, 2, 4)) | cells(3, 3, 2)
    assert burned(spark, [[holed, [square(1.0, 1.0, 6.0)]]]) == cells(0, 0, 8)
    # Another territory's hole does not cut this one, and overlapping parts stay full.
    assert burned(spark, [[holed], [[square(0.0, 0.0, 8.0)]]]) == cells(0, 0, 8)
    assert burned(spark, [[[square(0.0, 0.0, 4.0)], [square(2.0, 2.0, 4.0)]]]) == cells(0, 0, 4) | cells(2, 2, 4)


def test_rings_that_are_no_polygon_go(spark):
    line = [(0.0, 0.0), (5.0, 5.0)]
    assert burned(spark, [[[square(0.0, 0.0, 4.0), line, None], [line, square(6.0, 6.0, 2.0)]], None, [[]]]) == cells(0, 0, 4)
    with pytest.raises(RuntimeError):
        burned(spark, [[[line]], []])
