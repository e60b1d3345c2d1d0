"""Territory polygons: validity, study area and per-pixel presence labels."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapix.functions.paths import path_year


class Raster(NamedTuple):
    """Origin (outer corner of pixel 0, 0), pixel size and, for clipping, shape.

    ``dy`` is negative where rows run from north to south.
    """

    x0: float = 0.0
    y0: float = 0.0
    dx: float = 1.0
    dy: float = 1.0
    n_cols: int | None = None
    n_rows: int | None = None


UNIT = Raster()


def valid_territories(territories: DataFrame, skip: str | None = None,
                      path_col: str = "path", ring_col: str = "ring") -> DataFrame:
    """Drop null and degenerate rings (a closed one needs 4 vertices, an open one 3)
    and, optionally, files whose path contains ``skip`` (e.g. ``".zip"``).

    Raises when no polygon is left.
    """
    ring = F.col(ring_col)
    closed = F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1)
    out = territories.filter(ring.isNotNull() & (F.size(ring) >= F.when(closed, 4).otherwise(3)))
    if skip is not None and path_col in territories.columns:
        out = out.filter(~F.col(path_col).contains(skip))
    if out.isEmpty():
        raise RuntimeError("the territory files hold no usable polygon")
    return out


def ring_edges(territories: DataFrame, ring_col: str = "ring") -> DataFrame:
    """Explode rings ``ARRAY<STRUCT<x,y>>`` to edges ``x1 y1 x2 y2``; open rings are closed.

    Consecutive vertices are paired with array functions inside each row, so
    no shuffle and no per-polygon grouping is needed.
    """
    ring = F.col(ring_col)
    first = F.slice(ring, 1, 1)
    shut = F.when(F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1), ring).otherwise(F.concat(ring, first))
    closed = territories.filter(F.size(ring) >= 2).withColumn("_ring", shut)
    n = F.size("_ring")
    pairs = F.arrays_zip(F.slice("_ring", 1, n - 1).alias("a"), F.slice("_ring", 2, n - 1).alias("b"))
    ids = ["poly_id", "year", *(["part_id"] if "part_id" in territories.columns else [])]
    return (closed.select(*ids, F.explode(pairs).alias("e"))
            .select(*ids, F.col("e.a.x").alias("x1"), F.col("e.a.y").alias("y1"),
                    F.col("e.b.x").alias("x2"), F.col("e.b.y").alias("y2")))


def valid_parts(territories: DataFrame, skip: str | None = None, path_col: str = "path",
                parts_col: str = "parts") -> DataFrame:
    """Territories of several parts (``ARRAY<ARRAY<ring>>``: an outer ring, then its holes), without what is no polygon.

    A part whose outer ring is null or degenerate goes with its holes; other
    null or degenerate rings go alone; a territory left without a part goes.
    ``skip`` leaves out files whose path contains it.  Raises when nothing is left.
    """
    def usable(ring: Column) -> Column:
        closed = F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1)
        return ring.isNotNull() & (F.size(ring) >= F.when(closed, 4).otherwise(3))

    whole = F.filter(F.col(parts_col), lambda part: F.coalesce(usable(F.get(part, F.lit(0))), F.lit(False)))
    out = territories.withColumn(parts_col, F.transform(whole, lambda part: F.filter(part, usable)))
    out = out.filter(F.size(parts_col) > 0)
    if skip is not None and path_col in territories.columns:
        out = out.filter(~F.col(path_col).contains(skip))
    if out.isEmpty():
        raise RuntimeError("the territory files hold no usable polygon")
    return out


def part_edges(territories: DataFrame, parts_col: str = "parts") -> DataFrame:
    """Edges of all rings of all parts: ``poly_id year part_id x1 y1 x2 y2``.

    The rings of one part keep one ``part_id``, so that the crossings of its
    holes count with those of its outer ring.
    """
    rings = (territories.select("poly_id", "year", F.posexplode(parts_col).alias("part_id", "_rings"))
             .select("poly_id", "year", "part_id", F.explode("_rings").alias("ring")))
    return ring_edges(rings)


def assign_years(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Attach the detected year of each territory file; files without one are dropped."""
    return files.withColumn("year", path_year(path_col)).filter(F.col("year").isNotNull())


def study_area(edges: DataFrame, buffer_km: float = 15.0, units_per_km: float = 1000.0) -> DataFrame:
    """Bounding rectangle of all territory vertices grown by ``buffer_km``.

    The buffered union's hull is bounded by the same rectangle in planar
    coordinates, so only min/max are needed (one global aggregate).
    """
    b = float(buffer_km) * float(units_per_km)
    xs = F.least("x1", "x2")
    ys = F.least("y1", "y2")
    return edges.agg(
        F.count("*").alias("n_edges"),
        (F.min(xs) - F.lit(b)).alias("x0"), (F.min(ys) - F.lit(b)).alias("y0"),
        (F.max(F.greatest("x1", "x2")) + F.lit(b)).alias("x1"),
        (F.max(F.greatest("y1", "y2")) + F.lit(b)).alias("y1"),
    )


def pixel_rows_cols(grid: DataFrame, raster: Raster = UNIT) -> DataFrame:
    """Raster indices of pixel centres (px, py)."""
    return grid.withColumns({"row_idx": F.floor((F.col("py") - raster.y0) / raster.dy).cast("int"),
                             "col_idx": F.floor((F.col("px") - raster.x0) / raster.dx).cast("int")})


def _indices(a: Column, b: Column, origin: float, step: float, count: int | None) -> Column:
    """Indices of the pixels whose centres may lie between coordinates ``a`` and ``b``, clipped to the raster."""
    u, v = (a - F.lit(origin)) / F.lit(step), (b - F.lit(origin)) / F.lit(step)
    lo = F.floor(F.least(u, v)).cast("int") - 1
    hi = F.ceil(F.greatest(u, v)).cast("int")
    if count is not None:
        lo, hi = F.greatest(lo, F.lit(0)), F.least(hi, F.lit(count - 1))
    return F.when(lo <= hi, F.sequence(lo, hi))


def inside_pixels(edges: DataFrame, raster: Raster = UNIT) -> DataFrame:
    """(year, row_idx, col_idx) of every pixel whose true centre lies inside some polygon.

    A polygon is a ``poly_id`` or, where ``edges`` has ``part_id``, one of its
    parts: holes are cut out of their own part only, and parts are united.
    Even-odd rule with the half-open crossing test ``(y1 > py) != (y2 > py)``
    and ``px < x_cross``; a centre on a crossing point counts as inside only on
    the span's left end.  Each edge is expanded to the raster rows it crosses
    (cost follows edge height, not grid x edges); the sorted crossings of one
    polygon on one row (as many as that polygon's edges, at most) pair into
    spans, and only the pixels inside spans are emitted, so the output is
    proportional to the positive pixels.
    """
    polygon = ["poly_id", *(["part_id"] if "part_id" in edges.columns else [])]
    rows = edges.select(*polygon, "year", "x1", "y1", "x2", "y2",
                        F.explode(_indices(F.col("y1"), F.col("y2"), raster.y0, raster.dy, raster.n_rows)).alias("row_idx"))
    py = (F.col("row_idx") + F.lit(0.5)) * F.lit(raster.dy) + F.lit(raster.y0)
    crossings = rows.filter((F.col("y1") > py) != (F.col("y2") > py)).select(
        *polygon, "year", "row_idx",
        ((F.col("x2") - F.col("x1")) * (py - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")).alias("xc"),
    )
    per_row = (crossings.groupBy("year", *polygon, "row_idx").agg(F.sort_array(F.collect_list("xc")).alias("xs"))
               .filter(F.size("xs") >= 2))
    spans = per_row.select(
        "year", "row_idx",
        F.explode(F.transform(
            F.sequence(F.lit(0), F.floor(F.size("xs") / 2).cast("int") - 1),
            lambda i: F.struct(F.element_at("xs", i * 2 + 1).alias("xa"), F.element_at("xs", i * 2 + 2).alias("xb")),
        )).alias("s"),
    )
    cols = spans.select(
        "year", "row_idx", F.col("s.xa").alias("xa"), F.col("s.xb").alias("xb"),
        F.explode(_indices(F.col("s.xa"), F.col("s.xb"), raster.x0, raster.dx, raster.n_cols)).alias("col_idx"),
    )
    px = (F.col("col_idx") + F.lit(0.5)) * F.lit(raster.dx) + F.lit(raster.x0)
    return cols.filter((px >= F.col("xa")) & (px < F.col("xb"))).select("year", "row_idx", "col_idx").distinct()


def presence_labels(grid: DataFrame, edges: DataFrame, raster: Raster = UNIT) -> DataFrame:
    """0/1 presence for every pixel of ``grid`` in every year that has polygons.

    Overlapping polygons collapse (a pixel inside any polygon is 1).  Years
    without polygons produce no labels (they are skipped, not an error).
    """
    # One row with the distinct years, read where it is needed as a scalar subquery.
    years = edges.agg(F.array_sort(F.collect_set(F.col("year").cast("int"))).alias("years")).scalar()
    pos = inside_pixels(edges, raster).withColumn("_in", F.lit(1))
    gy = (pixel_rows_cols(grid, raster).withColumn("_years", years)
          .select("pixel_id", "row_idx", "col_idx", F.explode("_years").alias("year")))
    out = gy.join(pos, ["year", "row_idx", "col_idx"], "left")
    return out.select("year", "pixel_id", "row_idx", "col_idx",
                      F.coalesce(F.col("_in"), F.lit(0)).alias("presence"))
