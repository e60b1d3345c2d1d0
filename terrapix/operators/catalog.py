"""Scene catalogs: merge, AOI x scene spatial join, least-cloudy top-k."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapix.functions.spectral import MAX_CLOUD
from terrapix.operators.observe import filter_scenes
from terrapix.sources.store import materialize

# ---------------------------------------------------------------------------
# The published catalog trial's date window and top-k.
# ---------------------------------------------------------------------------
CATALOG_START = "2013-01-01"
CATALOG_END = "2024-12-31"
TOP_K = 3
# ---------------------------------------------------------------------------


def union_catalogs(*catalogs: DataFrame) -> DataFrame:
    """Bag union of scene catalogs by column name (no de-duplication)."""
    return reduce(lambda a, b: a.unionByName(b), catalogs)


MIN_LEVEL, MAX_LEVEL = -20, 62  # powers of two that grid steps may have; smaller rectangles share the least
HOT_CELL = 20_000               # rows of one side in one cell that stay together
_SIDES = ("x0", "y0", "x1", "y1")


def _level(df: DataFrame, p: str) -> Column:
    """Exponent of the grid step that is no smaller than the rectangle's longer side."""
    side = F.greatest(F.col(p + "x1") - F.col(p + "x0"), F.col(p + "y1") - F.col(p + "y0"))
    return F.least(F.greatest(F.coalesce(F.ceil(F.log2(side)), F.lit(MIN_LEVEL)), F.lit(MIN_LEVEL)), F.lit(MAX_LEVEL)).cast("int")


def _levelled(df: DataFrame, p: str) -> DataFrame:
    """``df``'s columns prefixed, with ``_level``; rectangles without all four bounds, or with bounds that are not
    numbers, meet nothing and are left out."""
    out = df.select(*[F.col(f"`{c}`").alias(p + c) for c in df.columns])
    for c in _SIDES:
        out = out.filter(F.col(p + c).isNotNull() & ~F.isnan(F.col(p + c).cast("double")))
    return out.withColumn("_level", _level(out, p))


def _levels(df: DataFrame) -> list[int]:
    return sorted(r[0] for r in df.select("_level").distinct().collect())  # at most MAX_LEVEL - MIN_LEVEL + 1


def _cells(df: DataFrame, p: str, own: list[int], other: list[int], left: bool) -> DataFrame:
    """``df`` by grid cell: (_m, _part, _cx, _cy) for each grid in which its rectangles can meet the other side's.

    Two rectangles meet in the grid of the larger level of the two, where neither
    touches more than two cells along an axis.  Part 0 of a grid joins
    left rectangles of that level with right ones up to it, part 1 smaller left
    ones with right ones of that level; no pair is in both, and no two
    rectangles that are both smaller than the grid are brought together.
    """
    def places(level: int) -> list[tuple[int, int]]:
        if left:
            return [(level, 0)] * any(m <= level for m in other) + [(m, 1) for m in other if m > level]
        return [(m, 0) for m in other if m >= level] + [(level, 1)] * any(m < level for m in other)

    grids = {v: F.array(*[F.struct(F.lit(m).alias("m"), F.lit(part).alias("part")) for m, part in places(v)])
             for v in own if places(v)}
    if not grids:
        zero = {"_m": F.lit(0), "_part": F.lit(0), "_cx": F.lit(0).cast("long"), "_cy": F.lit(0).cast("long")}
        return df.limit(0).drop("_level").withColumns(zero)
    table = F.create_map(*[x for v, g in grids.items() for x in (F.lit(v), g)])
    step = F.pow(F.lit(2.0), F.col("_at.m"))

    def span(a: str, b: str) -> Column:
        return F.sequence(F.floor(F.col(p + a) / step).cast("long"), F.floor(F.col(p + b) / step).cast("long"))

    return (df.withColumn("_at", F.explode(F.try_element_at(table, F.col("_level"))))
            .withColumn("_cx", F.explode(span("x0", "x1"))).withColumn("_cy", F.explode(span("y0", "y1")))
            .withColumn("_m", F.col("_at.m")).withColumn("_part", F.col("_at.part")).drop("_at", "_level"))


def _spread(cells: DataFrame, hot: DataFrame, mine: str, theirs: str, salt: Column) -> DataFrame:
    """Rows of hot cells cut into ``mine`` slices, a copy for each of the other side's ``theirs`` slices."""
    key = ["_m", "_part", "_cx", "_cy"]
    n, copies = F.coalesce(mine, F.lit(1)), F.coalesce(theirs, F.lit(1))
    return (cells.join(hot, key, "left")
            .withColumn("_own", F.pmod(salt, n).cast("int"))
            .withColumn("_copy", F.explode(F.sequence(F.lit(0), (copies - 1).cast("int"))))
            .drop("_n_l", "_n_r"))


def overlap_join(left: DataFrame, right: DataFrame, lprefix: str = "l_", rprefix: str = "r_",
                 hot_cell: int = HOT_CELL) -> DataFrame:
    """All pairs of intersecting rectangles (``x0 y0 x1 y1`` on both sides).

    Equi-joins on the cells of a multi-level grid replace the nested-loop theta
    join, so neither side has to be broadcast (AQE still turns it into a
    broadcast join when one side is measured small at run time).  A
    rectangle belongs to the level of its own size and is looked up in the
    grids of the larger levels that the other side has; it has at most four cells
    in each, whatever the spread of sizes.  A pair sharing several cells is
    emitted only in the cell holding the lower-left corner of the
    intersection, so no de-duplication shuffle is needed.  Where a cell holds more
    than ``hot_cell`` rows of a side, its rows are cut into slices that
    are joined slice by slice in tasks of their own.  Columns of each side get
    the given prefixes.
    """
    lt, rt = _levelled(left, lprefix), _levelled(right, rprefix)
    l_levels, r_levels = _levels(lt), _levels(rt)
    lp, rp = _cells(lt, lprefix, l_levels, r_levels, True), _cells(rt, rprefix, r_levels, l_levels, False)
    key = ["_m", "_part", "_cx", "_cy"]

    def hot(cells: DataFrame, name: str) -> DataFrame:
        return (cells.groupBy(*key).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_cell)
                .select(*key, F.ceil(F.col("_n") / hot_cell).cast("int").alias(name)))

    hot_l, hot_r = hot(lp, "_n_l"), hot(rp, "_n_r")
    if not hot_l.select(*key).unionByName(hot_r.select(*key)).isEmpty():
        cut = materialize(hot_l.join(hot_r, key, "full"), "hot-cells")
        lp = _spread(lp, cut, "_n_l", "_n_r", F.xxhash64(*[c for c in lp.columns if c.startswith(lprefix)]))
        rp = _spread(rp, cut, "_n_r", "_n_l", F.xxhash64(*[c for c in rp.columns if c.startswith(rprefix)]))
        lp = lp.withColumnsRenamed({"_own": "_a", "_copy": "_b"})
        rp = rp.withColumnsRenamed({"_own": "_b", "_copy": "_a"})
        key = [*key, "_a", "_b"]
    j = lp.join(rp, key, "inner")
    L = {c: F.col(lprefix + c) for c in _SIDES}
    R = {c: F.col(rprefix + c) for c in _SIDES}
    hit = (L["x0"] <= R["x1"]) & (R["x0"] <= L["x1"]) & (L["y0"] <= R["y1"]) & (R["y0"] <= L["y1"])
    step = F.pow(F.lit(2.0), F.col("_m"))
    ix, iy = F.greatest(L["x0"], R["x0"]), F.greatest(L["y0"], R["y0"])
    home = (F.floor(ix / step) == F.col("_cx")) & (F.floor(iy / step) == F.col("_cy"))
    return j.filter(hit & home).drop(*key)


def aoi_scenes(scenes: DataFrame, aoi: DataFrame, start: str = CATALOG_START, end: str = CATALOG_END,
               max_cloud: float = MAX_CLOUD) -> DataFrame:
    """(aoi_id, scene_id, collection, acquired, cloud) for scenes passing the
    date / cloud filters whose footprint intersects the AOI."""
    s = filter_scenes(scenes, start=start, end=end, max_cloud=max_cloud)
    j = overlap_join(aoi.select("aoi_id", "x0", "y0", "x1", "y1"),
                     s.select("scene_id", "collection", "acquired", "cloud", "x0", "y0", "x1", "y1"),
                     lprefix="a_", rprefix="s_")
    return j.select(F.col("a_aoi_id").alias("aoi_id"), F.col("s_scene_id").alias("scene_id"),
                    F.col("s_collection").alias("collection"), F.col("s_acquired").alias("acquired"),
                    F.col("s_cloud").alias("cloud"))


def scenes_per_aoi(scenes: DataFrame, aoi: DataFrame, **kw) -> DataFrame:
    """Number of matching scenes per AOI (AOIs without scenes are absent)."""
    return aoi_scenes(scenes, aoi, **kw).groupBy("aoi_id").agg(F.count("*").alias("n_scenes"))


def least_cloudy(scenes: DataFrame, aoi: DataFrame, k: int = TOP_K, **kw) -> DataFrame:
    """The ``k`` least-cloudy matching scenes per AOI (ties by scene_id).

    ``row_number() <= k`` is planned as a ``WindowGroupLimit`` that keeps only
    k rows per AOI before the shuffle, so a hot AOI never ships all its scenes.
    """
    w = Window.partitionBy("aoi_id").orderBy(F.col("cloud").asc(), F.col("scene_id").asc())
    return (aoi_scenes(scenes, aoi, **kw)
            .withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))
