"""Deterministic fixture views over the driver's tables.

Each function derives one input dataset of the habitat pipeline from the
driver's TPC-H-like tables, so every operator runs over whole tables and its
work grows with them.  The same views exist as SQL text in
``terrapix.plans.oracle`` for the DuckDB cross-check; the definitions here
are the DataFrame-API twins and must stay row-identical to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrapix.sources.tables import read_table


def _case(expr, mapping: dict, default):
    out = None
    for k, v in mapping.items():
        out = F.when(expr == k, F.lit(v)) if out is None else out.when(expr == k, F.lit(v))
    return out.otherwise(F.lit(default))


def raw_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (scene, pixel) observation: scene metadata + raw DN bands."""
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"])
    k, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    sensor = _case(F.expr("(l_orderkey div 28) % 4"), {0: "L5", 1: "L7", 2: "L8"}, "L9")
    qa = _case((k + p + n) % 10, {0: 2, 1: 8, 2: 16, 3: 32, 4: 66}, 64)
    mult = {  # per band: multipliers of orderkey, partkey, suppkey, linenumber
        "b1": (31, 17, 7, 101), "b2": (37, 19, 11, 103), "b3": (41, 23, 13, 107),
        "b4": (43, 29, 17, 109), "b5": (47, 31, 19, 113), "b6": (53, 37, 23, 127),
        "b7": (59, 41, 29, 131),
    }
    bands = [(F.lit(7000) + (k * a + p * b + s * c + n * d) % 20000).alias(name)
             for name, (a, b, c, d) in mult.items()]
    return li.select(
        k.alias("scene_id"),
        sensor.alias("sensor"),
        (F.lit(1995) + (k % 28).cast("int")).alias("year"),
        F.month("l_shipdate").cast("int").alias("month"),
        F.dayofmonth("l_shipdate").cast("int").alias("day"),
        (p % 100).cast("int").alias("pixel_id"),
        ((k * 13) % 100).cast("double").alias("cloud_cover"),
        qa.alias("qa_pixel"),
        *bands,
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Territory polygon edges: one triangle per supplier, three edges each.

    The three edges are generated per row with ``explode`` (no join).
    """
    sup = read_table(spark, sf_dir, "supplier", ["s_suppkey"])
    tri = F.array(*[
        F.struct(F.lit(k1).alias("k1"), F.lit(m1).alias("m1"), F.lit(k2).alias("k2"), F.lit(m2).alias("m2"))
        for k1, m1, k2, m2 in ((0.0, 0.0, 4.0, 1.0), (4.0, 1.0, 1.0, 4.0), (1.0, 4.0, 0.0, 0.0))
    ])
    p = sup.select(
        F.col("s_suppkey").alias("poly_id"),
        (F.lit(1995) + (F.col("s_suppkey") % 28).cast("int")).alias("year"),
        (F.col("s_suppkey") * 3 % 7).cast("double").alias("ax"),
        (F.col("s_suppkey") * 5 % 7).cast("double").alias("ay"),
        F.explode(tri).alias("t"),
    )
    return p.select(
        "poly_id", "year",
        (F.col("ax") + F.col("t.k1")).alias("x1"), (F.col("ay") + F.col("t.m1")).alias("y1"),
        (F.col("ax") + F.col("t.k2")).alias("x2"), (F.col("ay") + F.col("t.m2")).alias("y2"),
    )


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel centres of the 10x10 raster; ``row = pixel_id / 10``, ``col = pixel_id % 10``."""
    li = read_table(spark, sf_dir, "lineitem", ["l_partkey"])
    p = F.col("l_partkey")
    return li.select(
        (p % 100).cast("int").alias("pixel_id"),
        ((p % 10).cast("int") + 0.5).cast("double").alias("px"),
        (F.floor((p % 100) / 10.0) + 0.5).cast("double").alias("py"),
    ).distinct()


def nlcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land cover per pixel, one vintage for every year; class 0 is invalid."""
    classes = {0: 0, 1: 11, 2: 21, 3: 31, 4: 41, 5: 42, 6: 43, 7: 52, 8: 71, 9: 81, 10: 90}
    g = grid(spark, sf_dir)
    return g.select("pixel_id", _case(F.col("pixel_id") % 12, classes, 95).alias("nlcd_class"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled model scores with ties: id, year, presence, prob."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_returnflag"])
    k, p = F.col("l_orderkey"), F.col("l_partkey")
    pos = F.col("l_returnflag") == "R"
    return li.select(
        k.alias("id"),
        (F.lit(1995) + (k % 28).cast("int")).alias("year"),
        F.when(pos, 1).otherwise(0).alias("presence"),
        (((k * 31 + p * 17) % 850 + F.when(pos, 150).otherwise(0)).cast("double") / F.lit(1000.0)).alias("prob"),
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene catalog in two collections with rectangular footprints."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id"])
    e, u = F.col("event_id"), F.col("user_id")
    return ev.select(
        e.alias("scene_id"),
        F.when(e % 2 == 0, "A").otherwise("B").alias("collection"),
        F.col("ts").cast("date").alias("acquired"),
        ((e * 37) % 101).cast("double").alias("cloud"),
        (u % 40).cast("double").alias("x0"), ((u * 7) % 40).cast("double").alias("y0"),
        (u % 40 + 5).cast("double").alias("x1"), ((u * 7) % 40 + 5).cast("double").alias("y1"),
    )


def aoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of interest: one square per region."""
    r = read_table(spark, sf_dir, "region", ["r_regionkey"])
    k = F.col("r_regionkey")
    return r.select(
        k.alias("aoi_id"),
        (k * 8).cast("double").alias("x0"), (k * 8).cast("double").alias("y0"),
        (k * 8 + 4).cast("double").alias("x1"), (k * 8 + 4).cast("double").alias("y1"),
    )


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-metrics JSON documents, one in ten malformed."""
    s = F.col("s_suppkey")
    sup = read_table(spark, sf_dir, "supplier", ["s_suppkey"])
    good = F.concat(
        F.lit('{"app_name":"trial_'), s.cast("string"),
        F.lit('","metrics":{"val_auc":0.'), F.lpad(((s * 37) % 1000).cast("string"), 3, "0"),
        F.lit(',"test_auc":0.'), F.lpad(((s * 53) % 1000).cast("string"), 3, "0"),
        F.lit('},"hyperparameters":{"max_depth":'), (F.lit(6) + s % 4 * 2).cast("string"),
        F.lit("}}"),
    )
    return sup.select(F.when(s % 10 == 9, F.lit("{bad")).otherwise(good).alias("js"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Territory file paths in the naming schemes the year detector knows."""
    pt = read_table(spark, sf_dir, "part", ["p_partkey"])
    k = F.col("p_partkey")
    y = (F.lit(1990) + k % 37).cast("string")
    path = (
        F.when(k % 8 == 0, F.concat(F.lit("/d/x/"), y, F.lit("_agate_mcp.shp")))
        .when(k % 8 == 1, F.concat(F.lit("/d/x/ter"), y, F.lit(".shp")))
        .when(k % 8 == 2, F.concat(F.lit("/d/x/pack_"), y, F.lit(".shp")))
        .when(k % 8 == 3, F.concat(F.lit("/d/x/pack_"), y, F.lit("_mcp.shp")))
        .when(k % 8 == 4, F.concat(F.lit("/d/"), y, F.lit(" mcps/agate.shp")))
        .when(k % 8 == 5, F.concat(F.lit("/d/"), y, F.lit(" Wolf Territory/agate.shp")))
        .when(k % 8 == 6, F.concat(F.lit("/d/"), y, F.lit("/agate.shp")))
        .otherwise(F.lit("/d/none/agate.shp"))
    )
    return pt.select(k.alias("file_id"), path.alias("path"))


def territory_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Territories of two parts: a square with a square hole, and a triangle that lies over both."""
    sup = read_table(spark, sf_dir, "supplier", ["s_suppkey"])
    k = F.col("s_suppkey")
    ax, ay = (k * 3 % 7).cast("double"), (k * 5 % 7).cast("double")

    def ring(*points):
        return F.array(*[F.struct((ax + x).alias("x"), (ay + y).alias("y")) for x, y in points])

    parts = F.array(
        F.array(ring((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)), ring((1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0))),
        F.array(ring((2.0, 2.0), (5.0, 2.25), (2.5, 5.0))))
    path = F.concat(F.lit("/d/"), k.cast("string"), F.when(k % 9 == 4, F.lit(".zip")).otherwise(F.lit(".shp")))
    return sup.select(k.alias("poly_id"), (F.lit(1995) + k % 28).cast("int").alias("year"), path.alias("path"),
                      parts.alias("parts"))


def free_year_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Territory file paths whose year stands free in them, or nowhere."""
    pt = read_table(spark, sf_dir, "part", ["p_partkey"])
    k = F.col("p_partkey")
    y = F.lit(1990) + k % 37
    t, u = y.cast("string"), (y - 5).cast("string")
    path = (F.when(k % 6 == 0, F.concat(F.lit("/d/area"), t, F.lit("x/agate 7.shp")))
            .when(k % 6 == 1, F.concat(F.lit("/d/set-"), t, F.lit("-"), u, F.lit("/agate.shp")))
            .when(k % 6 == 2, F.concat(F.lit("/d/x"), t, F.lit(" y"), u, F.lit(" z/agate.shp")))
            .when(k % 6 == 3, F.concat(F.lit("/d/n1"), t, F.lit("b/agate.shp")))
            .when(k % 6 == 4, F.concat(F.lit("/d/_"), t, F.lit(" a/agate.shp")))
            .otherwise(F.concat(F.lit("/d/q"), t, F.lit("_/agate."), u)))
    return pt.select(k.alias("file_id"), path.alias("path"))


def run_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run documents as a tool prints them, over several lines: one in ten cut off, one of another kind, one with a
    field of another type."""
    sup = read_table(spark, sf_dir, "supplier", ["s_suppkey"])
    s = F.col("s_suppkey")
    auc = F.concat(F.lit("0."), F.lpad(((s * 37) % 1000).cast("string"), 3, "0"))
    whole = F.concat(F.lit('{\n  "app_name": "trial_'), s.cast("string"), F.lit('",\n  "metrics": {\n    "val_auc": '),
                     F.when(s % 10 == 7, F.lit('"high"')).otherwise(auc), F.lit(',\n    "test_auc": 0.5\n  },\n'),
                     F.lit('  "hyperparameters": {\n    "max_depth": '), (F.lit(6) + s % 4 * 2).cast("string"), F.lit("\n  }\n}"))
    text = (F.when(s % 10 == 9, F.substring(whole, 1, 40)).when(s % 10 == 8, F.lit("[1, 2]")).otherwise(whole))
    return sup.select(s.alias("run_id"), text.alias("value"))
