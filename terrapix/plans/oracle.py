"""Independent SQL twins of the registered queries (DuckDB dialect).

Written from the operator definitions, not generated from our Spark plans,
so they check the DataFrame implementation.  Fixture views are inlined as
CTEs because the checker registers only the base tables.
"""

from __future__ import annotations

# ------------------------------------------------------------------ fixtures
VIEWS = {
    "raw_obs": """SELECT l_orderkey AS scene_id,
 CASE CAST(floor(l_orderkey / 28.0) AS BIGINT) % 4 WHEN 0 THEN 'L5' WHEN 1 THEN 'L7' WHEN 2 THEN 'L8' ELSE 'L9' END AS sensor,
 1995 + CAST(l_orderkey % 28 AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, CAST(day(l_shipdate) AS INT) AS day,
 CAST(l_partkey % 100 AS INT) AS pixel_id, CAST((l_orderkey * 13) % 100 AS DOUBLE) AS cloud_cover,
 CASE (l_orderkey + l_partkey + l_linenumber) % 10 WHEN 0 THEN 2 WHEN 1 THEN 8 WHEN 2 THEN 16 WHEN 3 THEN 32 WHEN 4 THEN 66 ELSE 64 END AS qa_pixel,
 7000 + (l_orderkey * 31 + l_partkey * 17 + l_suppkey * 7 + l_linenumber * 101) % 20000 AS b1,
 7000 + (l_orderkey * 37 + l_partkey * 19 + l_suppkey * 11 + l_linenumber * 103) % 20000 AS b2,
 7000 + (l_orderkey * 41 + l_partkey * 23 + l_suppkey * 13 + l_linenumber * 107) % 20000 AS b3,
 7000 + (l_orderkey * 43 + l_partkey * 29 + l_suppkey * 17 + l_linenumber * 109) % 20000 AS b4,
 7000 + (l_orderkey * 47 + l_partkey * 31 + l_suppkey * 19 + l_linenumber * 113) % 20000 AS b5,
 7000 + (l_orderkey * 53 + l_partkey * 37 + l_suppkey * 23 + l_linenumber * 127) % 20000 AS b6,
 7000 + (l_orderkey * 59 + l_partkey * 41 + l_suppkey * 29 + l_linenumber * 131) % 20000 AS b7 FROM lineitem""",
    "edges": """SELECT poly_id, year, CAST(ax+k1 AS DOUBLE) AS x1, CAST(ay+m1 AS DOUBLE) AS y1, CAST(ax+k2 AS DOUBLE) AS x2, CAST(ay+m2 AS DOUBLE) AS y2 FROM (
 SELECT s_suppkey AS poly_id, 1995 + CAST(s_suppkey % 28 AS INT) AS year, CAST(s_suppkey * 3 % 7 AS DOUBLE) AS ax, CAST(s_suppkey * 5 % 7 AS DOUBLE) AS ay FROM supplier) p
 CROSS JOIN (SELECT 0.0 AS k1, 0.0 AS m1, 4.0 AS k2, 1.0 AS m2 UNION ALL SELECT 4.0, 1.0, 1.0, 4.0 UNION ALL SELECT 1.0, 4.0, 0.0, 0.0) t""",
    "grid": """SELECT DISTINCT CAST(l_partkey % 100 AS INT) AS pixel_id, CAST(CAST(l_partkey % 10 AS INT) + 0.5 AS DOUBLE) AS px, CAST(floor((l_partkey % 100) / 10.0) + 0.5 AS DOUBLE) AS py FROM lineitem""",
    "nlcd": """SELECT pixel_id, CASE pixel_id % 12 WHEN 0 THEN 0 WHEN 1 THEN 11 WHEN 2 THEN 21 WHEN 3 THEN 31 WHEN 4 THEN 41 WHEN 5 THEN 42 WHEN 6 THEN 43 WHEN 7 THEN 52 WHEN 8 THEN 71 WHEN 9 THEN 81 WHEN 10 THEN 90 ELSE 95 END AS nlcd_class FROM grid""",
    "scored": """SELECT l_orderkey AS id, 1995 + CAST(l_orderkey % 28 AS INT) AS year, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS presence,
 CAST((l_orderkey * 31 + l_partkey * 17) % 850 + CASE WHEN l_returnflag = 'R' THEN 150 ELSE 0 END AS DOUBLE) / CAST(1000 AS DOUBLE) AS prob FROM lineitem""",
    "scenes": """SELECT event_id AS scene_id, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS collection, CAST(ts AS DATE) AS acquired, CAST((event_id * 37) % 101 AS DOUBLE) AS cloud,
 CAST(user_id % 40 AS DOUBLE) AS x0, CAST((user_id * 7) % 40 AS DOUBLE) AS y0, CAST(user_id % 40 + 5 AS DOUBLE) AS x1, CAST((user_id * 7) % 40 + 5 AS DOUBLE) AS y1 FROM events""",
    "aoi": """SELECT r_regionkey AS aoi_id, CAST(r_regionkey * 8 AS DOUBLE) AS x0, CAST(r_regionkey * 8 AS DOUBLE) AS y0, CAST(r_regionkey * 8 + 4 AS DOUBLE) AS x1, CAST(r_regionkey * 8 + 4 AS DOUBLE) AS y1 FROM region""",
    "trials": """SELECT CASE WHEN s_suppkey % 10 = 9 THEN '{bad' ELSE concat('{"app_name":"trial_', CAST(s_suppkey AS STRING), '","metrics":{"val_auc":0.', lpad(CAST((s_suppkey * 37) % 1000 AS STRING), 3, '0'), ',"test_auc":0.', lpad(CAST((s_suppkey * 53) % 1000 AS STRING), 3, '0'), '},"hyperparameters":{"max_depth":', CAST(6 + s_suppkey % 4 * 2 AS STRING), '}}') END AS js FROM supplier""",
    "paths": """SELECT p_partkey AS file_id, CASE p_partkey % 8 WHEN 0 THEN concat('/d/x/', CAST(1990 + p_partkey % 37 AS STRING), '_agate_mcp.shp') WHEN 1 THEN concat('/d/x/ter', CAST(1990 + p_partkey % 37 AS STRING), '.shp') WHEN 2 THEN concat('/d/x/pack_', CAST(1990 + p_partkey % 37 AS STRING), '.shp') WHEN 3 THEN concat('/d/x/pack_', CAST(1990 + p_partkey % 37 AS STRING), '_mcp.shp') WHEN 4 THEN concat('/d/', CAST(1990 + p_partkey % 37 AS STRING), ' mcps/agate.shp') WHEN 5 THEN concat('/d/', CAST(1990 + p_partkey % 37 AS STRING), ' Wolf Territory/agate.shp') WHEN 6 THEN concat('/d/', CAST(1990 + p_partkey % 37 AS STRING), '/agate.shp') ELSE '/d/none/agate.shp' END AS path FROM part""",
}
VIEW_DEPS = {"nlcd": ["grid"]}

BANDS = ("BLUE", "GREEN", "RED", "NIR", "SWIR1", "SWIR2")
INDICES = ("NDVI", "EVI", "NDWI", "NBR", "BSI", "NDSI")
ALL = BANDS + INDICES
RAW_L57 = ("b1", "b2", "b3", "b4", "b5", "b7")
RAW_L89 = ("b2", "b3", "b4", "b5", "b6", "b7")


def _ctes(views, extra: list[tuple[str, str]]) -> str:
    names = []
    for v in views:
        for d in VIEW_DEPS.get(v, []):
            if d not in names:
                names.append(d)
        if v not in names:
            names.append(v)
    parts = [f"{n} AS ({VIEWS[n]})" for n in names] + [f"{n} AS ({q})" for n, q in extra]
    return "WITH " + ",\n".join(parts)


def _nd(a, b):
    return f"CASE WHEN ({a} + {b}) = 0 THEN 0.0 ELSE ({a} - {b}) / ({a} + {b}) END"


ELIGIBLE = ("month * 100 + day >= 501 AND month * 100 + day < 930 AND cloud_cover < 60.0 AND "
            "((sensor = 'L5' AND year <= 2011) OR (sensor = 'L7' AND year >= 1999) OR "
            "(sensor = 'L8' AND year >= 2013) OR (sensor = 'L9' AND year >= 2022)) AND (qa_pixel & 58) = 0")

_RAW = ", ".join(
    f"CAST(CASE WHEN sensor IN ('L5', 'L7') THEN {a} ELSE {b} END AS DOUBLE) * 2.75e-5 + CAST(-0.2 AS DOUBLE) AS r_{n}"
    for n, a, b in zip(BANDS, RAW_L57, RAW_L89))
_CLAMP = ", ".join(f"CASE WHEN r_{n} < 0 THEN 0.0 WHEN r_{n} > 1 THEN 1.0 ELSE r_{n} END AS {n}" for n in BANDS)
_EVI_DEN = "(NIR + 6.0 * RED - 7.5 * BLUE + 1.0)"
_IDX = ", ".join([
    f"{_nd('NIR', 'RED')} AS NDVI",
    f"2.5 * (CASE WHEN {_EVI_DEN} = 0 THEN 0.0 ELSE (NIR - RED) / {_EVI_DEN} END) AS EVI",
    f"{_nd('GREEN', 'NIR')} AS NDWI",
    f"{_nd('NIR', 'SWIR2')} AS NBR",
    "CASE WHEN ((SWIR1 + RED) + (NIR + BLUE)) = 0 THEN 0.0 ELSE ((SWIR1 + RED) - (NIR + BLUE)) / ((SWIR1 + RED) + (NIR + BLUE)) END AS BSI",
    f"{_nd('GREEN', 'SWIR1')} AS NDSI",
])

SPECTRAL = [
    ("elig", f"SELECT * FROM raw_obs WHERE {ELIGIBLE}"),
    ("scaled", f"SELECT scene_id, pixel_id, year, sensor, {_RAW} FROM elig"),
    ("clamped", f"SELECT scene_id, pixel_id, year, sensor, {_CLAMP} FROM scaled"),
    ("spec", f"SELECT *, {_IDX} FROM clamped"),
]

COMPOSITE = SPECTRAL + [
    ("comp", "SELECT year, pixel_id, " + ", ".join(
        f"CAST(CAST(median({b}) AS FLOAT) AS DOUBLE) AS {b}" for b in ALL)
     + ", CAST(CAST(count(NDVI) AS FLOAT) AS DOUBLE) AS pixel_count FROM spec GROUP BY year, pixel_id"),
]

LABELS = [
    ("cross_n", """SELECT g.pixel_id, e.year, e.poly_id,
 SUM(CASE WHEN ((e.y1 > g.py) <> (e.y2 > g.py)) AND (g.px < (e.x2 - e.x1) * (g.py - e.y1) / (e.y2 - e.y1) + e.x1) THEN 1 ELSE 0 END) AS n
 FROM grid g CROSS JOIN edges e GROUP BY g.pixel_id, e.year, e.poly_id"""),
    ("pos", "SELECT DISTINCT pixel_id, year FROM cross_n WHERE n % 2 = 1"),
    ("yrs", "SELECT DISTINCT year FROM edges"),
    ("labels", """SELECT y.year, g.pixel_id, CAST(floor(g.py) AS INT) AS row_idx, CAST(floor(g.px) AS INT) AS col_idx,
 CASE WHEN p.pixel_id IS NULL THEN 0 ELSE 1 END AS presence
 FROM grid g CROSS JOIN yrs y LEFT JOIN pos p ON p.pixel_id = g.pixel_id AND p.year = y.year"""),
]

BY_YEAR = LABELS + [
    ("byc", """SELECT year, count(*) AS total_pixels, count(*) FILTER (WHERE presence = 1) AS positive_pixels,
 count(*) FILTER (WHERE presence = 0) AS negative_pixels, max(col_idx) + 1 AS width, max(row_idx) + 1 AS height
 FROM labels GROUP BY year"""),
    ("by_year", """SELECT year, total_pixels, positive_pixels, negative_pixels,
 total_pixels - positive_pixels - negative_pixels AS nodata_pixels,
 (CASE WHEN total_pixels = 0 THEN 0.0 ELSE CAST(positive_pixels AS DOUBLE) / CAST(total_pixels AS DOUBLE) END) * 100.0 AS positive_pct,
 (CASE WHEN total_pixels = 0 THEN 0.0 ELSE CAST(negative_pixels AS DOUBLE) / CAST(total_pixels AS DOUBLE) END) * 100.0 AS negative_pct,
 CASE WHEN positive_pixels > 0 THEN CAST(negative_pixels AS DOUBLE) / CAST(positive_pixels AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END AS imbalance_ratio,
 CAST(width AS INT) AS width, CAST(height AS INT) AS height FROM byc"""),
]

ALIGNED = COMPOSITE + LABELS + [
    ("aligned_all", """SELECT c.*, l.presence, n.nlcd_class FROM comp c
 JOIN labels l ON l.year = c.year AND l.pixel_id = c.pixel_id JOIN nlcd n ON n.pixel_id = c.pixel_id"""),
    ("aligned", "SELECT * FROM aligned_all WHERE nlcd_class > 0 AND "
     + " AND ".join(f"{b} IS NOT NULL AND NOT isnan({b})" for b in ALL + ("pixel_count",))),
]

SAMPLE = ALIGNED + [
    ("keyed", "SELECT *, substr(md5('42:' || year || ':' || pixel_id), 1, 15) AS h FROM aligned"),
    ("cnt", """SELECT year, count(*) FILTER (WHERE presence = 1) AS n_pos, count(*) FILTER (WHERE presence = 0) AS n_neg
 FROM keyed GROUP BY year"""),
    ("tgt", """SELECT year, least(n_pos, 1500000) AS pos_t,
 least(n_neg, CAST(floor(least(n_pos, 1500000) * 1.0) AS BIGINT)) AS neg_t FROM cnt"""),
    ("ranked", "SELECT *, row_number() OVER (PARTITION BY year, presence ORDER BY h, pixel_id) AS rn FROM keyed"),
    ("sample", """SELECT r.* EXCLUDE (h, rn) FROM ranked r JOIN tgt t ON t.year = r.year
 WHERE r.rn <= CASE WHEN r.presence = 1 THEN t.pos_t ELSE t.neg_t END"""),
]

POINTS = [
    ("g", """SELECT CAST(prob AS DOUBLE) AS threshold, count(*) FILTER (WHERE presence = 1) AS pos,
 count(*) FILTER (WHERE presence <> 1) AS neg FROM scored GROUP BY 1"""),
    ("pts", """SELECT threshold, pos, neg,
 CAST(sum(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS tp,
 CAST(sum(neg) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS fp,
 CAST(sum(pos) OVER () AS BIGINT) AS n_pos, CAST(sum(neg) OVER () AS BIGINT) AS n_neg FROM g"""),
]


def _prec(tp, fp):
    return f"CASE WHEN CAST(({tp}) + ({fp}) AS DOUBLE) = 0 THEN 0.0 ELSE CAST({tp} AS DOUBLE) / CAST(({tp}) + ({fp}) AS DOUBLE) END"


def _hist_sql(src: str, col: str, bins: int, key: str | None, density: bool) -> list[tuple[str, str]]:
    k = f"{key}, " if key else ""
    kj = f" USING ({key})" if key else " ON TRUE"
    grp = f" GROUP BY {key}" if key else ""

    def edge(i):
        return f"(CASE WHEN {i} = {bins} THEN hi ELSE {i} * ((hi - lo) / {float(bins)}) + lo END)"

    dens = ", CAST(cnt AS DOUBLE) / (n * (e_hi - e_lo)) AS density" if density else ""
    return [
        ("hv", f"SELECT {k}CAST({col} AS DOUBLE) AS x FROM {src} WHERE {col} IS NOT NULL AND NOT isnan({col})"),
        ("hr", f"""SELECT {k}count(*) AS n,
 CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
 CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM hv{grp}"""),
        ("h0", f"""SELECT {k}x, lo, hi, least(greatest(CAST(floor((x - lo) * ({float(bins)} / (hi - lo))) AS INT), 0), {bins - 1}) AS i0
 FROM hv JOIN hr{kj}"""),
        ("h1", f"SELECT {k}x, lo, hi, CASE WHEN x < {edge('i0')} THEN i0 - 1 ELSE i0 END AS i1 FROM h0"),
        ("h2", f"SELECT {k}CASE WHEN x >= {edge('(i1 + 1)')} AND i1 <> {bins - 1} THEN i1 + 1 ELSE i1 END AS bin FROM h1"),
        ("hc", f"SELECT {k}bin, count(*) AS cnt FROM h2 GROUP BY {k}bin"),
        ("hb", f"""SELECT {k}CAST(b.range AS INT) AS bin, n, {edge('CAST(b.range AS INT)')} AS e_lo,
 {edge('(CAST(b.range AS INT) + 1)')} AS e_hi FROM hr CROSS JOIN range({bins}) b"""),
        ("hist", f"""SELECT {f'hb.{key}, ' if key else ''}hb.bin, e_lo, e_hi, n, coalesce(hc.cnt, 0) AS cnt
 FROM hb LEFT JOIN hc ON hc.bin = hb.bin{f' AND hc.{key} = hb.{key}' if key else ''}"""),
        ("hout", f"""SELECT {k}bin, round(e_lo, 6) AS lo, round(e_hi, 6) AS hi, cnt AS "count", n{dens} FROM hist"""),
    ]


LEADER = [
    ("runs", """SELECT coalesce(json_extract_string(js, '$.app_name'), 'unknown') AS app_name,
 CAST(json_extract(js, '$.metrics.val_auc') AS DOUBLE) AS val_auc,
 CAST(json_extract(js, '$.metrics.val_pr_auc') AS DOUBLE) AS val_pr_auc,
 CAST(json_extract(js, '$.metrics.test_auc') AS DOUBLE) AS test_auc,
 CAST(json_extract(js, '$.metrics.test_pr_auc') AS DOUBLE) AS test_pr_auc,
 CAST(json_extract(js, '$.hyperparameters.max_depth') AS BIGINT) AS max_depth,
 CAST(json_extract(js, '$.hyperparameters.eta') AS DOUBLE) AS eta,
 CAST(json_extract(js, '$.hyperparameters.subsample') AS DOUBLE) AS subsample,
 CAST(json_extract(js, '$.hyperparameters.colsample_bytree') AS DOUBLE) AS colsample_bytree,
 CAST(json_extract(js, '$.hyperparameters.min_child_weight') AS DOUBLE) AS min_child_weight,
 CAST(json_extract(js, '$.hyperparameters.reg_lambda') AS DOUBLE) AS reg_lambda,
 CAST(json_extract(js, '$.hyperparameters.reg_alpha') AS DOUBLE) AS reg_alpha
 FROM trials WHERE json_valid(js)"""),
]

HYPERPARAMETERS = ("max_depth", "eta", "subsample", "colsample_bytree", "min_child_weight", "reg_lambda", "reg_alpha")

# The best split of one weighted tree over a feature of few values: labels -1 and 1, candidates midway between
# neighbouring values, largest fall of the weighted variance, the first of equals.
ONE_SPLIT = [
    ("banded", "SELECT *, floor(prob * 20) AS band FROM scored"),
    ("tr", "SELECT * FROM banded WHERE year BETWEEN 1995 AND 2015"),
    ("r", "SELECT CAST(count(*) FILTER (WHERE presence = 0) AS DOUBLE) / count(*) FILTER (WHERE presence = 1) AS ratio FROM tr"),
    ("v", """SELECT band, count(*) AS n, sum(CASE WHEN presence = 1 THEN ratio ELSE 1.0 END) AS w,
 sum(CASE WHEN presence = 1 THEN ratio ELSE -1.0 END) AS y FROM tr CROSS JOIN r GROUP BY band"""),
    ("cand", """SELECT (band + lead(band) OVER o) / 2 AS t, sum(n) OVER o AS ln, sum(w) OVER o AS lw, sum(y) OVER o AS ly,
 sum(n) OVER () - sum(n) OVER o AS rn, sum(w) OVER () - sum(w) OVER o AS rw, sum(y) OVER () - sum(y) OVER o AS ry
 FROM v WINDOW o AS (ORDER BY band)"""),
    ("best", """SELECT t, CAST(ln AS BIGINT) AS ln, lw, ly, CAST(rn AS BIGINT) AS rn, rw, ry FROM cand WHERE t IS NOT NULL
 ORDER BY ly * ly / lw + ry * ry / rw DESC, t LIMIT 1"""),
]

CATALOG = [
    ("sc", "SELECT * FROM scenes WHERE cloud < 60.0 AND acquired >= DATE '2013-01-01' AND acquired < DATE '2024-12-31'"),
    ("pairs", """SELECT a.aoi_id, s.scene_id, s.collection, s.acquired, s.cloud FROM aoi a JOIN sc s
 ON a.x0 <= s.x1 AND s.x0 <= a.x1 AND a.y0 <= s.y1 AND s.y0 <= a.y1"""),
]

_PY_T1 = (r"^(\d{4})_\w+", r"ter(\d{4})", r"^(\d{4})_all", r"_(\d{4})$", r"_(\d{4})_mcp")
_PY_T2 = (r"/(\d{4})\s*mcps?/", r"/(\d{4})\s*MCPs?/", r"/(\d{4})\s*Wolf[^/]*/", r"/(\d{4})_Wolf[^/]*/", r"/(\d{4})/")


def _year_pick(s, pat):
    ex = f"regexp_extract({s}, '{pat}', 1)"
    return f"CASE WHEN {ex} <> '' AND CAST({ex} AS INT) BETWEEN 1995 AND 2022 THEN CAST({ex} AS INT) END"


def _r(cols, digits):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


def build() -> dict[str, str]:
    q = {}
    q["eligible_obs"] = _ctes(["raw_obs"], []) + f"\nSELECT * FROM raw_obs WHERE {ELIGIBLE}"
    q["spectral_indices"] = _ctes(["raw_obs"], SPECTRAL) + f"\nSELECT scene_id, pixel_id, year, sensor, {_r(ALL, 7)} FROM spec"
    q["composite_ndvi"] = _ctes(["raw_obs"], SPECTRAL) + (
        "\nSELECT year, pixel_id, round(median(NDVI), 6) AS median_ndvi, count(NDVI) AS pixel_count"
        " FROM spec GROUP BY year, pixel_id")
    q["composite_full"] = _ctes(["raw_obs"], COMPOSITE) + (
        f"\nSELECT year, pixel_id, {_r(ALL + ('pixel_count',), 6)}, make_date(year, 5, 1) AS start_date,"
        " make_date(year, 9, 30) AS end_date, concat_ws(',', CASE WHEN year <= 2011 THEN 'L5' END,"
        " CASE WHEN year >= 1999 THEN 'L7' END, CASE WHEN year >= 2013 THEN 'L8' END,"
        " CASE WHEN year >= 2022 THEN 'L9' END) AS sensors, 'median_growing_season' AS composite FROM comp")
    q["presence_labels"] = _ctes(["grid", "edges"], LABELS) + "\nSELECT * FROM labels"
    # The same crossing count at the true centres of a north-up raster of 30 m pixels.
    north_up = [
        ("grid30", "SELECT pixel_id, px * 30.0 + 500000.0 AS px, 4100300.0 - py * 30.0 AS py FROM grid"),
        ("edges30", "SELECT poly_id, year, x1 * 30.0 + 500000.0 + 7.0 AS x1, 4100300.0 - y1 * 30.0 - 11.0 AS y1,"
                    " x2 * 30.0 + 500000.0 + 7.0 AS x2, 4100300.0 - y2 * 30.0 - 11.0 AS y2 FROM edges"),
        ("cross30", """SELECT g.pixel_id, e.year, e.poly_id,
 SUM(CASE WHEN ((e.y1 > g.py) <> (e.y2 > g.py)) AND (g.px < (e.x2 - e.x1) * (g.py - e.y1) / (e.y2 - e.y1) + e.x1) THEN 1 ELSE 0 END) AS n
 FROM grid30 g CROSS JOIN edges30 e GROUP BY g.pixel_id, e.year, e.poly_id"""),
        ("pos30", "SELECT DISTINCT pixel_id, year FROM cross30 WHERE n % 2 = 1"),
        ("years30", "SELECT DISTINCT year FROM edges"),
    ]
    q["presence_labels_30m"] = _ctes(["grid", "edges"], north_up) + """
SELECT y.year, g.pixel_id, CAST(floor((4100300.0 - g.py) / 30.0) AS INT) AS row_idx, CAST(floor((g.px - 500000.0) / 30.0) AS INT) AS col_idx,
 CASE WHEN p.pixel_id IS NULL THEN 0 ELSE 1 END AS presence
FROM grid30 g CROSS JOIN years30 y LEFT JOIN pos30 p ON p.pixel_id = g.pixel_id AND p.year = y.year"""
    q["territory_rings"] = _ctes(["edges"], []) + "\nSELECT poly_id, year, x1, y1, x2, y2 FROM edges"
    q["study_area"] = _ctes(["edges"], []) + (
        "\nSELECT count(*) AS n_edges,"
        " round(min(least(x1, x2)) - 15000.0, 6) AS x0, round(min(least(y1, y2)) - 15000.0, 6) AS y0,"
        " round(max(greatest(x1, x2)) + 15000.0, 6) AS x1, round(max(greatest(y1, y2)) + 15000.0, 6) AS y1 FROM edges")
    stem = r"regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\.[^.]+$', '\1')"
    picks = [_year_pick("stem", p) for p in _PY_T1] + [_year_pick("path", "(?i)" + p) for p in _PY_T2]
    q["path_year"] = _ctes(["paths"], [("st", f"SELECT file_id, path, {stem} AS stem FROM paths")]) + (
        f"\nSELECT file_id, path, coalesce({', '.join(picks)}) AS year FROM st")
    q["imbalance_by_year"] = _ctes(["grid", "edges"], BY_YEAR) + (
        "\nSELECT year, total_pixels, positive_pixels, negative_pixels, nodata_pixels, "
        f"{_r(('positive_pct', 'negative_pct', 'imbalance_ratio'), 6)}, width, height FROM by_year")
    q["imbalance_summary"] = _ctes(["grid", "edges"], BY_YEAR + [
        ("s", """SELECT count(*) AS n_years, avg(CAST(positive_pixels AS DOUBLE)) AS mean_positive_pixels,
 avg(positive_pct) AS mean_positive_pct, avg(imbalance_ratio) AS mean_imbalance_ratio,
 CAST(sum(positive_pixels) AS BIGINT) AS total_positive_pixels, CAST(sum(negative_pixels) AS BIGINT) AS total_negative_pixels
 FROM by_year"""),
        ("lo", "SELECT positive_pct AS min_positive_pct, year AS min_positive_year FROM by_year ORDER BY positive_pct ASC, year ASC LIMIT 1"),
        ("hi", "SELECT positive_pct AS max_positive_pct, year AS max_positive_year FROM by_year ORDER BY positive_pct DESC, year ASC LIMIT 1"),
    ]) + ("\nSELECT n_years, "
          + _r(("mean_positive_pixels", "mean_positive_pct", "mean_imbalance_ratio", "min_positive_pct"), 6)
          + ", min_positive_year, round(max_positive_pct, 6) AS max_positive_pct, max_positive_year,"
            " total_positive_pixels, total_negative_pixels FROM s CROSS JOIN lo CROSS JOIN hi")
    q["imbalance_hist"] = _ctes(["grid", "edges"], BY_YEAR + _hist_sql("by_year", "positive_pct", 15, None, False)) + (
        "\nSELECT * FROM hout")
    q["aligned_pixels"] = _ctes(["raw_obs", "grid", "edges", "nlcd"], ALIGNED) + (
        f"\nSELECT pixel_id, year, {_r(ALL + ('pixel_count',), 6)}, presence, nlcd_class FROM aligned")
    # Classes of the training years by frequency, ties in string order; a class unseen there has the next index.
    bands = ", ".join("CASE WHEN (c.pixel_id + c.year) % 17 = 0 THEN NULL WHEN (c.pixel_id + c.year) % 19 = 0"
                      " THEN CAST('nan' AS DOUBLE) ELSE c.NIR END AS NIR" if b == "NIR" else f"c.{b}" for b in ALL)
    q["feature_rows"] = _ctes(["raw_obs", "grid", "nlcd"], COMPOSITE + [
        ("feat", f"""SELECT c.year, c.pixel_id, {bands}, CASE WHEN c.year >= 2016 AND c.pixel_id % 5 = 0 THEN 99
 ELSE n.nlcd_class END AS nlcd_class FROM comp c JOIN nlcd n ON n.pixel_id = c.pixel_id"""),
        ("seen", """SELECT nlcd_class, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST(nlcd_class AS VARCHAR)) - 1 AS INT)
 AS idx FROM feat WHERE year BETWEEN 1995 AND 2015 GROUP BY nlcd_class"""),
        ("n_seen", "SELECT CAST(count(*) AS INT) AS n FROM seen"),
    ]) + (f"\nSELECT f.year, f.pixel_id, f.nlcd_class, coalesce(s.idx, n.n) AS nlcd_indexed, {len(ALL)} + n.n AS n_features,"
          " coalesce(s.idx, -1) AS hot, " + ", ".join(f"round(f.{b}, 6) AS f{i}" for i, b in enumerate(ALL))
          + " FROM feat f CROSS JOIN n_seen n LEFT JOIN seen s ON s.nlcd_class = f.nlcd_class WHERE "
          + " AND ".join(f"f.{b} IS NOT NULL AND NOT isnan(f.{b})" for b in ALL))
    q["stratified_sample"] = _ctes(["raw_obs", "grid", "edges", "nlcd"], SAMPLE) + (
        f"\nSELECT pixel_id, year, {_r(ALL + ('pixel_count',), 6)}, presence, nlcd_class FROM sample")
    q["stratified_sample_capped"] = _ctes(["grid", "edges"], LABELS + [
        ("k2", "SELECT *, substr(md5('7:' || year || ':' || pixel_id), 1, 15) AS h FROM labels"),
        ("k3", "SELECT *, row_number() OVER (PARTITION BY year, presence ORDER BY h, pixel_id) AS rn FROM k2"),
        ("k4", "SELECT year, count(*) FILTER (WHERE presence = 1) AS p FROM labels GROUP BY year"),
    ]) + ("\nSELECT k3.year, k3.pixel_id, k3.presence FROM k3 JOIN k4 ON k4.year = k3.year"
          " WHERE k3.rn <= CASE WHEN k3.presence = 1 THEN least(k4.p, 5) ELSE 3 * least(k4.p, 5) END")
    q["samples_written"] = _ctes(["grid", "edges"], LABELS) + (
        "\nSELECT pixel_id, row_idx, col_idx, presence, year FROM labels WHERE year BETWEEN 1995 AND 2015")
    q["report_csv"] = q["imbalance_by_year"]
    q["predictions_written"] = _ctes(["scored"], []) + (
        "\nSELECT presence AS true_label, round(CAST(CAST(prob AS FLOAT) AS DOUBLE), 6) AS predicted_prob, count(*) AS n"
        " FROM scored GROUP BY 1, 2")
    q["sample_totals"] = _ctes(["raw_obs", "grid", "edges", "nlcd"], SAMPLE) + (
        "\nSELECT count(*) AS total, count(*) FILTER (WHERE presence = 1) AS positives,"
        " count(*) FILTER (WHERE presence = 0) AS negatives FROM sample")
    split = ("CASE WHEN year BETWEEN 1995 AND 2015 THEN 'train' WHEN year BETWEEN 2016 AND 2018 THEN 'val'"
             " WHEN year BETWEEN 2019 AND 2022 THEN 'test' END")
    q["split_counts"] = _ctes(["scored"], [("sp", f"SELECT {split} AS split, presence FROM scored")]) + (
        "\nSELECT split, presence, count(*) AS n FROM sp WHERE split IS NOT NULL GROUP BY split, presence")
    q["class_weights"] = _ctes(["scored"], [
        ("tr", "SELECT * FROM scored WHERE year BETWEEN 1995 AND 2015"),
        ("c", "SELECT count(*) FILTER (WHERE presence = 1) AS p, count(*) FILTER (WHERE presence = 0) AS n FROM tr"),
    ]) + ("\nSELECT id, year, presence, round(prob, 9) AS prob, round(CASE WHEN presence = 1 THEN"
          " (CASE WHEN c.p > 0 THEN CAST(c.n AS DOUBLE) / c.p ELSE 1.0 END) ELSE 1.0 END, 9) AS weight"
          " FROM tr CROSS JOIN c")
    prec = _prec("tp", "fp")
    prev = _prec("tp - pos", "fp - neg")
    first = "((tp - pos) + (fp - neg)) = 0"
    q["roc_auc_exact"] = _ctes(["scored"], POINTS + [
        ("terms", f"""SELECT *, CAST(neg AS DOUBLE) * CAST(2 * tp - pos AS DOUBLE) AS roc_term,
 CAST(pos AS DOUBLE) * (({prec}) + (CASE WHEN {first} THEN {prec} ELSE {prev} END)) / 2.0 AS pr_term,
 CAST(pos AS DOUBLE) * (({prec}) + (CASE WHEN {first} THEN 1.0 ELSE {prev} END)) / 2.0 AS pr1_term FROM pts"""),
        ("agg", """SELECT sum(roc_term) AS rs, sum(pr_term) AS ps, sum(pr1_term) AS p1s,
 CAST(first(n_pos) AS DOUBLE) AS P, CAST(first(n_neg) AS DOUBLE) AS N, first(n_pos) AS n_pos, first(n_neg) AS n_neg FROM terms"""),
    ]) + ("\nSELECT round(CASE WHEN 2.0 * P * N = 0 THEN 0.0 ELSE rs / (2.0 * P * N) END, 9) AS roc_auc,"
          " round(CASE WHEN P = 0 THEN 0.0 ELSE ps / P END, 9) AS pr_auc,"
          " round(CASE WHEN P = 0 THEN 0.0 ELSE p1s / P END, 9) AS pr_auc_trapezoid,"
          " round(CASE WHEN P + N = 0 THEN 0.0 ELSE P / (P + N) END, 9) AS baseline, n_pos, n_neg FROM agg")
    q["roc_curve"] = _ctes(["scored"], POINTS) + (
        "\nSELECT round(threshold, 9) AS threshold,"
        " round(CASE WHEN n_neg = 0 THEN 0.0 ELSE CAST(fp AS DOUBLE) / CAST(n_neg AS DOUBLE) END, 9) AS fpr,"
        " round(CASE WHEN n_pos = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(n_pos AS DOUBLE) END, 9) AS tpr FROM pts"
        " UNION ALL SELECT NULL, 0.0, 0.0 FROM (SELECT 1 FROM pts LIMIT 1)")
    q["pr_curve"] = _ctes(["scored"], POINTS) + (
        "\nSELECT round(threshold, 9) AS threshold,"
        " round(CASE WHEN n_pos = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(n_pos AS DOUBLE) END, 9) AS recall,"
        f" round({prec}, 9) AS precision FROM pts"
        " UNION ALL SELECT NULL, 0.0, 1.0 FROM (SELECT 1 FROM pts LIMIT 1)")
    q["confusion_at_threshold"] = _ctes(["scored"], [
        ("cm", """SELECT count(*) FILTER (WHERE presence = 1 AND prob >= 0.5) AS tp,
 count(*) FILTER (WHERE presence <> 1 AND prob >= 0.5) AS fp,
 count(*) FILTER (WHERE presence <> 1 AND prob < 0.5) AS tn,
 count(*) FILTER (WHERE presence = 1 AND prob < 0.5) AS fn FROM scored"""),
        ("cd", "SELECT *, CAST(tp AS DOUBLE) AS dtp, CAST(fp AS DOUBLE) AS dfp, CAST(tn AS DOUBLE) AS dtn, CAST(fn AS DOUBLE) AS dfn FROM cm"),
        ("pr", """SELECT *, CASE WHEN dtp + dfp = 0 THEN 0.0 ELSE dtp / (dtp + dfp) END AS precision,
 CASE WHEN dtp + dfn = 0 THEN 0.0 ELSE dtp / (dtp + dfn) END AS recall FROM cd"""),
    ]) + ("\nSELECT 0.5::DOUBLE AS threshold, tp, fp, tn, fn,"
          " round(CASE WHEN dtp + dtn + dfp + dfn = 0 THEN 0.0 ELSE (dtp + dtn) / (dtp + dtn + dfp + dfn) END, 9) AS accuracy,"
          " round(precision, 9) AS precision, round(recall, 9) AS recall,"
          " round(CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2.0 * precision * recall / (precision + recall) END, 9) AS f1 FROM pr")
    q["prob_histogram"] = _ctes(["scored"], _hist_sql("scored", "prob", 50, "presence", True)) + (
        "\nSELECT presence, bin, lo, hi, \"count\", n, round(density, 6) AS density FROM hout")
    q["aoi_scene_topk"] = _ctes(["scenes", "aoi"], CATALOG + [
        ("rk", "SELECT *, CAST(row_number() OVER (PARTITION BY aoi_id ORDER BY cloud ASC, scene_id ASC) AS INT) AS rnk FROM pairs"),
    ]) + "\nSELECT aoi_id, scene_id, collection, acquired, cloud, rnk AS \"rank\" FROM rk WHERE rnk <= 3"
    q["aoi_scene_count"] = _ctes(["scenes", "aoi"], CATALOG) + (
        "\nSELECT aoi_id, count(*) AS n_scenes FROM pairs GROUP BY aoi_id")
    q["leaderboard"] = _ctes(["trials"], LEADER) + (
        "\nSELECT row_number() OVER (ORDER BY val_auc DESC NULLS LAST, app_name ASC) AS rank, app_name, val_auc, test_auc, val_pr_auc, test_pr_auc, max_depth, eta, subsample, colsample_bytree,"
        " min_child_weight, reg_lambda FROM runs ORDER BY val_auc DESC NULLS LAST, app_name ASC LIMIT 10")
    q["leaderboard_full"] = q["leaderboard"].removesuffix(" LIMIT 10")
    q["run_documents"] = q["leaderboard_full"]
    q["best_model"] = _ctes(["trials"], LEADER + [
        ("b", "SELECT * FROM runs ORDER BY val_auc DESC NULLS LAST, app_name ASC LIMIT 1"),
    ]) + ("\nSELECT (SELECT count(*) FROM runs) AS n_models, b.app_name AS best_app_name, b.val_auc AS best_val_auc,"
          " b.val_pr_auc AS best_val_pr_auc, b.test_auc AS best_test_auc, b.test_pr_auc AS best_test_pr_auc,"
          " (SELECT max(test_auc) FROM runs) AS max_test_auc FROM b")
    # Parity inside a part, any part of any territory.
    q["presence_labels_parts"] = _ctes(["grid"], [
        ("terr", """SELECT s_suppkey AS poly_id, 1995 + CAST(s_suppkey % 28 AS INT) AS year, CAST(s_suppkey * 3 % 7 AS DOUBLE) AS ax,
 CAST(s_suppkey * 5 % 7 AS DOUBLE) AS ay FROM supplier WHERE s_suppkey % 9 <> 4"""),
        ("seg(part, a1, b1, a2, b2)", """VALUES (0, 0.0, 0.0, 4.0, 0.0), (0, 4.0, 0.0, 4.0, 4.0), (0, 4.0, 4.0, 0.0, 4.0),
 (0, 0.0, 4.0, 0.0, 0.0), (0, 1.0, 1.0, 3.0, 1.0), (0, 3.0, 1.0, 3.0, 3.0), (0, 3.0, 3.0, 1.0, 3.0), (0, 1.0, 3.0, 1.0, 1.0),
 (1, 2.0, 2.0, 5.0, 2.25), (1, 5.0, 2.25, 2.5, 5.0), (1, 2.5, 5.0, 2.0, 2.0)"""),
        ("e", """SELECT poly_id, part, year, CAST(ax + a1 AS DOUBLE) AS x1, CAST(ay + b1 AS DOUBLE) AS y1, CAST(ax + a2 AS DOUBLE) AS x2,
 CAST(ay + b2 AS DOUBLE) AS y2 FROM terr CROSS JOIN seg"""),
        ("n", """SELECT g.pixel_id, e.year, e.poly_id, e.part,
 SUM(CASE WHEN ((e.y1 > g.py) <> (e.y2 > g.py)) AND (g.px < (e.x2 - e.x1) * (g.py - e.y1) / (e.y2 - e.y1) + e.x1) THEN 1 ELSE 0 END) AS n
 FROM grid g CROSS JOIN e GROUP BY ALL"""),
        ("pos", "SELECT DISTINCT pixel_id, year FROM n WHERE n % 2 = 1"),
    ]) + """
SELECT y.year, g.pixel_id, CAST(floor(g.py) AS INT) AS row_idx, CAST(floor(g.px) AS INT) AS col_idx,
 CASE WHEN p.pixel_id IS NULL THEN 0 ELSE 1 END AS presence
FROM grid g CROSS JOIN (SELECT DISTINCT year FROM terr) y LEFT JOIN pos p ON p.pixel_id = g.pixel_id AND p.year = y.year"""
    # Every four digits that stand free, by position; the last in range.
    q["path_year_free"] = """WITH p AS (SELECT p_partkey AS k, 1990 + p_partkey % 37 AS y FROM part),
f AS (SELECT k AS file_id, CASE k % 6 WHEN 0 THEN concat('/d/area', y, 'x/agate 7.shp') WHEN 1 THEN concat('/d/set-', y, '-', y - 5, '/agate.shp')
 WHEN 2 THEN concat('/d/x', y, ' y', y - 5, ' z/agate.shp') WHEN 3 THEN concat('/d/n1', y, 'b/agate.shp')
 WHEN 4 THEN concat('/d/_', y, ' a/agate.shp') ELSE concat('/d/q', y, '_/agate.', y - 5) END AS path FROM p),
c AS (SELECT file_id, path, list_filter(list_transform(range(1, length(path) - 2), lambda i:
  CASE WHEN regexp_full_match(path[i:i + 3], '[0-9]{4}') AND (i = 1 OR path[i - 1] NOT IN ('/', '_'))
   AND NOT regexp_full_match(path[i + 4:i + 4], '[/_0-9]') THEN CAST(path[i:i + 3] AS INT) END), lambda x: x BETWEEN 1995 AND 2022) AS ys FROM f)
SELECT file_id, path, ys[len(ys)] AS year FROM c"""
    q["roc_curve_compact"] = _ctes(["scored"], POINTS + [
        ("st", """SELECT *, row_number() OVER (ORDER BY threshold DESC) AS i, lead(pos) OVER (ORDER BY threshold DESC) AS pos1,
 lead(neg) OVER (ORDER BY threshold DESC) AS neg1 FROM pts"""),
    ]) + ("\nSELECT round(threshold, 9) AS threshold,"
          " round(CASE WHEN n_neg = 0 THEN 0.0 ELSE CAST(fp AS DOUBLE) / CAST(n_neg AS DOUBLE) END, 9) AS fpr,"
          " round(CASE WHEN n_pos = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(n_pos AS DOUBLE) END, 9) AS tpr FROM st"
          " WHERE i = 1 OR pos1 IS NULL OR pos <> pos1 OR neg <> neg1"
          " UNION ALL SELECT NULL, 0.0, 0.0 FROM (SELECT 1 FROM pts LIMIT 1)")
    q["bounded_sample_check"] = ("SELECT count(*) AS total, true AS subset, true AS repeatable, true AS near_bound,"
                                 " count(*) > 5000 AS drawn FROM lineitem")
    q["run_files"] = """WITH d AS (SELECT s_suppkey AS s, concat('{', chr(10), '  "app_name": "trial_', s_suppkey, '",', chr(10), '  "metrics": {', chr(10),
 '    "val_auc": ', CASE WHEN s_suppkey % 10 = 7 THEN '"high"' ELSE concat('0.', lpad(CAST((s_suppkey * 37) % 1000 AS VARCHAR), 3, '0')) END, ',', chr(10),
 '    "test_auc": 0.5', chr(10), '  },', chr(10), '  "hyperparameters": {', chr(10), '    "max_depth": ', 6 + s_suppkey % 4 * 2, chr(10), '  }', chr(10), '}') AS js FROM supplier),
t AS (SELECT s, CASE s % 10 WHEN 9 THEN js[1:40] WHEN 8 THEN '[1, 2]' ELSE js END AS js, s % 10 AS k FROM d)
SELECT s AS run_id, CAST(strlen(js) + 1 AS BIGINT) AS n_bytes,
 CASE WHEN NOT json_valid(js) OR json_type(js) <> 'OBJECT' THEN 'skipped' WHEN json_type(js, '$.metrics.val_auc') = 'VARCHAR' THEN 'partial' ELSE 'read' END AS status,
 CASE WHEN NOT json_valid(js) THEN 'not JSON' WHEN json_type(js) <> 'OBJECT' THEN 'not an object'
  WHEN json_type(js, '$.metrics.val_auc') = 'VARCHAR' THEN 'a field of another type' END AS reason,
 CASE WHEN k < 8 THEN json_extract_string(js, '$.app_name') END AS app_name,
 CASE WHEN k < 7 THEN CAST(json_extract(js, '$.metrics.val_auc') AS DOUBLE) END AS val_auc,
 CASE WHEN k < 8 THEN CAST(json_extract(js, '$.metrics.test_auc') AS DOUBLE) END AS test_auc,
 CASE WHEN k < 8 THEN CAST(json_extract(js, '$.hyperparameters.max_depth') AS BIGINT) END AS max_depth FROM t"""
    q["tuning_sweep"] = _ctes(["raw_obs", "grid", "edges", "nlcd", "trials"], ALIGNED + LEADER + [
        ("sets", f"SELECT DISTINCT {', '.join(HYPERPARAMETERS)} FROM runs"),
        ("named", "SELECT *, row_number() OVER (ORDER BY "
                  + ", ".join(f"{h} NULLS FIRST" for h in HYPERPARAMETERS) + ") - 1 AS i FROM sets"),
        ("cn", """SELECT count(*) FILTER (WHERE year BETWEEN 1995 AND 2015) AS train_samples,
 count(*) FILTER (WHERE year BETWEEN 2016 AND 2018) AS val_samples, count(*) FILTER (WHERE year BETWEEN 2019 AND 2022) AS test_samples,
 count(*) FILTER (WHERE year BETWEEN 1995 AND 2015 AND presence = 1) AS pos_count,
 count(*) FILTER (WHERE year BETWEEN 1995 AND 2015 AND presence = 0) AS neg_count FROM aligned"""),
    ]) + ("\nSELECT 'trial_' || i AS app_name, cn.*, round(CASE WHEN pos_count > 0 THEN CAST(neg_count AS DOUBLE) / pos_count ELSE 1.0 END, 9)"
          " AS weight_ratio, coalesce(max_depth, 10) AS max_depth, coalesce(eta, 0.1)::DOUBLE AS eta, 100::BIGINT AS num_round,"
          " subsample, colsample_bytree, min_child_weight, reg_lambda, reg_alpha,"
          " array_to_string(range(1995, 2016), ',') AS train_years, array_to_string(range(2016, 2019), ',') AS val_years,"
          " array_to_string(range(2019, 2023), ',') AS test_years, "
          + ", ".join(f"CASE WHEN {s}_samples > 0 THEN true END AS {s}_{m}_found" for s in ("val", "test") for m in ("auc", "pr_auc"))
          + " FROM named CROSS JOIN cn")
    q["one_split_model"] = _ctes(["scored"], ONE_SPLIT) + """
SELECT 0 AS tree, 1.0::DOUBLE AS weight, 0 AS node, 0 AS feature, round(t, 9) AS threshold, 1 AS "left", 2 AS "right",
 round((ly + ry) / (lw + rw), 9) AS prediction, ln + rn AS n_rows FROM best
UNION ALL SELECT 0, 1.0, 1, NULL, NULL, NULL, NULL, round(ly / lw, 9), ln FROM best
UNION ALL SELECT 0, 1.0, 2, NULL, NULL, NULL, NULL, round(ry / rw, 9), rn FROM best"""
    q["node_scores"] = _ctes(["scored"], ONE_SPLIT) + """
SELECT b.band, round(1 / (1 + exp(-2 * CASE WHEN b.band <= t THEN ly / lw ELSE ry / rw END)), 9) AS prob, count(*) AS n,
 count(*) FILTER (WHERE presence = 1) AS positives FROM banded b CROSS JOIN best WHERE year BETWEEN 2016 AND 2018 GROUP BY 1, 2"""
    # Two scores only: the curves have one inner point.
    q["saved_model_eval"] = _ctes(["scored"], ONE_SPLIT + [
        ("c", """SELECT (SELECT count(*) FROM banded) AS total_samples, count(*) AS eval_samples,
 count(*) FILTER (WHERE presence = 1) AS pos_count, count(*) FILTER (WHERE presence = 0) AS neg_count,
 CAST(count(*) FILTER (WHERE presence = 1 AND (band > t) = (ry / rw > ly / lw)) AS DOUBLE) AS tp,
 CAST(count(*) FILTER (WHERE presence = 0 AND (band > t) = (ry / rw > ly / lw)) AS DOUBLE) AS fp
 FROM banded CROSS JOIN best WHERE year BETWEEN 2019 AND 2022"""),
    ]) + """
SELECT '2019,2020,2021,2022' AS eval_years, total_samples, eval_samples, pos_count, neg_count,
 round(CAST(neg_count AS DOUBLE) / pos_count, 9) AS class_ratio,
 round((tp / pos_count) * (fp / neg_count) / 2 + (tp / pos_count + 1) / 2 * (1 - fp / neg_count), 9) AS roc_auc,
 round(tp / (tp + fp) * (tp / pos_count)
  + (tp / (tp + fp) + CAST(pos_count AS DOUBLE) / (pos_count + neg_count)) / 2 * (1 - tp / pos_count), 9) AS pr_auc FROM c"""
    return q


ORACLE_SQL = build()
