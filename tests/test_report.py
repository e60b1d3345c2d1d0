"""Golden formula checks on the published yearly statistics and leaderboard rules."""

import json

import pytest

from terrapix.operators.report import (
    best_model,
    flatten_run_metrics,
    imbalance_from_counts,
    imbalance_hist,
    imbalance_summary,
    leaderboard,
    parse_run_metrics,
)

# ---------------------------------------------------------------------------
# Published per-year label counts (7010 x 8407 pixels, no nodata)
# and a few published derived values.
# ---------------------------------------------------------------------------
TOTAL, WIDTH, HEIGHT = 58933070, 7010, 8407
COUNTS = {
    1995: (3128077, 55804993), 1996: (8087755, 50845315), 1997: (6456507, 52476563),
    1998: (7799009, 51134061), 1999: (5148223, 53784847), 2000: (5462827, 53470243),
    2001: (5833294, 53099776), 2002: (6058325, 52874745), 2003: (3271039, 55662031),
    2004: (3898787, 55034283), 2005: (4982189, 53950881), 2006: (3888444, 55044626),
    2007: (4210926, 54722144), 2008: (5119683, 53813387), 2009: (5970223, 52962847),
    2010: (4297423, 54635647), 2011: (3114125, 55818945), 2012: (4900403, 54032667),
    2013: (3416601, 55516469), 2014: (4333630, 54599440), 2015: (4583289, 54349781),
    2016: (4262206, 54670864), 2017: (4903821, 54029249), 2018: (3454171, 55478899),
    2019: (5598357, 53334713), 2021: (4064752, 54868318), 2022: (4725715, 54207355),
}
PUBLISHED = {  # year: (positive_pct, negative_pct, imbalance_ratio)
    1995: (5.307846680989129, 94.69215331901087, 17.84003175113656),
    1996: (13.723627498109295, 86.2763725018907, 6.286703170410083),
    2011: (5.284172367059785, 94.71582763294022, 17.924439449283508),
    2022: (8.01878300248061, 91.98121699751938, 11.470720303700075),
}
# ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def by_year(spark):
    rows = [(y, TOTAL, p, n, WIDTH, HEIGHT) for y, (p, n) in COUNTS.items()]
    c = spark.createDataFrame(rows, "year int, total_pixels long, positive_pixels long, negative_pixels long, "
                                    "width int, height int")
    return imbalance_from_counts(c)


def test_yearly_formulas_match_published(by_year):
    got = {r["year"]: r for r in by_year.collect()}
    assert len(got) == 27 and 2020 not in got
    for y, (pp, np_, ratio) in PUBLISHED.items():
        r = got[y]
        assert (r["positive_pct"], r["negative_pct"], r["imbalance_ratio"]) == (pp, np_, ratio)
        assert r["nodata_pixels"] == 0 and r["width"] * r["height"] == r["total_pixels"]


def test_summary_matches_published(by_year):
    s = imbalance_summary(by_year).collect()[0]
    assert s["n_years"] == 27
    assert s["total_positive_pixels"] == 130969801 and s["total_negative_pixels"] == 1460223089
    assert round(s["mean_positive_pct"], 4) == 8.2309
    assert round(s["mean_imbalance_ratio"], 4) == 11.9313
    assert (round(s["min_positive_pct"], 4), s["min_positive_year"]) == (5.2842, 2011)
    assert (round(s["max_positive_pct"], 4), s["max_positive_year"]) == (13.7236, 1996)
    assert round(s["mean_positive_pixels"], 2) == 4850733.37


def test_histogram_covers_all_years(by_year):
    h = imbalance_hist(by_year).collect()
    assert len(h) == 15 and sum(r["count"] for r in h) == 27


def test_no_positive_year_ratio_is_infinite(spark):
    c = spark.createDataFrame([(2000, 10, 0, 10, 2, 5)], "year int, total_pixels long, positive_pixels long, "
                                                        "negative_pixels long, width int, height int")
    r = imbalance_from_counts(c).collect()[0]
    assert r["imbalance_ratio"] == float("inf") and r["positive_pct"] == 0.0


def test_leaderboard_rules(spark):
    docs = [json.dumps({"app_name": "a", "metrics": {"val_auc": 0.70, "test_auc": 0.71},
                        "hyperparameters": {"max_depth": 6, "eta": 0.1}}),
            json.dumps({"app_name": "b", "metrics": {"val_auc": 0.75, "test_auc": 0.60}}),
            json.dumps({"metrics": {"val_auc": 0.72, "test_auc": 0.73}}),
            json.dumps({"app_name": "d", "metrics": {}}),
            "{not json"]  # skipped
    runs = flatten_run_metrics(parse_run_metrics(spark.createDataFrame([(d,) for d in docs], "js string")))
    top = leaderboard(runs, 3).collect()
    assert [r["app_name"] for r in top] == ["b", "unknown", "a"]
    assert top[2]["max_depth"] == 6 and top[0]["eta"] is None
    full = leaderboard(runs, None).collect()
    assert full[-1]["app_name"] == "d" and [r["rank"] for r in full] == [1, 2, 3, 4]  # NULL AUC last
    odd = ['{"app_name": "n", "metrics": {"val_auc": NaN}}', '{"app_name": "f", "metrics": {"val_auc": 0.9}, "hyperparameters": {"max_depth": 8.0}}',
           '{"app_name": "t", "metrics": {"val_auc": 0.95}, "hyperparameters": {"max_depth": "deep"}}']
    extra = flatten_run_metrics(parse_run_metrics(spark.createDataFrame([(d,) for d in docs + odd], "js string")))
    order = leaderboard(extra, 10).collect()
    assert [r["app_name"] for r in order] == ["t", "f", "b", "unknown", "a", "d", "n"]
    assert order[1]["max_depth"] == 8 and order[0]["max_depth"] is None and best_model(extra).first()["best_app_name"] == "t"
    b = best_model(runs).collect()[0]
    assert (b["n_models"], b["best_app_name"], b["best_val_auc"], b["max_test_auc"]) == (4, "b", 0.75, 0.73)
