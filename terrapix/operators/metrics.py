"""Binary-classifier evaluation computed over all rows, distributed.

Scores are first grouped by distinct value (a partial aggregate), then the
curve needs prefix sums over scores in descending order; those come from
``running_totals`` so no single task ever sees the whole score range.
Only the curve / histogram tables (one row per distinct score or bin) are
results; nothing is collected to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from terrapix.functions.spectral import safe_div
from terrapix.operators.prefix import running_totals
from terrapix.sources.store import materialize

# ---------------------------------------------------------------------------
# Published evaluation defaults.
# ---------------------------------------------------------------------------
DEFAULT_THRESHOLD = 0.5
PROB_HIST_BINS = 50
# ---------------------------------------------------------------------------


def scores(predictions: DataFrame, label: str = "presence", prob: str = "probability") -> DataFrame:
    """``true_label``, ``predicted_prob`` (positive-class probability, 32-bit)
    from a model's output, with the built-in ``vector_to_array`` (no Python)."""
    from pyspark.ml.functions import vector_to_array

    return predictions.select(F.col(label).cast("int").alias("true_label"),
                              vector_to_array(prob)[1].cast("float").alias("predicted_prob"))


def bounded_sample(df: DataFrame, max_rows: int | None = None, seed: int = 42,
                   fraction: float = 1.0) -> DataFrame:
    """Seeded Bernoulli sample: ``max_rows / count`` when the table is larger,
    else the explicit ``fraction``.  The size is approximate (as with any
    ``sample``); use it only for plotting subsets, never for metrics, which are
    computed over all rows."""
    if max_rows:
        n = df.count()
        if n > max_rows:
            return df.sample(withReplacement=False, fraction=max_rows / n, seed=seed)
        return df
    return df.sample(withReplacement=False, fraction=fraction, seed=seed) if fraction < 1.0 else df


def score_points(df: DataFrame, label: str = "presence", score: str = "prob",
                 num_partitions: int | None = None, by: list[str] | None = None) -> DataFrame:
    """One row per distinct score (per ``by`` group), descending, with counts
    and cumulative counts.

    Columns: ``*by, threshold, pos, neg, tp, fp, n_pos, n_neg`` where
    ``tp``/``fp`` count rows with score >= threshold.
    """
    by = list(by or [])
    g = df.groupBy(*by, F.col(score).cast("double").alias("threshold")).agg(
        F.count(F.when(F.col(label) == 1, 1)).alias("pos"),
        F.count(F.when(F.col(label) != 1, 1)).alias("neg"))
    r = running_totals(g, by, [F.col("threshold").desc()], {"pos": "pos", "neg": "neg"},
                       with_total=True, num_partitions=num_partitions, along=-F.col("threshold"))
    return r.select(*by, "threshold", "pos", "neg", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"),
                    F.col("tot_pos").alias("n_pos"), F.col("tot_neg").alias("n_neg"))


def _prec(tp, fp):
    return safe_div(tp.cast("double"), (tp + fp).cast("double"))


def curve_areas(df: DataFrame, label: str = "presence", score: str = "prob",
                num_partitions: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Exact ROC AUC and two PR areas in one aggregate over the curve points.

    * ``roc_auc``: trapezoids between consecutive distinct thresholds, from
      (0,0) to (1,1); equals the evaluator's area with ``numBins=0``.
    * ``pr_auc``: trapezoids over recall, the curve starting at
      (0, precision of the first threshold), as the evaluator does.
    * ``pr_auc_trapezoid``: same curve but starting at (0, 1), as a plotting
      library's precision-recall curve does.
    * ``baseline``: positive share.

    With ``by``, one row per group from the same single pass.
    """
    by = list(by or [])
    p = score_points(df, label, score, num_partitions, by)
    P, N = F.col("n_pos").cast("double"), F.col("n_neg").cast("double")
    tp, fp, pos, neg = F.col("tp"), F.col("fp"), F.col("pos"), F.col("neg")
    prev_tp, prev_fp = tp - pos, fp - neg
    first = (prev_tp + prev_fp) == 0
    prec = _prec(tp, fp)
    prev_prec = F.when(first, prec).otherwise(_prec(prev_tp, prev_fp))
    prev_prec_1 = F.when(first, F.lit(1.0)).otherwise(_prec(prev_tp, prev_fp))
    roc_term = neg.cast("double") * (2 * tp - pos).cast("double")
    return p.groupBy(*by).agg(
        safe_div(F.sum(roc_term), 2.0 * F.first(P) * F.first(N)).alias("roc_auc"),
        safe_div(F.sum(pos.cast("double") * (prec + prev_prec) / 2.0), F.first(P)).alias("pr_auc"),
        safe_div(F.sum(pos.cast("double") * (prec + prev_prec_1) / 2.0), F.first(P)).alias("pr_auc_trapezoid"),
        safe_div(F.first(P), F.first(P) + F.first(N)).alias("baseline"),
        F.first("n_pos").alias("n_pos"), F.first("n_neg").alias("n_neg"),
    )


def compact_points(points: DataFrame) -> DataFrame:
    """``score_points`` without those at which a curve goes straight on: the next step equals the one that led there.

    The point after another is found by an equality: rows at or above a score
    grow with every point, so their number names a point, and the next
    point's number before its own step is the same.  The names differ, so the
    join has no hot key, and no order over all points is needed.
    """
    n = F.col("tp") + F.col("fp")
    after = points.select((n - F.col("pos") - F.col("neg")).alias("_n"), F.col("pos").alias("_pos"), F.col("neg").alias("_neg"))
    straight = (F.col("pos") == F.col("_pos")) & (F.col("neg") == F.col("_neg")) & (n > F.col("pos") + F.col("neg"))
    return (points.withColumn("_n", n).join(after, "_n", "left")
            .filter(~F.coalesce(straight, F.lit(False))).drop("_n", "_pos", "_neg"))


def roc_curve(df: DataFrame, label: str = "presence", score: str = "prob",
              num_partitions: int | None = None, compact: bool = False) -> DataFrame:
    """ROC points (threshold, fpr, tpr): (0, 0) with a null threshold, then one per distinct score.

    ``compact`` leaves out points between two equal steps; the first and the last stay.
    """
    p = materialize(score_points(df, label, score, num_partitions), "curve-points")
    p = compact_points(p) if compact else p
    points = p.select("threshold",
                      safe_div(F.col("fp").cast("double"), F.col("n_neg").cast("double")).alias("fpr"),
                      safe_div(F.col("tp").cast("double"), F.col("n_pos").cast("double")).alias("tpr"))
    return points.unionByName(_end_point(p, fpr=0.0, tpr=0.0))


def _end_point(points: DataFrame, **values: float) -> DataFrame:
    """The curve's point above all scores; none where there are no scores."""
    return points.limit(1).select(F.lit(None).cast("double").alias("threshold"),
                                  *[F.lit(v).alias(k) for k, v in values.items()])


def pr_curve(df: DataFrame, label: str = "presence", score: str = "prob",
             num_partitions: int | None = None) -> DataFrame:
    """Precision-recall points (threshold, recall, precision): (0, 1) with a null threshold,
    then one per distinct score."""
    p = score_points(df, label, score, num_partitions)
    points = p.select("threshold",
                      safe_div(F.col("tp").cast("double"), F.col("n_pos").cast("double")).alias("recall"),
                      _prec(F.col("tp"), F.col("fp")).alias("precision"))
    return points.unionByName(_end_point(p, recall=0.0, precision=1.0))


def confusion(df: DataFrame, threshold: float = DEFAULT_THRESHOLD, label: str = "presence",
              score: str = "prob") -> DataFrame:
    """Confusion counts at ``score >= threshold`` plus accuracy, precision,
    recall and F1 (0 when undefined), in one conditional aggregate."""
    pred = F.col(score) >= F.lit(float(threshold))
    pos = F.col(label) == 1
    c = df.agg(
        F.count(F.when(pos & pred, 1)).alias("tp"), F.count(F.when(~pos & pred, 1)).alias("fp"),
        F.count(F.when(~pos & ~pred, 1)).alias("tn"), F.count(F.when(pos & ~pred, 1)).alias("fn"))
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    precision = safe_div(tp, tp + fp)
    recall = safe_div(tp, tp + fn)
    return c.select(
        F.lit(float(threshold)).alias("threshold"), "tp", "fp", "tn", "fn",
        safe_div(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        precision.alias("precision"), recall.alias("recall"),
        safe_div(2.0 * precision * recall, precision + recall).alias("f1"),
    )


def bin_edge(i: Column, lo: Column, hi: Column, bins: int) -> Column:
    """``lo + i * (hi - lo) / bins``, the last edge exactly ``hi``."""
    return F.when(i == bins, hi).otherwise(i * ((hi - lo) / F.lit(float(bins))) + lo)


def bin_of(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """``floor((x - lo) * (bins / (hi - lo)))``, corrected by one where rounding put ``x`` across an edge."""
    raw = F.floor((x - lo) * (F.lit(float(bins)) / (hi - lo))).cast("int")
    i0 = F.least(F.greatest(raw, F.lit(0)), F.lit(bins - 1))
    i1 = F.when(x < bin_edge(i0, lo, hi, bins), i0 - 1).otherwise(i0)
    return F.when((x >= bin_edge(i1 + 1, lo, hi, bins)) & (i1 != bins - 1), i1 + 1).otherwise(i1)


def widened(low: Column, high: Column) -> tuple[Column, Column]:
    """The range [low, high], or half a unit to each side where it is a point."""
    return F.when(low == high, low - 0.5).otherwise(low), F.when(low == high, high + 0.5).otherwise(high)


def small_histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """``histogram`` of a table of few rows, in one evaluation: its values are one array."""
    x = F.col(col).cast("double")
    values = df.agg(F.collect_list(F.when(~F.isnan(x), x)).alias("_v")).filter(F.size("_v") > 0)
    lo, hi = widened(F.array_min("_v"), F.array_max("_v"))
    of = F.transform("_v", lambda v: bin_of(v, F.col("_lo"), F.col("_hi"), bins))
    each = (values.withColumns({"_lo": lo, "_hi": hi}).withColumn("_bins", of)
            .select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")))
    return each.select("bin", bin_edge(F.col("bin"), F.col("_lo"), F.col("_hi"), bins).alias("lo"),
                       bin_edge(F.col("bin") + 1, F.col("_lo"), F.col("_hi"), bins).alias("hi"),
                       F.size(F.filter("_bins", lambda b: b == F.col("bin"))).cast("long").alias("count"),
                       F.size("_v").cast("long").alias("n"))


def histogram(df: DataFrame, col: str, bins: int, by: str | None = None, density: bool = False) -> DataFrame:
    """Equal-width histogram over each group's own [min, max] (all bins, also empty).

    Edges are ``lo + i * (hi - lo) / bins`` with the last edge exactly ``hi``;
    bin ``i`` covers ``[edge_i, edge_i+1)``, the last bin closed.  A value's
    bin is ``floor((x - lo) * (bins / (hi - lo)))`` corrected by one when
    rounding put it across an edge.  When min == max the range becomes
    [min - 0.5, max + 0.5].  With ``density``, ``density = count / (n * width)``.

    Two passes are inherent (range, then bins); both aggregate before they
    shuffle.  ``by`` must have few values (classes): the ranges of all groups
    come back as one map from a scalar subquery, so no row is joined or moved
    for its group.  Null groups are left out.
    """
    keys = [by] if by else []
    x = F.col(col).cast("double")
    vals = df.select(*keys, x.alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    if keys:
        vals = vals.filter(F.col(by).isNotNull())
    stats = vals.groupBy(*keys).agg(F.min("_x").alias("_mn"), F.max("_x").alias("_mx"), F.count("*").alias("_n"))
    lo, hi = widened(F.col("_mn"), F.col("_mx"))
    rng = stats.select(*keys, "_n", lo.alias("_lo"), hi.alias("_hi"))
    if keys:
        entry = F.struct(F.col(by), F.struct("_n", "_lo", "_hi"))
        ranges = rng.agg(F.map_from_entries(F.collect_list(entry)).alias("_m")).scalar()
        j = (vals.withColumn("_m", ranges).withColumn("_r", F.element_at("_m", F.col(by)))
             .select(*keys, "_x", "_r.*"))
        base = rng
    else:
        # One struct: the range is one subquery, which both sides use.
        ranges = rng.select(F.struct("_n", "_lo", "_hi")).scalar()
        j = vals.withColumn("_r", ranges).select("_x", "_r.*")
        base = vals.sparkSession.range(1).select(ranges.alias("_r")).select("_r.*")
    counts = j.groupBy(*keys, bin_of(F.col("_x"), F.col("_lo"), F.col("_hi"), bins).alias("bin")).agg(F.count("*").alias("count"))
    allbins = base.filter(F.col("_n") > 0).select(
        *keys, "_n", "_lo", "_hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = allbins.join(counts, [*keys, "bin"], "left").select(
        *keys, "bin",
        bin_edge(F.col("bin"), F.col("_lo"), F.col("_hi"), bins).alias("lo"),
        bin_edge(F.col("bin") + 1, F.col("_lo"), F.col("_hi"), bins).alias("hi"),
        F.coalesce(F.col("count"), F.lit(0)).alias("count"),
        F.col("_n").alias("n"),
    )
    if density:
        out = out.withColumn("density", (F.col("count") / (F.col("n") * (F.col("hi") - F.col("lo")))).cast(DoubleType()))
    return out
