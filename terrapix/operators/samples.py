"""Training samples: align composite, labels and land cover; balanced selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapix.operators.composite import COMPOSITE_BANDS
from terrapix.operators.prefix import literal_rows
from terrapix.sources.store import materialize

# ---------------------------------------------------------------------------
# Published sampling defaults.
# ---------------------------------------------------------------------------
MAX_POSITIVES_PER_YEAR = 1_500_000
NEGATIVE_RATIO = 1.0
# ---------------------------------------------------------------------------

DEFAULT_SEED = 42
KEY_BITS = 60        # of a selection key: 15 hexadecimal digits
DIGIT_BITS = 12      # looked at in one round of the selection
MAX_BUCKET = 10_000  # pixels that are ranked at once; larger buckets are split by the next digits
STRATUM = ["year", "presence"]

SAMPLE_COLUMNS = ("year", "presence", "nlcd_class") + COMPOSITE_BANDS


def align_pixels(composite: DataFrame, labels: DataFrame, nlcd: DataFrame) -> DataFrame:
    """Composite x label on (year, pixel) and x land cover on pixel.

    Land cover has one vintage for all years, so it joins on the pixel only.
    The planner picks the strategy from sizes (AQE turns a small side into a
    broadcast at run time); nothing is forced, since both sides grow with the
    raster.  Features become doubles, as the published sampler reads them.
    """
    comp = composite.select("year", "pixel_id",
                            *[F.col(b).cast("double").alias(b) for b in COMPOSITE_BANDS],
                            F.col("pixel_count").cast("double").alias("pixel_count"))
    lab = labels.select("year", "pixel_id", "presence")
    return comp.join(lab, ["year", "pixel_id"], "inner").join(nlcd.select("pixel_id", "nlcd_class"),
                                                             "pixel_id", "inner")


def valid_pixels(df: DataFrame, bands=COMPOSITE_BANDS + ("pixel_count",)) -> DataFrame:
    """No missing value (NULL or NaN) in any composite band and land cover > 0."""
    cond = F.col("nlcd_class") > 0
    for b in bands:
        cond = cond & F.col(b).isNotNull() & ~F.isnan(b)
    return df.filter(cond)


def selection_key(pixel="pixel_id", year="year", seed: int = DEFAULT_SEED) -> Column:
    """A 60-bit key of each pixel-year: the first digits of the MD5 of ``seed:year:pixel``.

    Every engine has it, and two pixels' keys have nothing in common, whatever
    their distance in the raster.
    """
    name = F.concat_ws(":", F.lit(str(seed)), F.col(year).cast("string"), F.col(pixel).cast("string"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, KEY_BITS // 4), 16, 10).cast("long")


def _cuts(buckets: DataFrame, target: Column) -> list[dict]:
    """For each stratum the bucket (prefix, n) in which its target falls, and how many it still needs there.

    ``buckets`` holds (year, presence, prefix, n): at most 2**DIGIT_BITS rows a stratum.
    """
    upto = Window.partitionBy(*STRATUM).orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
    rows = (buckets.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).withColumn("target", target)
            .filter((F.col("before") < F.col("target")) & (F.col("target") <= F.col("before") + F.col("n")))
            .select(*STRATUM, "prefix", "n", (F.col("target") - F.col("before")).alias("need")).collect())
    return [r.asDict() for r in rows]  # at most two for each calendar year


def _inside(keyed: DataFrame, cuts: list[dict], shift: int) -> DataFrame:
    """The rows of ``keyed`` in the given buckets, with ``need``."""
    schema = T.StructType([T.StructField("year", keyed.schema["year"].dataType),
                           T.StructField("presence", keyed.schema["presence"].dataType),
                           T.StructField("_prefix", T.LongType()), T.StructField("need", T.LongType())])
    table = literal_rows(keyed.sparkSession, [(c["year"], c["presence"], c["prefix"], c["need"]) for c in cuts], schema)
    return (keyed.select(*STRATUM, "pixel_id", "_key", F.shiftright("_key", shift).alias("_prefix"))
            .join(F.broadcast(table), [*STRATUM, "_prefix"]))


def selection_thresholds(keyed: DataFrame, max_pos: int, neg_ratio: float,
                         max_bucket: int = MAX_BUCKET) -> list[tuple[int, int, int, int | None]]:
    """(year, presence, key, pixel): the last taken (key, pixel) of each stratum; a null pixel takes all of that key.

    A radix selection over ``keyed`` (year, presence, pixel_id, _key): rows are
    counted by the leading digits of their keys (partial sums before the
    shuffle), and the bucket in which a stratum's target falls is counted by its
    next digits until it holds ``max_bucket`` rows or fewer, or is taken
    whole.  Only such a bucket is ranked, so no task sees a stratum.
    """
    shift = KEY_BITS - DIGIT_BITS
    counts = (keyed.groupBy(*STRATUM, F.shiftright("_key", shift).alias("prefix")).agg(F.count("*").alias("n")))
    of_class = [F.sum(F.when(F.col("presence") == c, F.col("n")).otherwise(0)).over(Window.partitionBy("year")) for c in (1, 0)]
    pos = F.least(of_class[0], F.lit(int(max_pos)))
    neg = F.least(of_class[1], F.floor(pos * F.lit(float(neg_ratio))).cast("long"))
    cuts = _cuts(counts, F.when(F.col("presence") == 1, pos).otherwise(neg))
    done: list[tuple[int, int, int, int | None]] = []
    while cuts:
        whole = [c for c in cuts if c["n"] == c["need"]]
        done += [(c["year"], c["presence"], ((c["prefix"] + 1) << shift) - 1, None) for c in whole]
        ranked = [c for c in cuts if c["n"] > c["need"] and (c["n"] <= max_bucket or shift == 0)]
        if ranked:
            each = (_inside(keyed, ranked, shift).groupBy(*STRATUM, "need", "_key", "pixel_id").agg(F.count("*").alias("c")))
            before = Window.partitionBy(*STRATUM).orderBy("_key", "pixel_id").rowsBetween(Window.unboundedPreceding, -1)
            last = (each.withColumn("before", F.coalesce(F.sum("c").over(before), F.lit(0))).filter("before < need")
                    .groupBy(*STRATUM).agg(F.max(F.struct("_key", "pixel_id")).alias("m")))
            done += [(r["year"], r["presence"], r["m"]["_key"], r["m"]["pixel_id"]) for r in last.collect()]
        cuts = [c for c in cuts if c["n"] > max(c["need"], max_bucket) and shift > 0]
        if cuts:
            inside = _inside(keyed, cuts, shift)
            shift = max(0, shift - DIGIT_BITS)
            cuts = _cuts(inside.groupBy(*STRATUM, "need", F.shiftright("_key", shift).alias("prefix"))
                         .agg(F.count("*").alias("n")), F.col("need"))
    return done


def stratified_sample(df: DataFrame, max_pos: int = MAX_POSITIVES_PER_YEAR,
                      neg_ratio: float = NEGATIVE_RATIO, seed: int = DEFAULT_SEED,
                      max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Per year: up to ``max_pos`` positives, then ``int(n_pos * neg_ratio)``
    negatives (all of them when fewer), both without replacement.

    The selection is exact and repeatable: the first ``target`` rows of each
    (year, presence) stratum by (``selection_key``, pixel); another ``seed``
    draws another sample.  The input is evaluated once, with its keys; the
    thresholds come from counts (``selection_thresholds``), two a year at most,
    and rows are kept by comparison, so no full row is shuffled.  Rows that
    repeat a pixel-year are kept or left out together.
    """
    keyed = materialize(df.filter(F.col("presence").isin(0, 1)).withColumn("_key", selection_key(seed=seed)), "sample-keys")
    last = selection_thresholds(keyed, max_pos, neg_ratio, max_bucket)
    schema = T.StructType([T.StructField("year", keyed.schema["year"].dataType),
                           T.StructField("presence", keyed.schema["presence"].dataType),
                           T.StructField("_last", T.LongType()), T.StructField("_pixel", T.LongType())])
    if not last:
        return keyed.limit(0).drop("_key")
    taken = (F.col("_key") < F.col("_last")) | ((F.col("_key") == F.col("_last")) &
                                                (F.col("_pixel").isNull() | (F.col("pixel_id") <= F.col("_pixel"))))
    out = keyed.join(F.broadcast(literal_rows(df.sparkSession, last, schema)), STRATUM).filter(taken)
    # The key's order mixes the classes inside each partition (row order is not part of the result).
    return out.sortWithinPartitions("_key", "pixel_id").drop("_key", "_last", "_pixel")


def sample_totals(samples: DataFrame) -> DataFrame:
    """Run totals of the sampled rows: all, positives, negatives."""
    return samples.agg(
        F.count("*").alias("total"),
        F.count(F.when(F.col("presence") == 1, 1)).alias("positives"),
        F.count(F.when(F.col("presence") == 0, 1)).alias("negatives"))
