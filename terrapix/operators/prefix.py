"""Skew-safe running totals and exact order statistics.

``Window.partitionBy(key).orderBy(x)`` puts every row of a key into one task,
so a key holding a third of the data becomes a single straggler (or an OOM).
``running_totals`` instead cuts the order into slices, so that a hot key is
spread over many tasks; each task computes running sums inside a slice, and a
window over the totals of each key in each slice supplies the carry-in.
Nothing passes the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrapix.sources.store import discard, materialize


# Beyond so many partitions the carries are joined by a shuffle.
MAX_BROADCAST_PARTITIONS = 200_000
# Slices that quantiles of the order cut, at most, as a power of two.
MAX_SLICE_BITS = 14


def _num_partitions(df: DataFrame, n: int | None) -> int:
    if n:
        return int(n)
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def literal_rows(spark, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small DataFrame of literal rows, built from expressions (no RDD).
    Only for driver-side summaries with a proven size bound."""
    structs = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(r, schema.fields)])
               for r in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def _sort_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_slice(df: DataFrame, along: Column, n: int) -> DataFrame:
    """``df`` with ``_pid``, the slice of ``along`` (a numeric column) that a row lies in; nulls are in the last.

    The cuts are approximate quantiles over the whole table, one array from a
    scalar subquery of at most 2**MAX_SLICE_BITS numbers.  A binary search
    finds the slice, so equal values share one, and slices rise with values.
    """
    bits = min(max(1, (n - 1).bit_length()), MAX_SLICE_BITS)
    size = 1 << bits
    x = along.cast("double")
    points = F.expr(f"array({', '.join(f'{i / size}D' for i in range(1, size))})")  # must be a literal
    cuts = df.agg(F.percentile_approx(x, points, 10 * size).alias("c")).scalar()
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(bits))])

    def step(at: Column, width: Column) -> Column:
        return at + F.when(F.get("_cuts", at + width - 1) < x, width).otherwise(F.lit(0))

    found = F.when(x.isNull(), F.lit(size)).otherwise(F.aggregate(steps, F.lit(0), step))
    return df.withColumn("_cuts", cuts).withColumn("_pid", found).drop("_cuts")


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list,
    weights: dict[str, str | Column],
    *,
    with_total: bool = False,
    num_partitions: int | None = None,
    along: Column | None = None,
) -> DataFrame:
    """Add inclusive running sums of ``weights`` within each key.

    ``keys``: grouping columns (non-null); may be empty for one global order.
    ``order``: column names or sort expressions (``F.col("x").desc()``); within
    a key the order must be total (no ties) for the sums to be deterministic.
    ``weights``: output name -> integral column.  Adds ``cum_<name>`` and, when
    ``with_total``, ``tot_<name>`` (the key's grand total).

    ``along``: a numeric column that never falls along ``order`` (nulls where the
    order has them, last), with few rows of a key at any one value.  Slices are
    then cut by its quantiles, and the rows are shuffled once.  Without it they
    are range-partitioned by the whole order, for which the windows inside a
    partition shuffle them once more.

    Runs one job eagerly: the rows are written to the checkpoint folder, so every
    consumer sees the same ones.
    """
    n = _num_partitions(df, num_partitions)
    keys = list(keys)
    drop_key = False
    if not keys:
        df = df.withColumn("_rk", F.lit(0))
        keys, drop_key = ["_rk"], True
    order_cols = [_sort_col(c) for c in order]
    names = list(weights)
    df = df.withColumns({f"_w_{k}": _sort_col(v).cast("long") for k, v in weights.items()})
    w_run = Window.partitionBy("_pid", *keys).orderBy(*order_cols).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    w_all = Window.partitionBy("_pid", *keys)
    running = ({f"_lc_{k}": F.sum(f"_w_{k}").over(w_run) for k in names}
               | {f"_lt_{k}": F.sum(f"_w_{k}").over(w_all) for k in names})
    if along is None:
        sliced = (df.repartitionByRange(n, *[F.col(k) for k in keys], *order_cols)
                  .withColumn("_pid", F.spark_partition_id()))
        local = materialize(sliced.withColumns(running).drop(*[f"_w_{k}" for k in names]), "running-totals")
        per_slice = local.groupBy(*keys, "_pid").agg(*[F.first(f"_lt_{k}").alias(f"_t_{k}") for k in names])
    else:
        rows = materialize(df, "running-totals")
        sliced = with_slice(rows, along, n)
        local = sliced.withColumns(running).drop(*[f"_w_{k}" for k in names])
        per_slice = sliced.groupBy(*keys, "_pid").agg(*[F.sum(f"_w_{k}").alias(f"_t_{k}") for k in names])

    # Totals of each key in each slice it reaches, one row each; a window over
    # them gives what came before a slice and the key's grand total.
    own = Window.partitionBy(*keys)
    before = own.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    crossing = (per_slice.withColumn("_parts", F.count("*").over(own))
                .withColumns({f"_c_{k}": F.sum(f"_t_{k}").over(before) for k in names}
                             | {f"_b_{k}": F.sum(f"_t_{k}").over(own) for k in names})
                .filter(F.col("_parts") > 1)
                .drop("_parts", *[f"_t_{k}" for k in names]))
    # Of a range, only the first and the last key can cross its ends: two rows a
    # partition at most, whatever the data.  Slices have no such bound.
    small = F.broadcast(crossing) if along is None and n <= MAX_BROADCAST_PARTITIONS else crossing
    out = local.join(small, [*keys, "_pid"], "left")
    cols = {f"cum_{k}": F.col(f"_lc_{k}") + F.coalesce(F.col(f"_c_{k}"), F.lit(0)) for k in names}
    if with_total:
        cols |= {f"tot_{k}": F.coalesce(F.col(f"_b_{k}"), F.col(f"_lt_{k}")) for k in names}
    out = out.withColumns(cols)
    drop = ["_pid"] + [f"{x}{k}" for x in ("_lc_", "_lt_", "_c_", "_b_") for k in names]
    if drop_key:
        drop.append("_rk")
    return out.drop(*drop)


# A key of up to so many rows is aggregated by one task: with a dozen value
# columns that is a few MB of buffer, for any key.
MAX_GROUP_ROWS = 4096


def exact_medians(
    df: DataFrame,
    keys: list[str],
    values: list[str],
    *,
    counts: dict[str, str] | None = None,
    num_partitions: int | None = None,
    max_group_rows: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """Exact median of each value column per key, skew-safe.

    The average of the two middle values for an even count; NULLs ignored; NULL
    for no values.  Rows are counted per key first (key columns only, partial
    counts before the shuffle).  Keys of up to ``max_group_rows`` rows take the
    built-in aggregate; rows of larger keys go through ``split_medians``, which
    holds no key in one task and reads them once.  Both give the same values.

    ``counts`` maps an output name to one of ``values``: that column's count of
    non-NULL values per key.  ``keys`` are non-null; keys without any non-NULL
    value are absent from the result.  Runs the count eagerly.
    """
    keys = list(keys)
    large = materialize(df.groupBy(*keys).agg(F.count("*").alias("_rows"))
                        .filter(F.col("_rows") > max_group_rows).select(*keys), "large-keys")
    if large.isEmpty():
        discard(large)
        return group_medians(df, keys, values, counts)
    small = group_medians(df.join(large, keys, "left_anti"), keys, values, counts)
    return small.unionByName(
        split_medians(df.join(large, keys, "left_semi"), keys, values, counts=counts, num_partitions=num_partitions))


def group_medians(df: DataFrame, keys: list[str], values: list[str], counts: dict[str, str] | None = None) -> DataFrame:
    """Medians and counts by one aggregate; a key's values meet in one task."""
    out = df.groupBy(*keys).agg(
        *[F.median(F.col(v).cast("double")).alias(v) for v in values],
        *[F.count(v).alias(name) for name, v in (counts or {}).items()])
    return out.filter(F.coalesce(*values).isNotNull())


# Points of the quantile grid that narrows a median's bracket, and the grid's error (1 / accuracy, far below a step).
GRID_STEPS = 64
GRID_ACCURACY = 1000


def split_medians(
    df: DataFrame,
    keys: list[str],
    values: list[str],
    *,
    counts: dict[str, str] | None = None,
    num_partitions: int | None = None,
    hold: int = MAX_GROUP_ROWS,
) -> DataFrame:
    """``exact_medians`` for keys of any size, by selection in rounds.

    Each value column of a key has an open bracket (lo, hi) around its middle
    ranks, the number of values up to ``lo`` and the number inside.  A round
    puts a quantile sketch of the values inside around the wanted rank and
    counts again, which leaves about a sixteenth; brackets that hold at most
    ``hold`` values (64 at least) are collected and sorted.  Sketches and counts
    are combined before the shuffle, so that no task sees a whole key, and
    ties are counted, never collected.  NaN comes after all other values.

    The rows are read once, and written with only these columns
    (``num_partitions``: dealt over so many partitions).  The result is a table
    of its own, one row a key, and the rows' table is removed.
    """
    keys, hold = list(keys), max(hold, GRID_STEPS)
    rows = df.select(*keys, *[F.col(v).cast("double").alias(f"_v{i}") for i, v in enumerate(values)])
    rows = materialize(rows.repartition(num_partitions) if num_partitions else rows, "median-rows")
    cols = range(len(values))

    def c(name: str, i: int) -> Column:
        return F.col(f"_{name}{i}")

    def inside(i: int) -> Column:
        above = c("v", i).isNotNull() & (c("lo", i).isNull() | (c("v", i) > c("lo", i)))
        return above & (c("hi", i).isNull() | (c("v", i) < c("hi", i))) & ~F.isnan(c("v", i))

    def ranks(i: int) -> tuple[Column, Column]:
        return F.floor((c("n", i) + 1) / 2), F.floor(c("n", i) / 2) + 1

    def wanted(i: int) -> Column:
        """Whether a middle rank lies inside the bracket."""
        low, high = ranks(i)
        return (high > c("below", i)) & (low <= c("below", i) + c("in", i))

    def count(df: DataFrame, brackets: list[str], first: list) -> DataFrame:
        return materialize(df.groupBy(*keys, *brackets).agg(*first, *[e for i in cols for e in (
            F.count(F.when(c("v", i) <= c("lo", i), True)).alias(f"_below{i}"),
            F.count(F.when(inside(i), True)).alias(f"_in{i}"))]), "median-brackets")

    open_ = rows.withColumns({f"_{x}{i}": F.lit(None).cast("double") for x in ("lo", "hi") for i in cols})
    ends = [f"_{x}{i}" for i in cols for x in ("lo", "hi")]
    state = count(open_, ends, [F.count(c("v", i)).alias(f"_n{i}") for i in cols])
    points = F.array(*[F.lit(j / GRID_STEPS) for j in range(GRID_STEPS + 1)])
    while True:
        wide = [F.when(wanted(i) & (c("in", i) > hold), True) for i in cols]
        if state.agg(F.count(F.coalesce(*wide))).first()[0] == 0:
            break
        met = rows.join(state, keys)
        grid = met.groupBy(*keys).agg(*[
            F.percentile_approx(F.when(wide[i] & inside(i), c("v", i)), points, GRID_ACCURACY).alias(f"_g{i}") for i in cols])
        narrow = {}
        for i in cols:
            low, high = ranks(i)
            at = F.floor((low - c("below", i)) / c("in", i) * GRID_STEPS).cast("int") - 1
            to = F.ceil((high - c("below", i)) / c("in", i) * GRID_STEPS).cast("int") + 1
            narrow[f"_lo{i}"] = F.coalesce(F.when(wide[i] & (at >= 0), F.get(c("g", i), at)), c("lo", i))
            narrow[f"_hi{i}"] = F.coalesce(F.when(wide[i] & (to <= GRID_STEPS), F.get(c("g", i), to)), c("hi", i))
        nets = state.join(grid, keys).select(*keys, *[f"_n{i}" for i in cols], *[e.alias(k) for k, e in narrow.items()])
        old, state = state, count(rows.join(nets, keys), ends + [f"_n{i}" for i in cols], [])
        discard(old)
    held = rows.join(state, keys).groupBy(*keys).agg(*[
        F.sort_array(F.collect_list(F.when(wanted(i) & inside(i), c("v", i)))).alias(f"_held{i}") for i in cols])

    def at_rank(i: int, r: Column) -> Column:
        past = r > c("below", i) + c("in", i)
        return (F.when(r <= c("below", i), c("lo", i)).when(past, F.coalesce(c("hi", i), F.lit(float("nan"))))
                .otherwise(F.get(c("held", i), (r - c("below", i) - 1).cast("int"))))

    out = state.join(held, keys).select(
        *keys,
        *[F.when(c("n", i) > 0, (at_rank(i, ranks(i)[0]) + at_rank(i, ranks(i)[1])) / 2.0).alias(v)
          for i, v in enumerate(values)],
        *[c("n", list(values).index(v)).alias(name) for name, v in (counts or {}).items()])
    out = materialize(out.filter(F.coalesce(*[F.col(v) for v in values]).isNotNull()), "medians")
    discard(rows)
    discard(state)
    return out
