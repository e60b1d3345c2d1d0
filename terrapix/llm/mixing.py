"""Mixing sources to target weights by iterative proportional fitting.

Token totals of the cells (source, language, topic) are raked to target
shares of each marginal; a document's calibration weight is its cell's
raked total over its actual one, and documents are sampled with
probability proportional to that weight (at most 1) so that the expected
number of tokens meets a budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapix.sources.store import discard, materialize

DIMS = ("source", "lang", "topic")
MISSING = "\u0000null"  # key of null values; no tagged value can equal it


def word_tokens(text: Column) -> Column:
    """Number of whitespace-separated words; null and blank texts have none."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(F.size(F.split(t, r"\s+"))).cast("long")


def length_topic(n_tokens: Column) -> Column:
    """Where documents carry no topic: their length band."""
    return F.when(n_tokens < 150, "short").when(n_tokens < 1000, "medium").otherwise("long")


def as_key(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(MISSING))


def cell_table(items: DataFrame, dims: tuple[str, ...] = DIMS, tokens: str = "n_tokens") -> DataFrame:
    """One row for each cell that occurs, with its tokens; partial sums are made before the shuffle."""
    return (items.groupBy(*[as_key(F.col(d)).alias(d) for d in dims])
            .agg(F.sum(F.col(tokens)).cast("double").alias("tokens"))
            .where("tokens > 0"))


def tempered_shares(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """(value, share): shares proportional to tokens**power; 0 gives equal shares, 1 the natural ones."""
    totals = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").alias("t"))
    raised = totals.select("value", F.pow("t", F.lit(float(power))).alias("p"))
    total = raised.agg(F.sum("p")).first()[0] or 1.0
    return raised.select("value", (F.col("p") / F.lit(float(total))).alias("share"))


def rake(cells: DataFrame, shares: dict[str, DataFrame], max_sweeps: int = 40, tolerance: float = 1e-4) -> DataFrame:
    """``cells`` with ``raked``: tokens fitted to ``shares`` ({dimension: (value, share)}), same grand total;
    ``sweeps`` made, and ``residual``: how far, relatively, the last of them still had to move a marginal.

    A value without a share gets 0; shares of values that do not occur are
    spread over the others in proportion.  Sweeps end when no marginal had to
    move by more than ``tolerance`` (relative), or after ``max_sweeps`` where
    empty cells make the targets unreachable; ``residual`` tells.  One row for each cell is all
    that moves; marginals are partial sums joined back, so a value holding
    most cells is no single task.
    """
    dims = list(shares)
    known = [c for c in cells.columns if c != "tokens"]
    cur = cells
    for i, d in enumerate(dims):
        s = shares[d].groupBy("value").agg(F.sum("share").alias("share"))
        cur = cur.join(s.select(F.col("value").alias(d), F.col("share").alias(f"share{i}")), d, "left")
    alive = F.lit(True)
    for i in range(len(dims)):
        cur = cur.withColumn(f"share{i}", F.coalesce(f"share{i}", F.lit(0.0)))
        alive = alive & (F.col(f"share{i}") > 0)
    cur = materialize(cur.withColumn("raked", F.when(alive, F.col("tokens")).otherwise(0.0))
                      .withColumn("moved", F.lit(0.0)), "llm-cells")
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    present = [cur.where("raked > 0").groupBy(d).agg(F.first(f"share{i}").alias("s")).agg(F.sum("s")).first()[0] or 1.0
               for i, d in enumerate(dims)]
    sweeps, residual = 0, 0.0
    while sweeps < max_sweeps:
        step = cur.withColumn("moved", F.lit(0.0))
        for i, d in enumerate(dims):
            margin = step.groupBy(d).agg(F.sum("raked").alias("margin"))
            goal = F.col(f"share{i}") * F.lit(total / present[i])
            factor = F.when(F.col("margin") > 0, goal / F.col("margin")).otherwise(0.0)
            change = F.when(F.col("raked") > 0, F.abs(factor - 1)).otherwise(0.0)
            step = (step.join(margin, d)
                    .withColumn("moved", F.greatest("moved", change))
                    .withColumn("raked", F.col("raked") * factor).drop("margin"))
        old, cur = cur, materialize(step, "llm-cells")
        discard(old)
        sweeps, residual = sweeps + 1, cur.agg(F.max("moved")).first()[0] or 0.0
        if residual <= tolerance:
            break
    return cur.select(*known, "tokens", "raked", F.lit(sweeps).alias("sweeps"), F.lit(float(residual)).alias("residual"))


def budget_scale(cells: DataFrame, budget: float) -> float:
    """The factor L for which sum(tokens * min(1, L * raked / tokens)) is ``budget``
    (or its largest value where all of the raked cells would be kept)."""
    scale, full = 0.0, -1
    while True:
        sat = F.col("raked") * F.lit(scale) >= F.col("tokens")
        kept, rest, n = cells.where("raked > 0").agg(
            F.sum(F.when(sat, F.col("tokens")).otherwise(0.0)),
            F.sum(F.when(sat, 0.0).otherwise(F.col("raked"))), F.sum(sat.cast("int"))).first()
        n = n or 0
        if n == full or not rest:
            return scale if n == full else max(scale, 1e300 if n else 0.0)
        full, scale = n, max(scale, (budget - (kept or 0.0)) / rest)


def mix_documents(docs: DataFrame, shares: dict[str, DataFrame] | None = None, keep: float = 0.5, seed: int = 42,
                  doc_id: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang",
                  topic: str | None = None, powers: dict[str, float] | None = None, with_row: bool = True) -> DataFrame:
    """Per row of ``docs``: doc_id, source, lang, topic, n_tokens, weight, prob, sampled, the raking's sweeps and
    residual (null in a cell without tokens), and, ``with_row``, the row as ``row``.

    Texts are read once: what is kept of a row is written, and the rest of the
    work reads that.  A text of any length is one row's word count and hash.

    ``shares`` gives (value, share) of dimensions; for the others they are
    the natural shares raised to ``powers`` (default: sources 0.3, languages
    0.5, topics 0.7).  ``keep`` is the budget as a share of all tokens.  A null
    value of a dimension is a category of its own.  Documents without words
    weigh 0 tokens and are kept with their cell's probability, or dropped
    where their cell has no tokens.  Equal rows meet the same fate; an empty
    table gives an empty result.
    """
    n = word_tokens(F.col(text))
    topic_of = F.col(topic).cast("string") if topic else length_topic(F.col("n_tokens"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    u = F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"),
                       F.col(lang).cast("string").alias("lang"), n.alias("n_tokens"), u.alias("_u"),
                       *([F.col(topic).cast("string").alias("topic")] if topic else []),
                       *([row.alias("row")] if with_row else []))
    if not topic:
        base = base.withColumn("topic", topic_of)
    base = materialize(base, "llm-mixing")
    cells = materialize(cell_table(base), "llm-cells")
    raise_to = {"source": 0.3, "lang": 0.5, "topic": 0.7} | (powers or {})
    goal = {d: (shares or {}).get(d) or tempered_shares(cells, d, raise_to[d]) for d in DIMS}
    raked = rake(cells, goal)
    total = cells.agg(F.sum("tokens")).first()[0] or 0.0
    discard(cells)
    scale = budget_scale(raked, keep * total)
    rate = raked.select(*[F.col(d).alias(f"_{d}") for d in DIMS], (F.col("raked") / F.col("tokens")).alias("weight"),
                        "sweeps", "residual")
    joined = base
    for d in DIMS:
        joined = joined.withColumn(f"_{d}", as_key(F.col(d)))
    return (joined.join(rate, [f"_{d}" for d in DIMS], "left")
            .withColumn("weight", F.coalesce("weight", F.lit(0.0)))
            .withColumn("prob", F.least(F.lit(1.0), F.col("weight") * F.lit(scale)))
            .withColumn("sampled", F.col("_u") < F.col("prob"))
            .select("doc_id", "source", "lang", "topic", "n_tokens", "weight", "prob", "sampled", "sweeps", "residual",
                    *(["row"] if with_row else [])))
