"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every historical version of a path is content-addressed by the SHA-256 of
its text.  The ledger, a Parquet table in a shared folder, has one row for
each (blob, rule, rule version) ever scanned, with the spans found; a scan
looks at only those pairs that the ledger lacks, appends them, and joins the
findings back to all paths that hold the blob.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``regex`` count if ``group`` has at least ``least`` characters."""

    kind: str
    regex: str
    group: int
    least: int
    version: int = 1


# Fixed patterns of the base rules, in the order in which kinds are listed.
# Runs of one character class match as a whole from their start, so for
# "access" and "hex" the least length can stand in the pattern itself.
BASE_RULES = (
    Rule("assign", r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"""
                   r"""|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 6),
    Rule("access", r"(AKIA[A-Z0-9]{16,})", 1, 20),
    Rule("hex", r"([0-9a-f]{24,})", 1, 24),
)

LEDGER_SCHEMA = ("blob binary, kind string, version int, "
                 "spans array<struct<`start`:bigint,`end`:bigint>>")


def blob_id(text: Column) -> Column:
    """Content address: SHA-256 of the UTF-8 text, null as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at ``path``, or None where none was written yet."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def match_lengths(text: Column, rule: Rule) -> Column:
    """For each match in order: characters before it since the last match, of it, and of the judged group.

    Splitting at the matches and extracting them walk the text the same way,
    so lengths of both give every position without a Python matcher.
    """
    gaps = F.transform(F.split(text, rule.regex, -1), lambda s: F.length(s).cast("long"))
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0)), lambda s: F.length(s).cast("long"))
    judged = F.transform(F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group)), F.length)
    return F.when(text.rlike(rule.regex), F.arrays_zip(
        F.slice(gaps, 1, F.size(whole)).alias("gap"), whole.alias("len"), judged.alias("judged")))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows for ``blobs`` (blob, text, todo: kinds to scan)."""
    per_rule = F.array(*[
        F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.lit(r.least).alias("least"),
                 F.when(F.array_contains("todo", r.kind), match_lengths(F.col("text"), r)).alias("found"))
        for r in rules])
    rows = (blobs.select("blob", "todo", F.explode(per_rule).alias("r"))
            .where(F.array_contains("todo", F.col("r.kind")))
            .select("blob", "r.*"))
    # From here on only lengths are moved.  A window holds the matches of one
    # rule in one text; a text without a match has one row of nulls.
    hits = rows.select("blob", "kind", "version", "least", F.posexplode_outer("found").alias("at", "m"))
    upto = Window.partitionBy("blob", "kind", "version").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    span = F.when(F.col("m.judged") >= F.col("least"),
                  F.struct((F.col("end") - F.col("m.len")).alias("start"), F.col("end").alias("end")))
    return (hits.withColumn("end", F.sum(F.col("m.gap") + F.col("m.len")).over(upto))
            .groupBy("blob", "kind", "version")
            .agg(F.array_sort(F.collect_list(span)).alias("spans")))


def update_ledger(versions: DataFrame, ledger: str, text: str = "text",
                  rules: tuple[Rule, ...] = BASE_RULES) -> int:
    """Scan the (blob, rule version) pairs of ``versions`` that the ledger lacks; returns how many it added.

    Equal texts are one blob and are scanned once.  A failed run appends
    nothing (Parquet's committer publishes whole jobs), and a repeated run
    finds every pair present.
    """
    spark = versions.sparkSession
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    blobs = (versions.select(body.alias("text")).select(blob_id(F.col("text")).alias("blob"), "text")
             .dropDuplicates(["blob"]))
    known = read_ledger(spark, ledger)
    if known is None:
        todo = blobs.withColumn("todo", kinds)
    else:
        current = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
        seen = (known.where(F.array_contains(current, F.struct("kind", "version")))
                .groupBy("blob").agg(F.collect_set("kind").alias("seen")))
        todo = (blobs.join(seen, "blob", "left")
                .withColumn("todo", F.array_except(kinds, F.coalesce("seen", F.array().cast("array<string>"))))
                .where(F.size("todo") > 0).drop("seen"))
    before = 0 if known is None else known.count()
    scan_blobs(todo, rules).write.mode("append").option("compression", "zstd").parquet(ledger)
    return read_ledger(spark, ledger).count() - before


def blob_findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """(blob, spans): for each blob with findings of the current rule versions, its spans
    (start, rank of the kind, kind, end), sorted by start, then kind as listed."""
    listed = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"),
                                F.lit(i).alias("rank")) for i, r in enumerate(rules)])
    current = F.filter(listed, lambda x: (x["kind"] == F.col("kind")) & (x["version"] == F.col("version")))
    rows = (read_ledger(spark, ledger).where(F.size("spans") > 0)
            .dropDuplicates(["blob", "kind", "version"])
            .withColumn("rule", F.get(F.transform(current, lambda x: x["rank"]), F.lit(0)))
            .where("rule is not null"))
    shaped = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), F.col("rule").alias("rank"),
                                                     F.col("kind").alias("kind"), s["end"].alias("end")))
    return rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(shaped))).alias("spans"))


def scan_versions(versions: DataFrame, ledger: str, text: str = "text",
                  rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """``versions`` with ``blob`` and ``spans`` (array of start, rank, kind, end; code points, end exclusive).

    Null texts count as empty; a version without findings has an empty array.
    Repeated rows and equal texts share one ledger entry and each row gets the
    spans.  Kinds are judged alone, so spans of different kinds may overlap.
    Other columns are kept, but for ones named ``blob`` or ``spans``.
    """
    spark = versions.sparkSession
    update_ledger(versions, ledger, text, rules)
    found = blob_findings(spark, ledger, rules)
    keep = [F.col(f"`{c}`") for c in versions.columns if c not in ("blob", "spans")]
    none = F.array().cast("array<struct<`start`:bigint,rank:int,kind:string,`end`:bigint>>")
    return (versions.select(*keep, blob_id(F.col(f"`{text}`")).alias("blob"))
            .join(found, "blob", "left")
            .select(*keep, "blob", F.coalesce("spans", none).alias("spans")))


def span_string(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined in order."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every maximal run of overlapping spans replaced by one ``mark``."""
    start = {"at": F.lit(0).cast("long"), "keep": F.array().cast("array<struct<a:bigint,b:bigint>>")}

    def step(acc: Column, s: Column) -> Column:
        fresh = (s["start"] >= acc["at"]) | (F.size(acc["keep"]) == 0)
        piece = F.array(F.struct(acc["at"].alias("a"), s["start"].alias("b")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(acc["keep"], piece)).otherwise(acc["keep"]).alias("keep"))

    cut = F.aggregate(spans, F.struct(start["at"].alias("at"), start["keep"].alias("keep")), step)

    def part(a: Column, n: Column) -> Column:
        return F.substring(text, (a + 1).cast("int"), n.cast("int"))

    pieces = F.transform(cut["keep"], lambda k: part(k["a"], k["b"] - k["a"]))
    tail = part(cut["at"], F.greatest(F.length(text) - cut["at"], F.lit(0)))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(pieces, mark), F.lit(mark), tail))


def redact_secrets(docs: DataFrame, ledger: str, text: str = "text", chars: str = "n_chars",
                   rules: tuple[Rule, ...] = BASE_RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret replaced by ``mark``, and ``chars`` (if present) set to the new length.

    No document is dropped; texts without a finding stay as they are, null ones too.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    scanned = scan_versions(docs.select(row.alias("row"), F.col(f"`{text}`").alias("text")), ledger, "text", rules)
    new = F.when(F.size("spans") > 0, redact(F.col("text"), F.col("spans"), mark)).otherwise(F.col("text"))
    out = scanned.select("row", new.alias("new"), (F.size("spans") > 0).alias("hit"))
    cols = []
    for c in docs.columns:
        old = F.col("row")[c]
        if c == text:
            cols.append(F.col("new").alias(c))
        elif c == chars:
            kind = docs.schema[c].dataType
            cols.append(F.when(F.col("hit"), F.length("new").cast(kind)).otherwise(old).alias(c))
        else:
            cols.append(old.alias(c))
    return out.select(*cols)
