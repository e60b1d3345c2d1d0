"""Year assignment for territory file paths, as a Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the published year-detection rules)
# ---------------------------------------------------------------------------
# Accepted year range, inclusive.
YEAR_MIN = 1995
YEAR_MAX = 2022
# Tier 1: searched in the file stem (name without its last extension), in order.
FILENAME_PATTERNS = (
    r"^(\d{4})_\w+",
    r"ter(\d{4})",
    r"^(\d{4})_all",
    r"_(\d{4})$",
    r"_(\d{4})_mcp",
)
# Tier 2: searched in the whole path, case-insensitive, in order.
PATH_PATTERNS = (
    r"/(\d{4})\s*mcps?/",
    r"/(\d{4})\s*MCPs?/",
    r"/(\d{4})\s*Wolf[^/]*/",
    r"/(\d{4})_Wolf[^/]*/",
    r"/(\d{4})/",
)
# Tier 3: every free 4-digit run in the path; the last one in range wins.
FREE_YEAR_PATTERN = r"(?<![/_])(\d{4})(?![/_\d])"
# ---------------------------------------------------------------------------


def _in_range(y: Column) -> Column:
    return (y >= YEAR_MIN) & (y <= YEAR_MAX)


def _first_match_year(s: Column, pattern: str) -> Column:
    """Year captured by the first match of ``pattern``; NULL when absent or out of range."""
    y = F.regexp_extract(s, pattern, 1)
    yi = F.when(y != "", y.cast("int"))
    return F.when(_in_range(yi), yi)


def file_stem(path) -> Column:
    """Last path component without its final ``.ext`` (a leading dot is kept)."""
    path = F.col(path) if isinstance(path, str) else path
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def path_year(path, tiers: int = 3) -> Column:
    """Year of a territory file from its path, or NULL.

    A pattern that matches a year outside the accepted range does not stop
    the search; the next pattern is tried.  ``tiers`` limits the search to
    the first one or two tiers (tier 3 needs look-behind).
    """
    path = F.col(path) if isinstance(path, str) else path
    stem = file_stem(path)
    cands = [_first_match_year(stem, p) for p in FILENAME_PATTERNS]
    if tiers >= 2:
        cands += [_first_match_year(path, "(?i)" + p) for p in PATH_PATTERNS]
    if tiers >= 3:
        runs = F.transform(F.regexp_extract_all(path, F.lit(FREE_YEAR_PATTERN), 1), lambda r: r.cast("int"))
        ok = F.filter(F.reverse(runs), _in_range)
        cands.append(F.try_element_at(ok, F.lit(1)))
    return F.coalesce(*cands)
