"""Column expressions that read labels out of sample, pool and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from biascomp.functions.numeric import col

# The name formats in use.
LAST_DOT_TOKEN = r"^(.*)\.[^.]+$"          # everything before the last dot token
LAST_UNDERSCORE_TOKEN = r"([^_]+)$"        # marker at the end of a pool key
LEADING_TOKEN = r"^([^_-]+)"               # cycle at the start of an object id
PREDICTED_ID = r"predicted (\S+)"          # sample behind a predicted replicate
SNAPSHOT_DATE = r"(\d{2}_\d{2}_\d{4})"     # month_day_year in a file name
SNAPSHOT_DATE_FORMAT = "MM_dd_yyyy"
SIZE_TOKEN = r"(S1|S2|S3)"                 # size class inside a key
VARIANT_SUFFIX = r"\sASV\s\d+$"            # numbered variant of a species
SIZE_CODES = {"S1": 0.2, "S2": 0.5, "S3": 1.0}
POOL_RANKS = {"All": 1, "A1": 2, "B3": 3, "C5": 4, "AllandSub": 5}


def extract(c: Column | str, pattern: str) -> Column:
    """First capture group, NULL where the pattern does not match.

    The argument is used once: filters on the result are pushed down to the scan with the whole
    expression behind the argument, and must not multiply it.
    """
    return F.nullif(F.regexp_extract(col(c), pattern, 1), F.lit(""))


def drop_last_token(c: Column | str) -> Column:
    """Everything before the last dot; NULL without a dot or with nothing around it."""
    return extract(c, LAST_DOT_TOKEN)


def last_token(c: Column | str) -> Column:
    return extract(c, LAST_UNDERSCORE_TOKEN)


def leading_token(c: Column | str) -> Column:
    return extract(c, LEADING_TOKEN)


def predicted_id(c: Column | str) -> Column:
    return extract(c, PREDICTED_ID)


def snapshot_date(c: Column | str) -> Column:
    return F.to_date(extract(c, SNAPSHOT_DATE), SNAPSHOT_DATE_FORMAT)


def strip_prefix(c: Column | str, prefix: str) -> Column:
    return F.regexp_replace(col(c), f"^{prefix}", "")


def strip_variant(c: Column | str) -> Column:
    return F.regexp_replace(col(c), VARIANT_SUFFIX, "")


def normal_id(c: Column | str) -> Column:
    """Lower case with dashes as underscores."""
    return F.lower(F.replace(col(c), F.lit("-"), F.lit("_")))


def leading_number(c: Column | str, width: int, default: int) -> Column:
    """Number in the first ``width`` characters, ``default`` where there is none."""
    head = F.substring(col(c), 1, width)
    return F.when(head.rlike(r"^\d+$"), head.cast("int")).otherwise(F.lit(default))


def code(c: Column | str, codes: dict[str, object]) -> Column:
    """Map labels to codes; NULL for labels outside the table."""
    c = col(c)
    out = None
    for label, value in codes.items():
        out = F.when(c == label, F.lit(value)) if out is None else out.when(c == label, F.lit(value))
    return out
