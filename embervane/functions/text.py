"""String and label functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vectors import _c

#: Severity, least first.
FLAGS = ("normal", "flagged", "suspect", "candidate")


def clean_code(code) -> Column:
    """A class code without dashes and blanks, trailing ``.0`` or exponent."""
    s = F.regexp_replace(F.trim(_c(code).cast("string")), r"[-\s]", "")
    s = F.regexp_replace(s, r"\.0+$", "")
    return F.when(s.rlike(r"^\d+(\.\d+)?[eE]\+?\d+$"), s.cast("decimal(38,0)").cast("string")).otherwise(s)


def flag_rank(flag) -> Column:
    r = F.lit(0)
    for i, name in enumerate(FLAGS):
        r = F.when(F.lower(F.trim(_c(flag))) == name, F.lit(i)).otherwise(r)
    return r


def flag_name(rank) -> Column:
    return F.element_at(F.array(*[F.lit(f) for f in FLAGS]), F.least(F.greatest(_c(rank), F.lit(0)), F.lit(len(FLAGS) - 1)) + 1)


def in_classes(label, classes) -> Column:
    """Case and surrounding blanks don't count."""
    return F.coalesce(F.lower(F.trim(_c(label).cast("string"))).isin([str(c).strip().lower() for c in classes]), F.lit(False))


def column_fingerprint(names: list[str]) -> Column:
    """SHA-256 of columns in the order of their names."""
    return F.sha2(F.concat_ws("\n", *[F.concat_ws("=", F.lit(n), F.col(n).cast("string")) for n in sorted(names)]), 256)
