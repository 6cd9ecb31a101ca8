"""Bounded samples of labelled rows for fitting, the same for the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


def share(id_col: str) -> Column:
    """A uniform number in [0, 1) that hangs on the id alone."""
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)


#: Values that a sample is dealt over at most; if there are more, the commonest.  A model is fitted on these alone.
CLASSES = 1000


def sample(rows: DataFrame, by: str, bound: int, id_col: str) -> DataFrame:
    """About ``bound`` rows (all, if fewer) in equal parts of each value of ``by``, of up to CLASSES values; chosen by a hash of the id."""
    sizes = {r[by]: r["count"] for r in rows.groupBy(by).count().orderBy(F.desc("count"), by).limit(CLASSES).collect()}
    if not sizes:
        return rows
    each = max(1, bound // len(sizes))
    spare = bound - sum(min(n, each) for n in sizes.values())
    large = [v for v, n in sizes.items() if n > each]
    each += spare // max(1, len(large))
    keep = F.lit(False)
    for v, n in sizes.items():
        keep = keep | ((F.col(by) == F.lit(v)) & (share(id_col) < min(1.0, each / n)))
    return rows.where(keep)
