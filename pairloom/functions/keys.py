"""Keys: cleaned identifiers and fixed-size digests of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters taken as surrounding blanks.
BLANKS = " \t\r\n\f\v\u00a0\u200b\ufeff"


def clean_key(col: Column | str) -> Column:
    """A key without regard to letter case and surrounding blanks; null stays null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def digest_key(*cols: Column) -> Column:
    """16 bytes that stand for the tuple of ``cols``.

    Fields are length-prefixed and a null differs from every string, so tuples
    that differ give different inputs to SHA-256, of which 128 bits are kept.
    """
    parts = []
    for c in cols:
        s = c.cast("string")
        parts.append(F.coalesce(F.concat(F.length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.unhex(F.substring(F.sha2(F.concat(*parts), 256), 1, 32))
