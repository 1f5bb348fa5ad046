"""What several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII texts take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
